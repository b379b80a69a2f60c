"""Exact stratified splits, folds and samples that shuffle no data rows.

Each row has a hash key. A stratum's first ``q`` rows in key order are exactly
the rows at or below one *cutoff key*, so a split is: find the cutoffs, then
compare. Finding them counts rows per stratum and leading hex digits (a small
aggregate), and ranks only the rows of the few hash slots a cutoff falls in.
Assigning is a narrow pass over the rows. Same result for any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions.rates import percent, ratio
from cohortlens.operators.ordering import HASH_DIGITS, hash_key
from cohortlens.operators.validate import require_proportions
from cohortlens.storage import BROADCAST_ROWS, broadcast_if_small, materialise


def stratum_key(*columns: str) -> Column:
    """The values joined by ``_``; one that holds the sign, and a missing one, are marked by a backslash.

    So different rows of values never share a key.
    """
    def part(column: str) -> Column:
        text = F.replace(F.col(column).cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(text, F.lit("_"), F.lit("\\_")), F.lit("\\N"))

    return F.concat_ws("_", *[part(c) for c in columns])


def rare_strata(df: DataFrame, stratum: str,
                least: int = K.RARE_STRATUM_ROWS) -> DataFrame:
    return (df.groupBy(stratum).agg(F.count("*").alias("_n"))
            .where(F.col("_n") < least).select(stratum))


def collapse_rare(df: DataFrame, stratum: str, least: int = K.RARE_STRATUM_ROWS,
                  name: str = K.RARE_STRATUM_NAME) -> DataFrame:
    """Rename strata with fewer than ``least`` rows to one common name."""
    rare = materialise(rare_strata(df, stratum, least), "rare-strata")
    if rare.isEmpty():
        return df
    marked = df.join(
        broadcast_if_small(rare.withColumn("_rare", F.lit(True))), stratum, "left")
    renamed = F.when(F.col("_rare"), F.lit(name)).otherwise(F.col(stratum))
    return marked.withColumn(stratum, renamed).select(*df.columns)


def apportion(sizes: DataFrame, size: str, target: Column, name: str) -> DataFrame:
    """Share ``target`` rows out over the strata, exactly.

    Floor of the proportional share, then one more for the largest remainders;
    equal remainders are served in stratum order. Works on one row per stratum.
    """
    every = Window.partitionBy()
    exact = F.col(size).cast("decimal(19,0)") * F.col("_want").cast("decimal(19,0)")
    parts = (sizes.withColumn("_all", F.sum(size).over(every))
             .withColumn("_want", F.least(target, F.col("_all")).cast("bigint"))
             .withColumn("_exact", exact)
             .withColumn("_low", F.expr("CASE WHEN _all = 0 THEN 0 ELSE _exact div _all END"))
             .withColumn("_rest", F.expr(
                 "CASE WHEN _all = 0 THEN 0 ELSE _exact - _low * cast(_all AS decimal(19,0)) END")))
    queue = Window.partitionBy().orderBy(F.desc("_rest"), "stratum")
    extra = F.row_number().over(queue) <= F.col("_want") - F.sum("_low").over(every)
    return (parts.withColumn(name, F.col("_low") + extra.cast("int"))
            .drop("_all", "_want", "_exact", "_low", "_rest"))


def _keyed(df: DataFrame, id_col: str, stratum: Column, seed: int) -> DataFrame:
    return (df.withColumn("stratum", stratum)
            .withColumn("_key", hash_key(seed, id_col)))


def _slot_counts(keyed: DataFrame, digits: int) -> DataFrame:
    return (keyed.groupBy("stratum", F.substring("_key", 1, digits).alias("_slot"))
            .agg(F.count("*").alias("_n")))


def _cutoffs(keyed: DataFrame, id_col: str, slots: DataFrame, ends: DataFrame,
             marks: int, digits: int,
             side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per stratum, the key of the row at each of ``ends`` (an array of ranks).

    A rank of 0 has no row and no cutoff (null); a rank of the whole stratum
    has its last row's.
    """
    before = (Window.partitionBy("stratum").orderBy("_slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    hit = (slots.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
           .join(ends, "stratum")
           .withColumn("_here", F.filter(
               F.transform("ends", lambda r, i: F.struct(
                   i.alias("mark"), (r - F.col("_start")).alias("rank"))),
               lambda m: (m["rank"] >= 1) & (m["rank"] <= F.col("_n"))))
           .where(F.size("_here") > 0).select("stratum", "_slot", "_here"))
    hit = side(hit)
    place = F.row_number().over(
        Window.partitionBy("stratum", "_slot").orderBy("_key", id_col))
    near = (keyed.select("stratum", "_key", id_col)
            .withColumn("_slot", F.substring("_key", 1, digits))
            .join(hit, ["stratum", "_slot"])
            .withColumn("_place", place)
            .withColumn("_mark", F.explode(F.filter(
                "_here", lambda m: m["rank"] == F.col("_place")))))
    cut = F.struct(F.col("_key").alias("key"), F.col(id_col).alias("id"))
    found = near.groupBy("stratum").agg(*[
        F.max(F.when(F.col("_mark.mark") == i, cut)).alias(f"_cut{i}")
        for i in range(marks)])
    return ends.select("stratum").join(found, "stratum", "left")


def _at_or_below(id_col: str, mark: int) -> Column:
    here = F.struct(F.col("_key").alias("key"), F.col(id_col).alias("id"))
    return F.coalesce(here <= F.col(f"_cut{mark}"), F.lit(False))


def _cut_rows(keyed: DataFrame, id_col: str, slots: DataFrame, ends: DataFrame,
              marks: int, digits: int) -> DataFrame:
    """The rows with their stratum's cutoffs.

    Cutoffs and the slots they fall in number at most strata x marks. The slot
    table tells how many strata there are, and so whether they may be broadcast
    or must join by shuffle.
    """
    few = slots.select("stratum").distinct().count() * marks <= BROADCAST_ROWS
    side = F.broadcast if few else (lambda table: table)
    cuts = _cutoffs(keyed, id_col, slots, ends, marks, digits, side)
    return keyed.join(side(cuts), "stratum")


def split_sizes(slots: DataFrame, parts: Sequence[tuple[str, float]]) -> DataFrame:
    """Rows per stratum and part, cut one part at a time from what remains.

    Each cut takes ``p / (p + following parts)`` of the remaining rows, so three
    parts mean two cuts: first from all, then from the rest.
    """
    sizes = slots.groupBy("stratum").agg(F.sum("_n").alias("_left"))
    for i, (_, p) in enumerate(parts[:-1]):
        follow = sum(q for _, q in parts[i:])
        fraction = p / follow if i else p
        total = F.sum("_left").over(Window.partitionBy())
        sizes = apportion(sizes, "_left", F.floor(F.lit(float(fraction)) * total),
                          f"_part{i}")
        sizes = sizes.withColumn("_left", F.col("_left") - F.col(f"_part{i}"))
    return sizes.withColumnRenamed("_left", f"_part{len(parts) - 1}")


def stratified_split(df: DataFrame, id_col: str, strata: Sequence[str],
                     parts: Sequence[tuple[str, float]] = tuple(K.SPLIT_PARTS),
                     seed: int = K.SEED, name: str = "conjunto",
                     digits: int = HASH_DIGITS) -> DataFrame:
    """Add the part of every row; sizes are exact overall and per stratum."""
    require_proportions(parts)
    keyed = _keyed(df, id_col, stratum_key(*strata), seed)
    slots = materialise(_slot_counts(keyed.select("stratum", "_key"), digits), "slots")
    sizes = split_sizes(slots, parts)
    ends = [sum((F.col(f"_part{j}") for j in range(i + 1)), F.lit(0))
            .cast("bigint") for i in range(len(parts) - 1)]
    ends = sizes.select("stratum", F.array(*ends).alias("ends"))
    rows = _cut_rows(keyed, id_col, slots, ends, len(parts) - 1, digits)
    part = F.lit(parts[-1][0])
    for i in reversed(range(len(parts) - 1)):
        part = F.when(_at_or_below(id_col, i), F.lit(parts[i][0])).otherwise(part)
    return rows.select(*df.columns, part.alias(name))


def stratified_folds(df: DataFrame, id_col: str, strata: Sequence[str],
                     k: int = K.FOLDS, seed: int = K.SEED, name: str = "fold",
                     digits: int = HASH_DIGITS) -> DataFrame:
    """Add a fold number 0..k-1; folds of a stratum differ by at most one row."""
    keyed = _keyed(df, id_col, stratum_key(*strata), seed)
    slots = materialise(_slot_counts(keyed.select("stratum", "_key"), digits), "slots")
    sizes = slots.groupBy("stratum").agg(F.sum("_n").alias("_n"))
    ends = sizes.select("stratum", F.array(*[
        F.ceil(F.col("_n") * j / k).cast("bigint") for j in range(1, k)]).alias("ends"))
    rows = _cut_rows(keyed, id_col, slots, ends, k - 1, digits)
    # with fewer rows than folds two ends may meet: the last one counts
    fold = sum(((~_at_or_below(id_col, i)).cast("int") for i in range(k - 1)), F.lit(0))
    return rows.select(*df.columns, fold.alias(name))


def sized_samples(df: DataFrame, id_col: str, strata: Sequence[str],
                  sizes: Sequence[int | None], seed: int = K.SEED,
                  least: int = K.RARE_STRATUM_ROWS,
                  digits: int = HASH_DIGITS) -> DataFrame:
    """Stratified samples of several exact sizes from one pass over the rows.

    A row appears once for every sample it is in, told apart by ``sample_rows``
    (null for the sample that is the whole table). Rare strata are merged
    first. All samples follow one hash order, so a larger one starts with the
    rows of a smaller one wherever its stratum's quota grew.
    """
    with_key = df.withColumn("stratum", stratum_key(*strata))
    keyed = (collapse_rare(with_key, "stratum", least)
             .withColumn("_key", hash_key(seed, id_col)))
    slots = materialise(_slot_counts(keyed.select("stratum", "_key"), digits), "slots")
    quotas = slots.groupBy("stratum").agg(F.sum("_n").alias("_n"))
    fixed = [s for s in sizes if s is not None]
    there = slots.agg(F.sum("_n")).first()[0] or 0
    if any(n > there for n in fixed):
        raise ValueError(f"a sample of {max(fixed)} rows is asked for, the table has {there}")
    for i, n in enumerate(fixed):
        quotas = apportion(quotas, "_n", F.lit(n), f"_q{i}")
    ends = quotas.select("stratum", F.array(*[
        F.col(f"_q{i}").cast("bigint") for i in range(len(fixed))]).alias("ends"))
    rows = _cut_rows(keyed, id_col, slots, ends, len(fixed), digits)
    marks = [F.when(_at_or_below(id_col, i), F.struct(F.lit(n).cast("bigint").alias("n")))
             for i, n in enumerate(fixed)]
    marks += [F.struct(F.lit(None).cast("bigint").alias("n"))
              for s in sizes if s is None]
    return (rows.withColumn("_in", F.explode(F.filter(
        F.array(*marks), lambda m: m.isNotNull())))
        .select(*df.columns, F.col("_in.n").alias("sample_rows")))


def stratified_sample(df: DataFrame, id_col: str, strata: Sequence[str], n: int,
                      seed: int = K.SEED, least: int = K.RARE_STRATUM_ROWS) -> DataFrame:
    return sized_samples(df, id_col, strata, [n], seed, least).drop("sample_rows")


def leave_one_group_out(df: DataFrame, group: str, shared: Column, held_out,
                        id_col: str, seed: int = K.SEED, test_share: float = 0.30,
                        name: str = "conjunto") -> DataFrame:
    """Test on one group, train on the others; shared rows are split by hash.

    ``shared`` marks the rows that belong to no group (the common negatives);
    an exact ``test_share`` of them goes to the test side.
    """
    common = stratified_split(
        df.where(shared).withColumn("_one", F.lit("shared")), id_col, ["_one"],
        [("train", 1 - test_share), ("test", test_share)], seed, name).drop("_one")
    own = df.where(~F.coalesce(shared, F.lit(False))).withColumn(
        name, F.when(F.col(group) == held_out, "test").otherwise("train"))
    return common.unionByName(own)


def split_conformity(df: DataFrame, part: str, target: str) -> DataFrame:
    """Per part and in total: rows, both class counts, percent and ratio."""
    counts = df.groupBy(part, target).agg(F.count("*").alias("_n"))
    table = counts.rollup(part).agg(
        F.sum("_n").alias("total"),
        F.coalesce(F.sum(F.when(F.col(target) == 0, F.col("_n"))), F.lit(0)).alias("n_0"),
        F.coalesce(F.sum(F.when(F.col(target) == 1, F.col("_n"))), F.lit(0)).alias("n_1"),
        F.grouping(part).alias("_g"))
    return table.select(
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(part)).alias(part),
        "total", "n_0", "n_1", percent("n_1", "total").alias("pct_1"),
        F.round(ratio("n_1", "n_0"), 4).alias("ratio"))
