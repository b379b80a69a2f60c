"""Running totals and positions over an order, with no task holding a group.

A window with no bounded partition sorts a whole group in one task. Here the
order is cut into slots first:

1. every row gets a slot number that respects the order;
2. slot totals (at most ``points + 1`` rows per group) give each slot's offset;
3. the window runs inside ``(group, slot)`` and the offset is added.

For values the cuts are the values of the counted rows with the smallest
hashes. Counted rows are distinct in ``(group, value)``, so that is a uniform
pick whatever the counts; a group with many values gets many cuts, and any
re-run picks the same ones. For hashed keys the leading hex digits do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS = 1023
HASH_DIGITS = 3


def split_points(hist: DataFrame, value: str, weights: Sequence[str],
                 by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """One row, one sorted array of at most ``points`` values to cut at.

    Asking for a positive weight keeps the weight columns in this branch of the
    plan, so that it reuses the shuffle of ``hist`` instead of a second scan.
    """
    weighs = sum((F.col(w) for w in weights), F.lit(0)) > 0
    picked = (hist.where(weighs).select(*by, value)
              .orderBy(F.xxhash64(*by, value), *by, value).limit(points))
    return picked.agg(F.sort_array(F.collect_set(value)).alias("points"))


def even_quantiles(value: str, n: int) -> Column:
    """About the ``n`` inner quantiles of a column, as an array; for cuts, where any values would do."""
    fractions = ", ".join(f"{(i + 1) / (n + 1)}D" for i in range(n))  # one text: each literal would be a call
    return F.expr(f"percentile_approx(`{value}`, array({fractions}), {4 * (n + 1)})")


def slot_of(value: Column, points: Column, most: int = POINTS) -> Column:
    """How many split points lie below ``value`` (binary search by halving)."""
    jumps = [1 << k for k in reversed(range(most.bit_length()))]
    below = F.aggregate(
        F.array(*[F.lit(j) for j in jumps]), F.lit(0),
        lambda at, jump: F.when(
            (at + jump <= F.size(points))
            & (F.try_element_at(points, at + jump) < value), at + jump,
        ).otherwise(at))
    # never null, and declared so: a join on the slot then adds no null check
    # that would repeat the search on the rows of the scan
    return F.coalesce(below, F.lit(0))


def with_slots(hist: DataFrame, value: str, weights: Sequence[str],
               by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """Add ``_slot``, the place of each row's value among the split points."""
    cuts = split_points(hist, value, weights, by, points).scalar()
    return with_slot_of(hist.withColumn("_points", cuts), value, points).drop("_points")


def with_slot_of(df: DataFrame, value: str, most: int = POINTS) -> DataFrame:
    """``slot_of`` the column ``value`` among ``_points``, as ``_slot``.

    One projection a halving: each reads the place so far several times, so Spark keeps them apart
    and compiles them; a function over an array would be interpreted, for every row and halving.
    """
    out = df.withColumn("_slot", F.lit(0))
    for jump in (1 << k for k in reversed(range(most.bit_length()))):
        next_ = F.col("_slot") + jump  # beyond the last point there is none, and null is not below
        out = out.withColumn("_slot", F.when(
            F.try_element_at("_points", next_) < F.col(value), next_).otherwise(F.col("_slot")))
    # never null, as in ``slot_of``
    return out.withColumn("_slot", F.coalesce("_slot", F.lit(0)))


def running_totals(hist: DataFrame, value: str, weights: Sequence[str],
                   by: Sequence[str] = (), descending: bool = False,
                   points: int = POINTS, follow: bool = False) -> DataFrame:
    """Add ``cum_w`` (inclusive) and ``total_w`` for every weight column.

    ``hist`` has one row per ``(by, value)``. With ``follow``, also adds
    ``next_w``: the weights of the row that follows in the order, null on the
    last one. Rows with a null group key or value form no group and drop out.
    """
    by = list(by)
    for key in (*by, value):
        hist = hist.where(F.col(key).isNotNull())
    cut = with_slots(hist, value, weights, by, points)
    order = F.desc if descending else F.asc
    first = F.max_by if descending else F.min_by

    slots = cut.groupBy(*by, "_slot").agg(
        *[F.sum(w).alias(f"_sum_{w}") for w in weights],
        first(F.struct(*weights), F.col(value)).alias("_head"))
    by_slot = Window.partitionBy(*by).orderBy(order("_slot"))
    before = by_slot.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = slots.select(
        *by, "_slot",
        *[F.coalesce(F.sum(f"_sum_{w}").over(before), F.lit(0)).alias(f"_off_{w}")
          for w in weights],
        *[F.sum(f"_sum_{w}").over(whole).alias(f"total_{w}") for w in weights],
        F.lead("_head").over(by_slot).alias("_next_head"))

    inside = Window.partitionBy(*by, "_slot").orderBy(order(value))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.join(offsets, [*by, "_slot"])
    out = joined.select(
        *hist.columns,
        *[(F.col(f"_off_{w}") + F.sum(w).over(so_far)).alias(f"cum_{w}")
          for w in weights],
        *[F.col(f"total_{w}") for w in weights],
        *([F.coalesce(F.lead(F.struct(*weights)).over(inside),
                      F.col("_next_head")).alias("_follow")] if follow else []))
    if follow:
        out = out.select("*", *[F.col(f"_follow.{w}").alias(f"next_{w}")
                                for w in weights]).drop("_follow")
    return out


def previous_in_order(df: DataFrame, by: Sequence[str], order: Sequence[str],
                      value: Column, name: str = "previous",
                      points: int = POINTS) -> DataFrame:
    """``value`` of the row before, in each group's order; null on the first.

    A long series is cut into slots of its order, so no task sorts a whole one;
    a slot's first row takes the last value of the slot before. ``order`` must
    be unique within the table, which also makes the result deterministic.
    Rows without an order key come first.
    """
    keyed = df.select("*", F.struct(*order).alias("_order"), value.alias("_value"))
    cuts = (keyed.select("_order").orderBy(F.xxhash64(*[F.col(f"_order.{o}") for o in order]),
                                           "_order").limit(points)
            .agg(F.sort_array(F.collect_list("_order"))).scalar())
    cut = (keyed.withColumn("_points", cuts)
           .withColumn("_slot", slot_of(F.col("_order"), F.col("_points"), points))
           .drop("_points"))
    tails = cut.groupBy(*by, "_slot").agg(
        F.max_by(F.struct("_value"), "_order").alias("_tail"))
    carried = tails.select(*by, "_slot", F.lag("_tail").over(
        Window.partitionBy(*by).orderBy("_slot")).alias("_carried"))
    inside = F.lag(F.struct("_value")).over(
        Window.partitionBy(*by, "_slot").orderBy("_order"))
    return (cut.join(carried, [*by, "_slot"])
            .withColumn(name, F.coalesce(inside, F.col("_carried"))["_value"])
            .select(*df.columns, name))


def hash_key(seed: int, *ids: str) -> Column:
    """Deterministic shuffle key: the same for any partitioning or row order."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)),
                             *[F.col(i).cast("string") for i in ids]))


def hash_positions(df: DataFrame, id_col: str, seed: int, by: Sequence[str] = (),
                   name: str = "position", digits: int = HASH_DIGITS) -> DataFrame:
    """0-based position of every row in its group's hashed order."""
    by = list(by)
    keyed = (df.withColumn("_key", hash_key(seed, id_col))
             .withColumn("_slot", F.substring("_key", 1, digits)))
    counts = keyed.groupBy(*by, "_slot").agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*by).orderBy("_slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        *by, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_slot").orderBy("_key", id_col)
    return (keyed.join(starts, [*by, "_slot"])
            .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
            .select(*df.columns, name))


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return (df.where(F.col(value).isNotNull())
            .groupBy(*by, value).agg(F.count("*").alias("n")))


def exact_quantiles(df: DataFrame, value: str, fractions: Sequence[float],
                    by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """Linear-interpolated quantiles per group, as an array in given order.

    Slot totals tell which slots hold the wanted ranks; only the value counts of
    those are sorted, and no group's values are ever gathered in one place.
    """
    by = list(by)
    hist = value_counts(df, value, by)
    for key in by:
        hist = hist.where(F.col(key).isNotNull())
    cut = with_slots(hist, value, ["n"], by, points)
    before = (Window.partitionBy(*by).orderBy("_slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    slots = cut.groupBy(*by, "_slot").agg(F.sum("n").alias("_here")).select(
        *by, "_slot", "_here", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"),
        F.sum("_here").over(Window.partitionBy(*by)).alias("total_n"))
    edges = F.array(*[edge(F.lit(float(p)) * (F.col("total_n") - 1)).cast("bigint")
                      for p in fractions for edge in (F.floor, F.ceil)])
    wanted = slots.where(F.exists(edges, lambda e: (e >= F.col("_before"))
                                  & (e < F.col("_before") + F.col("_here")))).drop("_here")
    inside = (Window.partitionBy(*by, "_slot").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = cut.join(wanted, [*by, "_slot"]).withColumn(
        "cum_n", F.col("_before") + F.sum("n").over(inside))
    low, high = [], []
    for i, p in enumerate(fractions):
        at = F.lit(float(p)) * (F.col("total_n") - 1)
        for store, edge, tag in ((low, F.floor(at), "lo"), (high, F.ceil(at), "hi")):
            held = (F.col("cum_n") - F.col("n") <= edge) & (edge < F.col("cum_n"))
            store.append(F.max(F.when(held, F.col(value).cast("double")))
                         .alias(f"_{tag}{i}"))
    found = ranked.groupBy(*by).agg(*low, *high, F.max("total_n").alias("_n"))

    def between(i: int, p: float) -> Column:
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return lo + (hi - lo) * (at - F.floor(at))

    return found.select(*by, F.array(
        *[between(i, p) for i, p in enumerate(fractions)]).alias("quantiles"))


def average_ranks(df: DataFrame, columns: Sequence[str], points: int = POINTS) -> DataFrame:
    """``column, value, rank``: average ranks of the distinct values of columns.

    All columns are ranked in one pass: rows become (column, value) pairs that
    are counted before they are shuffled.
    """
    pairs = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(pairs.alias("_p")).select("_p.column", "_p.value")
    ranked = running_totals(value_counts(long, "value", ["column"]), "value", ["n"],
                            ["column"], points=points)
    return ranked.select("column", "value", (
        F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
