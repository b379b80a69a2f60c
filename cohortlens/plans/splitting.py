"""Split, fold, sample and overlap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators import audit as A
from cohortlens.operators import split as S
from cohortlens.operators.ordering import hash_positions
from cohortlens.plans.data import LABELLED, labelled, table
from cohortlens.sources.tables import check_stamp, fingerprint, read_or_build, run_record, stamped, write_record
from cohortlens.storage import materialise, scratch_path

SAMPLE_ROWS = 60
SAMPLE_SIZES = [300, 600, 1200, None]


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _split(spark, sf):
    return S.stratified_split(labelled(spark, sf), "doc_id", ["quality"])


def stratified_split(spark, sf):
    return _split(spark, sf).select("doc_id", "quality", "conjunto")


def stratified_split_many(spark, sf):
    split = S.stratified_split(_orders(spark, sf), "o_orderkey",
                               ["o_orderstatus", "o_orderpriority"])
    return split.select("o_orderkey", "conjunto")


def split_conformity(spark, sf):
    return S.split_conformity(_split(spark, sf), "conjunto", "quality")


def fold_assignment(spark, sf):
    return S.stratified_folds(_orders(spark, sf), "o_orderkey", ["o_orderstatus"]).select(
        "o_orderkey", "fold")


def stratum_position(spark, sf):
    return hash_positions(_orders(spark, sf), "o_orderkey", K.SEED, ["o_orderstatus"]).select(
        "o_orderkey", "position")


def rare_collapse(spark, sf):
    rows = labelled(spark, sf).withColumn("stratum", S.stratum_key("quality", "source"))
    return (S.collapse_rare(rows, "stratum").groupBy("stratum")
            .agg(F.count("*").alias("n")))


def _sample(spark, sf):
    return S.stratified_sample(labelled(spark, sf), "doc_id", ["quality", "lang"], SAMPLE_ROWS)


def stratified_subsample(spark, sf):
    return _sample(spark, sf).select("doc_id", "quality", "lang")


def persisted_subsample(spark, sf):
    path = scratch_path(spark, "subsample")
    first = read_or_build(spark, path, lambda: stratified_subsample(spark, sf),
                          mode="errorifexists")
    # the second call finds the artefact and builds nothing
    return read_or_build(spark, path, lambda: first.limit(0))


def sized_samples(spark, sf):
    sizes = S.sized_samples(_orders(spark, sf), "o_orderkey",
                            ["o_orderstatus", "o_orderpriority"], SAMPLE_SIZES)
    # 0 marks the sample that is the whole table
    return sizes.select("o_orderkey", F.coalesce("sample_rows", F.lit(0)).alias("sample_rows"))


def split_fingerprint(spark, sf):
    return fingerprint(stratified_split(spark, sf), ["doc_id", "quality", "conjunto"])


def split_record(spark, sf):
    """The record of a split, written and read back: its parameters and the fingerprint of its rows."""
    split = materialise(stratified_split(spark, sf), "split")
    columns = ["doc_id", "quality", "conjunto"]
    record = stamped(run_record(spark, {"seed": K.SEED, "stratification": "quality"}), split, columns)
    path = scratch_path(spark, "record")
    write_record(record, path)
    stored = spark.read.schema(record.schema).json(path)
    check_stamp(stored, split, columns)
    return stored.select("seed", "stratification", "split_rows", "split_hash")


def leave_one_group_out(spark, sf):
    rows = labelled(spark, sf).select("doc_id", "lang", "quality")
    return S.leave_one_group_out(rows, "lang", F.col("quality") == 0, "fr", "doc_id")


def split_overlap(spark, sf):
    return A.split_overlap(_split(spark, sf), "conjunto", ["lang", "source", "doc_id"])


def split_odd_strata(spark, sf):
    """Strata with missing values and with the sign that joins their parts."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit("a_b")).when(
            F.col("o_orderkey") % 3 == 0, F.lit("a")).alias("left"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("c")).when(
            F.col("o_orderkey") % 3 == 0, F.lit("b_c")).when(
            F.col("o_orderkey") % 5 == 0, F.lit("a")).alias("right"))
    split = S.stratified_split(rows, "o_orderkey", ["left", "right"])
    return split.groupBy("left", "right", "conjunto").agg(F.count("*").alias("n"))


QUERIES = [split_odd_strata, stratified_split, stratified_split_many, split_conformity, fold_assignment,
           stratum_position, rare_collapse, stratified_subsample, persisted_subsample,
           sized_samples, split_fingerprint, split_record, leave_one_group_out, split_overlap]


def _ranked(name: str, source: str, key: str, stratum: str) -> str:
    """Rows with their stratum, 1-based position in it and the stratum's size."""
    return f"""{name} AS (
      SELECT *, row_number() OVER (PARTITION BY stratum
                  ORDER BY md5('{K.SEED}#' || {key}), {key}) AS pos,
             count(*) OVER (PARTITION BY stratum) AS size
      FROM (SELECT *, {stratum} AS stratum FROM {source}))"""


def _apportioned(name: str, sizes: str, size: str, target: str, quota: str) -> str:
    """Largest remainders, on one row per stratum."""
    return f"""{name}_x AS (
      SELECT *, CAST({size} AS HUGEINT) * least({target}, sum({size}) OVER ()) AS exact,
             sum({size}) OVER () AS every, least({target}, sum({size}) OVER ()) AS want
      FROM {sizes}),
    {name}_y AS (SELECT *, exact // every AS low, exact % every AS rest FROM {name}_x),
    {name} AS (
      SELECT * EXCLUDE (exact, every, want, low, rest),
             CAST(low + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum)
               <= want - sum(low) OVER () THEN 1 ELSE 0 END AS BIGINT) AS {quota}
      FROM {name}_y)"""


def _split_sql(source: str, key: str, stratum: str, with_labelled: bool) -> str:
    start = f"{LABELLED}," if with_labelled else ""
    return f"""WITH {start} {_ranked('ranked', source, key, stratum)},
    sizes AS (SELECT stratum, count(*) AS n FROM ranked GROUP BY stratum),
    {_apportioned('cut1', 'sizes', 'n', 'CAST(floor(0.7::DOUBLE * (SELECT sum(n) FROM sizes)) AS BIGINT)', 'q1')},
    rest AS (SELECT *, n - q1 AS r FROM cut1),
    {_apportioned('cut2', 'rest', 'r', 'CAST(floor(0.5::DOUBLE * (SELECT sum(r) FROM rest)) AS BIGINT)', 'q2')},
    split AS (SELECT ranked.*, CASE WHEN pos <= q1 THEN 'treino'
                WHEN pos <= q1 + q2 THEN 'validacao' ELSE 'teste' END AS conjunto
              FROM ranked JOIN cut2 USING (stratum))"""


_DOCS = _split_sql("labelled", "doc_id", "CAST(quality AS VARCHAR)", True)
_RARE = f"""{LABELLED}, keyed AS (
  SELECT *, quality || '_' || {{by}} AS raw FROM labelled),
merged AS (
  SELECT * EXCLUDE (raw), CASE WHEN count(*) OVER (PARTITION BY raw) < 10
    THEN 'outros' ELSE raw END AS merged FROM keyed)"""
_SUBSAMPLE = f"""
    WITH {_RARE.format(by='lang')}, {_ranked('ranked', 'merged', 'doc_id', 'merged')},
    sizes AS (SELECT stratum, count(*) AS n FROM ranked GROUP BY stratum),
    {_apportioned('cut', 'sizes', 'n', str(SAMPLE_ROWS), 'q')}
    SELECT doc_id, quality, lang FROM ranked JOIN cut USING (stratum) WHERE pos <= q"""
_SIZES = [s for s in SAMPLE_SIZES if s]

_ODD = _split_sql(
    """(SELECT o_orderkey,
          CASE WHEN o_orderkey % 2 = 0 THEN 'a_b' WHEN o_orderkey % 3 = 0 THEN 'a' END AS lef,
          CASE WHEN o_orderkey % 2 = 0 THEN 'c' WHEN o_orderkey % 3 = 0 THEN 'b_c'
               WHEN o_orderkey % 5 = 0 THEN 'a' END AS righ FROM orders)""", "o_orderkey",
    " || '_' || ".join(f"coalesce(replace(replace({c}, '\\', '\\\\'), '_', '\\_'), '\\N')"
                       for c in ("lef", "righ")), False)

ORACLES = {
    "split_odd_strata": f"""{_ODD} SELECT lef AS "left", righ AS "right", conjunto, count(*) AS n
        FROM split GROUP BY ALL""",
    "stratified_split": f"{_DOCS} SELECT doc_id, quality, conjunto FROM split",
    "stratified_split_many": _split_sql(
        "orders", "o_orderkey", "o_orderstatus || '_' || o_orderpriority", False)
        + " SELECT o_orderkey, conjunto FROM split",
    "split_conformity": f"""{_DOCS}
        SELECT coalesce(conjunto, 'TOTAL') AS conjunto, count(*) AS total,
               count(*) FILTER (quality = 0) AS n_0, count(*) FILTER (quality = 1) AS n_1,
               round(100.0 * count(*) FILTER (quality = 1) / count(*), 2) AS pct_1,
               round(count(*) FILTER (quality = 1) / count(*) FILTER (quality = 0), 4) AS ratio
        FROM split GROUP BY ROLLUP (conjunto)""",
    "fold_assignment": f"""
        WITH {_ranked('ranked', 'orders', 'o_orderkey', 'o_orderstatus')}
        SELECT o_orderkey, CAST((pos - 1) * 5 // size AS INTEGER) AS fold FROM ranked""",
    "stratum_position": f"""
        WITH {_ranked('ranked', 'orders', 'o_orderkey', 'o_orderstatus')}
        SELECT o_orderkey, pos - 1 AS position FROM ranked""",
    "rare_collapse": f"""
        WITH {_RARE.format(by='source')}
        SELECT merged AS stratum, count(*) AS n FROM merged GROUP BY merged""",
    "stratified_subsample": _SUBSAMPLE,
    "persisted_subsample": _SUBSAMPLE,
    "sized_samples": f"""
        WITH {_ranked('ranked', 'orders', 'o_orderkey', "o_orderstatus || '_' || o_orderpriority")},
        sizes AS (SELECT stratum, count(*) AS n FROM ranked GROUP BY stratum),
        {', '.join(_apportioned(f'cut{i}', 'sizes', 'n', str(s), 'q') for i, s in enumerate(_SIZES))}
        """ + " UNION ALL ".join(
            f"SELECT o_orderkey, CAST({s} AS BIGINT) AS sample_rows "
            f"FROM ranked JOIN cut{i} USING (stratum) WHERE pos <= q"
            for i, s in enumerate(_SIZES))
        + " UNION ALL SELECT o_orderkey, 0 FROM orders",
    "split_fingerprint": f"""{_DOCS}
        SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(doc_id || '#' || quality || '#'
               || conjunto), 1, 15)) AS HUGEINT)) AS VARCHAR) AS content_hash FROM split""",
    "split_record": f"""{_DOCS}
        SELECT {K.SEED} AS seed, 'quality' AS stratification, count(*) AS split_rows,
               CAST(sum(CAST(('0x' || substr(md5(doc_id || '#' || quality || '#' || conjunto), 1, 15)) AS HUGEINT))
                    AS VARCHAR) AS split_hash FROM split""",
    "leave_one_group_out": f"""
        WITH {LABELLED},
        shared AS (SELECT *, row_number() OVER (ORDER BY md5('{K.SEED}#' || doc_id), doc_id)
                   AS pos, count(*) OVER () AS size FROM labelled WHERE quality = 0)
        SELECT doc_id, lang, quality, CASE WHEN pos <= floor(0.7::DOUBLE * size)
               THEN 'train' ELSE 'test' END AS conjunto FROM shared
        UNION ALL
        SELECT doc_id, lang, quality, CASE WHEN lang = 'fr' THEN 'test' ELSE 'train' END
        FROM labelled WHERE quality <> 0""",
    "split_overlap": f"""{_DOCS},
        long AS (SELECT conjunto, 'lang' AS key, lang AS value FROM split
                 UNION ALL SELECT conjunto, 'source', source FROM split
                 UNION ALL SELECT conjunto, 'doc_id', CAST(doc_id AS VARCHAR) FROM split),
        seen AS (SELECT key, value, count(DISTINCT conjunto) AS parts FROM long GROUP BY 1, 2)
        SELECT key, count(*) AS n_values, count(*) FILTER (parts > 1) AS n_shared,
               max(parts) AS most_parts FROM seen GROUP BY key""",
}
