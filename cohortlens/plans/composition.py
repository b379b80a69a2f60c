"""Composition, describe and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import correlate as C
from cohortlens.operators import profile as P
from cohortlens.plans.data import LABELLED, labelled, six, table


def frequency_table(spark, sf):
    return P.frequency_table(table(spark, sf, "documents"), "lang")


def membership_summary(spark, sf):
    return P.membership_summary(table(spark, sf, "documents"), "lang", ["de", "fr"])


def imbalance_summary(spark, sf):
    return P.imbalance_summary(labelled(spark, sf), "quality", 0, 1)


def crosstab_long(spark, sf):
    return P.crosstab_long(labelled(spark, sf), "lang", "quality")


def crosstab_wide(spark, sf):
    wide = P.crosstab_wide(labelled(spark, sf), "lang", "quality", [0, 1])
    return wide.select("lang", F.col("0").alias("n_0"), F.col("1").alias("n_1"),
                       F.col("All").alias("n_all"))


def crosstab_plain(spark, sf):
    wide = P.crosstab_wide(labelled(spark, sf), "source", "quality", [0, 1], margin=None)
    return wide.select("source", F.col("0").alias("n_0"), F.col("1").alias("n_1"))


def describe_by_group(spark, sf):
    return P.describe(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


def describe_all(spark, sf):
    return P.describe(table(spark, sf, "events"), "value")


def describe_sketched(spark, sf):
    """The single-pass form. Its quantiles are judged by rank: how far off their share of the rows is."""
    rows = table(spark, sf, "events")
    found = P.describe(rows, "value", ["event_type"], digits=None, approximate=True)
    shares = rows.join(F.broadcast(found), "event_type").groupBy("event_type").agg(*[
        F.struct(F.avg((F.col("value") < F.col(p)).cast("int")).alias("low"),
                 F.avg((F.col("value") <= F.col(p)).cast("int")).alias("high")).alias(f"_{p}")
        for p in ("p25", "p50", "p75")])

    def near(p: str) -> F.Column:
        share = float(p[1:]) / 100
        return ((F.col(f"_{p}.low") <= share + 0.001) & (F.col(f"_{p}.high") >= share - 0.001)).alias(f"{p}_near")

    return found.join(shares, "event_type").select(
        "event_type", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")],
        *[near(p) for p in ("p25", "p50", "p75")])


def subset_median(spark, sf):
    rows = table(spark, sf, "lineitem")
    out = P.mean_and_median(rows, "l_extendedprice", F.col("l_linestatus") == "F")
    return out.select("count", six("mean"), six("median"))


def subset_filter(spark, sf):
    return labelled(spark, sf).where(F.col("lang") == "en").select(
        "doc_id", "source", "quality")


def mutual_implication(spark, sf):
    return P.mutual_implication(labelled(spark, sf), F.col("quality") == 0,
                                F.col("toxic") == 1)


def value_mapping(spark, sf):
    from cohortlens.functions.rates import code_to_name
    band = code_to_name("lang", {"en": "wide", "de": "narrow", "fr": "narrow"}, "other")
    return (table(spark, sf, "documents").groupBy(band.alias("band"))
            .agg(F.count("*").alias("n")))


def sorted_prefix_values(spark, sf):
    return (table(spark, sf, "documents").select("source").distinct()
            .where(F.col("source").startswith("src1")).orderBy("source"))


def density_histogram(spark, sf):
    out = P.density_histogram(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return out.select("l_returnflag", "bin", six("bin_start"), six("bin_end"), "n",
                      F.round("density", 10).alias("density"))


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "returned"]


def _measures(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"))


def pearson_matrix(spark, sf):
    return C.pearson_matrix(_measures(spark, sf), COLUMNS).select("method", "a", "b", six("r"))


def spearman_matrix(spark, sf):
    return C.spearman_matrix(_measures(spark, sf), COLUMNS).select("method", "a", "b", six("r"))


def strong_pairs(spark, sf):
    both = C.correlation_table(_measures(spark, sf), COLUMNS)
    return C.strong_pairs(both).select("method", "a", "b", six("r"))


def correlation_wide(spark, sf):
    wide = C.wide_matrix(C.correlation_table(_measures(spark, sf), COLUMNS), COLUMNS)
    return wide.select("method", "row", *[six(c) for c in COLUMNS])


QUERIES = [frequency_table, membership_summary, imbalance_summary, crosstab_long,
           crosstab_wide, crosstab_plain, describe_by_group, describe_all,
           describe_sketched, subset_median, subset_filter, mutual_implication,
           value_mapping, sorted_prefix_values, density_histogram, pearson_matrix,
           spearman_matrix, strong_pairs, correlation_wide]

_MEASURES = """m AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax,
         l_extendedprice * (1 - l_discount) AS net,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned
  FROM lineitem)"""
_RANKS = "r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
    for c in COLUMNS) + " FROM m)"


def _long(source: str, method: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{method}' AS method, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, "
        f"{i} AS i, {j} AS j FROM {source}"
        for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS))


ORACLES = {
    "frequency_table": """
        SELECT lang, count(*) AS n,
               round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct
        FROM documents GROUP BY lang""",
    "membership_summary": """
        SELECT count(*) AS total, count(*) FILTER (lang IN ('de', 'fr')) AS n,
               round(100.0 * count(*) FILTER (lang IN ('de', 'fr')) / count(*), 2) AS pct
        FROM documents""",
    "imbalance_summary": f"""
        WITH {LABELLED}, c AS (
          SELECT count(*) AS total, count(*) FILTER (quality = 0) AS n_minority,
                 count(*) FILTER (quality = 1) AS n_majority FROM labelled)
        SELECT *, round(100.0 * n_minority / total, 2) AS pct_minority,
               round(100.0 * n_majority / total, 2) AS pct_majority,
               round(n_majority / n_minority, 4) AS ratio FROM c""",
    "crosstab_long": f"""
        WITH {LABELLED}
        SELECT CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS lang,
               CASE WHEN grouping(quality) = 1 THEN 'All'
                    ELSE CAST(quality AS VARCHAR) END AS quality, count(*) AS n
        FROM labelled GROUP BY CUBE (lang, quality)""",
    "crosstab_wide": f"""
        WITH {LABELLED}
        SELECT CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS lang,
               count(*) FILTER (quality = 0) AS n_0, count(*) FILTER (quality = 1) AS n_1,
               count(*) AS n_all
        FROM labelled GROUP BY ROLLUP (lang)""",
    "crosstab_plain": f"""
        WITH {LABELLED}
        SELECT source, count(*) FILTER (quality = 0) AS n_0,
               count(*) FILTER (quality = 1) AS n_1
        FROM labelled GROUP BY source""",
    "describe_by_group": """
        SELECT l_returnflag, count(*) AS count, round(avg(l_extendedprice), 4) AS mean,
               round(stddev_samp(l_extendedprice), 4) AS std,
               round(min(l_extendedprice), 4) AS min,
               round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
               round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
               round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
               round(max(l_extendedprice), 4) AS max
        FROM lineitem GROUP BY l_returnflag""",
    "describe_all": """
        SELECT count(value) AS count, round(avg(value), 4) AS mean,
               round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min,
               round(quantile_cont(value, 0.25), 4) AS p25,
               round(quantile_cont(value, 0.5), 4) AS p50,
               round(quantile_cont(value, 0.75), 4) AS p75, round(max(value), 4) AS max
        FROM events""",
    "describe_sketched": """
        SELECT event_type, count(value) AS count, round(avg(value), 4) AS mean,
               round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min,
               round(max(value), 4) AS max, true AS p25_near, true AS p50_near, true AS p75_near
        FROM events GROUP BY event_type""",
    "subset_median": """
        SELECT count(*) AS count, round(avg(l_extendedprice), 6) AS mean,
               round(median(l_extendedprice), 6) AS median
        FROM lineitem WHERE l_linestatus = 'F'""",
    "subset_filter": f"""
        WITH {LABELLED} SELECT doc_id, source, quality FROM labelled WHERE lang = 'en'""",
    "mutual_implication": f"""
        WITH {LABELLED}
        SELECT count(*) FILTER (quality = 0) AS n_left, count(*) FILTER (toxic = 1) AS n_right,
               count(*) FILTER (quality = 0 AND toxic = 1) AS n_both,
               bool_and(quality <> 0 OR toxic = 1) AS left_implies_right,
               bool_and(toxic <> 1 OR quality = 0) AS right_implies_left,
               bool_and((quality = 0) = (toxic = 1)) AS equivalent
        FROM labelled""",
    "value_mapping": """
        SELECT CASE lang WHEN 'en' THEN 'wide' WHEN 'de' THEN 'narrow'
               WHEN 'fr' THEN 'narrow' ELSE 'other' END AS band, count(*) AS n
        FROM documents GROUP BY 1""",
    "sorted_prefix_values": """
        SELECT DISTINCT source FROM documents WHERE source LIKE 'src1%' ORDER BY source""",
    "density_histogram": """
        WITH s AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
                          count(*) AS total FROM lineitem GROUP BY l_returnflag),
        b AS (SELECT l_returnflag, least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 50)
                     AS INTEGER) + 1, 50) AS bin, count(*) AS n
              FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1, 2)
        SELECT s.l_returnflag, CAST(g.bin AS INTEGER) AS bin,
               round(lo + (g.bin - 1) * ((hi - lo) / 50), 6) AS bin_start,
               round(lo + g.bin * ((hi - lo) / 50), 6) AS bin_end,
               coalesce(b.n, 0) AS n,
               round(coalesce(b.n, 0) / (total * ((hi - lo) / 50)), 10) AS density
        FROM s CROSS JOIN generate_series(1, 50) AS g(bin)
        LEFT JOIN b ON b.l_returnflag = s.l_returnflag AND b.bin = g.bin""",
    "pearson_matrix": f"""
        WITH {_MEASURES} SELECT method, a, b, r FROM ({_long('m', 'pearson')})""",
    "spearman_matrix": f"""
        WITH {_MEASURES}, {_RANKS}
        SELECT method, a, b, r FROM ({_long('r', 'spearman')})""",
    "strong_pairs": f"""
        WITH {_MEASURES}, {_RANKS}
        SELECT method, a, b, r
        FROM ({_long('m', 'pearson')} UNION ALL {_long('r', 'spearman')})
        WHERE i < j AND abs(r) > 0.3""",
    "correlation_wide": f"WITH {_MEASURES}, {_RANKS} " + " UNION ALL ".join(
        f"SELECT '{method}' AS method, '{a}' AS row, " + ", ".join(
            f"round(corr({a}, {b}), 6) AS {b}" for b in COLUMNS) + f" FROM {source}"
        for method, source in (("pearson", "m"), ("spearman", "r")) for a in COLUMNS),
}
