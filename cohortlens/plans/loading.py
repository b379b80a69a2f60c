"""Metadata loading, joins, set operations and extraction-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators import audit as A
from cohortlens.operators import joins as J
from cohortlens.operators import models as M
from cohortlens.operators import validate as V
from cohortlens.plans.data import LABELLED, labelled, six, table
from cohortlens.sources import files, metadata
from cohortlens.sources.tables import write_table
from cohortlens.storage import materialise, scratch_path


def _metadata_lines(spark, sf):
    """The labelled documents as lines of the trial metadata format."""
    attack = F.when(F.col("quality") == 0, F.lit("-")).otherwise(
        F.concat(F.lit("A"), F.lpad(F.substring("source", 4, 9), 2, "0")))
    return labelled(spark, sf).select(F.concat_ws(
        "  ", "source", F.concat(F.lit("LA_D_"), F.lpad(F.col("doc_id").cast("string"), 7, "0")),
        "lang", F.lit("tx"), attack,
        F.when(F.col("quality") == 0, "Bonafide").otherwise("spoof"),
        F.when(F.col("toxic") == 1, "only_speech").otherwise("notrim"),
        F.when(F.col("lang") == "en", "eval").otherwise("hidden")).alias("value"))


def _written_metadata(spark, sf):
    path = scratch_path(spark, "metadata")
    _metadata_lines(spark, sf).write.text(path)
    return path


def label_ingest(spark, sf):
    return metadata.load_labels(spark, _written_metadata(spark, sf), "/audio")


def phase_filter(spark, sf):
    labels = metadata.load_labels(spark, _written_metadata(spark, sf), "/audio")
    return metadata.only_phase(labels, "eval").select("arquivo", "fase", "classe_binaria")


def metadata_preview(spark, sf):
    lines = metadata.read_lines(spark, _written_metadata(spark, sf))
    out = metadata.preview(lines, order="value")
    return out.select("n_tokens", F.concat_ws(" ", "tokens").alias("line"))


def column_roles(spark, sf):
    lines = metadata.read_lines(spark, _written_metadata(spark, sf))
    return metadata.detect_columns(lines, order="value")


def id_check(spark, sf):
    ids = table(spark, sf, "documents").select(
        F.concat_ws("_", F.lit("LA"), F.upper(F.substring("lang", 1, 1)),
                    F.when(F.col("lang") != "es", F.col("doc_id")).cast("string")).alias("id"))
    return V.id_report(ids, "id")


def unexpected_values(spark, sf):
    return V.unexpected_values(table(spark, sf, "documents"), "lang", ["en", "de"])


def guarded_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return J.guarded_join(table(spark, sf, "labels"), docs, "doc_id")


def join_loss(spark, sf):
    return J.join_loss(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


def left_lookup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return J.with_lookup(docs, table(spark, sf, "labels"), "doc_id", "quality").select(
        "doc_id", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("none"))
        .alias("quality"))


def resume_anti_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return J.not_done(docs, table(spark, sf, "labels"), "doc_id")


def known_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return J.known_to(docs, table(spark, sf, "labels"), "doc_id")


def set_difference(spark, sf):
    rare = labelled(spark, sf).where(F.col("quality") == 0)
    return J.key_difference(table(spark, sf, "documents"), rare, "source")


def missing_files(spark, sf):
    """Sources whose folder was never written: only those with a class 0 were."""
    root = scratch_path(spark, "listing")
    rows = labelled(spark, sf)
    write_table(rows.where(F.col("quality") == 0).select("doc_id", "source"), root,
                partition_by=["source"])
    listed = table(spark, sf, "documents").select("source").distinct().withColumn(
        "folder", F.concat(F.lit(f"{root}/source="), F.col("source")))
    found = files.parent_folders(files.file_listing(spark, root, "*.parquet"))
    return files.missing(listed, found, "folder").select("source")


def _source_folders(spark, sf):
    """Folders that the sources of all documents should have, and what executors find in them."""
    root = scratch_path(spark, "listing")
    write_table(labelled(spark, sf).where(F.col("quality") == 0).select("doc_id", "source"), root,
                partition_by=["source"])
    listed = materialise(table(spark, sf, "documents").select("source").distinct().withColumn(
        "folder", F.concat(F.lit(f"{root}/source="), F.col("source"))), "listed")
    found = files.parent_folders(files.listing_by_folder(listed, "folder", ".parquet"))
    return listed, found


def present_files(spark, sf):
    """Sources whose folder holds a file."""
    return files.present(*_source_folders(spark, sf), "folder").select("source")


def presence_summary(spark, sf):
    return files.presence_summary(*_source_folders(spark, sf), "folder")


def _failed(spark, sf):
    """Documents without a label play the rows that failed."""
    docs = table(spark, sf, "documents")
    return J.not_done(docs, table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.format_string("%sError('%s')", F.col("source"), F.col("lang")).alias("erro"),
        "text")


def error_top_k(spark, sf):
    return A.common_errors(_failed(spark, sf))


def error_examples(spark, sf):
    return A.example_errors(_failed(spark, sf).select("doc_id", "text"), "doc_id", "text")


def failure_bias(spark, sf):
    rows = labelled(spark, sf)
    return A.failure_bias(rows, rows.where(F.col("toxic") == 1),
                          rows.where(F.col("toxic") == 0), "doc_id", "quality", 0, 1)


def inventory_check(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return A.inventory_check(docs, table(spark, sf, "labels"), _failed(spark, sf), "doc_id")


def share_health(spark, sf):
    return A.share_health(table(spark, sf, "lineitem"), "l_discount")


def feature_projection(spark, sf):
    """Averages of what is left after excluding keys, target and texts."""
    rows = table(spark, sf, "lineitem")
    names = M.feature_columns(rows, [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
        "l_linestatus", "l_shipdate"])
    return rows.select(*names).agg(*[F.round(F.avg(c), 6).alias(c) for c in names])


def class_weights(spark, sf):
    rows = table(spark, sf, "embeddings").select((F.col("label") != 0).cast("int").alias("y"))
    return M.class_weights(rows, "y").select("y", "n", six("weight"))


def weighted_rows(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") != 0).cast("int").alias("y"))
    return M.with_class_weights(rows, "y").select("vec_id", "y", six("weight"))


QUERIES = [label_ingest, phase_filter, metadata_preview, column_roles, id_check,
           unexpected_values, guarded_join, join_loss, left_lookup, resume_anti_join,
           known_rows, set_difference, missing_files, present_files, presence_summary, error_top_k, error_examples,
           failure_bias, inventory_check, share_health, feature_projection,
           class_weights, weighted_rows]

_META = f"""{LABELLED}, meta AS (
  SELECT source AS locutor, 'LA_D_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS arquivo,
         lang AS codec, 'tx' AS transmissao,
         CASE WHEN quality = 0 THEN '-' ELSE 'A' || lpad(substr(source, 4), 2, '0') END AS ataque,
         CASE WHEN quality = 0 THEN 'Bonafide' ELSE 'spoof' END AS raw_label,
         CASE WHEN toxic = 1 THEN 'only_speech' ELSE 'notrim' END AS trim,
         CASE WHEN lang = 'en' THEN 'eval' ELSE 'hidden' END AS fase
  FROM labelled), line AS (
  SELECT concat_ws('  ', locutor, arquivo, codec, transmissao, ataque, raw_label, trim, fase)
         AS value FROM meta)"""

ORACLES = {
    "label_ingest": f"""
        WITH {_META}
        SELECT arquivo, '/audio/' || arquivo || '{K.AUDIO_SUFFIX}' AS caminho, codec,
               transmissao, ataque, lower(raw_label) AS label, trim, fase,
               CASE WHEN lower(raw_label) <> 'bonafide' THEN 1 ELSE 0 END AS classe_binaria
        FROM meta""",
    "phase_filter": f"""
        WITH {_META}
        SELECT arquivo, fase,
               CASE WHEN lower(raw_label) <> 'bonafide' THEN 1 ELSE 0 END AS classe_binaria
        FROM meta WHERE fase = 'eval'""",
    "metadata_preview": f"""
        WITH {_META}
        SELECT CAST(len(string_split(value, '  ')) AS INTEGER) AS n_tokens,
               replace(value, '  ', ' ') AS line
        FROM (SELECT value FROM line ORDER BY value LIMIT 5)""",
    "column_roles": f"""
        WITH {_META},
        head AS (SELECT value FROM line ORDER BY value LIMIT 200),
        tok AS (SELECT value, string_split(value, '  ') AS t FROM head),
        hit AS (SELECT value, CAST(pos AS INTEGER) - 1 AS pos, t[pos] AS token
                FROM tok, generate_series(1, 8) AS g(pos)),
        role AS (SELECT *, CASE
                   WHEN regexp_matches(token, '^LA_[A-Z]_[0-9]+$') THEN 'id'
                   WHEN lower(token) IN ('bonafide', 'spoof') THEN 'label'
                   WHEN regexp_matches(token, '^A[0-9][0-9]$') THEN 'attack' END AS role
                 FROM hit)
        SELECT arg_min(pos, value || pos) FILTER (role = 'id') AS id,
               arg_min(pos, value || pos) FILTER (role = 'label') AS label,
               arg_min(pos, value || pos) FILTER (role = 'attack') AS attack
        FROM role""",
    "id_check": """
        WITH i AS (SELECT 'LA_' || upper(substr(lang, 1, 1)) ||
                   CASE WHEN lang = 'es' THEN '' ELSE '_' || doc_id END AS id FROM documents)
        SELECT count(*) AS n,
               count(*) FILTER (NOT regexp_matches(id, '^LA_[A-Z]_[0-9]+$')) AS n_bad,
               bool_and(regexp_matches(id, '^LA_[A-Z]_[0-9]+$')) AS all_match FROM i""",
    "unexpected_values": """
        SELECT DISTINCT lower(lang) AS value FROM documents
        WHERE lower(lang) NOT IN ('en', 'de')""",
    "guarded_join": """
        SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "join_loss": """
        SELECT (SELECT count(*) FROM documents) AS n_left,
               (SELECT count(*) FROM documents
                WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_lost,
               (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id
                HAVING count(*) > 1)) AS n_doubled_keys""",
    "left_lookup": """
        SELECT d.doc_id, d.lang, coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "resume_anti_join": """
        SELECT doc_id, source FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "known_rows": """
        SELECT doc_id, lang, n_chars FROM documents
        WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "set_difference": f"""
        WITH {LABELLED}
        SELECT source FROM documents EXCEPT SELECT source FROM labelled WHERE quality = 0""",
    "missing_files": f"""
        WITH {LABELLED}
        SELECT DISTINCT source FROM documents
        WHERE source NOT IN (SELECT source FROM labelled WHERE quality = 0)""",
    "present_files": f"""
        WITH {LABELLED}
        SELECT DISTINCT source FROM documents
        WHERE source IN (SELECT source FROM labelled WHERE quality = 0)""",
    "presence_summary": f"""
        WITH {LABELLED}, s AS (
          SELECT DISTINCT source, source IN (SELECT source FROM labelled WHERE quality = 0) AS there FROM documents)
        SELECT count(*) AS n, count(*) FILTER (there) AS n_present, count(*) FILTER (NOT there) AS n_missing,
               CASE WHEN count(*) FILTER (there) = 0 THEN 'not on disk'
                    WHEN count(*) FILTER (NOT there) = 0 THEN 'unreadable' ELSE 'mixed' END AS diagnosis FROM s""",
    "error_top_k": """
        SELECT source || 'Error' AS error_type, count(*) AS n,
               round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        GROUP BY source ORDER BY n DESC, error_type LIMIT 10""",
    "error_examples": """
        SELECT doc_id, substr(text, 1, 160) AS excerpt FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 3""",
    "failure_bias": f"""
        WITH {LABELLED}, c AS (
          SELECT quality AS label, count(*) AS n_original,
                 count(*) FILTER (toxic = 1) AS n_failed,
                 count(*) FILTER (toxic = 0) AS n_survived
          FROM labelled GROUP BY quality),
        r AS (
          SELECT sum(n_original) AS o, sum(n_failed) AS f, sum(n_survived) AS s,
                 sum(n_original) FILTER (label = 1) / sum(n_original) FILTER (label = 0) AS ratio_before,
                 sum(n_survived) FILTER (label = 1) / sum(n_survived) FILTER (label = 0) AS ratio_after
          FROM c)
        SELECT label, n_original, round(100.0 * n_original / o, 2) AS pct_original,
               n_failed, round(100.0 * n_failed / f, 2) AS pct_failed,
               n_survived, round(100.0 * n_survived / s, 2) AS pct_survived,
               round(ratio_before, 4) AS ratio_before, round(ratio_after, 4) AS ratio_after,
               round(100 * abs(ratio_after - ratio_before) / ratio_before, 4) AS shift_pct,
               CASE WHEN 100 * abs(ratio_after - ratio_before) / ratio_before < 5
                    THEN 'uniform' ELSE 'biased' END AS verdict
        FROM c, r""",
    "inventory_check": """
        SELECT (SELECT count(*) FROM documents) AS n_labels,
               (SELECT count(*) FROM labels) AS n_features,
               (SELECT count(*) FROM documents
                WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_errors,
               (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels)
                 + (SELECT count(*) FROM documents
                    WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS adds_up,
               CAST(0 AS BIGINT) AS n_missing,
               (SELECT count(*) FROM labels
                WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_stray,
               (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id
                HAVING count(*) > 1)) AS n_repeated""",
    "share_health": """
        SELECT count(*) AS n, count(*) FILTER (l_discount = 0) AS n_zero,
               round(100.0 * count(*) FILTER (l_discount = 0) / count(*), 2) AS pct_zero,
               round(avg(l_discount), 6) AS mean_share,
               avg(l_discount) < 0.3 AS too_aggressive
        FROM lineitem""",
    "feature_projection": """
        SELECT round(avg(l_quantity), 6) AS l_quantity,
               round(avg(l_extendedprice), 6) AS l_extendedprice,
               round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax
        FROM lineitem""",
    "class_weights": """
        SELECT CASE WHEN label <> 0 THEN 1 ELSE 0 END AS y, count(*) AS n,
               round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
        FROM embeddings GROUP BY 1""",
    "weighted_rows": """
        WITH e AS (SELECT vec_id, CASE WHEN label <> 0 THEN 1 ELSE 0 END AS y FROM embeddings)
        SELECT vec_id, y, round(count(*) OVER () /
               (2 * count(*) OVER (PARTITION BY y)), 6) AS weight FROM e""",
}
