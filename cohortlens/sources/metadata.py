"""Headerless, whitespace-separated trial metadata: preview, parse, check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators.validate import require_domain, require_ids


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as ``value``; a missing path raises ``FileNotFoundError``."""
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(
            f"{path} does not exist. Download and unpack the metadata first.") from e


def tokens(lines: DataFrame) -> DataFrame:
    """Blank lines hold no tokens and are left out."""
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    return (lines.withColumn("tokens", F.split(text, " "))
            .where(F.length(text) > 0))


def preview(lines: DataFrame, n: int = 5, order: str | None = None) -> DataFrame:
    """The first lines raw: how many tokens, and which.

    ``order`` names a column that gives the line order; without it the scan's
    own order is used.
    """
    head = (lines.orderBy(order) if order else lines).limit(n)
    return tokens(head).select(F.size("tokens").alias("n_tokens"), "tokens")


def detect_columns(lines: DataFrame, most: int = K.DETECTION_LINES,
                   order: str | None = None) -> DataFrame:
    """Token positions of id, label and attack in the first ``most`` lines.

    The first hit wins, by line and then by position. A token is tried for the
    roles in that order. ``order`` names a column that gives the line order;
    without it the order of the scan is used.
    """
    head = (lines.orderBy(order) if order else lines).limit(most)
    numbered = tokens(head.select(
        "value", (F.col(order) if order else F.monotonically_increasing_id()).alias("line")))
    token = F.col("token")
    role = (F.when(token.rlike(K.ID_PATTERN), "id")
            .when(F.lower(token).isin(K.LABEL_DOMAIN), "label")
            .when(token.rlike(K.ATTACK_PATTERN), "attack"))
    hits = numbered.select("line", F.posexplode("tokens").alias("pos", "token")).select(
        "line", "pos", role.alias("role"))

    def first(name: str):
        return F.min_by(F.when(F.col("role") == name, F.col("pos")),
                        F.when(F.col("role") == name, F.struct("line", "pos"))).alias(name)

    return hits.agg(first("id"), first("label"), first("attack"))


def parse(lines: DataFrame, names: Sequence[str] = tuple(K.METADATA_COLUMNS)) -> DataFrame:
    """Named columns by token position; short lines give nulls at the end."""
    return tokens(lines).select(*[
        F.try_element_at("tokens", F.lit(i)).alias(n) for i, n in enumerate(names, start=1)])


def derive_labels(meta: DataFrame, folder: str, id_col: str = "arquivo",
                  label: str = "label", negative: str = K.NEGATIVE_LABEL,
                  suffix: str = K.AUDIO_SUFFIX) -> DataFrame:
    """The label table: path, lower-cased label, binary class; no speaker."""
    keep = [c for c in meta.columns if c not in ("locutor", id_col)]
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col(id_col), F.lit(suffix))
    lowered = F.lower(label)
    return meta.select(
        id_col, path.alias("caminho"),
        *[(lowered if c == label else F.col(c)).alias(c) for c in keep],
        (lowered != negative).cast("int").alias("classe_binaria"))


def load_labels(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Read, check and derive. Raises on a wrong id or an unknown label."""
    meta = parse(read_lines(spark, path))
    require_ids(meta, "arquivo")
    require_domain(meta, "label", K.LABEL_DOMAIN)
    return derive_labels(meta, folder)


def only_phase(labels: DataFrame, phase: str | None) -> DataFrame:
    """Restrict to one phase, or leave the table as it is."""
    return labels if phase is None else labels.where(F.col("fase") == phase)
