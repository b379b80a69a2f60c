"""Schemas, readers and sinks of the tables that pass between the stages.

Schemas are declared, never inferred. Values such as codec ``none`` or attack
``-`` are ordinary strings, so text readers use an empty null marker.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import constants as K
from cohortlens.operators.features import feature_names


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


LABELS = T.StructType(
    _strings("arquivo", "caminho", "codec", "transmissao", "ataque", "label", "trim", "fase")
    + [T.StructField("classe_binaria", T.IntegerType())])
ERRORS = T.StructType(_strings("arquivo", "erro"))
SPLIT = T.StructType(_strings("arquivo", "conjunto"))
WAVEFORMS = T.StructType(_strings("arquivo") + [
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType()))])


def features_schema(n_mfcc: int = K.N_MFCC) -> T.StructType:
    return T.StructType(
        _strings("arquivo", "label")
        + [T.StructField("classe_binaria", T.IntegerType()),
           T.StructField("prop_fala", T.DoubleType())]
        + [T.StructField(n, T.FloatType()) for n in feature_names(n_mfcc)])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               columns: Sequence[str] | None = None, fmt: str = "parquet",
               hint: str = "") -> DataFrame:
    """Read Parquet, ORC, JSON or CSV with a header; only ``columns`` if given.

    A missing path raises ``FileNotFoundError`` naming the path and ``hint``.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("reading CSV needs a schema")
        reader = reader.options(header=True, nullValue="", mode="FAILFAST",
                                enforceSchema=False)
    try:
        table = reader.load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"{path} does not exist. {hint}".strip()) from e
    return table.select(*columns) if columns else table


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whatever file system it names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(jvm_path) if s.isDirectory()]


def holds_table(spark: SparkSession, path: str) -> bool:
    """Whether a finished write is there: a broken one leaves no marker."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def finished_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that are in a folder, also those that finished tasks of a broken write left there."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = (), order_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Write a table; ``order_by`` sorts it globally, for reproducible files.

    Partition by the split part to let readers skip the sealed test rows.
    """
    out = df.orderBy(*order_by) if order_by else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("emptyValue", "").csv(path)
    else:
        writer.format(fmt).save(path)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                  force: bool = False, **write_options) -> DataFrame:
    """An artefact written once and read ever after, unless forced.

    Without force a table that is already there is never touched. A write that
    broke off does not count as there and is replaced.
    """
    if force or not holds_table(spark, path):
        write_table(build(), path, **write_options)
    return spark.read.parquet(path)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: count and an order-free content hash of the table.

    The sum of 60-bit parts of each row's md5; equal tables agree whatever
    their files, order or partitioning.
    """
    text = F.concat_ws("#", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"),
                  F.sum(part).cast("string").alias("content_hash"))


def run_record(spark: SparkSession, values: Mapping[str, Column | object]) -> DataFrame:
    """A one-row record of a run: metrics, parameters, seed and versions."""
    import platform

    import numpy
    import pandas
    versions = {"spark": spark.version, "python": platform.python_version(),
                "numpy": numpy.__version__, "pandas": pandas.__version__}
    cells = [F.lit(x) for kv in versions.items() for x in kv]
    return spark.range(1).select(
        *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()],
        F.create_map(*cells).alias("versions"))


def stamped(record: DataFrame, rows: DataFrame, columns: Sequence[str], name: str = "split") -> DataFrame:
    """Add to a record the count and fingerprint of the rows it was made on."""
    made_on = fingerprint(rows, columns).select(F.struct("*")).scalar()
    return (record.withColumn(f"{name}_rows", made_on["n"])
            .withColumn(f"{name}_hash", made_on["content_hash"]))


def check_stamp(record: DataFrame, rows: DataFrame, columns: Sequence[str], name: str = "split") -> None:
    """Raise unless the rows are those the record was made on; one moved row is enough."""
    then, now = record.select(f"{name}_rows", f"{name}_hash").first(), fingerprint(rows, columns).first()
    if tuple(then) != tuple(now):
        raise ValueError(f"the record was made on {then[0]} rows with {then[1]}, these are {now[0]} with {now[1]}")


def write_record(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


def published(df: DataFrame, names: Mapping[str, str] = K.PUBLISHED_NAMES) -> DataFrame:
    """Rename report columns to the published ones."""
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})
