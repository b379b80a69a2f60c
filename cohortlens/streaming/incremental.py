"""Feature extraction that resumes, in batch and as a stream of new files.

Failures never stop a run. A row that fails goes to the error table with its
exception text and is tried again next time; only success marks an id as done.

Waveform rows are heavy and ids are light, so every decision about what is
pending or failed is made on ids alone. Only then are rows picked, by a join
that does not move them as long as the id list is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cohortlens.operators.joins import known_to, not_done
from cohortlens.sources.tables import exists, finished_parts, folders, holds_table
from cohortlens.storage import broadcast_if_small, materialise

Extractor = Callable[[DataFrame], DataFrame]


def rows_with_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    stored = materialise(keys.select(key), "keys")
    return known_to(rows, broadcast_if_small(stored), key)


def pending_rows(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows_with_keys(source, not_done(source.select(key), done, key), key)


def _failures(pending: DataFrame, written: DataFrame, run: Extractor,
              key: str) -> tuple[DataFrame, DataFrame]:
    """The rows a run left undone, and their reasons.

    Only those rows are extracted again, so a whole batch is neither computed
    twice nor held in memory to feed two sinks.
    """
    rows = pending_rows(pending, written, key)
    reasons = run(rows).where(F.col("erro").isNotNull()).select(key, "erro")
    return rows, reasons


def extract_pending(source: DataFrame, features_path: str, errors_path: str,
                    run: Extractor, key: str) -> None:
    """One resumable batch run.

    ``run`` maps source rows to rows with the key, the features and a nullable
    ``erro``. Rows done earlier are skipped, new ones are appended, and the
    error table is replaced by this run's failures, so it empties itself.

    Each task's rows count as done when the task is: its file moves to its place
    at once, not when the job ends. A run that breaks off half-way loses only
    the tasks that were at work.
    """
    spark = source.sparkSession
    pending = source
    if exists(spark, features_path):
        known = StructType([f for f in source.schema.fields if f.name == key])
        pending = pending_rows(source, finished_parts(spark, features_path, known), key)
    good = run(pending).where(F.col("erro").isNull()).drop("erro")
    good.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(features_path)
    _, reasons = _failures(pending, spark.read.parquet(features_path), run, key)
    reasons.write.mode("overwrite").parquet(errors_path)


def _folder(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/batch={batch}"


def read_stream_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def latest_errors(spark: SparkSession, path: str) -> DataFrame:
    """The failures that the last finished batch left open.

    Found by folder: a batch without failures has no rows, yet closes the
    errors of the batches before it.
    """
    batches = [int(name.split("=")[1]) for name in folders(spark, path)
               if name.startswith("batch=")]
    last = max(b for b in batches if holds_table(spark, _folder(path, b)))
    return spark.read.parquet(_folder(path, last))


def _write_batch(pending: DataFrame, batch: int, features_path: str, errors_path: str,
                 retry_path: str, run: Extractor, key: str) -> None:
    session = pending.sparkSession
    target = _folder(features_path, batch)
    good = run(pending).where(F.col("erro").isNull()).drop("erro")
    good.write.mode("overwrite").parquet(target)
    rows, reasons = _failures(pending, session.read.parquet(target), run, key)
    rows.write.mode("overwrite").parquet(_folder(retry_path, batch))
    reasons.write.mode("overwrite").parquet(_folder(errors_path, batch))


def stream_new_files(spark: SparkSession, input_path: str, schema: StructType,
                     features_path: str, errors_path: str, retry_path: str,
                     checkpoint: str, run: Extractor, key: str,
                     files_per_batch: int = 1000) -> StreamingQuery:
    """Process files that arrived since the last run, then stop.

    The checkpoint remembers which files were read, so failed rows would never
    come again by themselves. They are kept whole in ``retry_path`` and join
    the next batch. Every batch writes to a folder of its own number and
    replaces it, so a batch repeated after a crash leaves one copy. Ids must
    be unique among the files of one batch.
    """
    arriving = (spark.readStream.schema(schema)
                .option("maxFilesPerTrigger", files_per_batch).parquet(input_path))

    def handle(new_rows: DataFrame, batch: int) -> None:
        session = new_rows.sparkSession
        pending = new_rows
        if batch > 0:
            done = (session.read.option("basePath", features_path)
                    .parquet(features_path).where(F.col("batch") < batch))
            failed_before = session.read.schema(schema).parquet(_folder(retry_path, batch - 1))
            again = pending_rows(failed_before, new_rows, key)
            pending = pending_rows(new_rows.unionByName(again), done, key)
        _write_batch(pending, batch, features_path, errors_path, retry_path, run, key)

    return (arriving.writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def retry_open_errors(spark: SparkSession, batch: int, schema: StructType,
                      features_path: str, errors_path: str, retry_path: str,
                      run: Extractor, key: str) -> None:
    """Try the failures of the last batch again when no new file has arrived.

    Successes are added to that batch's features and drop out of its errors.
    """
    target = _folder(features_path, batch)
    failed = spark.read.schema(schema).parquet(_folder(retry_path, batch))
    pending = pending_rows(failed, spark.read.parquet(target), key)
    good = run(pending).where(F.col("erro").isNull()).drop("erro")
    good.write.mode("append").parquet(target)
    _, reasons = _failures(pending, spark.read.parquet(target), run, key)
    reasons.write.mode("overwrite").parquet(_folder(errors_path, batch))
