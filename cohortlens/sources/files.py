"""Which listed files are really there. Contents are never read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that list folders, and names in one batch of rows.
LISTERS, NAMES_AT_ONCE = 256, 10_000


def file_listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths below a folder, listed by Spark and pruned to the path column."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).load(folder)
            .select(bare_path("path").alias("path")))


def listing_by_folder(folders: DataFrame, folder: str, suffix: str = "", tasks: int = LISTERS) -> DataFrame:
    """Paths right below each of the given folders, listed by the executors and never held by the driver.

    ``folders`` has one row per folder, under a path or address that every executor can reach. Folders
    are dealt out over ``tasks`` and a task holds one folder's names at a time. A folder that is not
    there, or a null one, has no rows; one named twice is listed once.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked in batch.column(0).to_pylist():
                store, root = fs.FileSystem.from_uri(asked)
                root = root.rstrip("/")
                found = [asked.rstrip("/") + f.path[len(root):]
                         for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))
                         if f.type == fs.FileType.File and f.path.endswith(suffix)]
                for i in range(0, len(found), NAMES_AT_ONCE):
                    yield pa.RecordBatch.from_arrays([pa.array(found[i:i + NAMES_AT_ONCE], pa.string())], names=["path"])

    asked = folders.select(F.col(folder).alias("folder")).where(F.col("folder").isNotNull()).distinct()
    return (asked.repartition(tasks, "folder").mapInArrow(names, "path string")
            .select(bare_path("path").alias("path")))


def bare_path(column: str):
    """Without a scheme such as ``file:``, so both sides compare."""
    return F.regexp_replace(F.col(column), r"^[A-Za-z][A-Za-z0-9+.-]*:/{1,3}", "/")


def parent_folders(listing: DataFrame) -> DataFrame:
    """Folders that hold at least one file."""
    return listing.select(F.regexp_replace("path", r"/[^/]+$", "").alias("path")).distinct()


def present(listed: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    return (listed.withColumn("_p", bare_path(path))
            .join(listing.select(F.col("path").alias("_p")), "_p", "left_semi").drop("_p"))


def missing(listed: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    return (listed.withColumn("_p", bare_path(path))
            .join(listing.select(F.col("path").alias("_p")), "_p", "left_anti").drop("_p"))


def presence_summary(listed: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Counts over all listed rows, and what the picture suggests."""
    marked = listed.withColumn("_p", bare_path(path)).join(
        listing.select(F.col("path").alias("_p"), F.lit(1).alias("_there")), "_p", "left")
    return marked.agg(F.count("*").alias("n"), F.count("_there").alias("n_present")).select(
        "n", "n_present", (F.col("n") - F.col("n_present")).alias("n_missing"),
        F.when(F.col("n_present") == 0, "not on disk")
        .when(F.col("n_present") == F.col("n"), "unreadable").otherwise("mixed")
        .alias("diagnosis"))
