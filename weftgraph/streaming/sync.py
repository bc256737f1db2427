"""Incremental synchronization: listings as a stream, and changed files merged into stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.budget import snapshot_diff
from ..sources.tables import remove


def merge_partition(table: str, new: DataFrame, key: str, gone: DataFrame) -> None:
    """Rewrite only the partitions of a Parquet table, partitioned by ``key``, that ``new`` or ``gone`` (key) touch."""
    spark = new.sparkSession
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(table)
    empty = [r[0] for r in gone.join(new.select(key).distinct(), key, "left_anti").select(key).distinct().collect()]  # the deleted files of one batch
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for value in empty:
        path = fs.Path(f"{table}/{key}={spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def watch(spark: SparkSession, listings: str, previous: DataFrame, on_change: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``on_change`` (changes (path, change), batch) for each listing (path, mtime, size) that appears in a folder,
    against the one before it, ``previous`` for the first; available listings are worked off and then the stream ends.

    Each listing is kept as a table named by its batch beside the checkpoint until the next but one, so a stream that is
    started again goes on from the listing that it had last, and a batch that is repeated sees the same one.
    """
    kept = lambda number: f"{checkpoint.rstrip('/')}-listings/batch={number}"
    schema = "path string, mtime long, size long"

    def step(batch: DataFrame, number: int) -> None:
        batch.select("path", "mtime", "size").write.mode("overwrite").parquet(kept(number))
        now = spark.read.schema(schema).parquet(kept(number))
        last = spark.read.schema(schema).parquet(kept(number - 1)) if number else previous
        on_change(snapshot_diff(last, now), number)
        if number > 1:
            remove(spark, kept(number - 2))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(listings)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_since(listing: DataFrame, mtime: int) -> DataFrame:
    return listing.where(F.col("mtime") > mtime)
