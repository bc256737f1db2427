"""Tables written to the folder that the driver and all executors share, to end a plan's lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or that ``SparkContext.setCheckpointDir`` was given. A session on one
    machine (a local master) that has neither gets a temporary folder; on a cluster it is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/weft-checkpoints"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/weft-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.add(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made.discard(path)


@atexit.register
def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and _made:
            remove(spark, *list(_made))
    except Exception:  # noqa: BLE001  the session is already gone
        pass


def settled(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """``df`` as a written table, after which the tables that it was made from are removed."""
    out, _ = written(df, name)
    remove(df.sparkSession, *paths)
    return out


#: Rows up to which a table that was counted is broadcast, where a row is at most a few hundred bytes.
FEW = 50_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few; else the join shuffles it."""
    return F.broadcast(df) if rows <= FEW else df


#: Bytes of stored input for one task where a table is dealt out.
A_TASK = 8_000_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by a key to as many tasks as the files that it is read from need. Spark puts shuffled partitions
    together by their compressed bytes, of which a task with short rows gets so many that its sorts and sums take gigabytes."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = -(-sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()) if "Relation" in leaves.apply(i).nodeName()) // A_TASK)
    return df.repartition(n, key) if n > 1 else df


def ranked(df: DataFrame, *order) -> tuple[DataFrame, str]:
    """``df`` with its 1-based ``rank`` in an order over all rows, without one task that sorts them: rows are dealt by
    ranges of the order and sorted within, and each range's rank begins after the rows of those before it."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    table, path = written(dealt, "ranked")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = table.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    out = table.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + place + 1)
    return out.drop("__part", "__before", "__at"), path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
