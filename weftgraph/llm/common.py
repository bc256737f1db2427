"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_path, remove, settled, shared_dir, written  # noqa: F401  used through this module

#: Rows of one Arrow batch that goes to a Python worker; with texts of 100 kB each a batch stays under 30 MB.
ROWS_PER_BATCH = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; ``sf_dir`` may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small, as rows may hold long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def crc_of(col) -> F.Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column of a batch without nulls: a null text is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.string()), "") if col.null_count else col.cast(pa.string())


_KINDS = {"doc_id": "long", "text": "string", "source": "string", "lang": "string"}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, by exact name, so that others which differ in case don't clash; missing ones are null."""
    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    place = {name: F.col(f"c{i}") for i, name in enumerate(df.columns)}
    cols = [place.get(n, F.lit(None)) for n in names]
    return by_place.select(*[(c.cast(_KINDS[n]) if n in _KINDS else c).alias(n) for n, c in zip(names, cols, strict=True)])


def shield(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """``df`` with only the ``needed`` columns under their names and all others renamed by place, so that no name an
    operator uses can clash with them; and these names, in order. ``out.select(*names).toDF(*df.columns)`` undoes it."""
    names = [c if c in needed else f"x{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), names
