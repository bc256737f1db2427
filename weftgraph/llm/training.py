"""A bounded sample of labelled documents for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed: Column | None = None) -> DataFrame:
    """(doc_id, text, y, place) of at most ``per_class`` documents of each label 0 and 1, those whose hashed ids come
    first; ``allowed`` (an expression over doc_id) leaves labels out.

    Null and contradicting labels are left out, repeated ones count once; of rows with one doc_id the least text counts.
    """
    labels = pick(labels, "doc_id", label)
    own = labels.where(allowed) if allowed is not None else labels
    own = own.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("__most")).where("y = __most")
    own = own.select(F.col("doc_id").alias("__id"), F.col("y").cast("int").alias("y"), F.xxhash64("doc_id").alias("place"))
    parts = [own.where(F.col("y") == y).orderBy("place", "__id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 * per_class rows at most
    found = pick(docs, "doc_id", "text").join(F.broadcast(chosen), F.expr("doc_id = __id"))
    return found.groupBy("doc_id", "y", "place").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def within(rows: DataFrame, column: str, most: int) -> DataFrame:
    """Rows of labels 0 and 1 whose bytes in ``column`` sum to ``most`` at most: what the driver can hold. Each label
    has half of it and then what the other one leaves; by ``place``, and a row that doesn't fit is passed over."""
    rows, _ = written(rows, "sample")
    sizes = sorted(rows.select("place", "doc_id", "y", F.octet_length(column)).collect())  # rows of a bounded sample
    room, left, chosen = {0: most // 2, 1: most - most // 2}, [], []
    for place, i, y, size in sizes:
        if size <= room[y]:
            room[y] -= size
            chosen.append(i)
        else:
            left.append((i, size))
    rest = sum(room.values())
    for i, size in left:
        if size <= rest:
            rest -= size
            chosen.append(i)
    if len(chosen) == len(sizes):
        return rows
    ids = rows.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    return rows.join(F.broadcast(ids), "doc_id", "left_semi")
