"""Connected components of a graph of links, as joins and grouped minima over written tables.

Each round replaces the links by those of large-star and small-star (every node points its larger neighbours, then its
smaller ones, to the least node around it), which keeps the components and ends in stars after a number of rounds that
is logarithmic in practice. Minima are taken by partial aggregation and joined back, so a node with very many links is
no group in any task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import remove, written

ROUNDS = 60


def _mark(links: DataFrame) -> tuple:
    """A count and a checksum: equal for two rounds only when no link has changed."""
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def _to_least(sided: DataFrame, keep) -> DataFrame:
    """Links (node, other) become links to the least node around ``node``, for the others that ``keep`` names."""
    least = sided.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    return sided.join(least, "node").where(keep)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b) of longs; component is the least node reachable, itself included."""
    spark = links.sparkSession
    tidy = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = written(tidy(links), "links")
    mark = _mark(now)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(now.select("b", "a"))
        large = tidy(_to_least(both, F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("least").alias("b")))
        # now a > b in every link: a's smaller neighbours and a itself go to the least of them
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        small = _to_least(down, F.lit(True)).select(F.explode(F.array(F.struct(F.col("other").alias("a"), F.col("least").alias("b")), F.struct(F.col("node").alias("a"), F.col("least").alias("b")))).alias("l")).select("l.*")
        new, new_path = written(tidy(small), "links")
        new_mark = _mark(new)
        remove(spark, path)
        now, path, same, mark = new, new_path, new_mark == mark, new_mark
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    # stars: every a has one b
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
