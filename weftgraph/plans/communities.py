"""Communities by modularity: nodes move to the neighbouring community that raises it most, all at once in rounds, and
communities then become the nodes of the next level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import remove, settled, written

LEVELS, ROUNDS = 4, 12
#: Communities larger than this share of the nodes (and than LARGE nodes) are split again at a finer resolution.
SHARE, LARGE, FINER = 0.2, 10, 1.5


def modularity(members: DataFrame, links: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (n_links, modularity) of members (id, community) over distinct undirected links (src, dst)."""
    pair = links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    m = members.select("id", "community")
    ends = pair.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b")
    sides = ends.select(F.col("ca").alias("community"), (F.col("ca") == F.col("cb")).cast("int").alias("inside")).unionByName(ends.select(F.col("cb").alias("community"), F.lit(0).alias("inside")))
    per = sides.groupBy("community").agg(F.sum("inside").alias("inside"), F.count("*").alias("degree"))
    total = ends.agg(F.count("*").alias("n_links"))
    q = per.join(F.broadcast(total))  # one row
    share = F.col("inside") / F.col("n_links") - resolution * F.pow(F.col("degree") / (2.0 * F.col("n_links")), 2)
    return q.groupBy("n_links").agg(F.round(F.sum(share), 6).alias("modularity"))


def _level(weights: DataFrame, resolution: float, rounds: int) -> tuple[DataFrame, str]:
    """(id, community) of one level of a graph (a, b, w) in both directions, where a loop has its weight twice."""
    spark = weights.sparkSession
    degree, degree_path = written(weights.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "degrees")
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    labels, path = written(degree.select("id", F.col("id").alias("community")), "labels")
    still = 0
    for number in range(rounds):
        held = labels.join(degree, "id").groupBy("community").agg(F.sum("k").alias("held"))
        # weights from a node to each community around it, and 0 to its own where it has no link there
        around = weights.where("a <> b").join(labels.toDF("b", "to"), "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("w"))
        own = labels.select("id", F.col("community").alias("to"), F.lit(0.0).alias("w"))
        offers = around.unionByName(own).groupBy("id", "to").agg(F.sum("w").alias("w")).join(labels, "id").join(degree, "id").join(held.withColumnRenamed("community", "to"), "to")
        others = F.col("held") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * others / total, 9)
        best = offers.withColumn("gain", gain).groupBy("id", "community").agg(F.min(F.struct((-F.col("gain")).alias("less"), "to")).alias("best"), F.max(F.when(F.col("to") == F.col("community"), F.col("gain"))).alias("stays"))
        # half of the nodes may move in a round, so that two don't change places
        turn = F.pmod(F.xxhash64(F.col("id"), F.lit(number // 2)), F.lit(2)) == number % 2
        moves = turn & (-F.col("best.less") > F.col("stays"))
        new, new_path = written(best.select("id", F.when(moves, F.col("best.to")).otherwise(F.col("community")).alias("community"), moves.alias("moved")), "labels")
        moved = new.where("moved").count()
        remove(spark, path)
        labels, path = new.drop("moved"), new_path
        still = 0 if moved else still + 1
        if still == 2:
            break
    remove(spark, degree_path)
    return labels, path


def _louvain(links: DataFrame, resolution: float, levels: int, rounds: int) -> tuple[DataFrame, str]:
    pair = links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    spark = links.sparkSession
    weights, weights_path = written(pair.select("a", "b", F.lit(1.0).alias("w")).unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1.0).alias("w"))), "weights")
    members, members_path = written(weights.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")), "members")
    n = members.count()
    for _ in range(levels):
        labels, path = _level(weights, resolution, rounds)
        new, new_path = written(members.join(labels.toDF("community", "__next"), "community").select("id", F.col("__next").alias("community")), "members")
        lifted = weights.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"))
        lifted, lifted_path = written(lifted, "weights")
        remove(spark, members_path, weights_path, path)
        members, members_path, weights, weights_path = new, new_path, lifted, lifted_path
        before, n = n, members.select("community").distinct().count()
        if n == before:
            break
    remove(spark, weights_path)
    return members, members_path


def by_modularity(links: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, levels: int = LEVELS, rounds: int = ROUNDS) -> DataFrame:
    """(id, community) of undirected links (src, dst); a community is named by one of its nodes. Nodes (id) without links
    are communities of their own. Communities that are too large are split once more. Runs agree; equal gains go to the
    lesser community."""
    members, path = _louvain(links, resolution, levels, rounds)
    most = max(LARGE, int(SHARE * members.count()))
    large = members.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") > most).select("community")
    paths = [path]
    if not large.isEmpty():
        own = members.join(F.broadcast(large), "community", "left_semi")  # 1 / SHARE rows at most
        inside = links.join(own.toDF("src", "cs"), "src").join(own.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst")
        finer, finer_path = _louvain(inside, FINER * resolution, levels, rounds)
        paths.append(finer_path)
        members = members.join(finer.toDF("id", "__finer"), "id", "left").select("id", F.coalesce("__finer", "community").alias("community"))
    if nodes is not None:
        alone = nodes.select("id").distinct().join(members, "id", "left_anti")
        members = members.unionByName(alone.select("id", F.col("id").alias("community")))
    return settled(members, "communities", paths)
