"""Traversals as level loops over DataFrames; each level is written to the shared folder, so plans stay short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import ACROSS, FOLLOW, edge_prior, graph_score, noisy_or_of_counts, path_confidence
from ..sources.tables import FEW, dealt, remove, settled, small, written
from .lenses import excluded, language

DEGREE_LIMIT, FANOUT, PATHS, DEPTH, THRESHOLD = 40, 24, 3, 5, 0.20


def _adjacency(edges: DataFrame) -> DataFrame:
    """(node, peer, flow, type, confidence, prior, place): each edge from both of its ends."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in FOLLOW]), F.col("type")), F.lit(0))
    e = edges.withColumn("prior", edge_prior(F.col("type"), F.col("confidence"))).withColumn("place", F.when(place == 0, 20).otherwise(place - 1))
    side = lambda node, peer, flow: e.select(F.col(node).alias("node"), F.col(peer).alias("peer"), F.lit(flow).alias("flow"), "type", "confidence", "prior", "place")
    return side("dst", "src", "upstream").unionByName(side("src", "dst", "downstream"))


def blast_radius(
    nodes: DataFrame, edges: DataFrame, target: str, max_depth: int = DEPTH, direction: str = "both", threshold: float = THRESHOLD, rules: list[str] | None = None,
    degree_limit: int | None = DEGREE_LIMIT, fanout: int | None = FANOUT, paths: int | None = PATHS,
) -> DataFrame:
    """(id, kind, file, distance, n_paths, confidence, score, category) of the nodes around a target.

    Simple paths grow level by level. A path's confidence is the product of its edges' priors, less with each hop; a
    node's is the noisy-or of its paths'. category: direct (one hop, 0.5 or more), indirect, excluded (below the
    threshold), or rule (left out by ``rules`` before any path through it is recorded).

    Guards, each off with None: nodes with ``degree_limit`` edges or more aren't left again, a node follows its first
    ``fanout`` edges by type and peer, and only the first ``paths`` paths to a node go on. A missing target gives no rows.
    """
    made: list[str] = []

    def keep(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        table, path = written(df, name)
        made.append(path)
        return table, table.count()

    adjacency = _adjacency(edges)
    files = nodes.select(F.col("id").alias("peer"), F.col("kind").alias("peer_kind"), F.col("file").alias("peer_file"))
    # :: and . before these names mark constructors, which calls of their class reach
    start = nodes.where(F.col("id") == target).select(F.col("id").alias("node"), F.lit("").alias("path"), F.array("id").alias("seen"), F.lit(1.0).alias("product"))
    frontier, n_paths = keep(start, "frontier")
    recorded, pruned, order = None, None, ("place", "peer", "flow", "type", "confidence")
    for depth in range(max_depth):
        if recorded is not None and not n_paths:
            break
        own = adjacency.join(small(frontier, n_paths), "node")
        parent = F.regexp_replace("node", r"(\.__init__|::constructor|\.constructor)$", "")
        classes = frontier.withColumn("parent", parent).where("parent <> node")
        built = adjacency.where("flow = 'upstream' and type = 'CALLS'").withColumnRenamed("node", "parent").join(small(classes, n_paths), "parent").drop("parent")
        cand = own.unionByName(built.select(own.columns))
        if depth and degree_limit is not None:
            # degrees are counted before any path's edges are brought together
            hubs = own.groupBy("path").agg(F.count("*").alias("degree")).where(F.col("degree") >= degree_limit).select("path")
            cand = cand.join(small(hubs, n_paths), "path", "left_anti")
        if direction != "both":
            cand = cand.where(F.col("flow") == direction)
        if not depth and fanout is not None:
            cand = cand.orderBy(*order).limit(fanout)  # the target alone: its first edges without a window over all of them
        if fanout is None and paths is None:
            cand = cand.withColumn("n", F.monotonically_increasing_id())  # the order of paths doesn't matter
        else:
            cand = cand.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(*order)))
        if fanout is not None:
            cand = cand.where(F.col("n") <= fanout)
        a, b = language(F.col("node")), language(F.col("peer"))
        cand = cand.where(~F.array_contains("seen", F.col("peer"))).where(F.col("type").isin(ACROSS) | (a == "") | (b == "") | (a == b))
        if depth:
            cand = cand.where(b != "")
        if fanout is not None and n_paths * fanout <= FEW:
            cand = files.join(F.broadcast(cand), "peer", "right")  # ``fanout`` rows a path at most
        else:
            cand = cand.join(files, "peer", "left")
        level = cand.select(
            F.col("peer").alias("node"), F.concat("path", F.lpad(F.col("n").cast("string"), 12, "0")).alias("path"), F.concat("seen", F.array("peer")).alias("seen"),
            (F.col("product") * F.col("prior")).alias("product"), F.lit(depth + 1).alias("hops"), "peer_kind", "peer_file", "prior",
            (~F.lower("confidence").isin("external", "unresolved") & F.coalesce(F.col("peer_kind") != "external_symbol", F.lit(True))).alias("goes_on"),
        )
        level = level.withColumn("out", excluded(F.col("node"), F.coalesce("peer_file", F.lit("")), rules) if rules else F.lit(False))
        level, _ = keep(level, "level")
        gone = level.where("out").select("node", "hops", "prior")
        pruned = gone if pruned is None else pruned.unionByName(gone)
        level = level.where("not out")
        recorded_before, new = recorded, level.select("node", "hops", "product")
        recorded = new if recorded is None else recorded.unionByName(new)
        on = level
        if paths is not None:
            on = on.withColumn("order", F.row_number().over(Window.partitionBy("node").orderBy("path")))
            if recorded_before is not None:
                before = recorded_before.groupBy("node").agg(F.count("*").alias("before"))
                on = on.join(before, "node", "left").withColumn("order", F.col("order") + F.coalesce("before", F.lit(0)))
            on = on.where(F.col("order") <= paths)
        if depth + 1 < max_depth:
            frontier, n_paths = keep(on.where("goes_on").select("node", "path", "seen", "product"), "frontier")
    each = recorded.withColumn("p", path_confidence(F.col("product"), F.col("hops")))
    by_value = each.groupBy(F.col("node").alias("id"), "p").agg(F.min("hops").alias("hops"), F.count("*").alias("n"))
    found = by_value.groupBy("id").agg(F.min("hops").alias("distance"), F.sum("n").alias("n_paths"), noisy_or_of_counts(F.collect_list(F.struct("p", "n"))).alias("confidence"))
    category = F.when(F.col("confidence") < threshold, "excluded").when((F.col("distance") == 1) & (F.col("confidence") >= 0.5), "direct").otherwise("indirect")
    found = found.withColumn("score", graph_score(F.col("confidence"), F.col("distance"))).withColumn("category", category)
    by_rule = pruned.groupBy(F.col("node").alias("id")).agg(F.min("hops").alias("distance"), F.count("*").alias("n_paths"), F.max("prior").alias("confidence"))
    found, n_found = keep(found.unionByName(by_rule.withColumn("score", F.col("confidence")).withColumn("category", F.lit("rule"))), "found")
    cards = nodes.select("id", "kind", "file")
    out = cards.join(F.broadcast(found), "id", "right") if n_found <= FEW else found.join(cards, "id", "left")
    return settled(out.select("id", "kind", "file", "distance", "n_paths", "confidence", "score", "category"), "blast", made)


def blast_summary(found: DataFrame) -> DataFrame:
    """One row: counts by category, mean confidence and greatest distance of what is affected, files and tables."""
    hit = F.col("category").isin("direct", "indirect")
    n = lambda c: F.count_if(F.col("category") == c)
    return found.agg(
        n("direct").alias("direct_count"), n("indirect").alias("indirect_count"), F.count_if(~hit).alias("excluded_count"), F.round(F.coalesce(F.avg(F.when(hit, F.col("confidence"))), F.lit(0.0)), 4).alias("mean_confidence"),
        F.coalesce(F.max(F.when(hit, F.col("distance"))), F.lit(0)).alias("max_distance"), F.countDistinct(F.when(hit, F.col("file"))).alias("affected_files"), F.countDistinct(F.when(hit & F.lower("kind").isin("sql_table", "table"), F.col("id"))).alias("affected_tables"),
    )


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, upstream: bool = False) -> DataFrame:
    """(id, depth) of nodes reached from seeds (id) along edges, or against them; seeds have depth 0."""
    made = []
    step = edges.select(F.col("dst" if upstream else "src").alias("id"), F.col("src" if upstream else "dst").alias("peer"))
    known, path = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "reach")
    made.append(path)
    frontier, n, total = known, known.count(), known.count()
    for depth in range(1, max_depth + 1):
        new = step.join(small(frontier.select("id"), n), "id").select(F.col("peer").alias("id")).distinct().join(small(known.select("id"), total), "id", "left_anti")
        frontier, path = written(new.withColumn("depth", F.lit(depth)), "reach")
        made.append(path)
        n = frontier.count()
        total += n
        if not n:
            break
        known = known.unionByName(frontier)
    return settled(known, "reached", made)


def impact(nodes: DataFrame, edges: DataFrame, target: str, max_depth: int = 5) -> DataFrame:
    """(id, kind, file, depth) of the nodes that reach a target."""
    seeds = nodes.where(F.col("id") == target).select("id")
    return reach(edges, seeds, max_depth, upstream=True).where("depth > 0").join(nodes.select("id", "kind", "file"), "id", "left").select("id", "kind", "file", "depth")


def impact_edges(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(src, dst, type, depth): distinct edges against whose direction each level goes, so an edge on a cycle has a row
    for each depth."""
    made, out = [], None
    frontier, path = written(seeds.select(F.col("id").alias("dst")).distinct(), "frontier")
    made.append(path)
    for depth in range(1, max_depth + 1):
        n = frontier.count()
        if out is not None and not n:
            break
        # repeated edges fall together after the join, so the edges themselves aren't shuffled for a small frontier
        level, path = written(edges.select("src", "dst", "type").join(small(frontier, n), "dst").distinct().select("src", "dst", "type", F.lit(depth).alias("depth")), "impact")
        made.append(path)
        out = level if out is None else out.unionByName(level)
        if depth < max_depth:
            frontier, path = written(level.select(F.col("src").alias("dst")).distinct(), "frontier")
            made.append(path)
    return settled(out, "impact-edges", made)


def reach_by_depth(edges: DataFrame, seeds: DataFrame, gold: DataFrame, max_depth: int = 4) -> DataFrame:
    """Per depth the distinct edges within it of the seeds, against gold edges (src, dst, type): precision, recall, F1."""
    depths = reach(edges, seeds, max_depth - 1)
    side = lambda e, own: e.select("src", "dst", "type", F.lit(own).alias("own"), F.lit(1 - own).alias("gold"))
    # both kinds of edges lie by their source, where they fall together and meet its depth
    each = dealt(side(edges, 1).unionByName(side(gold, 0)), "src").groupBy("src", "dst", "type").agg(F.max("own").alias("own"), F.max("gold").alias("gold"))
    at = each.join(depths.withColumnRenamed("id", "src"), "src", "left").groupBy("depth").agg(F.sum("own").alias("found"), F.sum(F.col("own") * F.col("gold")).alias("hits"), F.sum("gold").alias("gold"))
    at, _ = written(at, "by-depth")  # a row a depth
    total = at.agg(F.coalesce(F.sum("gold"), F.lit(0)).alias("gold"))
    level = F.explode(F.sequence(F.col("depth") + 1, F.lit(max_depth))).alias("max_hops")
    by = at.where("depth is not null and found > 0").select(level, "found", "hits").groupBy("max_hops").agg(F.sum("found").alias("found"), F.sum("hits").alias("hits"))
    p, r = F.col("hits") / F.col("found"), F.when(F.col("gold") > 0, F.col("hits") / F.greatest("gold", F.lit(1))).otherwise(1.0)
    out = by.join(F.broadcast(total)).withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / F.greatest(F.col("p") + F.col("r"), F.lit(1e-300))).otherwise(0.0)
    return out.select("max_hops", "found", "hits", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def cycles(links: DataFrame, longest: int = 6) -> DataFrame:
    """(length, cycle): elementary cycles of distinct links (src, dst) of 2 to ``longest`` nodes, each once, from its
    least node and closed with it. Paths only grow over nodes above their first, and only where the first is reachable
    at all: nodes without a way in or out are peeled off first."""
    e, path = written(links.where("src <> dst").select("src", "dst").distinct(), "links")
    made = [path]
    n = e.count()
    for _ in range(longest):
        both = e.select("src").intersect(e.select("dst")).toDF("__id")
        less, path = written(e.join(both, F.expr("src = __id"), "left_semi").join(both, F.expr("dst = __id"), "left_semi"), "links")
        before, n, e = n, less.count(), less
        made.append(path)
        if n == before:
            break
    paths = e.where("dst > src").select(F.array("src", "dst").alias("path"))
    out = None
    for length in range(2, longest + 1):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        closed = paths.join(e, (last == F.col("src")) & (first == F.col("dst"))).select(F.lit(length).alias("length"), F.concat("path", F.array(first)).alias("cycle"))
        out = closed if out is None else out.unionByName(closed)
        if length < longest:
            more = paths.join(e, last == F.col("src")).where((F.col("dst") > first) & ~F.array_contains("path", F.col("dst")))
            paths, path = written(more.select(F.concat("path", F.array("dst")).alias("path")), "paths")
            made.append(path)
    return settled(out, "cycles", made)


def label_propagation(links: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) of undirected, distinct links (src, dst): each node takes the commonest label around it, its own
    counting once, the least of equals; all at once, for a number of rounds."""
    both = links.where("src <> dst").select("src", "dst").union(links.where("src <> dst").select("dst", "src")).distinct()
    both, links_path = written(both, "links")
    last = None
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "community").unionByName(labels)
        n = votes.groupBy("id", "community").agg(F.count("*").alias("n"))
        labels, path = written(n.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("best")).select("id", F.col("best.community").alias("community")), "labels")
        if last:
            remove(links.sparkSession, last)
        last = path
    return settled(labels, "communities", [links_path, *([last] if last else [])])


def cohesion(members: DataFrame, links: DataFrame) -> DataFrame:
    """(community, n_nodes, n_links, cohesion): distinct links inside a community over the pairs of its nodes; 1 for one."""
    m = members.select("id", "community")
    pair = links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    inside = pair.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("n_links"))
    n = m.groupBy("community").agg(F.count("*").alias("n_nodes")).join(inside, "community", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    size = F.col("n_nodes")
    return n.withColumn("cohesion", F.when(size <= 1, 1.0).otherwise(F.round(F.col("n_links") / (F.greatest(size * (size - 1), F.lit(1)) / 2), 4)))


def community_labels(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, label): the commonest parent folder of its members, the first of equals, and their least signature."""
    folder = F.when(F.col("file").contains("/"), F.regexp_extract("file", "([^/]+)/[^/]*$", 1)).otherwise("")
    m = members.join(nodes.select("id", "sig", folder.alias("folder")), "id")
    by = m.groupBy("community", "folder").agg(F.count("*").alias("n"), F.min("sig").alias("sig"))
    best = by.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "folder")).alias("best"), F.min("sig").alias("sig"))
    return best.select("community", F.concat_ws(": ", F.col("best.folder"), F.col("sig")).alias("label"))


def cross_community(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, n): links from community a to another community b."""
    m = members.select("id", "community")
    e = links.join(m.toDF("src", "a"), "src").join(m.toDF("dst", "b"), "dst").where("a <> b")
    return e.groupBy("a", "b").agg(F.count("*").alias("n"))
