"""The queries of a property graph behind one object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import context, task, temporal
from .operators import graph as g
from .operators.budget import telemetry
from .plans import bridges, communities, lenses, traverse
from .plans.components import components
from .sources import store


class GraphEngine:
    """nodes (id, kind, sig, file, ...), edges (src, dst, type, confidence), and commits (hash, ts, files) where there are
    any. Every method gives a DataFrame."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, commits: DataFrame | None = None):
        self.nodes, self.edges, self.commits = nodes, edges, commits

    @classmethod
    def from_tree(cls, spark, root: str, rules: list[str] | None = None, commits: DataFrame | None = None, with_log: bool = False) -> GraphEngine:
        """Scan, parse and resolve a source tree; ``with_log`` reads its commits from git."""
        from .lang import parse_files
        from .plans.resolve import resolve
        from .sources import git
        from .sources.files import scan
        from .sources.tables import written

        commits = git.log(spark, root) if with_log and commits is None else commits
        nodes, raw, _ = parse_files(written(scan(spark, root, rules).select("path", "kind", "text"), "files")[0])
        nodes, raw = written(nodes, "nodes")[0], written(raw, "raw-edges")[0]
        edges, outside = resolve(nodes.select("id", "kind", "file"), raw)
        invoked = bridges.links(nodes).select("src", "dst", F.lit("INVOKES").alias("type"), "confidence").distinct()
        edges = edges.unionByName(invoked, allowMissingColumns=True)
        return cls(nodes.unionByName(outside, allowMissingColumns=True), written(edges, "edges")[0], commits)

    @classmethod
    def federated(cls, engines: dict[str, GraphEngine]) -> GraphEngine:
        """The graphs of several roots as one; ids and files get their root's name, so that equal paths stay apart."""
        parts = [lenses.rooted(e.nodes, e.edges, root) for root, e in engines.items()]
        nodes, edges = parts[0]
        for n, e in parts[1:]:
            nodes, edges = nodes.unionByName(n, allowMissingColumns=True), edges.unionByName(e, allowMissingColumns=True)
        return cls(nodes, edges)

    def save(self, path: str) -> None:
        store.save(self.nodes, self.edges, path)

    def graphml(self, path: str) -> None:
        store.graphml(self.nodes, self.edges, path)

    @classmethod
    def load(cls, spark, path: str) -> GraphEngine:
        return cls(*store.load(spark, path))

    def lookup(self, query: str) -> DataFrame:
        return g.lookup(self.nodes, query)

    def search(self, text: str, most: int = 10) -> DataFrame:
        return g.search(self.nodes, text, most)

    def neighbors(self, node_id: str, direction: str = "both", most: int = 30) -> DataFrame:
        return g.neighbors(self.nodes, self.edges, node_id, direction, most)

    def blast_radius(self, node_id: str, **options) -> DataFrame:
        return traverse.blast_radius(self.nodes, self.edges, node_id, **options)

    def impact(self, node_id: str, max_depth: int = 5) -> DataFrame:
        return traverse.impact(self.nodes, self.edges, node_id, max_depth)

    def data_trace(self, entity: str) -> DataFrame:
        return g.data_trace(self.nodes, self.edges, entity)

    def co_changes(self, target: str, **options) -> DataFrame:
        if self.commits is None:
            raise ValueError("this graph has no commits")
        return temporal.for_target(temporal.co_changes(self.commits, **options), target)

    def resolve(self, text: str, top: int = 10) -> DataFrame:
        return task.resolve_task(self.nodes, text, top)

    def explain(self, text: str, top: int = 5) -> DataFrame:
        return task.explain(self.nodes, text, top)

    def compile(self, text: str, budget: int = 1500, **options) -> context.Package:
        """Entries, neighbours, files, limits, risk and plan of a task, and its text within a budget."""
        return context.compile_context(self.nodes, self.edges, text, budget, **options)

    def context(self, text: str, budget: int = 1500, entries: int = 5) -> DataFrame:
        """The pack around the first symbols of a task."""
        found = [row.id for row in self.resolve(text, entries).collect()]
        return task.context_pack(self.nodes, self.edges, found, budget)

    def context_pack(self, targets: list[str], budget: int = 1500) -> DataFrame:
        return task.context_pack(self.nodes, self.edges, targets, budget)

    def god_nodes(self, top: int = 10, hub_percentile: float | None = None) -> DataFrame:
        return g.god_nodes(self.nodes, self.edges, top, hub_percentile)

    def surprising(self, top: int = 10) -> DataFrame:
        return g.surprising(self.nodes, self.edges, top=top)

    def cycles(self, longest: int = 6) -> DataFrame:
        """Import cycles between files."""
        home = self.nodes.selectExpr("id", "file")
        e = self.edges.where("type = 'IMPORTS'").join(home.toDF("src", "src_file"), "src").join(home.toDF("dst", "dst_file"), "dst")
        return traverse.cycles(e.selectExpr("src_file as src", "dst_file as dst").where("not (src rlike '[.](md|rst|txt)$' or dst rlike '[.](md|rst|txt)$')"), longest)

    def communities(self, rounds: int | None = None) -> DataFrame:
        """(id, community) by modularity, without external and configuration nodes; with ``rounds`` by that many rounds of
        label propagation instead, which is cheaper."""
        if rounds is not None:
            return traverse.label_propagation(self.edges.select("src", "dst").where("not src like 'ext:%' and not dst like 'ext:%'"), rounds)
        inner = self.nodes.where("not id like 'ext:%'").where(~F.col("kind").isin(lenses.CONFIG_KINDS)).select("id")
        e = self.edges.select("src", "dst").join(inner.toDF("src"), "src", "left_semi").join(inner.toDF("dst"), "dst", "left_semi")
        return communities.by_modularity(e, inner)

    def components(self) -> DataFrame:
        """(id, component): the weakly connected parts, named by their least id's hash."""
        h = self.edges.selectExpr("src", "dst", "xxhash64(src) as a", "xxhash64(dst) as b")
        parts = components(h.select("a", "b"))
        ids = h.selectExpr("src as id", "a as node").union(h.selectExpr("dst", "b")).distinct()
        return ids.join(parts, "node").select("id", "component")

    def lens(self, name: str) -> tuple[DataFrame, DataFrame]:
        return lenses.named_lens(self.nodes, self.edges, name)

    def report(self, top: int = 10) -> str:
        return store.report(self.nodes, self.edges, top)

    def questions(self, most: int = 10) -> list[str]:
        n = self.communities().select("community").distinct().count()
        return g.questions(self.god_nodes(3), self.cycles(), self.surprising(3), n, most)

    def kinds(self) -> DataFrame:
        return g.kind_counts(self.nodes)

    def routes(self) -> DataFrame:
        """(src, dst, method, route, confidence): client calls with the routes that they reach."""
        return bridges.links(self.nodes).orderBy("src", "dst", "route")

    def stats(self, calls: DataFrame) -> DataFrame:
        return telemetry(calls)
