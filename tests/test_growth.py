"""Queries at size: what they shuffle, by their plans, with results against plain Python."""

import contextlib
import io
import random

from weftgraph.operators import budget, graph
from weftgraph.plans import lenses


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def some_graph(spark, seed, n=30, m=160):
    """Some ids are no nodes, some nodes come twice with different files, and edges repeat."""
    rng = random.Random(seed)
    nodes = [(f"py:m{i % 5}::n{i}", rng.choice(["function", "sql_table", "file"]), rng.choice(["a/x.py", "a/y.py", "b/x.sql", "", None])) for i in range(n)]
    nodes += [(i, k, "c/z.py") for i, k, _ in nodes[:4]]
    ids = [r[0] for r in nodes] + ["py:m::gone"]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(["CALLS", "WRITES", "DEFINED_IN"]), rng.choice(["resolved", "external", "dynamic", "ambiguous"])) for _ in range(m)]
    return nodes, edges, spark.createDataFrame(nodes, "id string, kind string, file string").withColumn("sig", graph.last_part(graph.F.col("id"))), spark.createDataFrame(edges, "src string, dst string, type string, confidence string")


def test_risk_of_sources(spark):
    nodes, edges, n, e = some_graph(spark, 1, m=50)
    of = {}
    for src, dst, _, _ in edges:
        of.setdefault(src, []).extend((dst, k, f) for i, k, f in nodes if i == dst)
    want = {}
    for src, hit in of.items():
        if hit:
            affected, files = len({h[0] for h in hit}), len({h[2] for h in hit} - {None})
            want[src] = "HIGH" if any(h[1] == "sql_table" for h in hit) or affected > 5 else "MEDIUM" if affected > 1 or files > 1 else "LOW"
    df = budget.risk_of_sources(n, e)
    assert dict(df.collect()) == want and "Expand" not in plan(df)


def test_noisy_or_in_bounded_tasks(spark, sf, monkeypatch):
    """Line items are dealt to tasks by the size of their files."""
    from weftgraph.sources import graph_views, tables

    monkeypatch.setattr(tables, "A_TASK", 20_000, raising=False)
    assert "REPARTITION_BY_NUM" in plan(graph_views.edges(spark, sf).where("type = 'WRITES'"))


def test_surprising_by_classes(spark):
    """The same rows whether or not the unsurest edges fill the top; pairs aren't brought together before their nodes."""
    for seed, m, top in ((1, 12, 10), (2, 160, 3), (3, 160, 10), (4, 160, 100)):
        nodes, edges, n, e = some_graph(spark, seed, m=m)
        n = n.dropDuplicates(["id"])
        files = {r.id: r.file for r in n.collect()}
        part = lambda f: (f.rpartition("/")[0], f.rpartition(".")[2])
        best = {}
        for src, dst, kind, sure in edges:
            if kind != "DEFINED_IN" and src in files and dst in files:
                a, b = files[src], files[dst]
                cross = 1 + 2 * (part(a)[0] != part(b)[0]) + 3 * (part(a)[1] != part(b)[1]) if a and b and a != b else 0
                score = {"resolved": 0, "external": 1}.get(sure, 3) + cross
                if score:
                    best[src, dst] = min(best.get((src, dst), (1,)), (-score, kind, sure))
        want = sorted((s, src, dst, kind, sure) for (src, dst), (s, kind, sure) in best.items())[:top]
        assert [(-r.score, r.src, r.dst, r.type, r.confidence) for r in graph.surprising(n, e, top=top).collect()] == want
    calls = spark.createDataFrame([("py:a::b", "sql:c::d", "CALLS", "resolved")], e.schema).unionByName(e.where("confidence = 'dynamic'")).repartition(1)
    graph.surprising(n, calls.withColumn("src", graph.F.expr("if(confidence = 'resolved', raise_error('read'), src)")), top=1).collect()  # class 0 is not needed


def test_diff_within_reads_edges_once(spark):
    nodes, edges, n, e = some_graph(spark, 5)
    edges += [("py:m0::n0|x", "y", "CALLS", "resolved"), ("py:m0::n0", "x|y", "CALLS", "resolved")]  # one text, two edges
    e = spark.createDataFrame(edges, e.schema)
    n = n.unionByName(spark.createDataFrame([("py:m0::n0|x", "file", "f", "s"), ("x|y", "file", "f", "s")], n.schema)).dropDuplicates(["id"]).withColumn("content_hash", graph.F.sha2("id", 256))
    old, new = n.where("kind <> 'sql_table' or id like '%n0%'"), n.where("kind <> 'file' or id in ('x|y')").withColumn("content_hash", graph.F.expr("if(kind = 'function', 'other', content_hash)"))
    a, b = ({r.id: r.content_hash for r in x.collect()} for x in (old, new))
    was, now = {"|".join(x[:3]) for x in edges if x[0] in a}, {"|".join(x[:3]) for x in edges if x[1] in b}
    want = {("removed", "edge", i) for i in was - now} | {("added", "edge", i) for i in now - was} | {("removed", "node", i) for i in a.keys() - b.keys()} | {("added", "node", i) for i in b.keys() - a.keys()} | {("modified", "node", i) for i in a.keys() & b.keys() if a[i] != b[i]}
    df = lenses.diff_within(e, old, new)
    assert plan(df).count("Scan ExistingRDD[src") == 1 and {tuple(r) for r in df.collect()} == want
    apart = lenses.diff(old, e.join(old.select(graph.F.col("id").alias("src")), "src", "left_semi"), new, e.join(new.select(graph.F.col("id").alias("dst")), "dst", "left_semi"))
    assert {tuple(r) for r in apart.collect()} == want


def test_reach_by_depth_of_repeated_edges(spark):
    """Repeated edges and gold edges that are no edges, against plain Python; edges and gold edges are shuffled together."""
    from weftgraph.plans import traverse

    _, edges, _, e = some_graph(spark, 6, m=60)
    gold = [(s, d, t) for s, d, t, _ in edges[::3]] + [("py:x::y", "z", "CALLS")] * 2
    depth, frontier = {edges[0][0]: 0}, {edges[0][0]}
    for k in (1, 2):
        frontier = {d for s, d, _, _ in edges if s in frontier} - depth.keys()
        depth |= dict.fromkeys(frontier, k)
    want = {}
    for k in (1, 2, 3):
        found = {x[:3] for x in edges if depth.get(x[0], 9) < k}
        want[k] = (len(found), len(found & set(gold)), round(len(found & set(gold)) / len(set(gold)), 4))
    df = traverse.reach_by_depth(e, e.select(graph.F.lit(edges[0][0]).alias("id")), spark.createDataFrame(gold, "src string, dst string, type string"), 3)
    assert {r.max_hops: (r.found, r.hits, r.recall) for r in df.collect()} == want and "SortMergeJoin" not in plan(df)
