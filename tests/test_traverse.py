"""Traversals against plain Python."""

import math
from collections import defaultdict, deque

import pytest

from weftgraph.functions.confidence import ACROSS, FOLLOW, LEVEL_PRIOR, TYPE_PRIOR
from weftgraph.plans import traverse as tr
from weftgraph.plans.components import components


def prior(kind, level):
    by_type = TYPE_PRIOR.get(kind, 0.8)
    return by_type if level == "resolved" else round(min(LEVEL_PRIOR.get(level, 0.8), by_type), 4)


def brute(nodes, edges, target, depth, limit, fanout, most):
    around = defaultdict(list)
    for s, d, t, c in edges:
        around[d].append((FOLLOW.index(t), s, "upstream", t, c))
        around[s].append((FOLLOW.index(t), d, "downstream", t, c))
    paths, queue = defaultdict(list), deque([(target, (target,), 1.0)])
    while queue:
        at, seen, p = queue.popleft()
        n = len(seen) - 1
        if n >= depth or (n and len(around[at]) >= limit):
            continue
        for _, peer, _, t, c in sorted(around[at])[:fanout]:
            if peer in seen or (t not in ACROSS and at.split(":")[0] != peer.split(":")[0]):
                continue
            q = p * prior(t, c)
            paths[peer].append((n + 1, round(min(0.99, q * math.exp(-0.25 * n)), 6)))
            if c not in ("external", "unresolved") and len(paths[peer]) <= most:
                queue.append((peer, (*seen, peer), q))
    out = {}
    for k, v in paths.items():
        unseen = math.prod(1 - p for _, p in v)
        out[k] = (min(h for h, _ in v), len(v), min(0.99, 1 - unseen))
    return out


@pytest.fixture(scope="module")
def graph(spark):
    ids = [f"{'py' if i % 4 else 'sql'}:m{i % 3}::n{i}" for i in range(24)]
    kinds, levels = ["CALLS", "WRITES", "IMPORTS", "INHERITS"], ["resolved", "ambiguous", "unresolved", "external"]
    edges = [(ids[i], ids[(i * 7 + k * 5 + 3) % 24], kinds[(i + k) % 4], levels[(i * k) % 4]) for i in range(24) for k in range(3)]
    n = spark.createDataFrame([(i, "function", f"{i}.py") for i in ids], "id string, kind string, file string")
    return ids, edges, n, spark.createDataFrame(edges, "src string, dst string, type string, confidence string")


@pytest.mark.parametrize(("depth", "limit", "fanout", "most"), [(2, 40, 24, 3), (4, 40, 24, 3), (3, 6, 4, 2), (3, 5, 2, 1)])
def test_blast_radius(graph, depth, limit, fanout, most):
    ids, edges, n, e = graph
    got = {r.id: (r.distance, r.n_paths, r.confidence) for r in tr.blast_radius(n, e, ids[1], depth, degree_limit=limit, fanout=fanout, paths=most).collect()}
    want = brute(ids, edges, ids[1], depth, limit, fanout, most)
    assert got.keys() == want.keys()
    for k in got:
        assert got[k][:2] == want[k][:2]
        assert got[k][2] == pytest.approx(want[k][2], abs=2e-6)


def test_missing_target_and_rules(graph):
    ids, _, n, e = graph
    assert tr.blast_radius(n, e, "py:none::x", 2).count() == 0
    found = tr.blast_radius(n, e, ids[1], 2, rules=[ids[2].split("::")[1], "m"]).collect()
    assert {r.category for r in found if r.id == ids[2]} <= {"rule"}


def test_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    loops = [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star + loops, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_communities_by_modularity(spark):
    """Planted groups come out; the score is that of the plain formula; nodes without links stay alone."""
    import random

    from weftgraph.plans import communities as cm

    rng = random.Random(3)
    group = {i: i // 12 for i in range(84)}
    links = [(i, j) for i in group for j in group if i < j and rng.random() < (0.7 if group[i] == group[j] else 0.02)]
    df = spark.createDataFrame(links + [(b, a) for a, b in links[:50]] + [(5, 5)], "src long, dst long")
    found = cm.by_modularity(df, spark.createDataFrame([(500,), (3,)], "id long"))
    got = {r.id: r.community for r in found.collect()}
    assert len(got) == 85 and got[500] == 500 and len({(group[i], got[i]) for i in group}) <= 9 and len({got[i] for i in group}) >= 6
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    want = sum((got[a] == got[b]) / len(links) for a, b in links) - sum((sum(degree[i] for i in group if got[i] == c) / (2 * len(links))) ** 2 for c in set(got.values()))
    assert cm.modularity(found, df).first().modularity == pytest.approx(want, abs=1e-6) and want > 0.7
    assert {r.id: r.community for r in cm.by_modularity(df, spark.createDataFrame([(500,), (3,)], "id long")).collect()} == got
    assert cm.by_modularity(df.limit(0)).count() == 0


def test_cycles(spark):
    links = [(1, 2), (2, 1), (2, 3), (3, 1), (4, 5), (5, 5), (6, 1)]
    got = {tuple(r.cycle) for r in tr.cycles(spark.createDataFrame(links, "src long, dst long"), 4).collect()}
    assert got == {(1, 2, 1), (1, 2, 3, 1)}
