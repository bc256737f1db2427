"""Every registered query against its DuckDB counterpart on the smallest tables."""

import math

import duckdb
import pytest

from weftgraph import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return "[" + ",".join(map(same, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(same(r[c]) for c in cols) for r in df.collect())
    want = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(same(r[names.index(c)]) for c in cols) for r in want.fetchall())


def run(spark, sf, name):
    return catalog.queries()[name](spark, sf).collect()


def test_every_query_without_sql_has_a_test():
    tested = {"connected_components", "blast_radius", "blast_summary", "identifier_variants", "explain_task", "context_package", "suggested_questions", "task_intents", "modularity_communities"}
    assert set(catalog.queries()) - set(catalog.oracles()) == tested


def test_connected_components(spark, sf, duck):
    links = duck.execute("select distinct o_custkey, -1 - l_suppkey from orders join lineitem on o_orderkey = l_orderkey").fetchall()
    parent = {k: k for link in links for k in link}

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {r.node: r.component for r in run(spark, sf, "connected_components")} == {k: root(k) for k in parent}


def test_blast_radius(spark, sf):
    """Guards at their defaults over the whole views, and the summary's counts from its rows."""
    from test_traverse import brute

    from weftgraph.plans import traverse as tr
    from weftgraph.sources.graph_views import edges, nodes

    n, e = nodes(spark, sf), edges(spark, sf)
    target = min(r.id for r in n.where("kind = 'method'").select("id").collect())
    want = brute([], [tuple(r) for r in e.select("src", "dst", "type", "confidence").collect()], target, 5, 40, 24, 3)
    got = {r.id: (r.distance, r.n_paths, r.confidence) for r in run(spark, sf, "blast_radius")}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=2e-6) for k in got)
    rows = tr.blast_radius(n, e, target, rules=["supply/"], degree_limit=None, max_depth=3).collect()
    hit = [r for r in rows if r.category in ("direct", "indirect")]
    s = run(spark, sf, "blast_summary")[0]
    assert (s.direct_count + s.indirect_count, s.excluded_count, s.affected_tables) == (len(hit), len(rows) - len(hit), len([r for r in hit if r.kind == "sql_table"]))
    assert s.max_distance == max(r.distance for r in hit) and s.affected_files == len({r.file for r in hit}) and s.mean_confidence == pytest.approx(sum(r.confidence for r in hit) / len(hit), abs=1e-4)
    assert all(r.category == "rule" for r in rows if r.id.startswith("sql:supply/"))


def test_modularity_communities(spark, sf):
    """All nations, in communities whose modularity is no lower than that of the regions or of label propagation."""
    from weftgraph.catalog.traversal import _members, trade
    from weftgraph.plans import communities as cm

    links, found = trade(spark, sf), catalog.queries()["modularity_communities"](spark, sf)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in _members(spark, sf).collect())
    q = lambda m: cm.modularity(m, links).first().modularity
    assert q(found) >= max(q(_members(spark, sf)), q(catalog.queries()["label_propagation"](spark, sf))) - 1e-9


def test_identifier_variants(spark, sf):
    from pyspark.sql import functions as F

    from weftgraph.functions.text import stem

    rows = run(spark, sf, "identifier_variants")
    words = sorted({w for r in rows for w in r.p_name.split()})
    stems = dict(spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w"))).collect())
    for r in rows:
        parts, name = r.p_name.split(), r.p_name.title()
        assert r.variants == list(dict.fromkeys([name, name.lower(), *(sep.join(parts) for sep in ("_", "-", ".", "")), *parts, *(stems[p] for p in parts)]))


def test_tasks(spark, sf):
    first = run(spark, sf, "explain_task")
    assert [r.place for r in first] == [1, 2, 3, 4, 5] and [r.entry for r in first] == [True] * 3 + [False] * 2 and [r.score for r in first] == sorted((r.score for r in first), reverse=True)
    assert all("widget" in r.id or "Customer#000000007" in r.id for r in first)
    pack = run(spark, sf, "context_package")
    assert pack and all(r.risk in ("LOW", "MEDIUM", "HIGH") and r.tokens <= 400 for r in pack) and not any(r.id.startswith("sql:supply/") for r in pack)
    asked = run(spark, sf, "suggested_questions")
    assert 4 <= len(asked) <= 10 and "links" in asked[0].question
    i = {r.task: r for r in run(spark, sf, "task_intents")}
    assert i[0].exclusions == ["ship/box.py"] and i[0].identifiers == ["Cart.add"] and i[1].creates and i[1].infrastructure and i[2].exclusions == ["LegacyStore"] and i[2].identifiers == ["user_id"]


def test_pack_stages_of_odd_texts(spark, duck, tmp_path):
    """Empty texts, texts of white space, vertical tabs and nulls, and empty languages and sources, as in SQL."""
    texts = ["", " ", "\n", "a\x0bb" * 9, " a\x0b b \t", None, "x", *("w\x0bw " * n for n in range(20, 45))]
    rows = [(i, text, lang, source, len(text or "")) for i, (text, lang, source) in enumerate((t, g, s) for t in texts for g, s in (("en", "src0"), ("", "")))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["pack_stages"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.oracles()["pack_stages"]).fetchall())
