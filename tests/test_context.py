"""Task intents, scores, context, evaluation, sources and the command line on small inputs."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from weftgraph import cli
from weftgraph.engine import GraphEngine
from weftgraph.functions import text as tx
from weftgraph.operators import context as c
from weftgraph.operators import enrich as en
from weftgraph.operators import evaluate as ev
from weftgraph.operators import intent as it
from weftgraph.operators import task as t
from weftgraph.plans import lenses
from weftgraph.sources import git, settings

FILES = {
    "shop/cart.py": "from shop import store\n\nclass Cart:\n    def add(self, item):\n        return store.save_item(item)\n\n    def total(self):\n        return 1\n",
    "shop/store.py": "def save_item(item):\n    sql = 'INSERT INTO items VALUES (1)'\n    return sql\n\ndef load_item(key):\n    return key\n",
    "shop/legacy.py": "from shop.store import load_item\n\ndef old_total():\n    return load_item(1)\n",
    "schema.sql": "CREATE TABLE items (id int, name text);\n",
    "docs/cart.md": "# Cart\n\nHow the cart adds items.\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree):
    return GraphEngine.from_tree(spark, str(tree))


def test_report_of_a_tree(engine):
    text = engine.report()
    assert "| py |" in text or "| python |" in text
    assert any("Cart" in q or "links" in q for q in engine.questions())


@pytest.mark.parametrize(
    ("text", "left_out", "rest_has", "rest_lacks"),
    [
        ("Fix Cart.add; do not modify ship/box.py", ["ship/box.py"], "Cart.add", "box"), ("Change totals without touching LegacyStore", ["LegacyStore"], "totals", "Legacy"),
        ("Must not change\nthe totals", [], "totals", "zzz"), ("All files except tests/a.py and b/c.py", ["tests/a.py", "b/c.py"], "All", "tests"), ("avoid the database", ["the database"], "", "database"),
        ("don't include Django", [], "", "Django"), ("do not worry about it", [], "worry", "zzz"),
    ],
)
def test_exclusions(text, left_out, rest_has, rest_lacks):
    found, rest = it.exclusions(text)
    assert (found == left_out or (left_out == [] and all(f.lower() in ("django",) for f in found))) and rest_has in rest and rest_lacks not in rest


def test_search_terms():
    want = it.intent("Fix PaymentService.retry in retry_queue without touching retry_queue")
    assert "PaymentService" in it.search_terms(want) and "retry_queue" not in it.search_terms(want)


def test_resolve_and_explain(engine):
    got = engine.explain("Fix Cart.add so that items are saved").collect()
    assert got[0].id.endswith("Cart.add") and got[0].place == 1 and got[0].entry and "has the name" in got[0].reasons
    left = engine.resolve("Fix the total; do not modify shop/legacy.py").collect()
    assert left and not any("legacy" in r.id for r in left)
    docs = {r.id: r for r in engine.resolve("Fix the cart").collect()}
    assert all(r.kind_score <= 0.1 for i, r in docs.items() if "docs/cart.md" in i)


def test_compile(engine, spark, tree):
    files = spark.createDataFrame(list(FILES.items()), "file string, text string")
    p = engine.compile("Change how Cart.add saves items; do not modify shop/legacy.py", files=files)
    assert p.entries.first().id.endswith("Cart.add") and p.tokens <= 1500 and "Cart.add" in p.text and p.raw_tokens >= 2000 and 0 <= p.reduction_pct <= 100
    assert not any("legacy" in (r.file or "") for r in p.files.collect()) and p.files.count() <= 4
    steps = p.plan.collect()
    assert [s.step for s in steps] == list(range(1, len(steps) + 1)) and steps[0].phase == "pre_check" and steps[-1].phase == "post_check"
    assert any(s.phase == "modification" and s.target.endswith("Cart.add") for s in steps) and p.risk in ("LOW", "MEDIUM", "HIGH")
    made = engine.compile("Create a new exporter like Cart and register it")
    assert [s.phase for s in made.plan.collect()][1] == "scaffold"
    again = engine.compile("Change how Cart.add saves items; do not modify shop/legacy.py", files=files)
    assert again.text == p.text and ev.same_results(engine.kinds, 2)


def test_backstop_keeps_schema_files(spark):
    scores = spark.createDataFrame([(1, "a.py", 10.0), (1, "b.py", 9.0), (1, "c.py", 8.0), (1, "d.py", 7.0), (2, "a.py", 10.0)], "task int, file string, file_score double")
    must = spark.createDataFrame([(1, "s.sql", 2), (1, "r.sql", 1), (2, "a.py", 1)], "task int, file string, weight int")
    got = sorted((r.task, r.file) for r in c.keep_files(scores, must).collect())
    assert got == [(1, "a.py"), (1, "b.py"), (1, "c.py"), (1, "s.sql"), (2, "a.py")]


def test_render_stages(spark):
    cards = spark.createDataFrame([(1, 1, "x", "function", "a.py:1-2", "def x()", "It works. " + "More words. " * 20, "complexity=1", "line\n" * 60), (1, 2, "y", "class", None, None, None, None, None)], "task int, place int, id string, kind string, at string, sig string, story string, facts string, snippet string")
    links = spark.createDataFrame([(1, i, "x", f"y{i}", "CALLS") for i in range(1, 12)], "task int, place int, src string, dst string, type string")
    seen = {}
    for budget in range(5, 400, 5):
        r = c.render(cards, links, budget).first()
        seen.setdefault(r.stage, r)
        assert r.tokens <= budget or (r.stage == 4 and len(r.text.split("\n")) <= 5)
    assert set(seen) == {0, 1, 2, 3, 4} and "```" in seen[0].text and "```" not in seen[1].text and "complexity" not in seen[2].text and seen[3].text.count("->") == 3 and seen[2].text.count("->") == 11
    assert c.render(cards.limit(0), links, 10).count() == 0


def test_text_rules(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('x ```json\n{"a": 1}\n``` y',), ('so {"a": {"b": 2}} ok',), ("[1]",), ("{no json}",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(tx.json_object(F.col("s"))).collect()] == ['{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', None, None, None, None]
    urls = spark.createDataFrame([("",), ("url",), ("${API}/path",), ("/:id/7",), ("/api/x",), (None,)], "s string")
    assert [r[0] for r in urls.select(tx.template_only(F.col("s"))).collect()] == [True, True, True, True, False, True]
    names = spark.createDataFrame([("a.py::B.c", "C"), ("a.py::B.c", "b.C"), ("a.py::Bc", "c"), ("x", " X ")], "a string, b string")
    assert [r[0] for r in names.select(tx.symbols_match(F.col("a"), F.col("b"))).collect()] == [True, True, False, True]
    assert [r[0] for r in spark.createDataFrame([("Ab c!",), ("!!",)], "s string").select(tx.slug(F.col("s"))).collect()][0] == "ab-c"


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, "py:a.py::X.f", 1), (2, "py:a.py::X.f", 1), (2, "py:a.py::Y.g", 7), (3, "py:b.py::Z", 1)], "task int, id string, rank int")
    gold = spark.createDataFrame([(1, "X.f"), (2, "Y.g"), (3, "nothing"), (4, "gone")], "task int, symbol string")
    terms = spark.createDataFrame([(3, "noth"), (4, "else")], "task int, term string")
    m = ev.retrieval_metrics(ranked, gold).first()
    assert (m.tasks, m.recall_1, m.recall_5, m.recall_10, m.candidates_100, m.mrr) == (4, 0.25, 0.25, 0.5, 0.5, round((1 + 1 / 7) / 4, 4))
    assert {r.task: r.category for r in ev.triage(ranked, gold, terms).collect()} == {2: "RANKING_ERROR", 3: "IDENTIFIER_MISS", 4: "LEXICAL_MISS"}
    runs = {r.run: r.recall_1 for r in ev.compare({"all": ranked, "none": ranked.limit(0)}, gold).collect()}
    assert runs == {"all": 0.25, "none": 0.0} and "| run |" in ev.markdown(ev.compare({"all": ranked}, gold).select("run"), "Runs")
    included = spark.createDataFrame([(1, "symbol", "py:a.py::X.f"), (1, "symbol", "py:a.py::W"), (1, "file", "src/a.py")], "task int, what string, item string")
    want = spark.createDataFrame([(1, "symbol", "X.f"), (1, "symbol", "Q"), (1, "file", "a.py"), (1, "test", "t.py"), (1, "excluded", "W")], "task int, what string, item string")
    r = ev.context_metrics(included, want, spark.createDataFrame([(1, 100, 400)], "task int, tokens int, raw_tokens int")).first()
    assert (r.symbol_recall, r.file_recall, r.test_recall, r.false_inclusion, r.precision, r.reduction_pct) == (0.5, 1.0, 0.0, 1.0, 0.5, 75.0)


def test_tiers(spark):
    rows = [("a", "function", 1, 0, "h1"), ("b", "function", 9, 2, "h2"), ("c", "method", 8, 2, "h3"), ("d", "class", 7, 0, "h4"), ("e", "file", 1, 0, "h5")]
    n = spark.createDataFrame(rows, "id string, kind string, complexity int, calls int, content_hash string").withColumns({"reads": F.array().cast("array<string>"), "writes": F.lit(None).cast("array<string>")})
    cache = spark.createDataFrame([("h2",)], "h string").select(F.sha2(F.concat_ws(":", "h", F.lit("fast"), F.lit("1")), 256).alias("key"))
    assert {r.id: r.tier for r in en.tiers(n, cache, allowed=1).collect()} == {"a": "trivial", "b": "cache", "c": "model", "d": "template", "e": "trivial"}
    assert {r.tier for r in en.tiers(n, cache, room=0).collect()} == {"trivial", "cache", "template"}


def test_git(spark, tmp_path):
    assert not git.provenance(spark, str(tmp_path)).first().is_git and git.log(spark, str(tmp_path)).count() == 0
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("1")
    run("add", ".")
    run("commit", "-qm", "one")
    run("commit", "-qm", "empty", "--allow-empty")
    (tmp_path / "b.txt").write_text("2")
    p = git.provenance(spark, str(tmp_path)).first()
    assert p.is_git and p.dirty and len(p.commit) == 40
    assert [r.files for r in git.log(spark, str(tmp_path)).collect()] == [["a.txt"]]
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, blob_sha string")
    assert {r.path: r.same for r in git.unchanged(now, spark.createDataFrame([("a", "1"), ("b", "9")], "path string, blob_sha string")).collect()} == {"a": True, "b": False, "c": False}


def test_settings_and_tasks(spark, tmp_path):
    path = str(tmp_path / "s.json")
    settings.save_settings(settings.load_settings(path) | {"budget": 7}, path)
    assert settings.load_settings(path)["budget"] == 7
    (tmp_path / "bad.json").write_text('{"no": 1}')
    with pytest.raises(ValueError, match="unknown"):
        settings.load_settings(str(tmp_path / "bad.json"))
    (tmp_path / "t.yaml").write_text("tasks:\n- id: a\n  task: do it\n  gold: {symbols: [X.f], excluded: null}\n")
    row = settings.load_tasks(spark, str(tmp_path / "t.yaml")).first()
    assert (row.id, row.symbols, row.excluded) == ("a", ["X.f"], [])
    (tmp_path / "t.json").write_text(json.dumps([{"id": "a", "task": "x"}, {"id": "a", "task": "", "gold": {"files": ["f"]}}]))
    with pytest.raises(ValueError, match="id a occurs twice"):
        settings.load_tasks(spark, str(tmp_path / "t.json"))


def test_federated(spark, engine):
    both = GraphEngine.federated({"one": engine, "two": engine})
    inner = engine.nodes.where("not id like 'ext:%'")
    assert both.nodes.where("not id like 'ext:%'").select("id").distinct().count() == 2 * inner.count() and both.edges.count() == 2 * engine.edges.count()
    n, _ = lenses.rooted(engine.nodes, engine.edges, "r")
    assert n.where("file = 'r/shop/cart.py'").count() > 0


def test_command_line(spark, tree, tmp_path, capsys):
    path = str(tmp_path / "g")
    cli.main(["--tree", str(tree), "save", path], spark)
    assert "Cart" in cli.main(["--graph", path, "--format", "json", "lookup", "Cart"], spark)
    assert "# Context pack" in cli.main(["--graph", path, "context", "Fix Cart.add"], spark)
    with pytest.raises(SystemExit):
        cli.main(["--graph", path, "lookup"], spark)
    capsys.readouterr()


def test_rules_name_what_they_change(spark):
    names = [r.name for r in t.rules(it.intent("Fix cart_total"))]
    assert names == ["configuration", "prose", "file of that name", "outside"] and "page" in [r.name for r in t.rules(it.intent("Fix login"), client_side=True)]
