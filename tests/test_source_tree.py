"""A small source tree: scan, parse, resolve, store."""

import hashlib

import pytest

from weftgraph.lang import parse_files
from weftgraph.lang.dispatch import parse
from weftgraph.plans.resolve import resolve, update_files
from weftgraph.sources import files as fs
from weftgraph.sources import store
from weftgraph.sources.tables import written

TREE = {
    "app/shop/cart.py": '"""Carts."""\nimport os\nfrom .price import total, Price\nfrom app.util import log\n\nLIMIT = 3\n\nclass Cart(Price):\n    def __init__(self):\n        self.items = []\n\n    def add(self, x):\n        if x and self.items or x > 1:\n            raise ValueError(x)\n        self.items.append(x)\n        return total(self.items)\n\n    def save(self):\n        os.getenv("SHOP_DB")\n        q = "INSERT INTO carts SELECT id FROM items"\n        return log(q)\n',
    "app/shop/price.py": "class Price:\n    pass\n\ndef total(xs):\n    return sum(xs)\n",
    "app/util.py": "def log(s):\n    print(s)\n",
    "app/__init__.py": "",
    "app/broken.py": "def ok(:\n    pass\nclass K:\n    def m(self):\n",
    "db/schema.sql": "CREATE TABLE carts (id INT, n INT);\n-- rows; of carts\nCREATE TABLE items (id INT, PRIMARY KEY (id));\nSELECT c.id FROM carts c JOIN items i ON c.id = i.id;\nDELETE FROM items WHERE id = ';';\n",
    "run.sh": "#!/bin/bash\nexport SHOP_DB=x\npython app/util.py $HOME | tee out\n",
    "conf/app.yaml": "jobs:\n  nightly: run.sh\n  limits: [1, 2]\n",
    "conf/app.json": '{"a": {"b": 1}, "c": []}',
    "web/api.ts": "import { x } from './lib';\nexport interface Shape extends Base { a: number }\nexport class Box extends Shape implements Shape {\n  open(k) { if (k) { return x(k); } }\n}\nexport const go = async (id) => { return fetch('/api/users/1'); };\n",
    "web/lib.ts": "export function x(a) { return a; }\n",
    "main.go": 'import "fmt"\ntype S struct {\nfunc (s S) Run() {\n',
    ".env": "SECRET=1",
    "node_modules/a/index.js": "x",
    "data.bin": "\x00\x01",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return fs.scan(spark, str(root)).cache()


def test_scan(tree):
    got = {r.path: r for r in tree.collect()}
    assert "node_modules/a/index.js" not in got and got[".env"].status == "sensitive" and got["data.bin"].status == "binary"
    body = TREE["app/util.py"].encode()
    assert got["app/util.py"].sha256 == hashlib.sha256(body).hexdigest()
    assert got["app/util.py"].blob_sha == hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()
    assert (got["run.sh"].kind, got["main.go"].kind, got["conf/app.yaml"].kind) == ("shell", "go", "yaml")


def test_ignore_rules(spark):
    df = spark.createDataFrame([(p,) for p in ("a/b.py", "a/b.pyc", "gen/x.py", "yarn.lock", "x/gen/y.py")], "path string")
    assert {r.path for r in df.where(~fs.ignored(df.path, ["# note", "gen/"])).collect()} == {"a/b.py"}


def test_parse_and_resolve(spark, tree):
    nodes, edges, errors = parse_files(tree)
    assert errors.count() == 0
    kinds = {r.id: r for r in nodes.collect()}
    assert kinds["py:app/shop/cart.py::Cart.add"].complexity == 4 and kinds["py:app/shop/cart.py::Cart.add"].kind == "method"
    assert kinds["py:app/shop/cart.py::<module>"].story == "Carts." and kinds["sql:db/schema.sql::carts"].params == ["id", "n"]
    assert {"py:app/broken.py::ok", "py:app/broken.py::K.m", "ts:web/api.ts::Box.open", "ts:web/api.ts::go", "go:main.go::S", "go:main.go::Run", "json:conf/app.json::a.b", "yaml:conf/app.yaml::jobs.limits[1]"} <= set(kinds)
    done, outside = resolve(nodes.select("id", "kind", "file"), edges)
    got = {(r.src, r.dst, r.type, r.confidence) for r in done.collect()}
    cart, price = "py:app/shop/cart.py::", "py:app/shop/price.py::"
    for edge in [
        (cart + "Cart", price + "Price", "INHERITS", "resolved"), (cart + "Cart.add", price + "total", "CALLS", "resolved"), (cart + "Cart.save", "py:app/util.py::log", "CALLS", "resolved"),
        (cart + "<module>", "ext:py:stdlib:os", "IMPORTS", "external"), (cart + "Cart.save.sql_20", "sql:db/schema.sql::carts", "WRITES", "resolved"), (cart + "Cart.save.sql_20", "sql:db/schema.sql::items", "READS", "resolved"),
        (cart + "Cart.add", cart + "Cart.items", "READS", "resolved"), (price + "total", "ext:py:builtin:sum", "CALLS", "external"), ("ts:web/api.ts::<module>", "ts:web/lib.ts::<module>", "IMPORTS", "resolved"),
        ("ts:web/api.ts::Box.open", "ts:web/lib.ts::x", "CALLS", "resolved"), ("ts:web/api.ts::Box", "ts:web/api.ts::Shape", "IMPLEMENTS", "resolved"), ("yaml:conf/app.yaml::jobs.nightly", "sh:run.sh::<script>", "RUNS_SCRIPT", "resolved"),
        ("sh:run.sh::cmd_3_0", "py:app/util.py::<module>", "RUNS_SCRIPT", "resolved"), ("sql:db/schema.sql::query_2", "sql:db/schema.sql::items", "WRITES", "resolved"),
    ]:
        assert edge in got, edge
    assert done.count() == edges.count()
    ids = {r.id for r in outside.collect()}
    assert "ext:py:stdlib:os" in ids and all(i.startswith("ext:") for i in ids)


def test_update_keeps_callers(spark, tree):
    nodes, raw, _ = parse_files(tree)
    new = spark.createDataFrame([("app/util.py", "python", "def log(s, t):\n    pass\n")], "path string, kind string, text string")
    new_nodes, new_raw, _ = parse_files(new)
    _, _, done = update_files(nodes, None, raw, spark.createDataFrame([("app/util.py",)], "file string"), new_nodes, new_raw)
    assert done.where("dst = 'py:app/util.py::log' and src like '%Cart.save'").count() == 1
    # from the edges as they were resolved before: the same edges, and few of them anew
    nodes, raw = written(nodes, "n")[0], written(raw, "r")[0]
    before, outside = (written(df, "o")[0] for df in resolve(nodes.select("id", "kind", "file"), raw))
    had = written(nodes.unionByName(outside, allowMissingColumns=True), "h")[0]
    n, _, short = update_files(had, before, raw, spark.createDataFrame([("app/util.py",)], "file string"), new_nodes, new_raw)
    rows = lambda df: sorted((r.src, r.dst, r.type, r.confidence, r.start_line) for r in df.collect())
    assert rows(short) == rows(done)
    renamed = spark.createDataFrame([("app/util.py", "python", "def note(s):\n    pass\n")], "path string, kind string, text string")
    rn, rr, _ = parse_files(renamed)
    whole = update_files(had, None, raw, spark.createDataFrame([("app/util.py",)], "file string"), rn, rr)
    short = update_files(had, before, raw, spark.createDataFrame([("app/util.py",)], "file string"), rn, rr)
    assert rows(short[2]) == rows(whole[2]) and sorted(r.id for r in short[0].collect()) == sorted(r.id for r in whole[0].collect())


def test_errors_are_rows(spark):
    bad = spark.createDataFrame([("x.json", "json", "{"), ("y.yaml", "yaml", "a: [1"), ("z.py", "python", None)], "path string, kind string, text string")
    nodes, _, errors = parse_files(bad)
    assert nodes.count() == 0 and {r.path for r in errors.collect()} == {"x.json", "y.yaml"}
    assert len(parse('{"k": [' + ",".join("1" for _ in range(100)) + "]}", "big.json", "json").nodes) == 1


def test_store(spark, tree, tmp_path):
    nodes, raw, _ = parse_files(tree)
    edges, _ = resolve(nodes.select("id", "kind", "file"), raw)
    path = str(tmp_path / "graph")
    store.save(nodes, edges, path)
    n, e = store.load(spark, path)
    assert n.count() == nodes.count() and e.count() == edges.count()
    assert {r.digest for r in store.manifest(n, e).collect()} == {r.digest for r in spark.read.parquet(path + "/manifest").collect()}
    assert store.load_file(spark, path, "app/util.py").count() == 2
    some = e.first()
    assert store.load_node(spark, path, "py:app/util.py::log").count() == 1 and store.edges_of(spark, path, src=some.src, kind=some.type).where("src <> dst").count() >= 1
    store.save_lenses(n, e, path)
    assert {r.type for r in store.load_lens(spark, path, "call")[1].collect()} <= {"CALLS"}
    with pytest.raises(FileNotFoundError):
        store.load_file(spark, path, "none.py")
    links = {r.name: r.links for r in store.read_notes(store.notes(n, e)).collect()}
    assert any("Price" in x for x in links["py_app_shop_cart.py_Cart"])
    store.graphml(n, e, str(tmp_path / "g"))
    import xml.etree.ElementTree as ET

    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    assert len(ET.fromstring(text)[2]) == n.count() + e.count()


def test_git_log(spark):
    lines = ["COMMIT:a1|100", "", "x.py", "y.py", "COMMIT:b2|50", "COMMIT:c3|70", "x.py"]
    got = {r.hash: (r.ts, r.files) for r in fs.git_log(spark.createDataFrame(list(enumerate(lines)), "n long, line string")).collect()}
    assert got == {"a1": (100.0, ["x.py", "y.py"]), "c3": (70.0, ["x.py"])}


def ends(found, kind):
    return {(e["src"].split("::")[-1], e["dst"].split("::")[-1]) for e in found.edges if e["type"] == kind}


def test_python_nested_functions_and_aliases():
    text = "class A:\n    def run(self):\n        def inner():\n            deep()\n        box = Box()\n        box.open()\n        go = self.stop\n        go()\n        return inner()\n"
    found = parse(text, "a.py", "python")
    calls = ends(found, "CALLS")
    assert ("A.run.inner", "deep") in calls and ("A.run", "deep") not in calls and ("A.run", "Box.open") in calls and ("A.run", "A.stop") in calls
    assert {n["id"].split("::")[-1]: n["calls"] for n in found.nodes}["A.run.inner"] == 1


def test_declared_routes():
    text = "urlpatterns = [\n    path('users/<int:pk>/', UserView.as_view()),\n    re_path(r'^old/', views.old),\n    path('api/', include('api.urls')),\n]\nrouter.register('boxes', BoxSet)\n\ndef old(r):\n    pass\n\nclass UserView:\n    pass\n\nclass BoxSet:\n    pass\n"
    reads = {n["id"].split("::")[-1]: n["reads"] for n in parse(text, "urls.py", "python").nodes}
    assert reads["UserView"] == ["ROUTE:ANY:/users/<int:pk>/"] and reads["old"] == ["ROUTE:ANY:/old/"] and reads["BoxSet"] == ["ROUTE:ANY:/boxes"] and reads["<module>"] == ["ROUTE:ANY:/api"]


def test_wrappers_of_http_clients():
    text = "export async function request(url) { return fetch(url); }\nexport const load = async () => { return request('/api/users/7'); }\nexport function save() { return axios.post('/api/users', {}); }\nexport function other() { return request2('/api/x'); }\n"
    reads = {n["id"].split("::")[-1]: n["reads"] for n in parse(text, "a.ts", "typescript").nodes}
    assert reads["request"] == ["HTTP:wrapper"] and reads["load"] == ["HTTP:/api/users/7"] and reads["save"] == ["HTTP:POST:/api/users"] and reads["other"] == []


def test_bridges(spark, tmp_path):
    from weftgraph.engine import GraphEngine

    (tmp_path / "srv.py").write_text("@app.get('/api/users/{id}')\ndef user(id):\n    return id\n\n@app.post('/api/users')\ndef add():\n    pass\n")
    (tmp_path / "web.ts").write_text("export function load() { return fetch('/api/users/7'); }\nexport function save() { return axios.post('/api/users', {}); }\nexport function any(u) { return fetch(`${u}`); }\n")
    engine = GraphEngine.from_tree(spark, str(tmp_path))
    got = {(r.src.split("::")[1], r.dst.split("::")[1], r.confidence) for r in engine.routes().collect()}
    assert got == {("load", "user", "resolved"), ("save", "add", "resolved")}
    assert {(r.src.split("::")[1], r.dst.split("::")[1]) for r in engine.edges.where("type = 'INVOKES'").collect()} == {("load", "user"), ("save", "add")}


@pytest.mark.parametrize(
    ("lang", "text", "bases", "calls", "last"),
    [
        ("java", "public class Box extends Base implements A, B<C> {\n    public int open(int k) {\n        return helper(k) + this.size();\n    }\n}\n", {"Base", "A", "B"}, {"helper", "this.size"}, {"Box": 5, "open": 4}),
        ("kotlin", "class Box(val x: Int) : Base(), Shape {\n    fun open(): Int {\n        return helper()\n    }\n}\n", {"Base", "Shape"}, {"helper"}, {"Box": 5, "open": 4}),
        ("ruby", "class Box < Base\n  def open(k)\n    helper(k)\n  end\nend\n", {"Base"}, {"helper"}, {"Box": 5, "open": 4}),
        ("go", "type S struct {\n\tn int\n}\n\nfunc (s S) Run() {\n\tfmt.Println(go1(s.n))\n}\n", set(), {"fmt.Println", "go1"}, {"S": 3, "Run": 7}),
        ("rust", "pub struct S {\n    n: u32,\n}\n\npub fn run(n: u32) -> u32 {\n    // skip(me)\n    std::cmp::max(n, two())\n}\n", set(), {"std.cmp.max", "two"}, {"S": 3, "run": 8}),
        ("lua", "local function run(k)\n  return helper(k)\nend\n", set(), {"helper"}, {"run": 3}),
        ("php", "class Box extends Base implements A {\n    public function open($k) {\n        return helper($k);\n    }\n}\n", {"Base", "A"}, {"helper"}, {"Box": 5, "open": 4}),
        ("csharp", "class Box : Base, IShape\n{\n    public int Open(int k) {\n        return Helper(k);\n    }\n}\n", {"Base", "IShape"}, {"Helper"}, {"Box": 6, "Open": 5}),
    ],
)
def test_other_languages(lang, text, bases, calls, last):
    found = parse(text, f"a.{lang}", lang)
    assert {b for _, b in ends(found, "INHERITS")} == bases and {b for _, b in ends(found, "CALLS")} == calls
    assert {n["id"].split("::")[-1]: n["end_line"] for n in found.nodes if n["kind"] != "file"} == last


def test_sql_changes_of_tables():
    found = parse("ALTER TABLE carts ADD n INT;\nCREATE UNIQUE INDEX i ON items (id);\nCREATE TABLE lines (c INT REFERENCES carts(id));\nCREATE VIEW v AS SELECT * FROM items;\n", "a.sql", "sql")
    assert ends(found, "WRITES") == {("query_1", "carts"), ("query_2", "items")} and ends(found, "READS") == {("lines", "carts"), ("v", "items")}
