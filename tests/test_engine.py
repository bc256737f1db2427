"""The engine on a small graph, task resolution, packs and synchronization."""

import pytest

from weftgraph.engine import GraphEngine
from weftgraph.operators import task
from weftgraph.streaming import events, sync


@pytest.fixture(scope="module")
def engine(spark):
    nodes = [
        ("py:pay/retry.py::PaymentService.retry_payment", "method", "def retry_payment(self)", "pay/retry.py", 1, 9, 4), ("py:pay/retry.py::PaymentService", "class", "class PaymentService", "pay/retry.py", 1, 30, 1),
        ("py:ship/box.py::pack_box", "function", "def pack_box(x)", "ship/box.py", 3, 5, 2), ("sql:db/s.sql::payments", "sql_table", "CREATE TABLE payments", "db/s.sql", 1, 2, 1), ("yaml:docker-compose.yml::payment.retry", "yaml_config", "payment.retry = 3", "docker-compose.yml", 1, 1, 1),
    ]
    edges = [(nodes[0][0], nodes[1][0], "DEFINED_IN", "resolved"), (nodes[0][0], nodes[3][0], "WRITES", "resolved"), (nodes[2][0], nodes[0][0], "CALLS", "ambiguous"), (nodes[1][0], nodes[2][0], "IMPORTS", "resolved"), (nodes[2][0], nodes[1][0], "IMPORTS", "resolved")]
    commits = [("a", 0.0, ["x.py", "y.py"]), ("b", 86400.0, ["x.py", "y.py"]), ("c", 86400.0, ["x.py", "z.py"])]
    return GraphEngine(
        spark.createDataFrame(nodes, "id string, kind string, sig string, file string, start_line int, end_line int, complexity int"), spark.createDataFrame(edges, "src string, dst string, type string, confidence string"),
        spark.createDataFrame(commits, "hash string, ts double, files array<string>"),
    )


def test_intent():
    i = task.intent("Fix `PaymentService.retry` so payment retry waits 30 s on /api/pay/{id}; do not modify ship/box.py")
    assert i.exclusions == ["ship/box.py"] and "PaymentService.retry" in i.identifiers and i.values == ["30"] and "/api/pay/{id}" in i.api_paths
    assert ("payment", "retry") in i.pairs and i.verbs[0] == "fix" and not i.infrastructure
    assert task.intent("create a new docker deploy").creates and task.intent("docker compose").infrastructure


def test_resolve_task(engine):
    got = [r.id for r in engine.resolve("retry a failed payment in PaymentService").collect()]
    assert got[0].startswith("py:pay/retry.py::PaymentService") and got.index("yaml:docker-compose.yml::payment.retry") > 1
    assert all("ship/box" not in r.id for r in engine.resolve("pack_box payments, do not change ship/box.py").collect())


def test_queries(engine):
    assert engine.lookup("retry_payment").first().id.endswith("retry_payment") and engine.search("zzz").count() == 0
    assert engine.neighbors("py:pay/retry.py::PaymentService.retry_payment").count() == 3
    assert engine.impact("sql:db/s.sql::payments", 2).count() == 2
    assert {r.role for r in engine.data_trace("payments").collect()} == {"writer"}
    assert [(r.file_b, r.co_commit_count) for r in engine.co_changes("x.py").collect()] == [("y.py", 2)]
    assert [r.cycle for r in engine.cycles(3).collect()] == [["pay/retry.py", "ship/box.py", "pay/retry.py"]]
    assert engine.components().select("component").distinct().count() == 1 and engine.communities(2).count() == 4
    pack = engine.context_pack(["py:pay/retry.py::PaymentService.retry_payment"], 40).collect()
    assert pack[0].why == "target" and all(r.spent <= 40 for r in pack[1:])
    assert engine.context("retry payment").count() >= 1 and "Most connected" in engine.report()
    said = {r.id: r.story for r in task.stories(engine.nodes, engine.edges).collect()}
    assert "It holds 1 members" in said["py:pay/retry.py::PaymentService"]


def test_watch_and_merge(spark, tmp_path):
    listing = lambda rows: spark.createDataFrame(rows, "path string, mtime long, size long")
    listing([("a", 1, 1), ("b", 1, 1)]).coalesce(1).write.parquet(str(tmp_path / "l"))
    seen = []
    q = sync.watch(spark, str(tmp_path / "l"), listing([("a", 0, 1), ("c", 0, 1)]), lambda df, n: seen.extend((r.path, r.change) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == [("a", "changed"), ("b", "created"), ("c", "deleted")]
    table = str(tmp_path / "t")
    spark.createDataFrame([("n1", "f1"), ("n2", "f2"), ("n3", "f3")], "id string, file string").write.partitionBy("file").parquet(table)
    sync.merge_partition(table, spark.createDataFrame([("m1", "f1")], "id string, file string"), "file", spark.createDataFrame([("f2",)], "file string"))
    assert {(r.id, r.file) for r in spark.read.parquet(table).collect()} == {("m1", "f1"), ("n3", "f3")}


def test_streams_equal_batches(spark, sf, tmp_path):
    path = f"{sf}/events.parquet"
    want = {(r.tool, r.calls) for r in spark.read.parquet(path).groupBy("event_type").count().toDF("tool", "calls").collect()}
    assert {(r.tool, r.calls) for r in events.stream_telemetry(spark, path).select("tool", "calls").collect()} == want
    assert events.sliding(spark.read.parquet(path), "1 hour", "30 minutes").count() > 0 and events.first_sightings(spark.read.parquet(path), "user_id").count() > 0


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    """A stream that is started again compares with the listing before, not with the first."""
    schema, folder, seen = "path string, mtime long, size long", tmp_path / "listings", []
    listing = lambda rows: spark.createDataFrame(rows, schema).coalesce(1)
    note = lambda changes, number: seen.append((number, {r.path: r.change for r in changes.collect()}))
    start = lambda: sync.watch(spark, str(folder), listing([]), note, str(tmp_path / "checkpoint")).awaitTermination()
    listing([("a", 1, 1), ("b", 1, 1)]).write.mode("append").parquet(str(folder))
    start()
    listing([("a", 2, 1), ("c", 1, 1)]).write.mode("append").parquet(str(folder))
    start()
    listing([("a", 2, 1)]).write.mode("append").parquet(str(folder))
    start()
    assert seen == [(0, {"a": "created", "b": "created"}), (1, {"a": "changed", "b": "deleted", "c": "created"}), (2, {"c": "deleted"})]
