"""Co-change mining against plain Python."""

from collections import Counter

from weftgraph.operators import temporal as tm


def test_pairs_in_bounded_tasks(spark, monkeypatch):
    """Pairs are made where their commit is, by as many tasks as their number needs; a repeated hash meets itself."""
    monkeypatch.setattr(tm, "PAIRS_A_TASK", 50, raising=False)
    rows = [(f"c{i % 40}", 86400.0 * i, [f"f{(i * k) % 13}" for k in range(1, 2 + i % 6)]) for i in range(60)] + [("big", 0.0, [f"f{k}" for k in range(51)])]
    items = tm.touched(spark.createDataFrame(rows, "hash string, ts double, files array<string>"))
    by_hash = {}
    for h, _, files in rows:
        if 2 <= len(files) <= 50:
            by_hash.setdefault(h, []).extend(set(files))
    want = Counter((a, b) for files in by_hash.values() for a in files for b in files if a != b)
    assert {(r.file_a, r.file_b): r.n for r in tm.pairs(items).collect()} == want
    assert items.rdd.getNumPartitions() >= sum(len(f) ** 2 - len(f) for f in (set(f) for _, _, f in rows if 2 <= len(f) <= 50)) / 50
