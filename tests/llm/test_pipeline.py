"""The pipeline's stages against their contract."""

import collections

import corpus_pipeline as cp
from weftgraph.llm import pii, simhash


def test_stages(spark, sf, docs):
    now, seen = docs, {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = out.collect()
        seen[name] = rows
        now = spark.createDataFrame(rows, docs.schema)
    assert set(r.doc_id for r in seen["toxicity"]) <= set(r.doc_id for r in docs.collect()) and len(seen["toxicity"]) > 0.8 * docs.count()
    near = simhash.near_duplicates(spark.createDataFrame(seen["toxicity"], docs.schema)).collect()
    assert sorted(r.doc_id for r in seen["simhash_near_dedup"]) == sorted({r.component_id for r in near})
    assert len(seen["pii"]) == len(seen["simhash_near_dedup"]) and all(r.n_chars == len(r.text) for r in seen["pii"])
    assert pii.report(spark.createDataFrame(seen["pii"], docs.schema)).where("spans <> ''").count() == 0
    n = collections.Counter(r.doc_id for r in seen["mixing"])
    assert set(n.values()) <= {1, 2} and set(n) <= {r.doc_id for r in seen["pii"]}
    pieces = cp.STAGES[-1][1](spark, now, sf)
    assert pieces.agg({"length": "sum"}).first()[0] > 0


def test_run_and_hard_rows(spark, sf, hard, empty):
    assert cp.run(spark, sf).where("length <= 0").count() == 0
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, hard, sf)
        assert out.columns == hard.columns and out.dtypes == hard.dtypes, name
        got[name] = [(r.doc_id, r.text) for r in out.collect()]
        assert stage(spark, empty, sf).count() == 0, name
    kept = collections.Counter(got["toxicity"])
    assert all(kept[r] in (0, n) for r, n in collections.Counter(rows).items()) and (1, "") in kept and (2, None) in kept
    reps = got["simhash_near_dedup"]
    assert len(set(reps)) == len(reps) and set(reps) <= set(rows) and not {(1, ""), (2, None)} <= set(reps)
    assert len(got["pii"]) == len(rows) and (2, None) in got["pii"] and (1, "") in got["pii"] and not any("a.b@c.de" in (t or "") for _, t in got["pii"])
    assert all(n <= 2 * collections.Counter(rows)[r] for r, n in collections.Counter(got["mixing"]).items())
    pack = cp.STAGES[-1][1]
    pieces = pack(spark, hard, sf)
    assert pieces.where("start = 0").count() == len(rows) and pack(spark, empty, sf).count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in pieces.where("start = 0").collect()) == sorted((i is None, i or 0) for i, _ in rows)
