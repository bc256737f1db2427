"""Operators against brute-force versions, on the driver's rows and on hard ones."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, lm, media, mixing, packing, pii, quality, queries, simhash, textvec, toxicity, training

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# 1 media


def payload(t):
    raw = t.encode()
    n = max(1, -(-len(raw) // 64)) * 64
    return raw + bytes(n - len(raw))


def test_media(hard, docs, empty):
    for df in (hard, docs):
        got = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media(df).collect())
        want = collections.Counter((i, len(t.encode()), len(payload(t)), hashlib.sha256(payload(t)).hexdigest(), zlib.crc32(payload(t)[-64:])) for i, t in rows_of(df))
        assert got == want
    assert media.media(empty).count() == 0


def test_media_ranges_and_retries(spark, docs, tmp_path):
    folder = str(tmp_path / "a")
    manifest = str(tmp_path / "m")
    media.store(docs.repartition(3), folder, archive_bytes=60_000).write.parquet(manifest)
    got = media.load(spark, folder, manifest, range_bytes=7000, batch_bytes=3000)
    assert got.where("error is null").count() == docs.count() and got.select("archive", "offset").distinct().count() == docs.count()
    name = sorted(p.name for p in (tmp_path / "a").iterdir() if p.suffix == ".zip")[0]
    data = bytearray((tmp_path / "a" / name).read_bytes())
    data[80] ^= 255  # inside the first member
    (tmp_path / "a" / name).write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        media.described(got, strict=True).count()
    spark.read.parquet(manifest).withColumn("members", F.col("members") + 1).write.parquet(str(tmp_path / "m2"))
    with pytest.raises(Exception, match="manifest"):
        media.load(spark, folder, str(tmp_path / "m2")).count()
    bad = got.where("error is not null").collect()
    assert [(r.archive, r.offset, r.tries) for r in bad] == [(name, 0, 3)] and got.count() == docs.count()


def test_png_round_trip():
    for t in ("", "a", "ü" * 500, "x" * 64):
        n, p = media.padded(t)
        assert media.from_png(media.to_png(p, n)) == (p, n) and p == payload(t) and n == len(t.encode())
    with pytest.raises(ValueError, match="checksum"):
        media.from_png(media.to_png(bytes(64), 0)[:-5] + b"12345")


# 3 quality


def base(t):
    words, n = WORD.findall(t), 0
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(lines) - len(set(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), n, len(inside)


def test_quality_counts(hard, docs, labels, empty):
    model = quality.fit(docs, labels)
    for df in (hard.where("doc_id is null or doc_id <> 6"), docs):
        for r, (_, t) in zip(sorted(quality.judge(df, model).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words)), sorted(rows_of(df), key=lambda x: (x[0] is None, x[0] or 0, len(WORD.findall(x[1])))), strict=True):
            want = base(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
            assert r.base_failed == failed and r.kept == (not failed and r.low_quality < quality.REJECT)
    assert quality.judge(empty, model).count() == 0
    assert quality.counts("word " * 60_000)[4] == 60_000


def test_quality_scores_against_plain_means(spark):
    """The probability of a given model from plain n-grams of words and characters."""
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(0, 3, quality.BUCKETS).astype(np.float32), 0.3, 1.4, -0.2)
    texts = ["", "a", "ab", "two words", "Größe 漢字漢 ü", "x" * 400, "One two. One two!\nThree é", "é"]
    m32 = 0xFFFFFFFF

    def plain(t):
        c = [ord(x) for x in t]
        words = t.encode().split()
        h = [int(textvec.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hashes()[0]) for w in words]
        pair = [int(textvec.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
        three = [(x + y * 0x01000193 + z * 0xC2B2AE35) & m32 for x, y, z in zip(c, c[1:], c[2:], strict=False)]
        four = [(r + z * 0x27D4EB2F) & m32 for r, z in zip(three, c[3:], strict=False)]
        kinds = [[x >> 49 for x in h], [x >> 49 for x in pair], [(x * 0x9E3779B1 & m32) >> 17 for x in three], [(x * 0x85EBCA6B & m32) >> 17 for x in four]]
        z = model.bias + sum(sum(float(model.weights[g + (k << quality.BITS)]) for g in own) / max(len(own), 1) for k, own in enumerate(kinds))
        return 1 / (1 + math.exp(-(model.slope * z + model.shift)))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(df, model).collect()}
    for i, t in enumerate(texts):
        assert got[i].low_quality == pytest.approx(plain(t), abs=1e-6) and got[i].kept == (not got[i].base_failed and got[i].low_quality < quality.REJECT)


def test_quality_learns(spark):
    good = "the river ran over stones and under the old bridge near town"
    bad = "$$$ win |cash| &&& now ### click *** free %%% offer <> deal"
    d = spark.createDataFrame([(i, " ".join(np.random.default_rng(i).permutation((good if i % 3 else bad).split())) + f" n{i}") for i in range(300)], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(d, quality.fit(d, y)).collect()}
    assert np.mean([got[i].kept == (i % 3 > 0) for i in range(200, 300)]) > 0.95
    none = quality.fit(d, y.where("doc_id < 0"))
    assert all(r.kept for r in quality.judge(d, none).collect())


# 4 language model


def test_base_scores(hard, docs, empty):
    for df in (hard.where("doc_id is null or doc_id <> 6"), docs):
        toks = [(i, [x.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for x in WORD.findall(t)] + [None]) for i, t in rows_of(df)]
        out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        c = collections.Counter(w for i, x in toks if not out(i) for w in x)
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), out(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 6)) for i, x in toks)
        got = lm.scored(df).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert lm.scored(empty).count() == 0


def test_model_beats_unigrams(docs):
    got = lm.scored(docs).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_shuffles_of_scoring(spark, docs, hard, monkeypatch):
    """Texts go through a shuffle once, compressed, and keys as gaps; steps of any size give the same scores."""
    from bench import shuffle_bytes

    model, words = lm.fit(docs)
    before = shuffle_bytes(spark)
    want = sorted(tuple(r) for r in lm.score(docs, model, words).drop("base_score").collect())
    size = sum(len((r.text or "").encode()) for r in docs.collect())
    assert shuffle_bytes(spark) - before < 1.75 * size
    other = sorted(map(str, lm.score(hard, model, words).drop("base_score").collect()))
    monkeypatch.setattr(lm, "STEP_BYTES", 5000)
    assert sorted(tuple(r) for r in lm.score(docs, model, words).drop("base_score").collect()) == want
    assert sorted(map(str, lm.score(hard, model, words).drop("base_score").collect())) == other


def test_filter_counts_are_never_lower():
    key = textvec.mix(np.arange(1, 5001, dtype=np.uint64))
    n = np.random.default_rng(1).zipf(1.5, 5000).clip(1, 10**6)
    bits = np.zeros(1 << lm.FILTER_BITS, bool)
    for q in range(1, int(lm.level(n).max()) + 2):
        for probe in range(lm.PROBES):
            bits[lm._places(key[lm.level(n) + 1 >= q], q, probe)] = True
    f = lm.Filter(np.packbits(bits, bitorder="little"), 0, 0)
    assert (f.levels(key) >= lm.level(n) + 1).all() and (f.levels(key) == lm.level(n) + 1).mean() > 0.99
    assert (f.levels(textvec.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))) > 0).mean() < 0.01


def test_least_level_fits():
    levels = np.array([1000, 500, 200, 50, 1] + [0] * 123)
    assert lm.least_level(levels, 10**6) == 0
    m = lm.least_level(levels, 700)
    assert m > 0 and sum(levels[m + k] * (k + 1) for k in range(5 - m)) <= 700


def test_model_holds_all_words_and_pairs(spark, monkeypatch):
    """Counts down to 1 and words outside the vocabulary are in the filter, whatever its size."""
    monkeypatch.setattr(lm, "VOCABULARY", 50)
    monkeypatch.setattr(lm, "RANGE_TOKENS", 200)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 40).clip(1, 10**6)) for _ in range(600)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _ = lm.fit(train)
    step = lm.Step.of(pa.array(texts), model.vocab)
    assert 0 < len(model.vocab.hashes) <= 50 and lm.ranges_for(model.vocab.tokens) == 128
    held = {r.range: lm.Filter(np.frombuffer(r.bits, np.uint8)) for r in model.blocks.collect()}
    level = {}
    parts = lm._part(step.keys, 128)
    assert (np.diff(parts) >= 0).all()
    for part in np.unique(parts):
        own = step.keys[parts == part]
        level.update(zip(own.tolist(), held[part].levels(lm._short(own)).tolist(), strict=True))
    n = collections.Counter()
    n.update(lm.word_key(step.hashes).tolist())
    n.update(step.keys[step.pair].tolist())
    assert (step.keys[step.word] == lm.word_key(step.hashes)).all()
    assert set(n) == set(level) and min(n.values()) == 1
    want = {k: int(lm.level(np.array([c]))[0]) + 1 for k, c in n.items()}
    assert all(level[k] >= want[k] for k in n) and np.mean([level[k] == want[k] for k in n]) > 0.8
    # the share that the pairs hold, by level of all words that lead them
    word, pairs = collections.Counter(), collections.Counter()
    for t in texts:
        x = [None, *t.split(), None]
        word.update(x[1:])
        pairs.update(zip(x, x[1:], strict=False))
    of = lambda w: min(int(lm.level(np.array([word[w]]))[0]) // 2, 31)
    total, kept = np.zeros(32), np.zeros(32)
    for w, c in word.items():
        total[of(w)] += c
    for (w, _), c in pairs.items():
        kept[of(w)] += c - lm.DISCOUNT
    assert np.allclose(model.kept, kept / np.maximum(total, 1))


def test_score_is_that_of_plain_counts(spark):
    """The score against a model of plain dictionaries, whose counts are rounded to the same levels."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, rng.integers(0, 30)).clip(1, 400)) for _ in range(500)] + ["", None, "new words here", "w1 w1 new w2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = df.where("doc_id < 400")
    model, words = lm.fit(train)
    got = {r.doc_id: r for r in lm.score(df, model, words).collect()}
    held = {r.range: lm.Filter(np.frombuffer(r.bits, np.uint8)) for r in model.blocks.collect()}
    tokens = {i: [*(t or "").split(), None] for i, t in enumerate(texts)}
    word, pairs, follow = collections.Counter(), collections.Counter(), collections.Counter()
    for i in range(400):
        word.update(tokens[i])
        pairs.update(zip([None, *tokens[i]], tokens[i], strict=False))
    lvl = lambda c: int(math.floor(math.log2(c) * 2 + 1e-9))
    middle = lambda q: 0.0 if q == 0 else 1.0 if q == 1 else 2 ** ((q - 0.5) / 2)
    total = collections.Counter()
    for w, c in word.items():
        total[lvl(c) // 2] += c
    for (a, _), c in pairs.items():
        follow[lvl(word[a]) // 2] += c - lm.DISCOUNT
    n, v = sum(word.values()), len(word)

    def read(h, part, exact):
        """A count from the filter, and whether it is the exact one's."""
        q = int(held[part].levels(lm._short(np.array([h], np.uint64)))[0]) if part in held else 0
        assert q >= (lvl(exact) + 1 if exact else 0)
        return middle(q), q == (lvl(exact) + 1 if exact else 0)

    reads = []
    for i, own in tokens.items():
        step, plain, same = lm.Step.of(pa.array([texts[i] or ""]), model.vocab), 0.0, True
        part, log, before = lm._part(step.keys, lm.ranges_for(n)), 0.0, None
        for k, w in enumerate(own):
            at = step.word[k], step.pair[k]
            c, a = read(step.keys[at[0]], part[at[0]], word[w])
            end = lm.word_key(np.array([lm.END]))[0]
            lead, b = read(end, int(lm._part(np.array([end]), lm.ranges_for(n))[0]), word[None]) if before is None else (last, last_same)  # noqa: F821
            pc, d = read(step.keys[at[1]], part[at[1]], pairs[before, w])
            p = min((c + lm.ALPHA) / (n + lm.ALPHA * (v + 1)), 1.0)
            if lead > 0:
                of = lvl(word[before]) // 2 if word[before] else lvl(lead) // 2
                p *= 1 - min(max(follow[of] / max(total[of], 1), 0), 0.999)
            log += math.log10(min(p + min(max(min(pc, c, lead) - lm.DISCOUNT, 0) / max(lead, 1), 1.0), 1.0))
            same, last, last_same, before = same and a and b and d, c, a, w
            reads += [a, d]
        assert got[i].score == pytest.approx(log, abs=1e-6)
        # the same with exact counts
        for a, w in zip([None, *own], own, strict=False):
            c, lead, pc = (middle(lvl(x) + 1) if x else 0.0 for x in (word[w], word[a], pairs[a, w]))
            p = min((c + lm.ALPHA) / (n + lm.ALPHA * (v + 1)), 1.0)
            if lead > 0:
                p *= 1 - min(max(follow[lvl(word[a]) // 2] / total[lvl(word[a]) // 2], 0), 0.999)
            plain += math.log10(min(p + min(max(min(pc, c, lead) - lm.DISCOUNT, 0) / max(lead, 1), 1.0), 1.0))
        assert not same or got[i].score == pytest.approx(plain, abs=1e-6)
    assert np.mean(reads) > 0.85
    assert all(got[i].score > got[502].score for i in (500, 501))


# 5 personal data


def luhn(d):
    return sum((x * 2 - 9 if x * 2 > 9 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def spans(t):
    found = {}
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        found[kind] = []
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                found[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return found


TRICKY = [
    "a@b.c_d@e.f x@y.zz.@q a@b", "1.2.3.4.5.6.7.8 1.2.3.256 001.002.003.004 1..2.3.4", "4111-1111 1111-1111 12 4111111111111112", "4111 1111 1111 1111  4111111111111111 5",
    "+1 (415) 555-2671 +49-30-1234567x +123 +1 2", "é" * 5 + "+44 20 7946 0958" + "ü@a.bc", "9" * 4000 + " " + "1-" * 3000 + "@" * 50, "a.b%c+d-e@f-g.h.i" * 30, "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432",
]


def test_pii(spark, hard, docs, empty):
    extra = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for df in (hard, docs, extra):
        got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(df).collect())
        want = []
        for i, t in rows_of(df):
            s = spans(t)
            want.append((str(i), *[len(s[k]) for k in ("email", "ip", "card", "phone")], hashlib.sha256(",".join(sum(s.values(), [])).encode()).hexdigest()))
        assert got == sorted(want)
    added = {r.doc_id: r.spans for r in pii.report(extra).collect()}
    assert "iban:0:27" in added[8] and "iban:28:50" in added[8]
    assert pii.report(empty).count() == 0


def test_redact(spark, hard):
    got = {r.doc_id: r.text for r in pii.redact(hard).collect()}
    assert got[7] == "mail [EMAIL] and [IP], card [CARD], call [PHONE] now\n\n" and got[2] is None and got[8] == dict(rows_of(hard))[8]
    assert pii.redact(hard).columns == hard.columns
    # words after a match count as well, others lower its score, a column of that name is no obstacle
    around = ["123-45-6789 is my social security number", "order 123-45-6789, social security", "(415) 555-2671 (phone)", "call (415) 555-2671", "serial (415) 555-2671", "mail a@b.c example"]
    f = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(around)), "doc_id long, text string")).collect()}
    assert [bool(f[i].spans) for i in range(6)] == [True, False, True, True, False, True] and f[5].scores == "0.90" and f[2].scores == "0.70"
    clash = pii.find(spark.createDataFrame([(1, "a@b.c", "x")], "doc_id long, text string, Spans string"))
    assert clash.columns == ["doc_id", "text", "Spans0", "spans"] and clash.first()["Spans0"] == "x"
    s = "ids: 123-45-6789 none; my social security number is 123-45-6789 ok"
    one = spark.createDataFrame([(1, s)], "doc_id long, text string")
    assert pii.report(one).first().spans == f"ssn:{s.rindex('123-')}:{s.rindex('123-') + 11}"


# 6 toxicity


def test_toxicity(spark, hard, empty, docs):
    rng = np.random.default_rng(3)
    plain = [f"w{k}" for k in range(300)]

    def text(i):
        s = [" ".join(rng.choice(plain, 8)) + "." for _ in range(5)]
        if i % 4 == 0:
            s[i % 5] = f"you are {'awful' if i % 8 else 'loweid' + str(i)} indeed."
        return " ".join(s)

    d = spark.createDataFrame([(i, text(i)) for i in range(800)], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(5, None), (6, 1), (6, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    got = {r.doc_id: r for r in toxicity.score(d, model, locate=True).collect()}
    assert np.mean([(got[i].score >= 0.5) == (i % 4 == 0) for i in range(600, 800)]) > 0.95
    texts = dict(rows_of(d))
    hit = [texts[i].encode()[s.start : s.end].decode() for i in range(600, 800, 4) for s in got[i].spots]
    assert np.mean(["you are" in h for h in hit]) > 0.9
    scores = toxicity.score(hard, model).collect()
    assert len(scores) == 15 and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(empty, model).count() == 0 and toxicity.kept(empty, model).count() == 0
    assert toxicity.kept(hard, model).columns == hard.columns
    none = toxicity.fit(d, y.where("doc_id < 0"))
    assert all(r.score < 0.5 for r in toxicity.score(d, none).collect())


def test_noisy_or_against_plain_sums(spark):
    """Scores of whole texts with given weights, sentence by sentence and word by word."""
    rng = np.random.default_rng(1)
    weights, bias = rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), -2.0
    words = ["Größe", "gröber", "straßenbahn", "a", "ab12", "idiot", "漢字漢字漢字漢", "ÉTÉS", "x" * 9]
    texts = ["", " \n", "..!?"] + [" ".join(rng.choice(words, rng.integers(1, 12))) + rng.choice([".", "!\n", "? ", ", "]) + " ".join(rng.choice(words, 3)) for _ in range(60)]

    def hashed(word, n=None):
        w = textvec.Words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), textvec.ALNUM)
        h = w.hashes() if n is None else w.prefix_hashes(n)
        return int(h[0] >> np.uint64(64 - 18))

    want = []
    for t in texts:
        alive = 1.0
        parts = [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", s) for s in re.split(r"[\n!.?]", t)]
        for s in [p for p in parts if p] or [[]]:
            z = bias + sum(float(weights[hashed(w)]) + sum(float(weights[hashed(w, n) if len(w) > n else 0]) for n in toxicity.BEGINNINGS) for w in s)
            alive *= 1 - 1 / (1 + math.exp(-z))
        want.append(1 - alive)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(df, (weights, bias)).collect()}
    assert all(got[i] == pytest.approx(w, abs=1e-6) for i, w in enumerate(want))
    # beginnings are cut at characters: two words with the same first four characters share that feature
    assert hashed("größe", 4) == hashed("größer", 4) != hashed("grösse", 4) and hashed("漢字漢字漢", 4) == hashed("漢字漢字字", 4)


# 7 chat


def test_sample_keeps_both_classes(spark):
    """The byte budget is shared by the classes, and a row that doesn't fit costs none after it."""
    rows = [(i, 0, i, b"x" * 10) for i in range(100)] + [(1000, 1, -1, b"x" * 900)] + [(2000 + i, 1, 1000 + i, b"x" * 10) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, y int, place long, feats binary")
    got = [(r.doc_id, r.y) for r in training.within(df, "feats", 800).collect()]
    assert sorted(i for i, y in got if y) == list(range(2000, 2030))
    assert sorted(i for i, y in got if not y) == list(range(50))
    assert training.within(df, "feats", 10**6).count() == len(rows)


def test_escape_is_reversible():
    for s in ("<|im_end|>", "<\\|x", "<\\\\|", "<||", "a<|b<\\|c", "<", "|", "<<|"):
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)


def test_chat(spark, sf):
    odd = [(1, 2, "assistant", "B"), (1, 1, "user", None), (1, 2, "assistant", "A"), (1, 2, "assistant", "A"), (None, 1, None, "x<|im_sep|>"), (2, None, "assistant", " lead\n\n"), (2, 5, "assistant", ""), (2, 6, "assistant", "é🙂漢" * 50)]
    extra = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    path = queries.tokenizer_path()
    for df, block in ((table.unionByName(chat.probe(spark)), chat.BLOCK_CHARS), (extra, chat.BLOCK_CHARS), (extra, 1)):
        by = collections.defaultdict(list)
        for r in df.collect():
            by[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
        blocks = chat.formatted(df, path, block)
        got = {r.conv_id: r for r in chat.digests(blocks).collect()}
        assert got.keys() == by.keys()
        for k, v in by.items():
            v = sorted(v)
            said = "".join(t for _, role, t in v if role == "assistant")
            assert (got[k].n_turns, got[k].loss_chars) == (len(v), len(said))
            assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in v).encode()).hexdigest()
            assert got[k].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        whole = chat.tokenizer(path)
        for b in blocks.collect():
            assert b.ids == whole.encode(b.text, add_special_tokens=False).ids and len(b.loss) == len(b.ids)
            assert whole.decode(b.ids, skip_special_tokens=False) == b.text
    assert chat.digests(chat.formatted(extra.where("false"), path)).count() == 0


# 8 packing


def check_pack(df, pieces, length):
    enc = packing.encoder(queries.tokenizer_path()).full
    want = collections.Counter((i, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for i, t in rows_of(df) if (e := enc.encode(t, add_special_tokens=False).ids + [1]))
    seq, docs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        seq[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append(p)
    for k, v in seq.items():
        at = 0
        for o, n in sorted(v):
            assert o == at and n > 0
            at += n
        assert at == length or k == max(seq)
    assert sum(p.length for p in pieces) == sum(n * c for (_, n, _), c in want.items())
    texts = collections.defaultdict(list)
    for i, t in rows_of(df):
        texts[i].append(enc.encode(t, add_special_tokens=False).ids + [1])
    for i, own in docs.items():
        if len(texts[i]) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[i][0])
                assert p.ids_crc32 == zlib.crc32(np.array(texts[i][0][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(texts[i][0])


def test_packing(spark, hard, docs, empty):
    path = queries.tokenizer_path()
    check_pack(hard, packing.pack(hard, path).collect(), 2048)
    got = packing.pack(docs.repartition(5), path)
    check_pack(docs, got.collect(), 2048)
    share = {r.source: r.n for r in docs.select("doc_id", "source").join(got.select("doc_id", "length"), "doc_id").groupBy("source").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    total = sum(share.values())
    by = got.join(docs.select("doc_id", "source"), "doc_id").groupBy("sequence_id", "source").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()
    last = max(r.sequence_id for r in by)
    assert max(abs(r.n - 2048 * share[r.source] / total) for r in by if r.sequence_id < last) <= 2
    assert packing.pack(empty, path).count() == 0
    shares = {"src0": 3.0, "src1": 1.0}
    check_pack(docs, packing.pack(docs, path, 512, shares).collect(), 512)


def test_encoder_is_the_tokenizer():
    e = packing.encoder(queries.tokenizer_path())
    rng = np.random.default_rng(5)
    alphabet = list("ab'sre1.,!?-_ \n\t\x0b\x1c\x85\xa0éñß漢🙂<|>")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(3000)] + ["<|endoftext|> a<|endoftext|>b", " a", "a ", "a  b", "it's they'll", "ẞǅʰ x"]
    for t in texts:
        assert e.ids(t).tolist() == e.full.encode(t, add_special_tokens=False).ids, repr(t)


def by_rounds(total, share, length):
    """Plain deficit round-robin, one window after the other."""
    left, deficit, out = np.array(total), np.zeros(len(total)), []
    while left.any():
        room = min(length, int(left.sum()))
        own = np.where(left > 0, share, 0.0)
        served, deficit = packing.serve(own / own.sum() * room, deficit, room, left)
        left = left - served
        deficit[left == 0] = 0
        out.append(served)
    return np.array(out)


@pytest.mark.parametrize(
    ("total", "share"),
    [
        ([5000, 30, 700, 1], None), ([100, 100, 100], [8, 1, 1]), ([3], None), ([1] * 50, None), ([1] * 50, [1] * 50), ([700] * 9, [1, 1, 1, 2, 2, 2, 4, 4, 4]), ([1, 10**5, 9], [1, 1e-12, 1]),
        ([1 + 7 * i % 90 for i in range(3000)], None), ([1 + 7 * i % 900 for i in range(150)], [1 + i % 11 for i in range(150)]),
    ],
)
def test_schedule(total, share):
    """Whole windows, in order, near the targets, whatever the number of queues; any window alone gives the same."""
    length, rng = 64, np.random.default_rng(4)
    make = lambda: packing.Schedule(np.array(total), None if share is None else np.array(share, float), length)
    s = make()
    a = s.served(np.arange(s.windows + 1))
    assert (a.sum(1) == np.minimum(np.arange(s.windows + 1) * length, sum(total))).all() and (np.diff(a, axis=0) >= 0).all() and (a[-1] == total).all()
    plain = np.cumsum(by_rounds(total, np.array(total if share is None else share, float), length), axis=0)
    assert plain.shape == a[1:].shape and np.abs(plain - a[1:]).max() <= 4
    some = np.unique(rng.integers(0, s.windows + 1, 4))
    assert (make().served(some) == a[some]).all()
    q = rng.integers(0, len(total), 400)
    at = (rng.random(400) * np.array(total)[q]).astype(np.int64)
    w = make().window_of(q, at)
    assert (a[w, q] <= at).all() and (at < a[w + 1, q]).all()
    run, start, size, w, offset = make().cut(q, at, np.array(total)[q] - at)
    assert size.sum() == (np.array(total)[q] - at).sum() and (np.bincount(run, size) == np.array(total)[q] - at).all() and (offset + size <= length).all()
    assert (a[w, q[run]] <= at[run] + start).all() and (at[run] + start + size <= a[w + 1, q[run]]).all()


def test_packing_keeps_a_queue_for_each_source(spark):
    """3,000 sources, two of them with given shares: these fill the first windows."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 99, 30)), f"s{i % 3000}" if i % 3 else ["s0", "s1"][i % 2]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(df, queries.tokenizer_path(), 512, {"s0": 3.0, "s1": 1.0}).collect()
    check_pack(df, got, 512)
    source, by = {r[0]: r[2] for r in rows}, collections.Counter()
    for p in got:
        by[p.sequence_id, source[p.doc_id]] += p.length
    assert all(abs(by[w, "s0"] - 384) <= 4 and abs(by[w, "s1"] - 128) <= 4 for w in range(20))


# 9 mixing


def test_mixing(hard, docs, empty):
    for df in (docs, hard):
        m = mixing.mix(df).collect()
        by = collections.defaultdict(lambda: [0, 0, 0.0])
        for r in m:
            v = by[r.source]
            v[0], v[1], v[2] = v[0] + r["size"], v[1] + r.copies * r["size"], r.target
            assert 0 <= r.copies <= 2
        total = sum(v[0] for v in by.values())
        order = sorted(by, key=lambda s: (s is None, s or ""))
        weight, cap, left, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: 2 * by[s][0] for s in order}, 1.5 * total, set(order)
        want = {}
        while True:
            u = left / sum(weight[s] for s in open_)
            over = {s for s in open_ if weight[s] * u > cap[s]}
            if not over:
                break
            for s in over:
                want[s], left = cap[s], left - cap[s]
            open_ -= over
        want |= {s: weight[s] * u for s in open_}
        assert all(by[s][2] == pytest.approx(want[s]) for s in order)
    assert sorted(map(str, m)) == sorted(map(str, mixing.mix(hard.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixing_comes_near(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(docs).collect():
        by[r.source][0] += r.copies * r["size"]
        by[r.source][1] = r.target
    assert all(abs(a - t) <= 0.02 * t for a, t in by.values())


def test_solve_meets_overlapping_constraints(spark):
    """Newton's solution of the dual against plain raking of the cells, and a mix that can't exist."""
    rng = np.random.default_rng(2)
    a, b = [f"s{i}" for i in range(7)], ["en", "de", None]
    size = {(x, y): int(rng.integers(50, 5000)) for x in a for y in b}
    cells = spark.createDataFrame([(x, y, n) for (x, y), n in size.items()], "source string, lang string, size long")
    want = {"source": {x: float(rng.integers(500, 5000)) for x in a}}
    whole = sum(want["source"].values())
    want["lang"] = {"en": 0.6 * whole, "de": 0.3 * whole, None: 0.1 * whole}
    goals = {k: spark.createDataFrame(list(v.items()), "value string, target double") for k, v in want.items()}
    rate = {k: 1.0 for k in size}
    for _ in range(500):
        for kind, at in (("source", 0), ("lang", 1)):
            for v, t in want[kind].items():
                own = [k for k in size if k[at] == v]
                f = t / sum(size[k] * rate[k] for k in own)
                for k in own:
                    rate[k] *= f
    got = {(r.source, r.lang): r.rate for r in mixing.solve(cells, goals).collect()}
    assert got.keys() == rate.keys() and all(got[k] == pytest.approx(rate[k], rel=1e-6) for k in rate)
    alone = {(r.source, r.lang): r.rate for r in mixing.solve(cells, {"source": goals["source"]}).collect()}
    assert all(r == pytest.approx(want["source"][s] / sum(n for (x, _), n in size.items() if x == s), rel=1e-9) for (s, _), r in alone.items())
    apart = spark.createDataFrame([("x", "en", 10), ("y", "de", 10)], "source string, lang string, size long")
    with pytest.raises(ValueError, match="no mix"):
        mixing.solve(apart, {"source": spark.createDataFrame([("x", 5.0), ("y", 5.0)], "value string, target double"), "lang": spark.createDataFrame([("en", 8.0), ("de", 2.0)], "value string, target double")}, steps=10)


def test_mixing_by_source_and_language(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(rng.integers(5, 60))), f"s{i % 3}", ["en", "de"][int(rng.random() < 0.3)], i) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, Size long")
    m = mixing.mix(df, also={"lang": {"en": 1.0, "de": 1.0}})
    assert m.columns == ["doc_id", "text", "source", "lang", "Size0", "size", "source_size", "target", "copies"]
    took, goal = collections.Counter(), {}
    for r in m.collect():
        took[r.source] += r.copies * r[5]
        took[r.lang] += r.copies * r[5]
        goal[r.source] = r.target
    assert all(abs(took[s] - t) < 0.01 * t for s, t in goal.items()) and abs(took["en"] - took["de"]) < 0.01 * took["en"]


# 10 SimHash


def simhash_brute(t):
    import xxhash

    low = t.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    w = WORD.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(fps, ids, bits):
    f = np.array(fps, np.uint64)
    parent = list(range(len(f)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= bits, 1)), strict=True):
        a, b = root(int(i)), root(int(j))
        parent[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [least[root(k)] for k in range(len(f))]


def test_simhash(hard, docs, empty):
    for df in (hard.where("doc_id is null or doc_id <> 6"), docs):
        rows = rows_of(df)
        fps = [simhash_brute(t) for _, t in rows]
        comp = components_brute(fps, [i for i, _ in rows], 2)
        got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
        assert got == collections.Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp, strict=True))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.representatives(hard)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    comp = {}
    for (i, t), c in zip(rows, components_brute([simhash_brute(t or "") for _, t in rows], list(range(len(rows))), 2), strict=True):
        comp.setdefault(c, []).append((i is None, i or 0))
    assert kept.columns == hard.columns and sorted((i is None, i or 0) for i, _ in got) == sorted(min(v) for v in comp.values())
    assert simhash.representatives(empty).count() == 0


def test_representatives_of_repeated_ids(spark):
    """An id with texts in two components, copies without an id, whole rows that repeat, a column that can't be ordered."""
    a, b, c = "one two three four five", "quite another text of six words", "third text about nothing at all here"
    rows = [(7, a, {"k": 1}), (7, b, {"k": 2}), (9, b, {"k": 1}), (None, c, {"k": 1}), (None, c, {"k": 1}), (3, a, {"k": 5}), (3, a, {"k": 5}), (3, a, {"k": 4})]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash map<string,int>")
    got = sorted(((r.doc_id, r.text, r.text_hash["k"]) for r in simhash.representatives(df).collect()), key=str)
    assert got == sorted([(7, b, 2), (None, c, 1), (3, a, 4)], key=str)


@pytest.mark.parametrize("k", [3, 4, 5])
def test_links_of_a_dense_cluster(spark, k):
    rng = np.random.default_rng(9)
    base_ = int(rng.integers(0, 2**63))
    fps = {base_ ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (400, 3))} | {int(x) for x in rng.integers(0, 2**63, 300)}
    fps |= {f ^ (1 << int(a)) ^ (1 << int(b)) for f, (a, b) in zip(list(fps)[-40:], rng.integers(0, 64, (40, 2)), strict=True)}
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"), k=k).collect()
    assert all(bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 2 for e in edges)
    place = {simhash._signed(f): k for k, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for e in edges:
        a, b = root(place[e.a]), root(place[e.b])
        parent[max(a, b)] = min(a, b)
    assert [root(k) for k in range(len(fps))] == components_brute(fps, list(range(len(fps))), 2)


def test_count_filter_tallies_shared_bytes(spark):
    """A pair in light lists meets once for each choice of k among its shared positional bytes."""
    x = 0x0123456789ABCDEF
    for shared in range(3, 8):
        y = x
        for i in range(8 - shared):
            y ^= 255 << 8 * i
        df = spark.createDataFrame([(simhash._signed(x),), (simhash._signed(y),)], "fp long")
        lists = simhash.postings(df, 3).repartition(3, "key").sortWithinPartitions("key")
        assert simhash.tallies(lists).count() == math.comb(shared, 3)


def test_long_lists_go_on_to_longer_keys(spark):
    """Lists of any length, cut anywhere by batches, form the same links."""
    fps = sorted([i << 40 | 7 for i in range(200)] + [1 << 62 | i for i in range(33)] + [5])
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    found = {(min(e), max(e)) for e in simhash.links(df).collect()}
    parent = {f: f for f in fps}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in found:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert [fps.index(root(f)) for f in fps] == [fps.index(fps[c]) for c in components_brute(fps, list(range(len(fps))), 2)]


# kernels


def test_words_and_hashes():
    texts = ["", "a", " a b ", "Ab\tab\x0bAB\x0c", "é ü", "x\x1cy \x85z", "one two", "two one"]
    arr = pa.array(["skip", *texts]).slice(1)
    seen = {}
    for i, j, w in textvec.words_of(arr, most=6):
        h = w.hashes()
        for d in range(i, j):
            own = [bytes(w.raw[a:b]).lower() for a, b in zip(w.start[w.first[d - i] : w.first[d - i + 1]], w.end[w.first[d - i] : w.first[d - i + 1]], strict=True)]
            assert own == [x.encode().lower() for x in WORD.findall(texts[d])]
            for x, y in zip(own, h[w.first[d - i] : w.first[d - i + 1]].tolist(), strict=True):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
