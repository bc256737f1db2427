"""SimHash near-duplicates through an inverted index over byte positions, with a count filter.

A fingerprint is 8 bytes. Two fingerprints that differ in at most d bits share at least T = 8 - d positional bytes. The
index has a posting list for each choice of k positions and each value of the bytes there; a pair that shares s
positional bytes meets in C(s, k) lists. So the count filter tallies the lists in which a pair meets, keeps the pairs
that reach the guaranteed minimum C(T, k), and verifies their bits. (With k = 1 a list holds 1/256 of all fingerprints,
and the pairs to tally grow with the square of the input; k = 3, 4 or 5, by the number of fingerprints, keeps a list of
unrelated ones below one on average. The result is the same for each k.)

A list of more than ``LIST`` fingerprints forms no pairs. Its members go on to longer keys of T positional bytes, those
it has and each choice of the others: any pair of the list that reaches the minimum meets there, with its tally complete
by construction, and such a list holds at most 256**d fingerprints, however many documents there are. In it pairs are
verified by looking up each fingerprint's neighbours at 1 to d bits, and a spanning forest of the links goes on, not all
pairs. A pair that meets in light lists only has its whole tally there. Equal fingerprints count once throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from .common import pick, remove, shield, small_batches, text_column, written

SHINGLE = 3
SEED = 42
BITS = 2
#: Fingerprints of a posting list up to which all its pairs are tallied.
LIST = 8
#: Rows of sorted postings that a task looks at at once.
AT_ONCE = 1 << 15
#: Documents of one fingerprint from which it may be a heavy one; there are at most ``HEAVY_SHARE`` such fingerprints.
HEAVY, HEAVY_SHARE = 10_000, 1000
#: Hashes of one step of the bit counts, 64 bytes each while counted.
STEP = 1 << 16


def fingerprint(text: str) -> int:
    """Bit i is set if it is set in over half of the XXH64 of the text's shingles of 3 words (A-Z in lower case)."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [h(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        begins = [0, *ends[: len(words) - SHINGLE].tolist()]
        hashes = [h(joined[a:b], SEED) for a, b in zip(begins, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        part = np.array(hashes[i : i + STEP], np.uint64)
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash) for each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [_signed(fingerprint(t)) for t in text_column(batch).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(fp, pa.int64()), batch.column(2)], ["doc_id", "fp", "text_hash"])

    small_batches(docs.sparkSession)
    own = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    return own.mapInArrow(run, "doc_id long, fp long, text_hash long")


def near_links(fps: np.ndarray, bits: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of ``fps`` (sorted, distinct) that differ in 1 to ``bits`` bits of ``within``."""
    free = [i for i in range(64) if within >> i & 1]
    masks = np.array([sum(1 << i for i in c) for d in range(1, bits + 1) for c in combinations(free, d)], np.uint64)
    if len(fps) <= 32:
        x = fps[:, None] ^ fps[None, :]
        i, j = np.nonzero(np.triu(np.bitwise_count(x) <= bits, 1))
    else:
        pairs = []
        for m in masks:
            other = fps ^ m
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = np.flatnonzero((fps[at] == other) & (other > fps))
            pairs.append(np.stack([hit, at[hit]]))
        i, j = np.concatenate(pairs, 1)
    parent = list(range(len(fps)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if (ra := root(a)) != (rb := root(b)):
            parent[max(ra, rb)] = min(ra, rb)
            kept.append(k)
    return i[kept], j[kept]


def width(distinct: int) -> int:
    """Positional bytes of a posting key: a list of unrelated fingerprints holds a quarter on average at most."""
    return next((k for k in (3, 4) if distinct <= 1 << (8 * k - 2)), 5)


def postings(distinct: DataFrame, k: int) -> DataFrame:
    """(key, fp): each fingerprint under all choices of ``k`` positions; a key holds the choice and the bytes."""
    byte = lambda at: F.shiftrightunsigned("fp", 8 * at).bitwiseAND(F.lit(255))
    keys = []
    for number, places in enumerate(combinations(range(8), k)):
        key = F.lit(number << 40)
        for i, at in enumerate(places):
            key = key.bitwiseOR(F.shiftleft(byte(at), 8 * i))
        keys.append(key)
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def pairs_of(rows: np.ndarray) -> np.ndarray:
    """All pairs (lesser, greater) of each row's values."""
    i, j = np.triu_indices(rows.shape[1], 1)
    both = np.stack([rows[:, i].ravel(), rows[:, j].ravel()])
    both.sort(axis=0)
    return both


def tallies(lists: DataFrame) -> DataFrame:
    """From (key, fp) with each key's rows together: (a, b) for each light list that a pair meets in, and for a heavy
    list's members (a) the number of its choice of positions, as (a, null, choice)."""
    names = ["a", "b", "choice"]

    def light(both: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(both[0]), pa.array(both[1]), pa.nulls(both.shape[1], pa.int32())], names)

    def heavy(key: int, fps: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(np.full(len(fps), key >> 40, np.int32))], names)

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        held, size = [], 0
        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += batch.num_rows
            if size >= AT_ONCE:
                yield *(np.concatenate(x) for x in zip(*held, strict=True)), False
                held, size = [], 0
        none = np.zeros(0, np.int64)
        yield *(np.concatenate([none, *x]) for x in (zip(*held, strict=True) if held else ((), ()))), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for key, fp, last in blocks_of(batches):
            key, fp = np.concatenate([rest_key, key]), np.concatenate([rest_fp, fp])
            if hot is not None:  # a heavy list goes on
                n = int(np.searchsorted(key != hot, True)) if len(key) else 0
                if n:
                    yield heavy(hot, fp[:n])
                key, fp = key[n:], fp[n:]
            if not len(key):
                rest_key, rest_fp = key, fp
                continue
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            hot = None
            if not last:  # the last list may go on
                if edges[-1] - edges[-2] > LIST:
                    hot = int(key[-1])
                    yield heavy(hot, fp[edges[-2] :])
                    rest_key, rest_fp = key[:0], fp[:0]
                else:
                    rest_key, rest_fp = key[edges[-2] :], fp[edges[-2] :]
                edges = edges[:-1]
            size, begin = np.diff(edges), edges[:-1]
            for m in np.unique(size[(size > 1) & (size <= LIST)]):
                rows = fp[begin[size == m][:, None] + np.arange(m)]
                yield light(pairs_of(rows))
            for at in np.flatnonzero(size > LIST):
                yield heavy(int(key[begin[at]]), fp[begin[at] : begin[at] + size[at]])

    return lists.mapInArrow(run, "a long, b long, choice int")


def links(distinct: DataFrame, bits: int = BITS, k: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) whose components are those of all pairs at ``bits`` bits or fewer."""
    k = k or width(distinct.count())
    lists = postings(distinct, k).repartition("key").sortWithinPartitions("key")
    table, _ = written(tallies(lists), "tallies")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    light = table.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("met")).where((F.col("met") >= comb(8 - bits, k)) & near)
    longer = list(combinations(range(8), 8 - bits))
    others = [sum(255 << 8 * i for i in range(8) if i not in c) for c in longer]
    # the longer choices that hold each shorter one, and a fingerprint's keys under all that its heavy lists ask for
    holding = F.array(*[F.array(*[F.lit(n) for n, c in enumerate(longer) if set(p) <= set(c)]) for p in combinations(range(8), k)])
    masks = F.array(*[F.lit(_signed((1 << 64) - 1 ^ m)) for m in others])
    asked = table.where("b is null").groupBy(F.col("a").alias("fp")).agg(F.collect_set("choice").alias("choices"))  # 70 at most
    blocks = F.array_distinct(F.flatten(F.transform("choices", lambda c: F.get(holding, c))))
    posts = asked.select("fp", F.explode(blocks).alias("block")).withColumn("key", F.col("fp").bitwiseAND(F.get(masks, F.col("block"))))
    long = posts.groupBy("block", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for block, fps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.sort(np.asarray(fps.values, np.int64).view(np.uint64))
                i, j = near_links(own, bits, others[block])
                a.append(own[i])
                b.append(own[j])
            if a:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return light.select("a", "b").unionByName(long.select("block", "fps").mapInArrow(run, "a long, b long"))


def _classes(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) for each row; (fp, component, component_id) for each fingerprint; and of these the heavy ones."""
    table, _ = written(fingerprints(docs), "fingerprints")
    classes, classes_path = written(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    nodes = components(links(classes.select("fp"), bits))
    of = classes.join(nodes, classes["fp"] == nodes["node"], "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component"))
    of, of_path = written(of, "members")
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named, _ = written(of.join(ids, "component").select("fp", "n", "component", "component_id"), "named")
    remove(docs.sparkSession, classes_path, of_path)
    rows = named.agg(F.sum("n")).first()[0] or 0
    heavy = named.where(F.col("n") > max(HEAVY, rows // HEAVY_SHARE))
    return table, named.drop("n"), heavy.drop("n")


def _with_components(docs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, fp, text_hash, component, component_id) for each row; rows of heavy fingerprints aren't moved."""
    table, named, heavy = _classes(docs, bits)
    few = F.broadcast(heavy)  # HEAVY_SHARE rows at most
    return table.join(few, "fp").unionByName(table.join(few, "fp", "left_anti").join(named, "fp"))


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    Documents link at ``bits`` or fewer differing bits; component_id is the smallest doc_id reachable over links, the
    row's own included; null ids don't count, and a component of null ids alone has none. Null and empty texts have
    the fingerprint zero and link like any other. Equal rows get equal values. An empty table stays empty. Other
    columns are not looked at.
    """
    return _with_components(docs, bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each component of near-duplicates in ``docs``: that with the smallest doc_id, a null id coming last, and
    of rows with that id in the component the one whose text has the least hash, then the least text and other columns.

    Null and empty texts are near-duplicates of each other. Repeated rows leave one. An empty table stays empty. Other
    columns may have any names and types.
    """
    own, names = shield(docs, "doc_id", "text")
    rows = _with_components(own, bits).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("__n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    best = rows.groupBy("component").agg(F.min_by(F.struct("doc_id", "text_hash", "__n"), order).alias("__best"))
    best, _ = written(best.select(F.col("__best.doc_id").alias("__id"), F.col("__best.text_hash").alias("__hash"), F.col("__best.__n").alias("__n")), "best")
    # one row for each component, so the table grows with the documents: shuffled at every size
    found = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    out = own.join(best.where("__n = 1").hint("merge"), found).select(*names)
    if not best.where("__n > 1").isEmpty():  # whole rows are compared only where id and text repeat
        rest = F.struct("text", F.to_json(F.struct(*names)))
        least = own.join(best.where("__n > 1").hint("merge"), found).groupBy("__id", "__hash").agg(F.min_by(F.struct(*names), rest).alias("__row"))
        out = out.unionByName(least.select("__row.*").select(*names))
    return out.toDF(*docs.columns)
