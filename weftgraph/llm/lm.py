"""Language-model scores from a log-frequency Bloom filter.

The filter holds the counts of all words and pairs of words on a logarithmic scale: an n-gram of level q (its count lies
between BASE**(q-1) and BASE**q) is entered q times, each time with its level. A count is read back by probing levels
1, 2, ... until one is missing, so errors only ever raise a count, and a raise by r levels needs r false answers in a
row. The filter grows with the corpus: it lies in ranges of hashes, as many as the training tokens ask for, and each
range has the bits that its own entries half fill. It is never in one place. Texts are taken in steps of a few MB: a
step asks each range for the levels of its distinct n-grams in a join on the range, and the answers meet the step's
texts in a join on the step.

A pair's probability is its discounted count over its first word's, plus what the discounts leave over (by level of the
first word, from the training counts) times the word's own smoothed probability.

Beside the model, the exact smoothed unigram score: the counts of a vocabulary of bounded size go to all workers, and
the rarer words of the documents meet theirs in a join.

Words are known by 64-bit hashes; for a billion distinct words the chance of any collision is about 3 %.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, pick, small_batches, text_column, written
from .textvec import mix, words_of

#: Probes of an entry; bits of a filter where its size isn't given, and the entries of one kind that fill it a quarter.
FILTER_BITS, PROBES = 27, 5
CAPACITY = int((1 << FILTER_BITS) * np.log(2) / PROBES / 2)
BASE = 2.0**0.5
#: Words at most whose exact counts every worker holds (16 bytes each).
VOCABULARY = 1 << 18
DISCOUNT, ALPHA = 0.75, 0.1
#: Tokens that a task counts before it passes the counts on.
AT_ONCE = 1 << 22
#: Training tokens for each range of hashes, which one task merges and answers for.
RANGE_TOKENS = 1 << 21
#: Bytes of the texts of a step.
STEP_BYTES = 6 << 20
END = np.uint64(0x1F83D9ABFB41BD6B)
_WORD, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the tokens, first token of each text and the end) in steps: a text's words and its end."""
    for i, j, words in words_of(texts):
        first = words.first + np.arange(j - i + 1)
        out = np.full(len(words) + j - i, END, np.uint64)
        at = np.arange(len(words)) + words.doc()
        out[at] = words.hashes()
        yield out, first


def pair_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The pair that each token ends; a text's first token follows an end."""
    before = np.concatenate([[END], h[:-1]]).astype(np.uint64)
    before[first[:-1]] = END
    return mix(before * _PAIR + h) & ~np.uint64(31)


def led_key(pair: np.ndarray, lead: np.ndarray, lead_at: np.ndarray, ranges: int) -> np.ndarray:
    """The keys of pairs: those led by a word outside the vocabulary take the top bits, which say the range, of that word."""
    low = np.uint64((1 << (65 - ranges.bit_length())) - 1)
    return np.where(lead_at >= 0, pair, word_key(lead) & ~low | pair & low)


def level(count: np.ndarray) -> np.ndarray:
    """floor(log_BASE(count)) for counts from 1 on."""
    return np.floor(np.log2(np.maximum(count, 1)) * 2 + 1e-9).astype(np.int64)


def leads(h: np.ndarray, first: np.ndarray, at: np.ndarray, end_at: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each one, the end before a text's first, and its place in the vocabulary."""
    lead, lead_at = np.concatenate([[END], h[:-1]]).astype(np.uint64), np.concatenate([[-1], at[:-1]])
    lead[first[:-1]], lead_at[first[:-1]] = END, end_at
    return lead, lead_at


def _part(key: np.ndarray, ranges: int) -> np.ndarray:
    """The range of keys by their top bits; ``ranges`` is a power of two."""
    return (key >> np.uint64(65 - ranges.bit_length())).astype(np.int64)


def _cut(part: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The distinct parts in order, and for each column the bytes of each part's stretch; ``part`` is sorted."""
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(part))[: len(edge)]
    return part[edge], [pa.array([x[i:j].tobytes() for i, j in zip(edge, ends, strict=True)], pa.binary()) for x in columns]


def _short(key: np.ndarray) -> np.ndarray:
    """The 40 bits of keys that tell them apart within a range, above a pair's free bits and below the range's."""
    return key >> np.uint64(5) & np.uint64((1 << 40) - 1)


def _in_ranges(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of distinct keys by range and, within it, by their 40 bits; and these bits above those of the range."""
    both = _part(keys, ranges).astype(np.uint64) << np.uint64(40) | _short(keys)
    order = np.argsort(both)
    return order, both[order]


def _gaps(x: np.ndarray) -> bytes:
    """Numbers of up to 40 bits in order, as a byte that says how many bytes each has and the gaps between them."""
    gap = np.diff(x, prepend=np.uint64(0))
    width = 4 if int(gap.max(initial=0)) < 1 << 32 else 5
    return bytes([width]) + gap.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_gaps(blob: bytes) -> np.ndarray:
    gap = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, blob[0])
    return np.cumsum(np.pad(gap, ((0, 0), (0, 8 - blob[0]))).view(np.uint64).ravel(), dtype=np.uint64)


def _packed(rows: pa.Table) -> bytes:
    """A table with its buffers compressed, for shuffles: to two thirds of what Spark's own compression leaves of texts."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(column: pa.ChunkedArray) -> pa.RecordBatch:
    """The rows of all tables of a column."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in column]).combine_chunks().to_batches()[0]


def _joined(column, kind: type) -> np.ndarray:
    """The numbers of all blobs of a column."""
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in column]])


def _places_among(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``x`` in order, and the place of each value among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[new], place


def _merge(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(n, at) if len(at) else n


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, n) of all tokens of ``docs`` (doc_id, text); tasks pass on sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

        for batch in batches:
            for h, _ in token_hashes(text_column(batch)):
                held.append(h)
                if sum(map(len, held)) >= AT_ONCE:
                    yield out()
        yield out()

    return docs.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Hashes, sorted, and counts of the most frequent words, all with at least some count; N and V of the training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes; -1 for those that aren't in it."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def vocabulary(words: DataFrame) -> Vocabulary:
    """The words of the largest counts, as many whole counts as ``VOCABULARY`` holds."""
    all_, distinct = words.agg(F.sum("n"), F.count("*")).first()
    # the counts that some bit length has: at most 64 rows, then the counts of one bit length at most
    bits = F.length(F.bin("n"))
    by_bits = dict(words.groupBy(bits.alias("b")).count().collect())
    room, least = VOCABULARY, 1 << 62
    for b in sorted(by_bits, reverse=True):
        if by_bits[b] > room:
            step = max(1, (1 << (b - 1)) >> 10)  # 1,024 steps of a bit length
            rows = dict(words.where(bits == b).groupBy(F.floor(F.col("n") / step).alias("s")).count().collect())
            for s in sorted(rows, reverse=True):
                if rows[s] > room:
                    break
                room, least = room - rows[s], s * step
            break
        room, least = room - by_bits[b], 1 << (b - 1)
    top = words.where(F.col("n") >= least).toArrow()
    h, n = top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return Vocabulary(h[order], n[order], int(all_ or 0), int(distinct))


def ranges_for(tokens: int) -> int:
    """Ranges of hashes for a number of training tokens."""
    ranges = 64
    while ranges * RANGE_TOKENS < tokens:
        ranges *= 2
    return ranges


#: Kinds of counts: pairs led by a word of the vocabulary, by its level; pairs led by another word, with it; words.
_TAGGED, _LED, _WORDS = range(3)


def blocks(docs: DataFrame, words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(range, bits, kept): the filter's block for each range of hashes, with all words and pairs of ``docs`` in it, and
    the pairs' discounted counts by the level of their first word (32 doubles).

    A pair lies in the range of its own hash where its first word is in the vocabulary, and otherwise in the range of
    its first word, whose pairs then give its count: a word that is followed by something each time it occurs.
    """
    ranges, shared = ranges_for(vocab.tokens), docs.sparkSession.sparkContext.broadcast(vocab)
    schema = "range long, kind int, keys binary, counts binary, leads binary"
    names = ["range", "kind", "keys", "counts", "leads"]

    def rows(kind: int, part: np.ndarray, key: np.ndarray, n: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        part, cols = _cut(part[order], key[order], n[order].astype(np.int64), lead[order] if len(lead) else lead)
        return pa.record_batch([pa.array(part), pa.array(np.full(len(part), kind, np.int32)), *cols], names)

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, none = shared.value, np.zeros(0, np.uint64)
        end_at, tagged, led, lead_of, size = own.find(np.array([END]))[0], [none], [none], [none], 0

        def out() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(tagged), return_counts=True)
            yield rows(_TAGGED, _part(h, ranges), h, n, none)
            h, i, n = np.unique(np.concatenate(led), return_index=True, return_counts=True)
            lead = np.concatenate(lead_of)[i]
            yield rows(_LED, _part(h, ranges), h, n, lead)
            for held in (tagged, led, lead_of):
                del held[1:]

        for batch in batches:
            for h, first in token_hashes(text_column(batch)):
                lead, lead_at = leads(h, first, own.find(h), end_at)
                pair, of = led_key(pair_hashes(h, first), lead, lead_at, ranges), lead_at >= 0
                # the low five bits, free in a pair's hash, carry the level of its first word
                tagged.append(pair[of] | np.minimum(level(own.counts[lead_at[of]]) // 2, 31).astype(np.uint64))
                led.append(pair[~of])
                lead_of.append(lead[~of])
                size += len(h)
                if size >= AT_ONCE:
                    yield from out()
                    size = 0
        yield from out()

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            key = word_key(h)
            return rows(_WORDS, _part(key, ranges), key, n, np.zeros(0, np.uint64))

        for batch in batches:
            held.append((np.array(batch.column(0)).view(np.uint64), np.array(batch.column(1))))
            size += batch.num_rows
            if size >= AT_ONCE:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def block(table: pa.Table) -> pa.Table:
        get = lambda kind, *cols: (_joined(table.filter(pc.equal(table["kind"], kind))[c], np.int64 if c == "counts" else np.uint64) for c in cols)
        h, n = _merge(*get(_TAGGED, "keys", "counts"))
        kept = np.bincount((h & np.uint64(31)).astype(np.int64), n - DISCOUNT, minlength=32).astype(float)
        led, m, lead = get(_LED, "keys", "counts", "leads")
        led, i, back = np.unique(led, return_index=True, return_inverse=True)
        m, lead = np.bincount(back, m, len(led)).astype(np.int64), lead[i]
        _, back = np.unique(lead, return_inverse=True)
        kept += np.bincount(np.minimum(level(np.bincount(back, m)) // 2, 31)[back], m - DISCOUNT, minlength=32)
        word, c = get(_WORDS, "keys", "counts")
        bits = filled(_short(np.concatenate([h, led, word])), level(np.concatenate([n, m, c])) + 1)
        return pa.table({"range": [table["range"][0].as_py()], "bits": pa.array([bits.tobytes()], pa.binary()), "kept": [kept.tolist()]})

    counts = docs.mapInArrow(of_pairs, schema).unionByName(words.select("hash", "n").mapInArrow(of_words, schema))
    return counts.groupBy("range").applyInArrow(block, "range long, bits binary, kept array<double>")


def least_level(levels: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least level to keep so that the entries (1 for it, 2 for the next ...) are ``capacity`` at most: for filters
    of a given size. The model keeps every level."""
    m = 0
    while (levels[m:] * np.arange(1, len(levels) - m + 1)).sum() > capacity:
        m += 1
    return m


def _places(key: np.ndarray, q: int, probe: int, size: int = 1 << FILTER_BITS) -> np.ndarray:
    """Bits for level q of keys in a filter of ``size`` bits."""
    inside = mix(key + np.uint64((q * PROBES + probe + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)
    return inside * np.uint64(size) >> np.uint64(32)


def filled(key: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The bytes of a filter that the entries of keys, one for each level from 1 on, fill to about one half."""
    size = 8 * max(8, int(np.ceil(levels.sum() * PROBES / np.log(2) / 8)))
    bits = np.zeros(size, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        key, levels = key[levels >= q], levels[levels >= q]
        for probe in range(PROBES):
            bits[_places(key, q, probe, size)] = True
    return np.packbits(bits, bitorder="little")


def quantised(levels: np.ndarray, least: int = 0) -> np.ndarray:
    """Counts of levels that were read: the geometric middle of the level, 1 for the counts of level 0 alone, 0 where absent."""
    q = levels.astype(np.int64) + least - 1
    return np.where(q < least, 0.0, np.where(q == 0, 1.0, BASE ** (q + 0.5)))


@dataclass(frozen=True)
class Filter:
    """bits, and the least levels of words and of pairs that it holds."""

    bits: np.ndarray
    least_word: int = 0
    least_pair: int = 0

    def levels(self, key: np.ndarray) -> np.ndarray:
        """How many levels from 1 on each key has; 0 for keys that aren't in it."""
        out, left, q = np.zeros(len(key), np.int64), np.arange(len(key)), 1
        while len(left) and q < 128:
            for probe in range(PROBES):
                at = _places(key[left], q, probe, 8 * len(self.bits))
                left = left[self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]
            out[left] = q
            q += 1
        return out


def word_key(h: np.ndarray) -> np.ndarray:
    return mix(h ^ _WORD)


@dataclass(frozen=True)
class Model:
    """kept: by level of a word, the share of its followers' count that the pairs hold; blocks: the table of the filter."""

    vocab: Vocabulary
    kept: np.ndarray
    blocks: DataFrame


@dataclass(frozen=True)
class Step:
    """The tokens of some texts: the first token of each text and the end; each token's place in the vocabulary, and the
    places of its word and of the pair that it ends among the distinct keys of the step, which are sorted, so that each
    range's keys lie together."""

    hashes: np.ndarray
    first: np.ndarray
    at: np.ndarray
    keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray

    @staticmethod
    def tokens(texts: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, ...]:
        """(hashes, first, distinct words, place of each token's word among them, places in the vocabulary, pairs)."""
        slices, first = list(token_hashes(texts)), [np.zeros(1, np.int64)]
        h = np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in slices]])
        for _, f in slices:
            first.append(f[1:] + first[-1][-1])
        first = np.concatenate(first)
        words, place = _places_among(h)
        at = vocab.find(words)[place] if len(h) else np.zeros(0, np.int64)
        lead, lead_at = leads(h, first, at, vocab.find(np.array([END]))[0])
        return h, first, words, place, at, led_key(pair_hashes(h, first), lead, lead_at, ranges_for(vocab.tokens))

    @staticmethod
    def asked(texts: pa.Array, vocab: Vocabulary) -> np.ndarray:
        """The keys alone."""
        _, _, words, _, _, pair = Step.tokens(texts, vocab)
        keys = np.sort(np.concatenate([word_key(words), pair]))
        return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]

    @staticmethod
    def of(texts: pa.Array, vocab: Vocabulary) -> Step:
        h, first, words, word, at, pair = Step.tokens(texts, vocab)
        keys, place = _places_among(np.concatenate([word_key(words), pair]))
        return Step(h, first, at, keys, place[: len(words)][word], place[len(words) :])


def log_probabilities(vocab: Vocabulary, kept: np.ndarray, step: Step, levels: np.ndarray) -> np.ndarray:
    """log10 of each token's probability; ``levels`` are those of the step's keys."""
    of_level = quantised(np.arange(256))
    word_level = levels[step.word]
    c = of_level[word_level]
    p = np.minimum((c + ALPHA) / (vocab.tokens + ALPHA * (vocab.distinct + 1)), 1.0)
    ends = step.first[1:] - 1  # a text's first token follows an end
    end_level = word_level[ends[0]] if len(ends) else 0
    lead_level, lead_at = np.concatenate([[0], word_level[:-1]])[: len(c)], np.concatenate([[-1], step.at[:-1]])[: len(c)]
    lead_level[step.first[:-1]], lead_at[step.first[:-1]] = end_level, vocab.find(np.array([END]))[0]
    rest = 1 - kept[np.minimum(level(of_level) // 2, 31)]
    rest[0] = 1.0
    share = rest[lead_level]
    known = lead_at >= 0
    share[known] = (1 - kept[np.minimum(level(vocab.counts) // 2, 31)])[lead_at[known]]
    lead_c = of_level[lead_level]
    # a pair is no more frequent than its words, whatever the filter says
    pair = np.minimum(of_level[levels[step.pair]], np.minimum(c, lead_c))
    p = p * share + np.minimum(np.maximum(pair - DISCOUNT, 0) / np.maximum(lead_c, 1), 1.0)
    return np.log10(np.clip(p, 1e-300, 1.0))


def held_out(doc_id="doc_id"):
    """Documents that the model doesn't learn from; null ids are among them."""
    return crc_of(doc_id) % 10 == 0


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """A model of all rows of ``train`` (doc_id, text), and the table (hash, n) of its words."""
    small_batches(train.sparkSession)
    words, _ = written(word_counts(train), "words")
    vocab = vocabulary(words)
    table, _ = written(blocks(train, words, vocab), "blocks")
    kept, total = np.zeros(32), np.zeros(32)
    for q, n in table.select(F.posexplode("kept").alias("q", "n")).groupBy("q").agg(F.sum("n").alias("n")).collect():
        kept[q] = n
    lvl = F.least(F.floor(F.floor(F.log2("n") * 2 + 1e-9) / 2), F.lit(31))
    for q, n in words.groupBy(lvl.alias("q")).agg(F.sum("n").alias("n")).collect():
        total[q] = n
    return Model(vocab, np.clip(kept / np.maximum(total, 1), 0, 0.999), table.select("range", "bits")), words


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text).

    A null text is empty; an empty text is its end token alone. Rows are told apart by their place, so repeated and
    null ids are fine, and equal texts have equal scores. With no training tokens the model's score and the base score
    are those of an empty vocabulary. Other columns are not looked at; an empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark removes the shuffles of the fit once the driver has dropped them
    vocab = model.vocab
    shared = spark.sparkContext.broadcast((vocab, model.kept))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, size = TaskContext.get().partitionId() << 33, 0
        base = row
        for batch in batches:
            texts = text_column(batch)
            upto = size + np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
            yield pa.record_batch([pa.array(base + upto // STEP_BYTES), pa.array(np.arange(row, row + len(texts))), batch.column(0), texts], ["step", "row", "doc_id", "text"])
            row, size = row + len(texts), int(upto[-1]) if len(upto) else size

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            return pa.record_batch([pa.array([own]), pa.array([_packed(rows)], pa.binary())], ["step", "rows"])

        for batch in batches:
            steps = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(steps)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i < j:
                    if held and steps[i] != own:
                        yield out()
                    own = int(steps[i])
                    held.append(batch.slice(i, j - i).select(["row", "doc_id", "text"]))
        if held:
            yield out()

    def ask(table: pa.Table) -> pa.Table:
        _, keys = _in_ranges(Step.asked(text_column(_unpacked(table["rows"])), shared.value[0]), ranges_for(shared.value[0].tokens))
        part, short = (keys >> np.uint64(40)).astype(np.int64), keys & np.uint64((1 << 40) - 1)
        edge = np.flatnonzero(np.diff(part, prepend=-1))
        blobs = pa.array([_gaps(x) for x in np.split(short, edge[1:])] if len(edge) else [], pa.binary())
        return pa.table({"step": pa.array(np.full(len(edge), table["step"][0].as_py())), "range": part[edge], "keys": blobs})

    def answer(asked: pa.Table, block: pa.Table) -> pa.Table:
        keys = [_from_gaps(x.as_py()) for x in asked["keys"]]
        many, key = np.array([len(x) for x in keys], np.int64), np.concatenate([np.zeros(0, np.uint64), *keys])
        levels = Filter(np.frombuffer(block["bits"][0].as_buffer(), np.uint8)).levels(key) if block.num_rows else np.zeros(len(key), np.int64)
        of = [x.tobytes() for x in np.split(levels.astype(np.uint8), np.cumsum(many)[:-1])] if len(many) else []
        return pa.table({"step": asked["step"], "range": asked["range"], "levels": pa.array(of, pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        own, kept = shared.value
        batch = _unpacked(table["rows"])
        step, logs = Step.of(text_column(batch), own), np.log10(own.counts + ALPHA)
        order, _ = _in_ranges(step.keys, ranges_for(own.tokens))
        levels = np.empty(len(order), np.uint8)
        levels[order] = _joined(answers.sort_by("range")["levels"], np.uint8)
        p = log_probabilities(own, kept, step, levels)
        inside, begin = step.at >= 0, step.first[:-1]
        cum = lambda x: np.add.reduceat(x, begin)  # noqa: E731  no text is without tokens
        base = cum(np.where(inside, logs[step.at] if len(logs) else 0.0, 0.0))
        ends = np.concatenate([[0], np.cumsum(cum((~inside).astype(np.int64)))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(step.hashes[~inside].view(np.int64)))
        values = [pa.array(x) for x in (np.diff(step.first), cum(inside.astype(np.int64)), base, cum(p))]
        return pa.table([batch.column(0), batch.column(1), *values, lists], ["row", "doc_id", "n_tokens", "known", "base", "score", "rare"])

    texts, _ = written(docs.mapInArrow(number, "step long, row long, doc_id long, text string"), "texts")
    packed = texts.mapInArrow(pack, "step long, rows binary")
    asked = packed.groupBy("step").applyInArrow(ask, "step long, range long, keys binary")
    answers = asked.groupBy("range").cogroup(model.blocks.groupBy("range")).applyInArrow(answer, "step long, range long, levels binary")
    scored_ = packed.groupBy("step").cogroup(answers.groupBy("step")).applyInArrow(finish, "row long, doc_id long, n_tokens long, known long, base double, score double, rare array<long>")
    table, _ = written(scored_, "scores")
    rare = table.select("row", F.explode("rare").alias("hash")).join(words, "hash", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("more"), F.count("n").alias("also"))
    under = float(np.log10(vocab.tokens + ALPHA * (vocab.distinct + 1)))
    out = table.drop("rare").join(rare, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(under)).alias("base_score"), "score",
    )


def scored(docs: DataFrame) -> DataFrame:
    """Scores of all rows under a model of those that aren't held out."""
    own = pick(docs, "doc_id", "text")
    model, words = fit(own.where(~held_out()))
    return score(own, model, words).withColumn("held_out", held_out()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
