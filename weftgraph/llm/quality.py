"""Quality rules: counted heuristics, and a calibrated model behind a fixed threshold.

The model is a logistic regression on the shares of hashed n-grams of a text: words, pairs of words, and runs of three
and of four characters (case kept, so that shouting shows). It is trained on a bounded sample of labelled rows; Platt's
method on rows that it has not seen turns its output into a probability. Texts are scored in Arrow batches: a score is
the mean of the weights of the text's n-grams, without a feature vector for any text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, small_batches, text_column
from .textvec import Words, characters, data_of, mix, seg_sum, slices
from .training import labelled_sample, within

#: Hash buckets for each kind of n-gram (a power of two); the weights take 4 bytes each.
BITS = 15
KINDS = 4
BUCKETS = KINDS << BITS
#: Labelled documents of each class to learn from, and bytes of their features at most.
PER_CLASS, SAMPLE_BYTES = 1200, 80 << 20
#: A text is rejected where its calibrated probability of low quality is this or more.
REJECT = 0.5
STEPS, RATE, DECAY = 150, 0.08, 1e-4
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 5, 10, 20
_BLANKS = " \t\n\v\f\r"


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    chars = len(text) - sum(map(text.count, _BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    again = np.zeros(n, bool)
    for i, w in enumerate(windows):
        if (j := seen.setdefault(w, i)) != i:
            again[i] = again[j] = True
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + WINDOW, -1)
    return int((inside.cumsum() > 0).sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEATED_PERCENT * n_words


def grams(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram the buckets of all n-grams in order, and the range of each text in them."""
    words = Words(raw, offsets)
    h = words.hashes()
    shift = np.uint64(64 - BITS)
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    out = [(h >> shift, words.first[:-1], words.first[1:]), (pair >> shift, words.first[:-1], np.maximum(words.first[1:] - 1, words.first[:-1]))]
    c, at = characters(raw, offsets)
    run = c[:-2] + c[1:-1] * np.uint32(0x01000193) + c[2:] * np.uint32(0xC2B2AE35) if len(c) > 2 else np.zeros(0, np.uint32)
    out.append((run * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS), at[:-1], np.maximum(at[1:] - 2, at[:-1])))
    run = run[:-1] + c[3:] * np.uint32(0x27D4EB2F) if len(c) > 3 else np.zeros(0, np.uint32)
    out.append((run * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS), at[:-1], np.maximum(at[1:] - 3, at[:-1])))
    return [(g.astype(np.int64) + (k << BITS), np.minimum(a, len(g)), np.minimum(z, len(g))) for k, (g, a, z) in enumerate(out)]


@dataclass(frozen=True)
class Model:
    """weights and bias of the regression; slope and shift that calibrate it to the probability of low quality."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """The calibrated probability that each text is of low quality."""
        raw, off = data_of(texts)
        z = [np.full(0, 0.0)]
        for i, j in slices(off):
            own = np.full(j - i, self.bias)
            for g, a, b in grams(raw[off[i] : off[j]], off[i : j + 1] - off[i]):
                own += seg_sum(self.weights[g].astype(np.float64), a, b) / np.maximum(b - a, 1)
            z.append(own)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.concatenate(z) + self.shift, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, allowed=None) -> Model:
    """A model from a bounded sample of labelled documents; four fifths train it and one fifth calibrates it."""
    small_batches(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            raw, off = data_of(text_column(batch))
            for i, j in slices(off):
                kinds = grams(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                for d in range(j - i):
                    found = [(np.unique(g[a[d] : b[d]], return_counts=True), max(b[d] - a[d], 1)) for g, a, b in kinds]
                    rows.append((np.concatenate([u for (u, _), _ in found]).astype(np.uint32).tobytes(), np.concatenate([c / n for (_, c), n in found]).astype(np.float32).tobytes()))
            a, b = zip(*rows, strict=True) if rows else ((), ())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "y", "place", "ids", "shares"])

    sample = labelled_sample(docs, labels, "quality", PER_CLASS, allowed).select("doc_id", "y", "place", "text")
    rows = within(sample.mapInArrow(features, "doc_id long, y int, place long, ids binary, shares binary"), "ids", SAMPLE_BYTES // 2).toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    y = 1.0 - rows.column("y").to_numpy().astype(float)  # 1: low quality
    weights = np.zeros(BUCKETS, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(weights, -20.0 if not len(y) or y[0] == 0 else 20.0)
    ids = [np.frombuffer(x, np.uint32) for x in rows.column("ids").to_pylist()]
    shares = np.concatenate([np.frombuffer(x, np.float32) for x in rows.column("shares").to_pylist()])
    many = np.array([len(x) for x in ids])
    ids, end = np.concatenate(ids).astype(np.int64), np.cumsum(many)
    start, owner = end - many, np.repeat(np.arange(len(y)), many)
    hidden = np.arange(len(y)) % 5 == 4
    seen = ~hidden
    balance = np.where(y == 1, seen.sum() / (2 * max(y[seen].sum(), 1)), seen.sum() / (2 * max((1 - y[seen]).sum(), 1))) * seen / max(seen.sum(), 1)
    # features are divided by their root mean square so that all kinds learn alike
    size = np.sqrt(np.bincount(ids, shares.astype(float) ** 2, minlength=BUCKETS) / len(y)) + 1e-4
    x = (shares / size[ids]).astype(np.float32)
    w, bias = np.zeros(BUCKETS), 0.0
    mean, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, STEPS + 1):  # Adam
        p = 1 / (1 + np.exp(-np.clip(seg_sum(w[ids] * x, start, end) + bias, -700, 700)))
        g = balance * (p - y)
        grad = np.append(np.bincount(ids, g[owner] * x, minlength=BUCKETS) + DECAY * w, g.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        w, bias = w - move[:-1] / 10, bias - move[-1]
    weights = (w / size).astype(np.float32)
    z = seg_sum(weights[ids].astype(np.float64) * shares, start, end) + bias
    return Model(weights, float(bias), *_platt(z[hidden], y[hidden]))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) a probability of y, fitted to Platt's smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    if not up or not down:
        return 1.0, 0.0
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    ab, design = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -700, 700)))
        h = design.T * (p * (1 - p)) @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (p - goal) + 1e-6 * (ab - [1, 0]))
        ab = ab - step * min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-12))
    return float(ab[0]), float(ab[1])


def judge(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, low_quality) per row.

    A null text has no words, like an empty one, and fails. kept is false where the counted rules fail, else it is the
    model's verdict; low_quality is the calibrated probability. Equal texts have equal results; other columns of
    ``docs`` than doc_id and text are not looked at; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            table = np.array([counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, 5)
            low = model.probabilities(texts)
            failed = np.array([base_failed(n, r) for n, r in zip(table[:, 0].tolist(), table[:, 4].tolist(), strict=True)], bool)
            cols = [batch.column(0), *[pa.array(table[:, k]) for k in range(5)], pa.array(failed), pa.array(~failed & (low < reject)), pa.array(low)]
            yield pa.record_batch(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "low_quality"])

    small_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, low_quality double")
