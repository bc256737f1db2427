"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document has a label. A sentence's score is a logistic model of its
hashed words and word beginnings; a document is toxic if any of its sentences is (noisy-or), so one minus its score is
the product of the sentences' (1 - p). The likelihood of the document labels trains the sentence model, which then
locates the offending sentences. Features that don't tell the classes apart in the sample stay at zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, pick, small_batches, text_column
from .textvec import ALNUM, seg_sum, words_of
from .training import labelled_sample, within

#: Hash buckets of the features; the weights take 4 bytes each.
BUCKETS = 1 << 18
#: Lengths in characters of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)
#: Labelled documents of each class to learn from, and bytes of their features at most.
PER_CLASS, SAMPLE_BYTES = 2500, 64 << 20
#: Adam steps, their rate, weight decay, the bias to start from; how clearly a feature must tell the classes apart.
STEPS, RATE, DECAY, START, APART, LEAST = 250, 0.1, 0.05, -4.0, 3.5, 8
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def bags(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, object]]:
    """(i, j, features of each word, first word of each sentence, first sentence of each text, words) in steps. A text
    without words has one sentence without words."""
    for i, j, words in words_of(texts, ALNUM):
        feats = np.stack([words.hashes(), *[words.prefix_hashes(n) for n in BEGINNINGS]], 1) >> np.uint64(64 - 18)
        ended = np.concatenate([[0], np.cumsum(_END[words.raw])])
        doc = words.doc()
        part = ended[words.start]
        new = np.ones(len(words), bool)
        new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
        first, owner = np.flatnonzero(new), doc[new]
        empty = np.flatnonzero(words.counts == 0)
        at = np.searchsorted(owner, empty)
        first = np.insert(first, at, words.first[empty])
        owner = np.insert(owner, at, empty)
        yield i, j, feats.astype(np.uint32), np.append(first, len(words)), np.searchsorted(owner, np.arange(j - i + 1)), words


def sentence_logits(weights: np.ndarray, bias: float, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
    return seg_sum(weights[feats].sum(1, dtype=np.float64), first[:-1], first[1:]) + bias


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def noisy_or(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) over the sentences of each text."""
    return -np.expm1(-seg_sum(_softplus(logits), first[:-1], first[1:]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(np.minimum(z, 0) - np.log1p(np.exp(-np.abs(z))))


def _telling(feats: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number from 0 on for the features whose share of documents differs between the classes by ``APART`` standard
    errors; -1 for the others."""
    have = np.zeros((2, BUCKETS))
    for k in range(feats.shape[1]):
        pairs = np.unique(owner.astype(np.uint64) << np.uint64(18) | feats[:, k])
        doc, bucket = (pairs >> np.uint64(18)).astype(np.int64), (pairs & np.uint64(BUCKETS - 1)).astype(np.int64)
        for c in (0, 1):
            have[c] += np.bincount(bucket[y[doc] == c], minlength=BUCKETS)
    n = np.array([[(y == 0).sum()], [(y == 1).sum()]])
    share = np.minimum(have.sum(0) / n.sum(), 1)
    z = (have[1] / n[1] - have[0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
    keep = (np.abs(z) > APART) & (have.sum(0) >= LEAST)
    keep[0] = False  # beginnings that are not there
    return np.where(keep, np.cumsum(keep) - 1, -1)


def fit(docs: DataFrame, labels: DataFrame, allowed=None) -> tuple[np.ndarray, float]:
    """Weights and bias from a bounded sample of the labelled documents."""
    small_batches(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, feats, first, sentences, _ in bags(text_column(batch, "text")):
                for d in range(len(sentences) - 1):
                    lim = first[sentences[d] : sentences[d + 1] + 1]
                    rows.append((feats[lim[0] : lim[-1]].tobytes(), np.diff(lim).astype(np.uint32).tobytes()))
            a, b = zip(*rows, strict=True) if rows else ((), ())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "y", "place", "feats", "sizes"])

    sample = labelled_sample(docs, labels, "toxic", PER_CLASS, allowed).select("doc_id", "y", "place", "text")
    rows = within(sample.mapInArrow(features, "doc_id long, y int, place long, feats binary, sizes binary"), "feats", SAMPLE_BYTES).toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    y = np.asarray(rows.column("y").to_numpy(), np.float64)
    weights, bias = np.zeros(BUCKETS, np.float32), START
    if not len(y) or y.min() == y.max():
        return weights, bias if not len(y) or y.max() == 0 else -START
    feats = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("feats").to_pylist()]).reshape(-1, 1 + len(BEGINNINGS))
    sizes = [np.frombuffer(x, np.uint32) for x in rows.column("sizes").to_pylist()]
    del rows
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    sentences = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    bag = np.repeat(np.arange(len(y)), np.diff(sentences))
    telling = _telling(feats, np.repeat(bag, np.diff(first)), y)
    word, which = np.nonzero(telling[feats] >= 0)
    column, sentence = telling[feats[word, which]], np.repeat(np.arange(len(bag)), np.diff(first))[word]
    w, many = np.zeros(telling.max() + 2), len(bag)
    mean, square = np.zeros(len(w)), np.zeros(len(w))
    w[-1] = bias
    for step in range(1, STEPS + 1):  # Adam on the negative log-likelihood of the document labels
        z = np.bincount(sentence, w[column], minlength=many) + w[-1]
        score = np.clip(noisy_or(z, sentences), 1e-9, 1 - 1e-9)
        pull = np.where(y == 1, -(1 - score) / score, 1.0)
        g = _sigmoid(z) * pull[bag]
        grad = np.append(np.bincount(column, g[sentence], minlength=len(w) - 1), g.sum())
        grad[:-1] += DECAY * w[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w = w - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    chosen = telling >= 0
    weights[chosen] = w[telling[chosen]]
    return weights, float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], locate: bool = False) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text), and where ``locate`` is set the offending sentences as
    (start, end, score), places in bytes of the UTF-8 text.

    A null text is empty; an empty text or one without words has the score of a sentence without words. Equal texts
    have equal scores. Other columns are not looked at. An empty table stays empty.
    """
    weights, bias = model
    spot = "array<struct<start:long,end:long,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spots = [], []
            for _, _, feats, first, sentences, words in bags(text_column(batch)):
                z = sentence_logits(weights, bias, feats, first)
                scores.append(noisy_or(z, sentences))
                if locate:
                    for d in range(len(sentences) - 1):
                        at = [k for k in range(sentences[d], sentences[d + 1]) if z[k] > 0 and first[k + 1] > first[k]]
                        spots.append([{"start": int(words.start[first[k]] - words.offsets[d]), "end": int(words.end[first[k + 1] - 1] - words.offsets[d]), "score": float(1 / (1 + np.exp(-z[k])))} for k in at])
            cols = [batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            if locate:
                cols.append(pa.array(spots, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
            yield pa.record_batch(cols, ["doc_id", "score"] + ["spots"] * locate)

    small_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double" + f", spots {spot}" * locate)


def kept(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, all columns as they were.

    A null or empty text has the score of a sentence without words, as in ``score``. Repeated rows stay or go together,
    rows without an id are judged by their text like all others. Other columns may have any names. An empty table stays
    empty.
    """
    weights, bias = model
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.compute.fill_null(batch.column(at).cast(pa.string()), "")
            scores = [noisy_or(sentence_logits(weights, bias, feats, first), sentences) for _, _, feats, first, sentences, _ in bags(texts)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id"):
    """Rows whose labels the registered query and the pipeline don't learn from."""
    return crc_of(doc_id) % 5 == 0


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` under a model of the labels that aren't held out.

    Null and empty texts have the score of a sentence without words; rows with a null id are scored too and count as ids
    of the empty text in the fold. Repeated rows have equal results. A label that is null, contradicted or without a
    document teaches nothing; with labels of one class alone all scores are alike. An empty table stays empty.
    """
    out = score(docs, fit(docs, labels, ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
