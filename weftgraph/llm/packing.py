"""Mixture-controlled packing of documents into sequences of a fixed length by deficit round-robin.

Every source is a queue of tokens. A round of the round-robin fills one window of ``length`` tokens: each queue's deficit
counter rises by its quantum, the tokens that its target proportion gives it in a window; it is served the whole tokens
of its deficit, the odd tokens left in the window go to the greatest deficits, and what a queue is then owed, or was
given ahead, is carried to the next round. When a queue has ended, its quantum is shared by the others.

Running round after round through all windows would be one long sequential pass, so rounds are nested. A round over a
long run of windows, with quanta as many times larger, gives each queue's tokens in the run and the deficits carried to
the next run; inside a run, the same round-robin deals those tokens to ``FAN`` shorter runs, and so on down to single
windows. Any window's state follows from a few such steps, whatever their number, so each task finds the pieces of its
own documents from the totals of the queues alone: deficits go over windows and partitions, and token ids never leave
the task that made them. At each level a deficit stays under a token or two.

Documents are cut freely; every id lies in exactly one piece. Only the last window is shorter than ``length``.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small_batches, text_column, written

END_ID = 1
#: Runs of windows that a round-robin deals a run's tokens to.
FAN = 32
#: Bytes of dealt runs that a worker remembers, and of the table of served tokens that it looks at at once.
REMEMBERED, AT_ONCE = 32 << 20, 16 << 20
#: Rounds of the outermost round-robin between two states that are kept; the others are run again where needed.
KEPT_EVERY = 64
#: Rows of the table of queue offsets up to which it is broadcast (about 40 bytes each).
BROADCAST_ROWS = 200_000
_BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of a byte-level BPE tokenizer file of the ``tokenizers`` library, without added special tokens.

    Where the same vocabulary lies beside the file as ranks for ``tiktoken``, that library encodes Latin texts, whose
    character classes no version of Unicode changes; it is the faster one. Nothing is remembered between texts.
    """

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path, self._full, self.latin = path, None, None
        self.special = [t["content"] for t in file["added_tokens"]]
        largest = max([len(file["model"]["vocab"]) - 1, *(t["id"] for t in file["added_tokens"])])
        self.dtype = np.uint16 if largest < 1 << 16 else np.uint32
        del file
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.latin = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @property
    def full(self):
        """The tokenizer itself, loaded when a text first needs it."""
        if self._full is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.path)
        return self._full

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if self.latin is not None and (text.isascii() or not _BEYOND_LATIN.search(text)) and not any(s in text for s in self.special):
            try:
                return self.latin.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)
            except (ValueError, RuntimeError):  # the pattern's engine may give up on a very long run of one class
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, self.dtype)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(pid, doc_id, queue, n, at, ids) for each document: its ids with the end id; at: its place in its task's part of
    the queue. The columns of ``docs`` are doc_id, text and queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, at = encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([END_ID], enc.dtype)
        for batch in batches:
            rows = []
            for text, queue in zip(text_column(batch).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.concatenate([enc.ids(text), end]).astype(np.uint32 if enc.dtype == np.uint32 else np.uint16)
                rows.append((len(ids), at[queue], ids.tobytes()))
                at[queue] += len(ids)
            n, starts, ids = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch(
                [pa.array([pid] * len(n), pa.int32()), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
                ["pid", "doc_id", "queue", "n", "at", "ids"],
            )

    return docs.mapInArrow(run, "pid int, doc_id long, queue string, n long, at long, ids binary")


def serve(quanta: np.ndarray, deficit: np.ndarray, room: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: (tokens served, deficits carried on). ``left``: tokens in the queues, ``room`` of them at least."""
    owed = deficit + quanta
    out = np.minimum(np.floor(np.maximum(owed, 0)).astype(np.int64), left)
    while more := room - int(out.sum()):
        open_ = np.flatnonzero(out < left if more > 0 else out > 0)
        after = (out - owed)[open_]
        order = np.argsort(after if more > 0 else -after, kind="stable")[: abs(more)]
        out[open_[order]] += 1 if more > 0 else -1
    return out, owed - out


class Schedule:
    """How many tokens of each queue the first w windows hold, by deficit round-robin.

    total: tokens of each queue; share: their target proportions; by default those of the totals, so that all queues
    end together. A queue that ends early leaves its share to the others.
    """

    def __init__(self, total: np.ndarray, share: np.ndarray | None, length: int):
        self.total, self.length = np.asarray(total, np.int64), length
        self.all = int(self.total.sum())
        share = np.asarray(self.total if share is None else share, float)
        share = share / max(float(share.sum()), 1e-300)
        self.windows = -(-self.all // length)
        # the times at which queues end, and the tokens served by then; served tokens are linear in time in between
        ends = np.where(self.total > 0, self.total / np.maximum(share, 1e-300), 0.0)
        order = np.argsort(ends, kind="stable")
        alive = np.cumsum(share[order][::-1])[::-1]
        gone = np.concatenate([[0], np.cumsum(self.total[order])]).astype(float)
        by_then = np.maximum.accumulate(np.minimum(gone[:-1] + alive * ends[order], float(self.all)))
        cuts = by_then / length
        self.edges = np.unique(np.concatenate([[0, self.windows], np.floor(cuts), np.ceil(cuts)]).clip(0, self.windows).astype(np.int64))
        self._share, self._time = share, (np.concatenate([[0.0], by_then]), np.concatenate([[0.0], ends[order]]))
        self._kept: list[tuple[np.ndarray, np.ndarray]] = []
        self._dealt: OrderedDict[tuple, np.ndarray] = OrderedDict()
        state = np.zeros(len(self.total), np.int64), np.zeros(len(self.total))
        for k in range(len(self.edges)):  # the outermost rounds, from one queue's end to the next
            if k % KEPT_EVERY == 0:
                self._kept.append(state)
            if k + 1 < len(self.edges):
                state = self._round(k, *state)

    def _tokens(self, window) -> int:
        return min(int(window) * self.length, self.all)

    def _due(self, tokens: int) -> np.ndarray:
        """Each queue's part of the first tokens by the targets, as fractions."""
        return np.minimum(self._share * np.interp(tokens, *self._time), self.total)

    def _round(self, k: int, held: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = self._tokens(self.edges[k]), self._tokens(self.edges[k + 1])
        out, deficit = serve(self._due(end) - self._due(begin), deficit, end - begin, self.total - held)
        return held + out, deficit

    def _remember(self, key: tuple, make) -> np.ndarray:
        if key in self._dealt:
            self._dealt.move_to_end(key)
        else:
            self._dealt[key] = made = make()
            while len(self._dealt) > 4 and len(self._dealt) * made.nbytes > REMEMBERED:
                self._dealt.popitem(last=False)
        return self._dealt[key]

    def _outer(self, block: int) -> np.ndarray:
        """Tokens served by the edges of a block of outermost rounds, the next block's first edge included."""

        def make() -> np.ndarray:
            state, rows = self._kept[block], []
            first = block * KEPT_EVERY
            for k in range(first, min(first + KEPT_EVERY, len(self.edges) - 1)):
                rows.append(state[0])
                state = self._round(k, *state)
            return np.array([*rows, state[0]])

        return self._remember(("outer", block), make)

    def _inner(self, first: int, last: int, held: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows [first, last), in which ``upto - held`` is served, dealt to shorter runs: their edges and the
        tokens served by them."""
        edges = np.append(np.arange(first, last, -(-(last - first) // FAN)), last)

        def make() -> np.ndarray:
            count, rows, deficit = upto - held, [held], np.zeros(len(held))
            base = self._tokens(first)
            per = count / max(self._tokens(last) - base, 1)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                room = self._tokens(b) - self._tokens(a)
                out, deficit = serve(per * room, deficit, room, upto - rows[-1])
                rows.append(rows[-1] + out)
            return np.array(rows)

        return edges, self._remember((first, last), make)

    def served(self, w: np.ndarray) -> np.ndarray:
        """A row for each of the sorted windows w, a column for each queue; the row's sum is min(w * length, all)."""
        out = np.empty((len(w), len(self.total)), np.int64)

        def fill(edges: np.ndarray, table: np.ndarray, i: int, j: int) -> None:
            run = np.searchsorted(edges, w[i:j], "right") - 1
            while i < j:
                k = int(run[0])
                n = int(np.searchsorted(run, k, "right"))
                at_edge = int(np.searchsorted(w[i : i + n], edges[k], "right"))
                out[i : i + at_edge] = table[k]
                if at_edge < n:
                    fill(*self._inner(int(edges[k]), int(edges[k + 1]), table[k], table[k + 1]), i + at_edge, i + n)
                run, i = run[n:], i + n

        block = np.minimum(np.searchsorted(self.edges, w, "right") - 1, max(len(self.edges) - 2, 0)) // KEPT_EVERY
        for b in np.unique(block):
            edges = self.edges[b * KEPT_EVERY : (b + 1) * KEPT_EVERY + 1]
            fill(edges, self._outer(int(b)), *np.searchsorted(block, [b, b + 1]))
        return out

    def window_of(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The window of token j of a queue."""
        out = np.empty(len(j), np.int64)

        def find(edges: np.ndarray, table: np.ndarray, at: np.ndarray) -> None:
            run = np.empty(len(at), np.int64)
            for q in np.unique(queue[at]):
                own = queue[at] == q
                run[own] = np.searchsorted(table[:, q], j[at[own]], "right") - 1
            for k in np.unique(run):
                own = at[run == k]
                if edges[k + 1] - edges[k] == 1:
                    out[own] = edges[k]
                else:
                    find(*self._inner(int(edges[k]), int(edges[k + 1]), table[k], table[k + 1]), own)

        block = np.zeros(len(j), np.int64)
        for q in np.unique(queue):
            own = queue == q
            block[own] = np.searchsorted([held[q] for held, _ in self._kept], j[own], "right") - 1
        for b in np.unique(block):
            find(self.edges[b * KEPT_EVERY : (b + 1) * KEPT_EVERY + 1], self._outer(int(b)), np.flatnonzero(block == b))
        return out

    def cut(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of the runs [at, at + n) of queues: (run, start in the run, length, window, offset in the window)."""
        if not len(at):
            return (np.zeros(0, np.int64),) * 5
        w0 = self.window_of(queue, at)
        many = self.window_of(queue, at + n - 1) + 1 - w0
        run = np.repeat(np.arange(len(at)), many)
        w = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + w0[run]
        lo, hi, base = (np.empty(len(run), np.int64) for _ in range(3))
        distinct, row = np.unique(w, return_inverse=True)
        step = max(1, AT_ONCE // (16 * len(self.total)))
        for i in range(0, len(distinct), step):
            some = distinct[i : i + step]
            edges = np.unique(np.concatenate([some, some + 1]))
            served, own = self.served(edges), np.flatnonzero((row >= i) & (row < i + step))
            before, q = np.searchsorted(edges, w[own]), queue[run[own]]
            lo[own], hi[own] = served[before, q], served[before + 1, q]
            first = np.searchsorted(edges, some)
            ahead = np.cumsum(served[first + 1] - served[first], axis=1)
            base[own] = np.where(q > 0, ahead[row[own] - i, q - 1], 0)
        start, end = np.maximum(lo, at[run]), np.minimum(hi, (at + n)[run])
        keep = end > start
        return run[keep], (start - at[run])[keep], (end - start)[keep], w[keep], (base + start - lo)[keep]


def pack(docs: DataFrame, path: str, length: int = 2048, shares: dict[str | None, float] | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of ``docs`` (doc_id, text, source).

    A null text is empty and still takes its end id. A null source is a queue of its own. Repeated rows are packed as
    often as they occur. An empty table has no pieces. Other columns are not looked at. ``shares`` gives target
    proportions by source (others: none until these have ended, then by their totals); by default the proportions are
    those of the totals, which alone fill every window of the whole table to target. Each source is a queue of its own,
    whatever their number; the driver and each worker hold a few numbers a source. ``with_ids`` adds the piece's ids
    as little-endian integers (16 bits where the vocabulary allows it).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, "doc_id", "text", "source")
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    table, _ = written(tokenized(docs.select("doc_id", "text", source.alias("queue")), path), "ids")
    parts, _ = written(table.groupBy("pid", "queue").agg(F.sum("n").alias("n")), "queues")
    sums = sorted((r.queue, r.n) for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    if not sums:
        return spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
    total, share = np.array([n for _, n in sums]), None
    if shares is not None:
        given = np.array([shares.get(None if q == "n" else q[1:], 0.0) for q, _ in sums], float)
        rest = np.where(given > 0, 0, total)
        share = given / max(given.sum(), 1e-300) + 1e-12 * rest / max(rest.sum(), 1)
    shared = spark.sparkContext.broadcast(({q: i for i, (q, _) in enumerate(sums)}, total, share))
    upto = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("pid", "queue", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    few = parts.count() <= BROADCAST_ROWS
    rows = table.join(F.broadcast(base) if few else base, ["pid", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    wide = encoder(path).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total, share = shared.value
        plan = Schedule(total, share, length)
        for batch in batches:
            queue = np.array([number[q] for q in batch.column(1).to_pylist()], np.int64)
            at, n = (np.asarray(batch.column(i), np.int64) for i in (2, 3))
            doc, start, size, w, offset = plan.cut(queue, at, n)
            assert size.sum() == n.sum()
            ids = batch.column(4)
            crc, blobs, last, now = np.empty(len(doc), np.int64), [], -1, None
            for k, (d, a, m) in enumerate(zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)):
                if d != last:
                    own = np.frombuffer(ids[d].as_buffer(), wide)
                    last, now = d, memoryview(own.astype("<u4")).cast("B")
                crc[k] = zlib.crc32(now[4 * a : 4 * (a + m)])
                if with_ids:
                    blobs.append(own[a : a + m].tobytes())
            cols = [batch.column(0).take(pa.array(doc)), start, size, crc, n[doc], w, offset]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols] + [pa.array(blobs, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
