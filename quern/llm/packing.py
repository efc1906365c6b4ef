"""Best-fit decreasing packing of tokenised documents into sequences of at most ``window`` tokens.

A document's ids are the tokenizer's plus one end id. Documents of a window or more are first cut into full windows, each a
sequence of its own; what remains of every document is one piece below the window. The pieces of the whole corpus
are packed by best-fit decreasing: from the longest down, each goes into the open sequence with the tightest fitting
remaining capacity, which a segment tree indexed by remaining capacity finds.

Equal lengths behave alike, so the packing needs only the histogram of piece lengths (at most ``window`` entries,
whatever the corpus size): open sequences of equal remaining capacity are kept as ranges, and one step places a run
of equal pieces into such a range. The steps say where the r-th piece of each length goes. Ranks come from the
position within the task that tokenised the piece plus a running sum over tasks, so no length, however common, is
gathered in one task, and the result is exactly that of packing piece by piece.

Tokens are looked up by runs between white space, which no token of this kind of tokenizer spans; each
new run is encoded by the tokenizer itself.

Cases: null or empty text has just the end id; a long document has pieces of its own id at successive starts; repeated
rows and null ids are packed as rows of their own; no rows give no pieces. Only the named columns are read. The last
sequences may be short: padding to the window is then the only loss, none where their length is a power of two.
"""

from __future__ import annotations

import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import arrow_iter, arrow_map, plain, written

PIECES = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, rank bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_MARK = "\x01"


class Tokens:
    """Little-endian unsigned 32-bit ids of texts. Runs between white space are kept; a full store is emptied.

    New runs are encoded many at a time with a mark between them, whose id tells where each one's ids end; where a run
    holds the mark itself they are encoded one by one.
    """

    def __init__(self, path: str, end_id: int, most: int):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # runs are kept here, so the tokenizer's own store only costs time
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)
        self.end = np.array([end_id], "<u4").tobytes()
        self.known: dict[str, bytes] = {"": b""}
        self.most = most
        mark = self._ids(_MARK)
        self.mark = int(mark[0]) if len(mark) == 1 and len(self._ids(f"a {_MARK} a {_MARK} a")) == 2 + 3 * len(self._ids("a")) else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode(self, runs: list[str]) -> None:
        for a in range(0, len(runs), 1000):
            some = runs[a : a + 1000]
            if self.mark is not None and not any(_MARK in r for r in some):
                ids = self._ids(f" {_MARK} ".join(some))
                ends = np.flatnonzero(ids == self.mark)
                if len(ends) == len(some) - 1:
                    data, starts = ids.tobytes(), [0, *(ends + 1).tolist()]
                    for run, i, j in zip(some, starts, [*ends.tolist(), len(ids)], strict=True):
                        self.known[run] = data[4 * i : 4 * j]
                    continue
            for run in some:
                self.known[run] = self._ids(run).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        by_text = [_runs(t or "") for t in texts]
        if len(self.known) > self.most:
            self.known = {"": b""}
        known = self.known
        new = set().union(*by_text).difference(known)
        if new:
            self._encode(list(new))
        return [b"".join(map(known.__getitem__, runs)) + self.end for runs in by_text]


def _runs(text: str) -> list[str]:
    """What white space parts; the few control characters that only Python takes for white space part nothing."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.replace("\n", " ").split(" ")
    return text.split()


class _Kept:
    """A worker's tokens from task to task; dropped when it has been idle for some seconds, as other stages need the memory."""

    IDLE = 3.0

    def __init__(self):
        self.key, self.tokens, self.users, self.uses, self.lock = None, None, 0, 0, threading.Lock()

    def take(self, *key) -> Tokens:
        with self.lock:
            self.users, self.uses = self.users + 1, self.uses + 1
            if self.tokens is None or self.key != key:
                self.key, self.tokens = key, Tokens(*key)
            return self.tokens

    def rest(self) -> None:
        with self.lock:
            self.users -= 1
            timer = threading.Timer(self.IDLE, self.drop, (self.uses,))
        timer.daemon = True
        timer.start()

    def drop(self, uses: int) -> None:
        """Only if nothing has been taken since."""
        with self.lock:
            if self.uses == uses and not self.users:
                self.tokens = None

    def __getstate__(self):
        raise TypeError("a store stays in its worker")


_kept = _Kept()


def packing_store() -> _Kept:
    """The worker's own store (looked up there: a store isn't sent with the task)."""
    return _kept


def _portions(texts: pa.Array, chars: int = 1_000_000) -> Iterator[list[str | None]]:
    out, size = [], 0
    for t in texts:
        out.append(t.as_py())
        size += len(out[-1] or "")
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def tokenised(docs: DataFrame, path: str, end_id: int, window: int, id_col: str, text: str, kept_runs: int) -> DataFrame:
    """Pieces with their rank among the pieces of their length in their task; full windows have rank too."""
    base = plain(docs, id_col, text).toDF("doc_id", "text")
    schema = PIECES.format(id=base.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        kept = packing_store()
        task, tokens, ranks = TaskContext.get().partitionId(), kept.take(path, end_id, kept_runs), np.zeros(window + 1, np.int64)
        try:
            for batch in batches:
                ids, rows = batch.column(0), []
                for j, data in enumerate(d for some in _portions(batch.column(1)) for d in tokens(some)):
                    n = len(data) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        rows.append((j, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, ranks[length]))
                        ranks[length] += 1
                at, start, length, crc, n, rank = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 6
                yield {"doc_id": ids.take(pa.array(at)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": n, "task": np.full(len(at), task, np.int32), "rank": rank}
        finally:
            kept.rest()

    return arrow_iter(base, run, schema)


class _Capacities:
    """A segment tree over remaining capacities: the smallest one, at least a bound, that some open sequence has."""

    def __init__(self, size: int):
        self.size = 1
        while self.size < size:
            self.size *= 2
        self.tree = np.zeros(2 * self.size, bool)

    def set(self, capacity: int, on: bool) -> None:
        j = capacity + self.size
        self.tree[j] = on
        while j > 1:
            j //= 2
            self.tree[j] = self.tree[2 * j] or self.tree[2 * j + 1]

    def at_least(self, capacity: int) -> int | None:
        """Climbs from the capacity's leaf to the first subtree on its right that isn't empty, then descends leftmost."""
        j = capacity + self.size
        if self.tree[j]:
            return capacity
        while j > 1:
            if j % 2 == 0 and self.tree[j + 1]:
                j += 1
                while j < self.size:
                    j = 2 * j if self.tree[2 * j] else 2 * j + 1
                return j - self.size
            j //= 2
        return None


def best_fit(histogram: dict[int, int], window: int) -> np.ndarray:
    """Steps (length, first rank, count, first sequence, pieces a sequence, offset): the packing by best-fit decreasing.

    The piece of rank first + j goes to sequence first_sequence + j // per, at offset + (j % per) * length.
    """
    open_, tree, steps, sequences = [[] for _ in range(window + 1)], _Capacities(window + 1), [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            open_[capacity].append((first, count))
            tree.set(capacity, True)

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.at_least(length) if length <= window else None
            if capacity is None:
                first, count, capacity = sequences, -(-left // (window // length)), window
                sequences += count
            else:
                first, count = open_[capacity].pop()
                if not open_[capacity]:
                    tree.set(capacity, False)
            per = capacity // length
            full, over = divmod(left, per)
            used = min(count, full + bool(over))
            placed = min(left, count * per)
            steps.append((length, rank, placed, first, per, window - capacity))
            put(capacity, first + used, count - used)
            if placed == used * per:
                put(capacity - per * length, first, used)
            else:
                put(capacity - per * length, first, used - 1)
                put(capacity - (placed - (used - 1) * per) * length, first + used - 1, 1)
            left -= placed
            rank += placed
    return np.array(steps, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text: str = "text", kept_runs: int = 1_500_000) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    kept_runs bounds the runs whose ids a worker keeps (about 200 bytes each): more memory for less encoding, no other effect.
    """
    spark = docs.sparkSession
    pieces = written(tokenised(docs, path or default_tokenizer(), end_id, window, id_col, text, kept_runs))
    # a row for each task and length at most, summed within tasks first
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = best_fit(histogram, window)
    sent = spark.sparkContext.broadcast(steps[np.lexsort((steps[:, 1], steps[:, 0]))])
    ranked = pieces.join(base, ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id bigint, offset bigint"

    def place(batch: pa.RecordBatch) -> dict:
        s = sent.value
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        key = s[:, 0] << 44 | s[:, 1]
        step = s[np.searchsorted(key, length << 44 | rank, side="right") - 1]
        j = rank - step[:, 1]
        out = {c: batch.column(c) for c in batch.schema.names}
        return out | {"sequence_id": step[:, 3] + j // step[:, 4], "offset": step[:, 5] + (j % step[:, 4]) * length}

    return arrow_map(ranked, place, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
