"""Repeated passages by a sparse suffix array.

1. A suffix is kept only where it starts at a minimiser: of each ``least - prefix + 1`` successive runs of ``prefix`` words the
   one with the smallest hash. The choice depends on content alone, so a passage of ``least`` words or more that two texts
   share keeps suffixes at the same places of both.
2. The kept suffixes are sorted by (the hash of) their first ``prefix`` words; those whose neighbours belong to one
   document are dropped. A document has one row for a key, with all its places, and a key that two documents of a task share is
   settled there: only one marker of it goes on, so a key has at most one row per task and document, however common.
3. The remaining suffixes, with the words before and behind the place, meet by key. For each extension to the
   left by l words they are sorted by their next ``least - l`` words and the l words before, and neighbours of different
   documents that agree are matches of ``least`` words; the matches of a suffix leave its task as intervals.
4. Keys with more than ``HOT`` places would make one task's group too large. Their runs are dealt one by one, by the hash of the
   whole run, so that they meet (and are settled within tasks first) wherever they are.
5. A document's intervals are joined into maximal spans: exactly the words covered by runs of ``least`` words that
   occur in two or more documents.

Words lie between ASCII white space, A-Z in lower case. Cases: null, empty and short texts have no spans; rows
with the same id are one document, so their copies don't repeat each other; rows with null ids take no part; repeats within one
document don't count; no rows give no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHashes, arrow_iter, flat, mix, plain, rolling, sorted_groups, written

KEYED = "key bigint, doc_id bigint, kind int, places binary, before binary, behind binary"
ALONE, MARK, KNOWN, SUFFIX = 0, 1, 2, 3  # a key of one document of the task; a key settled there; places settled there; a suffix with its words
FLUSH = 1_000_000  # places that a task holds at a time
HOT = 4096  # places of a key that meet in one task
MOST_BROADCAST = 200_000  # hot keys


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def minimisers(h: np.ndarray, prefix: int, least: int) -> np.ndarray:
    """Start positions of the kept suffixes."""
    runs = rolling(h, prefix)
    window = least - prefix + 1
    if len(runs) < window:
        return np.empty(0, np.int64)
    at = sliding_window_view(runs, window).argmin(axis=1) + np.arange(len(runs) - window + 1)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of int32 values, from each of first to the next, as binary."""
    offsets = np.append(first, len(values)).astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<i4"))]).cast(pa.binary())


def _settled(keys: np.ndarray, docs: np.ndarray, pos: np.ndarray) -> dict:
    """A task's places, a row for each key and document; keys that two of its documents share are settled."""
    order = np.lexsort((pos, docs, keys))
    k, d, p = keys[order], docs[order], pos[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    row = np.flatnonzero(new_key | np.concatenate(([True], d[1:] != d[:-1])))
    places, k, d, p = _packed(p, row), k[row], d[row], p[row]
    first = np.flatnonzero(new_key[row])
    sizes = np.diff(np.append(first, len(k)))
    known = np.repeat(sizes > 1, sizes)
    marks = first[sizes > 1]
    # settled places are spread by their place, as their key has been dealt with
    spread = np.where(known, mix(d.astype(np.uint64) * np.uint64(31) + p.astype(np.uint64)).view(np.int64), k)
    none = pa.nulls(len(k) + len(marks), pa.binary())
    return {
        "key": np.concatenate((spread, k[marks])),
        "doc_id": np.concatenate((d, d[marks])),
        "kind": np.concatenate((np.where(known, KNOWN, ALONE), np.full(len(marks), MARK))).astype(np.int32),
        # a settled place takes its key along, which tells hot keys
        "places": pa.concat_arrays([places, pa.nulls(len(marks), pa.binary())]),
        "before": pa.concat_arrays([_longs(k), pa.nulls(len(marks), pa.binary())]),
        "behind": none,
    }


def _longs(values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(len(values) + 1, dtype=np.int32) * 8), pa.py_buffer(np.ascontiguousarray(values))])


def _collected(rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[dict]:
    """Places (doc, keys, positions) in settled portions."""
    held, size = [], 0
    for doc, keys, pos in rows:
        held.append((np.full(len(keys), doc, np.int64), keys, pos))
        size += len(keys)
        if size >= FLUSH:
            yield _joined(held)
            held, size = [], 0
    if size:
        yield _joined(held)


def _joined(held: list) -> dict:
    docs, keys, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    return _settled(keys.view(np.int64), docs, pos)


def _shared(batch: pa.RecordBatch, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, place) of the places whose key another document has too."""
    docs, kind = batch.column("doc_id").to_numpy(), batch.column("kind").to_numpy()
    starts, sizes = cuts[:-1], np.diff(cuts)
    own = kind != KNOWN  # a settled place is dealt by another key, so it doesn't count in this group
    low = np.minimum.reduceat(np.where(own, docs, np.iinfo(np.int64).max), starts)
    high = np.maximum.reduceat(np.where(own, docs, np.iinfo(np.int64).min), starts)
    shared = (low < high) | np.logical_or.reduceat(kind == MARK, starts)
    keep = (kind == KNOWN) | (kind == ALONE) & np.repeat(shared, sizes)
    kept = batch.filter(pa.array(keep))
    pos, ends = flat(kept.column("places"), "<i4")
    keys, n = flat(kept.column("before"), "<i8")[0], np.diff(ends)
    return np.repeat(keys, n), np.repeat(docs[keep], n), pos


def shared_places(places: DataFrame) -> DataFrame:
    """(key, doc_id, pos) of the places whose key another document has too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, cuts in sorted_groups(batches, ["key"]):
            yield dict(zip(("key", "doc_id", "pos"), _shared(batch, cuts), strict=True))

    return arrow_iter(places.repartition("key").sortWithinPartitions("key"), compare, "key bigint, doc_id bigint, pos int")


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = [np.ones(n, np.uint64), np.ones(n, np.uint64)]
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out[0][j], out[1][j] = out[0][j - 1] * _BASE, out[1][j - 1] * inverse
    return out[0], out[1]


def extended(group: np.ndarray, docs: np.ndarray, before: list[np.ndarray], behind: list[np.ndarray], least: int, prefix: int) -> np.ndarray:
    """matched[i, l]: whether suffix i, extended left by l words, agrees with another document's suffix of its group on least words.

    before and behind hold hashes of the words in front of the place (the nearest last) and from the place on.
    """
    most, n = least - prefix, len(group)
    words = np.arange(n * (most + least), dtype=np.uint64).reshape(n, -1)
    words = mix(words ^ np.uint64(0x5851F42D4C957F2D))  # where a text ends, something that agrees with nothing
    for i, (left, right) in enumerate(zip(before, behind, strict=True)):
        words[i, most - len(left) : most] = left
        words[i, most : most + len(right)] = right
    up, down = _powers(most + least)
    matched = np.zeros((n, most + 1), bool)
    with np.errstate(over="ignore"):
        sums = np.zeros((n, most + least + 1), np.uint64)
        np.cumsum(words * up, axis=1, out=sums[:, 1:])
        for l in range(most + 1):
            a = most - l
            run = (sums[:, a + least] - sums[:, a]) * down[a]
            order = np.lexsort((docs, run, group))
            g, r, d = group[order], run[order], docs[order]
            first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1]))))
            sizes = np.diff(np.append(first, n))
            matched[order, l] = np.repeat(d[first] != d[first + sizes - 1], sizes)
    return matched


def repeated_spans(docs: DataFrame, least: int = 50, prefix: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, n_words: maximal spans of words covered by repeated passages of at least least words."""
    base = plain(docs, id_col, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = WordHashes()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    w = split(t.as_py())
                    if len(w) >= least:
                        h = words(w)
                        at = minimisers(h, prefix, least)
                        yield doc, rolling(h, prefix)[at], at

        yield from _collected(rows())

    kept = written(shared_places(arrow_iter(base, suffixes, KEYED)))
    hot = written(kept.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot")))
    n_hot = hot.count()
    flagged = kept.join(F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot, "key", "left") if n_hot else kept.withColumn("hot", F.lit(False))
    by_doc = flagged.groupBy("doc_id").agg(F.collect_set(F.struct("pos", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))
    placed = base.join(by_doc, "doc_id").select("doc_id", "text", F.col("places.pos").alias("pos"), F.col("places.hot").alias("hot"))

    def with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Suffixes with the words around them; of hot keys all runs of least words that hold the place's prefix."""
        words, out, size, runs, held = WordHashes(), [], 0, [], 0

        def taken() -> dict:
            key, doc, at, before, behind = zip(*out, strict=True)
            at = np.array(at, np.int32)
            out.clear()
            return {"key": np.array(key, np.uint64).view(np.int64), "doc_id": doc, "kind": np.full(len(doc), SUFFIX, np.int32), "places": _packed(at, np.arange(len(at))), "before": before, "behind": behind}

        for batch in batches:
            for doc, t, places, hots in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                w = split(t.as_py())
                if len(w) < least:
                    continue
                h, at = words(w), places.values.to_numpy()
                is_hot = hots.values.to_numpy(zero_copy_only=False).astype(bool)[at + prefix <= len(h)]
                at = at[at + prefix <= len(h)]  # rows of the same id may be shorter
                cold, keys = at[~is_hot], rolling(h, prefix)
                for p in cold.tolist():
                    before, behind = b" ".join(w[max(0, p - least + prefix) : p]), b" ".join(w[p : p + least])
                    out.append((keys[p], doc, p, before, behind))
                    size += len(before) + len(behind)
                if is_hot.any():
                    n = len(h) - least + 1
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.clip(at[is_hot] + prefix - least, 0, n), 1)
                    np.add.at(edge, np.clip(at[is_hot] + 1, 0, n), -1)
                    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    runs.append((doc, mix(rolling(h, least)[starts]), starts))
                    held += len(starts)
                if size > 4 << 20:
                    yield taken()
                    size = 0
                if held > FLUSH:
                    yield from _collected(iter(runs))
                    runs, held = [], 0
        if out:
            yield taken()
        yield from _collected(iter(runs))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = WordHashes()
        for batch, cuts in sorted_groups(batches, ["key"]):
            kind = batch.column("kind").to_numpy()
            found = []
            at = np.flatnonzero(kind == SUFFIX)
            if len(at):
                rows = batch.take(pa.array(at))
                group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[at]
                ids, pos = rows.column("doc_id").to_numpy(), flat(rows.column("places"), "<i4")[0].astype(np.int64)
                around = [[words(x.as_py().split()) for x in rows.column(c)] for c in ("before", "behind")]
                matched = extended(group, ids, *around, least, prefix)
                # runs of successive extensions are one interval
                edge = np.diff(np.pad(matched, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                (i, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                found.append((ids[i], pos[i] - (high - 1), pos[i] - low + least))
            if len(at) < len(kind):
                _, d, p = _shared(batch, cuts)
                found.append((d, p.astype(np.int64), p.astype(np.int64) + least))
            yield dict(zip(("doc_id", "start", "stop"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True))

    met = arrow_iter(placed, with_words, KEYED).repartition("key").sortWithinPartitions("key")
    intervals = arrow_iter(met, compare, "doc_id bigint, start bigint, stop bigint").groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("parts"))
    parts = intervals.select("doc_id", F.col("parts.start").alias("start"), F.col("parts.stop").alias("stop"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for doc, starts, stops in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                start, stop = starts.values.to_numpy(), stops.values.to_numpy()
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(stop[order])
                first = np.concatenate(([True], start[1:] > stop[:-1]))
                begin, end = start[first], stop[np.concatenate((first[1:], [True]))]
                out += zip([doc] * len(begin), begin.tolist(), (end - begin).tolist(), strict=True)
            doc, start, n = zip(*out, strict=True) if out else ([], [], [])
            yield {"doc_id": doc, "start_word": start, "n_words": n}

    return arrow_iter(parts, spans, "doc_id bigint, start_word int, n_words int")


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the words of the spans (start_word, n_words); what stays keeps its white space."""
    import re

    if not text or not spans:
        return text
    drop = {w for start, n in spans for w in range(start, start + n)}
    parts = re.split(r"([^\x20\x09-\x0d]+)", text)
    return "".join(p for j, p in enumerate(parts) if j % 2 == 0 or j // 2 not in drop)


def op7_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """The passages of 50 words or more that documents share."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

