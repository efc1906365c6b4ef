"""What the operators of this package share: scratch tables, Arrow maps and text hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.scratch import discard, new_scratch, scratch_dir, written

__all__ = ["WordHashes", "arrow_iter", "arrow_map", "bucket", "discard", "flat", "mapped", "mix", "new_scratch", "plain", "rolling", "scratch_dir", "sorted_groups", "to_arrow", "values", "written"]


BATCH_BYTES = 16 << 20


def _bounded(df: DataFrame) -> None:
    """Smaller Arrow batches than Spark's default, as workers hold a batch of long texts several times over."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(name, str(BATCH_BYTES))).rstrip("b")) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")


def values(column: pa.Array) -> Iterator:
    """A column's values one at a time, not all at once."""
    return (x.as_py() for x in column)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for columns of any name: it can't read names with dots or backticks, so these come in under other names."""
    names = df.columns
    if not any("." in n or "`" in n for n in names):
        return df.mapInArrow(run, schema)
    return df.toDF(*[f"_{j}" for j in range(len(names))]).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns (a dict); column types come from schema."""
    _bounded(df)
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield as_batch(step(batch), target)

    return mapped(df, run, schema)


def arrow_iter(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a generator over all batches of a task that yields columns (dicts)."""
    _bounded(df)
    target = to_arrow(schema)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield as_batch(columns, target)

    return mapped(df, convert, schema)


def to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def as_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for f in target]
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns, whatever their names, can't clash."""
    return df.select(*[df[n] for n in names])


def bucket(column: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _SHIFT)) * _MIX
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


class WordHashes:
    """64-bit hashes of words (xxhash), kept for words seen before; the store is emptied when it is full, which changes no result."""

    def __init__(self, most: int = 400_000):
        import xxhash

        self.known: dict[bytes, int] = {}
        self.most = most
        self.hash = xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, out = self.known, None
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self.hash(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes, in linear time by doubling; element i covers h[i:i+k]."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    out, done, power, width = None, 0, h, 1
    rest = k
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                out = power[:n].copy() if out is None else mix(out * _MULT + power[done : done + n])
                done += width
            rest >>= 1
            if rest:
                power = mix(power[:-width] * _MULT + power[width:])
                width *= 2
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by keys, cut so that no group spans two of them, with the bounds of their groups."""
    held: list[pa.RecordBatch] = []

    def bounds(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        return np.concatenate(([0], np.flatnonzero(change) + 1, [batch.num_rows]))

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def ends_group(batch: pa.RecordBatch) -> bool:
        """Whether batch holds a row of another group than the rows held back."""
        return any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[batch.num_rows - 1].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        more = not held or ends_group(batch)
        held.append(batch)
        if more:
            whole = joined()
            cuts = bounds(whole)
            if len(cuts) > 2:
                yield whole.slice(0, cuts[-2]), cuts[:-1]
            held = [whole.slice(cuts[-2])]
    if held:
        whole = joined()
        yield whole, bounds(whole)


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of packed arrays (binary)."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(kind) if data is not None else np.empty(0, kind)
    return values, (offsets - offsets[0]) // size
