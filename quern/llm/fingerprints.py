"""Document fingerprints by randomised edit embedding: shared random walks over characters turn edit distance into Hamming distance.

A walk reads a text with a step counter: at each step the character under it is put out, and a bit that depends on the step and the character says
whether the walk goes on to the next character. All texts share these bits (of PERIOD steps, over 256 classes of characters), so two texts that differ by few
edits soon fall into step again behind each edit, with some probability; WALKS walks make it likely that one of them does. What is put out is sampled
at steps that all texts share: all of the first 2**FIRST, and PER_OCTAVE of every later octave, so that texts of any length have comparable fingerprints whose size
grows with the logarithm of the length. A fingerprint holds each walk's length and the sampled characters, hashed to 4 bits.

Likeness of two fingerprints: the share of steps with equal characters, each octave weighed by its steps up to the longer walk's end and corrected for
equal hashes; the best walk counts.

Each text also has an edited one, whose last third is taken from the next document. Documents are sorted by id over the cluster and read in order, so a task meets each one's next; only
the last document of each part of the sort waits for the first one of the next part, in a second step over one row a part.

Near duplicates (near_groups) share bit-sampled bands of their fingerprints and are verified by the whole ones.

Cases: null texts are empty; the fingerprints of empty texts are equal, and their likeness to others is 0, to each other 1; rows of equal ids are neighbours, ordered by their texts'
hash, then text; null ids come last; a single document follows itself; an empty table gives no rows. Texts are read whole, in pieces of 2**20 characters. Only the named columns are read.
"""

from __future__ import annotations

import copy
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import arrow_iter, arrow_map, mix, plain, sorted_groups, written
from quern.llm.graph import components
from quern.llm.neardup import _stars, _tiles, linked_parts

SEED, WALKS, PERIOD = 12, 2, 256
FIRST, PER_OCTAVE, OCTAVES = 5, 32, 40
PIECE = 1 << 20


@functools.cache
def _shared() -> tuple[list[tuple[bytes, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """Of all walks: by class of character and phase the phase at the next character; the sampled steps; each octave's first sample and first step."""
    rng = np.random.default_rng(SEED)
    tables = []
    for _ in range(WALKS):
        goes_on = rng.random((256, PERIOD)) < 0.5
        goes_on[:, -1] |= ~goes_on.any(axis=1)
        # the first step from each phase on that goes on, then the one behind it
        there = np.where(np.tile(goes_on, 2), np.arange(2 * PERIOD), 2 * PERIOD)
        ahead = np.minimum.accumulate(there[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
        tables.append(tuple(((row + 1) % PERIOD).astype(np.uint8).tobytes() for row in ahead))
    octaves = [np.arange(1 << FIRST)] + [np.sort(rng.choice(1 << k, min(PER_OCTAVE, 1 << k), replace=False)) + (1 << k) if k < 20 else np.unique(rng.integers(1 << k, 2 << k, PER_OCTAVE)) for k in range(FIRST, OCTAVES)]
    starts = np.concatenate(([0], np.cumsum([len(o) for o in octaves])[:-1]))
    return tables, np.concatenate(octaves), starts, np.array([0] + [1 << k for k in range(FIRST, OCTAVES + 1)])


class Walk:
    """One walk over a text that is fed in parts; a copy goes on with another text from there."""

    def __init__(self, number: int):
        self.table, self.steps = _shared()[0][number], _shared()[1]
        self.phase, self.end, self.symbols = 0, 0, []
        self.taken = 0

    def branch(self) -> Walk:
        out = copy.copy(self)
        out.symbols = self.symbols.copy()
        return out

    def feed(self, codes: np.ndarray) -> Walk:
        for begin in range(0, len(codes), PIECE):
            piece = codes[begin : begin + PIECE]
            table, before = self.table, self.phase
            j = before
            phases = np.frombuffer(bytes([j := table[c][j] for c in piece.astype(np.uint8).tobytes()]), np.uint8)
            self.phase = j
            stays = np.diff(phases, prepend=np.uint8(before)).astype(np.int64)  # modulo PERIOD
            stays[stays == 0] = PERIOD
            ends = self.end + np.cumsum(stays)
            self.end = int(ends[-1])
            upto = int(np.searchsorted(self.steps, self.end))
            seen = piece[np.searchsorted(ends, self.steps[self.taken : upto], side="right")]
            self.symbols.append(((seen * np.uint32(2654435761)) >> np.uint32(28)).astype(np.uint8))
            self.taken = upto
        return self

    def packed(self) -> bytes:
        s = np.concatenate([*self.symbols, np.zeros(self.taken % 2, np.uint8)]) if self.symbols else np.zeros(0, np.uint8)
        return self.end.to_bytes(6, "big") + (s[::2] << 4 | s[1::2]).tobytes()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(text: str) -> bytes:
    """For each walk its length (6 bytes) and its samples (4 bits each)."""
    return b"".join(Walk(w).feed(codes_of(text)).packed() for w in range(WALKS))


def _walks(fp: bytes) -> Iterator[tuple[int, np.ndarray]]:
    steps, at = _shared()[1], 0
    for _ in range(WALKS):
        end = int.from_bytes(fp[at : at + 6], "big")
        n = int(np.searchsorted(steps, end))
        raw = np.frombuffer(fp, np.uint8, (n + 1) // 2, at + 6)
        at += 6 + len(raw)
        yield end, np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)[:n]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1."""
    if a == b:
        return 1.0
    steps, starts, firsts = _shared()[1:]
    best = 0.0
    for (end_a, x), (end_b, y) in zip(_walks(a), _walks(b), strict=True):
        n, m, end = min(len(x), len(y)), max(len(x), len(y)), max(end_a, end_b)
        if not n:
            continue
        equal = np.zeros(m, np.int64)
        equal[:n] = x[:n] == y[:n]
        k = int(np.searchsorted(starts, m))
        agree = np.add.reduceat(equal, starts[:k]) / np.diff(starts[:k], append=m)
        weight = np.minimum(firsts[1 : k + 1], end) - firsts[:k]
        share = float((agree * weight).sum() / weight.sum())
        best = max(best, (share - 1 / 16) / (1 - 1 / 16))
    return best


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by the beginning of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class _Document:
    """A text with its fingerprint and the walks up to where its edited text differs."""

    def __init__(self, text: str):
        self.text, codes = text, codes_of(text)
        self.third = len(codes) // 3
        self.common = [Walk(w).feed(codes[: len(codes) - self.third]) for w in range(WALKS)]
        self.fingerprint = b"".join(w.branch().feed(codes[len(codes) - self.third :]).packed() for w in self.common)

    def before(self, text: str, fp: bytes) -> dict:
        """The columns of FOUND if the next document has this text and fingerprint."""
        changed = b"".join(w.branch().feed(codes_of(text[: self.third])).packed() for w in self.common)
        digest = hashlib.sha256(edited(self.text, text).encode("utf-8", "surrogatepass")).digest()
        return {"n_chars": len(self.text), "edited_sha256": digest, "fingerprint": self.fingerprint, "edited_fingerprint": changed, "near_edited": likeness(self.fingerprint, changed), "near_next": likeness(self.fingerprint, fp)}


FOUND = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _columns(rows: list[dict], names: list[str]) -> dict:
    return {n: [r.get(n) for r in rows] for n in names}


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row; next is the one with the next smaller id, behind the last the first."""
    own = plain(docs, ident, text).toDF("id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    order = [F.desc_nulls_last("id"), F.desc("hash")]
    sorted_rows = own.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, F.desc("text"))
    # what: a row with all columns, or the first text of a part of the sort with its fingerprint, or a part's last text
    schema = f"what string, part int, id {docs.schema[ident].dataType.simpleString()}, text string, {FOUND}"
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, last, ident = None, None, None
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("id"), batch.column("text"), strict=True):
                now = t.as_py()
                doc = last if last is not None and last.text == now else _Document(now)
                if last is None:
                    part = batch.column("part")[0].as_py()
                    rows.append({"what": "first", "part": part, "text": now, "fingerprint": doc.fingerprint})
                else:
                    rows.append({"what": "row", "id": ident} | last.before(now, doc.fingerprint))
                last, ident = doc, i.as_py()
            yield _columns(rows, names)
        if last is not None:
            yield _columns([{"what": "last", "part": part, "id": ident, "text": last.text}], names)

    found = written(arrow_iter(sorted_rows.select("id", "text", F.spark_partition_id().alias("part")), scan, schema))
    firsts = found.where("what = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    # one row for each part of the sort: the next part that has rows, behind the last the first
    parts = found.where("what = 'first'").select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.orderBy("part"))).alias("next_part"))
    lasts = found.where("what = 'last'").select("part", "id", "text").join(parts, "part").join(firsts, "next_part").select("id", "text", "next_text", "next_fp")

    def finish(batch: pa.RecordBatch) -> dict:
        rows = [{"id": r["id"]} | _Document(r["text"]).before(r["next_text"], r["next_fp"]) for r in batch.to_pylist()]
        return _columns(rows, ["id", *names[4:]])

    ended = arrow_map(lasts, finish, f"id {docs.schema[ident].dataType.simpleString()}, {FOUND}")
    return found.where("what = 'row'").select(*ended.columns).unionByName(ended)


# -- near duplicates


BAND_SYMBOLS, BANDS = 6, 24  # of a walk and an octave
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _band_places(octave: int) -> np.ndarray:
    """(BANDS, BAND_SYMBOLS) places among the samples of an octave and the one before it."""
    starts = _shared()[2]
    rng = np.random.default_rng(SEED + 1000 + octave)
    low, high = int(starts[octave - 1]), int(starts[octave + 1])
    return np.stack([rng.choice(np.arange(low, high), BAND_SYMBOLS, replace=False) for _ in range(BANDS)])


def band_keys(fp: bytes) -> list[int]:
    """Keys of sampled bits of the last two octaves that each walk has gone through; of a text that ends before the second octave does, its whole fingerprint."""
    steps, _, firsts = _shared()[1:]
    keys = []
    for w, (end, symbols) in enumerate(_walks(fp)):
        whole = int(np.searchsorted(firsts, end, side="right")) - 2  # the last octave that lies before the end
        for octave in range(max(1, whole - 1), whole + 1):
            bits = symbols[_band_places(octave)].astype(np.uint64) @ (np.uint64(16) ** np.arange(BAND_SYMBOLS, dtype=np.uint64))
            salted = bits + np.uint64(((w * 64 + octave) * BANDS) << 24) + (np.arange(BANDS, dtype=np.uint64) << np.uint64(24))
            keys += mix(salted * _ODD).view(np.int64).tolist()
    return keys or [int.from_bytes(hashlib.sha256(fp).digest()[:8], "big", signed=True)]


class _Many:
    """Fingerprints as arrays, for the likeness of one to all."""

    def __init__(self, fps: list[bytes]):
        walks = [list(_walks(fp)) for fp in fps]
        self.walks = []
        for w in range(WALKS):
            ends = np.array([x[w][0] for x in walks])
            symbols = np.full((len(fps), max(len(x[w][1]) for x in walks)), 255, np.uint8)
            for row, x in zip(symbols, walks, strict=True):
                row[: len(x[w][1])] = x[w][1]
            self.walks.append((ends, symbols))

    def to(self, x: int) -> np.ndarray:
        steps, starts, firsts = _shared()[1:]
        ends = self.walks[0][0]
        best = np.where((ends == 0) & (ends[x] == 0), 1.0, 0.0)  # empty texts are equal
        for ends, symbols in self.walks:
            if not symbols.shape[1]:
                continue
            k = int(np.searchsorted(starts, symbols.shape[1]))
            end = np.maximum(ends, ends[x])
            # samples up to the longer walk's end, by octave
            number = np.clip(np.searchsorted(steps, end)[:, None] - starts[None, :k], 0, np.append(np.diff(starts[:k]), symbols.shape[1] - starts[k - 1]))
            agree = np.add.reduceat((symbols == symbols[x]) & (symbols[x] < 255), starts[:k], axis=1)
            weight = np.where(number > 0, np.clip(end[:, None] - firsts[None, :k], 0, np.diff(firsts)[:k]), 0)
            share = (agree / np.maximum(number, 1) * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
            best = np.maximum(best, (share - 1 / 16) / (1 - 1 / 16))
        return best


def near_groups(docs: DataFrame, least: float = 0.8, ident: str = "doc_id", text: str = "text", tile: int = 512) -> DataFrame:
    """(id, class_id) of every row: the smallest id that a chain of pairs with a likeness of `least` or more reaches, itself included.

    Equal texts are one class. Classes meet where they share a band, that is BAND_SYMBOLS sampled characters of one octave pair and walk; buckets of more than `tile` classes are dealt as
    pairs of blocks, and each task verifies by the whole fingerprints and gives the links that span its groups. Texts of fewer than about 30 characters only meet equal
    ones; empty texts are a class; null ids stand alone (class_id null).
    """
    base = plain(docs, ident, text).toDF("id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    kind = docs.schema[ident].dataType.simpleString()
    named = base.where("id IS NOT NULL").withColumn("mark", F.sha2("text", 256))
    reps = named.groupBy("mark").agg(F.min("id").alias("rep"))
    firsts = named.join(reps.hint("merge"), (named["mark"] == reps["mark"]) & (named["id"] == reps["rep"]), "left_semi").select("id", "text")

    def sketch(batch: pa.RecordBatch) -> dict:
        return {"rep": batch.column(0), "fp": [fingerprint(t.as_py()) for t in batch.column(1)]}

    classes = written(arrow_map(firsts, sketch, f"rep {kind}, fp binary").dropDuplicates(["rep"]))

    def spread(batch: pa.RecordBatch) -> dict:
        keys = [band_keys(fp.as_py()) for fp in batch.column("fp")]
        return {"key": np.concatenate([np.array(k, np.int64) for k in keys]), "rep": batch.column("rep").take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])))}

    light = written(arrow_map(classes, spread, f"key bigint, rep {kind}").distinct())
    sizes = light.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    large = written(sizes.where(F.col("n") > tile).select("key", F.ceil(F.col("n") / tile).cast("int").alias("blocks")))
    few = F.broadcast(large) if large.count() <= 100_000 else large
    small = light.join(few.select("key"), "key", "left_anti").join(sizes.select("key").withColumn("blocks", F.lit(1)), "key")
    rows = _tiles(light.join(few, "key").unionByName(small).join(classes, "rep"), "blocks", "rep").select("key", "i", "j", "rep", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, cuts in sorted_groups(batches, ["key", "i", "j"]):
            ids, fps, a, b = batch.column("rep").to_numpy(), batch.column("fp").to_pylist(), [], []
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if end - start > 1:
                    many = _Many(fps[start:end])
                    p, q = _stars(ids[start:end], linked_parts(end - start, lambda x: many.to(x) >= least))  # noqa: B023
                    a.append(p)
                    b.append(q)
            if a:
                yield {"a": np.concatenate(a), "b": np.concatenate(b)}

    links = arrow_iter(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), link, "a bigint, b bigint")
    groups = components(links)
    members = named.select("id", "mark").join(reps.hint("merge"), "mark").join(groups, F.col("rep") == F.col("node"), "left")
    alone = base.where("id IS NULL").select("id", F.col("id").alias("class_id"))
    return members.select("id", F.coalesce("component", "rep").alias("class_id")).unionByName(alone)


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that to the next document's."""
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select(F.col("id").alias("doc_id"), "n_chars", digits("edited_sha256"), digits("fingerprint"), digits("edited_fingerprint"), "near_edited", "near_next")
