"""Language identification by prediction by partial matching (PPM).

Training counts byte n-grams up to ``max_order + 1`` for each language on a bounded, documented sample of
labelled rows: of each language min(all its bytes, ``max_bytes_per_lang``), from the rows with the smallest id hashes
(text hashes where ids are null). A row gives at most 1/64 of the bound, or the least doubling of that with which the language's
rows fill it; the text that crosses the bound is cut there. The counts are then frozen: in a context with T occurrences and q different successors a
known byte costs ``-log2(n / (T + q))`` bits, any other one the escape ``-log2(q / (T + q))`` plus its cost in the
next shorter context, down to 8 bits without any context. A text's code length under a language is the exact sum
over all its bytes; the shortest code wins and the score is its posterior under equal priors.

The context trees are kept flat: for every n-gram known to any language the cost under each language, with all
escapes already added, in sorted arrays. Scoring sorts a text's n-grams, looks each different one up once and
weighs the costs with the counts, a piece of a long text at a time, so its work is linear in the text and its memory bounded.

Cases: null text or text without a letter is ``und`` with score 0; without any labelled row all is ``und``; ties
go to the language that sorts first; rows are kept as they are, repeated or not; null ids are ordinary rows. Only
the named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_iter, arrow_map, bucket, plain, values

_LETTER = regex.compile(r"\p{L}")
_BASE_BITS = 8.0  # a byte without any context
PIECE = 1 << 20  # bytes of a text that are looked up at a time


@dataclass
class PPMModel:
    langs: list[str]
    max_order: int
    grams: list[np.ndarray]  # [k]: sorted n-grams of k + 1 bytes
    bits: list[np.ndarray]  # [k]: their costs, a column for each language
    contexts: list[np.ndarray]  # [k]: sorted contexts of k bytes
    escapes: list[np.ndarray]  # [k]: cost of an escape, 0 where the language doesn't know the context

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of the whole text under each language, added up over pieces that each see the bytes before them."""
        total = np.zeros(len(self.langs))
        for a in range(0, len(data), PIECE):
            grams, counts = _ngrams(data[a : a + PIECE], self.max_order, data[max(0, a - self.max_order) : a])
            total += counts @ self._cost(grams, self.max_order)
        return total

    def _cost(self, grams: np.ndarray, k: int) -> np.ndarray:
        known = self.grams[k]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        out = self.bits[k][at]
        miss = np.flatnonzero(known[at] != grams)
        if len(miss):
            rest = grams[miss]
            if k == 0:
                lower = np.full((len(rest), len(self.langs)), _BASE_BITS)
            else:
                shorter, back = np.unique(rest & grams.dtype.type((1 << (8 * k)) - 1), return_inverse=True)
                lower = self._cost(shorter, k - 1)[back]
            context = rest >> grams.dtype.type(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            lower = lower + np.where((self.contexts[k][at] == context)[:, None], self.escapes[k][at], 0.0)
            out[miss] = lower
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        bits = self.code_lengths(text.encode("utf-8", "replace"))
        best = int(np.argmin(bits))
        return self.langs[best], float(1 / np.exp2(np.minimum(bits[best] - bits, 0)).sum())


def _ngrams(data: bytes, order: int, before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of order + 1 bytes that end at each byte, and how often; the data follows before, a text's start line feeds."""
    kind = np.uint32 if order <= 3 else np.uint64
    a = np.frombuffer(before.rjust(order, b"\n") + data, np.uint8).astype(kind)
    n = len(a) - order
    g = a[order:].copy()
    for j in range(1, order + 1):
        g |= a[order - j : order - j + n] << kind(8 * j)
    g.sort()
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[first], np.diff(np.append(first, n)).astype(np.float64)


def fit(samples: dict[str, list[bytes]], max_order: int = 3) -> PPMModel:
    """The frozen model of texts by language."""
    langs = sorted(samples)
    model = PPMModel(langs, max_order, [], [], [], [])
    if not langs:
        return model
    kind = np.uint32 if max_order <= 3 else np.uint64
    for k in range(max_order + 1):
        by_lang = []
        for lang in langs:
            parts = [_ngrams(x, max_order) for x in samples[lang]]
            grams = np.concatenate([p[0] for p in parts]) & kind((1 << (8 * (k + 1))) - 1)
            unique, back = np.unique(grams, return_inverse=True)
            by_lang.append((unique, np.bincount(back, np.concatenate([p[1] for p in parts]), len(unique))))
        known = np.unique(np.concatenate([g for g, _ in by_lang]))
        contexts = np.unique(known >> kind(8))
        escapes = np.zeros((len(contexts), len(langs)))
        if k:
            bits = model.bits[k - 1][np.searchsorted(model.grams[k - 1], known & kind((1 << (8 * k)) - 1))].copy()
        else:
            bits = np.full((len(known), len(langs)), _BASE_BITS)
        back = np.searchsorted(contexts, known >> kind(8))
        for j, (grams, n) in enumerate(by_lang):
            own = np.searchsorted(contexts, grams >> kind(8))
            total = np.bincount(own, n, len(contexts))
            q = np.bincount(own, minlength=len(contexts))
            there = q > 0
            escapes[there, j] = np.log2((total[there] + q[there]) / q[there])
            bits[:, j] += escapes[back, j]
            bits[np.searchsorted(known, grams), j] = np.log2((total[own] + q[own]) / n)
        model.grams.append(known)
        model.bits.append(bits)
        model.contexts.append(contexts)
        model.escapes.append(escapes)
    return model


SHARES = 6  # a row gives at most 1 / 2**SHARES of the bound, doubled as often as a language needs


class _Sample:
    """The first rows in order that fill a bound, of all that are added; it never holds much more than twice the bound."""

    def __init__(self, bound: int):
        self.bound, self.rows, self.bytes = bound, [], 0

    def add(self, position: int, data: bytes) -> None:
        self.rows.append((position, data))
        self.bytes += len(data)
        if self.bytes > 2 * self.bound and len(self.rows) > 1:
            self.rows = self.first()
            self.bytes = sum(len(x) for _, x in self.rows)

    def first(self) -> list[tuple[int, bytes]]:
        """The rows up to the one that reaches the bound."""
        out, left = [], self.bound
        for row in sorted(self.rows):
            if left <= 0:
                break
            out.append(row)
            left -= len(row[1])
        return out


def train(docs: DataFrame, max_order: int = 3, max_bytes_per_lang: int = 262_144, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> PPMModel:
    """Fits on a sample of docs that holds min(all its bytes, max_bytes_per_lang) of each language, chosen by id hash."""
    bound = max_bytes_per_lang
    rows = plain(docs, id_col, lang, text).toDF("i", "l", "t").where("l IS NOT NULL AND t IS NOT NULL AND t <> ''")
    caps = [max(1, bound >> (SHARES - j)) for j in range(SHARES + 1)]
    sums = [F.sum(F.least(F.octet_length("t"), F.lit(c))).alias(f"b{j}") for j, c in enumerate(caps)]
    # by language: what a row gives at most, and the bytes that all rows give then
    plan = {r.l: next(((c, r[f"b{j}"]) for j, c in enumerate(caps) if r[f"b{j}"] >= bound), (bound, r[f"b{SHARES}"])) for r in rows.groupBy("l").agg(*sums).collect()}
    samples: dict[str, list[bytes]] = {}
    place = F.when(F.col("i").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("i"))
    factor, open_ = 2.0, dict(plan)
    while open_:
        # rows up to a hash that should give twice the bound; languages with less than it by chance are read further
        limit = F.create_map(*[F.lit(x) for name, (_, b) in open_.items() for x in (name, min(1.0, factor * bound / b))])
        chosen = rows.withColumn("p", place).where((F.col("p") / F.lit(2.0**64)) + 0.5 <= limit[F.col("l")])
        got = {name: _Sample(bound) for name in open_}
        sent = {name: cap for name, (cap, _) in open_.items()}
        for r in _firsts(chosen.select("l", "p", F.expr(f"left(t, {bound})").alias("t")), sent, bound).toLocalIterator():
            got[r.l].add(r.p, bytes(r.t))
        for name, sample in got.items():
            if sum(len(x) for _, x in sample.rows) >= min(bound, open_[name][1]) or factor * bound >= open_[name][1]:
                left, samples[name] = bound, []
                for _, data in sample.first():
                    samples[name].append(data[:left])
                    left -= len(samples[name][-1])
                del open_[name]
        factor *= 4
    return fit(samples, max_order)


def _firsts(rows: DataFrame, caps: dict[str, int], bound: int) -> DataFrame:
    """(l, p, t) of the rows of each task that may be among a language's first, their texts cut to what a row gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own: dict[str, _Sample] = {}
        for batch in batches:
            for name, p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values(batch.column(2)), strict=True):
                own.setdefault(name, _Sample(bound)).add(p, t[: caps[name]].encode("utf-8", "replace")[: caps[name]])
        for name, sample in own.items():
            first = sample.first()
            yield {"l": [name] * len(first), "p": [p for p, _ in first], "t": [data for _, data in first]}

    return arrow_iter(rows, run, "l string, p bigint, t binary")


def identify(docs: DataFrame, model: PPMModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    base = docs.select(*[docs[f"`{c}`"] for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["lang_pred string", "score double"])

    def step(batch: pa.RecordBatch) -> dict:
        m = sent.value
        got = [m.predict(t) for t in values(batch.column(text))]
        return {c: batch.column(c) for c in batch.schema.names} | {"lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}

    return arrow_map(base, step, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from rows whose id bucket (of 4) isn't 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(bucket("doc_id", 4) != 2))
    out = identify(plain(docs, "doc_id", "text"), model)
    # the prediction's input is the text alone; the id is carried along to name the row
    return out.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
