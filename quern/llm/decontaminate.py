"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters (at least ``min_chars``) has an error budget of k = floor(max_error * n) edits, k lowered so that
pieces keep ``min_piece`` characters. It is split into k + 1 pieces; wherever it occurs with at most k edits one piece
occurs unchanged. One automaton finds all exact piece hits of a text, hits of an item on near diagonals are merged into
windows, and Myers' bit-parallel algorithm gives each window's smallest edit distance. So every occurrence
within the budget is found and nothing else is reported.

Texts are compared in lower case with every white space character as a blank, character by character, so positions are
those of the text. The items are a query set: they are sent in blocks of at most ``block_chars`` characters, each
of which passes over all documents once; a worker builds a block's automaton once, for all its tasks.

Cases: null and empty texts hold nothing; null items and blank ones are never found, items below min_chars only with
``short``, and then exactly, without the blanks around them and on word borders;
items with equal text are all reported; repeated documents alike; null ids pass through; an empty side gives no rows.
Result: for each document and item it holds, the smallest distance and its first occurrence. Only named columns are read.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_iter, mapped, plain

_OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def normal(text: str) -> str:
    """Lower case and blanks, of the same length as text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    return _OTHER_SPACE.sub(" ", low.replace("\n", " ").replace("\t", " ").replace("\r", " "))


def budget(n: int, max_error: float, min_piece: int) -> int:
    return max(0, min(int(n * max_error + 1e-9), n // min_piece - 1))


def split(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    ends = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for j, c in enumerate(pattern):
        out[c] |= 1 << j
    return out


def myers(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """Edit distances of pattern to the best substring of text ending at each position (anchored: to each prefix)."""
    m, masks = len(pattern), _masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, carry = full, 0, m, int(anchored)
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | carry) & full
        pv = ((mh << 1) | (full & ~(xv | ph))) & full
        mv = ph & xv
        yield score


def _bordered(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end."""
    over = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not over(start) and not over(end)


_last: list = [None, None]


def shared_matcher(key: object, items: list[str], limits: tuple) -> Matcher:
    """The worker's matcher of a block of items: built once for all its tasks, dropped for the next block's."""
    if _last[0] != key:
        _last[:] = None, None
        _last[:] = key, Matcher(items, *limits)
    return _last[1]


class Matcher:
    """Finds items (numbered texts) within their error budgets."""

    def __init__(self, items: list[str], max_error: float = 0.05, min_chars: int = 20, min_piece: int = 8, short: bool = False):
        import ahocorasick

        self.items = [normal(x) for x in items]
        self.budgets = [budget(len(x), max_error, min_piece) for x in self.items]
        hits: dict[str, list] = defaultdict(list)
        self.short = {j for j, x in enumerate(self.items) if short and len(x) < min_chars and x.strip()}
        for j in self.short:
            self.items[j], self.budgets[j] = self.items[j].strip(), 0
            hits[self.items[j]].append((j, len(self.items[j]) - 1))
        for j, x in enumerate(self.items):
            if j not in self.short and len(x) >= min_chars and x.strip():
                for at, piece in split(x, self.budgets[j]):
                    hits[piece].append((j, at + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, where)
        self.any = bool(hits)
        if self.any:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item's best occurrence, the first of equals."""
        if not text or not self.any:
            return []
        t = normal(text)
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, where in self.automaton.iter(t):
            for j, last in where:
                diagonals[j].add(end - last)
        return [(j, *best) for j, ds in sorted(diagonals.items()) if (best := self._best(j, sorted(ds), t))]

    def _best(self, j: int, diagonals: list[int], t: str) -> tuple[int, int, int] | None:
        item, k = self.items[j], self.budgets[j]
        for d in diagonals:  # an exact occurrence can't be beaten
            if d >= 0 and t.startswith(item, d) and (j not in self.short or _bordered(t, d, d + len(item))):
                return 0, d, d + len(item)
        if not k:
            return None
        best, windows = None, []
        for d in diagonals:
            low, high = max(0, d - k), min(len(t), d + len(item) + k)
            if windows and low <= windows[-1][1]:
                windows[-1][1] = max(high, windows[-1][1])
            else:
                windows.append([low, high])
        for low, high in windows:
            for at, distance in enumerate(myers(item, t[low:high])):
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, low + at + 1)
        if best is None:
            return None
        distance, end = best
        back = t[max(0, end - len(item) - distance) : end][::-1]
        length = next((n for n, x in enumerate(myers(item[::-1], back, anchored=True), 1) if x == distance), len(back))
        return distance, end - length, end


def contaminated(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.05, min_chars: int = 20, min_piece: int = 8, block_chars: int = 4_000_000, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", short: bool = False) -> DataFrame:
    """doc_id, item_id, distance, start, end: the items that each document holds within their error budgets."""
    base = plain(docs, id_col, text).toDF("doc_id", "text").where("text IS NOT NULL")
    types = [x.schema[c].dataType.simpleString() for x, c in ((base, "doc_id"), (benchmark, item_col))]
    schema = "doc_id {}, item_id {}, distance int, start int, end int".format(*types)
    parts = [_search(base, rows, (max_error, min_chars, min_piece, short), schema) for rows in blocks(benchmark, item_col, item_text, 1 if short else min_chars, block_chars)]
    return reduce(DataFrame.unionAll, parts)


def blocks(benchmark: DataFrame, item_col: str, item_text: str, min_chars: int, block_chars: int) -> Iterator[list[tuple]]:
    """The items (id, text), block by block; about block_chars characters are on the driver at a time. At least one block."""
    items = plain(benchmark, item_col, item_text).toDF("item_id", "item").where(F.length("item") >= min_chars)
    n = max(1, -(-(items.agg(F.sum(F.length("item"))).first()[0] or 0) // block_chars))
    for b in range(n):
        yield [(r.item_id, r.item) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b).orderBy("item_id", "item").collect()]


def _search(base: DataFrame, rows: list[tuple], limits: tuple, schema: str) -> DataFrame:
    sent, key = base.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, matcher = [r[0] for r in sent.value], shared_matcher(key, [r[1] for r in sent.value], limits)
        for batch in batches:
            found = [(i, *hit) for i, t in enumerate(batch.column(1)) for hit in matcher.find(t.as_py())]
            at, item, distance, start, end = zip(*found, strict=True) if found else [()] * 5
            yield {"doc_id": batch.column(0).take(pa.array(at, pa.int64())), "item_id": [ids[j] for j in item], "distance": distance, "start": start, "end": end}

    return arrow_iter(base, run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.05, min_chars: int = 20, min_piece: int = 8, block_chars: int = 4_000_000, text: str = "text", item_col: str = "item_id", item_text: str = "text", short: bool = False) -> DataFrame:
    """The rows of docs that hold no item: a filter row by row, without a shuffle; null texts stay."""
    for rows in blocks(benchmark, item_col, item_text, 1 if short else min_chars, block_chars):
        docs = _keep_clean(docs, rows, (max_error, min_chars, min_piece, short), text)
    return docs


def _keep_clean(docs: DataFrame, rows: list[tuple], limits: tuple, text: str) -> DataFrame:
    sent, key = docs.sparkSession.sparkContext.broadcast([r[1] for r in rows]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared_matcher(key, sent.value, limits)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(text)], pa.bool_()))

    return mapped(docs, run, docs.schema)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """The benchmark items in all documents."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)
