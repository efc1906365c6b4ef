"""Matches of patterns with their places and surroundings: dates, mentions, aliases, code and table spans.

Built-in expressions give matches without their places, so these are row-wise generators over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.functions import text as T

MOST_BATCH = 16 << 20  # bytes of a task's input at once
MOST_HELD = 4 << 20  # characters or bytes of rows that a task holds before it hands them on
MENTION = r"\bEIP[- ]?(\d+)\b"
CODE, TABLE = r"```[\s\S]*?```", r"(?:\|[^\n]+\|\n)+"
# fixed values: phrases that introduce an alias, with the names of their kinds
ALIASES = (
    (r"(?:also|sometimes)\s+(?:known|referred\s+to)\s+as\s+[\"']?([^\"'\.,]+)[\"']?", "known_as"),
    (r"commonly\s+called\s+[\"']?([^\"'\.,]+)[\"']?", "commonly_called"),
    (r"referred\s+to\s+as\s+[\"']?([^\"'\.,]+)[\"']?", "referred_as"),
    (r"nicknamed?\s+[\"']?([^\"'\.,]+)[\"']?", "nicknamed"),
    (r"dubbed\s+[\"']?([^\"'\.,]+)[\"']?", "dubbed"),
    (r"\((?:the\s+)?\"([^\"]+)\"\)", "parenthetical_quoted"),
    (r"\(a\.?k\.?a\.?\s+([^)]+)\)", "aka"),
)
PARENTHETICAL = r"EIP-?(\d+)\s*\(([^)]+)\)"
ACRONYM = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*\(([A-Z]{2,})\)"
# fixed values: words and openings that are no alias
NO_ALIAS, NO_OPENING = ("this", "that", "the", "a", "an", "it", "its", "which", "what", "where"), ("see ", "note ", "i.e.", "e.g.")


def small_batches(rows: DataFrame) -> DataFrame:
    """rows, whose Arrow batches are held to MOST_BATCH bytes."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(name, str(MOST_BATCH))).rstrip("b")) > MOST_BATCH:
        conf.set(name, f"{MOST_BATCH}b")
    return rows


def generated(rows: DataFrame, key: str, columns: list[str], schema: str, run: Callable[..., Iterator[tuple]]) -> DataFrame:
    """key and the fields of schema for each tuple that run yields for a row's columns."""
    kind = rows.schema[key].dataType.simpleString()
    target = to_arrow_schema(StructType.fromDDL(f"{key} {kind}, {schema}"))
    small_batches(rows)

    def made(out: list[tuple]) -> pa.RecordBatch:
        parts = zip(*out, strict=True) if out else [()] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(parts, target, strict=True)], schema=target)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row of the batch at a time, and what it gives in batches of bounded size
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                k, *values = (c[i].as_py() for c in batch.columns)
                for found in run(*values):
                    out.append((k, *found))
                    held += 100 + sum(len(x) for x in found if isinstance(x, str | bytes))
                    if held > MOST_HELD:
                        yield made(out)
                        out, held = [], 0
            yield made(out)

    return rows.select(key, *columns).mapInArrow(each, f"{key} {kind}, {schema}")


def located(texts: DataFrame, key: str, patterns: tuple[str, ...], text: str = "text", around: int = 100, group: int = 1, ignore_case: bool = True) -> DataFrame:
    """(key, pattern, n, found, start, end, context): all matches, pattern by pattern, with around characters on both sides."""
    compiled = [re.compile(p, re.I if ignore_case else 0) for p in patterns]

    def run(t: str | None) -> Iterator[tuple]:
        for j, p in enumerate(compiled):
            for n, m in enumerate(p.finditer(t or "")):
                yield j, n, m[min(group, p.groups)], m.start(), m.end(), t[max(0, m.start() - around) : m.end() + around].strip()

    return generated(texts, key, [text], "pattern int, n int, found string, start int, end int, context string", run)


def dated(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, found, context, ...): spellings of dates with 100 characters around."""
    return located(texts, key, T.DATES, text)


def mentions(texts: DataFrame, key: str, text: str = "text", around: int = 100) -> DataFrame:
    """(key, n, number, context): mentions with the words around them, dots where these are cut."""

    def run(t: str | None) -> Iterator[tuple]:
        for n, m in enumerate(re.finditer(MENTION, t or "", re.I)):
            a, b = max(0, m.start() - around), min(len(t), m.end() + around)
            yield n, int(m[1]), "..." * (a > 0) + " ".join(t[a:b].split()) + "..." * (b < len(t))

    return generated(texts, key, [text], "n int, number bigint, context string", run)


def structural_spans(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, n, start, end): fenced code, then tables."""
    found = located(texts, key, (CODE, TABLE), text, 0, 0)
    return found.select(key, F.when(F.col("pattern") == 0, "code").otherwise("table").alias("kind"), "n", "start", "end")


def inside(spans: DataFrame, positions: DataFrame, key: str, position: str = "position") -> DataFrame:
    """positions with in_code and in_table: whether they lie in a span of that kind."""
    at = positions.join(spans, key, "left").withColumn("_in", (F.col("start") <= F.col(position)) & (F.col(position) < F.col("end")))
    flags = [F.coalesce(F.bool_or(F.col("_in") & (F.col("kind") == k)), F.lit(False)).alias(f"in_{k}") for k in ("code", "table")]
    return at.groupBy(*positions.columns).agg(*flags)


def _rows(texts: DataFrame, key: str, number: str, text: str, patterns: tuple[str, ...], ignore_case: bool = True) -> DataFrame:
    """(_k, rule, n, found, start, context) of the patterns' whole matches; _k holds key and number."""
    keyed = texts.select(F.struct(F.col(key).alias("key"), F.col(number).alias("number")).alias("_k"), F.col(text).alias("_t"))
    return located(keyed, "_k", patterns, "_t", around=50, group=0, ignore_case=ignore_case).withColumnRenamed("pattern", "rule")


def _first(rows: DataFrame, same: str, key: str, *names: str) -> DataFrame:
    """Of candidates (_k, rule, n, part) the first with each value of same, numbered in order within _k."""
    order = ("rule", "n", "part")
    once = rows.withColumn("_r", F.row_number().over(W.partitionBy("_k", same).orderBy(*order))).where("_r = 1")
    return once.select(F.col("_k.key").alias(key), (F.row_number().over(W.partitionBy("_k").orderBy(*order)) - 1).alias("n"), *names)


def aliases(texts: DataFrame, key: str, number: str = "number", text: str = "text") -> DataFrame:
    """(key, n, canonical, alias, kind, context): what a proposal's text says it is called, the first of each spelling by rule and place. Keys are unique."""
    phrases = _rows(texts, key, number, text, (PARENTHETICAL, *[p for p, _ in ALIASES]))
    short = _rows(texts, key, number, text, (ACRONYM,), ignore_case=False)
    own = F.regexp_extract("found", f"(?i){PARENTHETICAL}", 1).try_cast("bigint") == F.col("_k.number")
    rules = F.create_map(*[x for j, (p, kind) in enumerate(ALIASES, 1) for x in (F.lit(j), F.struct(F.lit(f"(?i){p}").alias("p"), F.lit(kind).alias("kind")))])
    rule = rules[F.col("rule")]
    meant = F.when(F.col("rule") == 0, F.struct(F.regexp_extract("found", f"(?i){PARENTHETICAL}", 2).alias("alias"), F.lit("eip_parenthetical").alias("kind"), F.col("found").alias("context")))
    meant = meant.otherwise(F.struct(F.call_function("regexp_extract", F.col("found"), rule["p"], F.lit(1)).alias("alias"), rule["kind"].alias("kind"), F.col("context").alias("context")))
    said = phrases.where((F.col("rule") > 0) | own).select("_k", "rule", "n", F.lit(0).alias("part"), meant.alias("m"))
    said = said.select("_k", "rule", "n", "part", T.strip(F.col("m.alias")).alias("alias"), "m.kind", "m.context")
    low, size = F.lower("alias"), F.length("alias")
    openings = reduce(lambda x, y: x | y, [F.startswith(low, F.lit(o)) for o in NO_OPENING])
    said = said.where(size.between(2, 100) & ~F.col("alias").rlike(r"^[\d\s]+$") & ~low.isin(*NO_ALIAS) & ~openings)
    name, letters = F.regexp_extract("found", ACRONYM, 1), F.regexp_extract("found", ACRONYM, 2)
    spelled = short.where((F.length(letters) <= 8) & (F.size(F.split(name, r"\s+")) >= F.length(letters)))
    spelled = spelled.select("_k", F.lit(len(ALIASES) + 1).alias("rule"), "n", F.posexplode(F.array(name, letters)).alias("part", "alias"), F.lit("acronym_definition").alias("kind"), F.col("found").alias("context"))
    both = said.unionByName(spelled).withColumn("_low", F.lower("alias")).withColumn("canonical", F.concat(F.lit("EIP-"), F.col("_k.number").cast("string")))
    return _first(both, "_low", key, "canonical", "alias", "kind", "context")


def other_references(texts: DataFrame, key: str, number: str = "number", text: str = "text") -> DataFrame:
    """(key, n, other, context): other proposals that a text names; first those followed by a parenthesis, with it. Keys are unique."""
    found = _rows(texts, key, number, text, (PARENTHETICAL, r"EIP-?(\d+)"))
    other = F.regexp_extract("found", r"(?i)EIP-?(\d+)", 1).try_cast("bigint")
    inside = F.when(F.col("rule") == 0, T.strip(F.regexp_extract("found", f"(?i){PARENTHETICAL}", 2)))
    rows = found.select("_k", "rule", "n", F.lit(0).alias("part"), other.alias("other"), inside.alias("context"))
    return _first(rows.where(F.col("other") != F.col("_k.number")), "other", key, "other", "context")


def sentence_packs(t: str, most: int = 500, least: int = 50) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of sentences of at most most characters; one blank is counted between two sentences."""
    at = begin = size = 0

    def ended() -> Iterator[tuple[int, int]]:
        n = len(t[begin : begin + size].strip()) if size else 0
        if n >= least:
            yield begin, min(begin + n, len(t))

    for sentence in re.split(r"(?<=[.!?])\s+", t):
        if size + len(sentence) > most:
            yield from ended()
            begin, size = at, 0
        size += len(sentence) + 1
        at += len(sentence) + 1
    yield from ended()


def paragraphs(t: str, most: int = 500, least: int = 50) -> Iterator[tuple[int, int]]:
    """(start, end) of paragraphs of least to most characters."""
    for m in re.finditer(r"(?:(?!\n\n)[\s\S])+", t):
        part = m[0].strip()
        if least <= len(part) <= most:
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            yield start, start + len(part)


def candidate_spans(texts: DataFrame, key: str, text: str = "text", most: int = 500, overlap: int = 50, least: int = 50) -> DataFrame:
    """(key, kind, start, end): the whole of a short text; else sentence packs, windows that end at a blank, and paragraphs."""

    def run(t: str | None) -> Iterator[tuple]:
        t = t or ""
        if len(t) <= most:
            yield "whole", 0, len(t)
            return
        yield from (("sentences", a, b) for a, b in sentence_packs(t, most, least))
        for a in range(0, len(t) - least, most - overlap):
            b = min(a + most, len(t))
            blank = t.rfind(" ", a, b) if b < len(t) else -1
            b = blank if blank > a + least else b
            if b - a >= least:
                yield "window", a, b
        yield from (("paragraph", a, b) for a, b in paragraphs(t, most, least))

    return generated(texts, key, [text], "kind string, start int, end int", run)
