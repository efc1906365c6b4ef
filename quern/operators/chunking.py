"""Chunking: fixed windows in pure expressions; greedy packing as a fold within a row; markdown, speakers and code by row-wise generators.

Token counts come from a declared tokenizer (word characters); another may be passed where a function takes one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.functions import text as T


def fixed(docs: DataFrame, most: int = 512, overlap: int = 64, text: str = "text") -> DataFrame:
    """Windows of most words that overlap; a short text is one chunk. The last window ends the text."""
    words = docs.withColumn("w", T.tokens(F.col(text)))
    n, step = F.size("w"), most - overlap
    starts = F.when(n <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))
    out = words.select("document_id", "w", F.posexplode(starts).alias("chunk_index", "start"))
    part = F.slice(F.col("w"), F.col("start") + 1, F.lit(most))
    return out.select("document_id", "chunk_index", F.size(part).alias("token_count"), F.array_join(part, " ").alias("content"))


def packed(docs: DataFrame, most: int = 512, text: str = "text", delimiter: str = "\n") -> DataFrame:
    """Paragraphs (between delimiters) packed greedily in order; an oversized one is a chunk of its own, chunks without words drop out."""
    from quern.operators.chunkers import packs
    from quern.operators.located import generated

    def run(t: str | None) -> Iterator[tuple]:
        groups = ((used, delimiter.join(held)) for held, used in packs((t or "").split(delimiter), most))
        return ((j, *x) for j, x in enumerate(x for x in groups if x[0]))

    return generated(docs, "document_id", [text], "chunk_index int, token_count int, content string", run)


def packed_turns(turns: DataFrame, most: int = 512, reserve: int = 50) -> DataFrame:
    """Turns (document_id, turn, text) of each conversation packed greedily in order into chunks of at most most tokens.

    An oversized turn is a run of chunks of its own, windows of most - reserve tokens (room for a header) without overlap. Sorted rows are
    streamed through the fold, so no conversation becomes one row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    names = ["document_id", "chunk_index", "turns", "token_count", "first_turn", "last_turn"]
    schema = f"document_id {kinds['document_id']}, chunk_index int, turns bigint, token_count bigint, first_turn {kinds['turn']}, last_turn {kinds['turn']}"
    sized = turns.select("document_id", "turn", "text", F.coalesce(F.greatest(F.size(T.tokens(F.col("text"))), F.lit(0)), F.lit(0)).alias("n"))
    rows = sized.repartition("document_id").sortWithinPartitions("document_id", "turn", "text").select("document_id", "turn", "n")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chunk, now, index = [], None, (), 0

        def close() -> None:
            nonlocal chunk, index
            if chunk is not None:
                out.append((now[0], index, *chunk))
                chunk, index = None, index + 1

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            for document, turn, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (document,):
                    close()
                    now, index = (document,), 0
                if chunk is not None and chunk[1] + n > most:
                    close()
                if n > most:
                    for start in range(0, n, most - reserve):
                        chunk = (1, min(most - reserve, n - start), turn, turn)
                        close()
                elif chunk is None:
                    chunk = (1, n, turn, turn)
                else:
                    chunk = (chunk[0] + 1, chunk[1] + n, chunk[2], turn)
            yield taken()
        close()
        yield taken()

    return rows.mapInArrow(run, schema)


def code_fences(text: F.Column) -> F.Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)```.*?```"), F.lit(0))


# fixed values: marks of equations and of figures
EQUATIONS = (r"(?s)\$\$.*?\$\$", r"\$[^$]+\$", r"(?s)\\begin\{equation\}.*?\\end\{equation\}", r"(?s)\\begin\{align\}.*?\\end\{align\}", r"=\s*\d+")
FIGURES = (r"(?i)Figure\s+\d+", r"(?i)Fig\.\s*\d+", r"(?i)Table\s+\d+", r"(?i)\\begin\{figure\}", r"(?i)\\begin\{table\}")


def flags(text: F.Column) -> tuple[F.Column, F.Column]:
    """Whether a text has an equation, and whether it has a figure or a table."""
    return tuple(reduce(lambda a, b: a | b, [text.rlike(p) for p in ps]) for ps in (EQUATIONS, FIGURES))


HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)


def markdown_sections(text: str) -> list[tuple[int, str, str, int, int]]:
    """(level, name, body, start, end) of each heading's section; lines in code fences count as headings too."""
    found = list(HEADING.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(len(m[1]), m[2].strip(), text[m.end() : e].strip(), m.end(), e) for m, e in zip(found, ends, strict=True)]


SPEAKER = re.compile(r"^\*\*([^*\n]{2,60}?)\*\*(?:\s*\[?\(?(\d{1,2}:\d{2}(?::\d{2})?)\)?\]?)?\s*:?\s*", re.M)


def speaker_segments(text: str) -> list[tuple[str, str | None, str]]:
    """(speaker, time, words) by bold names; a plain-name line scan where there is none."""
    found = list(SPEAKER.finditer(text))
    if found:
        ends = [m.start() for m in found[1:]] + [len(text)]
        return [(m[1].strip().rstrip(":"), m[2], text[m.end() : e].strip()) for m, e in zip(found, ends, strict=True)]
    out: list[list] = []
    for line in text.split("\n"):
        m = re.match(r"^([A-Z][\w.'-]+(?: [A-Z][\w.'-]+){0,2}):\s*(.*)$", line)
        if m:
            out.append([m[1], None, m[2]])
        elif out and line.strip():
            out[-1][2] += "\n" + line.strip()
    return [tuple(x) for x in out]


def exploded(docs: DataFrame, split: Callable[[str], list[tuple]], schema: str, text: str = "text") -> DataFrame:
    """document_id, index and the fields of schema for each part that a row-wise splitter finds (Arrow batches)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, j, *part) for i, t in zip(batch["document_id"], batch[text], strict=True) for j, part in enumerate(split(t or ""))]
            yield pd.DataFrame(rows, columns=["document_id", "index", *names])

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", text).mapInPandas(run, f"document_id {kind}, index int, {schema}")


def code_units(text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of functions, methods and types by their opening lines, for brace and indent languages."""
    pattern = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+|async\s+|export\s+)*(func|fn|def|class|struct|type|trait|impl|interface)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", re.M)
    return [(m[1], m[2], text.count("\n", 0, m.start(1)) + 1) for m in pattern.finditer(text)]
