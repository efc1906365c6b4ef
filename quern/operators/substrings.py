"""Substring join of any size: which of many names does each text hold, wherever in a word.

A name is sought by its head, its first HEAD bytes (all of a shorter name). Where a head lies in a text, the parts of the text that begin there and are as long
as some name with that head are handed on, once each, and meet the names by an equi-join of their bytes. So a text is read once for a bounded number of
heads, whatever the number of names, and gives at most its places of heads times the lengths of their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.located import generated
from quern.scratch import written

HEAD = 4
MOST_HEADS = 200_000  # heads with a length that one pass over the texts looks for
MOST_PARTS = 10_000  # distinct parts that a task holds
SLOTS = 20  # bits of the hash that most places are told by


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS)


def _parts(pairs: list[tuple[bytes, int]]) -> Callable[[bytes | None], Iterator[tuple[bytes]]]:
    """What a text holds of the shape (head, length) of any of the pairs; a part may come again behind MOST_PARTS others."""
    shapes: dict[int, dict[int, list[int]]] = {}
    for head, length in pairs:
        shapes.setdefault(len(head), {}).setdefault(int.from_bytes(head, "big"), []).append(length)
    sought = {n: np.array(sorted(of), np.uint32) for n, of in shapes.items()}
    marks: dict[int, np.ndarray] = {}

    def run(text: bytes | None) -> Iterator[tuple[bytes]]:
        if not marks:  # in the task, as they are larger than what they are made of
            for n, of in sought.items():
                marks[n] = np.zeros(1 << SLOTS, bool)
                marks[n][_slots(of)] = True
        text = text or b""
        letters = np.frombuffer(text, np.uint8).astype(np.uint32)
        codes = letters
        for n in range(1, min(HEAD, len(text)) + 1):
            if n > 1:
                codes = (codes[:-1] << np.uint32(8)) | letters[n - 1 :]
            if n not in sought:
                continue
            at = marks[n][_slots(codes)].nonzero()[0]
            near = codes[at]
            here = sought[n][np.minimum(sought[n].searchsorted(near), len(sought[n]) - 1)] == near
            at, near = at[here].tolist(), near[here].tolist()
            if n < HEAD:  # such a head is a whole name
                yield from ((code.to_bytes(n, "big"),) for code in set(near))
                continue
            held: set[bytes] = set()
            for p, code in zip(at, near, strict=True):
                held.update([text[p : p + length] for length in shapes[n][code] if p + length <= len(text)])
                if len(held) >= MOST_PARTS:
                    yield from ((x,) for x in held)
                    held = set()
            yield from ((x,) for x in held)

    return run


def containing(names: DataFrame, texts: DataFrame, name: str = "name", key: str = "key", text: str = "text") -> DataFrame:
    """(key, name) once for each text that holds the name; empty and null names are in no text. Rows that share a key are read as several texts of it."""
    wanted = names.select(F.col(name).alias("name")).where("length(name) > 0").distinct().withColumn("part", F.col("name").cast("binary"))
    heads = written(wanted.select(F.substring("part", 1, HEAD).alias("head"), F.octet_length("part").alias("length")).distinct())
    passes = max(1, math.ceil(heads.count() / MOST_HEADS))
    read = texts.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    found = []
    for j in range(passes):
        pairs = [(bytes(r.head), r.length) for r in heads.where(F.pmod(F.xxhash64("head", "length"), F.lit(passes)) == j).collect()]
        found.append(generated(read, "key", ["text"], "part binary", _parts(pairs)))
    held = written(reduce(DataFrame.unionAll, found))
    # names that no text holds are left out first, so that frequent ones are few enough to be broadcast
    real = wanted.join(held.select("part").distinct(), "part")
    return held.join(real, "part").select("key", "name").distinct().withColumnsRenamed({"key": key, "name": name})
