"""Secret scans: three patterns, and password guess costs on values in credential contexts.

Patterns (kinds assign, access, hex) are matched over the whole text, leftmost and non-overlapping per kind; a match
that is too short is dropped but still uses up its text. Kind ``guess`` are values after a credential word (a wider
list than the pattern's) whose guess cost is at least ``min_log10_guesses``: a dynamic programme finds the
cheapest segmentation of the value into dictionary words (also with look-alike characters or capitals), dates, repeated
units, character sequences, keyboard walks and brute-force spans, where a segmentation costs the product of its parts' guesses
times the factorial of their number. A value that isn't reported may be the credential word of the next one. Values of any length
are searched for a segmentation below the bound, which is exact and takes time in proportion to the value.

The dictionary is the common words of passwords, then the words of the corpus itself by how often they occur (``dictionary``), which
tells values from prose: runs of 3 to 20 letters that stand in a share of all documents, without those right behind a credential word.

Cases: null and empty texts have no spans (counts 0, the hash of the empty text); overlapping kinds are all
reported; repeated rows alike; ids pass through, null or not; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, plain, values, written

KINDS = ("assign", "access", "hex", "guess")

# fixed values: the patterns
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?)"
    r"[\"']?\x20{0,4}(?:[:=]|=>|\x20is\x20|\x20)\x20{0,4}[\"']?([^\s\"'<>,;]{6,})",
    re.I | re.A,
)
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")

# fixed values: common words of passwords, most frequent first
COMMON = (
    "password 123456 qwerty admin welcome letmein login monkey dragon master hello freedom whatever shadow sunshine princess "
    "football baseball superman batman trustno iloveyou starwars access secret summer winter spring autumn love test guest root user "
    "default changeme example sample token apikey key pass demo temp public private server client service system account company "
    "please none null true false your here insert value string text file name code data word world house money happy lucky orange "
    "banana apple cherry flower garden silver golden purple yellow green black white blue red one two three four five six seven eight nine ten"
).split()
RANK = {w: j + 1 for j, w in enumerate(COMMON)}
_LEAST, _MOST = 3, 20  # letters of a dictionary word
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d)")

_KEYS = {c: (y, 2 * x + y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}


def _adjacent(a: str, b: str) -> bool:
    p, q = _KEYS.get(a), _KEYS.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 2


def _alphabet(value: str) -> int:
    return 10 * any(c.isdigit() for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 33 * any(not c.isalnum() for c in value)


class _Segments:
    """Candidate segments besides brute force that cost less than a bound, by their start; starts must be asked for in ascending order."""

    def __init__(self, value: str, below: float, rank: dict[str, int]):
        self.value, self.low, self.below, self.rank = value, value.lower(), below, rank
        self.plainer, self.ends = self.low.translate(LOOKALIKES), {}

    def _end(self, key: object, i: int, first: int, goes_on: Callable[[int], bool]) -> int:
        """Where the longest run from i ends whose characters from first on go on; a run is walked once."""
        j = self.ends.get(key, 0)
        if j < first:
            j = first
            while j < len(self.value) and goes_on(j):
                j += 1
            self.ends[key] = j
        return j

    def of(self, i: int) -> list[tuple[int, str, float]]:
        """(end, what, log10 of guesses)"""
        value, low, rank, n, out = self.value, self.low, self.rank, len(self.value), []
        if len(low) == n:  # a letter whose lower case is longer has no place here
            for j in range(i + _LEAST, min(n, i + _MOST) + 1):
                exact, alike = rank.get(low[i:j]), rank.get(self.plainer[i:j])
                if exact or alike:
                    upper = sum(c.isupper() for c in value[i:j])
                    out.append((j, "word", math.log10(exact or alike) + (0 if exact else 1) + (0 if not upper else 0.3 if upper in (1, j - i) else 1.5)))
        else:
            low = value
        if m := DATE.match(value, i):
            out.append((m.end(), "date", math.log10(365 * 120) if m.end() - i > 4 else math.log10(120)))
        for unit in range(1, (n - i) // 2 + 1):
            if unit >= self.below:  # each character costs 1 at least
                break
            times = (self._end(unit, i, i + unit, lambda j: value[j] == value[j - unit]) - i) // unit  # noqa: B023
            if times > 1 and unit * times >= 3:
                out.append((i + unit * times, "repeat", unit * math.log10(max(10, _alphabet(value[i : i + unit]))) + math.log10(times)))
        step = ord(low[i + 1]) - ord(low[i]) if i + 1 < n else 0
        if step in (-1, 1):
            j = self._end(("sequence", step), i, i + 1, lambda j: ord(low[j]) - ord(low[j - 1]) == step)
            if j - i >= 3:
                out.append((j, "sequence", math.log10(26 * (j - i))))
        j = self._end("walk", i, i + 1, lambda j: _adjacent(low[j - 1], low[j]))
        if j - i >= 4:
            out.append((j, "walk", math.log10(47) + 0.5 * (j - i)))
        return [(j, what, max(0.05, cost)) for j, what, cost in out if cost < self.below]


def _cheapest(value: str, below: float, rank: dict[str, int]) -> tuple[float, tuple] | None:
    """The cheapest segmentation that costs less than below, and its parts as a chain from the last one; None without one.

    Only ways that can still stay below the bound are followed, so with a fixed bound the time is in proportion to the value.
    """
    n, per, segments = len(value), math.log10(max(10, _alphabet(value))), _Segments(value, below, rank)
    orders = [0.0]  # log10 of m!
    reached: dict[int, dict[int, tuple[float, tuple]]] = {0: {0: (0.0, ())}}  # cheapest way to cover value[:j] with m parts
    spans: dict[int, tuple[int, float, tuple]] = {}  # by m: the start of the cheapest open brute-force span, the cost up to there
    for j in range(n + 1):
        here = reached.pop(j, {})
        for m, (i, so_far, chain) in list(spans.items()):
            cost = so_far + (j - i) * per
            if cost + orders[m + 1] >= below:
                del spans[m]
            elif m + 1 not in here or cost < here[m + 1][0]:
                here[m + 1] = cost, (chain, i, j, "brute")
        if j == n:
            ends = [(cost + orders[m], chain) for m, (cost, chain) in here.items() if cost + orders[m] < below]
            return min(ends, key=lambda x: x[0]) if ends else None
        if not here and not spans and not reached:
            return None
        follow = segments.of(j) if here else []
        for m, (cost, chain) in here.items():
            while len(orders) <= m + 2:
                orders.append(orders[-1] + math.log10(len(orders)))
            if not (chain and chain[3] == "brute") and (m not in spans or cost < spans[m][1] + (j - spans[m][0]) * per):
                spans[m] = (j, cost, chain)
            for end, what, more in follow:
                total = cost + more
                if total + orders[m + 1] < below:
                    ways = reached.setdefault(end, {})
                    if m + 1 not in ways or total < ways[m + 1][0]:
                        ways[m + 1] = total, (chain, j, end, what)


def guess_cost(value: str, rank: dict[str, int] = RANK) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses of the cheapest segmentation, and that segmentation: (start, end, what)."""
    brute = len(value) * math.log10(max(10, _alphabet(value)))
    found = _cheapest(value, brute, rank) if value else None
    if found is None:
        return brute, [(0, len(value), "brute")] if value else []
    out, chain = [], found[1]
    while chain:
        chain, *part = chain
        out.append(tuple(part))
    return found[0], out[::-1]


def guessable(value: str, below: float, rank: dict[str, int] = RANK) -> bool:
    """Whether some segmentation of value, however long it is, costs less than below."""
    return _cheapest(value, below, rank) is not None


_VALUE = r"(?:pass|pwd|secret|token|key|auth|bearer|credential)[\p{L}\p{N}_-]{0,12}[\"']?\x20{0,4}(?:[:=]|=>|\x20is\x20|\x20)\x20{0,4}[\"']?[^\s\"'<>,;]+"


def dictionary(docs: DataFrame, text: str = "text", most: int = 20_000, least_share: float = 1e-4, least_docs: int = 5) -> dict[str, int]:
    """Ranks of words: the common ones of passwords, then the ``most`` most frequent words (letters only) of docs that occur in
    least_share of all documents, and in least_docs at least. Words right behind a credential word don't count. Of
    equally frequent words the alphabetically first are taken.

    Counted over all texts on the executors; the driver gets at most ``most`` words.
    """
    base = plain(docs, text).toDF("t").where("t IS NOT NULL").select(F.lower("t").alias("t"))
    hinted = reduce(lambda a, b: a | b, [F.contains("t", F.lit(h)) for h in HINTS])
    rest = F.when(hinted, F.regexp_replace("t", _VALUE, " ")).otherwise(F.col("t"))
    found = F.array_distinct(F.regexp_extract_all(rest, F.lit(r"(?<![\p{L}\p{N}_])\p{L}{%d,%d}(?![\p{L}\p{N}_])" % (_LEAST, _MOST)), F.lit(0)))
    counted = base.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    least = max(least_docs, math.ceil(least_share * base.count()))
    kept = written(counted.where(F.col("n") >= least))
    words = [r.w for r in kept.orderBy(F.desc("n"), "w").limit(most).collect()]
    return RANK | {w: len(RANK) + j for j, w in enumerate((w for w in words if w not in RANK), 1)}


def scan(text: str | None, min_log10_guesses: float = 10.0, rank: dict[str, int] = RANK) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind."""
    if not text:
        return []
    low, found = text.lower(), []
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        m = CONTEXT.search(text)
        while m:
            value = m[1].rstrip(".)]}")
            secret = len(value) >= 8 and not guessable(value, min_log10_guesses, rank)
            if secret:
                found.append((m.start(1), m.start(1) + len(value), "guess"))
            # a value that is no secret may be a credential word itself
            m = CONTEXT.search(text, m.end() if secret else m.start(1))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, text: str = "text", min_log10_guesses: float = 10.0, rank: dict[str, int] | None = None) -> DataFrame:
    """docs with secrets: an array of (start, end, kind), code points with the end exclusive. rank: a dictionary, else that of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text) if rank is None else rank)
    kept = [c for c in docs.columns if c != "secrets"]
    base = docs.select(*[docs[f"`{c}`"] for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["secrets array<struct<start:int,end:int,kind:string>>"])

    def step(batch: pa.RecordBatch) -> dict:
        spans = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t, min_log10_guesses, sent.value)] for t in values(batch.column(text))]
        return {c: batch.column(c) for c in batch.schema.names} | {"secrets": spans}

    return arrow_map(base, step, schema)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str | None, spans: list[tuple[int, int, str]], placeholder: str = "[secret]") -> str | None:
    """text with each run of overlapping spans replaced."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], placeholder]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", placeholder: str = "[secret]", min_log10_guesses: float = 10.0, rank: dict[str, int] | None = None) -> DataFrame:
    """docs with their secrets replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text) if rank is None else rank)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def step(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in batch.schema.names} | {text: [redacted(t, scan(t, min_log10_guesses, sent.value), placeholder) for t in values(batch.column(text))]}

    return arrow_map(docs, step, schema)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document's secrets."""
    found = find_secrets(plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(text(of(*KINDS[:3])), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"), counts[3])
