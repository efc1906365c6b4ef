"""Text expressions: columns in, columns out, all evaluated by the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: each match begins where the last one ended, so a long text without a stop is read once
SENTENCE = r"\G[.!?]*+([^.!?]++[.!?]++)"
NUMBER = r"(?i)eip[- ]?(\d+)"


def tokens(text: Column) -> Column:
    """Lower-cased word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def runs(words: Column, n: int) -> Column:
    """Runs of n words, repeated ones too; fewer words make one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words; fewer words make one shingle, none make none."""
    return F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs(words, n)))


def sentences(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1)), lambda s: F.trim(s))


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(16))


def rough_tokens(text: Column) -> Column:
    return (F.length(text) / 4).cast("int") + 1


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\u0000", "")


def numbers(text: Column) -> Column:
    """Sorted distinct proposal numbers that a text mentions."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(found))


def number_list(text: Column) -> Column:
    """Reference lists written as an int, a list or a string: all runs of digits between separators."""
    return F.filter(F.transform(F.split(text, r"[,\s]+"), lambda x: F.expr("NULL") if x is None else x.try_cast("int")), lambda x: x.isNotNull())


def slug(text: Column, n: int = 50) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s-]", ""), r"[\s-]+", "-"), F.lit(n))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets given as arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_f1(a: Column, b: Column) -> Column:
    """F1 of the distinct words of an answer and of what was expected."""
    both = F.size(F.array_intersect(a, b))
    p, r = both / F.size(F.array_distinct(a)), both / F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def markers(text: Column) -> Column:
    """Citation numbers of markers such as [1] and [1, 2], in order, repeated ones too."""
    inside = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.flatten(F.transform(inside, lambda m: F.transform(F.split(m, r"\s*,\s*"), lambda x: x.cast("int"))))


def first_section(*columns: Column) -> Column:
    """The first column that isn't empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: fixed values: date spellings
DATES = (
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b(\d{4}/\d{2}/\d{2})\b",
    rf"\b((?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\b",
    rf"\b(\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})\b",
    r"\b(Q[1-4]\s+\d{4})\b",
    r"\b(\d{4})\b",
)


def dates(text: Column) -> Column:
    """All spellings of dates in a text, pattern by pattern, as often as they occur."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in DATES]))


def date_key(text: Column) -> Column:
    """A sortable date: ISO, slashes, month names, the start of a quarter or of the year that comes first; null if none fits."""
    named = F.initcap(text)
    quarter = F.concat(F.regexp_extract(text, r"^[Qq]\d\s+(\d{4})", 1), F.lit("-"), F.lpad((F.regexp_extract(text, r"^[Qq](\d)", 1).try_cast("int") * 3 - 2).cast("string"), 2, "0"), F.lit("-01"))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd")]
    tries += [F.try_to_timestamp(named, F.lit(f)) for f in ("MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy")]
    tries += [F.try_to_timestamp(quarter, F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4})", 1), F.lit("yyyy"))]
    # spellings that no pattern finds, but that events may come with
    tries += [F.try_to_timestamp(text, F.lit("M/d/yyyy")), F.try_to_timestamp(named, F.lit("MMM yyyy"))]
    return F.coalesce(*tries).cast("date")


def source_type(document_id: Column) -> Column:
    low = F.lower(document_id)
    return F.when(F.startswith(low, F.lit("eip-")), "eip").when(F.contains(low, F.lit("magicians")) | F.contains(low, F.lit("forum")), "forum").when(F.contains(low, F.lit("research")), "research").otherwise("document")
