"""Structured outputs: timelines, argument maps, comparison tables and dependency views; aliases and query expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.substrings import containing

# fixed values: patterns of arguments for and against
PRO = (r"(?:benefit|advantage|pro|support|favor)[\s:]+([^.]+\.)", r"(?:improves?|enables?|allows?)[\s]+([^.]+\.)")
CON = (r"(?:drawback|disadvantage|con|against|concern)[\s:]+([^.]+\.)", r"(?:risks?|issues?|problems?)[\s:]+([^.]+\.)")
# fixed values: the order of strengths
STRENGTH = {"strong": 3, "moderate": 2, "weak": 1}


def timeline(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, found, day): dated events in order of day, unknown days last; a spelling that occurs twice is two events."""
    found = texts.select(key, F.explode(T.dates(F.col(text))).alias("found"))
    return found.withColumn("day", T.date_key(F.col("found"))).orderBy(F.asc_nulls_last("day"), key, "found")


def positions(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, side, claim, strength) of pro and con patterns, pattern by pattern; claims of over 20 characters, all of moderate strength."""

    def of(side: str, pattern: str) -> F.Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit("(?i)" + pattern), F.lit(1)), lambda c: F.struct(F.lit(side).alias("side"), F.trim(c).alias("claim")))

    parts = F.filter(F.flatten(F.array(*[of(side, p) for side, ps in (("pro", PRO), ("con", CON)) for p in ps])), lambda x: F.length(x["claim"]) > 20)
    return texts.select(key, F.posexplode(parts).alias("n", "p")).select(key, "n", "p.side", "p.claim", F.lit("moderate").alias("strength"))


def strength_order(strength: F.Column) -> F.Column:
    """3 to 1 from strong to weak; unknown ones count as moderate."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])[strength], F.lit(2))


def argument_summary(arguments: DataFrame, key: str) -> DataFrame:
    """Counts of sides, and the strongest claim of each by (strength, n)."""
    best = lambda side: F.min_by(F.when(F.col("side") == side, F.col("claim")), F.when(F.col("side") == side, F.struct(-strength_order(F.col("strength")), F.col("n"))))
    counts = [F.count_if(F.col("side") == x).alias(x) for x in ("pro", "con", "neutral")]
    return arguments.groupBy(key).agg(*counts, best("pro").alias("best_pro"), best("con").alias("best_con"))


def comparison(cells: DataFrame, entities: list[str], feature: str = "feature", entity: str = "entity", value: str = "value") -> DataFrame:
    """A row per feature, a column per entity, N/A where there is no cell; the first value of several by order."""
    return cells.groupBy(feature).pivot(entity, entities).agg(F.min(value)).na.fill("N/A")


def markdown_table(table: DataFrame) -> DataFrame:
    """The rows of a table as markdown lines, with their order."""
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *table.columns), F.lit(" |")).alias("line"))


def dependency_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One element per node and edge, as JSON for graph viewers."""
    n = nodes.select(F.to_json(F.struct(F.struct(F.col("id").cast("string").alias("id"), "kind").alias("data"))).alias("element"))
    e = edges.select(F.to_json(F.struct(F.struct(F.concat_ws("-", "src", "dst").alias("id"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target")).alias("data"))).alias("element"))
    return n.unionAll(e)


def alias_index(aliases: DataFrame) -> DataFrame:
    """(alias, number): names, aliases and spellings of a number, lower-cased; aliases has (number, names array)."""
    spelled = F.array(*[F.concat(F.lit(p), F.col("number")) for p in ("eip-", "eip ", "eip", "#")])
    return aliases.select("number", F.explode(F.array_distinct(F.concat(F.transform("names", F.lower), spelled))).alias("alias")).dropDuplicates(["alias", "number"])


def expand(queries: DataFrame, aliases: DataFrame, key: str = "id", text: str = "q") -> DataFrame:
    """(key, numbers): explicit numbers first, then those of alias names found inside the query, in order of number and name; any number of rows of either."""
    spelled = aliases.select("number", F.explode("names").alias("spelling")).select("number", "spelling", F.lower("spelling").alias("name"))
    asked = queries.select(key, F.lower(text).alias("_q"))
    hits = containing(spelled, asked, key=key, text="_q").join(spelled, "name")
    named = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct("number", "spelling"))), lambda x: x["number"]).alias("_n"))
    found = F.concat(F.coalesce(T.numbers(F.col(text)), F.array().cast("array<int>")).cast("array<int>"), F.coalesce(F.col("_n").cast("array<int>"), F.array().cast("array<int>")))
    return queries.join(named, key, "left").select(key, F.array_distinct(found).alias("numbers"))
