"""Questions about the orders' keys, for query understanding: every rule's patterns occur, in both engines from one list."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.catalog import spread, table

#: {a} and {b} are numbers made of an order's keys
PHRASES = (
    "What is EIP-{a}?",
    "Compare EIP-{a} and EIP-{b}",
    "How did EIP-{a} evolve over time?",
    "Which chain of proposals depends on EIP-{a} and how do they relate to EIP-{b}?",
    "Show the pros and cons of EIP-{a}",
    "What does EIP-{a} require?",
    "what chain of things",
    "compare eip{a} and EIP-{b}",
    "Which pros and cons, EIP-{a} vs EIP-{b}?",
    "history of EIP-{a} depend",
    "history of EIP-{a} and EIP-{b} from the start",
    "timeline of blobs",
    "difference between proof of work and proof of stake",
    "How does EIP-{a} differ from EIP {b}?",
    "define blob",
    "explain the concept of gas",
    "gas cost of a transaction after the hard fork",
    "EIP-{a}, EIP-{b} and EIP-1559",
    "Is EIP-{a} better than EIP-{b} or worse, and which EIPs that use it are obsolete?",
    "Why did the group that proposed EIP-{a} decided on the base fee, and what are the trade-offs of that design decision for mainnet security and for the validator set over the next years?",
    "Give a comprehensive, in-depth analysis of the roadmap and the architecture upgrade",
    "Do EIP-{a} and EIP-{b} contradict each other? There is a debate",
    "carefully review the critical consensus change in production",
    "opposing views on rollups vs shards",
    "optimistic rollup or zk rollup",
    "what are the implications of EIP-{a}",
    "indirectly requires what EIP-{b} requires",
    "layer 1 versus layer 2",
    "who wrote this",
    "all the proposals that changed from draft to final before EIP-{a}",
    "what depends on EIP-{a}, with all dependents, deep",
    "direct dependencies of eip {a}",
    "account abstraction and the merge",
    "opinion on the tradeoff between fees and blob space",
    "summarise several EIPs: EIP-{a}, EIP-{b}, EIP-{a}",
    "evolution of EIP-{a} to EIP-{b}?",
    "Contrast EIP-{a} with the similarities between others",
)


_real = ContextVar("real", default=False)


def on_real_rows(query):
    """The same query over REAL in place of the phrases."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        mark = _real.set(True)
        try:
            return query(spark, d)
        finally:
            _real.reset(mark)

    return run


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations and whole documents as queries, under the names of the phrases' columns."""
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("q"))
    turns = turns.select((F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("o_orderkey"), F.col("turn").cast("bigint").alias("o_custkey"), "q")
    docs = spread(table(spark, d, "documents")).select((-1 - F.col("doc_id")).alias("o_orderkey"), (F.col("doc_id") % 100).alias("o_custkey"), F.col("text").alias("q"))
    return turns.unionByName(docs).where("q IS NOT NULL")


REAL = "q AS (SELECT * FROM (SELECT (conv_id * 1000 + turn)::BIGINT AS o_orderkey, turn::BIGINT AS o_custkey, min(text) AS q FROM conversations GROUP BY conv_id, turn UNION ALL SELECT -1 - doc_id, doc_id % 100, text FROM documents) WHERE q IS NOT NULL)"


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, o_custkey, q): the phrases with numbers of the orders."""
    if _real.get():
        return _texts(spark, d)
    text = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("o_orderkey") % len(PHRASES) + 1).cast("int"))
    for mark, number in (("{a}", F.col("o_orderkey") % 97), ("{b}", F.col("o_custkey") % 89)):
        text = F.replace(text, F.lit(mark), number.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", text.alias("q"))


_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
ASKED = f"q AS (SELECT o_orderkey, o_custkey, replace(replace(({_LIST})[o_orderkey % {len(PHRASES)} + 1], '{{a}}', (o_orderkey % 97)::VARCHAR), '{{b}}', (o_custkey % 89)::VARCHAR) AS q FROM orders)"


def sql_sum(patterns: tuple[str, ...], text: str) -> str:
    """How many of the patterns a text matches, in SQL."""
    return "(" + " + ".join(f"regexp_matches({text}, '(?i){p.replace(chr(39), chr(39) * 2)}')::INTEGER" for p in patterns) + ")"


def sql_any(words: tuple[str, ...], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"
