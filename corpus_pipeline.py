"""From raw documents to packed training sequences: five stages, each an operator of quern.llm.

Every stage but the last returns the columns of documents; what it rejects or rewrites is so for all later stages.

In every stage: rows with null ids, and null or empty texts, are rows like others (they have no shingles, items or secrets, and score as
texts without terms), so they stay up to packing, which gives a null or empty text its end id alone; texts of any length are read whole;
an empty table gives an empty one; further columns of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, neardup, packing, secrets, toxicity
from quern.llm.common import bucket, plain, written

REJECT = 0.7  # toxicity score
MOST_BROADCAST = 1_000_000  # ids
PLACEHOLDER = "[secret]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below REJECT; labels are learned from id buckets other than 1 of 3.

    Repeated rows get equal scores, so they stay or go together. Without labels nothing goes.
    """
    seen = bucket("doc_id", 3) != 1
    labels = plain(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic")
    model = toxicity.train(docs.where(seen), labels.where(seen), docs)
    # the model sees texts alone, so that further columns can't clash with its own
    names = [f"c{j}" for j in range(len(docs.columns))]
    found = toxicity.score(docs.toDF(*names), model, text=names[docs.columns.index("text")])
    return found.where(F.col("score") < REJECT).select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows without id stay.

    Rows that share an id are one document; the smallest of them (compared as JSON) stays.
    """
    found = neardup.near_duplicates(docs, width=5, percent=80)
    gone = written(found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct())
    out = docs.join(_sized(gone), docs["doc_id"] == gone["_gone"], "left_anti")
    again = written(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again"))
    if again.isEmpty():
        return out
    # rows that share an id are one document: the smallest row, as text
    rows = out.join(_sized(again), out["doc_id"] == again["_again"], "left_semi").select(F.col("doc_id").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    once = rows.groupBy("_id").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return out.join(_sized(again), out["doc_id"] == again["_again"], "left_anti").unionByName(once)


def _sized(ids: DataFrame) -> DataFrame:
    """Broadcast if it is small enough; else the join shuffles."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; repeated rows stay or go together, and without items all stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each run of overlapping secrets replaced by PLACEHOLDER; n_chars follows the text."""
    out = secrets.redact(docs, placeholder=PLACEHOLDER)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, kept_runs=300_000)  # the workers hold what earlier stages left, too


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]

#: No SQL expresses these stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
