"""Tables on shared storage: their schemas, creation, layout, and state kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "document_id string, title string, status string, type string, category string, author string, created string, requires array<int>, metadata string, git_commit string, updated_at timestamp",
    "chunks": "chunk_id string, document_id string, chunk_index int, section_path string, content string, token_count int, embedding array<float>, metadata string, git_commit string, created_at timestamp",
    "edges": "src bigint, dst bigint, type string, confidence double, evidence array<string>, inferred_at timestamp, source_hash string",
    "migrations": "version int, name string, applied_at timestamp",
    "sync_state": "source string, last_sync string, last_commit string, last_cursor string, docs_synced bigint, errors bigint",
    "calibration": "kind string, boundary double, value double, fitted_at string",
    "experiments": "experiment string, name string, place int, variant string, weight double, strategy string, status string, changed string",
    "results": "experiment string, variant string, query string, quality double, latency double, cost double, feedback int, at string",
    "snapshots": "version string, accuracy double, recall_at_k double, citation_accuracy double, latency_p50_ms double, latency_p99_ms double, cost_per_query double, eval_count int, at string",
    "aliases": "place int, number int, canonical string, name string, aliases array<string>",
}
#: tables that are kept as JSON lines and only appended to
LINES = ("calibration", "experiments", "results", "snapshots", "aliases", "sync_state")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def create_tables(spark: SparkSession, root: str) -> list[str]:
    """Makes the Parquet tables that aren't there yet, empty; their names."""
    made = []
    for name, schema in SCHEMAS.items():
        if name not in LINES and not _there(spark, f"{root}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
            made.append(name)
    return made


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table by name; no rows where nothing was written yet, lines that can't be read dropped."""
    path, schema = f"{root}/{name}", SCHEMAS[name]
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).dropna("all") if name in LINES else spark.read.schema(schema).parquet(path)


def append(rows: DataFrame, root: str, name: str) -> None:
    """Adds rows; columns that a table has and rows lack are null."""
    whole = rows.sparkSession.createDataFrame([], SCHEMAS[name]).unionByName(rows, allowMissingColumns=True)
    writer = whole.write.mode("append")
    (writer.json if name in LINES else writer.parquet)(f"{root}/{name}")


def latest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last line of each key."""
    columns = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(columns, F.struct(at, F.to_json(columns))).alias("_r")).select("_r.*")


def rebuilt(spark: SparkSession, root: str, name: str, key: str, parts: int) -> None:
    """Lays a Parquet table out anew: equal keys side by side in one of parts files, sorted, so that a scan for a key skips the rest."""
    path = f"{root}/{name}"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    load(spark, root, name).repartition(parts, key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}__new")
    files.delete(fs_path(path), True)
    files.rename(fs_path(f"{path}__new"), fs_path(path))


def dropped(spark: SparkSession, root: str, name: str) -> None:
    """Empties a table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if name not in LINES:
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(f"{root}/{name}")
