"""Readers of text sources. Paths go to Spark's readers only, so any store that Spark opens will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"


def whole_texts(spark: SparkSession, path: str, glob: str = "*.md", exclude: str | None = None, least: int = 0) -> DataFrame:
    """(path, text) of every file below a folder, without excluded paths (a pattern) and short bodies."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    out = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.length(F.trim("value")) >= least)
    return out if exclude is None else out.where(~F.col("path").rlike(exclude))


def front_matter(text: Column) -> Column:
    """Flat front matter as a map; empty without it. The first of equal names counts."""
    lines = F.filter(F.split(F.regexp_extract(text, FRONT, 1), r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z][\w-]*\s*:"))
    pair = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^:]+):", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(pair, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pair, lambda p: p["k"] == k), 1)["v"]))


def body(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, FRONT, ""))


def proposals(spark: SparkSession, path: str, prefix: str = "eip") -> DataFrame:
    """number, title, status, type, category, author, created, requires (ints) and body of numbered markdown proposals."""
    rows = whole_texts(spark, path, f"{prefix}-*.md").withColumn("number", F.regexp_extract("path", rf"{prefix}-(\d+)\.md$", 1).try_cast("int")).where("number IS NOT NULL")
    m = rows.withColumn("m", front_matter(F.col("text")))
    requires = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(F.col("m")["requires"], F.lit("")), r"[\[\]]", ""), r"[,\s]+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    fields = [F.col("m")[c].alias(c) for c in ("title", "status", "type", "category", "author", "created")]
    return m.select("number", *fields, requires.alias("requires"), body(F.col("text")).alias("body"))


def specs(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """Markdown files: title (first heading, else the file's name), category (the folder above), body of 50 characters or more."""
    rows = whole_texts(spark, path, "*.md", exclude, 50)
    stem = F.initcap(F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.md$", 1), "[-_]", " "))
    return rows.select("path", F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1), F.lit("")), stem).alias("title"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"), "text")


def forks(path: Column) -> Column:
    """The fork of a file of a spec repository: its folder; _features/x becomes feature-x."""
    feature = F.regexp_extract(path, r"/_features/([^/]+)/", 1)
    return F.when(feature != "", F.concat(F.lit("feature-"), feature)).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped and bad ones are null rows, which are dropped."""
    return spark.read.schema(schema).json(path).dropna("all")


def code_files(spark: SparkSession, path: str, extensions: tuple[str, ...], exclude: str = r"/(?:vendor|testdata|\.git|node_modules)/") -> DataFrame:
    rows = whole_texts(spark, path, "*")
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return rows.where(ext.isin(list(extensions)) & ~F.col("path").rlike(exclude)).withColumn("language", ext)


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries (id, title, summary, published) of Atom files; repeated ids once."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, summary string, published string").load(path)
    clean = [F.trim(F.regexp_replace(c, r"\s+", " ")).alias(c) for c in ("id", "title", "summary", "published")]
    return rows.select(*clean).dropDuplicates(["id"])


def upsert_table(spark: SparkSession, path: str, rows: DataFrame, key: str, update: list[str], order: str) -> None:
    """Keyed upsert into a Parquet table: the new state is written beside the old one whole, then takes its place by renaming.

    A writer that was stopped between the two leaves the new state, which the next one puts in place first.
    """
    from quern.operators.tables import upsert

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old_path, new_path = (jvm.org.apache.hadoop.fs.Path(p) for p in (path.rstrip("/"), path.rstrip("/") + "__new"))
    files = old_path.getFileSystem(conf)
    if files.exists(new_path) and not files.exists(old_path):
        files.rename(new_path, old_path)
    old = spark.read.parquet(path) if files.exists(old_path) else rows.limit(0)
    upsert(old, rows, key, update, order).write.mode("overwrite").parquet(str(new_path))
    files.delete(old_path, True)
    files.rename(new_path, old_path)
