"""Scratch tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """A folder that all executors share: below spark.checkpoint.dir, or where that is unset below the warehouse (a temporary folder in local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        base = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    elif not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_quern_scratch"
    path = f"{base.rstrip('/')}/quern-{spark.sparkContext.applicationId}"
    if not _scratch:
        atexit.register(clear_scratch)
    _scratch.add(path)
    return path


def new_scratch(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again."""
    path = new_scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch() -> None:
    """Deletes every scratch table of this session; results that still read one are lost."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in list(_scratch):
            _delete(spark, path)
            _scratch.discard(path)
    except Exception:  # the session may be down by now
        _scratch.clear()
