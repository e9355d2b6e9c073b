"""Writing results: files, catalog tables, and a scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_names

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The session's own folder inside the shared one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session in one process gets a temporary folder, removed when Python ends. On a cluster it is an
    error: executors would each write to a disk of their own."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/strandlens-{spark.sparkContext.applicationId}"


@lru_cache(maxsize=1)
def _local_root() -> str:
    folder = tempfile.mkdtemp(prefix="strandlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the session's scratch folder; frames that read from it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared scratch folder and go on from
    the files: it is worked out once, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Header row; times keep their microseconds."""
    times = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    writer = df.write.mode(mode).option("header", True)
    writer.option("timestampNTZFormat", times).option("timestampFormat", times + "XXX").csv(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error"
) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_report(report: DataFrame, path: str, title: str, mode: str = "error") -> None:
    """The figures of ``reports.summary_report`` as lines of text. A report has
    a dozen figures and one line per label, so it is one small file."""
    share = F.when(F.col("pct").isNotNull(), F.format_string(" (%.1f%%)", "pct"))
    line = F.concat_ws("", F.format_string("%s / %s: %.3f", "section", "item", "value"), share)
    lines = report.select("section", "item", line.alias("line"))
    head = report.sparkSession.createDataFrame(
        [("", "", title)], "section string, item string, line string"
    )
    ordered = head.unionByName(lines).coalesce(1).sortWithinPartitions("section", "item")
    ordered.select("line").write.mode(mode).text(path)


def table_name(database: str, base: str, strand_id: str) -> str:
    safe = re.sub(r"\W", "_", f"{base}_strand_{strand_id}")
    return f"{database}.{safe}"


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")


def save_new_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Save under catalog-safe column names; an existing table is an error."""
    writer = clean_names(df).write.format("parquet").mode("errorifexists")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def replace_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Save over an existing table, its schema included."""
    writer = clean_names(df).write.format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
