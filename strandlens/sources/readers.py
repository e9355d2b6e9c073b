"""Sensor logs and casting metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import strip_offset, with_plain_timestamp

# Marks in the file names of the two logs.
TEMPERATURE_LOG = "boExpert"
PROCESS_LOG = "dtExpert"

_PARQUET = "[pP][aA][rR][qQ][uU][eE][tT]"
_CSV = "[cC][sS][vV]"

# Columns of the casting metadata file.
METADATA_SCHEMA = T.StructType(
    [
        T.StructField("Casting ID", T.LongType()),
        T.StructField("Strand ID", T.IntegerType()),
        T.StructField("Datetime start first heat", T.StringType()),
        T.StructField("Datetime start last heat", T.StringType()),
        T.StructField("Quality casting", T.StringType()),
        T.StructField("Heat Count", T.IntegerType()),
    ]
)


def has_files(spark: SparkSession, folder: str, glob: str) -> bool:
    """Whether any file below ``folder`` matches; lists names, reads no content."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
    )
    return not listed.select("path").isEmpty()


def read_log(
    spark: SparkSession, folder: str, mark: str, schema: T.StructType | None = None
) -> DataFrame | None:
    """All files below ``folder`` whose name holds ``mark``, as one scan.

    Parquet files are read and CSV files ignored where there are any Parquet
    files; without either there is no log. A name that holds both marks belongs
    to the temperature log.
    """
    for extension, fmt in ((_PARQUET, "parquet"), (_CSV, "csv")):
        glob = f"*{mark}*.{extension}"
        if not has_files(spark, folder, glob):
            continue
        reader = (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob)
            .option("header", True)
        )
        reader = reader.schema(schema) if schema else reader.option("inferSchema", fmt == "csv")
        df = reader.format(fmt).load(folder)
        if mark != TEMPERATURE_LOG:
            df = df.filter(~F.col("_metadata.file_name").contains(TEMPERATURE_LOG))
        return with_plain_timestamp(df)
    return None


def read_logs(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    return read_log(spark, folder, TEMPERATURE_LOG), read_log(spark, folder, PROCESS_LOG)


def scan_files(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None
) -> DataFrame | None:
    """The named files as one scan, by the same Parquet-before-CSV rule."""
    parquet = [p for p in paths if p.lower().endswith(".parquet")]
    csv = [p for p in paths if p.lower().endswith(".csv")]
    reader = spark.read.schema(schema) if schema else spark.read
    if parquet:
        return with_plain_timestamp(reader.parquet(*parquet))
    if csv:
        reader = reader if schema else reader.option("inferSchema", True)
        return with_plain_timestamp(reader.option("header", True).csv(csv))
    return None


def read_metadata(
    spark: SparkSession, path: str, schema: T.StructType = METADATA_SCHEMA, local_time: bool = False
) -> DataFrame:
    """Casting metadata from a ``;``-separated file with ``ts_start``/``ts_end``.

    A time with an offset is an instant; with ``local_time`` the offset is
    dropped and the digits are taken as they stand.
    """
    df = spark.read.schema(schema).option("header", True).option("sep", ";").csv(path)

    def parse(name: str):
        return strip_offset(name) if local_time else F.col(f"`{name}`").try_cast("timestamp")

    return df.withColumns(
        {
            "ts_start": parse("Datetime start first heat"),
            "ts_end": parse("Datetime start last heat"),
        }
    )
