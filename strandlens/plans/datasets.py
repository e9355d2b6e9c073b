"""Parameterised SQL over the result tables, as a dashboard runs it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path

ALL = "All"
DAY = "day"


def _quoted(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def series_window(
    spark: SparkSession,
    signal: DataFrame,
    ts: str,
    columns: Sequence[str],
    start: str,
    end: str,
    limit: int | None = None,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The rows of a time range, in time order; with ``limit`` only the first ones.

    For a limit, hourly counts tell by which hour the limit is reached; rows of later hours
    are dropped at the scan and never meet in the task that sorts.
    """
    inside = f"`{ts}` BETWEEN CAST(:start_date AS TIMESTAMP_NTZ) AND CAST(:end_date AS TIMESTAMP_NTZ)"
    if limit is None:
        return spark.sql(
            f"""SELECT `{ts}` AS time, {_quoted(columns)} FROM {{signal}} WHERE {inside}
                ORDER BY {_quoted([ts, *tiebreak])}""",
            args={"start_date": start, "end_date": end},
            signal=signal,
        )
    return spark.sql(
        f"""WITH hours AS (
              SELECT date_trunc('HOUR', `{ts}`) AS h, count(*) AS n FROM {{signal}} WHERE {inside} GROUP BY 1),
            reached AS (
              SELECT min(h) AS h FROM (SELECT h, sum(n) OVER (ORDER BY h) AS upto FROM hours) WHERE upto >= {int(limit)})
            SELECT `{ts}` AS time, {_quoted(columns)} FROM {{signal}}
            WHERE {inside}
              AND date_trunc('HOUR', `{ts}`) <= coalesce((SELECT h FROM reached), date_trunc('HOUR', CAST(:end_date AS TIMESTAMP_NTZ)))
            ORDER BY {_quoted([ts, *tiebreak])} LIMIT {int(limit)}""",
        args={"start_date": start, "end_date": end},
        signal=signal,
    )


def parameter_correlations(
    spark: SparkSession, sequences: DataFrame, columns: dict[str, str], label: str, wanted: str
) -> DataFrame:
    """Window-level parameters of one label, or of all of them."""
    shown = ", ".join(f"`{c}` AS `{alias}`" for c, alias in columns.items())
    return spark.sql(
        f"""SELECT {shown}, `{label}` AS disturbance_type FROM {{sequences}}
            WHERE `{label}` = :wanted OR :wanted = '{ALL}'""",
        args={"wanted": wanted},
        sequences=sequences,
    )


def grades(
    spark: SparkSession, sequences: DataFrame, columns: dict[str, str], grade: str
) -> DataFrame:
    """Window-level parameters of the windows with a grade."""
    shown = ", ".join(f"`{c}` AS `{alias}`" for c, alias in columns.items())
    return spark.sql(
        f"SELECT `{grade}` AS quality_grade, {shown} FROM {{sequences}} WHERE `{grade}` IS NOT NULL",
        sequences=sequences,
    )


def by_day(signal: DataFrame, ts: str, name: str = "by-day") -> DataFrame:
    """The signal in the scratch folder, a folder per day (column ``day``): a time range then opens its own days only."""
    days = signal.withColumn(DAY, F.to_date(F.col(f"`{ts}`")))
    path = scratch_path(signal.sparkSession, name)
    # Rows of a day go to several tasks, so that a busy day isn't one task's.
    days.repartition(F.col(DAY), F.pmod(F.xxhash64(f"`{ts}`"), F.lit(8))).write.partitionBy(DAY).parquet(path)
    return signal.sparkSession.read.schema(days.schema).parquet(path)


def sequence_detail(
    spark: SparkSession,
    signal: DataFrame,
    sequences: DataFrame,
    ts: str,
    columns: Sequence[str],
    name: str,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The rows of one named window of each strand, with its label, spread and grade, in time order.

    The bounds of the windows of that name are looked up first (one row) and stand in the query as values, so the scan of the
    signal gets them: row groups are skipped by time, and folders by day where the signal has a ``day`` column (see ``by_day``)."""
    shown = ", ".join(f"s.`{c}`" for c in columns)
    bounds = spark.sql(
        """SELECT CAST(min(Seq_time_Start) AS STRING) AS a, CAST(max(Seq_time_End) AS STRING) AS b
           FROM {sequences} WHERE Seq_Name = :name""",
        args={"name": name},
        sequences=sequences,
    ).first()
    day = f"AND s.`{DAY}` BETWEEN CAST(:first AS DATE) AND CAST(:last AS DATE)" if DAY in signal.columns else ""
    order = ", ".join(f"s.`{c}`" for c in [ts, *tiebreak])
    return spark.sql(
        f"""SELECT s.`{ts}` AS time, {shown}, q.disturbance_type, q.`MOLD_LEVEL_std [mm]` AS sequence_sigma, q.`Quality casting`
            FROM {{signal}} s JOIN {{sequences}} q
              ON s.strand = q.strand AND s.`{ts}` BETWEEN q.Seq_time_Start AND q.Seq_time_End
            WHERE q.Seq_Name = :name AND s.`{ts}` BETWEEN CAST(:first AS TIMESTAMP_NTZ) AND CAST(:last AS TIMESTAMP_NTZ) {day}
            ORDER BY {order}""",
        args={"name": name, "first": bounds["a"], "last": bounds["b"]},
        signal=signal,
        sequences=sequences,
    )
