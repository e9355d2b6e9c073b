"""How the driver tables play the roles of a sensor plant.

``events``   the signal: strand = event type, level and speed = value, one
             current from the JSON property
``lineitem`` rows of parallel sensors
``orders``   with its line items a table of finished windows
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import any_flag, disturbance_label
from ..operators.ordered import fit_chunks, with_position
from ..spec import AnalysisConfig, SignalSpec

SPEC = SignalSpec(
    keys=("strand",),
    ts="ts",
    tiebreak=("event_id",),
    speed="speed",
    width="width",
    depth="depth",
    level="level",
    quality="quality",
    gas=("gas_a", "gas_b"),
    currents=("k",),
)

CFG = AnalysisConfig(
    window_size=6,
    speed_threshold=60.0,
    current_threshold=90.0,
    max_gap_seconds=7200,
    excursion_threshold=40.0,
    excursion_min_duration_s=3,
    drift_min_run_s=4,
    drift_min_amplitude=150.0,
    bump_k_amp=2.0,
    bump_min_amplitude=60.0,
    bump_min_duration_s=2,
    bump_max_duration_s=10,
    variability_ptp=280.0,
    variability_band=60.0,
    variability_fraction=0.2,
)

SEQ_ROWS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHUNK_ROWS = 2_000_000


@lru_cache(maxsize=64)
def _fitted(session: SparkSession, sf_dir: str, keys: tuple[str, ...], max_rows: int) -> SignalSpec:
    rows = signal(session, sf_dir).select(*SPEC.keys, *SPEC.order)
    return fit_chunks(rows, replace(SPEC, keys=keys), max_rows)


def fitted(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = SPEC.keys) -> SignalSpec:
    """The signal's roles, with chunks fitted to the rows of this folder."""
    return _fitted(spark, sf_dir, keys, CHUNK_ROWS)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    user, value = F.col("user_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("strand"),
        "ts",
        "event_id",
        "user_id",
        value.alias("level"),
        value.alias("speed"),
        k.alias("k"),
        (1.0 + (user % 100) / 80.0).alias("width"),
        (0.1 + (F.col("event_id") % 17) / 100.0).alias("depth"),
        F.nullif(k, F.lit(50.0)).alias("gas_a"),
        (value / 10).alias("gas_b"),
        F.when(user % 7 != 0, F.concat(1 + user % 6, F.lit("A"))).alias("quality"),
    )


SIGNAL = """signal AS (
  SELECT event_type AS strand, ts, event_id, user_id, value AS level, value AS speed, k,
         1.0 + (user_id % 100) / 80.0 AS width, 0.1 + (event_id % 17) / 100.0 AS depth,
         NULLIF(k, 50.0) AS gas_a, value / 10 AS gas_b,
         CASE WHEN user_id % 7 <> 0 THEN CONCAT(1 + user_id % 6, 'A') END AS quality
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""


def seq_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal cut into windows of a fixed number of rows."""
    placed = with_position(signal(spark, sf_dir), SPEC.keys, SPEC.order, fitted(spark, sf_dir).chunk())
    return placed.withColumn("seq_id", F.floor(F.col("pos") / SEQ_ROWS).cast("bigint"))


SEQ_KEYS = ["strand", "seq_id"]

SEQ_ROWS_SQL = f"""{SIGNAL},
seq_rows AS (
  SELECT *, pos // {SEQ_ROWS} AS seq_id FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY strand ORDER BY ts, event_id) - 1 AS pos FROM signal))"""


def seq_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        seq_rows(spark, sf_dir)
        .groupBy(*SEQ_KEYS)
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.stddev_samp("level").alias("sigma"),
        )
    )


SEQ_BOUNDS_SQL = f"""{SEQ_ROWS_SQL},
seq_bounds AS (
  SELECT strand, seq_id, MIN(ts) AS start_ts, MAX(ts) AS end_ts, STDDEV_SAMP(level) AS sigma
  FROM seq_rows GROUP BY strand, seq_id)"""


def _castings(days: DataFrame) -> DataFrame:
    number = F.datediff("day", F.lit("2024-01-01").cast("date")).cast("bigint") + 1
    start = F.col("day").cast("timestamp_ntz")
    return (
        days.filter(F.dayofmonth("day") % 3 != 0)
        .withColumn("casting_id", number)
        .withColumns(
            {
                "ts_start": start + F.expr("interval 6 hours"),
                "ts_end": start + F.expr("interval 18 hours"),
                "grade": F.concat(1 + F.col("casting_id") % 6, F.lit("-"), F.col("casting_id")),
            }
        )
        .drop("day")
    )


def castings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One casting on two days out of three, from 6 to 18 o'clock."""
    events = table(spark, sf_dir, "events")
    return _castings(events.select(F.to_date("ts").alias("day")).distinct())


def strand_castings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _castings(
        events.select(F.col("event_type").alias("strand"), F.to_date("ts").alias("day")).distinct()
    )


def _castings_sql(name: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key} casting_id, ts_start, ts_end, CONCAT(1 + casting_id % 6, '-', casting_id) AS grade
  FROM (SELECT {key} DATE_DIFF('day', DATE '2024-01-01', day) + 1 AS casting_id,
               CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR AS ts_start,
               CAST(day AS TIMESTAMP) + INTERVAL 18 HOUR AS ts_end
        FROM (SELECT DISTINCT {key.replace('strand', 'event_type AS strand')} CAST(ts AS DATE) AS day FROM events)
        WHERE DAY(day) % 3 <> 0))"""


CASTINGS = _castings_sql("castings", "")
STRAND_CASTINGS = _castings_sql("strand_castings", "strand,")


def windows_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finished window per order, with flags, label and grade."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            # Rounded, so that equal spreads are equal whatever order they sum in.
            F.round(F.stddev_samp("l_quantity") / 10, 9).alias("sigma"),
            (F.max("l_quantity") - F.min("l_quantity")).alias("ptp"),
            (F.avg("l_discount") * 20 + 0.5).alias("speed"),
            (F.avg("l_extendedprice") / 59999 + 0.8).alias("width"),
            (F.avg("l_tax") * 1000 + 100).alias("depth"),
            (F.max("l_quantity") > 48).alias("has_excursion_event"),
            (F.min("l_quantity") < 3).alias("has_slow_drift"),
            (F.max("l_discount") >= 0.1).alias("has_transient_bump"),
            (F.max("l_quantity") - F.min("l_quantity") > 40).alias("has_high_variability"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq_id"),
        F.col("o_orderstatus").alias("strand"),
        F.col("o_orderdate").alias("start_ts"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderpriority")).alias("grade"),
    )
    joined = orders.join(lines, orders.seq_id == lines.l_orderkey).drop("l_orderkey")
    return joined.withColumn("has_disturbance", any_flag()).withColumn("label", disturbance_label())


WINDOWS_TABLE = """windows AS (
  SELECT *, has_excursion_event OR has_slow_drift OR has_transient_bump OR has_high_variability AS has_disturbance,
         CASE WHEN NOT (has_excursion_event OR has_slow_drift OR has_transient_bump OR has_high_variability)
              THEN 'Normal' ELSE CONCAT_WS(' + ',
                CASE WHEN has_excursion_event THEN 'Excursion' END,
                CASE WHEN has_slow_drift THEN 'Slow drift' END,
                CASE WHEN has_transient_bump THEN 'Transient bump' END,
                CASE WHEN has_high_variability THEN 'High variability' END) END AS label
  FROM (SELECT o_orderkey AS seq_id, o_orderstatus AS strand, o_orderdate AS start_ts,
               CASE WHEN o_custkey % 11 <> 0 THEN o_orderpriority END AS grade, l.*
        FROM orders JOIN (
          SELECT l_orderkey, COUNT(*) AS n, ROUND(STDDEV_SAMP(l_quantity) / 10, 9) AS sigma,
                 MAX(l_quantity) - MIN(l_quantity) AS ptp, AVG(l_discount) * 20 + 0.5 AS speed,
                 AVG(l_extendedprice) / 59999 + 0.8 AS width, AVG(l_tax) * 1000 + 100 AS depth,
                 MAX(l_quantity) > 48 AS has_excursion_event, MIN(l_quantity) < 3 AS has_slow_drift,
                 MAX(l_discount) >= 0.1 AS has_transient_bump,
                 MAX(l_quantity) - MIN(l_quantity) > 40 AS has_high_variability
          FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey))"""
