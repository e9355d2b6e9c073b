"""Joins of logs, castings, gaps and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timing import utc_to_local
from ..operators import intervals as I
from ..operators import ordered as O
from ..operators import reports as R
from ..operators import stats as S
from ..plans.datasets import by_day
from ..plans.datasets import sequence_detail as sequence_detail_sql
from ..plans.pipeline import join_logs as join_two_logs
from ..sources.sinks import stage
from .registry import query
from .tables import (
    CASTINGS,
    SEQ_BOUNDS_SQL,
    SEQ_ROWS_SQL,
    SIGNAL,
    SPEC,
    STRAND_CASTINGS,
    castings,
    fitted,
    seq_bounds,
    signal,
    strand_castings,
    table,
)

DAY = 86_400
GAP_SECONDS = 1200

GAPS = f"""gaps AS (
  SELECT event_id, prev_timestamp, ts, time_diff_seconds, time_diff_seconds / 3600 AS time_diff_hours FROM (
    SELECT event_id, ts, LAG(ts) OVER (ORDER BY ts, event_id) AS prev_timestamp,
           epoch_us(ts) // 1000000 - epoch_us(LAG(ts) OVER (ORDER BY ts, event_id)) // 1000000 AS time_diff_seconds
    FROM events) WHERE time_diff_seconds > {GAP_SECONDS})"""


def deltas(spark, sf):
    """Steps between neighbouring rows of all strands together."""
    rows = table(spark, sf, "events").select("ts", "event_id")
    return O.time_deltas(rows, [], ["ts", "event_id"], fitted(spark, sf, ()).chunk())


def long_gaps(spark, sf):
    return O.significant_gaps(deltas(spark, sf), GAP_SECONDS)


JOIN_LOGS = """SELECT a.ts, a.level, b.speed, b.event_id FROM
         (SELECT DATE_TRUNC('hour', ts) AS ts, AVG(value) AS level FROM events
          WHERE COALESCE(event_type <> 'purchase', TRUE) GROUP BY ALL) a
         JOIN (SELECT DATE_TRUNC('hour', ts) AS ts, value AS speed, event_id FROM events
               WHERE event_type = 'purchase') b ON a.ts = b.ts"""


def two_logs(spark, sf):
    """Purchases as the process log, all other events as the temperature log, down to hours."""
    events = table(spark, sf, "events").withColumn(
        "ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")
    )
    process = F.coalesce(F.col("event_type") == "purchase", F.lit(False))
    first = events.filter(~process).select("ts", F.col("value").alias("level"))
    second = events.filter(process).select("ts", F.col("value").alias("speed"), "event_id")
    return S.downsample(first, ["ts"]), second


@query("join_logs", JOIN_LOGS, "level speed")
def join_logs(spark, sf):
    return join_two_logs(*two_logs(spark, sf), ["ts"])


@query(
    "join_logs_kept",
    f"""WITH j AS ({JOIN_LOGS}) SELECT ts, COUNT(*) AS n, AVG(speed) AS speed, MAX(level) AS level,
          (SELECT COUNT(*) FROM j) AS joined_rows FROM j GROUP BY ts""",
    "speed level",
)
def join_logs_kept(spark, sf):
    """The joined logs kept for several uses: staged once, then counted and averaged."""
    joined = stage(join_two_logs(*two_logs(spark, sf), ["ts"]), "joined-logs")
    means = joined.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("speed"), F.max("level").alias("level"))
    return means.withColumn("joined_rows", joined.select(F.count(F.lit(1))).scalar())


def _double_id(df):
    """A nullable integer reads differently in different clients; a double does not."""
    return df.withColumn("casting_id", F.col("casting_id").cast("double"))


CASTING_JOIN = """SELECT s.event_id, s.strand, s.ts, c.grade, c.casting_id FROM signal s
  LEFT JOIN strand_castings c ON s.strand = c.strand AND s.ts BETWEEN c.ts_start AND c.ts_end"""


def labelled(spark, sf):
    points = signal(spark, sf).select("event_id", "strand", "ts")
    return I.attach(
        points, strand_castings(spark, sf), "ts", "ts_start", "ts_end",
        ["grade", "casting_id"], keys=["strand"],
    )


@query(
    "join_casting",
    f"""WITH {SIGNAL}, {STRAND_CASTINGS}, j AS ({CASTING_JOIN})
        SELECT * REPLACE (CAST(casting_id AS DOUBLE) AS casting_id) FROM j""",
)
def join_casting(spark, sf):
    return _double_id(labelled(spark, sf))


@query(
    "join_casting_unkeyed",
    f"""WITH {STRAND_CASTINGS} SELECT e.event_id, c.grade FROM events e
        LEFT JOIN strand_castings c ON e.ts BETWEEN c.ts_start AND c.ts_end""",
)
def join_casting_unkeyed(spark, sf):
    """Castings of all strands: a row repeats for every strand that casts."""
    points = table(spark, sf, "events").select("event_id", "ts")
    return I.attach(
        points, strand_castings(spark, sf), "ts", "ts_start", "ts_end", ["grade"]
    ).select("event_id", "grade")


@query(
    "join_casting_local",
    f"""WITH {CASTINGS} SELECT e.event_id, e.local_ts, CAST(c.casting_id AS DOUBLE) AS casting_id, c.grade FROM
          (SELECT event_id, timezone('Europe/Amsterdam', timezone('UTC', ts)) AS local_ts FROM events) e
        LEFT JOIN castings c ON e.local_ts BETWEEN c.ts_start AND c.ts_end""",
)
def join_casting_local(spark, sf):
    points = table(spark, sf, "events").select("event_id", utc_to_local("ts").alias("local_ts"))
    known = castings(spark, sf).na.drop(subset=["ts_start", "ts_end"])
    return _double_id(
        I.attach(points, known, "local_ts", "ts_start", "ts_end", ["casting_id", "grade"])
    )


CLASSIFIED = f"""classified AS (
  SELECT g.event_id, g.prev_timestamp, g.ts, g.time_diff_hours, c.casting_id,
         CASE WHEN c.casting_id IS NOT NULL THEN 'Within Casting' ELSE 'Between Castings' END AS gap_type
  FROM gaps g LEFT JOIN castings c ON g.prev_timestamp BETWEEN c.ts_start AND c.ts_end
                                  AND g.ts BETWEEN c.ts_start AND c.ts_end)"""


def classified(spark, sf):
    gaps = long_gaps(spark, sf).select("event_id", "prev_timestamp", "ts", "time_diff_hours")
    out = I.classify_gaps(
        gaps, castings(spark, sf), "prev_timestamp", "ts", "ts_start", "ts_end", "casting_id"
    )
    return out.drop("ts_start", "ts_end", "grade")


@query("classify_gaps", f"WITH {GAPS}, {CASTINGS}, {CLASSIFIED} SELECT * REPLACE (CAST(casting_id AS DOUBLE) AS casting_id) FROM classified", "time_diff_hours")
def classify_gaps(spark, sf):
    return _double_id(classified(spark, sf))


@query(
    "gap_class_summary",
    f"""WITH {GAPS}, {CASTINGS}, {CLASSIFIED} SELECT gap_type, COUNT(*) AS count,
        SUM(time_diff_hours) AS total_hours, AVG(time_diff_hours) AS avg_hours FROM classified GROUP BY gap_type""",
    "total_hours avg_hours",
)
def gap_class_summary(spark, sf):
    return R.gap_class_summary(classified(spark, sf))


@query(
    "orphan_points",
    f"""WITH {SIGNAL}, {STRAND_CASTINGS}, j AS ({CASTING_JOIN})
        SELECT strand, COUNT(*) AS total_data_points, COUNT(casting_id) AS matched_to_casting,
               COUNT(*) - COUNT(casting_id) AS orphan_points,
               MIN(CASE WHEN casting_id IS NULL THEN ts END) AS first_orphan,
               MAX(CASE WHEN casting_id IS NULL THEN ts END) AS last_orphan
        FROM j GROUP BY strand""",
)
def orphan_points(spark, sf):
    orphan = F.col("casting_id").isNull()
    return labelled(spark, sf).groupBy("strand").agg(
        F.count(F.lit(1)).alias("total_data_points"),
        F.count("casting_id").alias("matched_to_casting"),
        F.count_if(orphan).alias("orphan_points"),
        F.min(F.when(orphan, F.col("ts"))).alias("first_orphan"),
        F.max(F.when(orphan, F.col("ts"))).alias("last_orphan"),
    )


COVERED = f"""covered AS (
  SELECT c.strand, c.casting_id, c.ts_start, c.ts_end, COUNT(e.ts) AS data_point_count,
         MIN(e.ts) AS first_data, MAX(e.ts) AS last_data,
         CASE WHEN COUNT(e.ts) = 0 THEN 'NO DATA' WHEN MIN(e.ts) > c.ts_start THEN 'LATE START'
              WHEN MAX(e.ts) < c.ts_end THEN 'EARLY END' ELSE 'FULL COVERAGE' END AS coverage_status
  FROM strand_castings c LEFT JOIN points e
    ON e.strand = c.strand AND e.ts BETWEEN c.ts_start AND c.ts_end
  GROUP BY c.strand, c.casting_id, c.ts_start, c.ts_end)"""

# Points are moved and castings added so that all four states occur: some points lie on a casting's start or end, and a fifth
# of the castings is planned again for days long after the last event.
POINTS = """points AS (
  SELECT strand, CASE WHEN user_id % 29 = 0 AND HOUR(ts) < 12 THEN LEAST(ts, DATE_TRUNC('day', ts) + INTERVAL 6 HOUR)
                      WHEN user_id % 31 = 0 AND HOUR(ts) >= 12 THEN GREATEST(ts, DATE_TRUNC('day', ts) + INTERVAL 18 HOUR)
                      ELSE ts END AS ts
  FROM signal)"""
PLANNED = f"""{STRAND_CASTINGS.replace('strand_castings AS', 'past_castings AS', 1)}, strand_castings AS (
  SELECT * FROM past_castings UNION ALL
  SELECT strand, casting_id + 100000, ts_start + INTERVAL 4000 DAY, ts_end + INTERVAL 4000 DAY, grade FROM past_castings WHERE casting_id % 5 = 0)"""


def planned_castings(spark, sf):
    past = strand_castings(spark, sf)
    later = past.filter(F.col("casting_id") % 5 == 0).withColumns({
        "casting_id": F.col("casting_id") + 100_000,
        **{c: F.col(c) + F.expr("interval 4000 days") for c in ("ts_start", "ts_end")},
    })
    return past.unionByName(later)


def covered(spark, sf):
    s = signal(spark, sf)
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    six, eighteen = (day + F.expr(f"interval {h} hours") for h in (6, 18))
    moved = (
        F.when((F.col("user_id") % 29 == 0) & (F.hour("ts") < 12), F.least(F.col("ts"), six))
        .when((F.col("user_id") % 31 == 0) & (F.hour("ts") >= 12), F.greatest(F.col("ts"), eighteen))
        .otherwise(F.col("ts"))
    )
    points = s.select("strand", moved.alias("ts"))
    return I.coverage(
        points, planned_castings(spark, sf).drop("grade"), "ts", "ts_start", "ts_end",
        ["strand", "casting_id"], keys=["strand"],
    )


@query("casting_coverage", f"WITH {SIGNAL}, {POINTS}, {PLANNED}, {COVERED} SELECT * FROM covered")
def casting_coverage(spark, sf):
    return covered(spark, sf)


@query(
    "coverage_status",
    f"""WITH {SIGNAL}, {POINTS}, {PLANNED}, {COVERED}
        SELECT coverage_status, COUNT(*) AS count FROM covered GROUP BY coverage_status""",
)
def coverage_status(spark, sf):
    return R.value_counts(covered(spark, sf), "coverage_status").withColumnRenamed("n", "count")


@query(
    "coverage_mismatch",
    f"""WITH {SIGNAL}, {POINTS}, {PLANNED}, {COVERED}
        SELECT *, (epoch_us(ts_end) // 1000000 - epoch_us(ts_start) // 1000000) / 3600 AS expected_duration_hours,
               (epoch_us(first_data) // 1000000 - epoch_us(ts_start) // 1000000) / 3600 AS data_start_delay_hours,
               (epoch_us(ts_end) // 1000000 - epoch_us(last_data) // 1000000) / 3600 AS data_end_early_hours
        FROM covered WHERE coverage_status <> 'FULL COVERAGE'""",
    "expected_duration_hours data_start_delay_hours data_end_early_hours",
)
def coverage_mismatch(spark, sf):
    return I.coverage_mismatch(covered(spark, sf), "ts_start", "ts_end")


@query(
    "gap_overlap_semi",
    f"""WITH {GAPS}, {CASTINGS} SELECT event_id, prev_timestamp, ts FROM gaps g WHERE EXISTS (
          SELECT 1 FROM castings c WHERE c.ts_start <= g.ts AND c.ts_end >= g.prev_timestamp)""",
)
def gap_overlap_semi(spark, sf):
    gaps = long_gaps(spark, sf).select("event_id", "prev_timestamp", "ts")
    return I.overlaps_any(
        gaps, castings(spark, sf), ("prev_timestamp", "ts"), ("ts_start", "ts_end"), ["event_id"]
    )


@query(
    "points_in_castings",
    f"""WITH {CASTINGS} SELECT event_id, ts FROM events e WHERE EXISTS (
          SELECT 1 FROM castings c WHERE e.ts BETWEEN c.ts_start AND c.ts_end)""",
)
def points_in_castings(spark, sf):
    points = table(spark, sf, "events").select("event_id", "ts")
    bounds = castings(spark, sf).select("ts_start", "ts_end")
    return I.join_points(points, bounds, "ts", "ts_start", "ts_end", how="left_semi")


def detail(spark, sf):
    rows = signal(spark, sf).select("strand", "event_id", "ts", "level", "k", "gas_a", "gas_b", "speed")
    return I.join_points(
        rows, seq_bounds(spark, sf), "ts", "start_ts", "end_ts", ["strand"], 2 * 3_600, "inner"
    )


DETAIL = """detail AS (
  SELECT s.strand, s.event_id, s.ts, s.level, s.k, s.gas_a, s.gas_b, s.speed, q.seq_id, q.sigma
  FROM signal s JOIN seq_bounds q ON s.strand = q.strand AND s.ts BETWEEN q.start_ts AND q.end_ts)"""


@query(
    "sequence_detail",
    f"WITH {SEQ_BOUNDS_SQL}, {DETAIL} SELECT strand, seq_id, event_id, ts, level, sigma FROM detail",
    "level sigma",
)
def sequence_detail(spark, sf):
    return detail(spark, sf).select("strand", "seq_id", "event_id", "ts", "level", "sigma")


@query(
    "sequence_detail_sql",
    f"""WITH {SEQ_BOUNDS_SQL}, {DETAIL} SELECT ts AS time, level, speed, 'Normal' AS disturbance_type, sigma AS sequence_sigma,
          CASE WHEN seq_id % 4 > 0 THEN CONCAT(1 + seq_id % 6, 'A') END AS "Quality casting"
        FROM detail WHERE printf('seq_%04d', seq_id) = 'seq_0003' ORDER BY ts, event_id""",
    "level speed sequence_sigma",
)
def sequence_detail_query(spark, sf):
    sequences = seq_bounds(spark, sf).select(
        "strand",
        F.format_string("seq_%04d", "seq_id").alias("Seq_Name"),
        F.col("start_ts").alias("Seq_time_Start"),
        F.col("end_ts").alias("Seq_time_End"),
        F.col("sigma").alias("MOLD_LEVEL_std [mm]"),
        F.lit("Normal").alias("disturbance_type"),
        F.when(F.col("seq_id") % 4 > 0, F.concat((1 + F.col("seq_id") % 6).cast("string"), F.lit("A"))).alias("Quality casting"),
    )
    rows = by_day(signal(spark, sf).select("strand", "event_id", "ts", "level", "speed"), "ts")
    return sequence_detail_sql(spark, rows, stage(sequences, "sequences"), "ts", ["level", "speed"], "seq_0003", ["event_id"])


@query(
    "peak_side",
    f"""WITH {SEQ_BOUNDS_SQL}, {DETAIL}, m AS (
          SELECT strand, seq_id, sigma, COUNT(*) AS n, AVG(gas_a) AS level_left, AVG(gas_b) AS level_right
          FROM detail GROUP BY strand, seq_id, sigma HAVING COUNT(*) >= 10),
        a AS (SELECT *, (level_left - level_right) / (ABS(level_left) + ABS(level_right) + 1e-6) AS asym FROM m)
        SELECT *, CAST(CASE WHEN asym > 0 THEN -1 ELSE 1 END AS BIGINT) AS side,
               LEAST(sigma / 3.0, 0.3) AS instability_spread FROM a""",
    "sigma level_left level_right asym instability_spread",
)
def peak_side(spark, sf):
    return S.peak_side(detail(spark, sf), ["strand", "seq_id"], "gas_a", "gas_b", "sigma")


@query(
    "sequence_context",
    f"""WITH {SEQ_BOUNDS_SQL}, {DETAIL} SELECT strand, seq_id, COUNT(*) AS n, AVG(gas_a) AS gas_a_avg,
          AVG(gas_b) AS gas_b_avg, AVG(k) AS k_avg FROM detail GROUP BY strand, seq_id HAVING COUNT(*) >= 5""",
    "gas_a_avg gas_b_avg k_avg",
)
def sequence_context(spark, sf):
    return S.context_averages(
        detail(spark, sf), ["strand", "seq_id"], [*SPEC.gas, *SPEC.currents, "absent"]
    )


@query(
    "null_stats",
    f"""WITH {SIGNAL}, {STRAND_CASTINGS}, j AS ({CASTING_JOIN})
        SELECT COUNT(*) AS total_rows, COUNT(*) - COUNT(grade) AS null_count, COUNT(grade) AS non_null_count,
               COUNT(DISTINCT casting_id) AS distinct_casting_id, COUNT(DISTINCT grade) AS distinct_grade FROM j""",
)
def null_stats(spark, sf):
    return R.null_stats(labelled(spark, sf), "grade", ["casting_id", "grade"])


@query(
    "time_extents",
    f"""WITH {SIGNAL}, {STRAND_CASTINGS}, j AS ({CASTING_JOIN}), d AS (
          SELECT MIN(ts) AS data_start, MAX(ts) AS data_end,
                 MIN(CASE WHEN grade IS NULL THEN ts END) AS first_null, MAX(CASE WHEN grade IS NULL THEN ts END) AS last_null,
                 MIN(CASE WHEN grade IS NOT NULL THEN ts END) AS first_non_null,
                 MAX(CASE WHEN grade IS NOT NULL THEN ts END) AS last_non_null FROM j),
        c AS (SELECT MIN(ts_start) AS first_casting_start, MAX(ts_end) AS last_casting_end FROM strand_castings)
        SELECT *, GREATEST((epoch_us(first_casting_start) // 1000000 - epoch_us(data_start) // 1000000) / 3600, 0.0) AS head_gap_hours,
               GREATEST((epoch_us(data_end) // 1000000 - epoch_us(last_casting_end) // 1000000) / 3600, 0.0) AS tail_gap_hours
        FROM d, c""",
    "head_gap_hours tail_gap_hours",
)
def time_extents(spark, sf):
    return R.time_extents(
        labelled(spark, sf), "ts", "grade", strand_castings(spark, sf), "ts_start", "ts_end"
    )


@query(
    "interval_gaps",
    f"""WITH {STRAND_CASTINGS}, l AS (SELECT strand, casting_id, ts_start, LAG(ts_end) OVER (PARTITION BY strand ORDER BY ts_start, casting_id) AS prev_end
          FROM strand_castings) SELECT *, (epoch_us(ts_start) // 1000000 - epoch_us(prev_end) // 1000000) / 3600 AS gap_hours
        FROM l WHERE ts_start > prev_end""",
    "gap_hours",
)
def interval_gaps(spark, sf):
    rows = strand_castings(spark, sf).drop("grade")
    return I.interval_gaps(rows, "ts_start", "ts_end", ["casting_id"], ["strand"]).drop("ts_end")


@query(
    "casting_totals",
    f"""WITH {STRAND_CASTINGS} SELECT COUNT(*) AS castings, MIN(ts_start) AS first_start, MAX(ts_end) AS last_end,
        SUM((epoch_us(ts_end) // 1000000 - epoch_us(ts_start) // 1000000) / 3600) AS total_hours FROM strand_castings""",
    "total_hours",
)
def casting_totals(spark, sf):
    return R.casting_totals(strand_castings(spark, sf), "ts_start", "ts_end")
