"""Ordered series: gaps, segments, rounding, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import active_filter
from ..operators import ordered as O
from ..operators import reports as R
from ..operators import sampling as P
from ..operators import stats as S
from ..operators import windows as W
from ..plans.datasets import series_window
from ..plans.pipeline import classify_windows, stable_sequences
from ..sources.sinks import stage
from .joins import GAPS, deltas, long_gaps
from .registry import query
from .sequences import FLAGS_SQL
from .tables import CFG, SIGNAL, SPEC, fitted, signal, table

DAY = 86_400
STEP = 0.01

DELTAS = """deltas AS (
  SELECT event_id, prev_timestamp, ts, epoch_us(ts) // 1000000 - epoch_us(prev_timestamp) // 1000000 AS time_diff_seconds
  FROM (SELECT event_id, ts, LAG(ts) OVER (ORDER BY ts, event_id) AS prev_timestamp FROM events)
  WHERE prev_timestamp IS NOT NULL)"""


@query("time_deltas", f"WITH {DELTAS} SELECT * FROM deltas")
def time_deltas(spark, sf):
    return deltas(spark, sf)


@query(
    "significant_gaps",
    f"WITH {GAPS} SELECT *, time_diff_seconds / 60 AS time_diff_minutes FROM gaps",
    "time_diff_minutes time_diff_hours",
)
def significant_gaps(spark, sf):
    return long_gaps(spark, sf)


@query(
    "top_gaps",
    f"WITH {GAPS} SELECT event_id, time_diff_seconds FROM gaps ORDER BY time_diff_seconds DESC, event_id LIMIT 20",
)
def top_gaps(spark, sf):
    rows = long_gaps(spark, sf).select("event_id", "time_diff_seconds")
    return P.top_rows(rows, "time_diff_seconds", ["event_id"], 20)


@query(
    "gap_stats",
    f"""WITH {DELTAS} SELECT MIN(time_diff_seconds) AS min_gap_sec, MAX(time_diff_seconds) AS max_gap_sec,
        AVG(time_diff_seconds) AS avg_gap_sec, QUANTILE_CONT(CAST(time_diff_seconds AS DOUBLE), 0.5) AS median_gap_sec,
        QUANTILE_CONT(CAST(time_diff_seconds AS DOUBLE), 0.95) AS p95_gap_sec FROM deltas""",
    "avg_gap_sec median_gap_sec p95_gap_sec",
)
def gap_stats(spark, sf):
    return R.gap_stats(deltas(spark, sf))


@query(
    "gap_ecdf",
    f"""WITH {DELTAS} SELECT time_diff_seconds, ROW_NUMBER() OVER (ORDER BY time_diff_seconds, event_id) AS rank,
        ROW_NUMBER() OVER (ORDER BY time_diff_seconds, event_id) / COUNT(*) OVER () * 100 AS cumulative_pct FROM deltas""",
    "cumulative_pct",
)
def gap_ecdf(spark, sf):
    return O.ecdf(R.value_counts(deltas(spark, sf), "time_diff_seconds"), "time_diff_seconds")


def _histogram_sql(source: str, value: str, bins: int) -> str:
    return f"""b AS (SELECT CAST(MIN({value}) AS DOUBLE) AS lo, CAST(MAX({value}) AS DOUBLE) AS hi FROM {source}),
  h AS (SELECT LEAST(CAST(FLOOR(({value} - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin, COUNT(*) AS n
        FROM {source}, b WHERE {value} IS NOT NULL GROUP BY 1),
  hist AS (SELECT r.bin, COALESCE(h.n, 0) AS n, lo + r.bin * ((hi - lo) / {bins}) AS bin_start,
                  lo + (r.bin + 1) * ((hi - lo) / {bins}) AS bin_end
           FROM (SELECT UNNEST(RANGE({bins})) AS bin) r LEFT JOIN h USING (bin), b)"""


@query(
    "gap_histogram",
    f"WITH {DELTAS}, {_histogram_sql('deltas', 'time_diff_seconds', 100)} SELECT * FROM hist",
    "bin_start bin_end",
)
def gap_histogram(spark, sf):
    counted = R.value_counts(deltas(spark, sf), "time_diff_seconds").withColumnRenamed("n", "weight")
    return R.histogram(counted, "time_diff_seconds", 100, "weight")


@query(
    "gap_trimmed",
    f"""WITH {DELTAS} SELECT event_id, time_diff_seconds FROM deltas
        WHERE time_diff_seconds <= (SELECT QUANTILE_CONT(CAST(time_diff_seconds AS DOUBLE), 0.99) FROM deltas)""",
)
def gap_trimmed(spark, sf):
    return R.trim_above(deltas(spark, sf).select("event_id", "time_diff_seconds"))


@query(
    "duplicate_ts",
    """SELECT event_type AS strand, COUNT(*) AS total, COUNT(DISTINCT h) AS distinct_ts, COUNT(*) - COUNT(DISTINCT h) AS duplicates
       FROM (SELECT event_type, DATE_TRUNC('hour', ts) AS h FROM events) GROUP BY event_type""",
)
def duplicate_ts(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("strand"), F.date_trunc("hour", "ts").alias("h")
    )
    return R.duplicate_times(rows, ["strand"], "h")


def _hourly(spark, sf):
    return signal(spark, sf).select(
        "strand",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        "ts",
        "event_id",
        F.sqrt("level").alias("level"),
        "user_id",
        "quality",
    )


@query(
    "downsample",
    f"""WITH {SIGNAL} SELECT strand, hour, AVG(SQRT(level)) AS level, AVG(user_id) AS user_id, MAX(CASE WHEN rn = 1 THEN quality END) AS quality
        FROM (SELECT *, DATE_TRUNC('hour', ts) AS hour,
                     ROW_NUMBER() OVER (PARTITION BY strand, DATE_TRUNC('hour', ts) ORDER BY ts, event_id) AS rn FROM signal)
        GROUP BY strand, hour""",
    "level user_id",
)
def downsample(spark, sf):
    return S.downsample(_hourly(spark, sf), ["strand", "hour"], ["ts", "event_id"])


@query(
    "downsample_first_known",
    f"""WITH {SIGNAL} SELECT strand, hour, AVG(SQRT(level)) AS level, AVG(user_id) AS user_id, MAX(CASE WHEN rn = 1 THEN quality END) AS quality
        FROM (SELECT *, DATE_TRUNC('hour', ts) AS hour,
                     ROW_NUMBER() OVER (PARTITION BY strand, DATE_TRUNC('hour', ts) ORDER BY quality IS NULL, ts, event_id) AS rn FROM signal)
        GROUP BY strand, hour""",
    "level user_id",
)
def downsample_first_known(spark, sf):
    return S.downsample(_hourly(spark, sf), ["strand", "hour"], ["ts", "event_id"], ignore_nulls=True)


@query(
    "compressed_index",
    f"WITH {SIGNAL} SELECT strand, event_id, ROW_NUMBER() OVER (PARTITION BY strand ORDER BY ts, event_id) - 1 AS pos FROM signal",
)
def compressed_index(spark, sf):
    rows = signal(spark, sf).select("strand", "ts", "event_id")
    return O.with_position(rows, SPEC.keys, SPEC.order, fitted(spark, sf).chunk()).drop("ts")


@query(
    "every_kth",
    f"""WITH {SIGNAL} SELECT strand, event_id, level FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY strand ORDER BY ts, event_id) - 1 AS p FROM signal) WHERE p % 7 = 0""",
    "level",
)
def every_kth(spark, sf):
    rows = signal(spark, sf).select("strand", "ts", "event_id", "level")
    return O.every_kth(rows, SPEC.keys, SPEC.order, fitted(spark, sf).chunk(), 7).drop("ts")


def _cut_sql(source: str, gap: float) -> str:
    return f"""cut AS (
  SELECT *, pos - MIN(pos) OVER (PARTITION BY strand, segment_id) AS seg_pos FROM (
    SELECT * EXCLUDE (jump), CAST(SUM(jump) OVER (PARTITION BY strand ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id
    FROM (SELECT *, ROW_NUMBER() OVER w - 1 AS pos,
                 CASE WHEN epoch_us(ts) - epoch_us(LAG(ts) OVER w) > {int(gap * 1_000_000)} THEN 1 ELSE 0 END AS jump
          FROM {source} WINDOW w AS (PARTITION BY strand ORDER BY ts, event_id))))"""


@query(
    "segment_gaps",
    f"WITH {SIGNAL}, {_cut_sql('signal', 3600)} SELECT strand, event_id, segment_id, pos, seg_pos FROM cut",
)
def segment_gaps(spark, sf):
    rows = signal(spark, sf).select("strand", "ts", "event_id")
    return O.segment_by_gaps(rows, SPEC.keys, SPEC.order, fitted(spark, sf).chunk(), 3600).drop("ts")


def _rounded_sql(source: str, value: str, scale: float) -> str:
    """Speeds are scaled down so that neighbours within the step do occur."""
    return f"""moved AS (
  SELECT *, CASE WHEN LAG(x) OVER w IS NULL OR ABS(x - LAG(x) OVER w) > {STEP} THEN ROUND_EVEN(x * 100 + 0.5, 0) / 100 END AS fresh
  FROM (SELECT *, {value} / {scale} AS x FROM {source}) WINDOW w AS (PARTITION BY strand ORDER BY ts, event_id)),
rounded AS (SELECT *, LAST_VALUE(fresh IGNORE NULLS) OVER (PARTITION BY strand ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM moved)"""


@query(
    "hysteresis_round",
    f"WITH {SIGNAL}, {_rounded_sql('signal', 'speed', 1000.0)} SELECT strand, event_id, x, r FROM rounded",
    "x r",
)
def hysteresis_round(spark, sf):
    rows = signal(spark, sf).select(
        "strand", "ts", "event_id", (F.col("speed") / 1000.0).alias("x")
    )
    out = O.hysteresis_round(rows, SPEC.keys, SPEC.order, fitted(spark, sf).chunk(), "x", "r")
    return out.drop("ts")


@query(
    "run_groups",
    f"""WITH {SIGNAL}, f AS (SELECT *, CASE WHEN ABS(level - LAG(level) OVER w) > 60 THEN 1 ELSE 0 END AS jump FROM signal
          WHERE user_id % 4 <> 0 WINDOW w AS (PARTITION BY strand ORDER BY ts, event_id)),
        g AS (SELECT *, CAST(SUM(jump) OVER (PARTITION BY strand ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f)
        SELECT strand, event_id, run FROM (SELECT *, COUNT(*) OVER (PARTITION BY strand, run) AS n FROM g) WHERE n >= 5""",
)
def run_groups(spark, sf):
    rows = signal(spark, sf).select("strand", "ts", "event_id", "user_id", "level")
    return O.run_groups(
        rows, SPEC.keys, SPEC.order, fitted(spark, sf).chunk(), F.col("user_id") % 4 != 0, "level", 60, 5
    ).select("strand", "event_id", "run")


@query(
    "spike_clean",
    f"""WITH {SIGNAL}, p AS (SELECT strand, event_id, level, ROW_NUMBER() OVER (PARTITION BY strand ORDER BY ts, event_id) - 1 AS pos FROM signal),
        m AS (SELECT *, CASE WHEN COUNT(level) OVER w = 5 THEN MEDIAN(level) OVER w END AS med FROM p
              WINDOW w AS (PARTITION BY strand ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
        k AS (SELECT *, CASE WHEN NOT COALESCE(ABS(med - LAG(med) OVER (PARTITION BY strand ORDER BY pos)) > 20, FALSE) THEN level END AS kept FROM m),
        n AS (SELECT *,
          LAST_VALUE(CASE WHEN kept IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p0, LAST_VALUE(kept IGNORE NULLS) OVER a AS v0,
          FIRST_VALUE(CASE WHEN kept IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p1, FIRST_VALUE(kept IGNORE NULLS) OVER b AS v1
          FROM k WINDOW a AS (PARTITION BY strand ORDER BY pos ROWS UNBOUNDED PRECEDING),
                        b AS (PARTITION BY strand ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT strand, event_id, level, COALESCE(kept, v0 + (v1 - v0) * (pos - p0) / NULLIF(p1 - p0, 0), v0, v1) AS clean FROM n""",
    "level clean",
)
def spike_clean(spark, sf):
    rows = signal(spark, sf).select("strand", "ts", "event_id", "level")
    return O.spike_clean(
        rows, SPEC.keys, SPEC.order, fitted(spark, sf).chunk(), "level", "clean", jump=20.0
    ).drop("ts")


def _active(spark, sf):
    return active_filter(signal(spark, sf), SPEC.currents)


def starts(spark, sf):
    return W.segmented_starts(
        _active(spark, sf), SPEC.keys, SPEC.order, fitted(spark, sf).chunk(), SPEC.speed, CFG.window_size,
        CFG.speed_threshold, SPEC.currents, CFG.current_threshold, CFG.max_gap_seconds,
    )


_W = CFG.window_size


def _walk_sql(active: str) -> str:
    """Row marks and the walk over them, from a CTE body for the active rows."""
    return f"""active AS ({active}), {_cut_sql('active', CFG.max_gap_seconds)},
stepped AS (SELECT *, ABS(k - LAG(k) OVER (PARTITION BY strand ORDER BY pos)) AS dk FROM cut),
marked AS (
  SELECT strand, event_id, ts, segment_id, pos,
         LEAD(segment_id, {_W - 1}) OVER (PARTITION BY strand ORDER BY pos) IS NOT DISTINCT FROM segment_id AS complete,
         COUNT(speed) OVER f = {_W} AND MAX(speed) OVER f - speed <= {CFG.speed_threshold}
           AND speed - MIN(speed) OVER f <= {CFG.speed_threshold}
           AND COALESCE(MAX(dk) OVER g < {CFG.current_threshold}, TRUE) AS good
  FROM stepped WINDOW f AS (PARTITION BY strand ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_W - 1} FOLLOWING),
                      g AS (PARTITION BY strand ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {_W - 1} FOLLOWING)),
walk AS (
  SELECT m.strand, m.segment_id, m.pos, m.complete AND m.good AS steady, m.complete
  FROM marked m WHERE m.pos = 0
  UNION ALL
  SELECT m.strand, m.segment_id, m.pos, m.complete AND m.good, m.complete
  FROM walk w JOIN marked m ON m.strand = w.strand AND m.pos = w.pos + CASE WHEN w.steady THEN {_W} ELSE 1 END)"""


_ACTIVE = "SELECT * FROM signal WHERE COALESCE(k <> 0, TRUE)"
WALK = _walk_sql(_ACTIVE)


@query(
    "stable_windows",
    f"WITH RECURSIVE {SIGNAL}, {WALK} SELECT strand, segment_id, pos AS start_pos FROM walk WHERE steady",
)
def stable_windows(spark, sf):
    return W.pick_windows(starts(spark, sf), SPEC.keys, _W)


@query(
    "abnormal_windows",
    f"WITH RECURSIVE {SIGNAL}, {WALK} SELECT strand, segment_id, pos FROM walk WHERE complete AND NOT steady",
)
def abnormal_windows(spark, sf):
    s, picks = stable_sequences(signal(spark, sf), SPEC, CFG, rounded=False)
    return W.abnormal_starts(s, picks, SPEC.keys, _W).select("strand", "segment_id", "pos")


@query(
    "sequence_rows",
    f"""WITH RECURSIVE {SIGNAL}, {WALK} SELECT m.strand, m.event_id, m.pos, w.pos AS start_pos FROM walk w
        JOIN marked m ON m.strand = w.strand AND m.pos BETWEEN w.pos AND w.pos + {_W - 1} WHERE w.steady""",
)
def sequence_rows(spark, sf):
    s, picks = stable_sequences(signal(spark, sf), SPEC, CFG, rounded=False)
    rows = s.select("strand", "event_id", "pos")
    return W.window_rows(rows, picks, SPEC.keys, _W).drop("segment_id", "seq_no")


@query(
    "sequence_names",
    f"""WITH RECURSIVE {SIGNAL}, {WALK} SELECT strand, pos AS start_pos,
        printf('seq_%04d', ROW_NUMBER() OVER (PARTITION BY strand ORDER BY pos) - 1) AS "Seq_Name" FROM walk WHERE steady""",
)
def sequence_names(spark, sf):
    picks = W.pick_windows(starts(spark, sf), SPEC.keys, _W)
    numbered = W.number_windows(picks, SPEC.keys)
    return numbered.select("strand", "start_pos", W.sequence_name("seq_no").alias("Seq_Name"))


@query(
    "sequence_stats",
    f"""WITH RECURSIVE {SIGNAL}, {WALK}, r AS (
          SELECT m.strand, w.pos AS start_pos, s.* EXCLUDE (strand) FROM walk w
          JOIN marked m ON m.strand = w.strand AND m.pos BETWEEN w.pos AND w.pos + {_W - 1}
          JOIN signal s ON s.strand = m.strand AND s.event_id = m.event_id WHERE w.steady),
        q AS (SELECT strand, start_pos, quality FROM (
                SELECT strand, start_pos, quality, ROW_NUMBER() OVER (PARTITION BY strand, start_pos ORDER BY COUNT(*) DESC, quality) AS rn
                FROM r WHERE quality IS NOT NULL GROUP BY strand, start_pos, quality) WHERE rn = 1)
        SELECT r.strand, r.start_pos, MIN(ts) AS "Seq_time_Start", MAX(ts) AS "Seq_time_End", COUNT(*) AS "Seq_num_samples",
               AVG(speed) AS speed_avg, AVG(width) AS width_avg, AVG(depth) * 1000 AS depth_avg, AVG(level) AS level_avg,
               STDDEV_SAMP(level) AS sigma, MAX(level) - MIN(level) AS ptp_mm, MAX(q.quality) AS quality,
               printf('seq_%04d', ROW_NUMBER() OVER (PARTITION BY r.strand ORDER BY r.start_pos) - 1) AS "Seq_Name",
               MAX(level) - MIN(level) > {CFG.variability_ptp}
                 OR AVG(CAST(ABS(level - med) > {CFG.variability_band} AS INT)) > {CFG.variability_fraction} AS has_high_variability
        FROM (SELECT *, MEDIAN(level) OVER (PARTITION BY strand, start_pos) AS med FROM r) r
        LEFT JOIN q ON q.strand = r.strand AND q.start_pos = r.start_pos GROUP BY r.strand, r.start_pos""",
    "speed_avg width_avg depth_avg level_avg sigma ptp_mm",
)
def sequence_stats(spark, sf):
    s, picks = stable_sequences(signal(spark, sf), SPEC, CFG, rounded=False)
    stats = classify_windows(s, picks, SPEC, CFG)
    return stats.select(
        "strand",
        "start_pos",
        "Seq_Name",
        "Seq_time_Start",
        "Seq_time_End",
        "Seq_num_samples",
        F.col("`CASTING_SPEED_avg [m/min]`").alias("speed_avg"),
        F.col("`MOLD_WIDTH_avg [m]`").alias("width_avg"),
        F.col("`SEN_avg [mm]`").alias("depth_avg"),
        F.col("`MOLD_LEVEL_avg [mm]`").alias("level_avg"),
        F.col("`MOLD_LEVEL_std [mm]`").alias("sigma"),
        "ptp_mm",
        F.col("`Quality casting`").alias("quality"),
        "has_high_variability",
    )


@query(
    "pipeline_labels",
    f"""WITH RECURSIVE {SIGNAL}, running AS ({_ACTIVE}), {_rounded_sql('running', 'speed', 1.0)},
        {_walk_sql('SELECT * REPLACE (r AS speed) FROM rounded')},
        seq_rows AS (SELECT m.strand, w.pos AS seq_id, m.pos, s.level FROM walk w
          JOIN marked m ON m.strand = w.strand AND m.pos BETWEEN w.pos AND w.pos + {_W - 1}
          JOIN signal s ON s.strand = m.strand AND s.event_id = m.event_id WHERE w.steady),
        {FLAGS_SQL}
        SELECT strand, disturbance_type, COUNT(*) AS count,
               ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY strand), 1) AS percentage
        FROM classified GROUP BY strand, disturbance_type""",
)
def pipeline_labels(spark, sf):
    """The whole chain with rounded speed, down to a count per label."""
    s, picks = stable_sequences(signal(spark, sf), SPEC, CFG)
    return R.label_counts(classify_windows(s, picks, SPEC, CFG), "disturbance_type", ["strand"])


@query(
    "break_windows",
    f"""WITH RECURSIVE {SIGNAL}, e AS (
          SELECT strand, speed, ROW_NUMBER() OVER (PARTITION BY strand ORDER BY ts, event_id) - 1 AS pos,
                 COUNT(*) OVER (PARTITION BY strand) AS n FROM signal),
        l AS (SELECT *, list(speed) OVER (PARTITION BY strand ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS vs FROM e),
        v AS (SELECT strand, pos, pos - 1 + list_position([abs(x - speed) > 60 FOR x IN vs], true) AS break_pos FROM l WHERE pos + 8 <= n),
        walk AS (SELECT strand, 0 AS window_no, pos, break_pos FROM v WHERE pos = 0
          UNION ALL SELECT v.strand, w.window_no + 1, v.pos, v.break_pos FROM walk w JOIN v ON v.strand = w.strand
            AND v.pos = CASE WHEN w.break_pos IS NULL THEN w.pos + 8 ELSE w.break_pos + 1 END)
        SELECT strand, CAST(window_no AS BIGINT) AS window_no, pos AS start_pos, CAST(break_pos AS DOUBLE) AS break_pos, break_pos IS NULL AS stable FROM walk""",
)
def break_windows(spark, sf):
    rows = signal(spark, sf).select("strand", "ts", "event_id", "speed")
    found = W.break_windows(
        rows, SPEC.keys, SPEC.order, "speed", 8, 60.0, chunk_seconds=fitted(spark, sf).chunk_seconds
    )
    return found.withColumn("break_pos", F.col("break_pos").cast("double"))


@query(
    "hourly_coverage",
    """SELECT event_type AS strand, DATE_TRUNC('hour', ts) AS hour, COUNT(*) AS data_points,
              CASE WHEN COUNT(*) < 1800 THEN 'Sparse' WHEN COUNT(*) < 3000 THEN 'Good' ELSE 'Dense' END AS coverage_level
       FROM events GROUP BY ALL""",
)
def hourly_coverage(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("strand"), "ts")
    return R.hourly_coverage(rows, "ts", ["strand"])


@query(
    "coverage_zero_filled",
    """WITH c AS (SELECT CONCAT(event_type, '-', user_id % 40) AS strand, DATE_TRUNC('hour', ts) AS hour, COUNT(*) AS n
                  FROM events GROUP BY ALL),
       s AS (SELECT strand, UNNEST(GENERATE_SERIES(MIN(hour), MAX(hour), INTERVAL 1 HOUR)) AS hour FROM c GROUP BY strand),
       f AS (SELECT s.strand, s.hour, COALESCE(n, 0) AS n FROM s LEFT JOIN c USING (strand, hour)),
       l AS (SELECT *, n = 0 AND LAG(n) OVER (PARTITION BY strand ORDER BY hour) > 0 AS starts FROM f)
       SELECT strand, COUNT(*) AS total_hours, COUNT_IF(n > 0)::BIGINT AS hours_with_data, COUNT_IF(starts)::BIGINT AS gap_count,
              COUNT_IF(n > 0) * 100.0 / COUNT(*) AS coverage_pct FROM l GROUP BY strand""",
    "coverage_pct",
)
def coverage_zero_filled(spark, sf):
    """Users are dealt to 40 strands per event type, so that strands have hours without data."""
    strand = F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string"))
    return R.coverage_zero_filled(table(spark, sf, "events").select(strand.alias("strand"), "ts"), "ts", ["strand"])


@query(
    "ordered_log",
    "SELECT ts, event_id, event_type, value FROM events ORDER BY ts, event_id",
    "value",
)
def ordered_log(spark, sf):
    """The log in time order: sorted by ranges of time, each range in one task."""
    return table(spark, sf, "events").select("ts", "event_id", "event_type", "value").orderBy("ts", "event_id")


@query(
    "null_edges",
    f"""WITH {SIGNAL}, n AS (SELECT ts, event_id, quality FROM signal WHERE quality IS NULL)
        SELECT * FROM (SELECT *, 'first' AS edge FROM n ORDER BY ts, event_id LIMIT 20)
        UNION ALL SELECT * FROM (SELECT *, 'last' AS edge FROM n ORDER BY ts DESC, event_id DESC LIMIT 20)""",
)
def null_edges(spark, sf):
    rows = signal(spark, sf).select("ts", "event_id", "quality")
    return P.edges(rows.filter(F.col("quality").isNull()), ["ts", "event_id"], 20)


@query(
    "series_window_sql",
    f"""WITH {SIGNAL} SELECT ts AS time, strand, level, width FROM signal
        WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' """,
    "level width",
)
def series_window_sql(spark, sf):
    return series_window(
        spark, signal(spark, sf), "ts", ["strand", "level", "width"],
        "2024-01-03 00:00:00", "2024-01-20 00:00:00", tiebreak=["event_id"],
    )
