"""Windows: statistics, detectors and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import grade_family, round_to_step, width_bin
from ..operators import detectors as D
from ..operators import quantiles as Q
from ..operators import reports as R
from ..operators import stats as S
from ..plans.datasets import grades, parameter_correlations
from .registry import query
from .rows import SENSORS_SQL, sensors
from .tables import (
    CFG,
    SEQ_KEYS,
    SEQ_ROWS_SQL,
    SPEC,
    WINDOWS_TABLE,
    seq_rows,
    windows_table,
)

ORDER = list(SPEC.order)


def gathered(spark, sf):
    rows = seq_rows(spark, sf).select(*SEQ_KEYS, *ORDER, "level")
    return D.gather(rows, SEQ_KEYS, ORDER, "level")


def timed(spark, sf):
    """Window samples with their times; some samples are missing."""
    level = F.when(F.col("user_id") % 9 != 0, F.col("level"))
    rows = seq_rows(spark, sf).select(*SEQ_KEYS, *ORDER, level.alias("level"))
    return rows.groupBy(*SEQ_KEYS).agg(D.timed_samples(ORDER, "level").alias("timed"))


TIMED_SQL = f"""{SEQ_ROWS_SQL}, timed AS (
  SELECT strand, seq_id, ts, event_id, pos, CASE WHEN user_id % 9 <> 0 THEN level END AS v FROM seq_rows)"""


@query(
    "sequence_stats_ext",
    f"""WITH {SEQ_ROWS_SQL}, mode AS (SELECT strand, seq_id, quality FROM (
          SELECT strand, seq_id, quality, ROW_NUMBER() OVER (PARTITION BY strand, seq_id ORDER BY COUNT(*) DESC, quality) AS rn
          FROM seq_rows WHERE quality IS NOT NULL GROUP BY strand, seq_id, quality) WHERE rn = 1)
        SELECT r.strand, r.seq_id, MIN(ts) AS "Seq_time_Start", MAX(ts) AS "Seq_time_End", COUNT(*) AS "Seq_num_samples",
          (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 6e7 AS "Seq_duration_min",
          AVG(speed) AS "CASTING_SPEED_avg [m/min]", STDDEV_SAMP(speed) AS "CASTING_SPEED_std [m/min]",
          AVG(width) AS "MOLD_WIDTH_avg [m]", STDDEV_SAMP(width) AS "MOLD_WIDTH_std [m]",
          AVG(depth) * 1000 AS "SEN_avg [mm]", STDDEV_SAMP(depth) * 1000 AS "SEN_std [mm]",
          AVG(level) AS "MOLD_LEVEL_avg [mm]", STDDEV_SAMP(level) AS "MOLD_LEVEL_std [mm]",
          MIN(level) AS "MOLD_LEVEL_min [mm]", MAX(level) AS "MOLD_LEVEL_max [mm]", MAX(level) - MIN(level) AS ptp_mm,
          AVG(gas_a) + AVG(gas_b) AS "ArFlow_avg [NL/min]", MAX(mode.quality) AS "Quality casting",
          AVG(k) AS "k_avg [A]", STDDEV_SAMP(k) AS "k_std [A]"
        FROM seq_rows r LEFT JOIN mode ON r.strand = mode.strand AND r.seq_id = mode.seq_id GROUP BY r.strand, r.seq_id""",
    [
        "Seq_duration_min", "CASTING_SPEED_avg [m/min]", "CASTING_SPEED_std [m/min]", "MOLD_WIDTH_avg [m]",
        "MOLD_WIDTH_std [m]", "SEN_avg [mm]", "SEN_std [mm]", "MOLD_LEVEL_avg [mm]", "MOLD_LEVEL_std [mm]",
        "MOLD_LEVEL_min [mm]", "MOLD_LEVEL_max [mm]", "ptp_mm", "ArFlow_avg [NL/min]", "k_avg [A]", "k_std [A]",
    ],
)
def sequence_stats_ext(spark, sf):
    return S.sequence_stats_extended(seq_rows(spark, sf), SEQ_KEYS, SPEC)


@query(
    "sequence_stats_manual",
    f"""WITH {SEQ_ROWS_SQL} SELECT strand, seq_id, MIN(ts) AS "Seq_time_Start", MAX(ts) AS "Seq_time_End",
          AVG(depth) AS "SEN_avg [mm]", STDDEV_SAMP(depth) AS "SEN_std [mm]",
          AVG(speed) AS "CASTING_SPEED_avg [m/min]", STDDEV_SAMP(speed) AS "CASTING_SPEED_std [m/min]",
          AVG(width) AS "MOLD_WIDTH_avg [m]", STDDEV_SAMP(width) AS "MOLD_WIDTH_std [m]",
          AVG(level) AS "MOLD_LEVEL_avg [mm]", STDDEV_SAMP(level) AS "MOLD_LEVEL_std [mm]",
          AVG(gas_a + gas_b) AS "ArFlow_avg [NL/min]", STDDEV_SAMP(gas_a + gas_b) AS "ArFlow_std [NL/min]",
          MIN(k) AS "min DC Current, Low [A]", AVG(k) AS "mean DC Current, Low [A]", MAX(k) AS "max DC Current, Low [A]",
          'normal' AS "Seq_Condition" FROM seq_rows GROUP BY strand, seq_id""",
    [
        "SEN_avg [mm]", "SEN_std [mm]", "CASTING_SPEED_avg [m/min]", "CASTING_SPEED_std [m/min]", "MOLD_WIDTH_avg [m]",
        "MOLD_WIDTH_std [m]", "MOLD_LEVEL_avg [mm]", "MOLD_LEVEL_std [mm]", "ArFlow_avg [NL/min]", "ArFlow_std [NL/min]",
        "min DC Current, Low [A]", "mean DC Current, Low [A]", "max DC Current, Low [A]",
    ],
)
def sequence_stats_manual(spark, sf):
    return S.sequence_stats_manual(
        seq_rows(spark, sf), SEQ_KEYS, SPEC, {"k": "DC Current, Low"}, "normal"
    )


@query(
    "mode_label",
    f"""WITH {SEQ_ROWS_SQL}, c AS (SELECT strand, seq_id, quality, COUNT(*) AS n FROM seq_rows GROUP BY ALL)
        SELECT strand, seq_id, MIN(CASE WHEN rn = 1 THEN quality END) AS quality FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY strand, seq_id ORDER BY quality IS NULL, n DESC, quality) AS rn FROM c)
        GROUP BY strand, seq_id""",
)
def mode_label(spark, sf):
    return seq_rows(spark, sf).groupBy(*SEQ_KEYS).agg(S.modal("quality").alias("quality"))


@query(
    "unique_label",
    f"""WITH {SEQ_ROWS_SQL}, d AS (SELECT DISTINCT strand, seq_id, TRIM(q) AS q FROM (
          SELECT strand, seq_id, CASE WHEN seq_id % 3 = 0 THEN ' same ' WHEN seq_id % 3 = 1 THEN quality END AS q FROM seq_rows))
        SELECT strand, seq_id, CASE COUNT(q) WHEN 0 THEN NULL WHEN 1 THEN MIN(q)
          ELSE 'MULTIPLE: ' || STRING_AGG(q, ' | ' ORDER BY q) END AS quality FROM d GROUP BY strand, seq_id""",
)
def unique_label(spark, sf):
    q = F.when(F.col("seq_id") % 3 == 0, " same ").when(F.col("seq_id") % 3 == 1, F.col("quality"))
    rows = seq_rows(spark, sf).withColumn("q", q)
    return rows.groupBy(*SEQ_KEYS).agg(S.unique_or_multiple("q").alias("quality"))


EXCURSION = f"""excursion AS (
  SELECT strand, seq_id, COALESCE(MAX(run), 0) >= {int(CFG.excursion_min_duration_s)} AS has_excursion_event FROM (
    SELECT strand, seq_id, isl, SUM(far) AS run FROM (
      SELECT *, pos - SUM(far) OVER (PARTITION BY strand, seq_id ORDER BY pos) AS isl FROM (
        SELECT strand, seq_id, pos, CAST(ABS(level - MEDIAN(level) OVER (PARTITION BY strand, seq_id)) > {CFG.excursion_threshold} AS INT) AS far
        FROM seq_rows))
    WHERE far = 1 OR TRUE GROUP BY strand, seq_id, isl, far)
  GROUP BY strand, seq_id)"""


@query("detect_excursion", f"WITH {SEQ_ROWS_SQL}, {EXCURSION} SELECT * FROM excursion")
def detect_excursion(spark, sf):
    flag = D.excursion("samples", CFG.excursion_threshold, CFG.excursion_min_duration_s)
    return gathered(spark, sf).select(*SEQ_KEYS, flag.alias("has_excursion_event"))


DRIFT = f"""drift AS (
  SELECT s.strand, s.seq_id, s.n >= {int(CFG.drift_min_run_s)} AND s.ptp >= {CFG.drift_min_amplitude}
         AND COALESCE(MAX(r.run), 0) >= {int(CFG.drift_min_run_s)} AS has_slow_drift
  FROM (SELECT strand, seq_id, COUNT(*) AS n, MAX(level) - MIN(level) AS ptp FROM seq_rows GROUP BY strand, seq_id) s
  LEFT JOIN (
    SELECT strand, seq_id, isl, sg, COUNT(*) AS run FROM (
      SELECT *, pos - ROW_NUMBER() OVER (PARTITION BY strand, seq_id, sg ORDER BY pos) AS isl FROM (
        SELECT strand, seq_id, pos, SIGN(level - LAG(level) OVER (PARTITION BY strand, seq_id ORDER BY pos)) AS sg FROM seq_rows)
      WHERE sg <> 0) GROUP BY ALL) r ON r.strand = s.strand AND r.seq_id = s.seq_id
  GROUP BY s.strand, s.seq_id, s.n, s.ptp)"""


@query("detect_slow_drift", f"WITH {SEQ_ROWS_SQL}, {DRIFT} SELECT * FROM drift")
def detect_slow_drift(spark, sf):
    flag = D.slow_drift("samples", CFG.drift_min_run_s, CFG.drift_min_amplitude)
    return gathered(spark, sf).select(*SEQ_KEYS, flag.alias("has_slow_drift"))


BUMP = f"""ix AS (SELECT strand, seq_id, level, pos - MIN(pos) OVER (PARTITION BY strand, seq_id) AS i,
                 COUNT(*) OVER (PARTITION BY strand, seq_id) AS n FROM seq_rows),
base AS (
  SELECT a.strand, a.seq_id, a.i, a.n, a.level, LIST_SORT(LIST(b.level))[11] AS base
  FROM (SELECT *, UNNEST(RANGE(-10, 10)) AS o FROM ix) a
  JOIN ix b ON b.strand = a.strand AND b.seq_id = a.seq_id AND b.i = GREATEST(0, LEAST(a.n - 1, a.i + a.o))
  GROUP BY a.strand, a.seq_id, a.i, a.n, a.level),
res AS (SELECT *, level - base AS res, MEDIAN(level - base) OVER (PARTITION BY strand, seq_id) AS med_res,
               MEDIAN(base) OVER (PARTITION BY strand, seq_id) AS med_base FROM base),
noise AS (SELECT strand, seq_id, 1.4826 * MEDIAN(ABS(res - med_res)) AS sigma FROM res GROUP BY strand, seq_id),
far AS (SELECT r.*, sigma, CAST(ABS(res) > GREATEST({CFG.bump_k_amp} * sigma, {CFG.bump_min_amplitude}) AS INT) AS far
        FROM res r JOIN noise USING (strand, seq_id)),
runs AS (SELECT strand, seq_id, n, sigma, med_base, MIN(i) AS a, MAX(i) + 1 AS b FROM (
           SELECT *, i - ROW_NUMBER() OVER (PARTITION BY strand, seq_id ORDER BY i) AS isl FROM far WHERE far = 1)
         GROUP BY strand, seq_id, n, sigma, med_base, isl),
bumps AS (SELECT r.strand, r.seq_id, r.a FROM runs r JOIN ix p ON p.strand = r.strand AND p.seq_id = r.seq_id
            AND p.i BETWEEN r.b AND r.b + 29
          WHERE r.b - r.a BETWEEN {int(CFG.bump_min_duration_s)} AND {int(CFG.bump_max_duration_s)} AND r.b < r.n
          GROUP BY r.strand, r.seq_id, r.a, r.med_base, r.sigma
          HAVING ABS(MEDIAN(p.level) - r.med_base) < {CFG.bump_return_band_sigma} * r.sigma),
bump AS (SELECT strand, seq_id, (strand, seq_id) IN (SELECT (strand, seq_id) FROM bumps) AS has_transient_bump
         FROM (SELECT DISTINCT strand, seq_id FROM seq_rows))"""


@query("detect_bump", f"WITH {SEQ_ROWS_SQL}, {BUMP} SELECT * FROM bump")
def detect_bump(spark, sf):
    flag = D.transient_bump(
        "samples", CFG.bump_k_amp, CFG.bump_min_amplitude, CFG.bump_min_duration_s,
        CFG.bump_max_duration_s, CFG.bump_return_band_sigma,
    )
    return gathered(spark, sf).select(*SEQ_KEYS, flag.alias("has_transient_bump"))


VARIABILITY = f"""variability AS (
  SELECT strand, seq_id, MAX(level) - MIN(level) > {CFG.variability_ptp}
         OR AVG(CAST(ABS(level - med) > {CFG.variability_band} AS INT)) > {CFG.variability_fraction} AS has_high_variability
  FROM (SELECT *, MEDIAN(level) OVER (PARTITION BY strand, seq_id) AS med FROM seq_rows) GROUP BY strand, seq_id)"""


@query("detect_high_variability", f"WITH {SEQ_ROWS_SQL}, {VARIABILITY} SELECT * FROM variability")
def detect_high_variability(spark, sf):
    flag = D.high_variability(
        "samples", CFG.variability_ptp, CFG.variability_band, CFG.variability_fraction
    )
    return gathered(spark, sf).select(*SEQ_KEYS, flag.alias("has_high_variability"))


@query(
    "detect_slow_drift_timed",
    f"""WITH {TIMED_SQL}, f AS (SELECT *, ROW_NUMBER() OVER w AS i, v - LAG(v) OVER w AS d,
            (epoch_us(ts) - epoch_us(LAG(ts) OVER w)) / 1e6 AS step FROM timed WHERE v IS NOT NULL
            WINDOW w AS (PARTITION BY strand, seq_id ORDER BY ts, event_id)),
        g AS (SELECT strand, seq_id, COUNT(*) AS n, MEDIAN(step) AS dt FROM f GROUP BY strand, seq_id),
        s AS (SELECT *, COALESCE(LAST_VALUE(NULLIF(SIGN(d), 0) IGNORE NULLS) OVER (PARTITION BY strand, seq_id ORDER BY i), 0) AS sg
              FROM f WHERE i > 1),
        b AS (SELECT *, SUM(CAST(sg IS DISTINCT FROM p AS INT)) OVER (PARTITION BY strand, seq_id ORDER BY i) AS run
              FROM (SELECT *, LAG(sg) OVER (PARTITION BY strand, seq_id ORDER BY i) AS p FROM s)),
        r AS (SELECT strand, seq_id, run, COUNT(*) AS len, ABS(ARG_MAX(v, i) - ARG_MIN(v - d, i)) AS amp FROM b WHERE sg <> 0 GROUP BY ALL)
        SELECT k.strand, k.seq_id, COALESCE(MAX(CAST(g.n >= 3 AND g.dt > 0 AND r.len * g.dt >= 14000 AND r.amp >= 120 AS INT)), 0) = 1 AS has_slow_drift
        FROM (SELECT DISTINCT strand, seq_id FROM timed) k LEFT JOIN g USING (strand, seq_id) LEFT JOIN r USING (strand, seq_id)
        GROUP BY k.strand, k.seq_id""",
)
def detect_slow_drift_timed(spark, sf):
    flag = D.slow_drift_timed("timed", 14_000, 120)
    return timed(spark, sf).select(*SEQ_KEYS, flag.alias("has_slow_drift"))


@query(
    "detect_excursion_timed",
    f"""WITH {TIMED_SQL}, f AS (SELECT *, CAST(COALESCE(ABS(v - MEDIAN(v) OVER (PARTITION BY strand, seq_id)) > 40, FALSE) AS INT) AS far,
            (epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY strand, seq_id ORDER BY pos))) / 1e6 AS step FROM timed),
        g AS (SELECT strand, seq_id, COUNT(*) AS n, MEDIAN(step) AS dt FROM f GROUP BY strand, seq_id),
        r AS (SELECT strand, seq_id, isl, COUNT(*) AS run FROM (
                SELECT *, pos - ROW_NUMBER() OVER (PARTITION BY strand, seq_id ORDER BY pos) AS isl FROM f WHERE far = 1) GROUP BY ALL)
        SELECT g.strand, g.seq_id, COALESCE(MAX(CAST(g.n >= 3 AND g.dt > 0 AND r.run * g.dt >= 3000 AS INT)), 0) = 1 AS has_excursion_event
        FROM g LEFT JOIN r USING (strand, seq_id) GROUP BY g.strand, g.seq_id""",
)
def detect_excursion_timed(spark, sf):
    flag = D.excursion_timed("timed", 40, 3_000)
    return timed(spark, sf).select(*SEQ_KEYS, flag.alias("has_excursion_event"))


FLAGS_SQL = f"""{EXCURSION}, {DRIFT}, {BUMP}, {VARIABILITY}, flags AS (
  SELECT * FROM excursion JOIN drift USING (strand, seq_id) JOIN bump USING (strand, seq_id) JOIN variability USING (strand, seq_id)),
classified AS (SELECT *, has_excursion_event OR has_slow_drift OR has_transient_bump OR has_high_variability AS has_disturbance,
  CASE WHEN NOT (has_excursion_event OR has_slow_drift OR has_transient_bump OR has_high_variability) THEN 'Normal'
       ELSE CONCAT_WS(' + ', CASE WHEN has_excursion_event THEN 'Excursion' END, CASE WHEN has_slow_drift THEN 'Slow drift' END,
            CASE WHEN has_transient_bump THEN 'Transient bump' END, CASE WHEN has_high_variability THEN 'High variability' END)
  END AS disturbance_type FROM flags)"""
CLASSIFIED = f"{SEQ_ROWS_SQL}, {FLAGS_SQL}"


def classified(spark, sf):
    return D.flag_disturbances(gathered(spark, sf), "samples", CFG).drop("samples")


@query("classify_sequences", f"WITH {CLASSIFIED} SELECT * FROM classified")
def classify_sequences(spark, sf):
    return classified(spark, sf)


@query(
    "disturbance_distribution",
    f"""WITH {CLASSIFIED} SELECT disturbance_type, COUNT(*) AS count,
        ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 1) AS percentage FROM classified GROUP BY disturbance_type""",
)
def disturbance_distribution(spark, sf):
    return R.label_counts(classified(spark, sf), "disturbance_type")


@query(
    "flag_counts",
    f"""WITH {WINDOWS_TABLE} SELECT flag, COUNT_IF(v)::BIGINT AS count FROM (
          SELECT 'has_disturbance' AS flag, has_disturbance AS v FROM windows
          UNION ALL SELECT 'has_excursion_event', has_excursion_event FROM windows
          UNION ALL SELECT 'has_slow_drift', has_slow_drift FROM windows
          UNION ALL SELECT 'has_transient_bump', has_transient_bump FROM windows
          UNION ALL SELECT 'has_high_variability', has_high_variability FROM windows) GROUP BY flag""",
)
def flag_counts(spark, sf):
    return R.flag_counts(windows_table(spark, sf))


@query(
    "flag_crosstab",
    f"""WITH {WINDOWS_TABLE} SELECT CASE GROUPING(has_excursion_event) WHEN 1 THEN 'All' ELSE CAST(has_excursion_event AS VARCHAR) END AS has_excursion_event_value,
          CASE GROUPING(has_high_variability) WHEN 1 THEN 'All' ELSE CAST(has_high_variability AS VARCHAR) END AS has_high_variability_value,
          COUNT(*) AS n FROM windows GROUP BY CUBE (has_excursion_event, has_high_variability)""",
)
def flag_crosstab(spark, sf):
    return R.flag_crosstab(windows_table(spark, sf), "has_excursion_event", "has_high_variability")


@query(
    "summary_report",
    f"""WITH {WINDOWS_TABLE} SELECT 'Overall' AS section, 'Total sequences' AS item, CAST(COUNT(*) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS pct FROM windows
        UNION ALL SELECT 'Stability', 'Stable', COUNT_IF(sigma <= 2.0), COUNT_IF(sigma <= 2.0) * 100.0 / COUNT(*) FROM windows
        UNION ALL SELECT 'Stability', 'Mean sigma', AVG(sigma), NULL FROM windows
        UNION ALL SELECT 'Stability', 'Median sigma', MEDIAN(sigma), NULL FROM windows
        UNION ALL SELECT 'Parameters', 'Casting Speed mean', AVG(speed), NULL FROM windows
        UNION ALL SELECT 'Parameters', 'Casting Speed std', STDDEV_SAMP(speed), NULL FROM windows
        UNION ALL SELECT 'Parameters', 'Mold Width mean', AVG(width), NULL FROM windows
        UNION ALL SELECT 'Parameters', 'Mold Width std', MAX(0.0), NULL FROM windows
        UNION ALL SELECT 'Disturbances', label, COUNT(*), ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 1) FROM windows GROUP BY label""",
    "value pct",
)
def summary_report(spark, sf):
    return R.summary_report(
        windows_table(spark, sf), "sigma", "label", 2.0,
        {"Casting Speed": ("speed", "speed"), "Mold Width": ("width", None)},
    )


def _effect_sql(category: str, labels: list[str], extra: str) -> str:
    listed = ", ".join(f"'{x}'" for x in labels)
    return f"""c AS (SELECT *, {category} AS cat FROM windows),
  a AS (SELECT strand, cat, COUNT(*) AS n_all, COUNT_IF(label = 'Normal')::BIGINT AS n_clean, MEDIAN(sigma) AS med_all,
               MEDIAN(sigma) FILTER (WHERE label = 'Normal') AS med_clean {extra} FROM c GROUP BY strand, cat),
  s AS (SELECT strand, UNNEST([{listed}]) AS cat FROM (SELECT DISTINCT strand FROM windows))"""


WIDTH_SQL = """CASE WHEN width >= 0 AND width < 1.2 THEN '<=1.2 m' WHEN width >= 1.2 AND width < 1.5 THEN '1.2-1.5 m'
  WHEN width >= 1.5 AND width < 1.8 THEN '1.5-1.8 m' WHEN width >= 1.8 AND width < 2.0 THEN '1.8-2.0 m' ELSE '>2.0 m' END"""
FAMILY_SQL = "CASE WHEN SUBSTR(TRIM(grade), 1, 1) IN ('1', '2', '3', '5') THEN SUBSTR(TRIM(grade), 1, 1) ELSE 'N' END"
EXCEED = ", AVG(CAST(COALESCE(sigma > 1.0, FALSE) AS INT)) * 100 AS exceed_pct"


@query(
    "width_effect",
    f"""WITH {WINDOWS_TABLE}, {_effect_sql(WIDTH_SQL, ['<=1.2 m', '1.2-1.5 m', '1.5-1.8 m', '1.8-2.0 m', '>2.0 m'], EXCEED)}
        SELECT strand, cat AS width_bin, COALESCE(n_all, 0) AS n_all, COALESCE(n_clean, 0) AS n_clean, med_all, med_clean, exceed_pct
        FROM s LEFT JOIN a USING (strand, cat)""",
    "med_all med_clean exceed_pct",
)
def width_effect(spark, sf):
    seqs = windows_table(spark, sf).withColumn("width_bin", width_bin("width"))
    return R.width_effect(seqs, ["strand"], "width_bin", "sigma", "label", 1.0)


@query(
    "family_effect",
    f"""WITH {WINDOWS_TABLE}, {_effect_sql(FAMILY_SQL, ['1', '2', '3', '5', 'N'], '')},
        r AS (SELECT strand, STRING_AGG('Fam ' || cat, ' > ' ORDER BY med_all DESC, cat) AS ranking FROM a WHERE med_all IS NOT NULL GROUP BY strand)
        SELECT strand, cat AS family, COALESCE(n_all, 0) AS n_all, COALESCE(n_clean, 0) AS n_clean, med_all, med_clean, ranking,
          CASE cat WHEN '1' THEN 'Family 1 (Low-C)' WHEN '2' THEN 'Family 2' WHEN '3' THEN 'Family 3 (Peritectic)'
                   WHEN '5' THEN 'Family 5 (HSLA)' ELSE 'Family N (Unclassified)' END AS family_name
        FROM s LEFT JOIN a USING (strand, cat) LEFT JOIN r USING (strand)""",
    "med_all med_clean",
)
def family_effect(spark, sf):
    seqs = windows_table(spark, sf).withColumn("family", grade_family("grade"))
    return R.family_effect(seqs, ["strand"], "family", "sigma", "label")


@query(
    "overview_kpis",
    f"""WITH {WINDOWS_TABLE} SELECT COUNT(*) AS total_sequences, COUNT_IF(sigma <= 2.0)::BIGINT AS stable_sequences,
          ROUND(COUNT_IF(sigma <= 2.0) * 100.0 / COUNT(*), 1) AS stable_pct, ROUND(AVG(sigma), 2) AS mean_sigma,
          ROUND(STDDEV_SAMP(sigma), 2) AS std_sigma, COUNT_IF(label = 'Normal')::BIGINT AS normal_sequences,
          ROUND(COUNT_IF(label = 'Normal') * 100.0 / COUNT(*), 1) AS normal_pct, ROUND(AVG(speed), 2) AS avg_casting_speed,
          ROUND(AVG(width), 3) AS avg_mold_width FROM windows""",
)
def overview_kpis(spark, sf):
    return R.overview_kpis(windows_table(spark, sf), "sigma", "label", "speed", "width", 2.0)


@query(
    "histogram",
    """WITH b AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem),
       h AS (SELECT LEAST(CAST(FLOOR((l_extendedprice - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin, COUNT(*) AS n FROM lineitem, b GROUP BY 1)
       SELECT r.bin, COALESCE(n, 0) AS n, lo + r.bin * ((hi - lo) / 50) AS bin_start, lo + (r.bin + 1) * ((hi - lo) / 50) AS bin_end,
              (SELECT AVG(l_extendedprice) FROM lineitem) AS mean, (SELECT MEDIAN(l_extendedprice) FROM lineitem) AS median
       FROM (SELECT UNNEST(RANGE(50)) AS bin) r LEFT JOIN h USING (bin), b""",
    "bin_start bin_end mean median",
)
def histogram(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice")
    return R.histogram_with_centre(rows, "l_extendedprice", 50)


@query(
    "density_2d",
    """WITH b AS (SELECT MIN(l_quantity) AS x0, MAX(l_quantity) AS x1, MIN(l_extendedprice) AS y0, MAX(l_extendedprice) AS y1 FROM lineitem)
       SELECT LEAST(CAST(FLOOR((l_quantity - x0) / (x1 - x0) * 20) AS BIGINT), 19) AS x_bin,
              LEAST(CAST(FLOOR((l_extendedprice - y0) / (y1 - y0) * 30) AS BIGINT), 29) AS y_bin, COUNT(*) AS n
       FROM lineitem, b GROUP BY 1, 2""",
)
def density_2d(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return R.density_2d(rows, "l_quantity", "l_extendedprice", 20, 30)


_PAIRS = " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, " + ("MAX(1.0::DOUBLE)" if x == y else f"CORR({x}, {y})") + " AS corr FROM sensors"
    for x in "abcd"
    for y in "abcd"
)


@query("corr_matrix", f"WITH {SENSORS_SQL} {_PAIRS}", "corr")
def corr_matrix(spark, sf):
    return R.corr_matrix(sensors(spark, sf), ["a", "b", "c", "d"])


@query(
    "corr_target",
    f"""WITH {WINDOWS_TABLE}, n AS (SELECT * FROM windows WHERE label = 'Normal')
        SELECT 'speed' AS parameter, CORR(speed, sigma) AS corr FROM n UNION ALL SELECT 'width', CORR(width, sigma) FROM n
        UNION ALL SELECT 'depth', CORR(depth, sigma) FROM n""",
    "corr",
)
def corr_target(spark, sf):
    clean = windows_table(spark, sf).filter(F.col("label") == "Normal")
    return R.corr_target(clean, ["speed", "width", "depth"], "sigma")


_QUALITY = " UNION ALL ".join(
    f"""SELECT '{c}' AS parameter, (COUNT(*) - COUNT({c})) * 100.0 / COUNT(*) AS missing_pct, AVG({c}) AS mean,
        STDDEV_SAMP({c}) AS std, MIN({c}) AS min, MAX({c}) AS max FROM sensors"""
    for c in "abcd"
)


@query("quality_table", f"WITH {SENSORS_SQL} {_QUALITY}", "missing_pct mean std min max")
def quality_table(spark, sf):
    return R.quality_table(sensors(spark, sf), ["a", "b", "c", "d"])


STABILITY = """cuts AS (SELECT strand, QUANTILE_CONT(sigma, 0.2) AS q_low, QUANTILE_CONT(sigma, 0.8) AS q_high FROM windows
                WHERE sigma IS NOT NULL AND ptp IS NOT NULL GROUP BY strand),
  stab AS (SELECT w.*, q_low, q_high, CASE WHEN sigma <= q_low THEN 'Stable' WHEN sigma <= q_high THEN 'Medium' ELSE 'Unstable' END AS stability
           FROM windows w JOIN cuts USING (strand) WHERE sigma IS NOT NULL AND ptp IS NOT NULL)"""


@query(
    "stability_category",
    f"WITH {WINDOWS_TABLE}, {STABILITY} SELECT strand, seq_id, q_low, q_high, stability FROM stab",
    "q_low q_high",
)
def stability_category(spark, sf):
    seqs = windows_table(spark, sf).select("strand", "seq_id", "ptp", "sigma")
    return R.stability_category(seqs, ["strand"], "ptp", "sigma").drop("ptp", "sigma")


@query(
    "category_profile",
    f"""WITH {WINDOWS_TABLE}, {STABILITY}, g AS (SELECT r AS point, r * (2.0::DOUBLE / 199) - 1 AS x FROM (SELECT UNNEST(RANGE(200)) AS r)),
        p AS (SELECT strand, stability, point, x, sigma, 0.5 * ptp * (2 * x * x - 1 + 0.3 * x * (speed - 1)) AS y FROM stab, g)
        SELECT strand, stability, point, x, COUNT(*) AS n, AVG(sigma) AS mean_sigma, AVG(y) AS profile_mean, STDDEV_POP(y) AS profile_std
        FROM p GROUP BY strand, stability, point, x""",
    "x mean_sigma profile_mean profile_std",
)
def category_profile(spark, sf):
    seqs = windows_table(spark, sf).select("strand", "seq_id", "ptp", "sigma", "speed")
    categorised = R.stability_category(seqs, ["strand"], "ptp", "sigma")
    return R.category_profile(
        categorised, ["strand"], "stability", "ptp", "sigma", asym=F.col("speed") - 1
    )


@query(
    "binned_trend",
    f"""WITH {WINDOWS_TABLE} SELECT ROUND_EVEN(width / 0.05, 0) * 0.05 AS x_bin, AVG(sigma) AS mean_y, COUNT(*) AS n
        FROM windows GROUP BY 1""",
    "x_bin mean_y",
)
def binned_trend(spark, sf):
    return R.binned_trend(windows_table(spark, sf), round_to_step("width", 0.05), "sigma")


@query(
    "box_stats",
    f"""WITH {WINDOWS_TABLE} SELECT label, COUNT(sigma) AS n, AVG(sigma) AS mean, STDDEV_SAMP(sigma) AS std, MIN(sigma) AS min,
          MAX(sigma) AS max, QUANTILE_CONT(sigma, 0.25) AS q1, MEDIAN(sigma) AS median, QUANTILE_CONT(sigma, 0.75) AS q3
        FROM windows WHERE sigma IS NOT NULL GROUP BY label""",
    "mean std min max q1 median q3",
)
def box_stats(spark, sf):
    return R.box_stats(windows_table(spark, sf), ["label"], "sigma")


@query(
    "describe_sigma",
    f"""WITH {WINDOWS_TABLE} SELECT COUNT(sigma) AS n, AVG(sigma) AS mean, STDDEV_SAMP(sigma) AS std, MIN(sigma) AS min,
          MAX(sigma) AS max, QUANTILE_CONT(sigma, 0.25) AS q1, MEDIAN(sigma) AS median, QUANTILE_CONT(sigma, 0.75) AS q3
        FROM windows""",
    "mean std min max q1 median q3",
)
def describe_sigma(spark, sf):
    return R.box_stats(windows_table(spark, sf), [], "sigma")


@query(
    "grade_order",
    f"""WITH {WINDOWS_TABLE}, g AS (SELECT grade, MEDIAN(sigma) AS median_sigma FROM windows WHERE grade IS NOT NULL GROUP BY grade)
        SELECT *, ROW_NUMBER() OVER (ORDER BY median_sigma, grade) AS place FROM g""",
    "median_sigma",
)
def grade_order(spark, sf):
    return R.grade_order(windows_table(spark, sf), "grade", "sigma")


@query(
    "strand_summary",
    f"""WITH {WINDOWS_TABLE} SELECT strand, label, label_count, CAST(SUM(label_count) OVER w AS BIGINT) AS sequences,
          CAST(SUM(st) OVER w AS BIGINT) AS stable_sequences, SUM(st) OVER w * 100.0 / SUM(label_count) OVER w AS stable_pct
        FROM (SELECT strand, label, COUNT(*) AS label_count, COUNT_IF(sigma <= 2.0) AS st FROM windows GROUP BY strand, label)
        WINDOW w AS (PARTITION BY strand)""",
    "stable_pct",
)
def strand_summary(spark, sf):
    return R.strand_summary(windows_table(spark, sf), ["strand"], "sigma", "label", 2.0)


@query(
    "label_example",
    f"""WITH {WINDOWS_TABLE} SELECT strand, label, MAX(CASE WHEN a = 1 THEN seq_id END) AS first_seq_id,
          MAX(CASE WHEN b = 1 THEN seq_id END) AS strongest_seq_id FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY strand, label ORDER BY start_ts, seq_id) AS a,
                 ROW_NUMBER() OVER (PARTITION BY strand, label ORDER BY ptp DESC, seq_id) AS b FROM windows)
        GROUP BY strand, label""",
)
def label_example(spark, sf):
    seqs = windows_table(spark, sf)
    first = R.label_example(seqs, ["strand", "label"], ["start_ts", "seq_id"], "ptp", ["seq_id"])
    strongest = R.label_example(seqs, ["strand", "label"], ["seq_id"], "ptp", ["seq_id"])
    return first.drop("strongest_seq_id").join(
        strongest.drop("first_seq_id"), ["strand", "label"]
    )


@query(
    "representatives",
    f"""WITH {WINDOWS_TABLE}, r AS (SELECT strand, label, seq_id, sigma, ROW_NUMBER() OVER (PARTITION BY strand, label ORDER BY sigma, seq_id) - 1 AS i,
          COUNT(*) OVER (PARTITION BY strand, label) AS n FROM windows WHERE label <> 'Normal' AND sigma IS NOT NULL),
        k AS (SELECT * FROM r WHERE n <= 6 OR i IN (SELECT CAST(ROUND_EVEN(j * (n - 1) / 5, 0) AS BIGINT) FROM (SELECT UNNEST(RANGE(6)) AS j)))
        SELECT strand, label, seq_id, sigma, ROW_NUMBER() OVER (PARTITION BY strand, label ORDER BY sigma, seq_id) AS rank FROM k""",
    "sigma",
)
def representatives(spark, sf):
    disturbed = (
        windows_table(spark, sf)
        .filter((F.col("label") != "Normal") & F.col("sigma").isNotNull())
        .select("strand", "label", "seq_id", "sigma")
    )
    return Q.representatives(disturbed, ["strand", "label"], "sigma", "seq_id", 6)


@query(
    "stable_table",
    f"""WITH {WINDOWS_TABLE} SELECT strand, seq_id, start_ts, speed, width, sigma, ptp, grade, label FROM windows
        WHERE sigma <= 2.0 ORDER BY sigma, seq_id""",
    "speed width sigma ptp",
)
def stable_table(spark, sf):
    return (
        windows_table(spark, sf)
        .filter(F.col("sigma") <= 2.0)
        .select("strand", "seq_id", "start_ts", "speed", "width", "sigma", "ptp", "grade", "label")
        .orderBy("sigma", "seq_id")
    )


CORR_COLUMNS = {"seq_id": "seq_id", "speed": "casting_speed", "width": "mold_width", "sigma": "mold_level_sigma"}
CORR_SQL = f"WITH {WINDOWS_TABLE} SELECT seq_id, speed AS casting_speed, width AS mold_width, sigma AS mold_level_sigma, label AS disturbance_type FROM windows"


@query("corr_dataset_sql", CORR_SQL, "casting_speed mold_width mold_level_sigma")
def corr_dataset_sql(spark, sf):
    return parameter_correlations(spark, windows_table(spark, sf), CORR_COLUMNS, "label", "All")


@query("corr_dataset_label_sql", f"{CORR_SQL} WHERE label = 'Slow drift'", "casting_speed mold_width mold_level_sigma")
def corr_dataset_label_sql(spark, sf):
    return parameter_correlations(spark, windows_table(spark, sf), CORR_COLUMNS, "label", "Slow drift")


@query(
    "grade_dataset_sql",
    f"""WITH {WINDOWS_TABLE} SELECT grade AS quality_grade, sigma AS mold_level_sigma, speed AS casting_speed, seq_id, label AS disturbance_type
        FROM windows WHERE grade IS NOT NULL""",
    "mold_level_sigma casting_speed",
)
def grade_dataset_sql(spark, sf):
    columns = {
        "sigma": "mold_level_sigma",
        "speed": "casting_speed",
        "seq_id": "seq_id",
        "label": "disturbance_type",
    }
    return grades(spark, windows_table(spark, sf), columns, "grade")
