"""Sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import labels as L
from ..functions import timing as TM
from ..functions.features import add_features
from ..operators.reshape import melt, union_strands
from ..operators.sampling import first_span, sample_about, sample_cap, sample_fraction, time_slice
from ..sources import readers, sinks
from .registry import query
from .tables import (
    CASTINGS,
    SIGNAL,
    SPEC,
    WINDOWS_TABLE,
    castings,
    signal,
    table,
    windows_table,
)

# The number that samples order keys by.
PLACE = "('0x' || substr(md5(concat_ws('|', 42, {})), 1, 15))::BIGINT"
LINEITEM_DOUBLES = "l_quantity l_extendedprice l_discount l_tax"

EVENTS_SQL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


@query("scan_parquet", EVENTS_SQL, "value")
def scan_parquet(spark, sf):
    return readers.scan_files(spark, [f"{sf}/events.parquet"])


@query("read_log", "SELECT event_id, event_type, value, ts AS \"plainTimeStamp\" FROM events", "value")
def read_log(spark, sf):
    """Two files in different folders are found by a mark in their names."""
    folder = sinks.scratch_path(spark, "logs")
    events = table(spark, sf, "events").select(
        "event_id", "event_type", "value", F.col("ts").alias("plainTimeStamp")
    )
    events.filter(F.col("event_id") % 2 == 0).write.parquet(f"{folder}/a")
    events.filter(F.col("event_id") % 2 != 0).write.parquet(f"{folder}/b/c")
    return readers.read_log(spark, folder, "part-")


@query("scan_csv", EVENTS_SQL, "value")
def scan_csv(spark, sf):
    events = table(spark, sf, "events")
    path = f"{sinks.scratch_path(spark, 'events')}.csv"
    sinks.write_csv(events, path)
    return readers.scan_files(spark, [path], events.schema)


@query(
    "scan_metadata_csv",
    f"WITH {CASTINGS} SELECT casting_id AS \"Casting ID\", grade AS \"Quality casting\", ts_start, ts_end FROM castings",
)
def scan_metadata_csv(spark, sf):
    """Times are written with an offset and read as local digits."""
    fmt = "yyyy-MM-dd HH:mm:ss'+02:00'"
    rows = castings(spark, sf).select(
        F.col("casting_id").alias("Casting ID"),
        F.lit(6).alias("Strand ID"),
        F.date_format("ts_start", fmt).alias("Datetime start first heat"),
        F.date_format("ts_end", fmt).alias("Datetime start last heat"),
        F.col("grade").alias("Quality casting"),
        F.lit(1).alias("Heat Count"),
    )
    path = sinks.scratch_path(spark, "castings")
    rows.write.option("header", True).option("sep", ";").csv(path)
    meta = readers.read_metadata(spark, path, local_time=True)
    return meta.select("Casting ID", "Quality casting", "ts_start", "ts_end")


@query("project_present", "SELECT ts, event_id, value FROM events", "value")
def project_present(spark, sf):
    return C.project_present(
        table(spark, sf, "events"), ["ts", "absent", "event_id", "value", "ts"]
    )


@query("sink_csv", EVENTS_SQL, "value")
def sink_csv(spark, sf):
    events = table(spark, sf, "events")
    path = sinks.scratch_path(spark, "sink")
    sinks.write_csv(events, path)
    return spark.read.schema(events.schema).option("header", True).csv(path)


@query("sink_parquet", "SELECT event_id, event_type AS strand, ts, value FROM events", "value")
def sink_parquet(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("strand"), "ts", "value"
    )
    path = sinks.scratch_path(spark, "sink")
    sinks.write_parquet(events, path, ("strand",))
    return spark.read.parquet(path)


def _saved(spark, df, save):
    location = sinks.scratch_path(spark, "db")
    name = "strandlens_" + location.rsplit("-", 1)[1]
    sinks.create_database(spark, name, location)
    target = sinks.table_name(name, "result", "23-6")
    save(df, target, f"{location}/result")
    return spark.table(target)


PART_SQL = 'SELECT p_partkey AS "part_key", p_retailprice AS "price_USD_unit" FROM part'


def _named_parts(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("part key"), F.col("p_retailprice").alias("price [USD/unit]")
    )


@query("sink_table_new", PART_SQL, "price_USD_unit")
def sink_table_new(spark, sf):
    return _saved(spark, _named_parts(spark, sf), sinks.save_new_table)


@query("sink_table_replace", PART_SQL, "price_USD_unit")
def sink_table_replace(spark, sf):
    def twice(df, target, path):
        sinks.replace_table(df.select("part key"), target, path)
        sinks.replace_table(df, target, path)

    return _saved(spark, _named_parts(spark, sf), twice)


@query("clean_names", PART_SQL, "price_USD_unit")
def clean_names(spark, sf):
    return C.clean_names(_named_parts(spark, sf))


@query(
    "normalize_ts",
    "SELECT event_id, DATE_TRUNC('second', ts) AS \"plainTimeStamp\" FROM events",
)
def normalize_ts(spark, sf):
    """Epoch seconds on odd rows, milliseconds on even ones."""
    us = TM.micros("ts")
    epoch = F.when(F.col("event_id") % 2 == 0, us / 1e3).otherwise(us / 1e6)
    events = table(spark, sf, "events").select("event_id", epoch.alias("dt_timestamp_utc"))
    return TM.with_plain_timestamp(events).select(
        "event_id", F.col("plainTimeStamp").cast("timestamp_ntz").alias("plainTimeStamp")
    )


@query(
    "convert_units",
    """SELECT l_orderkey, l_linenumber, l_discount * 60 AS "castingSpeed", l_tax * 1000 AS "Mold Level",
              l_quantity * 60000 AS "Argon Flow SEN", l_extendedprice AS "moldWidth" FROM lineitem""",
    ["castingSpeed", "Mold Level", "Argon Flow SEN", "moldWidth"],
)
def convert_units(spark, sf):
    return C.convert_units(
        table(spark, sf, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            F.col("l_discount").alias("castingSpeed"),
            F.col("l_tax").alias("Mold Level"),
            F.col("l_quantity").alias("Argon Flow SEN"),
            F.col("l_extendedprice").alias("moldWidth"),
        )
    )


@query(
    "filter_process",
    f"WITH {SIGNAL} SELECT strand, event_id, speed, depth FROM signal WHERE speed >= 0.5 AND depth BETWEEN 0.1 AND 0.26",
    "speed depth",
)
def filter_process(spark, sf):
    rows = signal(spark, sf).select("strand", "event_id", "speed", "depth")
    return C.process_filter(rows, "speed", "depth", 0.5, 0.1, 0.26)


@query(
    "dropna_subset",
    f"WITH {SIGNAL} SELECT event_id, gas_a, quality, level FROM signal WHERE gas_a IS NOT NULL AND quality IS NOT NULL",
    "gas_a level",
)
def dropna_subset(spark, sf):
    return signal(spark, sf).select("event_id", "gas_a", "quality", "level").na.drop(
        subset=["gas_a", "quality"]
    )


@query(
    "filter_active",
    f"WITH {SIGNAL} SELECT event_id, k, gas_a FROM signal WHERE COALESCE(k <> 0, TRUE) AND COALESCE(gas_a <> 0, TRUE)",
    "k gas_a",
)
def filter_active(spark, sf):
    rows = signal(spark, sf).select("event_id", "k", "gas_a")
    return C.active_filter(rows, ["k", "gas_a", "absent"])


@query("strip_offset_ts", "SELECT event_id, DATE_TRUNC('second', ts) AS local_ts FROM events")
def strip_offset_ts(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+02:00'")
    events = table(spark, sf, "events").select("event_id", text.alias("text"))
    return events.select("event_id", TM.strip_offset("text").alias("local_ts"))


@query(
    "utc_to_local",
    """SELECT o_orderkey, timezone('Europe/Amsterdam', timezone('UTC', o_orderdate)) AS local_ts FROM orders""",
)
def utc_to_local(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", TM.utc_to_local("o_orderdate").alias("local_ts")
    )


@query(
    "null_status",
    f"""WITH {SIGNAL} SELECT event_id, CASE WHEN quality IS NULL THEN 'No Casting (NULL)'
        ELSE 'Active Casting' END AS status FROM signal""",
)
def null_status(spark, sf):
    return signal(spark, sf).select("event_id", C.null_status("quality").alias("status"))


SENSORS_SQL = """sensors AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, NULLIF(l_discount, 0) * 100 AS b,
  NULLIF(l_tax, 0) * 100 AS c, l_extendedprice / 1000 AS d FROM lineitem)"""


def sensors(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("a"),
        (F.nullif("l_discount", F.lit(0.0)) * 100).alias("b"),
        (F.nullif("l_tax", F.lit(0.0)) * 100).alias("c"),
        (F.col("l_extendedprice") / 1000).alias("d"),
    )


@query(
    "row_mean",
    f"""WITH {SENSORS_SQL} SELECT l_orderkey, l_linenumber,
        (COALESCE(b, 0) + COALESCE(c, 0)) / NULLIF(CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT), 0) AS mean_bc
        FROM sensors""",
    "mean_bc",
)
def row_mean(spark, sf):
    return sensors(spark, sf).select(
        "l_orderkey", "l_linenumber", C.row_mean("b", "c").alias("mean_bc")
    )


@query(
    "row_range",
    f"WITH {SENSORS_SQL} SELECT l_orderkey, l_linenumber, GREATEST(a, b, c) - LEAST(a, b, c) AS range_abc FROM sensors",
    "range_abc",
)
def row_range(spark, sf):
    return sensors(spark, sf).select(
        "l_orderkey", "l_linenumber", C.row_range("a", "b", "c").alias("range_abc")
    )


@query(
    "row_features",
    f"""WITH {SENSORS_SQL}, m AS (SELECT *,
          (COALESCE(a, 0) + COALESCE(b, 0)) / NULLIF(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT), 0) AS bff,
          (COALESCE(c, 0) + COALESCE(d, 0)) / NULLIF(CAST(c IS NOT NULL AS INT) + CAST(d IS NOT NULL AS INT), 0) AS bfl
          FROM sensors)
        SELECT l_orderkey, l_linenumber, bff AS meniscus_bff_avg, bfl AS meniscus_bfl_avg,
          GREATEST(a, b) - LEAST(a, b) AS meniscus_bff_range, GREATEST(c, d) - LEAST(c, d) AS meniscus_bfl_range,
          bff - bfl AS "meniscus_FF_LF_asymmetry", a AS "cheb_X1_bff", b AS "cheb_X1_bfl", ABS(a) AS "abs_cheb_X1_bff",
          ABS(b) AS "abs_cheb_X1_bfl", a - b AS "cheb_X1_FF_LF_diff", c AS "cheb_X2_bff", ABS(c) AS "abs_cheb_X2_bff",
          d AS "cheb_X4_bfl", a - d AS "EMBR_DC_Bottom_LR_diff", b - c AS "EMBR_AC_Master_LR_diff",
          c - d AS "ML_LR_asymmetry", ABS(c - d) AS "ML_LR_abs_asymmetry" FROM m""",
    "meniscus_bff_avg meniscus_bfl_avg meniscus_bff_range meniscus_bfl_range meniscus_FF_LF_asymmetry cheb_X1_bff"
    " cheb_X1_bfl abs_cheb_X1_bff abs_cheb_X1_bfl cheb_X1_FF_LF_diff cheb_X2_bff abs_cheb_X2_bff cheb_X4_bfl"
    " EMBR_DC_Bottom_LR_diff EMBR_AC_Master_LR_diff ML_LR_asymmetry ML_LR_abs_asymmetry",
)
def row_features(spark, sf):
    raw = {
        "meniscus_bff_c01": "a",
        "meniscus_bff_c02": "b",
        "meniscus_bfl_c01": "c",
        "meniscus_bfl_c20": "d",
        "meniscusFlatness_bff_1": "a",
        "meniscusFlatness_bfl_1": "b",
        "meniscusFlatness_bff_2": "c",
        "meniscusFlatness_bfl_4": "d",
        "EMBR Current DC Left Bottom": "a",
        "EMBR Current DC Right Bottom": "d",
        "EMBR Current AC Left Master": "b",
        "EMBR Current AC Right Master": "c",
        "Mold Level Sensor Left": "c",
        "Mold Level Sensor Right": "d",
    }
    wide = sensors(spark, sf).select(
        "l_orderkey", "l_linenumber", *[F.col(c).alias(n) for n, c in raw.items()]
    )
    return add_features(wide).drop(*raw)


@query(
    "gas_totals",
    f"""WITH {SENSORS_SQL} SELECT l_orderkey, l_linenumber, COALESCE(b, 0) + COALESCE(c, 0) AS total,
        (COALESCE(b, 0) + COALESCE(c, 0)) / NULLIF(CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT), 0) AS average,
        b + c AS strict_total FROM sensors""",
    "total average strict_total",
)
def gas_totals(spark, sf):
    return sensors(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        C.row_total("b", "c").alias("total"),
        C.row_mean("b", "c").alias("average"),
        (F.col("b") + F.col("c")).alias("strict_total"),
    )


@query(
    "width_bin",
    """SELECT p_partkey, CASE WHEN w >= 0 AND w < 1.2 THEN '<=1.2 m' WHEN w >= 1.2 AND w < 1.5 THEN '1.2-1.5 m'
         WHEN w >= 1.5 AND w < 1.8 THEN '1.5-1.8 m' WHEN w >= 1.8 AND w < 2.0 THEN '1.8-2.0 m' ELSE '>2.0 m' END AS width_bin
       FROM (SELECT p_partkey, (p_retailprice - 850) / 100 + p_size / 40.0 AS w FROM part)""",
)
def width_bin(spark, sf):
    w = (F.col("p_retailprice") - 850) / 100 + F.col("p_size") / 40.0
    return table(spark, sf, "part").select("p_partkey", C.width_bin(w).alias("width_bin"))


@query(
    "grade_family",
    """SELECT p_partkey, CASE WHEN f IN ('1', '2', '3', '5') THEN f ELSE 'N' END AS family,
              CASE f WHEN '1' THEN 'Family 1 (Low-C)' WHEN '2' THEN 'Family 2' WHEN '3' THEN 'Family 3 (Peritectic)'
                     WHEN '5' THEN 'Family 5 (HSLA)' ELSE 'Family N (Unclassified)' END AS family_name
       FROM (SELECT p_partkey, SUBSTR(TRIM(REPLACE(p_brand, 'Brand#', ' ')), 1, 1) AS f FROM part)""",
)
def grade_family(spark, sf):
    grade = F.replace("p_brand", F.lit("Brand#"), F.lit(" "))
    family = C.grade_family(grade)
    return table(spark, sf, "part").select("p_partkey", family.alias("family")).withColumn(
        "family_name", C.family_name("family")
    )


@query(
    "round_bin",
    """SELECT l_orderkey, l_linenumber, ROUND_EVEN(l_extendedprice / 1000 * 10, 0) / 10 AS rounded,
              ROUND_EVEN(l_quantity / 4, 0) * 4 AS stepped FROM lineitem""",
    "rounded stepped",
)
def round_bin(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        C.round_even(F.col("l_extendedprice") / 1000, 1).alias("rounded"),
        C.round_to_step("l_quantity", 4).alias("stepped"),
    )


@query("label_disturbance", f"WITH {WINDOWS_TABLE} SELECT seq_id, label FROM windows")
def label_disturbance(spark, sf):
    return windows_table(spark, sf).select("seq_id", L.disturbance_label().alias("label"))


@query(
    "label_disturbance_alt",
    f"""WITH {WINDOWS_TABLE} SELECT seq_id, CASE WHEN NOT has_disturbance THEN 'Normal' ELSE CONCAT_WS(' + ',
          CASE WHEN has_excursion_event THEN 'Excursion' END, CASE WHEN has_high_variability THEN 'High variability' END,
          CASE WHEN has_transient_bump THEN 'Transient bump' END, CASE WHEN has_slow_drift THEN 'Slow drift' END) END AS label
        FROM windows""",
)
def label_disturbance_alt(spark, sf):
    return windows_table(spark, sf).select(
        "seq_id", L.disturbance_label(L.LABEL_ORDER_ALT).alias("label")
    )


@query(
    "label_order",
    f"""WITH {WINDOWS_TABLE} SELECT label, COUNT(*) AS n, CAST(CASE label WHEN 'Normal' THEN 1 WHEN 'High variability' THEN 2
          WHEN 'Transient bump' THEN 3 WHEN 'Slow drift' THEN 4 WHEN 'Excursion' THEN 5
          WHEN 'Excursion + Transient bump + High variability' THEN 6 ELSE 7 END AS BIGINT) AS place
        FROM windows GROUP BY label""",
)
def label_order(spark, sf):
    counted = windows_table(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", L.display_rank("label")).orderBy("place", "label")


@query(
    "coerce_types",
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS number,
              CASE WHEN event_id % 4 <> 0 THEN ts END AS moment FROM events""",
    "number",
)
def coerce_types(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.col("value").cast("string")).otherwise("n/a").alias("v"),
        F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("string")).otherwise("?").alias("t"),
    )
    return text.select("event_id", C.to_number("v").alias("number"), C.to_time("t").alias("moment"))


@query(
    "finite_only",
    "SELECT event_id, value AS x FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0",
    "x",
)
def finite_only(spark, sf):
    broken = (
        F.when(F.col("event_id") % 5 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 7 == 0, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    rows = table(spark, sf, "events").select("event_id", broken.alias("x"))
    return rows.filter(C.finite("x"))


@query(
    "stable_split",
    f"WITH {WINDOWS_TABLE} SELECT seq_id, sigma <= 2.0 AS stable FROM windows WHERE sigma IS NOT NULL",
)
def stable_split(spark, sf):
    rows = windows_table(spark, sf).filter(F.col("sigma").isNotNull())
    return rows.select("seq_id", (F.col("sigma") <= 2.0).alias("stable"))


@query(
    "time_slice",
    f"""WITH {SIGNAL} SELECT 'range' AS part, strand, event_id, ts FROM signal
          WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00'
        UNION ALL SELECT 'head', strand, event_id, ts
          FROM (SELECT *, MIN(ts) OVER (PARTITION BY strand) AS t0 FROM signal) WHERE ts <= t0 + INTERVAL 30 HOUR""",
)
def time_slice_query(spark, sf):
    rows = signal(spark, sf).select("strand", "event_id", "ts")
    start, end = (
        F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 06:00:00", "2024-01-12 18:30:00")
    )
    middle = time_slice(rows, "ts", start, end).withColumn("part", F.lit("range"))
    head = first_span(rows, ["strand"], "ts", "30 hours").withColumn("part", F.lit("head"))
    return middle.unionByName(head)


@query("normal_only", f"WITH {WINDOWS_TABLE} SELECT seq_id, sigma FROM windows WHERE label = 'Normal'", "sigma")
def normal_only(spark, sf):
    return windows_table(spark, sf).filter(F.col("label") == L.NORMAL).select("seq_id", "sigma")


@query("sample_fraction", f"SELECT * FROM events WHERE {PLACE.format('event_id')} % 1000000 < 250000", "value")
def sample_fraction_query(spark, sf):
    return sample_fraction(table(spark, sf, "events"), ["event_id"], 0.25, 42)


@query(
    "sample_about",
    f"""SELECT * FROM lineitem WHERE {PLACE.format('l_orderkey, l_linenumber')} % 1000000
          < LEAST(1.0::DOUBLE, 10000::DOUBLE / (SELECT COUNT(*) FROM lineitem)::DOUBLE) * 1000000""",
    LINEITEM_DOUBLES,
)
def sample_about_query(spark, sf):
    return sample_about(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 10_000, 42)


@query(
    "sample_cap",
    f"SELECT * FROM lineitem ORDER BY {PLACE.format('l_orderkey, l_linenumber')}, l_orderkey, l_linenumber LIMIT 10000",
    LINEITEM_DOUBLES,
)
def sample_cap_query(spark, sf):
    return sample_cap(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 10_000, 42)


@query(
    "union_strands",
    """SELECT 'A' AS strand, event_id, value, NULL AS extra FROM events WHERE event_type = 'click'
       UNION ALL SELECT 'B', event_id, value, props FROM events WHERE event_type <> 'click'""",
    "value",
)
def union_strands_query(spark, sf):
    events = table(spark, sf, "events")
    first = events.filter(F.col("event_type") == "click").select("event_id", "value")
    second = events.filter(F.col("event_type") != "click").select(
        "event_id", "value", F.col("props").alias("extra")
    )
    return union_strands({"A": first, "B": second})


@query(
    "melt_parameters",
    f"""WITH {SENSORS_SQL} SELECT l_orderkey, l_linenumber, 'a' AS parameter, a AS value FROM sensors
        UNION ALL SELECT l_orderkey, l_linenumber, 'b', b FROM sensors
        UNION ALL SELECT l_orderkey, l_linenumber, 'c', c FROM sensors""",
    "value",
)
def melt_parameters(spark, sf):
    rows = sensors(spark, sf).select("l_orderkey", "l_linenumber", "a", "b", "c")
    return melt(rows, ["l_orderkey", "l_linenumber"], ["a", "b", "c"])
