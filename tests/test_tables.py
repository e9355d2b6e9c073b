"""Rows, joins, aggregates, quantiles, sources and sinks."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from strandlens.functions import columns as C
from strandlens.functions import labels as L
from strandlens.functions import timing as TM
from strandlens.functions.features import add_features
from strandlens.operators import intervals as I
from strandlens.operators import quantiles as Q
from strandlens.operators import sampling as P
from strandlens.plans.datasets import series_window
from strandlens.operators import reports as R
from strandlens.operators import stats as S
from strandlens.sources import readers, sinks
from strandlens.spec import AnalysisConfig, StrandConfig

T0 = datetime(2025, 5, 1)


def test_default_thresholds():
    cfg = AnalysisConfig()
    assert (cfg.window_size, cfg.speed_threshold, cfg.stable_sigma) == (300, 0.1, 2.0)
    assert StrandConfig(6, "Strand 23-6", "/data/strand_6", "/out/").folder == "/out/strand_6"


def test_epoch_seconds_and_milliseconds(spark):
    df = spark.createDataFrame([(1_700_000_000.0,), (1_700_000_000_500.0,)], "dt_timestamp_utc double")
    seconds = TM.with_plain_timestamp(df).select(F.unix_timestamp("plainTimeStamp")).collect()
    assert [r[0] for r in seconds] == [1_700_000_000] * 2


def test_time_column_priority(spark):
    df = spark.createDataFrame([("2025-05-01 10:00:00", 5)], "dt_timestamp_utc string, TIMESTAMP bigint")
    assert TM.with_plain_timestamp(df).first().plainTimeStamp == datetime(2025, 5, 1, 10)
    text = spark.createDataFrame([("2025-05-01 10:00:00",)], "TIMESTAMP string")
    assert TM.with_plain_timestamp(text).columns == ["TIMESTAMP"]
    bad = spark.createDataFrame([("soon",)], "plainTimeStamp string")
    assert TM.with_plain_timestamp(bad).first().plainTimeStamp is None


def test_offset_is_kept_or_stripped(spark):
    df = spark.createDataFrame([("2025-05-01 21:56:21+02:00",)], "t string")
    row = df.select(
        F.col("t").cast("timestamp").cast("timestamp_ntz").alias("instant"), TM.strip_offset("t").alias("local")
    ).first()
    assert (row.instant.hour, row.local.hour) == (19, 21)


def test_zone_knows_summer_time(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 1, 12),), (datetime(2025, 7, 1, 12),)], "t timestamp_ntz")
    assert [r[0].hour for r in df.select(TM.utc_to_local("t")).collect()] == [13, 14]


def test_bins_and_families(spark):
    df = spark.createDataFrame([(1.2, " 3A"), (2.0, "4B"), (None, ""), (-1.0, None)], "w double, g string")
    rows = df.select(C.width_bin("w"), C.grade_family("g")).collect()
    assert [r[0] for r in rows] == ["1.2-1.5 m", ">2.0 m", ">2.0 m", ">2.0 m"]
    assert [r[1] for r in rows] == ["3", "N", "N", "N"]


def test_active_filter_keeps_missing_currents(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,)], "c double")
    assert C.active_filter(df, ["c", "absent"]).count() == 2


def test_labels(spark):
    df = spark.createDataFrame([(True, False, True, True), (False,) * 4], list(L.FLAGS))
    rows = df.select(L.disturbance_label(), L.disturbance_label(L.LABEL_ORDER_ALT), L.any_flag()).collect()
    assert rows[0][:] == (
        "Excursion + Transient bump + High variability", "Excursion + High variability + Transient bump", True
    )
    assert rows[1][:] == ("Normal", "Normal", False)


def test_all_features(spark):
    names = [f"meniscus_{f}_c{i:02d}" for f in ("bff", "bfl") for i in range(1, 21)]
    names += [f"meniscusFlatness_{f}_{i}" for f in ("bff", "bfl") for i in range(1, 5)]
    names += [f"EMBR Current {c} {s} {p}" for s in ("Left", "Right") for c, p in (("DC", "Bottom"), ("AC", "Master"), ("DC", "Master"))]
    names += ["Mold Level Sensor Left", "Mold Level Sensor Right"]
    df = spark.createDataFrame([tuple(float(i) for i in range(len(names)))], names)
    out = add_features(df)
    assert len(out.columns) - len(names) == 24
    row = out.first()
    assert row["meniscus_bff_avg"] == 9.5 and row["meniscus_FF_LF_asymmetry"] == -20.0
    assert row["ML_LR_abs_asymmetry"] == 1.0


def castings(spark):
    h = lambda n: T0 + timedelta(hours=n)
    return spark.createDataFrame(
        [(1, h(0), h(2), "1A"), (2, h(1), h(3), "2A"), (3, h(10), h(11), "3A"), (4, h(20), h(22), "4A"), (5, h(30), h(31), "5A")],
        "casting_id int, ts_start timestamp_ntz, ts_end timestamp_ntz, grade string",
    )


def at(spark, *hours):
    return spark.createDataFrame([(T0 + timedelta(hours=h),) for h in hours], "ts timestamp_ntz")


def test_closed_intervals_and_overlap(spark):
    points = at(spark, 0, 1.5, 3, 3.0001, 11)
    out = I.attach(points, castings(spark), "ts", "ts_start", "ts_end", ["casting_id"], bucket_seconds=1800)
    got = sorted((r.ts, r.casting_id or 0) for r in out.collect())
    assert [g[1] for g in got] == [1, 1, 2, 2, 0, 3]


def test_coverage_states(spark):
    points = at(spark, 0, 2, 1, 2.5, 10, 10.5, 20.5, 22)
    out = I.coverage(points, castings(spark), "ts", "ts_start", "ts_end", ["casting_id"])
    got = {r.casting_id: (r.coverage_status, r.data_point_count) for r in out.collect()}
    assert got == {
        1: ("FULL COVERAGE", 3), 2: ("EARLY END", 3), 3: ("EARLY END", 2), 4: ("LATE START", 2), 5: ("NO DATA", 0)
    }


def test_gap_classes_and_overlaps(spark):
    h = lambda n: T0 + timedelta(hours=n)
    gaps = spark.createDataFrame(
        [(1, h(10.1), h(10.9)), (2, h(10.1), h(12)), (3, h(5), h(6)), (4, h(9), h(25)), (5, h(3), h(4))],
        "id int, a timestamp_ntz, b timestamp_ntz",
    )
    kinds = I.classify_gaps(gaps, castings(spark), "a", "b", "ts_start", "ts_end", "casting_id")
    assert {r.id: r.gap_type.split()[0] for r in kinds.collect()} == {
        1: "Within", 2: "Between", 3: "Between", 4: "Between", 5: "Between"
    }
    touching = I.overlaps_any(gaps, castings(spark), ("a", "b"), ("ts_start", "ts_end"), ["id"])
    assert sorted(r.id for r in touching.collect()) == [1, 2, 4, 5]


def test_quantiles_match_exact_ones(spark):
    rng = random.Random(9)
    groups = {
        "spread": [rng.lognormvariate(0, 4) * rng.choice([1, -1]) for _ in range(501)],
        "tight": [1500 + rng.random() * 1e-6 for _ in range(400)],
        "same": [7.0] * 300 + [8.0],
        "one": [3.5],
        "zeros": [0.0] * 50 + [-1.0, 1.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("spread", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    out = Q.quantiles(df, ["g"], "v", {"lo": 0.0, "q": 0.2, "m": 0.5, "p": 0.95, "hi": 1.0}).collect()
    assert len(out) == len(groups)
    for r in out:
        s = sorted(groups[r.g])
        for name, p in (("lo", 0.0), ("q", 0.2), ("m", 0.5), ("p", 0.95), ("hi", 1.0)):
            at_ = p * (len(s) - 1)
            a, b = s[int(at_)], s[min(int(at_) + 1, len(s) - 1)]
            assert r[name] == pytest.approx(a + (b - a) * (at_ - int(at_)), rel=1e-12, abs=1e-15)
        assert r.m == pytest.approx(statistics.median(s), rel=1e-12)


@pytest.mark.parametrize("n,total,want", [(6, 10, [0, 2, 4, 5, 7, 9]), (6, 4, [0, 1, 2, 3]), (1, 3, [0, 1, 2]), (2, 5, [0, 4])])
def test_representatives(spark, n, total, want):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(total)], "g string, id bigint, s double")
    out = Q.representatives(df, ["g"], "s", "id", n).orderBy("rank").collect()
    assert [r.id for r in out] == want
    assert [r["rank"] for r in out] == list(range(1, len(want) + 1))


def test_representatives_among_equal_values(spark):
    df = spark.createDataFrame([("a", i, float(i // 20)) for i in range(41)], "g string, id bigint, s double")
    out = Q.representatives(df, ["g"], "s", "id", 5).orderBy("rank").collect()
    assert [r.id for r in out] == [0, 10, 20, 30, 40]


@pytest.mark.parametrize("n", [1, 7, 100, 5000])
def test_capped_sample_has_exactly_n_rows(spark, n):
    df = spark.range(3000)
    rows = [r.id for r in P.sample_cap(df, ["id"], n, 42).collect()]
    assert len(rows) == len(set(rows)) == min(n, 3000)
    assert sorted(rows) == sorted(r.id for r in P.sample_cap(df.repartition(7), ["id"], n, 42).collect())


@pytest.mark.parametrize("n", [1, 299, 450, 1700])
def test_capped_sample_takes_the_same_rows_of_a_shared_key(spark, n):
    df = spark.range(3000).select((F.col("id") % 10).alias("id"), (3000 - F.col("id")).alias("v"), F.create_map(F.lit("v"), "id").alias("m"))
    runs = [[(r.id, r.v, r.m["v"]) for r in P.sample_cap(d, ["id"], n, 42).collect()] for d in (df, df.repartition(7), df.orderBy("v"))]
    assert len(runs[0]) == n and sorted(runs[0]) == sorted(runs[1]) == sorted(runs[2])
    every = {k: sorted(3000 - i for i in range(3000) if i % 10 == k) for k in range(10)}
    for k in {k for k, *_ in runs[0]}:
        mine = sorted(v for i, v, _ in runs[0] if i == k)
        assert mine == every[k][: len(mine)]


def test_shares_do_not_depend_on_the_layout(spark):
    df = spark.range(20_000)
    for sample in (
        lambda d: P.sample_fraction(d, ["id"], 0.25, 7),
        lambda d: P.sample_about(d, ["id"], 5_000, 7),
    ):
        ids = {r.id for r in sample(df).collect()}
        assert 4_600 < len(ids) < 5_400
        assert ids == {r.id for r in sample(df.repartition(5)).collect()}
    assert P.sample_about(df, ["id"], 50_000, 7).count() == 20_000


@pytest.mark.parametrize("limit", [3, 90, 1000, None])
def test_series_window_keeps_the_first_rows(spark, limit):
    df = spark.range(200).select(
        "id", F.expr("timestamp_ntz'2025-05-01 00:00:00' + make_dt_interval(0, 0, id * 7)").alias("ts")
    )
    out = series_window(spark, df, "ts", ["id"], "2025-05-01 01:00:00", "2025-05-01 20:00:00", limit)
    want = [i for i in range(200) if 60 <= i * 7 <= 20 * 60][:limit]
    assert [r.id for r in out.collect()] == want


def test_mode_unique_and_range(spark):
    df = spark.createDataFrame(
        [("m", "a", 1.0), ("m", "b", 2.0), ("m", "a", None), ("m", "b", 4.0), ("u", "x", 1.0), ("u", " x", 5.0), ("u", "y", 2.0), ("n", None, 1.0)],
        "g string, q string, v double",
    )
    rows = {
        r.g: r
        for r in df.groupBy("g").agg(S.modal("q").alias("mode"), S.unique_or_multiple("q").alias("u"), S.strict_ptp("v").alias("ptp")).collect()
    }
    assert rows["m"].mode == "a" and rows["m"].ptp is None
    assert rows["u"].u == "MULTIPLE: x | y" and rows["u"].ptp == 4.0
    assert rows["n"].u is None and rows["n"].mode is None


def test_category_profile_needs_no_grid_join(spark):
    rows = [("s", "Stable", float(p), 1.0, a) for p, a in ((2, 0.1), (4, -0.2), (5, 0.0))]
    df = spark.createDataFrame(rows, "strand string, cat string, ptp double, sigma double, asym double")
    out = R.category_profile(df, ["strand"], "cat", "ptp", "sigma", asym=F.col("asym"), points=5).collect()
    for r in out:
        x = -1 + r.point * 0.5
        ys = [0.5 * p * (2 * x * x - 1 + 0.3 * x * a) for _, _, p, _, a in rows]
        assert r.profile_mean == pytest.approx(statistics.mean(ys), abs=1e-12)
        assert r.profile_std == pytest.approx(statistics.pstdev(ys), abs=1e-7)


def test_log_discovery(spark, tmp_path):
    t = pa.table({"plainTimeStamp": ["2025-05-01 00:00:00"], "v": [1.0]})
    for folder in ("a", "b", "c"):
        (tmp_path / folder).mkdir()
    pq.write_table(t, tmp_path / "a" / "boExpert_1.parquet")
    pacsv.write_csv(t, tmp_path / "a" / "boExpert_2.csv")
    pacsv.write_csv(t, tmp_path / "b" / "dtExpert.csv")
    pq.write_table(t, tmp_path / "c" / "other.parquet")
    bo, dt = readers.read_logs(spark, str(tmp_path))
    assert (bo.count(), dt.count()) == (1, 1)
    assert dict(dt.dtypes)["plainTimeStamp"].startswith("timestamp")
    assert readers.read_log(spark, str(tmp_path), "missing") is None
    assert readers.scan_files(spark, []) is None


def test_tables_are_created_once_or_replaced(spark, tmp_path):
    sinks.create_database(spark, "strandlens_test", str(tmp_path / "db"))
    df = spark.createDataFrame([(1, 2.0)], "`a b` int, `MOLD_LEVEL_std [mm]` double")
    name = sinks.table_name("strandlens_test", "stats", "23-6")
    sinks.save_new_table(df, name)
    with pytest.raises(AnalysisException):
        sinks.save_new_table(df, name)
    sinks.replace_table(df.select("a b"), name)
    assert spark.table(name).columns == ["a_b"]
    assert name == "strandlens_test.stats_strand_23_6"


def test_metadata_file(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text(
        "Casting ID;Strand ID;Datetime start first heat;Datetime start last heat;Quality casting;Heat Count\n"
        "7;6;2025-05-01 21:56:21+02:00;2025-05-02 01:00:00+02:00;3A;4\n"
    )
    local = readers.read_metadata(spark, str(path), local_time=True).first()
    assert local["ts_start"].hour == 21 and local["Casting ID"] == 7
    instant = readers.read_metadata(spark, str(path)).select(F.col("ts_start").cast("timestamp_ntz")).first()
    assert instant[0].hour == 19


def test_nan_is_missing(spark):
    nan = float("nan")
    rows = [(float(i), float(i * i)) for i in range(10)] + [(nan, 1.0), (2.0, nan), (None, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    bins = R.histogram(df, "x", 9).orderBy("bin").collect()
    assert sum(r.n for r in bins) == 11 and (bins[0].bin_start, bins[-1].bin_end) == (0.0, 9.0)
    assert sum(r.n for r in R.density_2d(df, "x", "y", 4, 4).collect()) == 10
    table = {r.parameter: r for r in R.quality_table(df, ["x", "y"]).collect()}
    assert table["x"].missing_pct == pytest.approx(200 / 13) and table["x"].max == 9.0
    plain = R.corr_matrix(df.filter("not isnan(x) and not isnan(y)"), ["x", "y"]).collect()
    assert {(r.x, r.y): r.corr for r in R.corr_matrix(df, ["x", "y"]).collect()} == pytest.approx({(r.x, r.y): r.corr for r in plain})


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_intervals_of_all_lengths(spark, how):
    start = datetime(2025, 5, 1)
    points = [(i, start + timedelta(minutes=37 * i) if i % 11 else None) for i in range(300)]
    spans = [(0, start, datetime(9999, 12, 31)), (1, start, start), (2, start + timedelta(minutes=74), start + timedelta(minutes=200))]
    spans += [(3, start + timedelta(days=1), start + timedelta(days=6)), (4, start + timedelta(days=9), start)]
    for some in (spans, spans[1:3], spans[:0]):
        df = I.join_points(
            spark.createDataFrame(points, "id bigint, ts timestamp_ntz"), spark.createDataFrame(some, "span bigint, a timestamp_ntz, b timestamp_ntz"),
            "ts", "a", "b", how=how,
        )
        hits = [(i, [s for s, a, b in some if t is not None and a <= t <= b]) for i, t in points]
        if how == "left_semi":
            assert sorted(r.id for r in df.collect()) == [i for i, h in hits if h]
        else:
            want = [(i, s) for i, h in hits for s in h] + [(i, -1) for i, h in hits if not h and how == "left"]
            assert sorted((r.id, -1 if r.span is None else r.span) for r in df.collect()) == sorted(want)


def test_spans_that_meet_intervals_of_any_length(spark):
    start = datetime(2025, 5, 1)
    spans = [(i, start + timedelta(hours=5 * i), start + timedelta(hours=5 * i + (4000 if i == 3 else 1))) for i in range(40)]
    for some in ([(start + timedelta(hours=99), start + timedelta(hours=101))], [(start + timedelta(days=3), datetime(9999, 1, 1))], [(start, start), (start + timedelta(days=90), start + timedelta(days=91))]):
        df = I.overlaps_any(
            spark.createDataFrame(spans, "id bigint, f timestamp_ntz, u timestamp_ntz"), spark.createDataFrame(some, "a timestamp_ntz, b timestamp_ntz"),
            ("f", "u"), ("a", "b"), ["id"],
        )
        assert sorted(r.id for r in df.collect()) == [i for i, f, u in spans if any(a <= u and b >= f for a, b in some)]


def test_time_column_in_another_spelling(spark):
    df = spark.createDataFrame([(datetime(2025, 5, 1, 10),)], "PlainTimeStamp timestamp_ntz")
    assert TM.with_plain_timestamp(df).columns == ["plainTimeStamp"]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    assert sinks.scratch_path(spark, "x").startswith(sinks.scratch_root(spark))
    monkeypatch.setattr(sinks, "CHECKPOINT_DIR", "spark.no.such.setting")
    assert "strandlens-" in sinks.scratch_root(spark)

    class Cluster:
        conf = spark.conf

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError):
        sinks.scratch_root(Cluster)
