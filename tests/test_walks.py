"""Walks in pieces: composed tables, jumps and picks against a plain walk; numbering over ranges; quantiles by scope; sweeps."""

from __future__ import annotations

import random
import re
import statistics
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlens.operators import intervals as I
from strandlens.operators import ordered as O
from strandlens.operators import quantiles as Q
from strandlens.operators import reports as R
from strandlens.operators import walks as K
from strandlens.plans.datasets import by_day, sequence_detail

T0 = datetime(2025, 5, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _entries(tables: dict, restart: bool) -> dict:
    out, at = {}, {}
    for group, piece in sorted(tables):
        following, offset = at.get(group, (0, 0))
        entry = offset if piece == following else 0 if restart else -1
        if entry >= 0:
            out[group, piece] = entry
        leave = tables[group, piece]
        at[group] = piece + 1, leave[entry] if 0 <= entry < len(leave) else -1
    return out


@pytest.mark.parametrize("restart", [True, False])
def test_entries_through_a_tree_of_tables(spark, monkeypatch, restart):
    """Groups of up to 300 pieces by trees of four, pieces missing at random, tables that forget where they were entered or keep it."""
    monkeypatch.setattr(K, "FAN", 4)
    r = random.Random(3)
    tables = {}
    for group, n in (("a", 300), ("b", 1), ("c", 17), ("d", 64), ("e", 65)):
        for piece in range(n):
            if r.random() < (0.05 if group != "c" else 0) and (restart or piece):
                continue
            least = 0 if restart or r.random() < 0.99 else -1
            tables[group, piece] = [r.randint(least, 4) for _ in range(1 if piece == 0 else 5)]
    df = spark.createDataFrame([(g, p, t) for (g, p), t in tables.items()], "g string, _piece long, _leave array<int>").repartition(4)
    got = {(r["g"], r["_piece"]): r["_entry"] for r in K.chain_entries(df, ["g"], 5, restart).collect()}
    assert got == _entries(tables, restart)


def test_a_series_of_very_many_pieces(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("_piece"), F.array(*[((F.col("id") * 7 + k * 3) % 4).cast("int") for k in range(4)]).alias("_leave"))
    out = K.chain_entries(df, ["g"], 4, True)
    offset, total = 0, 0
    for i in range(n):
        total += offset * (i % 1009)
        offset = (i * 7 + offset * 3) % 4
    assert out.agg(F.sum(F.col("_entry") * (F.col("_piece") % 1009))).first()[0] == total


def test_no_tables_no_entries(spark):
    df = spark.createDataFrame([], "g string, _piece long, _leave array<int>")
    assert K.chain_entries(df, ["g"], 4, True).count() == 0


def test_jumps():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 40)
        jump = np.array([min(n, i + r.randint(1, 6)) for i in range(n)])
        start, seen = r.randrange(n), []
        at = start
        while at < n:
            seen.append(at)
            at = int(jump[at])
        assert K.visits(jump, np.array([start])).tolist() == seen
        assert K.terminals(np.where(jump == n, np.arange(n), jump))[start] == seen[-1]


def test_whole_pieces_within_a_weight():
    r = random.Random(4)
    for _ in range(100):
        rows = [(g, p, r.randint(1, 9)) for g in ("a", None, "b") for p in range(r.randint(0, 6)) for _ in range(r.randint(1, 5))]
        table = pa.table({"g": pa.array([x[0] for x in rows], pa.string()), "p": pa.array([x[1] for x in rows], pa.int64()), "w": pa.array([x[2] for x in rows], pa.int64())})
        weigh = lambda t: t.column("w").to_numpy()
        parts = list(K.whole_pieces(iter(table.to_batches(max_chunksize=r.randint(1, 20))), ["g", "p"], weigh, 20))
        assert [tuple(x.values()) for t, _ in parts for x in t.to_pylist()] == rows
        seen = [{(g, p) for g, p in zip(t.column("g").to_pylist(), t.column("p").to_pylist())} for t, _ in parts]
        assert sum(map(len, seen)) == len(set().union(*seen)) == sum(len(set(n.tolist())) for _, n in parts)
        heaviest = max((sum(w for a, b, w in rows if (a, b) == k) for k in {x[:2] for x in rows}), default=0)
        assert all(weigh(t).sum() <= 20 + heaviest for t, _ in parts)


def test_numbers_along_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice([7.0, 7.0, r.random()]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(6)
    got = {row["i"]: row["k"] for row in O.number_rows(df, ["g"], [F.col("v").asc(), F.col("i").asc()], "k").collect()}
    want = {}
    for g in ("hot", "b", None):
        for k, (_, i) in enumerate(sorted((v, i) for x, v, i in rows if x == g)):
            want[i] = k
    assert got == want


def test_ecdf_of_many_values_in_one_narrow_range(spark):
    n = 200_000
    counts = spark.range(n).select((F.col("id") + 10**12).alias("gap"), (1 + F.col("id") % 3).alias("n"))
    out = O.ecdf(counts, "gap")
    assert "SinglePartition" not in plan(out)
    total = sum(1 + i % 3 for i in range(n))
    stats = out.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.max("cumulative_pct")).first()
    assert tuple(stats) == (total, total, 1, total, 100.0)
    assert out.filter("gap = 1000000000003").agg(F.min("rank")).first()[0] == 1 + 2 + 3 + 1


@pytest.mark.parametrize("limit", [0, 10**6])
def test_quantiles_by_scope_in_two_reads(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "SORTED", limit)
    r = random.Random(4)
    rows = [(r.choice("xy"), r.choice([5.0, r.gauss(0, 100)]), r.random() < 0.3) for _ in range(3000)] + [("x", None, True), ("y", float("nan"), True), ("z", 1.0, False)]
    df = spark.createDataFrame(rows, "g string, v double, c boolean")
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    counted = df.mapInArrow(seen, df.schema)
    scopes = {"all": F.lit(True), "clean": F.col("c")}
    got = {x["g"]: x for x in Q.quantiles(counted, ["g"], "v", {"med": 0.5, "top": 0.9}, scopes).collect()}
    assert reads.value == 2 * len(rows)
    for g in "xyz":
        values = [v for a, v, _ in rows if a == g and v is not None and v == v]
        clean = [v for a, v, c in rows if a == g and c and v is not None and v == v]
        assert got[g]["med_all"] == pytest.approx(statistics.median(values))
        assert got[g]["med_clean"] == (pytest.approx(statistics.median(clean)) if clean else None)
        s = sorted(values)
        at = 0.9 * (len(s) - 1)
        assert got[g]["top_all"] == pytest.approx(s[int(at)] + (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]) * (at % 1))


def test_nan_is_missing_in_effects_boxes_and_stability(spark):
    rows = [(v, "1", "Normal", 1.0) for v in (1.0, 2.0, 3.0, 4.0)]
    plain, nan, null = (spark.createDataFrame([*rows, *more], "s double, f string, l string, p double") for more in ([], [(float("nan"), "1", "Normal", 1.0)], [(None, "1", "Normal", 1.0)]))
    whole = R.box_stats(plain, ["f"], "s").first()
    assert whole["n"] == 4 and whole["std"] == pytest.approx(statistics.stdev([1, 2, 3, 4])) and whole["mean"] == 2.5
    assert R.box_stats(nan, ["f"], "s").first() == whole == R.box_stats(null, ["f"], "s").first()
    assert R.box_stats(nan, [], "s").first().asDict() == R.box_stats(plain, [], "s").first().asDict()
    none = R.box_stats(plain.limit(0), [], "s").first()
    assert none["n"] == 0 and none["mean"] is None and none["std"] is None and none["median"] is None
    one, other = (R.width_effect(d.withColumn("w", F.lit("<=1.2 m")), ["f"], "w", "s", "l", 1.5).filter("n_all > 0").first() for d in (nan, null))
    assert one == other and one["exceed_pct"] == 60.0 and one["med_all"] == one["med_clean"] == 2.5
    assert sorted(r["stability"] for r in R.stability_category(nan, ["f"], "p", "s").collect()) == sorted(r["stability"] for r in R.stability_category(plain, ["f"], "p", "s").collect())


@pytest.mark.parametrize("n,limit", [(1, 0), (2, 0), (6, 0), (40, 0), (40, 10**6)])
def test_representatives_of_a_hot_value(spark, monkeypatch, n, limit):
    monkeypatch.setattr(Q, "SORTED", limit)
    r = random.Random(5)
    rows = [(g, 7.0 if i % 3 else r.random() * 20, i, f"row{i}") for g in "ab" for i in range(900)] + [("a", float("nan"), 10_000, "x"), ("b", None, 10_001, "y")]
    df = spark.createDataFrame(rows, "g string, s double, id bigint, more string").repartition(5)
    got = Q.representatives(df, ["g"], "s", "id", n)
    assert got.columns == ["g", "s", "id", "more", "rank"]
    for g in "ab":
        s = sorted((v, i) for x, v, i, _ in rows if x == g and v is not None and v == v)
        at = range(len(s)) if n <= 1 else sorted({round(k * (len(s) - 1) / (n - 1)) for k in range(n)})
        assert [(x["s"], x["id"]) for x in got.filter(F.col("g") == g).orderBy("rank").collect()] == [s[k] for k in at]


def test_points_are_scanned_once_at_any_number_of_levels(spark, tmp_path):
    points = [(i, T0 + timedelta(minutes=i) if i % 50 else None) for i in range(500)] * 2  # repeated rows
    spark.createDataFrame(points, "id bigint, ts timestamp_ntz").write.parquet(str(tmp_path / "points"))
    spans = [(0, T0, T0 + timedelta(days=4000)), (1, T0 + timedelta(minutes=5), T0 + timedelta(minutes=9)), (2, T0 + timedelta(minutes=3), T0 + timedelta(days=90)), (3, T0 + timedelta(minutes=450), T0 + timedelta(minutes=480))]
    for some in (spans, spans[1:2] + spans[3:], [spans[1], (4, T0 + timedelta(days=30), T0 + timedelta(days=500))]):
        df = spark.read.parquet(str(tmp_path / "points"))
        intervals = spark.createDataFrame(some, "span bigint, a timestamp_ntz, b timestamp_ntz")
        for how in ("left", "left_semi", "inner"):
            out = I.join_points(df, intervals, "ts", "a", "b", how=how)
            assert len(re.findall(r"FileScan parquet \[id", plan(out))) == 1
            hits = [(i, [s for s, a, b in some if t is not None and a <= t <= b]) for i, t in points]
            if how == "left_semi":
                assert sorted(r["id"] for r in out.collect()) == sorted(i for i, h in hits if h)
            else:
                want = [(i, s) for i, h in hits for s in h] + [(i, -1) for i, h in hits if not h and how == "left"]
                assert sorted((r["id"], -1 if r["span"] is None else r["span"]) for r in out.collect()) == sorted(want)


def test_spans_meet_intervals_by_counts(spark):
    r = random.Random(9)
    at = lambda: T0 + timedelta(minutes=30 * r.randrange(600))
    for lengths in ([0, 1, 2], [0, 3000], [40_000]):
        spans = [(i, a, a + timedelta(minutes=30 * r.choice([0, 1, 5, -1, 900]))) for i, a in enumerate(at() for _ in range(150))] + [(900, None, T0), (901, T0, None)]
        some = [(a, a + timedelta(minutes=30 * r.choice(lengths))) for a in (at() for _ in range(12))] + [(at(), T0 - timedelta(days=1)), (None, T0)]
        df = I.overlaps_any(spark.createDataFrame(spans, "id bigint, f timestamp_ntz, u timestamp_ntz"), spark.createDataFrame(some, "a timestamp_ntz, b timestamp_ntz"), ("f", "u"), ("a", "b"), ["id"])
        want = [i for i, f, u in spans if f and u and f <= u and any(a and a <= b and a <= u and b >= f for a, b in some)]
        assert sorted(x["id"] for x in df.collect()) == want and df.columns == ["id", "f", "u"]
        assert "_bucket" not in plan(df)


def test_detail_opens_the_windows_days_only(spark):
    rows = spark.range(2000).select(
        F.lit("s").alias("strand"), "id", F.expr("timestamp_ntz'2025-05-01 00:00:00' + make_dt_interval(0, 0, id * 10)").alias("ts"), (F.col("id") % 7).alias("level")
    )
    windows = spark.createDataFrame(
        [("s", "w1", T0 + timedelta(days=3), T0 + timedelta(days=3, hours=2), "Normal", 1.5, "1A"), ("s", "w2", T0, T0 + timedelta(days=9), "Normal", 2.5, None)],
        "strand string, Seq_Name string, Seq_time_Start timestamp_ntz, Seq_time_End timestamp_ntz, disturbance_type string, `MOLD_LEVEL_std [mm]` double, `Quality casting` string",
    )
    out = sequence_detail(spark, by_day(rows, "ts"), windows, "ts", ["level"], "w1", ["id"])
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= [^\]]*day#\d+ <= ", plan(out))
    got = out.collect()
    assert len(got) == 13 and [r["time"] for r in got] == sorted(r["time"] for r in got) and {r["Quality casting"] for r in got} == {"1A"}
    assert sequence_detail(spark, rows, windows, "ts", ["level"], "none").count() == 0
