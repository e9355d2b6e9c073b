from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import reference_rules as rules
from strandlens.functions.timing import bucket
from strandlens.operators import ordered as O
from strandlens.operators import windows as W
from strandlens.spec import SignalSpec

T0 = datetime(2025, 4, 1)


def series(spark, values, name="a", gaps=(), **columns):
    rows, t = [], T0
    for i, v in enumerate(values):
        t += timedelta(hours=1) if i in gaps else timedelta(seconds=1)
        rows.append((name, t, i, v, *[c[i] for c in columns.values()]))
    schema = "strand string, ts timestamp_ntz, id bigint, v double" + "".join(
        f", {c} double" for c in columns
    )
    return spark.createDataFrame(rows, schema)


KEYS, ORDER = ["strand"], ["ts", "id"]


def chunk(seconds=7):
    return bucket("ts", seconds)


def test_scan_carries_across_chunks(spark):
    rng = random.Random(1)
    values = [rng.choice([None, rng.random()]) for _ in range(90)]
    df = series(spark, values, gaps={13, 40}).unionByName(series(spark, values[::-1], "b"))
    flag = F.col("v") > 0.5
    out = O.finish(
        O.scan(
            df, KEYS, ORDER, chunk(), lag={"prev": "v"}, position="pos",
            counts={"n": flag}, last={"left": "v"}, following={"right": "v"},
        )
    ).collect()
    for name, want in (("a", values), ("b", values[::-1])):
        got = sorted((r for r in out if r.strand == name), key=lambda r: r.id)
        assert [r.pos for r in got] == list(range(90))
        assert [r.prev for r in got] == [None, *want[:-1]]
        for i, r in enumerate(got):
            assert r.n == sum(v is not None and v > 0.5 for v in want[: i + 1])
            assert r.left == next((v for v in reversed(want[: i + 1]) if v is not None), None)
            assert r.right == next((v for v in want[i:] if v is not None), None)


def test_rounding_matches_rule_and_known_cases(spark):
    rng = random.Random(2)
    x, values = 1.2, []
    for _ in range(300):
        x += rng.choice([0.0, 0.004, -0.006, 0.02, -0.03])
        values.append(round(x, 3))
    for case in (values, [1.2, 1.205, 1.235], [1.2, 1.21]):
        out = O.hysteresis_round(series(spark, case), KEYS, ORDER, chunk(), "v", "r")
        got = [r.r for r in out.orderBy("id").collect()]
        assert got == pytest.approx(rules.rounding(case), abs=1e-12)
    assert rules.rounding([1.2, 1.205, 1.235]) == [1.2, 1.2, 1.24]


def test_rounding_leaves_missing_values_missing(spark):
    df = series(spark, [1.2, None, 1.205, 1.206])
    for out in (
        O.hysteresis_round(df, KEYS, ORDER, chunk(2), "v", "r"),
        O.segment_by_gaps(df, KEYS, ORDER, chunk(2), 5, ("v", "r")),
    ):
        got = [r.r for r in out.orderBy("id").collect()]
        assert got == [1.2, None, 1.21, 1.21]


def test_gap_of_an_hour_makes_two_segments(spark):
    df = series(spark, [1.2] * 600, gaps={300})
    out = O.segment_by_gaps(df, KEYS, ORDER, chunk(60), 5).collect()
    assert {r.segment_id for r in out} == {0, 1}
    assert all((r.segment_id, r.seg_pos) == divmod(r.id, 300) for r in out)


def test_segment_splits_only_above_the_limit(spark):
    df = spark.createDataFrame(
        [("a", T0, 0), ("a", T0 + timedelta(seconds=5), 1), ("a", T0 + timedelta(seconds=10, microseconds=1), 2)],
        "strand string, ts timestamp_ntz, id bigint",
    )
    out = O.segment_by_gaps(df, KEYS, ORDER, chunk(), 5).orderBy("id").collect()
    assert [r.segment_id for r in out] == [0, 0, 1]


def windows_of(spark, df, window, threshold, piece_rows, currents=(), limit=None, gap=5, block_rows=8):
    starts = W.segmented_starts(
        df, KEYS, ORDER, chunk(60), "v", window, threshold, list(currents), limit, gap,
        block_rows=block_rows,
    )
    picks = W.pick_windows(starts, KEYS, window, piece_rows=piece_rows)
    rejected = W.abnormal_starts(starts, picks, KEYS, window)
    return starts, picks, rejected


def test_constant_speed_gives_two_windows(spark):
    df = series(spark, [1.2] * 600, c=[100.0] * 600)
    _, picks, rejected = windows_of(spark, df, 300, 0.1, 1 << 20, ["c"], 50.0, block_rows=65536)
    assert [r.start_pos for r in picks.orderBy("start_pos").collect()] == [0, 300]
    assert rejected.count() == 0


@pytest.mark.parametrize("seed,window,piece_rows", [(1, 4, 4), (2, 5, 16), (3, 3, 7), (4, 6, 1 << 20), (5, 2, 2)])
def test_windows_match_the_walk(spark, seed, window, piece_rows):
    """Pieces down to one window long: every chain of entry offsets is used."""
    rng = random.Random(seed)
    n = 400
    v = [None if rng.random() < 0.01 else 1.0 + (rng.random() if rng.random() < 0.2 else 0.02 * rng.random()) for _ in range(n)]
    v[100:180] = [1.0] * 80
    c = [None if rng.random() < 0.05 else 100.0 + (80 if rng.random() < 0.03 else 0) for _ in range(n)]
    gaps = {210, 215, 300}
    df = series(spark, v, gaps=gaps, c=c)
    _, picks, rejected = windows_of(spark, df, window, 0.1, piece_rows, ["c"], 50.0)
    want_picks, want_rejected = [], []
    bounds = [0, *sorted(gaps), n]
    for a, b in zip(bounds, bounds[1:]):
        good, bad = rules.greedy(v[a:b], window, 0.1, [c[a:b]], 50.0)
        want_picks += [a + i for i in good]
        want_rejected += [a + i for i in bad]
    assert sorted(r.start_pos for r in picks.collect()) == want_picks
    assert sorted(r.pos for r in rejected.collect()) == want_rejected


def test_window_rows_and_names(spark):
    rng = random.Random(7)
    v = [1.0 + (rng.random() if rng.random() < 0.2 else 0.0) for _ in range(200)]
    df = series(spark, v)
    starts, picks, _ = windows_of(spark, df, 4, 0.1, 8)
    numbered = W.number_windows(picks, KEYS, chunk_rows=10)
    rows = W.window_rows(starts, numbered, KEYS, 4).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r.seq_no, []).append(r.pos)
    firsts = sorted(r.start_pos for r in picks.collect())
    assert {k: sorted(x) for k, x in ids.items()} == {
        i: list(range(s, s + 4)) for i, s in enumerate(firsts)
    }


def test_null_current_passes_null_speed_fails(spark):
    ok = series(spark, [1.0] * 6, c=[1.0, None, 1.0, 90.0, None, 2.0])
    bad = series(spark, [1.0, 1.0, None, 1.0, 1.0, 1.0], c=[1.0] * 6)
    for df, limit, want in ((ok, 100.0, 1), (bad, 100.0, 0)):
        _, picks, _ = windows_of(spark, df, 6, 0.1, 6, ["c"], limit)
        assert picks.count() == want
    _, picks, rejected = windows_of(spark, ok, 6, 0.1, 6, ["absent"], 100.0)
    assert (picks.count(), rejected.count()) == (0, 1)


def test_short_segments_can_be_left_out(spark):
    df = series(spark, [1.0] * 30, gaps={10})
    starts = W.segmented_starts(df, KEYS, ORDER, chunk(), "v", 4, 0.1, [], None, 5, min_segment_rows=15)
    picks = W.pick_windows(starts, KEYS, 4)
    assert sorted(r.start_pos for r in picks.collect()) == [10, 14, 18, 22, 26]


def test_spike_clean(spark):
    rng = random.Random(5)
    x = [10.0 + (30 if rng.random() < 0.15 else rng.random()) for _ in range(120)]
    x[0:4] = [90.0] * 4
    x[50] = None
    x[118:] = [80.0, 80.0]
    out = O.spike_clean(series(spark, x), KEYS, ORDER, chunk(), "v", "clean", block_rows=9)
    got = [r.clean for r in out.orderBy("id").collect()]
    assert got == pytest.approx(rules.spike_free(x, 5.0))


def test_every_kth_and_run_groups(spark):
    values = [float(x) for x in (1, 1, 1, 5, 5, 9, 9, 9, 9)]
    df = series(spark, values)
    kept = O.every_kth(df, KEYS, ORDER, chunk(2), 4)
    assert sorted(r.id for r in kept.collect()) == [0, 4, 8]
    groups = O.run_groups(df, KEYS, ORDER, chunk(2), F.col("id") != 1, "v", 1.0, 2)
    assert sorted((r.id, r.run) for r in groups.collect()) == [
        (0, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2), (8, 2)
    ]


def test_break_windows_resume_behind_the_break(spark):
    v = [1.0] * 5 + [2.0] * 9
    out = W.break_windows(series(spark, v), KEYS, ORDER, "v", 4, 0.1, max_windows=3).collect()
    assert [(r.start_pos, r.break_pos, r.stable) for r in sorted(out, key=lambda r: r.window_no)] == [
        (0, None, True), (4, 5, False), (6, None, True)
    ]


def test_break_windows_over_the_whole_series_in_any_pieces(spark):
    rng = random.Random(7)
    v = [None if rng.random() < 0.05 else float(rng.randint(0, 3)) for _ in range(400)]
    want, at = [], 0
    while at + 5 <= len(v):
        off = [j for j in range(at, at + 5) if v[at] is not None and v[j] is not None and abs(v[j] - v[at]) > 1]
        want.append((at, off[0] if off else None, not off))
        at = off[0] + 1 if off else at + 5
    for piece in (5, 16, 1000):
        out = W.break_windows(series(spark, v), KEYS, ORDER, "v", 5, 1.0, piece_rows=piece).collect()
        assert [(r.start_pos, r.break_pos, r.stable) for r in sorted(out, key=lambda r: r.window_no)] == want
    some = W.break_windows(series(spark, v), KEYS, ORDER, "v", 5, 1.0, max_windows=7).count()
    assert some == 7


def test_long_runs_are_picked_in_linear_time(spark):
    n = 1 << 20
    rows = spark.range(n).select(
        F.lit("a").alias("strand"), F.lit(0).cast("bigint").alias("segment_id"), F.col("id").alias("pos"),
        F.col("id").alias("seg_pos"), (F.col("id") % 7 == 0).alias("steady"), F.floor(F.col("id") / 65_536).alias(O.BLOCK),
    )
    began = time.time()
    assert W.pick_windows(rows, KEYS, 6).count() == -(-n // 7)
    assert time.time() - began < 60


def test_chunk_width_is_measured(spark):
    df = series(spark, [0.0] * 500)
    with pytest.raises(ValueError):
        O.fit_chunks(df, SignalSpec(keys=("strand",), ts="ts"))
    spec = SignalSpec(keys=("strand",), ts="ts", tiebreak=("id",))
    for max_rows, seconds in ((1000, 86_400), (70, 60), (3, 1)):
        assert O.fit_chunks(df, spec, max_rows).chunk_seconds == seconds


def test_rows_of_one_timestamp_are_parted_by_the_tiebreak(spark):
    df = spark.range(1000).select(
        F.lit("a").alias("strand"), F.lit(T0).cast("timestamp_ntz").alias("ts"), "id",
        F.when(F.col("id") % 97 == 5, F.col("id")).alias("v"),
    )
    spec = O.fit_chunks(df, SignalSpec(keys=("strand",), ts="ts", tiebreak=("id",)), max_rows=64)
    assert spec.tie_width == 64
    out = O.scan(df, spec.keys, spec.order, spec.chunk(), position="pos", last={"left": "v"}, lag={"prev": "id"})
    assert out.groupBy(O.CHUNK).count().agg(F.max("count")).first()[0] == 64
    for r in out.collect():
        assert r.pos == r.id and r.prev == (r.id - 1 if r.id else None)
        assert r.left == ((r.id - 5) // 97 * 97 + 5 if r.id >= 5 else None)


def test_ecdf_spreads_a_frequent_value(spark):
    counts = spark.createDataFrame([(1, 25), (2, 1), (9, 4)], "gap bigint, n bigint")
    out = sorted((r["rank"], r.gap, r.cumulative_pct) for r in O.ecdf(counts, "gap", piece=10).collect())
    assert [r[0] for r in out] == list(range(1, 31))
    assert [r[1] for r in out] == [1] * 25 + [2] + [9] * 4
    assert out[-1][2] == 100.0
