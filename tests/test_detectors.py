from __future__ import annotations

import random

import pytest

import reference_rules as rules
from strandlens.operators import detectors as D
from strandlens.spec import AnalysisConfig

FLAGS = ["has_excursion_event", "has_slow_drift", "has_transient_bump", "has_high_variability"]


def flags(spark, signals, cfg=AnalysisConfig()):
    df = spark.createDataFrame(list(enumerate(signals)), "id int, samples array<double>")
    rows = D.flag_disturbances(df, "samples", cfg).orderBy("id").collect()
    return [tuple(r[f] for f in FLAGS) for r in rows], rows


def test_known_signals(spark):
    spike = [0.0] * 300
    spike[100:120] = [15.0] * 20
    calm = [0.4 if i % 2 else -0.4 for i in range(300)]
    noisy = [6.0 if i % 2 else -6.0 for i in range(300)]
    four = [0.0] * 300
    four[10:14] = [15.0] * 4
    five = [0.0] * 300
    five[10:15] = [15.0] * 5
    ramp = [0.2 * i for i in range(61)] + [0.0] * 60
    short_ramp = [0.2 * i for i in range(60)] + [11.8] * 60
    noise = [((7 * i) % 11 - 5) / 5 for i in range(300)]
    inner = [v + (20 if 150 <= i <= 157 else 0) for i, v in enumerate(noise)]
    at_end = [v + (20 if 292 <= i <= 299 else 0) for i, v in enumerate(noise)]
    flat = [20.0 if 150 <= i <= 157 else 0.0 for i in range(300)]
    got, _ = flags(spark, [spike, calm, noisy, four, five, ramp, short_ramp, inner, at_end, flat])
    assert got[0][0] and not got[1][0] and not got[1][3] and got[2][3]
    assert not got[3][0] and got[4][0]
    assert got[5][1] and not got[6][1]
    assert got[7][2] and not got[8][2] and not got[9][2]


def test_missing_samples_clear_every_flag(spark):
    wild = [100.0 * (i % 7) for i in range(50)]
    got, rows = flags(spark, [wild, [*wild, None], [*wild, float("nan")], []])
    assert any(got[0])
    assert got[1:] == [(False,) * 4] * 3
    assert [r.disturbance_type for r in rows[1:]] == ["Normal"] * 3


def random_signals(n=120):
    rng = random.Random(11)
    out = []
    for _ in range(n):
        size = rng.randint(1, 90)
        x, level = [], 50.0
        for _i in range(size):
            level += rng.choice([0, 0, 1, 3, -2]) if rng.random() < 0.7 else rng.gauss(0, 4)
            x.append(round(level, 2))
        if size > 40 and rng.random() < 0.5:
            at, width = rng.randint(0, size - 3), rng.randint(2, 9)
            x = [v + 40 if at <= i < at + width else v for i, v in enumerate(x)]
        out.append(x)
    return out


def test_random_signals_match_the_rules(spark):
    cfg = AnalysisConfig(
        excursion_min_duration_s=3, drift_min_run_s=5, drift_min_amplitude=15.0, bump_k_amp=3.0,
        bump_min_duration_s=2, bump_max_duration_s=12, variability_ptp=45.0, variability_band=12.0,
        variability_fraction=0.3,
    )
    signals = random_signals()
    got, _ = flags(spark, signals, cfg)
    want = [
        (
            rules.excursion(x, cfg.excursion_threshold, 3),
            rules.drift(x, 5, 15.0),
            rules.bump(x, 3.0, 6.0, 2, 12, 2.5),
            rules.variability(x, 45.0, 12.0, 0.3),
        )
        for x in signals
    ]
    assert got == want
    for i in range(4):
        assert {w[i] for w in want} == {True, False}


def test_timed_detectors_match_the_rules(spark):
    rng = random.Random(3)
    data = []
    for x in random_signals(80):
        t, points = 0.0, []
        for v in x:
            t += rng.choice([1.0, 1.0, 2.5])
            points.append((t, None if rng.random() < 0.1 else v))
        data.append(points)
    df = spark.createDataFrame(
        [(i, [(int(t * 1e6), v) for t, v in p]) for i, p in enumerate(data)],
        "id int, timed array<struct<t: bigint, v: double>>",
    )
    out = df.withColumns(
        {
            "drift": D.slow_drift_timed("timed", 6.0, 8.0),
            "excursion": D.excursion_timed("timed", 8.0, 4.0),
        }
    )
    rows = out.orderBy("id").collect()
    assert [r.drift for r in rows] == [rules.drift_timed(p, 6.0, 8.0) for p in data]
    assert [r.excursion for r in rows] == [rules.excursion_timed(p, 8.0, 4.0) for p in data]
    assert len({r.drift for r in rows}) == len({r.excursion for r in rows}) == 2


@pytest.mark.parametrize("values,median", [([3.0], 3.0), ([1.0, 4.0], 2.5), ([5.0, 1.0, 2.0], 2.0)])
def test_array_median(spark, values, median):
    df = spark.createDataFrame([(values,)], "x array<double>")
    assert df.select(D.array_median(df.x)).first()[0] == median
