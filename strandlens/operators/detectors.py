"""Disturbance detectors over the samples of one window.

The samples of a window arrive as one array column in time order. A window has
a fixed number of samples, so the array is bounded; any number of windows is
worked in parallel, in one projection behind one shuffle. A missing or NaN
sample makes every flag of its window false.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import LABEL_ORDER, any_flag, disturbance_label
from ..functions.timing import _column, micros
from ..spec import AnalysisConfig

# Fixed value: scales a median absolute deviation to a standard deviation.
MAD_TO_SIGMA = 1.4826
BASELINE_S = 20
RETURN_S = 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row. A plain column would
    be pulled into the lambdas that use it and worked out per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_median(values: Column) -> Column:
    """Median of a non-empty array without nulls."""

    def middle(s: Column) -> Column:
        low = F.floor((F.size(s) - 1) / 2).cast("int")
        high = F.floor(F.size(s) / 2).cast("int")
        return (F.get(s, low) + F.get(s, high)) / 2

    return let(F.sort_array(values), middle)


def array_ptp(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def longest_run(flags: Column) -> Column:
    begin = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(state: Column, flag: Column) -> Column:
        return let(
            F.when(flag, state["now"] + 1).otherwise(0),
            lambda now: F.struct(
                now.alias("now"), F.greatest(state["best"], now).alias("best")
            ),
        )

    return F.aggregate(flags, begin, step, lambda s: s["best"])


def usable(values: Column) -> Column:
    """No missing and no NaN sample, and at least one sample."""
    return (F.size(values) > 0) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x))


def _checked(values: str | Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` for usable samples, false for others."""
    found = let(_column(values), lambda v: F.when(usable(v), rule(v)).otherwise(False))
    return F.coalesce(found, F.lit(False))


def _neighbours(values: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn`` of every element and the next one."""
    m = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), m), F.slice(values, F.lit(2), m), fn)


def gather(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "samples"
) -> DataFrame:
    """One row per window with its samples in order. ``keys`` must name windows
    of bounded length."""
    return rows.groupBy(*[_column(k) for k in keys]).agg(samples(order, value).alias(name))


def samples(order: Sequence[str], value: str) -> Column:
    return F.transform(
        F.array_sort(
            F.collect_list(
                F.struct(
                    *[_column(c).alias(f"o{i}") for i, c in enumerate(order)],
                    _column(value).cast("double").alias("v"),
                )
            )
        ),
        lambda x: x["v"],
    )


def timed_samples(order: Sequence[str], value: str) -> Column:
    """As ``samples``, each with its time in microseconds."""
    return F.array_sort(
        F.collect_list(
            F.struct(
                micros(order[0]).alias("t"),
                *[_column(c).alias(f"o{i}") for i, c in enumerate(order[1:])],
                _column(value).cast("double").alias("v"),
            )
        )
    )


def excursion(
    values: str | Column, threshold: float, min_duration_s: float, hz: float = 1.0
) -> Column:
    """A run of samples further than ``threshold`` from the window's median."""
    wanted = int(min_duration_s * hz)

    def rule(v: Column) -> Column:
        far = let(
            array_median(v), lambda m: F.transform(v, lambda x: F.abs(x - m) > threshold)
        )
        return longest_run(far) >= max(wanted, 1)

    return _checked(values, rule)


def slow_drift(
    values: str | Column, min_run_s: float, min_amplitude: float, hz: float = 1.0
) -> Column:
    """A long strictly monotone run in a window whose whole range is large."""
    wanted = int(min_run_s * hz)

    def rule(v: Column) -> Column:
        longest = let(
            _neighbours(v, lambda a, b: F.signum(b - a)),
            lambda signs: F.greatest(
                longest_run(F.transform(signs, lambda s: s > 0)),
                longest_run(F.transform(signs, lambda s: s < 0)),
            ),
        )
        return (
            (F.size(v) >= wanted)
            & (array_ptp(v) >= min_amplitude)
            & (longest >= max(wanted, 1))
        )

    return _checked(values, rule)


def _running_baseline(v: Column, width: int) -> Column:
    """Running median with repeated edge samples; of an even width the upper of
    the two middle values."""
    rank = width // 2
    padded = F.concat(
        F.array_repeat(F.get(v, F.lit(0)), rank),
        v,
        F.array_repeat(F.get(v, F.size(v) - 1), width - rank - 1),
    )
    return let(
        padded,
        lambda p: F.transform(
            v, lambda _x, i: F.get(F.sort_array(F.slice(p, i + 1, width)), F.lit(rank))
        ),
    )


def transient_bump(
    values: str | Column,
    k_amp: float,
    min_amplitude: float,
    min_duration_s: float = 5.0,
    max_duration_s: float = 180.0,
    return_band_sigma: float = 2.5,
    hz: float = 1.0,
) -> Column:
    """A short departure from a running-median baseline that returns to it.

    The noise is estimated from the median absolute deviation of the residuals.
    A departure that lasts to the end of the window does not count.
    """
    width = max(int(BASELINE_S * hz), 5)
    later_rows = int(RETURN_S * hz)
    shortest, longest = int(min_duration_s * hz), int(max_duration_s * hz)

    def rule(v: Column) -> Column:
        return let(_running_baseline(v, width), lambda base: departs(v, base))

    def spread(res: Column) -> Column:
        return let(
            array_median(res), lambda m: array_median(F.transform(res, lambda r: F.abs(r - m)))
        )

    def departs(v: Column, base: Column) -> Column:
        return let(
            F.zip_with(v, base, lambda x, b: x - b),
            lambda res: let(spread(res) * MAD_TO_SIGMA, lambda s: returns(v, base, res, s)),
        )

    def returns(v: Column, base: Column, res: Column, sigma: Column) -> Column:
        limit = F.greatest(sigma * k_amp, F.lit(float(min_amplitude)))
        far = let(limit, lambda cap: F.transform(res, lambda r: F.abs(r) > cap))
        return let(far, lambda f: let(array_median(base), lambda level: match(v, f, level, sigma)))

    def match(v: Column, far: Column, level: Column, sigma: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(far) - 1)

        def is_far(i: Column) -> Column:
            return F.coalesce(F.get(far, i), F.lit(False))

        starts = F.filter(index, lambda i: is_far(i) & ~is_far(i - 1))
        stops = F.filter(index, lambda i: ~is_far(i) & is_far(i - 1))

        def fits(first: Column, stop: Column) -> Column:
            later = array_median(F.slice(v, stop + 1, later_rows))
            back = F.abs(later - level) < sigma * return_band_sigma
            return (stop - first).between(shortest, longest) & back

        return F.exists(F.zip_with(starts, stops, fits), lambda hit: hit)

    return _checked(values, rule)


def high_variability(
    values: str | Column, ptp: float, band: float, fraction: float = 0.1
) -> Column:
    """A large range, or a large share of samples outside a band at the median."""

    def rule(v: Column) -> Column:
        outside = let(
            array_median(v), lambda m: F.size(F.filter(v, lambda x: F.abs(x - m) > band))
        )
        return (array_ptp(v) > ptp) | (outside / F.size(v) > fraction)

    return _checked(values, rule)


def _median_step_s(timed: Column) -> Column:
    """Median seconds between neighbouring samples; null below two samples."""
    steps = _neighbours(F.transform(timed, lambda x: x["t"]), lambda a, b: (b - a) / 1e6)
    return F.when(F.size(timed) > 1, array_median(steps))


def slow_drift_timed(timed: str | Column, min_run_s: float, min_amplitude: float) -> Column:
    """Time-aware drift: a monotone run (equal neighbours continue it) that is
    both long and large in itself. Missing samples are left out."""

    def walk(known: Column, dt: Column) -> Column:
        head = F.get(known, F.lit(0))["v"]
        begin = F.struct(
            F.lit(0.0).alias("sign"),
            F.lit(0).alias("len"),
            head.alias("start"),
            head.alias("prev"),
            F.lit(False).alias("hit"),
        )

        def step(s: Column, x: Column) -> Column:
            raw = F.signum(x["v"] - s["prev"])
            sign = F.when(raw == 0, s["sign"]).otherwise(raw)
            same = sign == s["sign"]
            length = F.when(same, s["len"] + 1).otherwise(1)
            start = F.when(same, s["start"]).otherwise(s["prev"])
            far = F.abs(x["v"] - start) >= min_amplitude
            # Length and amplitude only grow along a monotone run, so a run
            # that passes at its end is caught here and no other is.
            hit = s["hit"] | ((sign != 0) & (length * dt >= min_run_s) & far)
            return F.struct(
                sign.alias("sign"),
                length.alias("len"),
                start.alias("start"),
                x["v"].alias("prev"),
                hit.alias("hit"),
            )

        rest = F.slice(known, F.lit(2), F.greatest(F.size(known) - 1, F.lit(0)))
        found = F.aggregate(rest, begin, step, lambda s: s["hit"])
        return F.when((F.size(known) >= 3) & (dt > 0), found)

    kept = F.filter(
        _column(timed), lambda x: x["v"].isNotNull() & (F.abs(x["v"]) < F.lit(float("inf")))
    )
    found = let(kept, lambda known: let(_median_step_s(known), lambda dt: walk(known, dt)))
    return F.coalesce(found, F.lit(False))


def excursion_timed(timed: str | Column, threshold: float, min_duration_s: float) -> Column:
    """Time-aware excursion: the longest run times the median sample step."""

    def rule(x: Column) -> Column:
        known = F.filter(
            F.transform(x, lambda s: s["v"]), lambda v: v.isNotNull() & ~F.isnan(v)
        )

        def far(m: Column) -> Column:
            return F.transform(
                x,
                lambda s: F.coalesce(
                    ~F.isnan(s["v"]) & (F.abs(s["v"] - m) > threshold), F.lit(False)
                ),
            )

        run = longest_run(let(array_median(known), far))
        return let(
            _median_step_s(x),
            lambda dt: F.when((F.size(x) >= 3) & (dt > 0), run * dt >= min_duration_s),
        )

    return F.coalesce(let(_column(timed), rule), F.lit(False))


def flag_disturbances(df: DataFrame, values: str, cfg: AnalysisConfig) -> DataFrame:
    """All four flags, the any-flag and the label."""
    hz = cfg.sampling_hz
    flagged = df.withColumns(
        {
            "has_excursion_event": excursion(
                values, cfg.excursion_threshold, cfg.excursion_min_duration_s, hz
            ),
            "has_slow_drift": slow_drift(
                values, cfg.drift_min_run_s, cfg.drift_min_amplitude, hz
            ),
            "has_transient_bump": transient_bump(
                values,
                cfg.bump_k_amp,
                cfg.bump_min_amplitude,
                cfg.bump_min_duration_s,
                cfg.bump_max_duration_s,
                cfg.bump_return_band_sigma,
                hz,
            ),
            "has_high_variability": high_variability(
                values, cfg.variability_ptp, cfg.variability_band, cfg.variability_fraction
            ),
        }
    )
    return flagged.withColumn("has_disturbance", any_flag()).withColumn(
        "disturbance_type", disturbance_label(LABEL_ORDER)
    )
