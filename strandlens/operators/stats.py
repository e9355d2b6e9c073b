"""Aggregation of logs and of windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import known, present
from ..functions.timing import _column, minutes_between
from ..spec import SignalSpec
from .detectors import samples


def downsample(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    ignore_nulls: bool = False,
) -> DataFrame:
    """One row per key: mean of numeric columns, first of all others.

    With ``order`` the first row is the smallest in that order, else any.
    Columns that only order (``order``) are dropped from the result.
    """
    drop = set(keys) | set(order)
    place = F.struct(*[_column(c) for c in order]) if order else None
    aggs = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        c = _column(f.name)
        if isinstance(f.dataType, T.NumericType):
            aggs.append(F.avg(c).alias(f.name))
        elif place is None:
            aggs.append(F.first(c, ignorenulls=ignore_nulls).alias(f.name))
        else:
            at = F.when(c.isNotNull(), place) if ignore_nulls else place
            aggs.append(F.min_by(c, at).alias(f.name))
    return df.groupBy(*[_column(k) for k in keys]).agg(*aggs)


def modal(c: str | Column) -> Column:
    """Most frequent non-null value, the smallest one on ties."""
    return F.mode(_column(c), True)


def unique_or_multiple(c: str | Column) -> Column:
    """The one trimmed value, or all of them listed behind ``MULTIPLE:``."""
    values = F.array_sort(F.collect_set(F.trim(_column(c).cast("string"))))
    return (
        F.when(F.size(values) == 0, None)
        .when(F.size(values) == 1, F.get(values, F.lit(0)))
        .otherwise(F.concat(F.lit("MULTIPLE: "), F.array_join(values, " | ")))
    )


def strict_ptp(c: str | Column) -> Column:
    """Range that is null when any value is missing."""
    x = known(c)
    return F.when(F.count(x) == F.count(F.lit(1)), F.max(x) - F.min(x))


def sequence_stats(
    rows: DataFrame, keys: Sequence[str], spec: SignalSpec, keep_samples: str | None = None
) -> DataFrame:
    """Statistics per window, from the raw values. ``keep_samples`` adds the
    level samples as an array column for the detectors, in the same pass."""
    ts, level = _column(spec.ts), known(spec.level)
    have = set(rows.columns)
    aggs = [
        F.min(ts).alias("Seq_time_Start"),
        F.max(ts).alias("Seq_time_End"),
        F.count(F.lit(1)).alias("Seq_num_samples"),
        F.avg(known(spec.speed)).alias("CASTING_SPEED_avg [m/min]"),
        F.avg(known(spec.width)).alias("MOLD_WIDTH_avg [m]"),
        (F.avg(known(spec.depth)) * 1000).alias("SEN_avg [mm]"),
        F.avg(level).alias("MOLD_LEVEL_avg [mm]"),
        F.stddev_samp(level).alias("MOLD_LEVEL_std [mm]"),
        strict_ptp(spec.level).alias("ptp_mm"),
    ]
    quality = modal(spec.quality) if spec.quality in have else F.lit(None).cast("string")
    aggs.append(quality.alias("Quality casting"))
    if keep_samples:
        aggs.append(samples(spec.order, spec.level).alias(keep_samples))
    return rows.groupBy(*[_column(k) for k in keys]).agg(*aggs)


def current_name(column: str) -> str:
    """The words of a current's column behind what all of them begin with."""
    words = column.split(" ")
    return "_".join(words[2:] if words[:2] == ["EMBR", "Current"] else words)


def sequence_stats_extended(rows: DataFrame, keys: Sequence[str], spec: SignalSpec) -> DataFrame:
    """The statistics with duration, spreads, extremes, gas and currents."""
    have = set(rows.columns)
    ts, level = _column(spec.ts), known(spec.level)
    aggs = {
        "Seq_time_Start": F.min(ts),
        "Seq_time_End": F.max(ts),
        "Seq_num_samples": F.count(F.lit(1)),
    }
    for label, unit, c, scale in (
        ("CASTING_SPEED", "m/min", spec.speed, 1),
        ("MOLD_WIDTH", "m", spec.width, 1),
        ("SEN", "mm", spec.depth, 1000),
        ("MOLD_LEVEL", "mm", spec.level, 1),
    ):
        aggs[f"{label}_avg [{unit}]"] = F.avg(known(c)) * scale
        aggs[f"{label}_std [{unit}]"] = F.stddev_samp(known(c)) * scale
    aggs["MOLD_LEVEL_min [mm]"] = F.min(level)
    aggs["MOLD_LEVEL_max [mm]"] = F.max(level)
    aggs["ptp_mm"] = F.max(level) - F.min(level)
    if have.issuperset(spec.gas):
        total = F.lit(0.0)
        for g in spec.gas:
            total = total + F.avg(known(g))
        aggs["ArFlow_avg [NL/min]"] = total
    else:
        aggs["ArFlow_avg [NL/min]"] = F.lit(None).cast("double")
    if spec.quality in have:
        aggs["Quality casting"] = modal(spec.quality)
    for c in present(rows, spec.currents):
        aggs[f"{current_name(c)}_avg [A]"] = F.avg(known(c))
        aggs[f"{current_name(c)}_std [A]"] = F.stddev_samp(known(c))
    out = rows.groupBy(*[_column(k) for k in keys]).agg(*[v.alias(k) for k, v in aggs.items()])
    return out.withColumn("Seq_duration_min", minutes_between("Seq_time_Start", "Seq_time_End"))


def sequence_stats_manual(
    rows: DataFrame,
    keys: Sequence[str],
    spec: SignalSpec,
    currents: Mapping[str, str],
    condition: str,
) -> DataFrame:
    """Statistics with current extremes and the spread of the gas total; depth
    is not rescaled. ``currents`` maps a column to its display name."""
    ts = _column(spec.ts)
    gas = known(spec.gas[0])
    for g in spec.gas[1:]:
        gas = gas + known(g)
    aggs = {"Seq_time_Start": F.min(ts), "Seq_time_End": F.max(ts)}
    for label, unit, c in (
        ("SEN", "mm", known(spec.depth)),
        ("CASTING_SPEED", "m/min", known(spec.speed)),
        ("MOLD_WIDTH", "m", known(spec.width)),
        ("MOLD_LEVEL", "mm", known(spec.level)),
        ("ArFlow", "NL/min", gas),
    ):
        aggs[f"{label}_avg [{unit}]"] = F.avg(c)
        aggs[f"{label}_std [{unit}]"] = F.stddev_samp(c)
    for column, label in currents.items():
        c = known(column)
        aggs[f"min {label} [A]"] = F.min(c)
        aggs[f"mean {label} [A]"] = F.avg(c)
        aggs[f"max {label} [A]"] = F.max(c)
    out = rows.groupBy(*[_column(k) for k in keys]).agg(*[v.alias(k) for k, v in aggs.items()])
    return out.withColumn("Seq_Condition", F.lit(condition))


def peak_side(
    rows: DataFrame, keys: Sequence[str], left: str, right: str, sigma: str, min_rows: int = 10
) -> DataFrame:
    """Which side of the mold peaks, from the mean of the two level sensors.
    Windows with fewer than ``min_rows`` rows are left out."""
    means = rows.groupBy(*[_column(k) for k in keys], _column(sigma)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_column(left)).alias("level_left"),
        F.avg(_column(right)).alias("level_right"),
    )
    l, r = F.col("level_left"), F.col("level_right")
    asym = (l - r) / (F.abs(l) + F.abs(r) + 1e-6)
    return (
        means.filter(F.col("n") >= min_rows)
        .withColumn("asym", asym)
        .withColumn("side", F.when(F.col("asym") > 0, -1).otherwise(1).cast("bigint"))
        .withColumn("instability_spread", F.least(_column(sigma) / 3.0, F.lit(0.3)))
    )


def context_averages(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], min_rows: int = 5
) -> DataFrame:
    """Mean of the present ``columns`` per window of at least ``min_rows`` rows."""
    wanted = present(rows, columns)
    return (
        rows.groupBy(*[_column(k) for k in keys])
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(_column(c)).alias(f"{c}_avg") for c in wanted],
        )
        .filter(F.col("n") >= min_rows)
    )
