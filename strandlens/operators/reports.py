"""Report tables: counts, shares, distributions, correlations, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FAMILIES, WIDTH_LABELS, family_name, known
from ..functions.labels import FLAGS, NORMAL
from ..functions.timing import _column, hours_between
from ..sources.sinks import stage
from .quantiles import quantiles, value_cells


def null_stats(df: DataFrame, column: str, distinct: Sequence[str] = ()) -> DataFrame:
    c = _column(column)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(c.isNull()).alias("null_count"),
        F.count(c).alias("non_null_count"),
        *[F.count_distinct(_column(d)).alias(f"distinct_{d}") for d in distinct],
    )


def time_extents(
    labelled: DataFrame, ts: str, label: str, castings: DataFrame, start: str, end: str
) -> DataFrame:
    """First and last time of labelled and unlabelled rows, and how far the data
    reach beyond the castings at both ends, in hours."""
    t, known = _column(ts), _column(label).isNotNull()
    data = labelled.agg(
        F.min(t).alias("data_start"),
        F.max(t).alias("data_end"),
        F.min(F.when(~known, t)).alias("first_null"),
        F.max(F.when(~known, t)).alias("last_null"),
        F.min(F.when(known, t)).alias("first_non_null"),
        F.max(F.when(known, t)).alias("last_non_null"),
    )
    bounds = castings.agg(F.min(_column(start)).alias("s"), F.max(_column(end)).alias("e"))
    out = data.withColumns(
        {
            "first_casting_start": bounds.select("s").scalar(),
            "last_casting_end": bounds.select("e").scalar(),
        }
    )
    return out.withColumns(
        {
            "head_gap_hours": F.greatest(
                hours_between("data_start", "first_casting_start"), F.lit(0.0)
            ),
            "tail_gap_hours": F.greatest(
                hours_between("last_casting_end", "data_end"), F.lit(0.0)
            ),
        }
    )


def label_counts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per label and their share in percent, to one decimal."""
    counted = df.groupBy(*[_column(b) for b in by], _column(label)).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = F.sum("count").over(Window.partitionBy(*[_column(b) for b in by]))
    return counted.withColumn("percentage", F.round(F.col("count") * 100.0 / total, 1))


def duplicate_times(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    return (
        df.groupBy(*[_column(b) for b in by])
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_distinct(_column(ts)).alias("distinct_ts"),
        )
        .withColumn("duplicates", F.col("total") - F.col("distinct_ts"))
    )


def _effect(
    seqs: DataFrame,
    keys: Sequence[str],
    category: str,
    labels: Sequence[str],
    sigma: str,
    label: str,
    exceed: float | None,
) -> DataFrame:
    """Counts and median sigma per category, for all and for clean windows."""
    key_cols = [_column(k) for k in keys]
    clean = _column(label) == NORMAL
    scopes = {"all": F.lit(True), "clean": clean}
    on = [*keys, category]
    more = {"_all": F.count(F.lit(1)), "_clean": F.count_if(clean)}
    if exceed is not None:
        more["_above"] = F.count_if(known(sigma) > exceed)
    # One histogram gives the counts, the groups and the medians' bins.
    cells = value_cells(seqs, on, sigma, scopes, more)
    aggs = [F.sum("_all").alias("n_all"), F.sum("_clean").alias("n_clean")]
    if exceed is not None:
        aggs.append((F.sum("_above") / F.sum("_all") * 100).alias("exceed_pct"))
    counts = cells.groupBy(*key_cols, _column(category)).agg(*aggs)
    medians = quantiles(seqs, on, sigma, {"med": 0.5}, scopes, cells)
    spine = cells.select(*key_cols).distinct().withColumn(
        category, F.explode(F.array(*[F.lit(x) for x in labels]))
    )
    return (
        spine.join(counts, on, "left")
        .join(medians, on, "left")
        .fillna(0, subset=["n_all", "n_clean"])
    )


def width_effect(
    seqs: DataFrame, keys: Sequence[str], category: str, sigma: str, label: str, exceed: float
) -> DataFrame:
    return _effect(seqs, keys, category, WIDTH_LABELS, sigma, label, exceed)


def family_effect(
    seqs: DataFrame, keys: Sequence[str], category: str, sigma: str, label: str
) -> DataFrame:
    """As ``width_effect`` per grade family, with the families' display names
    and their ranking by median sigma, largest first."""
    key_cols = [_column(k) for k in keys]
    effect = _effect(seqs, keys, category, FAMILIES, sigma, label, None)
    ranked = effect.filter(F.col("med_all").isNotNull()).groupBy(*key_cols).agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct((-F.col("med_all")).alias("m"), _column(category).alias("f"))
                    )
                ),
                lambda x: F.concat(F.lit("Fam "), x["f"]),
            ),
            " > ",
        ).alias("ranking")
    )
    return effect.withColumn("family_name", family_name(category)).join(
        ranked, list(keys), "left"
    )


def overview_kpis(seqs: DataFrame, sigma: str, label: str, speed: str, width: str, stable: float) -> DataFrame:
    n = F.count(F.lit(1))
    is_stable, is_normal = F.count_if(_column(sigma) <= stable), F.count_if(_column(label) == NORMAL)
    return seqs.agg(
        n.alias("total_sequences"),
        is_stable.alias("stable_sequences"),
        F.round(F.try_divide(is_stable * 100.0, n), 1).alias("stable_pct"),
        F.round(F.avg(_column(sigma)), 2).alias("mean_sigma"),
        F.round(F.stddev_samp(_column(sigma)), 2).alias("std_sigma"),
        is_normal.alias("normal_sequences"),
        F.round(F.try_divide(is_normal * 100.0, n), 1).alias("normal_pct"),
        F.round(F.avg(_column(speed)), 2).alias("avg_casting_speed"),
        F.round(F.avg(_column(width)), 3).alias("avg_mold_width"),
    )


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(_column(value)).agg(F.count(F.lit(1)).alias("n"))


def gap_stats(deltas: DataFrame, value: str = "time_diff_seconds") -> DataFrame:
    """Extremes, mean, median and 95th percentile. Steps are whole seconds, so
    they are counted per length first and the percentile weighs the counts."""
    counted = value_counts(deltas, value)
    v, n = _column(value), F.col("n")
    return counted.agg(
        F.min(v).alias("min_gap_sec"),
        F.max(v).alias("max_gap_sec"),
        (F.sum(v * n) / F.sum(n)).alias("avg_gap_sec"),
        F.percentile(v, 0.5, n).alias("median_gap_sec"),
        F.percentile(v, 0.95, n).alias("p95_gap_sec"),
    )


def trim_above(deltas: DataFrame, q: float = 0.99, value: str = "time_diff_seconds") -> DataFrame:
    """Rows up to the given percentile of whole-number ``value``."""
    limit = value_counts(deltas, value).agg(F.percentile(_column(value), q, F.col("n")))
    return deltas.filter(_column(value) <= limit.scalar())


def histogram(
    df: DataFrame, value: str, bins: int, weight: str | None = None
) -> DataFrame:
    """Counts in equal bins from the smallest to the largest value, the last bin
    closed; empty bins are listed. ``weight`` counts a row several times."""
    v = known(value)
    rows = df.filter(v.isNotNull())
    bounds = rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo = bounds.select("lo").scalar().cast("double")
    hi = bounds.select("hi").scalar().cast("double")
    at = F.coalesce(
        F.least(F.floor(F.try_divide(v - lo, hi - lo) * bins), F.lit(bins - 1)), F.lit(0)
    ).cast("bigint")
    n = F.sum(_column(weight)) if weight else F.count(F.lit(1))
    counts = rows.groupBy(at.alias("bin")).agg(n.cast("bigint").alias("n"))
    spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    step = (hi - lo) / bins
    return (
        spine.join(counts, "bin", "left")
        .fillna(0, subset=["n"])
        .withColumns(
            {"bin_start": lo + F.col("bin") * step, "bin_end": lo + (F.col("bin") + 1) * step}
        )
    )


def histogram_with_centre(df: DataFrame, value: str, bins: int) -> DataFrame:
    centre = quantiles(df.withColumn(value, known(value)), [], value, {"m": 0.5})
    return histogram(df, value, bins).withColumns(
        {
            "mean": df.agg(F.avg(known(value))).scalar(),
            "median": centre.select("m").scalar(),
        }
    )


def density_2d(df: DataFrame, x: str, y: str, bins_x: int, bins_y: int) -> DataFrame:
    """Counts of the filled cells of an equal grid over both ranges."""
    rows = df.filter(known(x).isNotNull() & known(y).isNotNull())
    bounds = rows.agg(
        F.min(known(x)).alias("x0"),
        F.max(known(x)).alias("x1"),
        F.min(known(y)).alias("y0"),
        F.max(known(y)).alias("y1"),
    )

    def cell(c: str, low: str, high: str, bins: int) -> Column:
        a = bounds.select(low).scalar().cast("double")
        b = bounds.select(high).scalar().cast("double")
        at = F.floor(F.try_divide(known(c) - a, b - a) * bins)
        return F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("bigint")

    return rows.groupBy(
        cell(x, "x0", "x1", bins_x).alias("x_bin"), cell(y, "y0", "y1", bins_y).alias("y_bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows that have both, from one
    aggregation."""
    pairs = list(combinations(range(len(columns)), 2))
    row = df.agg(
        *[
            F.corr(known(columns[i]), known(columns[j])).alias(f"c_{i}_{j}")
            for i, j in pairs
        ]
    )
    cells = [
        F.struct(F.lit(columns[a]).alias("x"), F.lit(columns[b]).alias("y"), F.col(f"c_{i}_{j}").alias("corr"))
        for i, j in pairs
        for a, b in ((i, j), (j, i))
    ] + [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("corr")) for c in columns]
    return row.select(F.inline(F.array(*cells)))


def corr_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    row = df.agg(*[F.corr(known(c), known(target)).alias(c) for c in columns])
    return row.unpivot([], list(columns), "parameter", "corr")


def quality_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing share, mean, spread and extremes per column, from one pass."""
    total = F.count(F.lit(1))
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("parameter"),
                ((total - F.count(known(c))) * 100.0 / total).alias("missing_pct"),
                F.avg(known(c)).alias("mean"),
                F.stddev_samp(known(c)).alias("std"),
                F.min(known(c)).alias("min"),
                F.max(known(c)).alias("max"),
            ).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]
    )
    return row.select(F.inline(F.array(*[f"q{i}" for i in range(len(columns))])))


def flag_counts(seqs: DataFrame, flags: Sequence[str] = ("has_disturbance", *FLAGS)) -> DataFrame:
    row = seqs.agg(*[F.count_if(_column(f)).alias(f) for f in flags])
    return row.unpivot([], list(flags), "flag", "count")


def flag_crosstab(seqs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two flags with an ``All`` row and column."""

    def shown(c: str) -> Column:
        return F.when(F.grouping(c) == 1, "All").otherwise(F.col(c).cast("string"))

    flags = seqs.select(_column(a).alias("a"), _column(b).alias("b"))
    return flags.cube("a", "b").agg(
        shown("a").alias(f"{a}_value"),
        shown("b").alias(f"{b}_value"),
        F.count(F.lit(1)).alias("n"),
    ).drop("a", "b")


def category_profile(
    seqs: DataFrame, keys: Sequence[str], category: str, ptp: str, sigma: str,
    asym: Column | None = None, points: int = 200,
) -> DataFrame:
    """Mean and population spread of ``ptp/2 * (T2(x) + 0.3 T1(x) asym)`` per
    category on a grid over [-1, 1].

    The profile is linear in the two amplitudes ptp/2 and ptp/2*asym, so their
    moments per category give every grid point; rows are never multiplied by
    the grid.
    """
    a = _column(ptp) * 0.5
    seqs = seqs.withColumn("_a", a).withColumn("_b", a * (asym if asym is not None else F.lit(0.0)))
    moments = seqs.groupBy(*[_column(k) for k in keys], _column(category)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_column(sigma)).alias("mean_sigma"),
        F.avg("_a").alias("_ma"),
        F.avg("_b").alias("_mb"),
        F.var_pop("_a").alias("_va"),
        F.var_pop("_b").alias("_vb"),
        F.covar_pop("_a", "_b").alias("_cab"),
    )
    grid = moments.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("point") * (2.0 / (points - 1)) - 1
    )
    t1 = F.col("x") * 0.3
    t2 = 2 * F.col("x") * F.col("x") - 1
    variance = t2 * t2 * F.col("_va") + t1 * t1 * F.col("_vb") + 2 * t1 * t2 * F.col("_cab")
    return grid.select(
        *[_column(k) for k in keys],
        _column(category),
        F.col("point").cast("bigint").alias("point"),
        "x",
        "n",
        "mean_sigma",
        (t2 * F.col("_ma") + t1 * F.col("_mb")).alias("profile_mean"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("profile_std"),
    )


def binned_trend(df: DataFrame, x: Column, y: str) -> DataFrame:
    return df.groupBy(x.alias("x_bin")).agg(
        F.avg(_column(y)).alias("mean_y"), F.count(F.lit(1)).alias("n")
    )


BOX = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample spread, extremes and quartiles per group; null and NaN values are left out.

    Moments are put together from those of the quartiles' bins, so the rows are read twice, for the bins and for the quartiles."""
    x = known(value).cast("double")
    valued = df.filter(x.isNotNull())
    cells = value_cells(valued, by, value, None, {"_mean": F.avg(x), "_spread": F.var_pop(x)})
    keys = [_column(b) for b in by]
    n, mean = F.col("_n0"), F.col("_mean")
    groups = cells.groupBy(*keys).agg(F.sum(n * mean).alias("_sum"), F.sum(n).alias("n"), F.min("_low").alias("min"), F.max("_high").alias("max"))
    groups = groups.withColumn("mean", F.try_divide("_sum", "n")).drop("_sum")
    quartiles = quantiles(valued, by, value, BOX, None, cells)
    if not by:
        centre = groups.select("mean").scalar()
        around = cells.agg(F.sum(n * (F.col("_spread") + (mean - centre) ** 2)).alias("_square")).select("_square").scalar()
        whole = groups.withColumn("n", F.coalesce("n", F.lit(0)))
        std = F.when(F.col("n") > 1, F.sqrt(around / (F.col("n") - 1)))
        return whole.select("n", "mean", std.alias("std"), "min", "max").withColumns({q: quartiles.select(q).scalar() for q in BOX})

    def beside(left: DataFrame, right: DataFrame, mark: str) -> DataFrame:
        right = right.withColumnsRenamed({b: f"_{mark}_{b}" for b in by})
        same = reduce(lambda a, b: a & b, [_column(b).eqNullSafe(_column(f"_{mark}_{b}")) for b in by])
        return left.join(right, same).drop(*[f"_{mark}_{b}" for b in by])

    centres = groups.select(*keys, F.col("mean").alias("_centre"))
    around = beside(cells, centres, "m").groupBy(*keys).agg(F.sum(n * (F.col("_spread") + (mean - F.col("_centre")) ** 2)).alias("_square"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_square") / (F.col("n") - 1)))
    moments = beside(groups, around, "s").select(*keys, "n", "mean", std.alias("std"), "min", "max")
    return beside(moments, quartiles, "q")


def grade_order(df: DataFrame, grade: str, sigma: str) -> DataFrame:
    """Grades ranked by median sigma, smallest first."""
    medians = quantiles(df.filter(_column(grade).isNotNull()), [grade], sigma, {"median_sigma": 0.5})
    place = F.row_number().over(Window.orderBy("median_sigma", grade))
    return medians.withColumn("place", place.cast("bigint"))


def stability_category(
    df: DataFrame, keys: Sequence[str], ptp: str, sigma: str, low: float = 0.2, high: float = 0.8
) -> DataFrame:
    """Stable, Medium or Unstable by the 20th and 80th percentile of sigma. Rows without ptp or sigma, NaN included, are left
    out. The rows are staged: cuts and categories read the few columns that are asked for."""
    valued = stage(df.filter(known(ptp).isNotNull() & known(sigma).isNotNull()), "stability")
    cuts = quantiles(valued, keys, sigma, {"q_low": low, "q_high": high})
    category = (
        F.when(_column(sigma) <= F.col("q_low"), "Stable")
        .when(_column(sigma) <= F.col("q_high"), "Medium")
        .otherwise("Unstable")
    )
    return valued.join(cuts, list(keys)).withColumn("stability", category)


def casting_totals(castings: DataFrame, start: str, end: str) -> DataFrame:
    return castings.agg(
        F.count(F.lit(1)).alias("castings"),
        F.min(_column(start)).alias("first_start"),
        F.max(_column(end)).alias("last_end"),
        F.sum(hours_between(start, end)).alias("total_hours"),
    )


def gap_class_summary(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("gap_type").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("time_diff_hours").alias("total_hours"),
        F.avg("time_diff_hours").alias("avg_hours"),
    )


def strand_summary(seqs: DataFrame, keys: Sequence[str], sigma: str, label: str, stable: float) -> DataFrame:
    """Windows, stable windows and their share per series, with a row per label."""
    key_cols = [_column(k) for k in keys]
    per_label = seqs.groupBy(*key_cols, _column(label)).agg(
        F.count(F.lit(1)).alias("label_count"),
        F.count_if(_column(sigma) <= stable).alias("_stable"),
    )
    whole = Window.partitionBy(*key_cols)
    out = per_label.withColumns(
        {
            "sequences": F.sum("label_count").over(whole),
            "stable_sequences": F.sum("_stable").over(whole),
        }
    )
    share = F.col("stable_sequences") * 100.0 / F.col("sequences")
    return out.withColumn("stable_pct", share).drop("_stable")


def hourly_coverage(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    n = F.col("data_points")
    return (
        df.groupBy(*[_column(k) for k in keys], F.date_trunc("hour", _column(ts)).cast("timestamp_ntz").alias("hour"))
        .agg(F.count(F.lit(1)).alias("data_points"))
        .withColumn(
            "coverage_level", F.when(n < 1800, "Sparse").when(n < 3000, "Good").otherwise("Dense")
        )
    )


def coverage_zero_filled(df: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """Per series: hours between first and last row, hours with data, their
    share, and the number of times data stop. Rows are counted per hour first."""
    key_cols = [_column(k) for k in keys]
    counts = hourly_coverage(df, ts, keys).drop("coverage_level")
    spans = counts.groupBy(*key_cols).agg(F.min("hour").alias("_a"), F.max("hour").alias("_b"))
    hours = spans.select(
        *key_cols, F.explode(F.sequence("_a", "_b", F.expr("interval 1 hour"))).alias("hour")
    )
    filled = hours.join(counts, [*keys, "hour"], "left").fillna(0, subset=["data_points"])
    empty = F.col("data_points") == 0
    along = Window.partitionBy(*key_cols).orderBy("hour")
    starts = empty & (F.lag("data_points").over(along) > 0)
    return (
        filled.withColumn("_start", F.coalesce(starts, F.lit(False)))
        .groupBy(*key_cols)
        .agg(
            F.count(F.lit(1)).alias("total_hours"),
            F.count_if(~empty).alias("hours_with_data"),
            F.count_if("_start").alias("gap_count"),
        )
        .withColumn("coverage_pct", F.col("hours_with_data") * 100.0 / F.col("total_hours"))
    )


def label_example(
    df: DataFrame, by: Sequence[str], order: Sequence[str], strength: str, columns: Sequence[str]
) -> DataFrame:
    """Per label the first row in ``order`` and the one with most ``strength``."""
    place = F.struct(*[_column(c) for c in order])
    most = F.struct((-_column(strength)).alias("s"), *[_column(c) for c in order])
    return df.groupBy(*[_column(b) for b in by]).agg(
        *[F.min_by(_column(c), place).alias(f"first_{c}") for c in columns],
        *[F.min_by(_column(c), most).alias(f"strongest_{c}") for c in columns],
    )


def summary_report(
    seqs: DataFrame,
    sigma: str,
    label: str,
    stable: float,
    parameters: Mapping[str, tuple[str, str | None]],
) -> DataFrame:
    """The figures of the text report as rows (section, item, value, pct).

    ``parameters`` maps a display name to the column of its mean and, where the
    statistics carry one, the column whose spread is reported (else 0).
    """
    n, s = F.count(F.lit(1)), _column(sigma)
    is_stable = F.count_if(s <= stable)
    row = seqs.agg(
        n.alias("n"),
        is_stable.alias("stable"),
        (is_stable * 100.0 / n).alias("stable_pct"),
        F.avg(s).alias("mean_sigma"),
        *[F.avg(_column(c)).alias(f"m{i}") for i, (c, _) in enumerate(parameters.values())],
        *[
            (F.stddev_samp(_column(d)) if d else F.lit(0.0)).alias(f"s{i}")
            for i, (_, d) in enumerate(parameters.values())
        ],
    ).withColumn("median_sigma", quantiles(seqs, [], sigma, {"m": 0.5}).select("m").scalar())

    def item(section: str, name: str, value: Column, pct: Column | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(name).alias("item"),
            value.cast("double").alias("value"),
            (pct if pct is not None else F.lit(None).cast("double")).alias("pct"),
        )

    items = [
        item("Overall", "Total sequences", F.col("n")),
        item("Stability", "Stable", F.col("stable"), F.col("stable_pct")),
        item("Stability", "Mean sigma", F.col("mean_sigma")),
        item("Stability", "Median sigma", F.col("median_sigma")),
    ]
    for i, name in enumerate(parameters):
        items.append(item("Parameters", f"{name} mean", F.col(f"m{i}")))
        items.append(item("Parameters", f"{name} std", F.col(f"s{i}")))
    figures = row.select(F.inline(F.array(*items)))
    counted = label_counts(seqs, label)
    labels = counted.select(
        F.lit("Disturbances").alias("section"),
        _column(label).alias("item"),
        F.col("count").cast("double").alias("value"),
        F.col("percentage").cast("double").alias("pct"),
    )
    return figures.unionByName(labels)
