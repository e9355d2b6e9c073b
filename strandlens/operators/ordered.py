"""Running values over long ordered series, without one task per series.

A window partitioned by series alone sends a whole series to one task. Here a
series is cut into chunks along its order; each chunk is a window partition of
its own, and what it needs from earlier chunks arrives as a carry. Carries come
from one partially aggregated summary row per chunk, so only those rows are
ever ordered per series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import _column, micros
from ..sources.sinks import stage
from ..spec import SignalSpec

CHUNK = "_chunk"
BLOCK = "_block"


def widest_chunk(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    max_rows: int = 2_000_000,
    widths: Sequence[float] = (86_400, 3_600, 60, 1, 0.001),
) -> float | None:
    """Widest chunk in seconds that keeps every (series, chunk) within
    ``max_rows``; None where even the narrowest does not.

    Rows are counted per series and narrowest chunk; the wider counts build on
    each other. One job over the key and time columns brings back one row.
    """
    widths = sorted(widths)
    at = F.floor(micros(ts) / int(widths[0] * 1_000_000)).cast("bigint")
    counts = df.groupBy(*[_column(k) for k in keys], at.alias("_at")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    fitting = None
    for narrower, width in zip([None, *widths], widths):
        if narrower is not None:
            ratio = int(width * 1_000_000) // int(narrower * 1_000_000)
            wider = F.floor(F.col("_at") / ratio).cast("bigint")
            counts = counts.groupBy(*[_column(k) for k in keys], wider.alias("_at")).agg(
                F.sum("_n").alias("_n")
            )
        peak = counts.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("peak"))
        row = peak.filter(F.col("peak") <= max_rows).select(F.lit(float(width)).alias("w"))
        fitting = row if fitting is None else fitting.unionByName(row)
    return fitting.agg(F.max("w")).first()[0]


TIEBREAK = "_tie"


def with_tiebreak(df: DataFrame, spec: SignalSpec) -> tuple[DataFrame, SignalSpec]:
    """A total order for rows that share a timestamp: the spec's own tiebreak behind a number hashed from the whole row, so
    that rows of one timestamp can be parted evenly whatever their columns hold. Rows equal in all columns are
    interchangeable."""
    if spec.tiebreak:
        return df, spec
    return df.withColumn(TIEBREAK, F.xxhash64(*[_column(c) for c in df.columns])), replace(spec, tiebreak=(TIEBREAK,))


def fit_chunks(df: DataFrame, spec: SignalSpec, max_rows: int = 2_000_000) -> SignalSpec:
    """The spec with chunks fitted to the data: as wide in time as ``max_rows`` allows, or parted by the tiebreak where one
    timestamp alone has too many rows. The spec must name a tiebreak, an integer first (see ``with_tiebreak``)."""
    kind = {f.name: f.dataType for f in df.schema.fields}.get(spec.tiebreak[0]) if spec.tiebreak else None
    if not isinstance(kind, T.IntegralType):
        raise ValueError("rows need a total order: name an integer tiebreak, or add one by with_tiebreak")
    width = widest_chunk(df, spec.keys, spec.ts, max_rows)
    if width is not None:
        return replace(spec, chunk_seconds=width, tie_width=None)
    tie = _column(spec.tiebreak[0]).cast("double")
    at = df.groupBy(*[_column(k) for k in spec.keys], _column(spec.ts)).agg(
        F.count(F.lit(1)).alias("n"), (F.max(tie) - F.min(tie) + 1).alias("spread")
    )
    # Each part of a timestamp spans as many values as its rows, evenly spread, need to stay within half the limit.
    fine = at.filter(F.col("n") > max_rows).agg(F.min(F.col("spread") / F.col("n"))).first()[0]
    return replace(spec, tie_width=max(1, int((fine or 1.0) * max_rows / (1 if (fine or 1.0) <= 1 else 2))))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None = None,
    *,
    lag: Mapping[str, str | Column] | None = None,
    position: str | None = None,
    counts: Mapping[str, Column] | None = None,
    last: Mapping[str, str | Column] | None = None,
    following: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Add running columns along ``order`` inside each series.

    ``lag``       value of the previous row
    ``position``  0-based row number
    ``counts``    number of rows up to and including this one where the flag holds
    ``last``      latest non-null value up to and including this row
    ``following`` next non-null value from this row on

    ``order`` must be a total order without nulls, ``chunk`` any orderable value
    that never decreases along it.
    When ``chunk`` is None the frame already carries the chunk column. The
    chunk column stays on the result so that a further scan needs no new
    shuffle; ``finish`` drops it. A scan reads its input twice, once for the
    carries, so columns that do not build on each other belong in one scan.
    """
    lag, counts, last = dict(lag or {}), dict(counts or {}), dict(last or {})
    following = dict(following or {})
    names = list(df.columns)
    base = df if chunk is None else df.withColumn(CHUNK, chunk)
    inputs = {}
    for new, value in {**lag, **last, **following}.items():
        inputs[f"_in_{new}"] = _column(value)
    for new, flag in counts.items():
        inputs[f"_in_{new}"] = F.coalesce(flag, F.lit(False)).cast("bigint")
    base = base.withColumns(inputs) if inputs else base

    group = [_column(k) for k in keys] + [F.col(CHUNK)]
    place = F.struct(*[_column(c) for c in order]) if len(order) > 1 else _column(order[0])
    summary = [F.count(F.lit(1)).alias("_rows")]
    for new, value in lag.items():
        if isinstance(value, str) and value == order[0]:
            summary.append(F.max(_column(value)).alias(f"_end_{new}"))
        else:
            summary.append(F.max_by(F.col(f"_in_{new}"), place).alias(f"_end_{new}"))
    for new in counts:
        summary.append(F.sum(f"_in_{new}").alias(f"_end_{new}"))
    for new in [*last, *following]:
        there = F.when(F.col(f"_in_{new}").isNotNull(), place)
        pick = F.max_by if new in last else F.min_by
        summary.append(pick(F.col(f"_in_{new}"), there).alias(f"_end_{new}"))

    along = Window.partitionBy(*[_column(k) for k in keys]).orderBy(CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    later = along.rowsBetween(1, Window.unboundedFollowing)
    carry = [F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_carry_rows")]
    for new in lag:
        carry.append(F.lag(f"_end_{new}").over(along).alias(f"_carry_{new}"))
    for new in counts:
        carry.append(
            F.coalesce(F.sum(f"_end_{new}").over(before), F.lit(0)).alias(f"_carry_{new}")
        )
    for new in last:
        carry.append(F.last(f"_end_{new}", ignorenulls=True).over(before).alias(f"_carry_{new}"))
    for new in following:
        carry.append(F.first(f"_end_{new}", ignorenulls=True).over(later).alias(f"_carry_{new}"))
    carries = base.groupBy(*group).agg(*summary).select(*group, *carry)

    inside = Window.partitionBy(*group).orderBy(*[_column(c) for c in order])
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {"_row": F.row_number().over(inside)}
    for new in lag:
        local[f"_loc_{new}"] = F.lag(f"_in_{new}").over(inside)
    for new in counts:
        local[f"_loc_{new}"] = F.sum(f"_in_{new}").over(running)
    for new in last:
        local[f"_loc_{new}"] = F.last(f"_in_{new}", ignorenulls=True).over(running)
    backwards = Window.partitionBy(*group).orderBy(*[_column(c).desc() for c in order])
    for new in following:
        local[f"_loc_{new}"] = F.last(f"_in_{new}", ignorenulls=True).over(
            backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )

    joined = base.withColumns(local).join(carries, [*keys, CHUNK])
    out = [_column(c) for c in names if c != CHUNK]
    for new in lag:
        out.append(
            F.when(F.col("_row") == 1, F.col(f"_carry_{new}"))
            .otherwise(F.col(f"_loc_{new}"))
            .alias(new)
        )
    if position:
        out.append((F.col("_carry_rows") + F.col("_row") - 1).cast("bigint").alias(position))
    for new in counts:
        out.append((F.col(f"_carry_{new}") + F.col(f"_loc_{new}")).cast("bigint").alias(new))
    for new in [*last, *following]:
        out.append(F.coalesce(F.col(f"_loc_{new}"), F.col(f"_carry_{new}")).alias(new))
    return joined.select(*out, F.col(CHUNK))


def finish(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "pos"
) -> DataFrame:
    """0-based row number in time order: the index of the series without its gaps."""
    return finish(scan(df, keys, order, chunk, position=name))


def every_kth(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, k: int
) -> DataFrame:
    placed = with_position(df, keys, order, chunk, "_pos")
    return placed.filter(F.col("_pos") % k == 0).drop("_pos")


def time_deltas(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column
) -> DataFrame:
    """Whole seconds to the previous row; the first row of a series is left out."""
    ts = order[0]
    lagged = finish(scan(df, keys, order, chunk, lag={"prev_timestamp": ts}))
    seconds = F.floor(micros(ts) / 1_000_000) - F.floor(micros("prev_timestamp") / 1_000_000)
    return lagged.withColumn("time_diff_seconds", seconds.cast("bigint")).filter(
        F.col("prev_timestamp").isNotNull()
    )


def significant_gaps(deltas: DataFrame, threshold_seconds: float = 300) -> DataFrame:
    s = F.col("time_diff_seconds")
    return deltas.filter(s > threshold_seconds).withColumns(
        {"time_diff_minutes": s / 60, "time_diff_hours": s / 3600}
    )


def _re_rounded(x: Column, before: Column, round_up: bool, step: float) -> Column:
    """The new output where the raw value moved by more than ``step``, else null."""
    shifted = F.rint(x * 100 + F.lit(0.5 if round_up else -0.5)) / 100
    held = F.coalesce(F.abs(x - before) <= step, F.lit(False))
    return F.when(~held, shifted)


def hysteresis_round(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: str,
    name: str,
    round_up: bool = True,
    step: float = 0.01,
) -> DataFrame:
    """Two-decimal rounding that keeps the previous output while the raw value
    moves by at most ``step``. A move re-rounds, half a unit up or down; a
    missing value stays missing and the next one is a move."""
    moved = scan(df, keys, order, chunk, lag={"_before": value})
    fresh = _re_rounded(_column(value), F.col("_before"), round_up, step)
    held = finish(scan(moved, keys, order, last={name: fresh})).drop("_before")
    return held.withColumn(name, F.when(_column(value).isNotNull(), F.col(name)))


def segment_by_gaps(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    max_gap_seconds: float,
    rounded: tuple[str, str] | None = None,
    step: float = 0.01,
) -> DataFrame:
    """Add ``segment_id`` (0, 1, ... per series), ``pos`` (row number in the
    series) and ``seg_pos`` (row number in the segment). A segment ends where
    the step to the next row is longer than ``max_gap_seconds``, to the
    microsecond.

    ``rounded`` = (value, name) adds the rounding of ``hysteresis_round``, which
    runs across segments, in the same two scans.
    """
    ts = order[0]
    lag = {"_prev": ts}
    if rounded:
        lag["_before"] = rounded[0]
    stepped = scan(df, keys, order, chunk, lag=lag, position="pos")
    starts = F.coalesce(
        micros(ts) - micros("_prev") > F.lit(int(max_gap_seconds * 1_000_000)), F.lit(False)
    )
    last = {"_first": F.when(starts, F.col("pos"))}
    if rounded:
        last[rounded[1]] = _re_rounded(_column(rounded[0]), F.col("_before"), True, step)
    cut = finish(scan(stepped, keys, order, counts={"segment_id": starts}, last=last))
    if rounded:
        known = F.when(_column(rounded[0]).isNotNull(), _column(rounded[1]))
        cut = cut.withColumn(rounded[1], known)
    seg_pos = F.col("pos") - F.coalesce(F.col("_first"), F.lit(0))
    return cut.withColumn("seg_pos", seg_pos.cast("bigint")).drop("_prev", "_first", "_before")


def run_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    status: Column,
    value: str,
    max_step: float,
    min_length: int,
    name: str = "run",
) -> DataFrame:
    """Rows with ``status``, grouped while neighbouring values differ by at most
    ``max_step``; groups shorter than ``min_length`` are left out."""
    stepped = scan(df.filter(status), keys, order, chunk, lag={"_before": value})
    jump = F.abs(_column(value) - F.col("_before")) > max_step
    grouped = finish(scan(stepped, keys, order, counts={name: jump})).drop("_before")
    sizes = grouped.groupBy(*[_column(k) for k in keys], name).agg(
        F.count(F.lit(1)).alias("_size")
    )
    long_enough = sizes.filter(F.col("_size") >= min_length).drop("_size")
    return grouped.join(long_enough, [*keys, name], "left_semi")


def halo_blocks(
    df: DataFrame, pos: str, size: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Copy every row into each position block that needs it.

    Block b owns the positions [b*size, (b+1)*size) and also sees the ``before``
    rows that precede and the ``after`` rows that follow them, so a framed window inside a
    block is exact for the rows it owns and no block exceeds a fixed size.
    ``_owned`` tells the owned rows from the copies.
    """
    p = F.col(pos)
    first = F.greatest(p - after, F.lit(0))
    blocks = F.sequence(
        F.floor(first / size).cast("bigint"), F.floor((p + before) / size).cast("bigint")
    )
    return df.withColumn(BLOCK, F.explode(blocks)).withColumn(
        "_owned", F.floor(p / size).cast("bigint") == F.col(BLOCK)
    )


def spike_clean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: str,
    name: str,
    window: int = 5,
    jump: float = 5.0,
    block_rows: int = 65_536,
) -> DataFrame:
    """Null out values where the centred running median jumps, then interpolate.

    The running median is null where its window is incomplete or holds a null;
    a jump is a step between neighbouring medians. Interpolation is linear by
    row number, flat beyond the first and last kept value.
    """
    x = _column(value)
    placed = finish(scan(df, keys, order, chunk, position="_pos"))
    behind = window // 2
    ahead = window - 1 - behind
    in_block = Window.partitionBy(*[_column(k) for k in keys], BLOCK).orderBy("_pos")
    frame = in_block.rowsBetween(-behind, ahead)
    median = F.when(F.count(x).over(frame) == window, F.percentile(x, F.lit(0.5)).over(frame))
    blocked = halo_blocks(placed, "_pos", block_rows, before=behind + 1, after=ahead)
    step = F.abs(F.col("_med") - F.lag("_med").over(in_block))
    kept = (
        blocked.withColumn("_med", median)
        .withColumn("_kept", F.when(~F.coalesce(step > jump, F.lit(False)), x))
        .filter("_owned")
        .withColumnRenamed(BLOCK, CHUNK)
        .drop("_owned", "_med")
    )
    point = F.when(F.col("_kept").isNotNull(), F.struct(F.col("_pos").alias("p"), F.col("_kept").alias("v")))
    both = finish(scan(kept, keys, ["_pos"], last={"_left": point}, following={"_right": point}))
    a, b = F.col("_left"), F.col("_right")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("_pos") - a["p"]) / (b["p"] - a["p"])
    filled = F.coalesce(F.col("_kept"), between, a["v"], b["v"])
    return both.withColumn(name, filled).select(*[_column(c) for c in df.columns], name)


def _range_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows sorted over ranges of ``order``, staged, with ``_range`` and ``_place``, the place in the range. Ranges are fitted to the rows,
    so they stay even whatever the values are."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a partition and the row's place in it, in one integer.
    at = dealt.withColumn("_at", F.monotonically_increasing_id())
    parts = {"_range": F.shiftright("_at", 33).cast("int"), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)}
    return stage(at.withColumns(parts).drop("_at"), "sorted")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """0-based number of each row along ``order`` in its group, which may be one for all rows and may have rows of one value only.
    Offsets come from a count per group and range."""
    key_cols = [_column(k) for k in keys]
    placed = _range_sorted(df, [*[k.asc() for k in key_cols], *order])
    counts = placed.groupBy(*key_cols, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    along = Window.partitionBy(*key_cols).orderBy("_range")
    counts = counts.withColumn("_upto", F.sum("_n").over(along) - F.col("_n"))
    renamed = counts.withColumnsRenamed({c: f"_c_{c}" for c in [*keys, "_range"]})
    match = F.col("_range") == F.col("_c__range")
    for k in keys:
        match = match & _column(k).eqNullSafe(_column(f"_c_{k}"))
    number = (F.col("_upto") + F.col("_place") - F.col("_first")).cast("bigint")
    return placed.join(renamed, match).select(*[_column(c) for c in df.columns], number.alias(name))


def ecdf(counts: DataFrame, value: str, piece: int = 10_000) -> DataFrame:
    """One row per counted value with its rank and cumulative percentage.

    ``counts`` holds (value, n), with any number of distinct values. Equal values get
    distinct ranks; a value that occurs very often is spread over tasks before
    it is expanded. Running counts are taken inside ranges of the value; the ranges' own sums, one row per range, are added up on
    the driver.
    """
    spark = counts.sparkSession
    # Fitting the ranges reads the counts once more, so they are worked out before.
    counts = stage(counts.select(value, F.col("n").cast("bigint").alias("n")), "ecdf-counts")
    placed = _range_sorted(counts, [_column(value).asc()])
    sums = placed.groupBy("_range").agg(F.sum("n").alias("n")).collect()
    before, total = [], 0
    for r in sorted(sums, key=lambda r: r["_range"]):
        before.append((r["_range"], total))
        total += r["n"]
    # As many rows as ranges.
    before = spark.createDataFrame(before, "_range int, _before bigint")
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.withColumn("_to", F.sum("n").over(inside)).join(F.broadcast(before), "_range")
    pieces = (
        upto.select(value, "n", (F.col("_to") + F.col("_before")).alias("_to"))
        .withColumn("_from", F.col("_to") - F.col("n") + 1)
        .withColumn(
            "_start", F.explode(F.sequence("_from", "_to", F.lit(piece).cast("bigint")))
        )
        .repartition(value, "_start")
    )
    ranks = F.sequence("_start", F.least(F.col("_start") + (piece - 1), F.col("_to")))
    return pieces.withColumn("rank", F.explode(ranks)).select(
        value, "rank", (F.col("rank") / F.lit(total) * 100).alias("cumulative_pct")
    )
