"""Fixed-length windows in which speed and currents stay steady.

The rule is greedy: walk a segment from its first row; a steady window of W rows
is taken and skipped over, otherwise the walk moves on by one row. The walk is
sequential, but its state when it enters a stretch of rows is one of W offsets.
So stretches ("pieces") are worked in parallel: each gives a table from entry to
exit offset, the tables are composed in a tree, and a final parallel walk
emits the windows (see ``walks``). Only runs of steady starts are sent, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import _column, bucket
from ..sources.sinks import stage
from .ordered import BLOCK, finish, halo_blocks, scan, segment_by_gaps, with_position
from .walks import Spaced, chain_entries, terminals, visits, whole_pieces

PIECE_ROWS = 1 << 20


def steady_starts(
    df: DataFrame,
    keys: Sequence[str],
    speed: str,
    window: int,
    speed_threshold: float,
    currents: Sequence[str] = (),
    current_threshold: float | None = None,
    segment: str = "segment_id",
    pos: str = "pos",
    block_rows: int = 65_536,
) -> DataFrame:
    """Mark for every row whether a full window starts there (``complete``) and
    whether that window is steady (``steady``).

    Steady: every speed lies within ``speed_threshold`` of the window's first
    one, and every step of a current inside the window stays below
    ``current_threshold``. A missing speed fails a window, a missing current
    step does not; a current column that the frame lacks fails all windows.

    Window extremes are put together from running extremes over slots of W
    rows: a window is the tail of one slot plus the head of the next, so the
    work per row does not grow with W.
    """
    names = list(df.columns)
    use_currents = bool(currents) and current_threshold is not None
    lacking = use_currents and any(c not in names for c in currents)
    size = max(1, block_rows // window) * window
    key_cols = [_column(k) for k in keys]

    blocked = halo_blocks(df, pos, size, after=window - 1)
    blocked = blocked.withColumn("_slot", F.floor(F.col(pos) / window).cast("bigint"))
    in_block = Window.partitionBy(*key_cols, BLOCK).orderBy("_slot", pos)
    steps = {}
    if use_currents and not lacking:
        for i, c in enumerate(currents):
            value = F.nanvl(_column(c).cast("double"), F.lit(None).cast("double"))
            steps[f"_step{i}"] = F.abs(value - F.lag(value).over(in_block))
    blocked = blocked.withColumns(steps) if steps else blocked

    slot = Window.partitionBy(*key_cols, BLOCK, "_slot")
    head = slot.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    tail = slot.orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    after = slot.orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, -1)
    v = _column(speed)
    tails = {
        "_tail_max": F.max(v).over(tail),
        "_tail_min": F.min(v).over(tail),
        "_tail_known": F.count(v).over(tail),
        **{f"_tail{s}": F.max(s).over(after) for s in steps},
    }
    heads = {
        "_head": F.struct(
            F.max(v).over(head).alias("max"),
            F.min(v).over(head).alias("min"),
            F.count(v).over(head).alias("known"),
            _column(segment).alias("segment"),
            F.col("_slot").alias("slot"),
            *[F.max(s).over(head).alias(s) for s in steps],
        )
    }
    ends = {"_end": F.lead("_head", window - 1).over(in_block)}
    seen = blocked.withColumns(tails).withColumns(heads).withColumns(ends).filter("_owned")

    end = F.col("_end")
    # A window that fills its slot exactly has its tail counted in full; its
    # head is the same rows again, which changes no extreme.
    straddles = end["slot"] != F.col("_slot")
    known = F.col("_tail_known") + F.when(straddles, end["known"]).otherwise(0)
    highest = F.greatest(F.col("_tail_max"), end["max"])
    lowest = F.least(F.col("_tail_min"), end["min"])
    steady = (
        (known == window)
        & (highest - v <= F.lit(speed_threshold))
        & (v - lowest <= F.lit(speed_threshold))
    )
    for s in steps:
        worst = F.greatest(F.col(f"_tail{s}"), F.when(straddles, end[s]))
        steady = steady & F.coalesce(worst < F.lit(current_threshold), F.lit(True))
    if lacking:
        steady = F.lit(False)
    complete = F.coalesce(end["segment"] == _column(segment), F.lit(False))
    return seen.select(
        *[_column(c) for c in names],
        F.col(BLOCK),
        complete.alias("complete"),
        (complete & F.coalesce(steady, F.lit(False))).alias("steady"),
    )


def pick_windows(
    starts: DataFrame,
    keys: Sequence[str],
    window: int,
    segment: str = "segment_id",
    pos: str = "pos",
    seg_pos: str = "seg_pos",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Greedy choice of non-overlapping windows: (keys, segment, start_pos). A window starts at the first steady start that
    is not before the end of the window chosen last."""
    if piece_rows < window:
        raise ValueError("a piece must hold at least one window")
    key_cols = [_column(k) for k in keys]
    group = [*key_cols, _column(segment)]
    good = (
        starts.filter("steady")
        .select(*group, BLOCK, F.col(pos).alias("_p"), F.col(seg_pos).alias("_q"))
        .withColumn("_piece", F.floor(F.col("_q") / piece_rows).cast("bigint"))
    )
    rank = F.row_number().over(Window.partitionBy(*key_cols, BLOCK).orderBy("_p"))
    # Runs by segment position; the shift back to the row number in the series
    # is constant within a segment.
    runs = (
        good.withColumn("_island", F.col("_p") - rank)
        .groupBy(*key_cols, BLOCK, segment, "_piece", "_island")
        .agg(
            F.min("_q").alias("a"),
            F.max("_q").alias("b"),
            F.first(F.col("_p") - F.col("_q")).alias("_shift"),
        )
    )
    begin = F.col("_piece") * piece_rows
    runs = stage(
        runs.select(*group, "_piece", (F.col("a") - begin).alias("a"), (F.col("b") - begin).alias("b"), (F.col("_shift") + begin).alias("_shift")),
        "runs",
    )
    by_piece = [*keys, segment, "_piece"]
    pieces = [_column(c) for c in by_piece]

    # Segments of one piece, the usual case, need no chaining.
    long_segments = (
        runs.groupBy(*group)
        .agg(F.max("_piece").alias("_last"))
        .filter(F.col("_last") > 0)
        .drop("_last")
    )

    def spaced(table: pa.Table, piece: np.ndarray) -> Spaced:
        return Spaced(piece, table.column("a").to_numpy(), table.column("b").to_numpy(), piece_rows, window)

    def starts_in(runs: pa.Table | pa.RecordBatch) -> np.ndarray:
        return runs.column("b").to_numpy() - runs.column("a").to_numpy() + 2

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, piece in whole_pieces(batches, by_piece, starts_in):
            number, first = np.unique(piece, return_index=True)
            leave = spaced(table, piece).leaves(number)
            lists = pa.ListArray.from_arrays(np.arange(len(number) + 1) * window, pa.array(leave.ravel(), pa.int32()))
            yield from table.select(by_piece).take(first).append_column("_leave", lists).to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, piece in whole_pieces(batches, by_piece, starts_in):
            entry = np.zeros(int(piece[-1]) + 1 if len(piece) else 0, np.int64)
            entered = table.column("_entry").to_numpy()
            entry[piece[entered >= 0]] = entered[entered >= 0]
            walked = spaced(table, piece)
            at = walked.picked(np.arange(len(entry)), entry)
            run = walked.run[at]
            start = walked.place[at] + table.column("_shift").to_numpy()[run]
            yield from table.select([*keys, segment]).take(run).append_column("start_pos", pa.array(start)).to_batches()

    dealt = lambda df: df.repartition(*pieces).sortWithinPartitions(*pieces, "a")
    listed = dealt(runs.join(long_segments, [*keys, segment], "left_semi").select(*pieces, "a", "b"))
    kept = T.StructType(listed.schema.fields[: len(by_piece)])
    tables = listed.mapInArrow(fold, T.StructType([*kept.fields, T.StructField("_leave", T.ArrayType(T.IntegerType()))]))
    entries = chain_entries(tables, [*keys, segment], window, restart=True)
    # A piece's entry travels as a run without places, ahead of the others.
    none = {"a": F.lit(-1), "b": F.lit(-2), "_shift": F.lit(0)}
    entered = entries.withColumns({c: v.cast("bigint") for c, v in none.items()})
    both = runs.withColumn("_entry", F.lit(-1)).unionByName(entered)
    return dealt(both).mapInArrow(walk, T.StructType([*kept.fields[:-1], T.StructField("start_pos", T.LongType())]))


def window_rows(
    rows: DataFrame,
    picks: DataFrame,
    keys: Sequence[str],
    window: int,
    pos: str = "pos",
    how: str = "inner",
) -> DataFrame:
    """Rows with the window that holds them and what ``picks`` says of it,
    joined on slots of W rows; a window touches at most two."""
    slot = "_slot"
    labels = [c for c in picks.columns if c not in rows.columns]
    starts = picks.select(*[_column(k).alias(f"_w_{k}") for k in keys], *labels).withColumn(
        "_w_slot",
        F.explode(
            F.array_distinct(
                F.array(
                    F.floor(F.col("start_pos") / window).cast("bigint"),
                    F.floor((F.col("start_pos") + window - 1) / window).cast("bigint"),
                )
            )
        ),
    )
    p = F.col(pos)
    match = (F.col(slot) == F.col("_w_slot")) & p.between(
        F.col("start_pos"), F.col("start_pos") + window - 1
    )
    for k in keys:
        match = match & (_column(k) == _column(f"_w_{k}"))
    slotted = rows.withColumn(slot, F.floor(p / window).cast("bigint"))
    return slotted.join(starts, match, how).drop(slot, "_w_slot", *[f"_w_{k}" for k in keys])


def number_windows(
    picks: DataFrame, keys: Sequence[str], name: str = "seq_no", chunk_rows: int = PIECE_ROWS
) -> DataFrame:
    """Number the windows of a series in time order, from 0."""
    chunk = F.floor(F.col("start_pos") / chunk_rows).cast("bigint")
    return finish(scan(picks, keys, ["start_pos"], chunk, position=name))


def sequence_name(number: str | Column) -> Column:
    return F.format_string("seq_%04d", _column(number))


def segmented_starts(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    speed: str,
    window: int,
    speed_threshold: float,
    currents: Sequence[str],
    current_threshold: float | None,
    max_gap_seconds: float,
    min_segment_rows: int | None = None,
    rounded: str | None = None,
    block_rows: int = 65_536,
) -> DataFrame:
    """Cut at time gaps, then mark steady window starts inside each segment.
    With ``rounded`` the search sees the rounded speed, kept in that column."""
    rounding = (speed, rounded) if rounded else None
    cut = segment_by_gaps(rows, keys, order, chunk, max_gap_seconds, rounding)
    speed = rounded or speed
    if min_segment_rows is not None and min_segment_rows > window:
        group = [*keys, "segment_id"]
        long_enough = (
            cut.groupBy(*[_column(c) for c in group])
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= min_segment_rows)
            .drop("_n")
        )
        cut = cut.join(long_enough, group, "left_semi")
    return steady_starts(
        cut, keys, speed, window, speed_threshold, currents, current_threshold, block_rows=block_rows
    )


def abnormal_starts(
    starts: DataFrame, picks: DataFrame, keys: Sequence[str], window: int, pos: str = "pos"
) -> DataFrame:
    """Starts of the windows that the walk visited and rejected: every complete
    start outside the chosen windows."""
    rows = starts.filter("complete").drop(BLOCK, "complete", "steady")
    return window_rows(rows, picks, keys, window, pos, "left_anti")


def _breaks(values: np.ndarray, window: int, threshold: float) -> np.ndarray:
    """Steps from each row to the first one of its window that is off by more than ``threshold``; -1 without one."""
    found = np.full(len(values), -1, np.int64)
    for step in range(1, window):
        off = np.zeros(len(values), bool)
        off[:-step] = np.abs(values[step:] - values[:-step]) > threshold
        found[(found < 0) & off] = step
    return found


def break_windows(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    speed: str,
    window: int,
    threshold: float,
    max_windows: int | None = None,
    span: str | None = None,
    chunk_seconds: float = 86_400,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The visited windows of each series when a failed window is resumed behind the row that broke it.

    The whole series is walked. ``span`` asks for the first part of each series only, ``max_windows`` for its first
    windows. From any row the walk moves on by one to ``window`` rows, so a piece of ``piece_rows`` rows is entered at one
    of ``window`` offsets: pieces are folded for all of them in parallel, chained, and walked once more.
    """
    if piece_rows < window:
        raise ValueError("a piece must hold at least one window")
    keys = list(keys)
    ts = order[0]
    if span is not None:
        first = rows.groupBy(*[_column(k) for k in keys]).agg(F.min(_column(ts)).alias("_t0"))
        rows = rows.join(first, keys).filter(_column(ts) <= F.col("_t0") + F.expr(span)).drop("_t0")
    placed = with_position(rows, keys, order, bucket(ts, chunk_seconds), "_n")
    if max_windows is not None:
        placed = placed.filter(F.col("_n") < max_windows * window)
    value = F.coalesce(_column(speed).cast("double"), F.lit(float("nan")))
    cut = placed.select(*[_column(k) for k in keys], "_n", value.alias("_v"))
    blocked = halo_blocks(cut, "_n", piece_rows, after=window - 1)
    key_schema = rows.select(*[_column(k) for k in keys]).schema

    def steps(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Positions, steps to breaks, next positions (relative; beyond the series: -1) and the number of own rows."""
        table = table.sort_by("_n")
        pos = table.column("_n").to_numpy()
        breaks = _breaks(table.column("_v").to_numpy(), window, threshold)
        at = np.arange(len(pos))
        following = np.where(breaks < 0, at + window, at + breaks + 1)
        following[at + window > len(pos)] = -1
        return pos, breaks, following, int(np.count_nonzero(table.column("_owned").to_numpy(zero_copy_only=False)))

    def keyed(table: pa.Table, n: int) -> list[pa.Array]:
        return [table.column(k).combine_chunks().take(pa.array([0] * n, pa.int64())) for k in keys]

    def fold(table: pa.Table) -> pa.Table:
        _, _, following, own = steps(table)
        here = np.arange(own)
        ends = terminals(np.where((following[:own] >= 0) & (following[:own] < own), following[:own], here))
        leave = np.full(window, -1, np.int64)
        leave[:own] = np.where(following[ends] < 0, -1, following[ends] - own)[:window]
        piece = table.column(BLOCK).combine_chunks()[:1]
        return pa.Table.from_arrays([*keyed(table, 1), piece, pa.array([leave], pa.list_(pa.int32()))], names=[*keys, "_piece", "_leave"])

    def walk(table: pa.Table) -> pa.Table:
        pos, breaks, following, own = steps(table)
        # A place that no window fits from is the walk's end, and not visited.
        fits = following[:own] >= 0
        jump = np.where(fits & (following[:own] < own), following[:own], own)
        i = visits(jump, table.column("_entry").to_numpy()[:1].astype(np.int64))
        i = i[fits[i]]
        broken = pa.array(pos[i] + breaks[i], pa.int64(), mask=breaks[i] < 0)
        made = [*keyed(table, len(i)), pa.array(pos[i], pa.int64()), broken, pa.array(breaks[i] < 0)]
        return pa.Table.from_arrays(made, names=[*keys, "start_pos", "break_pos", "stable"])

    group = [*[_column(k) for k in keys], F.col(BLOCK)]
    pieces = T.StructType([*key_schema.fields, T.StructField("_piece", T.LongType()), T.StructField("_leave", T.ArrayType(T.IntegerType()))])
    # A piece holds at most piece_rows + window - 1 rows.
    tables = blocked.groupBy(*group).applyInArrow(fold, pieces)
    entries = chain_entries(tables, keys, window, restart=False).withColumnRenamed("_piece", BLOCK)
    walked = T.StructType([*key_schema.fields, T.StructField("start_pos", T.LongType()), T.StructField("break_pos", T.LongType()), T.StructField("stable", T.BooleanType())])
    found = blocked.join(entries, [*keys, BLOCK]).groupBy(*group).applyInArrow(walk, walked)
    numbered = number_windows(found, keys, "window_no")
    return numbered if max_windows is None else numbered.filter(F.col("window_no") < max_windows)
