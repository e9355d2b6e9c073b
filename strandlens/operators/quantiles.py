"""Exact order statistics of groups of any size.

A plain exact percentile keeps all distinct values of a group in one buffer.
Here the wanted ranks are narrowed down by counting: first in logarithmic bins
of the value, then in equal parts of the bins that hold a wanted rank. Only the
values of those parts are sorted, after equal values have been counted together.
Bin counts aggregate map-side, so a group that holds most of the rows still
sends each task's few bins only.

The input is read twice, whatever is asked for: once for the bins (``value_cells``, which also count by scope and carry further
aggregates), once for the rows of the bins that hold a wanted rank; these few are staged and narrowed down from there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import known
from ..functions.timing import _column
from ..sources.sinks import stage
from .ordered import number_rows

BINS_PER_E = 256
PARTS = 4096
SORTED = 1_000_000  # staged rows that are sorted as they are; more are narrowed down further
TOTAL = "_total"


def _log_bin(x: Column) -> Column:
    """Bin number that never decreases in x; each covers about 0.4 %. Null has none."""
    size = F.least(F.abs(x), F.lit(1.7e308))
    magnitude = F.floor(F.ln(size) * BINS_PER_E).cast("int") + 200_000
    return F.when(x == 0, 0).when(x > 0, magnitude).when(x < 0, -magnitude)


def _part(x: Column, low: Column, high: Column) -> Column:
    spread = high - low
    splits = (spread > 0) & (spread < F.lit(float("inf")))
    return F.when(splits, F.floor((x - low) / spread * PARTS).cast("int")).otherwise(0)


Scopes = Mapping[str, Column]


def _same(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [_column(c).eqNullSafe(_column(f"_c_{c}")) for c in columns])


def _beside(rows: DataFrame, cells: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of the cell that holds them; ``on`` may hold nulls."""
    renamed = cells.withColumnsRenamed({c: f"_c_{c}" for c in on})
    return rows.join(renamed, _same(on), how).drop(*[f"_c_{c}" for c in on])


def _hits(counted: DataFrame, group: Sequence[str], along: str | Sequence[str], count: int) -> DataFrame:
    """Of counted cells, those that hold a wanted rank of any scope. Per scope i: _n{i} counts rows, _before{i} is the rank of the
    group's first row, then of the cell's first, and _ranks{i} are the wanted ranks, then those in the cell."""
    order = Window.partitionBy(*[_column(g) for g in group]).orderBy(*([along] if isinstance(along, str) else along))
    upto = {f"_before{i}": F.col(f"_before{i}") + F.sum(f"_n{i}").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"_n{i}") for i in range(count)}

    def here(i: int) -> Column:
        first = F.col(f"_before{i}")
        return F.filter(f"_ranks{i}", lambda r: (r >= first) & (r < first + F.col(f"_n{i}")))

    inside = {f"_ranks{i}": here(i) for i in range(count)}
    some = reduce(lambda a, b: a | b, [F.size(f"_ranks{i}") > 0 for i in range(count)])
    return counted.withColumns(upto).withColumns(inside).filter(some)


def value_cells(
    df: DataFrame, keys: Sequence[str], value: str, scopes: Scopes | None = None, more: Mapping[str, Column] | None = None
) -> DataFrame:
    """Counts of each group's values in logarithmic bins, staged: the keys, _bin (null: null and NaN values), _low, _high, _n{i} per
    scope (rows where its condition holds), and the aggregates ``more``."""
    x = known(value).cast("double")
    held = list(scopes.values()) if scopes else [F.lit(True)]
    aggs = [F.count_if(F.coalesce(s, F.lit(False))).alias(f"_n{i}") for i, s in enumerate(held)]
    aggs += [a.alias(name) for name, a in (more or {}).items()]
    cells = df.groupBy(*[_column(k) for k in keys], _log_bin(x).alias("_bin")).agg(F.min(x).alias("_low"), F.max(x).alias("_high"), *aggs)
    return stage(cells, "value-cells")


def _wanted(cells: DataFrame, keys: Sequence[str], ranks: Callable[[Column], Column], count: int) -> DataFrame:
    """The bins that hold a wanted rank, with totals per scope."""
    whole = Window.partitionBy(*[_column(k) for k in keys])
    valued = cells.filter("_bin is not null")
    valued = valued.withColumns({f"{TOTAL}{i}": F.sum(f"_n{i}").over(whole) for i in range(count)})
    valued = valued.withColumns({f"_before{i}": F.lit(0).cast("bigint") for i in range(count)})
    none = F.expr("cast(array() as array<bigint>)")
    valued = valued.withColumns({f"_ranks{i}": F.when(F.col(f"{TOTAL}{i}") > 0, ranks(F.col(f"{TOTAL}{i}"))).otherwise(none) for i in range(count)})
    names = [f"{c}{i}" for c in ("_before", "_ranks", TOTAL) for i in range(count)]
    return _hits(valued, keys, "_bin", count).select(*[_column(k) for k in keys], "_bin", "_low", "_high", *names)


def _refined(rows: DataFrame, cells: DataFrame, by: Sequence[str], name: str, cell: Column, within: str, count: int) -> DataFrame:
    """Smaller cells, ``name``, inside ``cells`` that hold a wanted rank. ``rows``: _n{i} per scope; ``cell`` may use the outer
    cell's _low and _high, and the inner ones' are those of ``within``."""
    placed = _beside(rows, cells.select(*[_column(c) for c in by], "_low", "_high"), by).withColumn(name, cell)
    counted = placed.groupBy(*[_column(c) for c in by], name).agg(
        *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(count)], F.min(within).alias("_from"), F.max(within).alias("_to")
    )
    inner = _beside(counted, cells.drop("_low", "_high"), by).withColumnsRenamed({"_from": "_low", "_to": "_high"})
    return _hits(inner, by, name, count).drop(*[f"_n{i}" for i in range(count)])


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Callable[[Column], Column],
    scopes: Scopes | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Values at the wanted 0-based ranks of every group, in every scope.

    ``ranks`` makes an array of bigint from the number of values of a group in a scope; ``scopes`` are conditions on rows (one that holds
    everywhere where not given); ``cells`` is what ``value_cells`` gave for the same arguments. Null and NaN values are left
    out. Returns the keys, ``scope``, ``rank``, ``value`` and ``_total``."""
    names = list(scopes) if scopes else [""]
    count = len(names)
    cells = value_cells(df, keys, value, scopes) if cells is None else cells
    bins = stage(_wanted(cells, keys, ranks, count), "value-bins")
    key_cols = [_column(k) for k in keys]
    x = known(value).cast("double")
    flags = {f"_s{i}": F.coalesce(s, F.lit(False)) for i, s in enumerate(scopes.values())} if scopes else {"_s0": F.lit(True)}
    slim = df.withColumns({"_value": x, "_bin": _log_bin(x), **flags}).select(*key_cols, "_value", "_bin", *flags)
    values = _beside(slim, bins.select(*key_cols, "_bin"), [*keys, "_bin"], "left_semi").groupBy(*key_cols, "_bin", "_value").agg(
        *[F.count_if(f"_s{i}").alias(f"_n{i}") for i in range(count)]
    )
    values = stage(values, "values")
    if values.count() <= SORTED:
        by = [*keys, "_bin"]
        return _listed(_hits(_beside(values, bins.drop("_low", "_high"), by), by, "_value", count), keys, names)
    part = _part(F.col("_value"), F.col("_low"), F.col("_high"))
    parts = _refined(values, bins, [*keys, "_bin"], "_part", part, "_value", count)
    inside = _beside(values, bins.select(*key_cols, "_bin", "_low", "_high"), [*keys, "_bin"]).withColumn("_part", part).drop("_low", "_high")
    by = [*keys, "_bin", "_part"]
    return _listed(_hits(_beside(inside, parts.drop("_low", "_high"), by), by, "_value", count), keys, names)


def _listed(found: DataFrame, keys: Sequence[str], scopes: Sequence[str]) -> DataFrame:
    """A row per wanted rank and scope, from the values that hold them."""

    def ranked(i: int, name: str) -> Column:
        return F.transform(f"_ranks{i}", lambda r: F.struct(F.lit(name).alias("scope"), r.alias("rank"), F.col(f"{TOTAL}{i}").alias(TOTAL)))

    listed = F.flatten(F.array(*[ranked(i, name) for i, name in enumerate(scopes)]))
    key_cols = [_column(k) for k in keys]
    return found.select(*key_cols, F.col("_value").alias("value"), F.explode(listed).alias("_r")).select(*key_cols, "_r.*", "value")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], scopes: Scopes | None = None, cells: DataFrame | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation: the keys and one column per
    entry of ``probs``, or per entry and scope (name_scope), from the same two reads. Groups without a value are absent."""
    key_cols = [_column(k) for k in keys]

    def wanted(total: Column) -> Column:
        places = [(total - 1) * F.lit(float(p)) for p in probs.values()]
        return F.array_distinct(F.array(*[edge(place).cast("bigint") for place in places for edge in (F.floor, F.ceil)]))

    found = order_statistics(df, keys, value, wanted, scopes, cells)
    grouped = found.groupBy(*key_cols, "scope", TOTAL).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")
    )

    def pick(p: float) -> Column:
        place = (F.col(TOTAL) - 1) * F.lit(float(p))
        low = F.element_at("_at", F.floor(place).cast("bigint"))
        high = F.element_at("_at", F.ceil(place).cast("bigint"))
        return low + (high - low) * (place - F.floor(place))

    if not scopes:
        return grouped.select(*key_cols, *[pick(p).alias(n) for n, p in probs.items()])
    picked = grouped.select(*key_cols, "scope", *[pick(p).alias(n) for n, p in probs.items()])
    return picked.groupBy(*key_cols).agg(
        *[F.max(F.when(F.col("scope") == s, F.col(n))).alias(f"{n}_{s}") for s in scopes for n in probs]
    )


def spread_ranks(n: int, total: Column) -> Column:
    """Ranks of ``n`` rows spread evenly from the first to the last of a group;
    all ranks where the group has no more than ``n``."""
    last = total - 1
    few = F.sequence(F.lit(0).cast("bigint"), last)
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * last / (n - 1)).cast("bigint")
    )
    return F.when(total <= n, few).otherwise(F.array_distinct(spread))


def representatives(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, n: int
) -> DataFrame:
    """Rows spread evenly over the range of ``value`` in each group, with their
    1-based ``rank``; all rows where ``n`` is below two. ``tie`` is a number,
    unique in a group, that orders rows of equal value. Null and NaN values are left out.

    Rows are selected by the pair (value, tie) at once: the whole rows of the bins that hold a wanted rank are staged, and narrowed
    down by parts of the value, single values, parts of the tie, and the tie."""
    valued = df.filter(known(value).isNotNull())
    if n <= 1:
        ranked = number_rows(valued, keys, [_column(value).asc(), _column(tie).asc()], "rank")
        return ranked.withColumn("rank", F.col("rank") + 1)
    key_cols = [_column(k) for k in keys]
    cells = value_cells(valued, keys, value)
    bins = stage(_wanted(cells, keys, lambda total: spread_ranks(n, total), 1), "representative-bins")
    x = _column(value).cast("double")
    rows = valued.withColumns({"_value": x, "_bin": _log_bin(x), "_tie": _column(tie).cast("double"), "_n0": F.lit(1).cast("bigint")})
    by = [*keys, "_bin"]
    rows = _beside(rows, bins.select(*key_cols, "_bin", "_low", "_high"), by)
    rows = rows.withColumn("_part", _part(F.col("_value"), F.col("_low"), F.col("_high"))).drop("_low", "_high")
    rows = stage(rows, "representative-rows")
    if rows.count() <= SORTED:
        chosen = _hits(_beside(rows, bins.drop("_low", "_high"), by), by, ["_value", "_tie"], 1)
    else:
        parts = _refined(rows, bins, by, "_part", F.col("_part"), "_value", 1)
        by = [*by, "_part"]
        values = _refined(rows, parts, by, "_value", F.col("_value"), "_tie", 1)
        values = stage(values, "representative-values")
        by = [*by, "_value"]
        tied = _part(F.col("_tie"), F.col("_low"), F.col("_high"))
        ties = _refined(rows, values, by, "_tied", tied, "_tie", 1)
        near = _beside(rows, values.select(*[_column(c) for c in by], "_low", "_high"), by).withColumn("_tied", tied).drop("_low", "_high")
        by = [*by, "_tied"]
        near = _beside(near, ties.drop("_low", "_high"), by)
        chosen = _hits(near, by, "_tie", 1)
    order = Window.partitionBy(*key_cols).orderBy("_value", "_tie")
    picked = chosen.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return picked.select(*[_column(c) for c in df.columns], "rank")
