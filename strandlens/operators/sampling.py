"""Top rows, edges and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import _column

_GRAIN = 1_000_000
_RANGE_BITS = 12
_PLACE_BITS = 60


def _place(key: Sequence[str], seed: int) -> Column:
    """A number below 2^60 from the MD5 of seed and key, which any engine can work out again."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[_column(c).cast("string") for c in key]))
    return F.conv(F.substring(digest, 1, _PLACE_BITS // 4), 16, 10).cast("bigint")


def _total(df: DataFrame) -> list[Column]:
    """An order by all columns; those with maps, which have no order, go by their JSON."""
    loose = ("map<", "variant")
    return [F.to_json(F.struct(_column(c))) if any(t in kind for t in loose) else _column(c) for c, kind in df.dtypes]


def top_rows(df: DataFrame, by: str, tiebreak: Sequence[str], k: int) -> DataFrame:
    return df.orderBy(_column(by).desc(), *[_column(t) for t in tiebreak]).limit(k)


def edges(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The first and the last ``k`` rows, marked in ``edge``."""
    cols = [_column(c) for c in order]
    head = df.orderBy(*cols).limit(k).withColumn("edge", F.lit("first"))
    tail = df.orderBy(*[c.desc() for c in cols]).limit(k).withColumn("edge", F.lit("last"))
    return head.unionByName(tail)


def sample_fraction(df: DataFrame, key: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """A share of the rows that depends only on their key and the seed, so a
    lost task picks the same rows again."""
    return df.filter(_place(key, seed) % _GRAIN < int(fraction * _GRAIN))


def sample_about(df: DataFrame, key: Sequence[str], rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows: the share that the row count calls for."""
    share = F.least(F.lit(1.0), rows / df.agg(F.count(F.lit(1))).scalar())
    return df.filter(_place(key, seed) % _GRAIN < share * _GRAIN)


def sample_cap(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` random rows, or all where there are no more; the same rows on every
    run, also where rows share a key: those that the cap parts are taken in the order of all their columns.

    Rows are taken in the order of a hash of their key. Counts of a few thousand hash ranges tell in which one the cap
    falls, counts of its own parts in which of those; ranges and parts before it are taken whole, and only that part is
    sorted, so no more than some ten-millionth of the keys meets in one task.
    """
    hashed = df.withColumn("_hash", _place(key, seed))

    def at_cap(rows: DataFrame, bits: int, before: int) -> tuple[int, int] | None:
        """The range, by the first ``bits`` bits, in which the cap falls, and how many rows come before it. A few thousand counts
        reach the driver."""
        counts = rows.groupBy(F.shiftrightunsigned("_hash", _PLACE_BITS - bits).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
        for r in sorted(counts.collect()):
            if before + r["_n"] >= n:
                return r["_range"], before
            before += r["_n"]
        return None

    place = hashed.select("_hash")
    outer = at_cap(place, _RANGE_BITS, 0)
    if outer is None:
        return df
    near = place.filter(F.shiftrightunsigned("_hash", _PLACE_BITS - _RANGE_BITS) == outer[0])
    cut, before = at_cap(near, 2 * _RANGE_BITS, outer[1])
    room = n - before
    hashed = hashed.withColumn("_range", F.shiftrightunsigned("_hash", _PLACE_BITS - 2 * _RANGE_BITS))
    whole = hashed.filter(F.col("_range") < cut)
    order = Window.partitionBy("_range").orderBy("_hash", *[_column(c) for c in key], *_total(df))
    split = (
        hashed.filter(F.col("_range") == cut)
        .withColumn("_row", F.row_number().over(order))
        .filter(F.col("_row") <= room)
        .drop("_row")
    )
    return whole.unionByName(split).drop("_hash", "_range")


def time_slice(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    return df.filter(_column(ts).between(F.lit(start), F.lit(end)))


def first_span(df: DataFrame, keys: Sequence[str], ts: str, span: str) -> DataFrame:
    """Rows up to ``span`` after the first row of their series."""
    first = df.groupBy(*[_column(k) for k in keys]).agg(F.min(_column(ts)).alias("_t0"))
    return (
        df.join(first, list(keys))
        .filter(_column(ts) <= F.col("_t0") + F.expr(f"interval {span}"))
        .drop("_t0")
    )
