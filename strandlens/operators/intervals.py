"""Joins on closed time intervals, planned as equi-joins on time buckets.

A join on range predicates alone becomes a nested loop. Here an interval is
listed once per time bucket it touches and a point has exactly one bucket, so
the join is a hash or sort-merge join on (keys, bucket), adds no duplicates, and
splits a busy series over its buckets.

Spark's size estimate does not see that the listing multiplies the intervals.
So the listing is staged: its real size is known when the join is planned, it is
broadcast only below Spark's threshold and sort-merged beyond it, and intervals
that come from a long computation are worked out once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import _column, bucket, hours_between, micros
from ..sources.sinks import stage
from .ordered import finish, scan

_BUCKET = "_bucket"
_LEVEL = "_level"
LEVELS = 6
LEVEL_RATIO = 64


def _width(bucket_seconds: float, level: int) -> float:
    """Seconds of a bucket; at most what covers all times that Spark has, in one number of microseconds."""
    return min(bucket_seconds * LEVEL_RATIO**level, 2.0**62 / 1e6)


def by_bucket(intervals: DataFrame, start: str, end: str, bucket_seconds: float) -> DataFrame:
    """Every interval once per time bucket it touches, staged.

    Buckets have levels, each ``LEVEL_RATIO`` times as wide as the one below. An interval is listed at the lowest level
    at which it touches about LEVEL_RATIO buckets at most, so one that lasts for ages is listed as briefly as any other."""
    valid = intervals.filter(_column(start) <= _column(end))
    lasts = (micros(end) - micros(start)) / 1e6 / bucket_seconds
    level = F.lit(LEVELS - 1)
    for n in reversed(range(LEVELS - 1)):
        level = F.when(lasts <= float(LEVEL_RATIO ** (n + 1)), n).otherwise(level)
    width = F.element_at(F.array(*[F.lit(int(_width(bucket_seconds, n) * 1e6)) for n in range(LEVELS)]), level + 1)
    touched = F.sequence(F.floor(micros(start) / width).cast("bigint"), F.floor(micros(end) / width).cast("bigint"))
    return stage(valid.withColumn(_LEVEL, level).withColumn(_BUCKET, F.explode(touched)), "intervals")


def levels_of(listed: DataFrame) -> list[int]:
    """The levels in use, LEVELS at most."""
    return sorted(r[0] for r in listed.select(_LEVEL).distinct().collect())


def join_points(
    points: DataFrame,
    intervals: DataFrame,
    ts: str,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    bucket_seconds: float = 3_600,
    how: str = "left",
    extra: Column | None = None,
) -> DataFrame:
    """Match points with the intervals that hold them, both ends included.

    Overlapping intervals repeat the point. ``extra`` is a further condition
    over the columns of both sides. Column names of the two sides must differ
    but for ``keys``. ``how``: left, inner or left_semi. A point carries the bucket that holds it at each level in
    use, so all levels are one join and points are read once; points without time match nothing and stay out of it.
    A left or semi join over several levels tells afterwards, by the points' own columns, which have no match at any.
    """
    listed = by_bucket(intervals, start, end, bucket_seconds)
    levels = levels_of(listed) or [0]
    at = _column(ts)
    several = len(levels) > 1
    if several:
        probes = [F.struct(F.lit(n).alias(_LEVEL), bucket(ts, _width(bucket_seconds, n)).alias(_BUCKET)) for n in levels]
        probes = F.when(at.isNotNull(), F.array(*probes)).otherwise(F.array(F.struct(F.lit(levels[0]).alias(_LEVEL), F.lit(None).cast("bigint").alias(_BUCKET))))
        left = points.withColumn("_probe", F.explode(probes)).select(*[_column(c) for c in points.columns], "_probe.*")
    else:
        left = points.withColumns({_LEVEL: F.lit(levels[0]), _BUCKET: bucket(ts, _width(bucket_seconds, levels[0]))})
    if how != "left":
        left = left.filter(at.isNotNull())
    joint = [*keys, _LEVEL, _BUCKET]
    right = listed.withColumnsRenamed({c: f"_iv_{c}" for c in joint})
    match = at.between(_column(start), _column(end))
    for c in joint:
        match = match & (_column(c) == _column(f"_iv_{c}"))
    if extra is not None:
        match = match & extra
    out = left.join(right, match, how)
    gone = [_LEVEL, _BUCKET, *[f"_iv_{c}" for c in joint]]
    if how == "inner" or not several:
        return out.drop(*gone)
    # Equal points fare alike, so a group of them keeps all its rows of one level, or all its matches.
    same = Window.partitionBy(*[_column(k) for k in keys], at, F.xxhash64(*[_column(c) for c in points.columns]))
    if how == "left_semi":
        found = out.withColumn("_least", F.min(_LEVEL).over(same)).filter(F.col(_LEVEL) == F.col("_least"))
        return found.drop(*gone, "_least")
    hit = F.col(f"_iv_{_BUCKET}").isNotNull()
    found = out.withColumns({"_hits": F.count_if(hit).over(same), "_least": F.min(_LEVEL).over(same)})
    found = found.filter(hit | ((F.col("_hits") == 0) & (F.col(_LEVEL) == F.col("_least"))))
    return found.drop(*gone, "_hits", "_least")


def attach(
    points: DataFrame,
    intervals: DataFrame,
    ts: str,
    start: str,
    end: str,
    labels: Sequence[str],
    keys: Sequence[str] = (),
    bucket_seconds: float = 3_600,
) -> DataFrame:
    """Left join that brings only the interval's ``labels`` to the points."""
    needed = intervals.select(*[_column(c) for c in dict.fromkeys([*keys, start, end, *labels])])
    renames = {c: f"_bound_{c}" for c in (start, end) if c not in labels}
    needed = needed.withColumnsRenamed(renames)
    s, e = renames.get(start, start), renames.get(end, end)
    out = join_points(points, needed, ts, s, e, keys, bucket_seconds)
    return out.drop(*renames.values())


def overlaps_any(
    spans: DataFrame,
    intervals: DataFrame,
    span: tuple[str, str],
    bounds: tuple[str, str],
    identity: Sequence[str],
    bucket_seconds: float = 3_600,
) -> DataFrame:
    """Spans that share an instant with any interval; ``identity`` names a span.

    A span meets an interval iff more intervals start by its end than end before its start. Both are running counts over
    one timeline of starts, ends, and the spans' own two ends, taken in time chunks: no interval is listed more than
    once, however long it is, and no pair is formed."""
    lasting = intervals.filter(_column(bounds[0]) <= _column(bounds[1]))
    asked = spans.filter(_column(span[0]) <= _column(span[1]))
    first, opens, closes, last = range(4)  # order at one instant: an end at a span's start is not before it

    def marks(rows: DataFrame, at: tuple[str, str], kinds: tuple[int, int], keep: list[str]) -> DataFrame:
        both = F.array(*[F.struct(_column(c).alias("_at"), F.lit(k).alias("_kind")) for c, k in zip(at, kinds)])
        columns = [_column(c) for c in keep]
        return rows.select(*columns, F.explode(both).alias("_m")).select(*columns, "_m.*")

    line = marks(asked, span, (first, last), spans.columns).unionByName(
        marks(lasting, bounds, (opens, closes), []), allowMissingColumns=True
    )
    kind = F.col("_kind")
    counts = {"_opened": kind == opens, "_closed": kind == closes}
    counted = scan(line, [], ["_at", "_kind"], bucket("_at", bucket_seconds), counts=counts)
    named = list(dict.fromkeys([*identity, *span]))
    others = [c for c in spans.columns if c not in named]
    opened, closed = F.max(F.when(kind == last, F.col("_opened"))), F.max(F.when(kind == first, F.col("_closed")))
    held = counted.filter(kind.isin(first, last)).groupBy(*[_column(c) for c in named]).agg(
        (opened > closed).alias("_meets"), *[F.any_value(_column(c)).alias(c) for c in others]
    )
    return held.filter("_meets").select(*[_column(c) for c in spans.columns])


def classify_gaps(
    gaps: DataFrame,
    castings: DataFrame,
    gap_start: str,
    gap_end: str,
    start: str,
    end: str,
    casting_id: str,
    bucket_seconds: float = 3_600,
) -> DataFrame:
    """Left join to the casting that holds both ends of the gap."""
    inside = _column(gap_end).between(_column(start), _column(end))
    joined = join_points(
        gaps, castings, gap_start, start, end, (), bucket_seconds, "left", inside
    )
    return joined.withColumn(
        "gap_type",
        F.when(_column(casting_id).isNotNull(), "Within Casting").otherwise("Between Castings"),
    )


def interval_gaps(
    intervals: DataFrame,
    start: str,
    end: str,
    tiebreak: Sequence[str],
    keys: Sequence[str] = (),
    chunk_seconds: float = 30 * 86_400,
) -> DataFrame:
    """Pauses between one interval's end and the next one's start."""
    known = intervals.filter(_column(start).isNotNull() & _column(end).isNotNull())
    order = [start, *tiebreak]
    lagged = finish(
        scan(known, keys, order, bucket(start, chunk_seconds), lag={"prev_end": _column(end)})
    )
    return lagged.withColumn("gap_hours", hours_between("prev_end", start)).filter(
        F.col("gap_hours") > 0
    )


def coverage(
    points: DataFrame,
    castings: DataFrame,
    ts: str,
    start: str,
    end: str,
    identity: Sequence[str],
    keys: Sequence[str] = (),
    bucket_seconds: float = 3_600,
) -> DataFrame:
    """Points per casting and how well they cover it; empty castings stay.

    Points are counted per casting before castings are joined back, so only the
    matched points are shuffled and each task sends one row per casting.
    """
    bounds = castings.select(
        *[_column(c) for c in dict.fromkeys([*keys, *identity])],
        _column(start).alias("_from"),
        _column(end).alias("_until"),
    )
    slim = points.select(*[_column(k) for k in keys], _column(ts).alias("_at"))
    hits = (
        join_points(slim, bounds, "_at", "_from", "_until", keys, bucket_seconds, "inner")
        .groupBy(*[_column(c) for c in identity])
        .agg(
            F.count(F.lit(1)).alias("data_point_count"),
            F.min("_at").alias("first_data"),
            F.max("_at").alias("last_data"),
        )
    )
    joined = castings.join(hits, list(identity), "left")
    status = (
        F.when(F.col("data_point_count") == 0, "NO DATA")
        .when(F.col("first_data") > _column(start), "LATE START")
        .when(F.col("last_data") < _column(end), "EARLY END")
        .otherwise("FULL COVERAGE")
    )
    counted = F.coalesce(F.col("data_point_count"), F.lit(0)).cast("bigint")
    return joined.withColumn("data_point_count", counted).withColumn("coverage_status", status)


def coverage_mismatch(covered: DataFrame, start: str, end: str) -> DataFrame:
    """Castings without full coverage, with expected hours, delay and early end."""
    return covered.filter(F.col("coverage_status") != "FULL COVERAGE").withColumns(
        {
            "expected_duration_hours": hours_between(start, end),
            "data_start_delay_hours": hours_between(start, "first_data"),
            "data_end_early_hours": hours_between("last_data", end),
        }
    )

