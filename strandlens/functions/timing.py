"""Timestamps: parsing, zone handling, durations and time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_TYPES = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)
_TIME_TYPES = (T.TimestampType, T.TimestampNTZType)


def _column(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    return F.unix_micros(_column(ts).cast("timestamp"))


def whole_seconds(ts: str | Column) -> Column:
    return F.unix_timestamp(_column(ts).cast("timestamp"))


def hours_between(start: str | Column, end: str | Column) -> Column:
    return (whole_seconds(end) - whole_seconds(start)) / 3600


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Fractional minutes, keeping the sub-second part."""
    return (micros(end) - micros(start)) / 6e7


def bucket(ts: str | Column, seconds: float) -> Column:
    """Number of the time bucket that holds ``ts``; monotone in ``ts``."""
    return F.floor(micros(ts) / F.lit(int(seconds * 1_000_000))).cast("bigint")


def from_epoch(c: str | Column) -> Column:
    """Epoch seconds or milliseconds (above 1e12) to a whole-second instant."""
    value = _column(c)
    return F.timestamp_seconds(
        F.when(value > F.lit(1e12), value / 1000).otherwise(value).cast("bigint")
    )


def with_plain_timestamp(df: DataFrame, name: str = "plainTimeStamp") -> DataFrame:
    """Add one timestamp column from whichever time column the log carries.

    ``plainTimeStamp`` wins over ``dt_timestamp_utc``, which wins over
    ``TIMESTAMP``. A frame without a usable candidate comes back unchanged; a
    string ``TIMESTAMP`` is not a usable candidate. A time column of this name in
    another spelling is taken under this one.
    """
    spelled = {c.lower(): c for c in df.columns}.get(name.lower(), name)
    df = df.withColumnRenamed(spelled, name)
    types = {f.name: f.dataType for f in df.schema.fields}
    if name in types:
        if isinstance(types[name], T.StringType):
            return df.withColumn(name, F.try_to_timestamp(_column(name)))
        return df
    for candidate, parse_strings in (("dt_timestamp_utc", True), ("TIMESTAMP", False)):
        kind = types.get(candidate)
        if isinstance(kind, T.StringType) and parse_strings:
            return df.withColumn(name, F.try_to_timestamp(_column(candidate)))
        if isinstance(kind, _TIME_TYPES):
            return df.withColumn(name, _column(candidate))
        if isinstance(kind, _EPOCH_TYPES):
            return df.withColumn(name, from_epoch(candidate))
    return df


def strip_offset(text: str | Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Read a timestamp string as local time, ignoring a trailing ``+hh:mm``."""
    bare = F.regexp_replace(_column(text), r"\+\d{2}:\d{2}$", "")
    return F.try_to_timestamp(bare, F.lit(fmt)).cast("timestamp_ntz")


def utc_to_local(ts: str | Column, zone: str = "Europe/Amsterdam") -> Column:
    """UTC wall-clock time to the wall-clock time of ``zone`` (DST-aware)."""
    return F.convert_timezone(
        F.lit("UTC"), F.lit(zone), _column(ts).cast("timestamp_ntz")
    )
