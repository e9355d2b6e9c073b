"""Disturbance labels built from boolean flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timing import _column

NORMAL = "Normal"

# Flag names in the two published label orders.
LABEL_ORDER = {
    "Excursion": "has_excursion_event",
    "Slow drift": "has_slow_drift",
    "Transient bump": "has_transient_bump",
    "High variability": "has_high_variability",
}
LABEL_ORDER_ALT = {
    "Excursion": "has_excursion_event",
    "High variability": "has_high_variability",
    "Transient bump": "has_transient_bump",
    "Slow drift": "has_slow_drift",
}
FLAGS = tuple(LABEL_ORDER.values())

# Display order of the labels.
DISPLAY_ORDER = (
    "Normal",
    "High variability",
    "Transient bump",
    "Slow drift",
    "Excursion",
    "Excursion + Transient bump + High variability",
)


def disturbance_label(order: Mapping[str, str] = LABEL_ORDER) -> Column:
    """Names of the raised flags joined by `` + ``, or ``Normal``."""
    joined = F.concat_ws(" + ", *[F.when(_column(flag), name) for name, flag in order.items()])
    return F.when(joined == "", NORMAL).otherwise(joined)


def any_flag(flags=FLAGS) -> Column:
    return F.greatest(*[F.coalesce(_column(f), F.lit(False)) for f in flags])


def display_rank(label: str | Column, order=DISPLAY_ORDER) -> Column:
    """1-based place in the display order; labels outside it come after."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), _column(label))
    return F.when(place > 0, place).otherwise(len(order) + 1).cast("bigint")
