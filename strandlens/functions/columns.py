"""Row-wise operations: units, filters, coercion, names and bins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timing import _column

# Unit factors of the raw sensor columns.
UNIT_FACTORS = {
    "castingSpeed": 60,
    "Mold Level": 1000,
    "Mold Level Sensor Left": 1000,
    "Mold Level Sensor Right": 1000,
    "Argon Flow SEN": 60000,
    "Argon Flow Stopper": 60000,
}

# Mold width bins in metres and grade families.
WIDTH_EDGES = (0.0, 1.2, 1.5, 1.8, 2.0)
WIDTH_LABELS = ("<=1.2 m", "1.2-1.5 m", "1.5-1.8 m", "1.8-2.0 m", ">2.0 m")
FAMILIES = ("1", "2", "3", "5", "N")
FAMILY_NAMES = {
    "1": "Family 1 (Low-C)",
    "2": "Family 2",
    "3": "Family 3 (Peritectic)",
    "5": "Family 5 (HSLA)",
    "N": "Family N (Unclassified)",
}


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The wanted names that the frame has, each once, in the wanted order."""
    have = set(df.columns)
    return [c for c in dict.fromkeys(names) if c in have]


def project_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[_column(c) for c in present(df, wanted)])


def convert_units(df: DataFrame, factors: Mapping[str, float] = UNIT_FACTORS) -> DataFrame:
    return df.withColumns(
        {c: _column(c) * factors[c] for c in present(df, factors)}
    )


def process_filter(
    df: DataFrame, speed: str, depth: str, min_speed: float, depth_min: float, depth_max: float
) -> DataFrame:
    return df.filter(
        (_column(speed) >= min_speed) & _column(depth).between(depth_min, depth_max)
    )


def active_filter(df: DataFrame, currents: Sequence[str]) -> DataFrame:
    """Rows in which no current is zero; a missing current does not count as zero."""
    checks = [F.coalesce(_column(c) != 0, F.lit(True)) for c in present(df, currents)]
    return df.filter(reduce(lambda a, b: a & b, checks)) if checks else df


def finite(*cols: str | Column) -> Column:
    """True where every column is a number that is neither NaN nor infinite."""
    return reduce(
        lambda a, b: a & b,
        [F.abs(_column(c)) < F.lit(float("inf")) for c in cols],
    )


def null_status(quality: str | Column) -> Column:
    return F.when(_column(quality).isNull(), "No Casting (NULL)").otherwise("Active Casting")


# What becomes of characters that a catalog table forbids in names.
NAME_CHARACTERS = str.maketrans({" ": "_", "/": "_", "[": None, "]": None})


def clean_names(df: DataFrame) -> DataFrame:
    """Column names that a catalog table accepts."""
    return df.withColumnsRenamed({c: c.translate(NAME_CHARACTERS) for c in df.columns})


def known(c: str | Column) -> Column:
    """The value as a double; NaN is missing, as null is."""
    return F.nanvl(_column(c).cast("double"), F.lit(None).cast("double"))


def to_number(c: str | Column) -> Column:
    return _column(c).try_cast("double")


def to_time(c: str | Column) -> Column:
    return _column(c).try_cast("timestamp_ntz")


def width_bin(width: str | Column) -> Column:
    """Label of the half-open width bin; anything outside goes to the last one."""
    w = _column(width)
    bins = zip(WIDTH_EDGES, WIDTH_EDGES[1:], WIDTH_LABELS)
    expr = F
    for low, high, label in bins:
        expr = expr.when((w >= low) & (w < high), label)
    return expr.otherwise(WIDTH_LABELS[-1])


def grade_family(grade: str | Column) -> Column:
    first = F.substring(F.trim(_column(grade).cast("string")), 1, 1)
    return F.when(first.isin(*FAMILIES[:-1]), first).otherwise(FAMILIES[-1])


def family_name(family: str | Column) -> Column:
    names = F.create_map(*[F.lit(x) for x in chain(*FAMILY_NAMES.items())])
    return F.element_at(names, _column(family))


def round_even(c: str | Column, digits: int = 0) -> Column:
    """Half-even rounding on the binary value."""
    scale = F.lit(float(10**digits))
    return F.rint(_column(c) * scale) / scale


def round_to_step(c: str | Column, step: float) -> Column:
    return F.rint(_column(c) / F.lit(float(step))) * F.lit(float(step))


def row_mean(*cols: str | Column) -> Column:
    """Mean of the non-null inputs; null when there is none."""
    held = F.array_compact(F.array(*[_column(c).cast("double") for c in cols]))
    total = F.aggregate(held, F.lit(0.0), lambda sum_, x: sum_ + x)
    return F.try_divide(total, F.size(held))


def row_total(*cols: str | Column) -> Column:
    """Sum that counts a null input as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(_column(c), F.lit(0.0)) for c in cols])


def row_range(*cols: str | Column) -> Column:
    """Largest minus smallest non-null input; a single input has range zero."""
    exprs = [_column(c) for c in cols]
    if len(exprs) == 1:
        return exprs[0] - exprs[0]
    return F.greatest(*exprs) - F.least(*exprs)
