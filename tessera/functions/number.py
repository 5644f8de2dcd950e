"""Numbers as the map format writes them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def qt_number(value: float, significant: int = 6) -> str:
    """The shortest of plain and scientific form with so many significant digits; exact ties go away from zero."""
    if math.isnan(value):
        return "nan"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    if value == 0:
        return "0"
    n = max(1, significant)
    rounded = Context(prec=n, rounding=ROUND_HALF_UP).create_decimal(Decimal(value))
    exponent = rounded.adjusted()
    digits = "".join(map(str, rounded.as_tuple().digits)).rstrip("0") or "0"
    sign = "-" if value < 0 else ""
    if not -4 <= exponent < n:
        fraction = f".{digits[1:]}" if digits[1:] else ""
        return f"{sign}{digits[0]}{fraction}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    whole = digits[: exponent + 1].ljust(exponent + 1, "0")
    rest = digits[exponent + 1 :]
    return f"{sign}{whole}.{rest}" if rest else sign + whole


def qt_number_column(value: Column, significant: int = 6) -> Column:
    @F.pandas_udf("string")
    def shown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: qt_number(v, significant), na_action="ignore")

    return shown(value)


def native(mm: float) -> int:
    """Thousandths of a millimetre, halves upward."""
    return math.floor(mm * 1000 + 0.5)
