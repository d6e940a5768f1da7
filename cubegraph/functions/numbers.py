"""Numeric expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_TEXT = "—"


def fixed2(x: Column) -> Column:
    """Two-decimal text of a double's exact value, zero for null; exact halves go to the even digit.

    The product by 100 is rounded, so its error is computed too (the double is split into two halves
    whose products are exact). Where the product lies on a half, the error's sign decides.
    """
    value = F.coalesce(x.cast("double"), F.lit(0.0))
    size = F.abs(value)
    scaled = F.lit(134217729.0) * size
    high = scaled - (scaled - size)
    product = size * 100.0
    error = (high * 100.0 - product) + (size - high) * 100.0
    whole = F.floor(product)
    beyond = (product - whole) - F.lit(0.5)
    up = (beyond > 0) | ((beyond == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    cents = whole + F.when(up, 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    text = F.concat(sign, F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    # Above 2**45 a double's spacing is 1/128 or more, so no value lies near a half of a cent but on it.
    return F.when(size < float(1 << 45), text).otherwise(value.cast("decimal(38,2)").cast("string"))


def whole_thousandths(x: Column) -> Column:
    """Thousandths of a double below a billion in size, halves away from zero: ``1000 * round(x, 3)`` as a whole number.

    Rounding reads a double's shortest text, which is slow. Where the product by 1000 is not near a half, its nearest whole
    number is the same answer; the others are rounded by their text.
    """
    size = F.abs(x) * 1000.0
    whole = F.floor(size + 0.5)
    clear = (F.abs(size - F.floor(size) - 0.5) > 1e-3) & (size < 1e9)
    by_text = F.round(F.round(x, 3) * 1000.0, 0).cast("long")
    return F.when(clear, F.when(x < 0, -whole).otherwise(whole)).otherwise(by_text)


def thousandths(x: Column) -> Column:
    """A double below a billion in size as decimal(12,3), as ``round(x, 3)`` gives it."""
    return of_thousandths(whole_thousandths(x))


def of_thousandths(whole: Column) -> Column:
    """A number of thousandths as decimal(12,3)."""
    return (whole.cast("decimal(12,0)") * F.lit(Decimal("0.001"))).cast("decimal(12,3)")


def pct(part: Column, whole: Column, on_zero: float | None = None) -> Column:
    """100·part/whole; ``on_zero`` replaces the result where ``whole`` is zero."""
    share = F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    if on_zero is None:
        return share
    return F.when(whole == 0, F.lit(float(on_zero))).otherwise(share)


def choropleth_class(t: Column) -> Column:
    """Shade 1..5 of a scaled value; 0 where there is no value."""
    shade = F.when(t.isNull() | F.isnan(t), 0)
    for number, upper in enumerate((0.2, 0.4, 0.6, 0.8), start=1):
        shade = shade.when(t < upper, number)
    return shade.otherwise(5).cast("int")


def try_number(text: Column) -> Column:
    """Number read from text, null where it is none."""
    return text.try_cast("double")


def number_text(x: Column, digits: int = 2) -> Column:
    """Grouped number text with at most ``digits`` decimals; a dash for null."""
    pattern = "#,##0" + ("." + "#" * digits if digits else "")
    return F.coalesce(
        F.call_function("format_number", F.round(x.cast("double"), digits), F.lit(pattern)),
        F.lit(MISSING_TEXT),
    )


# Ordinal ranks of the development levels.
LEVEL_RANKS = {"POPULAR": 1, "BAJO": 2, "MEDIO": 3, "ALTO": 4}


def ordinal_rank(level: Column, ranks: dict[str, int] | None = None) -> Column:
    """Rank of a level in its ordered scheme, null for an unknown level."""
    pairs = [F.lit(v) for item in (ranks or LEVEL_RANKS).items() for v in item]
    return F.try_element_at(F.create_map(*pairs), level)
