"""Numbers as short text for charts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: display ----------------------------------------------------------------
CURRENCY_SIGNS = ("$", "€", "£", "¥")
MISSING_TEXT = "—"


def affixes(format_type: str | None = None, unit: str | None = None) -> tuple[str, str, bool]:
    """Text before the number, text after it, and whether it is a percentage."""
    kind, unit = (format_type or "").lower().strip(), (unit or "").strip()
    if kind == "currency" or unit in CURRENCY_SIGNS:
        return (unit if unit in CURRENCY_SIGNS else "$"), "", False
    if kind == "percentage" or unit == "%":
        return "", "%", True
    return "", (f" {unit}" if len(unit) > 1 else unit), False


def plain_number(value: Column, places: int) -> Column:
    """A number with fixed decimals and no separators, halves to even."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def whole_number(value: Column) -> Column:
    """A whole number with thousands separators, halves to even."""
    return F.format_number(F.rint(value), 0)


def display_number(
    value: Column, format_type: str | None = None, unit: str | None = None
) -> Column:
    """1234567 as 1.23M, with a currency sign, a percent sign or a unit."""
    before, after, is_percent = affixes(format_type, unit)
    number, size = value.cast("double"), F.abs(value.cast("double"))
    thousands = (size >= 1e4) if not is_percent else F.lit(False)
    text = (
        F.when(size >= 1e9, F.concat(plain_number(number / 1e9, 2), F.lit("B")))
        .when(size >= 1e6, F.concat(plain_number(number / 1e6, 2), F.lit("M")))
        .when(thousands, F.concat(plain_number(number / 1e3, 1), F.lit("K")))
        .when((size >= 100) | ((number == F.floor(number)) & (size >= 1)), whole_number(number))
        .when((size < 0.01) & (size > 0), plain_number(number, 4))
        .otherwise(plain_number(number, 2))
    )
    shown = F.concat(F.lit(before), text, F.lit(after))
    return F.when(number.isNull() | F.isnan(number), F.lit(MISSING_TEXT)).otherwise(shown)
