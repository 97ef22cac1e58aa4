"""Numeric expressions: count parsing, half-even rounding, guarded ratios.

Functions ending in ``_sql`` give SQL text. Wide projections are written as text because
the parser builds a whole expression in one call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType, FractionalType, IntegralType

from tallyforge.functions.text import trim_unicode_sql

# Spellings that stand for "no count".
EMPTY_COUNTS = ["", "-", "--", "nan", "None"]

_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}(?:[.](?:{_DIGITS})?)?|[.]{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def round_half_even(value: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.rint(value * scale) / scale + F.lit(0.0)


def round_sql(value: str, digits: int = 0) -> str:
    return f"rint(({value}) * {10**digits}D) / {10**digits}D + 0D"


def number_sql(value: float | None) -> str:
    """Literal that keeps every digit of a double."""
    return f"double('{value!r}')" if value is not None else "cast(null as double)"


def total_sql(columns: list[str]) -> str:
    return " + ".join(columns)


def ratio_sql(numerator: str, denominator: str, digits: int = 4) -> str:
    """Ratio, 0 where the denominator is not positive."""
    return f"if({denominator} > 0, {round_sql(f'{numerator} / nullif({denominator}, 0)', digits)}, 0D)"


def parse_count_sql(value: str) -> str:
    """Whole non-negative count written as text; null marks an invalid spelling.

    The shape test comes before the cast because the JVM accepts spellings such as
    ``1d`` or ``NaN`` that are no counts.
    """
    text = f"translate({trim_unicode_sql(value)}, '\u00a0 ', '')"
    dotted = f"translate({text}, ',', '.')"
    number = f"try_cast(translate({dotted}, '_', '') as double)"
    empty = ", ".join(f"'{spelling}'" for spelling in EMPTY_COUNTS)
    return (
        f"case when {value} is null or {text} in ({empty}) then 0L "
        f"when {dotted} rlike '{_NUMBER}' and {number} >= 0 and {number} < 9223372036854775807D "
        f"then cast(rint({number}) as bigint) end"
    )


def parse_count(value: str) -> Column:
    return F.expr(parse_count_sql(value))


def whole_count_sql(value: str) -> str:
    """Count of a whole-number column, where only a negative value is invalid."""
    return f"if(coalesce({value}, 0) >= 0, cast(coalesce({value}, 0) as bigint), null)"


def count_sql(df: DataFrame, name: str, strict: bool = True) -> str:
    """Count of a measure column of any type; text is parsed, whole numbers are checked.

    NaN in a floating column is a missing count, 0.
    """
    kind = df.schema[name].dataType
    value = f"nanvl({name}, cast(null as double))" if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType) else name
    count = whole_count_sql(name) if isinstance(kind, IntegralType) else parse_count_sql(value)
    if not strict:
        return count
    message = f"concat('invalid count in {name}: ', cast({name} as string))"
    return f"coalesce({count}, cast(raise_error({message}) as bigint))"
