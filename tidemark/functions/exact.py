"""Sums of money that are the same however the rows are split.

A sum of doubles depends on the order of its terms, which a cluster does not fix. Amounts
here have a few decimal places, so they are counted in whole units of the last place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_BITS = 20


def units(column: str, places: int = 2) -> Column:
    """An amount as a whole number of units of its last decimal place."""
    return F.rint(F.col(column) * F.lit(10.0**places)).cast("bigint")


def part_sums(name: str, amount: Column) -> dict[str, Column]:
    """Sum of whole units, as the two columns ``{name}_high`` and ``{name}_low``.

    High and low bits are summed apart, as ``bigint``: neither sum overflows within 10^12
    rows, and both stay in generated code, where decimals of over 18 digits do not.
    """
    return {
        f"{name}_high": F.sum(F.shiftright(amount, LOW_BITS)),
        f"{name}_low": F.sum(amount.bitwiseAND(F.lit((1 << LOW_BITS) - 1))),
    }


def merged_sums(name: str) -> dict[str, Column]:
    """The sums of several ``part_sums``, under the same names."""
    return {part: F.sum(part) for part in (f"{name}_high", f"{name}_low")}


def named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def whole_sum(high: Column, low: Column, places: int) -> Column:
    """The two parts put together, as a decimal amount."""
    whole = high.cast("decimal(20,0)") * F.lit(1 << LOW_BITS).cast("decimal(7,0)") + low.cast("decimal(20,0)")
    return (whole * F.lit(10**-places).cast(f"decimal({places},{places})")).cast(f"decimal(34,{places})")


def sum_of(name: str, places: int = 2) -> Column:
    """The amount held in ``{name}_high`` and ``{name}_low``."""
    return whole_sum(F.col(f"{name}_high"), F.col(f"{name}_low"), places)


def exact_sum(amount: Column, places: int = 2) -> Column:
    """Sum of whole units, as a decimal amount, in one step."""
    return whole_sum(*part_sums("", amount).values(), places)


def exact(column: str | Column, kind: str = "decimal(12,2)") -> Column:
    """A double with a few decimal places, as the decimal it stands for."""
    return (F.col(column) if isinstance(column, str) else column).cast(kind)


def as_double(column: str | Column, places: int = 2) -> Column:
    """A decimal result, rounded and given back as a double."""
    return F.round(F.col(column) if isinstance(column, str) else column, places).cast("double")
