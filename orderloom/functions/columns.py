"""Column expressions that the layers share; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import MONEY


def domain(c: Column | str) -> Column:
    """Domain values are compared upper-cased and without outer ASCII spaces."""
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def instant(epoch_seconds: Column | str) -> Column:
    """Epoch seconds with a fraction; NaN gives null."""
    return F.timestamp_seconds(epoch_seconds)


def amount(quantity: Column | str, price: Column | str) -> Column:
    """Quantity times price as money; null instead of an error where that is out of range."""
    quantity, price = (F.col(c) if isinstance(c, str) else c for c in (quantity, price))
    return (quantity * price).try_cast(MONEY)


def money(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


def share_of(c: Column, most: Column) -> Column:
    """Percent of the largest value, which counts as 1 at least; a bar of at least 4 for display."""
    return c / F.greatest(most, F.lit(1).cast(MONEY)) * 100
