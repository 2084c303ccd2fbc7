"""Validity rules as data: from one list come filters, reject reasons and gate metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``ok`` must be true; false and null both reject."""

    name: str
    ok: Callable[[], Column]

    def holds(self) -> Column:
        return F.coalesce(self.ok(), F.lit(False))


def present(column: str) -> Rule:
    return Rule(f"{column}_missing", lambda: F.col(column).isNotNull())


def text(column: str, most: int) -> list[Rule]:
    """Not blank (tabs and line ends are blank, too) and not too long."""
    return [Rule(f"{column}_blank", lambda: F.col(column).rlike(r"[^\x00-\x20]")), Rule(f"{column}_long", lambda: F.col(column).isNull() | (F.char_length(column) <= most))]


#: What the live metrics ask of a parsed event.
PARSED = (present("eventId"), present("occurredAt"))
#: What the trusted layer asks.
TRUSTED = (
    *PARSED,
    present("customerId"),
    present("productId"),
    Rule("quantity_not_positive", lambda: F.col("quantity") > 0),
    Rule("unitPrice_negative", lambda: F.col("unitPrice") >= 0),
)
#: Beyond the trusted rules, what this engine routes to rejects instead of failing a batch.
COMPUTABLE = (*TRUSTED, Rule("revenue_out_of_range", lambda: F.col("revenue").isNotNull()))
#: What the order request must fulfil. The lengths and least amounts.
REQUEST = (
    *text("idempotencyKey", 120),
    *text("customerId", 80),
    *text("productId", 80),
    Rule("quantity_below_1", lambda: F.col("quantity") >= 1),
    Rule("unitPrice_below_0.01", lambda: F.col("unitPrice") >= 0.01),
    *text("channel", 30),
    *text("location", 80),
)
#: What the consumer's projection asks.
PROJECTION = (
    present("eventId"),
    present("occurredAt"),
    Rule("quantity_not_positive", lambda: F.col("quantity") > 0),
    Rule("unitPrice_not_positive", lambda: F.col("unitPrice") > 0),
)
#: What the serving tables ask: no nulls, and keys that fit.
SERVED = (present("event_date"), present("channel"), present("location"), Rule("channel_long", lambda: F.char_length("channel") <= 50), Rule("location_long", lambda: F.char_length("location") <= 100))


def all_hold(rules: Iterable[Rule]) -> Column:
    out = F.lit(True)
    for rule in rules:
        out = out & rule.ok()
    return out


def valid(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    return df.where(all_hold(rules))


def reasons(rules: Iterable[Rule]) -> Column:
    """Names of the rules that a row breaks, in the rules' order."""
    return F.array_compact(F.array(*[F.when(~rule.holds(), F.lit(rule.name)) for rule in rules]))


def with_reasons(df: DataFrame, rules: Iterable[Rule], name: str = "reasons") -> DataFrame:
    return df.withColumn(name, reasons(rules))


def computed(df: DataFrame) -> DataFrame:
    """The same rows with all columns computed at this point: predicates that stand above read them instead
    of repeating their expressions (a parse of JSON, say) once each."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def rejected(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    return with_reasons(computed(df), rules).where(F.size("reasons") > 0)
