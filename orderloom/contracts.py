"""Schemas of all layers as text, checks against them, and alignment to an evolved schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(19, 2)
_TYPES = {
    "string": T.StringType(), "binary": T.BinaryType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "decimal(19,2)": MONEY,
}


def struct(fields: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


# Field names and types of the order event and of the layers.
EVENT = struct(
    "eventId string, eventType string, eventVersion int, occurredAt double, producer string, correlationId string, "
    "customerId string, productId string, quantity int, unitPrice decimal(19,2), channel string, location string"
)
MESSAGE = struct("key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
RAW = struct(
    "kafkaKey string, payload string, kafkaTopic string, kafkaPartition int, kafkaOffset long, kafkaTimestamp timestamp, ingestedAt timestamp, ingestionDate date"
)
TRUSTED = struct(
    "eventId string, eventType string, eventVersion int, occurredAt timestamp, producer string, correlationId string, "
    "customerId string, productId string, quantity int, unitPrice decimal(19,2), channel string, location string, "
    "kafkaTopic string, kafkaPartition int, kafkaOffset long, kafkaTimestamp timestamp, bronzeIngestedAt timestamp, "
    "revenue decimal(19,2), eventDate date, silverProcessedAt timestamp"
)
DAILY = struct("eventDate date, channel string, location string, totalOrders long, totalItems long, totalRevenue decimal(19,2), averageOrderValue decimal(19,2), goldProcessedAt timestamp")
SUMMARY = struct(
    "totalOrders long, totalItems long, totalRevenue decimal(19,2), averageOrderValue decimal(19,2), uniqueCustomers long, uniqueProducts long, goldProcessedAt timestamp"
)
SERVING_SUMMARY = struct(
    "id short, total_orders long, total_items long, total_revenue decimal(19,2), average_order_value decimal(19,2), unique_customers long, unique_products long, gold_processed_at timestamp, refreshed_at timestamp"
)
SERVING_DAILY = struct(
    "event_date date, channel string, location string, total_orders long, total_items long, total_revenue decimal(19,2), average_order_value decimal(19,2), gold_processed_at timestamp, refreshed_at timestamp"
)
#: Widths of the serving tables' strings.
SERVING_WIDTHS = {"channel": 50, "location": 100}


class ContractError(ValueError):
    """Data doesn't have the shape that was agreed on."""


def conforms(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` if names, order and types are those of ``schema`` (nullability aside)."""
    got = [(f.name, f.dataType) for f in df.schema]
    want = [(f.name, f.dataType) for f in schema]
    if got != want:
        wrong = [f"{a} instead of {b}" for a, b in zip(got, want) if a != b] or [f"{len(got)} columns instead of {len(want)}"]
        raise ContractError("; ".join(wrong))
    return df


@dataclass(frozen=True)
class Aligned:
    """A frame in the target's shape, and what that cost."""

    df: DataFrame
    added: tuple[str, ...]
    dropped: tuple[str, ...]


def align(df: DataFrame, target: T.StructType) -> Aligned:
    """The target's columns in its order: missing ones are typed nulls, further ones are left out (and named)."""
    have = set(df.columns)
    columns = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target]
    wanted = {f.name for f in target}
    return Aligned(df.select(*columns), tuple(f.name for f in target if f.name not in have), tuple(c for c in df.columns if c not in wanted))


class EmptyInput(ContractError):
    """A stage got no rows where it needs some."""


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyInput(f"{what} has no rows")
    return df
