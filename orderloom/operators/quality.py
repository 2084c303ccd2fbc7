"""The quality gate: one pass of counts, and a decision on the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics that must be zero. A null quantity or price counts as valid here; the null counts stand apart.
CHECKS: dict[str, object] = {
    "nullEventId": lambda: F.col("eventId").isNull(),
    "nullCustomerId": lambda: F.col("customerId").isNull(),
    "nullProductId": lambda: F.col("productId").isNull(),
    "invalidQuantity": lambda: F.col("quantity") <= 0,
    "invalidUnitPrice": lambda: F.col("unitPrice") < 0,
}
NOTED: dict[str, object] = {"nullQuantity": lambda: F.col("quantity").isNull(), "nullUnitPrice": lambda: F.col("unitPrice").isNull()}
GATED = (*CHECKS, "duplicateRows")


class QualityError(RuntimeError):
    def __init__(self, failures: Mapping[str, int]):
        super().__init__(f"quality gate failed: {dict(failures)}")
        self.failures = dict(failures)


def duplicate_rows(key: str = "eventId") -> Column:
    """Rows beyond the first of each key, nulls aside, without grouping by it twice."""
    return F.count(key) - F.count_distinct(key)


def metrics(df: DataFrame, noted: bool = False) -> DataFrame:
    """One row of counts from one scan."""
    counts = [F.count_if(check()).alias(name) for name, check in (CHECKS | (NOTED if noted else {})).items()]
    return df.agg(F.count("*").alias("totalRows"), *counts, duplicate_rows().alias("duplicateRows"))


def collected(row_frame: DataFrame) -> dict[str, int]:
    row = row_frame.first()
    return {c: int((row[c] if row is not None else 0) or 0) for c in row_frame.columns}


def failures(values: Mapping[str, int | None], gated: tuple[str, ...] = GATED) -> dict[str, int]:
    """Gated metrics above zero; what is missing or null counts as zero."""
    return {name: int(values[name]) for name in gated if (values.get(name) or 0) > 0}


def gate(df: DataFrame) -> dict[str, int]:
    """The metrics, or QualityError."""
    values = collected(metrics(df))
    if bad := failures(values):
        raise QualityError(bad)
    return values


def duplicate_groups(df: DataFrame, key: str = "eventId") -> DataFrame:
    """Keys that occur more than once, nulls aside."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


class ReconciliationError(RuntimeError):
    pass


def reconcile(trusted_rows: int, table_rows: int, summary_orders: int) -> dict[str, int]:
    """All three counts must agree; the last is a distinct count, so this also finds duplicates."""
    if trusted_rows != table_rows:
        raise ReconciliationError(f"trusted layer has {trusted_rows} rows, the table {table_rows}")
    if trusted_rows != summary_orders:
        raise ReconciliationError(f"trusted layer has {trusted_rows} rows, the summary {summary_orders} orders")
    return {"trusted": trusted_rows, "table": table_rows, "summary": summary_orders}


def reconciliation(trusted: DataFrame, table: DataFrame, summary: DataFrame) -> dict[str, int]:
    return reconcile(trusted.count(), table.count(), int(summary.first()["totalOrders"] or 0))
