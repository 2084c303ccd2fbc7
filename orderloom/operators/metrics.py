"""Sales metrics as data: the minute, daily and global aggregates are one list under different keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import money


@dataclass(frozen=True)
class Metric:
    name: str
    of: Callable[[], Column]

    def column(self) -> Column:
        return self.of().alias(self.name)


ORDERS = Metric("totalOrders", lambda: F.count_distinct("eventId"))
ITEMS = Metric("totalItems", lambda: F.sum("quantity"))
REVENUE = Metric("totalRevenue", lambda: money(F.sum("revenue")))
AVERAGE = Metric("averageOrderValue", lambda: money(F.avg("revenue")))
CUSTOMERS = Metric("uniqueCustomers", lambda: F.count_distinct("customerId"))
PRODUCTS = Metric("uniqueProducts", lambda: F.count_distinct("productId"))
SALES = (ORDERS, ITEMS, REVENUE, AVERAGE)
GLOBAL = (*SALES, CUSTOMERS, PRODUCTS)
LIVE = (Metric("orders", lambda: F.count("*")), Metric("items", lambda: F.sum("quantity")), Metric("revenue", lambda: F.round(F.sum("revenue"), 2)))
DAILY_KEYS = ("eventDate", "channel", "location")


def by(df: DataFrame, keys: Iterable[str | Column], metrics: Iterable[Metric]) -> DataFrame:
    columns = [m.column() for m in metrics]
    keys = list(keys)
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def stamped(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def daily(trusted: DataFrame) -> DataFrame:
    """Sales by day, channel and location."""
    return stamped(by(trusted, DAILY_KEYS, SALES), "goldProcessedAt")


def summary(trusted: DataFrame) -> DataFrame:
    """One row over everything; the distinct counts share one scan.

    Each row is expanded fourfold (one for the sums, one for each distinct count), but only within a task:
    values are made distinct before the shuffle, which therefore carries at most one row for each task and
    distinct id, customer and product, and again after it.
    """
    return stamped(by(trusted, (), GLOBAL), "goldProcessedAt")


def cube(trusted: DataFrame, keys: Iterable[str] = DAILY_KEYS) -> DataFrame:
    """Sales of every combination of the keys, by one Expand: ``level`` has a bit for each key that is summed over, the first key's the
    highest, which tells a subtotal from a null key. For orders whose ids are distinct, so they are counted as rows."""
    keys = list(keys)
    sales = [F.count("eventId").alias("totalOrders"), ITEMS.column(), REVENUE.column(), AVERAGE.column()]
    return trusted.cube(*keys).agg(F.grouping_id(*keys).cast("int").alias("level"), *sales)


def live(events: DataFrame, window: str = "1 minute") -> DataFrame:
    """Sales by window and channel; neither deduplicated nor normalised. Works on streams."""
    revenue = events.withColumn("revenue", F.col("quantity") * F.col("unitPrice"))
    return by(revenue, (F.window("occurredAt", window), "channel"), LIVE)


def flat_window(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in df.columns if c != "window"])


def shares(page: DataFrame, first: int = 12) -> DataFrame:
    """The first rows of an ordered page with their revenue as a percentage of the page's largest."""
    from ..functions.columns import share_of

    # a page is bounded, so one window over it costs less than a second computation of the page
    rows = page.withColumn("most", F.max("total_revenue").over(W.partitionBy())).orderBy(F.desc("event_date"), "channel", "location").limit(first)
    pct = F.round(share_of(F.col("total_revenue"), F.col("most")).cast("double"), 6)
    return rows.withColumn("share", pct).withColumn("bar", F.greatest("share", F.lit(4.0))).drop("most")
