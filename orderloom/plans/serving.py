"""Read models, their publication, and the queries that readers run."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..contracts import SERVING_DAILY, SERVING_SUMMARY, SERVING_WIDTHS, ContractError, conforms
from ..operators import rules
from ..operators.delivery import NotFound
from ..sources.files import exists, file_system

SINGLETON = 1
# Names of the read models' columns.
_SUMMARY = {"totalOrders": "total_orders", "totalItems": "total_items", "totalRevenue": "total_revenue", "averageOrderValue": "average_order_value", "uniqueCustomers": "unique_customers", "uniqueProducts": "unique_products", "goldProcessedAt": "gold_processed_at"}
_DAILY = {"eventDate": "event_date", "channel": "channel", "location": "location", "totalOrders": "total_orders", "totalItems": "total_items", "totalRevenue": "total_revenue", "averageOrderValue": "average_order_value", "goldProcessedAt": "gold_processed_at"}


def summary_model(summary: DataFrame) -> DataFrame:
    """One row with a constant key."""
    return summary.select(F.lit(SINGLETON).cast("short").alias("id"), *[F.col(a).alias(b) for a, b in _SUMMARY.items()], F.current_timestamp().alias("refreshed_at"))


def daily_model(daily: DataFrame) -> DataFrame:
    return daily.select(*[F.col(a).alias(b) for a, b in _DAILY.items()], F.current_timestamp().alias("refreshed_at"))


@dataclass(frozen=True)
class Published:
    summary_rows: int
    daily_rows: int


class Watched:
    """A model whose rows are counted by the write that stages it, so that nothing is read again."""

    def __init__(self, model: DataFrame, served: tuple[rules.Rule, ...] = ()):
        self.seen = Observation()
        bad = F.count_if(F.size(rules.reasons(served)) > 0) if served else F.lit(0)
        self.df = model.observe(self.seen, F.count("*").alias("rows"), bad.alias("bad"))

    def counts(self) -> tuple[int, int]:
        """Rows, and those that break a rule; once the write is done."""
        got = self.seen.get
        return got["rows"], got["bad"]


def _checked(summary: Watched, daily: Watched, staged: DataFrame) -> Published:
    """Row counts of what is about to be published, or ContractError; staged rows are only read to name some that can't be served."""
    (summaries, _), (days, bad) = summary.counts(), daily.counts()
    if bad:
        rows = rules.rejected(staged, rules.SERVED).select("event_date", "channel", "location", "reasons").take(5)
        raise ContractError(f"{bad} rows that can't be served: {[r.asDict() for r in rows]}")
    if summaries != 1:
        raise ContractError(f"the summary has {summaries} rows, not 1")
    if not days:
        raise ContractError("there are no daily rows")
    return Published(summaries, days)


def _sweep(spark: SparkSession, path: str, current: str, keep: int) -> None:
    """Deletes all but the newest ``keep`` versions; the current one always stays."""
    fs, at = file_system(spark, f"{path}/versions")
    found = sorted(fs.listStatus(at), key=lambda f: (f.getModificationTime(), f.getPath().getName()))
    for f in found[: -max(keep, 1)]:
        if f.getPath().getName() != current.rpartition("/")[2]:
            fs.delete(f.getPath(), True)


def publish_files(summary: DataFrame, daily: DataFrame, path: str, keep: int = 3) -> Published:
    """Stages both models under a new version, checks what was written, then swaps the pointer to it.

    Readers see either both old or both new models; one that has opened a version can read it until ``keep`` further publications are done. Daily rows are sorted by date in few files (a day has few
    rows, and a folder for each would cost more than it saves), so date filters skip files and row groups.
    """
    spark = summary.sparkSession
    version = f"{path}/versions/{uuid.uuid4().hex}"
    one = Watched(conforms(summary, SERVING_SUMMARY).coalesce(1))
    one.df.write.parquet(f"{version}/summary")
    ordered = conforms(daily, SERVING_DAILY).repartitionByRange("event_date", "channel", "location").sortWithinPartitions("event_date", "channel", "location")
    days = Watched(ordered, rules.SERVED)  # above the range exchange, whose sampling would count rows twice
    days.df.write.parquet(f"{version}/daily")
    found = _checked(one, days, spark.read.schema(SERVING_DAILY).parquet(f"{version}/daily"))
    fs, pointer = file_system(spark, f"{path}/current")
    _, staged = file_system(spark, f"{path}/current-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(staged, pointer, options)
    _sweep(spark, path, version, keep)
    return found


def publish_jdbc(summary: DataFrame, daily: DataFrame, url: str, summary_table: str, daily_table: str, properties: dict[str, str] | None = None) -> Published:
    """Replaces the rows of two tables in one transaction.

    Both models are written to tables named ``_staged`` and checked there; then one transaction empties both
    tables and fills them from those. Readers see either both old or both new models, and a failure
    leaves the old ones. Table names are inserted into SQL as they are.
    """
    spark = summary.sparkSession
    properties = properties or {}
    widths = ", ".join(f"{c} VARCHAR({n})" for c, n in SERVING_WIDTHS.items())
    tables = ((conforms(summary, SERVING_SUMMARY), summary_table, None), (conforms(daily, SERVING_DAILY), daily_table, widths))
    watched = Watched(tables[0][0]), Watched(tables[1][0], rules.SERVED)
    for (df, name, types), seen in zip(tables, watched):
        for rows, table, mode in ((seen.df, f"{name}_staged", "overwrite"), (df.limit(0), name, "append")):
            writer = rows.write.mode(mode).option("truncate", "true")
            (writer.option("createTableColumnTypes", types) if types else writer).jdbc(url, table, properties=properties)
    found = _checked(*watched, spark.read.jdbc(url, f"{daily_table}_staged", properties=properties))
    jvm = spark.sparkContext._jvm
    options = jvm.java.util.Properties()
    for key, value in properties.items():
        options.setProperty(key, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, options)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for df, name, _ in tables:
            columns = ", ".join(f'"{c}"' for c in df.columns)
            statement.executeUpdate(f"DELETE FROM {name}")
            statement.executeUpdate(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {name}_staged")
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
    return found


class Store:
    """The published models. ``missing`` until a first publication."""

    def __init__(self, spark: SparkSession, path: str, page_default: int = 100, page_most: int = 1000):
        self.spark, self.path, self.page_default, self.page_most = spark, path, page_default, page_most

    def _version(self) -> str:
        if not exists(self.spark, f"{self.path}/current"):
            raise NotFound("nothing is published yet")
        return self.spark.read.text(f"{self.path}/current").first()[0]

    def summary(self) -> dict:
        return summary_row(self.spark.read.parquet(f"{self._version()}/summary"))

    def daily(self, **filters) -> DataFrame:
        df = self.spark.read.schema(SERVING_DAILY).parquet(f"{self._version()}/daily")
        return daily_sales(df, page_default=self.page_default, page_most=self.page_most, **filters)


def summary_row(model: DataFrame) -> dict:
    row = model.where(F.col("id") == SINGLETON).first()
    if row is None:
        raise NotFound("nothing is published yet")
    return row.asDict()


def wanted(value: str | None) -> str | None:
    """A filter value as it is compared: stripped and upper-cased; blank means no filter."""
    value = (value or "").strip().upper()
    return value or None


def daily_sales(model: DataFrame, start: dt.date | None = None, end: dt.date | None = None, channel: str | None = None, location: str | None = None, limit: int | None = None, page_default: int = 100, page_most: int = 1000) -> DataFrame:
    """One page of daily sales, latest first. Dates are inclusive; ValueError for a range or limit that makes no sense."""
    limit = page_default if limit is None else limit
    if not 1 <= limit <= page_most:
        raise ValueError(f"limit must be within 1 and {page_most}")
    if start and end and start > end:
        raise ValueError("the first date is after the last")
    if start:
        model = model.where(F.col("event_date") >= F.lit(start))
    if end:
        model = model.where(F.col("event_date") <= F.lit(end))
    for column, value in (("channel", wanted(channel)), ("location", wanted(location))):
        if value is not None:
            model = model.where(F.col(column) == F.lit(value))
    return model.orderBy(F.desc("event_date"), "channel", "location").limit(limit)
