"""Order events made from generic tables, and a stream of messages with planned faults."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import MONEY
from ..functions.columns import amount, domain
from ..operators.events import first_of_each

#: The total order of the lines that share an order event's id.
LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
TOPIC = "retail.orders"
#: The fault of an event by the first divisor of its number that fits.
FAULTS = ((11, "malformed"), (13, "no_customer"), (17, "zero"), (19, "negative"), (23, "no_product"), (29, "twice"), (31, "padded"), (37, "iso"), (41, "decimals"), (43, "extra"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; in a temporary folder only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/orderloom-{os.getuid()}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part's price and their order's date: numbers only, for they are shuffled."""
    line, order, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    price = part.select("p_partkey", F.col("p_retailprice").cast(MONEY).alias("unitPrice"))
    dated = order.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("occurredAt"))
    rows = line.join(price, line.l_partkey == price.p_partkey).join(dated, line.l_orderkey == dated.o_orderkey)
    return rows.select("l_orderkey", "l_linenumber", "o_custkey", "occurredAt", "unitPrice", *LINE_ORDER)


def _events(lines: DataFrame, sf_dir: str) -> DataFrame:
    """Lines as order events; domain values are formed on the small sides."""
    customer, nation = (read(lines.sparkSession, sf_dir, t) for t in ("customer", "nation"))
    buyer = customer.select("c_custkey", "c_nationkey", domain("c_mktsegment").alias("channel"))
    place = nation.select("n_nationkey", domain("n_name").alias("location"))
    rows = lines.join(buyer, lines.o_custkey == buyer.c_custkey).join(place, buyer.c_nationkey == place.n_nationkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("eventId"), "occurredAt", F.col("o_custkey").cast("string").alias("customerId"),
        F.col("l_partkey").cast("string").alias("productId"), F.col("l_quantity").cast("int").alias("quantity"), "unitPrice", "channel", "location", *LINE_ORDER,
    )
    return rows.withColumns({"revenue": amount("quantity", "unitPrice"), "eventDate": F.to_date("occurredAt")})


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order event for each line; an id may occur more than once."""
    return _events(_lines(spark, sf_dir), sf_dir)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted orders: the first line of each id.

    An id stands for (order, line number), and all lines of an order have one customer, so copies go before that
    join; where the order's join shuffles by its key, the window needs no shuffle of its own.
    """
    first = first_of_each(_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], *LINE_ORDER)
    return _events(first, sf_dir).drop(*LINE_ORDER)


def _fault() -> str:
    return "CASE " + " ".join(f"WHEN event_id % {n} = 0 THEN '{name}'" for n, name in FAULTS) + " ELSE 'ok' END"


#: The payload in SQL that Spark and DuckDB share; ``secs`` are whole epoch seconds.
PAYLOAD = (
    "CASE WHEN fault = 'malformed' THEN '{\"eventId\": \"evt-' || CAST(event_id AS STRING) || '\", \"oops' ELSE "
    "'{\"eventId\":\"evt-' || CAST(event_id AS STRING) || '\",\"eventType\":\"ORDER_CREATED\",\"eventVersion\":1,\"occurredAt\":' || "
    "CASE WHEN fault = 'iso' THEN '\"2024-01-01T00:00:00Z\"' ELSE CAST(secs AS STRING) || '.0' END || ',\"producer\":\"web\"' || "
    "CASE WHEN fault = 'no_customer' THEN '' ELSE ',\"customerId\":\"user-' || CAST(user_id AS STRING) || '\"' END || "
    "CASE WHEN fault = 'no_product' THEN ',\"productId\":null' ELSE ',\"productId\":\"prod-' || CAST(event_id % 50 AS STRING) || '\"' END || "
    "',\"quantity\":' || CASE WHEN fault = 'zero' THEN '0' ELSE CAST(event_id % 5 + 1 AS STRING) END || "
    "',\"unitPrice\":' || CASE WHEN fault = 'negative' THEN '-1' WHEN fault = 'decimals' THEN CAST(price AS STRING) || '5' ELSE CAST(price AS STRING) END || "
    "',\"channel\":\"' || CASE WHEN fault = 'padded' THEN ' ' || lower(event_type) || '  ' ELSE upper(event_type) END || "
    "'\",\"location\":\"LOC_' || CAST(user_id % 10 AS STRING) || '\"' || CASE WHEN fault = 'extra' THEN ',\"coupon\":\"X\"' ELSE '' END || '}' END"
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as messages with planned faults; two for an event that is sent twice."""
    rows = read(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "CAST(value AS DECIMAL(19,2)) AS price", "unix_seconds(CAST(ts AS TIMESTAMP)) AS secs", f"{_fault()} AS fault"
    )
    rows = rows.selectExpr("*", "explode(CASE WHEN fault = 'twice' THEN array(0, 1) ELSE array(0) END) AS copy", f"{PAYLOAD} AS payload")
    return rows.selectExpr(
        "CAST(CAST(event_id AS STRING) AS BINARY) AS key", "CAST(payload AS BINARY) AS value", f"'{TOPIC}' AS topic",
        "CAST(event_id % 3 AS INT) AS partition", "event_id * 2 + copy AS offset", "timestamp_seconds(secs) AS timestamp",
    )


#: The same rows for DuckDB, as common table expressions ``e`` (events with their fault) and ``m`` (messages).
MESSAGES_SQL = f"""
e AS (SELECT event_id, user_id, event_type, CAST(value AS DECIMAL(19,2)) AS price, CAST(floor(epoch(ts)) AS BIGINT) AS secs, {_fault()} AS fault FROM events),
m AS (
  SELECT e.*, copy, event_id * 2 + copy AS off, {PAYLOAD} AS payload, CAST(event_id % 3 AS INTEGER) AS part,
         'evt-' || CAST(event_id AS STRING) AS eid,
         CASE WHEN fault = 'no_customer' THEN NULL ELSE 'user-' || CAST(user_id AS STRING) END AS cust,
         CASE WHEN fault = 'no_product' THEN NULL ELSE 'prod-' || CAST(event_id % 50 AS STRING) END AS prod,
         CAST(CASE WHEN fault = 'zero' THEN 0 ELSE event_id % 5 + 1 END AS INTEGER) AS qty,
         CAST(CASE WHEN fault = 'negative' THEN -1 WHEN fault = 'decimals' THEN price + 0.01 ELSE price END AS DECIMAL(19,2)) AS amount,
         CASE WHEN fault = 'padded' THEN ' ' || lower(event_type) || '  ' ELSE upper(event_type) END AS chan,
         'LOC_' || CAST(user_id % 10 AS STRING) AS loc,
         make_timestamp(secs * 1000000) AS tm
  FROM e, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR fault = 'twice')"""

#: The trusted orders for DuckDB, as a common table expression ``o``.
ORDERS_SQL = f"""
o AS (SELECT * EXCLUDE (k) FROM (
  SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS eventId, CAST(o_custkey AS STRING) AS customerId, CAST(l_partkey AS STRING) AS productId,
         CAST(l_quantity AS INTEGER) AS quantity, CAST(p_retailprice AS DECIMAL(19,2)) AS unitPrice,
         CAST(CAST(l_quantity AS INTEGER) * CAST(p_retailprice AS DECIMAL(19,2)) AS DECIMAL(19,2)) AS revenue,
         upper(trim(c_mktsegment)) AS channel, upper(trim(n_name)) AS location, CAST(o_orderdate AS DATE) AS eventDate,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey) WHERE k = 1)"""
