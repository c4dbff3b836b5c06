"""The given orders seen as a legacy table: all text, with the defects a migration meets.

The defects follow from the data: an unspecified priority is blank, urgent ones carry padding,
open status is empty, days past the thirtieth are unreadable, large amounts are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.functions.parsing import format_time
from tablehaul.operators.project import MappingRow, apply_mapping, as_clean_text
from tablehaul.operators.validate import Rule, row_checks, with_errors
from tablehaul.plans.registry import table

TARGETS = ["ORDER_ID", "CUSTOMER_ID", "STATUS", "PRIORITY", "ORDER_DATE", "NET_AMOUNT", "ORDER_TIME", "REGION", "NOTE"]

MAPPING = [
    MappingRow("ORDER_ID", "ordernr"),
    MappingRow("CUSTOMER_ID", "custnr"),
    MappingRow("STATUS", "prio"),
    MappingRow("STATUS", "status"),
    MappingRow("PRIORITY", "prio"),
    MappingRow("ORDER_DATE", "orddate"),
    MappingRow("NET_AMOUNT", "total"),
    MappingRow("ORDER_TIME", "ordtime"),
    MappingRow("REGION", "regio"),
    MappingRow("NOTE", None),
]

RULES = [
    Rule("ORDER_ID", key=True, required=True, max_length=10),
    Rule("CUSTOMER_ID", required=True, max_length=3),
    Rule("STATUS", required=True, max_length=1),
    Rule("PRIORITY", required=True, max_length=8),
    Rule("ORDER_DATE", required=True, type="date", max_length=8),
    Rule("NET_AMOUNT", type="decimal", max_length=8),
    Rule("ORDER_TIME", type="time", max_length=6),
    Rule("REGION"),
    Rule("NOTE"),
]


def legacy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    amount = F.col("o_totalprice").cast("decimal(15,2)")
    seconds = (amount * 100).cast("long") % 86400
    return o.select(
        F.col("o_orderkey").alias("order_no"),
        F.col("o_orderkey").cast("string").alias("ordernr"),
        F.col("o_custkey").cast("string").alias("custnr"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "   ")
        .when(F.col("o_orderpriority") == "1-URGENT", "  1-URGENT ")
        .otherwise(F.col("o_orderpriority")).alias("prio"),
        F.when(F.dayofmonth("o_orderdate") == 31, "unknown")
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("orddate"),
        F.when(F.col("o_totalprice") > 450000, "N/A").otherwise(amount.cast("string")).alias("total"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F"), "240000")
        .otherwise(format_time(seconds)).alias("ordtime"),
        F.when(F.col("o_orderstatus") == "O", "open").alias("remark"),
    )


# The same table in SQL, and the steps built on it.
LEGACY = """
legacy AS (
  SELECT o_orderkey AS order_no, CAST(o_orderkey AS VARCHAR) AS ordernr, CAST(o_custkey AS VARCHAR) AS custnr,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '   ' WHEN o_orderpriority = '1-URGENT' THEN '  1-URGENT '
         ELSE o_orderpriority END AS prio,
    CASE WHEN day(o_orderdate) = 31 THEN 'unknown' ELSE strftime(o_orderdate, '%Y%m%d') END AS orddate,
    CASE WHEN o_totalprice > 450000 THEN 'N/A' ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS total,
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN '240000'
         ELSE lpad(CAST(sec // 3600 AS VARCHAR), 2, '0') || lpad(CAST((sec % 3600) // 60 AS VARCHAR), 2, '0')
              || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') END AS ordtime,
    CASE WHEN o_orderstatus = 'O' THEN 'open' END AS remark
  FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT) % 86400 AS sec FROM orders)
)"""
MAPPED = LEGACY + """,
mapped AS (
  SELECT order_no, trim(ordernr) AS order_id, trim(custnr) AS customer_id, trim(status) AS status, trim(prio) AS priority,
    trim(orddate) AS order_date, trim(total) AS net_amount, trim(ordtime) AS order_time, '' AS region, '' AS note
  FROM legacy
)"""
CHECKED = MAPPED + """,
checked AS (
  SELECT *, list_filter([
    CASE WHEN order_id = '' THEN 'ORDER_ID.required' END,
    CASE WHEN customer_id = '' THEN 'CUSTOMER_ID.required' END,
    CASE WHEN status = '' THEN 'STATUS.required' END,
    CASE WHEN priority = '' THEN 'PRIORITY.required' END,
    CASE WHEN order_date = '' THEN 'ORDER_DATE.required' END], lambda x: x IS NOT NULL) AS errors
  FROM mapped
)"""


def mapped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = legacy_orders(spark, sf_dir)
    cleaned = as_clean_text(raw, [c for c in raw.columns if c != "order_no"])
    return apply_mapping(cleaned, TARGETS, MAPPING, keep=["order_no"])


def checked_orders(spark: SparkSession, sf_dir: str, extended: bool = False) -> DataFrame:
    return with_errors(mapped_orders(spark, sf_dir), row_checks(RULES, extended))
