"""Rules, routing and layout."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul import sinks
from tablehaul.operators import duplicates, project, report, scan, validate
from tablehaul.operators.rownum import number_rows
from tablehaul.plans import legacy
from tablehaul.plans.registry import query, table
from tablehaul.session import new_output
from tablehaul.sources import bucketed

RUN = datetime(2025, 1, 1, tzinfo=timezone.utc)

REJECT_BY_RULE = f"WITH {legacy.CHECKED} SELECT error_rule, count(*) AS errors FROM (SELECT unnest(errors) AS error_rule FROM checked) GROUP BY 1"


@query("reject_by_rule", REJECT_BY_RULE)
def reject_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rule_counts(legacy.mapped_orders(spark, sf_dir), validate.row_checks(legacy.RULES))


@query(
    "reject_rows",
    f"""WITH {legacy.CHECKED}
    SELECT order_no AS "__rownum", array_to_string(errors, '|') AS "__errors", errors[1] AS "__first_error",
      '{RUN.isoformat()}' AS "__timestamp", order_id AS "ORDER_ID", customer_id AS "CUSTOMER_ID", status AS "STATUS",
      priority AS "PRIORITY", order_date AS "ORDER_DATE", net_amount AS "NET_AMOUNT", order_time AS "ORDER_TIME",
      region AS "REGION", note AS "NOTE"
    FROM checked WHERE len(errors) > 0""",
)
def reject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rejected(legacy.checked_orders(spark, sf_dir), "order_no", RUN)


@query("accept_rows", f"WITH {legacy.CHECKED} SELECT * EXCLUDE (errors) FROM checked WHERE len(errors) = 0")
def accept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.accepted(legacy.checked_orders(spark, sf_dir))


@query(
    "in_out_counts",
    f"""WITH {legacy.CHECKED} SELECT count(*) AS rows_in, count(*) FILTER (len(errors) = 0) AS rows_out,
    count(*) FILTER (len(errors) > 0) AS rows_rejected FROM checked""",
)
def in_out_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.in_out_counts(legacy.checked_orders(spark, sf_dir))


@query(
    "errors_by_field",
    f"""WITH {legacy.CHECKED} SELECT split_part(e, '.', 1) AS field, count(*) AS errors
    FROM (SELECT unnest(errors) AS e FROM checked) GROUP BY 1""",
)
def errors_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.errors_by_field(validate.errors_by_rule(legacy.checked_orders(spark, sf_dir)))


TEMPLATE = ["CUSTOMER_ID(*)", "ORDER_ID(k/*)", "ORDER_DATE", "PLANT", "STATUS(*)"]


@query(
    "template_layout",
    f"""WITH {legacy.CHECKED} SELECT customer_id AS "CUSTOMER_ID(*)", order_id AS "ORDER_ID(k/*)",
    order_date AS "ORDER_DATE(*)", '' AS "PLANT", status AS "STATUS(*)" FROM checked WHERE len(errors) = 0""",
)
def template_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {r.field: (r.key, r.required) for r in legacy.RULES}
    layout = project.plan_layout(legacy.TARGETS, TEMPLATE, flags)
    return project.apply_layout(accept_rows(spark, sf_dir), layout)


EXTENDED_SQL = f"""WITH {legacy.MAPPED}, failed AS (
  SELECT unnest([
    CASE WHEN order_id = '' THEN 'ORDER_ID.required' END, CASE WHEN length(order_id) > 10 THEN 'ORDER_ID.max_length' END,
    CASE WHEN customer_id = '' THEN 'CUSTOMER_ID.required' END, CASE WHEN length(customer_id) > 3 THEN 'CUSTOMER_ID.max_length' END,
    CASE WHEN status = '' THEN 'STATUS.required' END, CASE WHEN length(status) > 1 THEN 'STATUS.max_length' END,
    CASE WHEN priority = '' THEN 'PRIORITY.required' END, CASE WHEN length(priority) > 8 THEN 'PRIORITY.max_length' END,
    CASE WHEN order_date = '' THEN 'ORDER_DATE.required' END, CASE WHEN length(order_date) > 8 THEN 'ORDER_DATE.max_length' END,
    CASE WHEN order_date <> '' AND NOT (regexp_full_match(order_date, '[0-9]{{8}}') AND try_strptime(order_date, '%Y%m%d') IS NOT NULL) THEN 'ORDER_DATE.date' END,
    CASE WHEN length(net_amount) > 8 THEN 'NET_AMOUNT.max_length' END,
    CASE WHEN net_amount <> '' AND try_cast(net_amount AS DOUBLE) IS NULL THEN 'NET_AMOUNT.decimal' END,
    CASE WHEN length(order_time) > 6 THEN 'ORDER_TIME.max_length' END,
    CASE WHEN order_time <> '' AND NOT regexp_full_match(order_time, '([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]') THEN 'ORDER_TIME.time' END
  ]) AS error_rule FROM mapped)
SELECT error_rule, count(*) AS errors FROM failed WHERE error_rule IS NOT NULL GROUP BY 1"""


@query("check_length_and_type", EXTENDED_SQL)
def check_length_and_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rule_counts(legacy.mapped_orders(spark, sf_dir), validate.row_checks(legacy.RULES, extended=True))


@query(
    "reject_rows_extended",
    EXTENDED_SQL.replace("SELECT unnest([", "SELECT order_no, unnest([").replace("SELECT error_rule, count(*) AS errors FROM failed", "SELECT order_no, error_rule FROM failed").replace(" GROUP BY 1", ""),
)
def reject_rows_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failed rule of every row."""
    return validate.error_rows(legacy.checked_orders(spark, sf_dir, extended=True).select("order_no", "errors"))


@query(
    "key_unique",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows_with_key FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def key_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    return validate.duplicate_keys(table(spark, sf_dir, "lineitem"), keys).drop("key_empty")


@query(
    "key_unique_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def key_unique_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return duplicates.rows_with_repeated_key(lines, ["l_orderkey", "l_linenumber"])


ORPHANS = """SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS
  (SELECT 1 FROM customer c WHERE o.o_custkey = CASE WHEN c_acctbal >= 0 THEN c_custkey ELSE -c_custkey END)"""


def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt have a negative number, so their orders find no customer."""
    number = F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(number.alias("c_custkey"))


@query(
    "ref_integrity",
    ORPHANS,
)
def ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer goes by another number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return validate.orphans(orders, renumbered(spark, sf_dir), ["o_custkey"], ["c_custkey"])


@query("ref_integrity_bucketed", ORPHANS)
def ref_integrity_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over tables stored in buckets of the customer number: the check itself shuffles neither."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = bucketed.store_bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], n, "orders_by_customer")
    customers = bucketed.store_bucketed(renumbered(spark, sf_dir), ["c_custkey"], n, "customers_by_number")
    return validate.orphans(orders, customers.hint("merge"), ["o_custkey"], ["c_custkey"])


@query(
    "reconcile_counts",
    f"""WITH {legacy.CHECKED}, kept AS (SELECT * FROM checked WHERE status <> '' OR priority <> ''),
    counts AS (SELECT (SELECT count(*) FROM legacy) AS rows_in, count(*) FILTER (len(errors) = 0) AS rows_out,
      count(*) FILTER (len(errors) > 0) AS rows_rejected FROM kept)
    SELECT *, rows_in - rows_out - rows_rejected AS rows_lost, rows_in = rows_out + rows_rejected AS balanced FROM counts""",
)
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts taken while both outcomes are written; rows without status and priority are lost on the way."""
    raw, given = sinks.count_rows(legacy.legacy_orders(spark, sf_dir))
    cleaned = project.as_clean_text(raw, [c for c in raw.columns if c != "order_no"])
    kept = project.drop_empty_rows(cleaned, ["status", "prio"])
    mapped = project.apply_mapping(kept, legacy.TARGETS, legacy.MAPPING, keep=["order_no"])
    checks = validate.row_checks(legacy.RULES)
    rows, outcomes = sinks.count_outcomes(validate.with_errors(mapped, checks), [label for label, _ in checks])
    sinks.write_routed(rows, new_output(spark, "reconciled"))
    found = {**given.get, **outcomes.get}
    lost = found["rows_in"] - found["rows_out"] - found["rows_rejected"]
    row = (found["rows_in"], found["rows_out"], found["rows_rejected"], lost, lost == 0)
    return spark.createDataFrame([row], "rows_in long, rows_out long, rows_rejected long, rows_lost long, balanced boolean")


@query(
    "write_summary",
    f"""WITH {legacy.CHECKED}, failed AS (SELECT unnest(errors) AS e FROM checked),
    counts AS (SELECT count(*) AS n, count(*) FILTER (len(errors) = 0) AS good FROM checked)
    SELECT 'rows' AS part, unnest(['in', 'out', 'rejected', 'lost']) AS name, unnest([n, good, n - good, 0]) AS n FROM counts
    UNION ALL SELECT 'errors_by_rule', e, count(*) FROM failed GROUP BY e
    UNION ALL SELECT 'errors_by_field', split_part(e, '.', 1), count(*) FROM failed GROUP BY split_part(e, '.', 1)""",
)
def write_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a write, from the write itself."""
    checks = validate.row_checks(legacy.RULES)
    labels = [label for label, _ in checks]
    raw, given = sinks.count_rows(legacy.mapped_orders(spark, sf_dir))
    rows, outcomes = sinks.count_outcomes(validate.with_errors(raw, checks), labels)
    sinks.write_routed(rows, new_output(spark, "summed"))
    return sinks.summary(spark, given.get["rows_in"], outcomes.get, labels)


@query(
    "repeated_run",
    f"""WITH {legacy.CHECKED} SELECT 'orders' AS object, CASE WHEN status = '' THEN 'none' ELSE lower(status) END AS variant, '0012' AS run_ts,
    order_no, order_id, customer_id, net_amount FROM checked""",
)
def repeated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of several variants written, and then all its variants but one again: every row stands once."""
    path = new_output(spark, "repeated_run")
    rows = legacy.checked_orders(spark, sf_dir).select("order_no", "order_id", "customer_id", "net_amount", F.when(F.col("status") == "", "none").otherwise(F.lower("status")).alias("variant"))
    tagged = rows.withColumns({"object": F.lit("orders"), "run_ts": F.lit("0012")})
    sinks.write_by_address(tagged, path)
    sinks.write_by_address(tagged.filter("variant <> 'none'"), path)
    return sinks.read_by_address(spark, path).select(*sinks.ADDRESS, "order_no", "order_id", "customer_id", "net_amount")


@query(
    "merged_cells",
    """WITH m AS (SELECT p_partkey AS at, p_partkey + p_size * 10 AS until, p_brand FROM part WHERE p_size <= 5)
    SELECT 'parts' AS file, p_partkey AS row_no, 'All parts' AS title, p_name AS name,
      CASE WHEN p_size <= 5 THEN p_brand ELSE (SELECT max_by(m.p_brand, m.at) FROM m WHERE m.at < p.p_partkey AND m.until >= p.p_partkey) END AS brand FROM part p""",
)
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet with a row for each part: a title merged over all its rows, and brands merged over rows of other parts."""
    part = table(spark, sf_dir, "part")
    cell = lambda row, col, value, down: F.struct(row.cast("long").alias("row_no"), F.lit(col).alias("col_no"), value.alias("value"), down.cast("long").alias("merge_down"))
    brand = F.when(F.col("p_size") <= 5, cell(F.col("p_partkey"), 3, F.col("p_brand"), F.col("p_size") * 10))
    own = part.select(F.inline(F.array_compact(F.array(cell(F.col("p_partkey"), 2, F.col("p_name"), F.lit(0)), brand))))
    ends = part.agg(F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    title = ends.select(F.inline(F.array(cell(F.col("low"), 1, F.lit("All parts"), F.col("high") - F.col("low")))))
    cells = own.unionByName(title).withColumns({"file": F.lit("parts"), "sheet": F.lit("all")})
    at = lambda i: F.get("cells", F.lit(i))
    return scan.fill_merged(cells, 3).select("file", "row_no", at(0).alias("title"), at(1).alias("name"), at(2).alias("brand"))


@query("row_numbers", "SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS row_no, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    numbered = number_rows(table(spark, sf_dir, "lineitem").select(*keys), keys)
    return numbered.select("row_no", *keys[:6])


@query(
    "search_rows",
    """SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer
    WHERE (CAST(c_custkey AS VARCHAR) LIKE '%7%' OR lower(c_name) LIKE '%7%' OR CAST(c_nationkey AS VARCHAR) LIKE '%7%' OR lower(c_mktsegment) LIKE '%7%')
    AND lower(c_mktsegment) LIKE '%mach%'""",
)
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return project.search(customers, "7", "c_mktsegment", "Mach")


MIXED = "CASE WHEN order_no % 5 = 0 THEN concat(total, ' EUR') WHEN order_no % 7 = 0 THEN concat('n/a ', total) ELSE total END"


@query(
    "numeric_first_sort",
    f"""WITH {legacy.LEGACY}, given AS (SELECT {MIXED} AS total, order_no FROM legacy),
    keyed AS (SELECT *, try_cast(nullif(regexp_extract(total, '{project.LEADING_NUMBER}', 1), '') AS DOUBLE) AS number FROM given)
    SELECT total, order_no, row_number() OVER (ORDER BY number ASC NULLS LAST, total ASC NULLS FIRST, order_no) AS "position" FROM keyed""",
)
def numeric_first_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, some with a word behind or before them; the order shows in the row numbers."""
    rows = legacy.legacy_orders(spark, sf_dir).select(F.expr(MIXED).alias("total"), "order_no")
    number = project.leading_number("total")
    keyed = rows.withColumn("is_text", number.isNull()).withColumn("number", number)
    return number_rows(keyed, ["is_text", "number", "total", "order_no"], "position").select("total", "order_no", "position")


@query(
    "empty_row_drop",
    f"""WITH {legacy.LEGACY} SELECT order_no, trim(status) AS status, trim(prio) AS prio FROM legacy
    WHERE trim(status) <> '' OR trim(prio) <> ''""",
)
def empty_row_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.legacy_orders(spark, sf_dir).select("order_no", "status", "prio")
    return project.drop_empty_rows(project.as_clean_text(rows, ["status", "prio"]), ["status", "prio"])


@query(
    "head_rows",
    f"""WITH {legacy.MAPPED} SELECT order_no AS "__rownum", order_id, customer_id, status,
    list_filter([CASE WHEN order_id = '' THEN 'order_id.required' END, CASE WHEN customer_id = '' THEN 'customer_id.required' END,
      CASE WHEN status = '' THEN 'status.required' END], lambda x: x IS NOT NULL) AS errors
    FROM mapped ORDER BY order_no LIMIT 200""",
)
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.head_rows(legacy.mapped_orders(spark, sf_dir), "order_no")


@query(
    "export_filtered_rows",
    f"""WITH {legacy.CHECKED} SELECT order_no AS "__rownum", array_to_string(errors, '|') AS "__errors", status AS "STATUS", priority AS "PRIORITY", order_date AS "ORDER_DATE"
    FROM checked WHERE len(errors) > 0 AND contains(lower(array_to_string(errors, '|')), 'status') AND
      (contains(order_date, '1995') OR contains(lower(priority), '1995') OR contains(CAST(order_no AS VARCHAR), '1995'))""",
)
def export_filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows that a search leaves, written as a file and read back."""
    rows = reject_rows(spark, sf_dir).select("__rownum", "__errors", "STATUS", "PRIORITY", "ORDER_DATE")
    path = new_output(spark, "filtered")
    sinks.write_load_file(project.search(rows, "1995", "__errors", "STATUS"), path)
    back = spark.read.options(header=True, escape='"').csv(path)
    return back.select(F.col("__rownum").cast("long").alias("__rownum"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("__errors", "STATUS", "PRIORITY", "ORDER_DATE")])


@query("export_list", f"WITH {legacy.CHECKED} SELECT DISTINCT e AS \"Item\" FROM (SELECT unnest(errors) AS e FROM checked)")
def export_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that failed, as a list in a file."""
    path = new_output(spark, "list")
    sinks.write_load_file(sinks.list_export(reject_by_rule(spark, sf_dir), "error_rule"), path)
    return spark.read.options(header=True).csv(path)


@query("top_error_rules", REJECT_BY_RULE + " ORDER BY errors DESC, error_rule LIMIT 10")
def top_error_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_rows(reject_by_rule(spark, sf_dir), "error_rule", "errors")


@query(
    "routed_output",
    f"""WITH {legacy.CHECKED} SELECT CASE WHEN len(errors) = 0 THEN 'accepted' ELSE 'rejected' END AS outcome, order_no, order_id, customer_id, status, errors FROM checked""",
)
def routed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outcomes written in one pass and read back."""
    path = new_output(spark, "routed_output")
    sinks.write_routed(legacy.checked_orders(spark, sf_dir), path)
    return spark.read.parquet(path).select("outcome", "order_no", "order_id", "customer_id", "status", "errors")


@query("partitioned_output", f"WITH {legacy.CHECKED} SELECT * EXCLUDE (errors) FROM checked WHERE len(errors) = 0")
def partitioned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows written by address and read back through it."""
    path = new_output(spark, "partitioned_output")
    sinks.write_addressed(accept_rows(spark, sf_dir), path, "orders", "legacy", "20250101_0000")
    back = sinks.read_by_address(spark, path)
    return back.filter((F.col("object") == "orders") & (F.col("variant") == "legacy")).drop("object", "variant", "run_ts")
