"""Value transforms over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul import sinks
from tablehaul.operators import migrate, rule_tables, transform, versions
from tablehaul.operators.transform import FieldTransform, Settings
from tablehaul.operators.validate import Rule
from tablehaul.plans import legacy
from tablehaul.plans.registry import query, table
from tablehaul.session import new_output
from tablehaul.sources import metadata

PRIORITY_SQL = "CASE lower(trim(prio)) WHEN '1-urgent' THEN 'A' WHEN '2-high' THEN 'B' WHEN '3-medium' THEN 'C' ELSE trim(prio) END"


def priorities(spark: SparkSession) -> DataFrame:
    """The value table of one field, in a spelling of its own."""
    rows = [("1-Urgent", "A"), ("2-HIGH", "B"), ("3-medium", "C")]
    return spark.createDataFrame([("prio", *r) for r in rows], "target_field string, source_value string, target_value string")


@query("value_map", f"WITH {legacy.LEGACY} SELECT order_no, {PRIORITY_SQL} AS prio, prio IS NULL AS skipped FROM legacy")
def value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.legacy_orders(spark, sf_dir).select("order_no", "prio")
    keep = Settings(null_handling="skip", empty_string_handling="keep")
    return rule_tables.apply_rule_tables(rows, [FieldTransform("prio")], priorities(spark), keep)


@query(
    "value_map_table",
    f"""WITH {legacy.LEGACY}, m AS (SELECT lower(c_mktsegment) AS k, min(CAST(c_custkey AS VARCHAR)) AS v FROM customer GROUP BY 1)
    SELECT c_custkey, coalesce(v, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN m ON lower(c_mktsegment) = k""",
)
def value_map_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value table that comes from data: each segment becomes its first customer's number."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    values = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("source_value"), F.col("c_custkey").cast("string").alias("target_value")
    )
    return transform.map_by_table(rows, "c_mktsegment", values)


@query(
    "placeholder",
    f"""WITH {legacy.LEGACY} SELECT order_no, CASE WHEN trim(status) = '' THEN '#' ELSE trim(status) END AS status,
    coalesce(remark, '-') AS remark FROM legacy""",
)
def placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.legacy_orders(spark, sf_dir).select("order_no", "status", "remark")
    return transform.apply_transforms(rows, [FieldTransform("status", placeholder="#"), FieldTransform("remark", placeholder="-")])


@query(
    "placeholder_skip",
    f"""WITH {legacy.LEGACY} SELECT order_no, trim(status) AS status, remark,
    status IS NULL OR trim(status) = '' OR remark IS NULL OR trim(remark) = '' AS skipped FROM legacy""",
)
def placeholder_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.legacy_orders(spark, sf_dir).select("order_no", "status", "remark")
    skip = Settings(null_handling="skip", empty_string_handling="skip")
    return transform.apply_transforms(rows, [FieldTransform("status"), FieldTransform("remark")], skip)


@query(
    "placeholder_error",
    f"""WITH {legacy.LEGACY} SELECT CASE WHEN remark IS NULL THEN 'REMARK.null' ELSE 'none' END AS error, count(*) AS "rows" FROM legacy GROUP BY 1""",
)
def placeholder_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.legacy_orders(spark, sf_dir).select("order_no", "status", "remark")
    fail = Settings(null_handling="error", empty_string_handling="keep")
    out = transform.apply_transforms(rows, [FieldTransform("status"), FieldTransform("remark")], fail)
    label = F.when(F.size("errors") == 0, "none").otherwise(F.concat_ws("|", "errors"))
    return out.groupBy(label.alias("error")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "constant_and_calculated",
    f"WITH {legacy.LEGACY} SELECT order_no, ' ' AS status, upper(ordernr || '/' || custnr) AS remark FROM legacy",
)
def constant_and_calculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.legacy_orders(spark, sf_dir).select("order_no", "ordernr", "custnr", "status", "remark")
    rules = [FieldTransform("status", "constant"), FieldTransform("remark", "calculated", expression="upper(concat(ordernr, '/', custnr))")]
    return transform.apply_transforms(rows, rules).select("order_no", "status", "remark")


@query(
    "date_std",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS order_date FROM orders WHERE day(o_orderdate) <> 31
    UNION ALL SELECT o_orderkey, NULL FROM orders WHERE day(o_orderdate) = 31""",
)
def date_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in three ways by status, one of them unreadable on the thirty-first."""
    d, status = F.col("o_orderdate"), F.col("o_orderstatus")
    written = (
        F.when(F.dayofmonth(d) == 31, "soon")
        .when(status == "O", F.date_format(d, "dd.MM.yyyy"))
        .when(status == "F", F.date_format(d, "yyyy-MM-dd"))
        .otherwise(F.date_format(d, "yyyyMMdd"))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return rows.select("o_orderkey", transform.standardize_date(F.col("written"), "yyyyMMdd", "yyyy-MM-dd", "dd.MM.yyyy").alias("order_date"))


@query(
    "number_std",
    "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS amount FROM orders",
)
def number_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with grouping points and a decimal comma."""
    grouped = F.format_number(F.col("o_totalprice").cast("decimal(15,2)"), 2)
    written = F.translate(grouped, ",.", ".,")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return rows.select("o_orderkey", transform.standardize_number(F.col("written")).alias("amount"))


RATES_SQL = """rates AS (SELECT CASE WHEN n_regionkey = 4 THEN 'OLD_' ELSE '' END || n_name AS from_currency, CAST(0.5 + n_nationkey / 25 AS DECIMAL(18,8)) AS rate FROM nation)"""


@query(
    "currency",
    f"""WITH {RATES_SQL} SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(18,4)) * CASE WHEN n_name = 'NATION_0' THEN 1 ELSE rate END, 2) AS DOUBLE) AS converted
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN rates ON n_name = from_currency""",
)
def currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation has its currency and a rate to that of nation 0; the currencies of one region go by old names."""
    nation = table(spark, sf_dir, "nation")
    old = F.when(F.col("n_regionkey") == 4, "OLD_").otherwise("")
    rates = nation.select(
        F.concat(old, "n_name").alias("from_currency"), F.lit("NATION_0").alias("to_currency"),
        (0.5 + F.col("n_nationkey") / 25).alias("rate"),
    )
    rows = transform.lookup(table(spark, sf_dir, "customer"), "c_nationkey", nation, "n_nationkey", "n_name", "currency")
    out = transform.convert_currency(rows, "c_acctbal", "currency", rates, "NATION_0")
    return out.select("c_custkey", F.col("converted").cast("double").alias("converted"))


@query(
    "lookup",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS brand FROM lineitem
    LEFT JOIN (SELECT CASE WHEN p_size <= 25 THEN p_partkey ELSE -p_partkey END AS part_no, p_brand FROM part) ON l_partkey = part_no""",
)
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part_no = F.when(F.col("p_size") <= 25, F.col("p_partkey")).otherwise(-F.col("p_partkey"))
    parts = table(spark, sf_dir, "part").select(part_no.alias("part_no"), "p_brand")
    return transform.lookup(lines, "l_partkey", parts, "part_no", "p_brand", "brand")


@query(
    "change_log",
    f"""WITH {legacy.LEGACY} SELECT order_no, 'prio' AS field, prio AS original, {PRIORITY_SQL} AS transformed FROM legacy
      WHERE prio IS DISTINCT FROM {PRIORITY_SQL}
    UNION ALL SELECT order_no, 'remark', remark, coalesce(remark, '-') FROM legacy WHERE remark IS NULL""",
)
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.legacy_orders(spark, sf_dir).select("order_no", "prio", "remark", F.col("prio").alias("old_prio"))
    keep = Settings(null_handling="skip", empty_string_handling="keep")
    mapped = rule_tables.apply_rule_tables(rows, [FieldTransform("prio")], priorities(spark), keep)
    remark = F.col("remark")
    pairs = {"prio": (F.col("old_prio"), F.col("prio")), "remark": (remark, transform.fill_value(remark, "-", Settings()))}
    return transform.change_log(mapped, "order_no", pairs)


RULE_FIELDS = [
    ("PRIO", "direct", "?", None), ("STATUS", "direct", "#", None), ("CUSTNR", "direct", "", None), ("REMARK", "direct", "-", None),
    ("ORDDATE", "constant", "00000000", None), ("ORDTIME", "calculated", "", "concat(substr(ordtime, 1, 2), ':', substr(ordtime, 3, 2))"),
]
#: What the value tables of the queries below hold, in SQL.
VALUES_SQL = """
prios AS (SELECT DISTINCT lower(o_orderpriority) AS k, substr(o_orderpriority, 3) AS v FROM orders WHERE o_orderpriority <> '5-LOW'),
states AS (SELECT DISTINCT lower(o_orderstatus) AS k, o_orderstatus || o_orderstatus AS v FROM orders),
custs AS (SELECT CAST(CASE WHEN c_acctbal >= 0 THEN c_custkey ELSE -c_custkey END AS VARCHAR) AS k, 'N' || c_nationkey || '-' || c_custkey AS v FROM customer)"""


def rule_documents(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Writes the transform document of the legacy orders; its short value tables come from the orders themselves."""
    orders = table(spark, sf_dir, "orders")
    prio, state = F.col("o_orderpriority"), F.col("o_orderstatus")
    pair = lambda field, source, target: F.struct(F.lit(field).alias("target_field"), F.struct(source.alias("source_value"), target.alias("target_value")).alias("pair"))
    both = F.array(pair("PRIO", prio, F.substring(prio, 3, 99)), pair("STATUS", F.lower(state), F.concat(state, state)))
    pairs = orders.select(F.inline(both)).filter("pair.source_value <> '5-LOW'").distinct()
    pairs = pairs.groupBy("target_field").agg(F.sort_array(F.collect_list("pair")).alias("value_mappings"))
    rows = [("orders", "legacy", i, *r) for i, r in enumerate(RULE_FIELDS)]
    schema = "object string, variant string, position int, target_field string, transformation_type string, placeholder_value string, expression string"
    rules = spark.createDataFrame(rows, schema).join(pairs, "target_field", "left")
    settings = spark.createDataFrame([("use_placeholder", "use_placeholder", False, True)], "null_handling string, empty_string_handling string, case_sensitive_mappings boolean, trim_whitespace boolean")
    metadata.write_transform_rules(rules, settings, path)


def customer_numbers(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    """A value table with an entry for each customer; customers in debt go by another number, so orders of theirs find none."""
    number = F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))
    target = F.concat(F.lit("N"), "c_nationkey", F.lit("-"), "c_custkey")
    return table(spark, sf_dir, "customer").select(F.lit(field).alias("target_field"), F.lit(0).alias("position"), number.cast("string").alias("source_value"), target.alias("target_value"))


@query(
    "transform_rules_applied",
    f"""WITH {legacy.LEGACY}, {VALUES_SQL}
    SELECT order_no, coalesce(CASE WHEN trim(prio) = '' THEN '?' END, prios.v, trim(prio)) AS prio,
      coalesce(CASE WHEN status = '' THEN '#' END, states.v, status) AS status, coalesce(custs.v, custnr) AS custnr, coalesce(remark, '-') AS remark,
      '00000000' AS orddate, substr(ordtime, 1, 2) || ':' || substr(ordtime, 3, 2) AS ordtime
    FROM legacy LEFT JOIN prios ON lower(trim(prio)) = prios.k LEFT JOIN states ON lower(status) = states.k LEFT JOIN custs ON custnr = custs.k""",
)
def transform_rules_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and settings read from a document, short value tables from the same, a long one from a table."""
    path = new_output(spark, "transform_rules")
    rule_documents(spark, sf_dir, path)
    rules, values, settings = metadata.read_transform_rules(spark, path)
    columns = ["target_field", "position", "source_value", "target_value"]
    values = values.select(*columns).unionByName(customer_numbers(spark, sf_dir, "CUSTNR").select(*columns))
    rows = legacy.legacy_orders(spark, sf_dir).select("order_no", "prio", "status", "custnr", "remark", "orddate", "ordtime")
    return rule_tables.apply_rule_tables(rows, rule_tables.collect_transforms(rules), values, rule_tables.collect_settings(settings))


TEMPLATE = ["CUSTOMER_ID(*)", "ORDER_ID(k/*)", "PRIORITY", "STATUS(*)", "PLANT", "REGION", "NOTE", "ORDER_DATE"]
MIGRATED = legacy.MAPPED + f""", {VALUES_SQL},
translated AS (
  SELECT order_no, order_id, coalesce(custs.v, customer_id) AS customer_id, coalesce(states.v, status) AS status, coalesce(prios.v, priority) AS priority,
    order_date, net_amount, order_time, 'EU' AS region, 'order ' || order_id AS note
  FROM mapped LEFT JOIN prios ON lower(priority) = prios.k LEFT JOIN states ON lower(status) = states.k LEFT JOIN custs ON customer_id = custs.k),
checked AS (
  SELECT *, list_filter([
    CASE WHEN length(order_id) > 10 THEN 'ORDER_ID.max_length' END, CASE WHEN length(customer_id) > 12 THEN 'CUSTOMER_ID.max_length' END,
    CASE WHEN status = '' THEN 'STATUS.required' END, CASE WHEN priority = '' THEN 'PRIORITY.required' END,
    CASE WHEN length(priority) > 6 THEN 'PRIORITY.max_length' END,
    CASE WHEN order_date <> '' AND NOT (regexp_full_match(order_date, '[0-9]{{8}}') AND try_strptime(order_date, '%Y%m%d') IS NOT NULL) THEN 'ORDER_DATE.date' END,
    CASE WHEN net_amount <> '' AND try_cast(net_amount AS DOUBLE) IS NULL THEN 'NET_AMOUNT.decimal' END], lambda x: x IS NOT NULL) AS errors
  FROM translated)"""


def migrated(spark: SparkSession, sf_dir: str) -> migrate.Result:
    """The legacy orders carried through the whole command."""
    path = new_output(spark, "migration")
    rule_documents(spark, sf_dir, f"{path}/rules")
    _, values, _ = metadata.read_transform_rules(spark, f"{path}/rules")
    renamed = F.create_map(F.lit("PRIO"), F.lit("PRIORITY"), F.lit("STATUS"), F.lit("STATUS"))
    columns = ["target_field", "position", "source_value", "target_value"]
    values = values.withColumn("target_field", F.try_element_at(renamed, F.col("target_field"))).select(*columns)
    values = values.unionByName(customer_numbers(spark, sf_dir, "CUSTOMER_ID").select(*columns))
    job = migrate.Job(
        "orders", "legacy", legacy.TARGETS, [m for m in legacy.MAPPING if (m.target, m.source) != ("STATUS", "prio")],
        [Rule("ORDER_ID", key=True, required=True, max_length=10), Rule("CUSTOMER_ID", required=True, max_length=12), Rule("STATUS", required=True),
         Rule("PRIORITY", required=True, max_length=6), Rule("ORDER_DATE", type="date"), Rule("NET_AMOUNT", type="decimal")],
        [FieldTransform("PRIORITY"), FieldTransform("STATUS"), FieldTransform("CUSTOMER_ID"), FieldTransform("REGION", "constant", "EU"),
         FieldTransform("NOTE", "calculated", expression="concat('order ', order_id)")],
        Settings(empty_string_handling="keep"), TEMPLATE, extended=True,
    )
    return migrate.run(legacy.legacy_orders(spark, sf_dir), job, values, f"{path}/out", "20250101_0000", "order_no")


@query(
    "migrate_orders",
    f"""WITH {MIGRATED} SELECT customer_id AS "CUSTOMER_ID(*)", order_id AS "ORDER_ID(k/*)", priority AS "PRIORITY(*)", status AS "STATUS(*)", '' AS "PLANT",
    region AS "REGION", note AS "NOTE", order_date AS "ORDER_DATE" FROM checked WHERE len(errors) = 0""",
)
def migrate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows of the whole command in the template's layout."""
    return migrated(spark, sf_dir).accepted


@query(
    "migrate_rejects",
    f"""WITH {MIGRATED} SELECT order_no AS "__rownum", array_to_string(errors, '|') AS "__errors", errors[1] AS "__first_error",
    customer_id AS "CUSTOMER_ID", priority AS "PRIORITY" FROM checked WHERE len(errors) > 0""",
)
def migrate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrated(spark, sf_dir).rejected.select("__rownum", "__errors", "__first_error", "CUSTOMER_ID", "PRIORITY")


@query(
    "migrate_summary",
    f"""WITH {MIGRATED}, failed AS (SELECT unnest(errors) AS e FROM checked),
    counts AS (SELECT count(*) AS n, count(*) FILTER (len(errors) = 0) AS good FROM checked)
    SELECT 'rows' AS part, unnest(['in', 'out', 'rejected', 'lost']) AS name, unnest([n, good, n - good, 0]) AS n FROM counts
    UNION ALL SELECT 'errors_by_rule', e, count(*) FROM failed GROUP BY e
    UNION ALL SELECT 'errors_by_field', split_part(e, '.', 1), count(*) FROM failed GROUP BY split_part(e, '.', 1)
    UNION ALL SELECT 'warning', w, 1 FROM (SELECT unnest(['missing_source_column regio', 'target_not_in_template NET_AMOUNT', 'target_not_in_template ORDER_TIME']) AS w)""",
)
def migrate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the write itself, and what the plan had to leave out."""
    done = migrated(spark, sf_dir)
    warned = spark.createDataFrame([("warning", f"{kind} {name}", 1) for kind, name in done.warnings], "part string, name string, n long")
    return done.summary.unionByName(warned)


VERSIONS = """
v1 AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS custkey, nullif(o_orderstatus, 'P') AS status, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS price, o_orderpriority AS prio
  FROM orders WHERE NOT (o_orderstatus = 'O' AND o_totalprice > 400000)),
v2 AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS custkey, CASE WHEN o_totalprice > 200000 THEN nullif(o_orderstatus, 'F') ELSE nullif(o_orderstatus, 'P') END AS status,
    CAST(CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(15,2)) AS VARCHAR) AS price, o_orderpriority AS prio
  FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 50000))"""


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the orders: the second lacks cheap finished ones and has further dear open ones; prices and states moved."""
    o = table(spark, sf_dir, "orders")
    state, total, prio = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    usual = F.nullif(state, F.lit("P"))
    shape = lambda status, price: [F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("custkey"), status.alias("status"), price.cast("decimal(15,2)").alias("price"), prio.alias("prio")]
    first = o.filter(~((state == "O") & (total > 400000))).select(*shape(usual, total))
    moved = F.when(prio == "1-URGENT", total + 1).otherwise(total)
    second = o.filter(~((state == "F") & (total < 50000))).select(*shape(F.when(total > 200000, F.nullif(state, F.lit("F"))).otherwise(usual), moved))
    return first, second


@query(
    "version_changes",
    f"""WITH {VERSIONS}, paired AS (SELECT coalesce(v1.k, v2.k) AS k, CASE WHEN v1.k IS NULL THEN 'insert' WHEN v2.k IS NULL THEN 'delete' ELSE 'update' END AS change,
      unnest([{{'field': 'custkey', 'a': v1.custkey, 'b': v2.custkey}}, {{'field': 'status', 'a': v1.status, 'b': v2.status}},
        {{'field': 'price', 'a': v1.price, 'b': v2.price}}, {{'field': 'prio', 'a': v1.prio, 'b': v2.prio}}]) AS e
      FROM v1 FULL JOIN v2 ON v1.k = v2.k)
    SELECT k, change, e.field AS field, e.a AS original, e.b AS transformed FROM paired WHERE e.a IS DISTINCT FROM e.b""",
)
def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log between two versions of the orders."""
    return versions.change_log(*order_versions(spark, sf_dir), ["k"])
