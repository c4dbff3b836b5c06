"""Column statistics, quality, histograms and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul import sinks
from tablehaul.operators import profile, report, sketches
from tablehaul.operators.project import missing_sources
from tablehaul.plans import legacy
from tablehaul.plans.registry import query, table
from tablehaul.session import cut_lineage, new_output

TYPES = {
    "custnr": "int",
    "status": "string",
    "prio": "string",
    "orddate": "date",
    "total": "decimal",
    "ordtime": "time",
    "remark": "string",
}


def long_sql(source: str, columns: list[str], as_text: bool = False) -> str:
    value = "CAST({c} AS VARCHAR)" if as_text else "{c}"
    return " UNION ALL ".join(f"SELECT '{c}' AS field, {value.format(c=c)} AS value FROM {source}" for c in columns)


def _stats_sql(columns: list[str], missing: list[str] = ()) -> str:
    parts = [
        f"SELECT '{c}' AS source_header, count(*) AS total, count(*) FILTER (coalesce(trim({c}), '') = '') AS empty_count FROM legacy"
        for c in columns
    ]
    parts += [f"SELECT '{c}', count(*), count(*) FROM legacy" for c in missing]
    return " UNION ALL ".join(parts)


RAW_COLUMNS = ["ordernr", *TYPES]


@query(
    "raw_column_stats",
    f"WITH {legacy.LEGACY}, s AS ({_stats_sql(RAW_COLUMNS, ['regio'])}) SELECT *, round_even(empty_count / total * 100, 2) AS pct_empty FROM s",
)
def raw_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = legacy.legacy_orders(spark, sf_dir)
    return profile.empty_counts(raw, RAW_COLUMNS, missing_sources(raw, legacy.MAPPING))


@query(
    "empty_columns",
    f"WITH {legacy.LEGACY}, s AS ({_stats_sql(RAW_COLUMNS, ['regio'])}) SELECT source_header FROM s WHERE empty_count = total",
)
def empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.empty_columns(raw_column_stats(spark, sf_dir))


@query(
    "top_null_rates",
    f"""WITH {legacy.LEGACY}, s AS ({_stats_sql(RAW_COLUMNS, ['regio'])})
    SELECT source_header, round_even(empty_count / total * 100, 2) AS pct_empty FROM s ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_rows(raw_column_stats(spark, sf_dir).select("source_header", "pct_empty"), "source_header", "pct_empty")


# Parsed value and validity per type, as the profile defines them.
PARSED = f"""
long AS ({long_sql('legacy', list(TYPES))}),
parsed AS (
  SELECT field, value, coalesce(trim(value), '') = '' AS blank,
    CASE WHEN field = 'custnr' THEN 'int' WHEN field = 'orddate' THEN 'date' WHEN field = 'total' THEN 'decimal'
         WHEN field = 'ordtime' THEN 'time' ELSE 'string' END AS type,
    CASE WHEN field IN ('custnr', 'total') THEN try_cast(trim(value) AS DOUBLE)
         WHEN field = 'ordtime' AND regexp_full_match(trim(value), '([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]')
           THEN CAST(value[1:2] AS INT) * 3600 + CAST(value[3:4] AS INT) * 60 + CAST(value[5:6] AS INT) END AS x,
    CASE WHEN field = 'orddate' AND regexp_full_match(value, '[0-9]{{8}}') THEN try_strptime(value, '%Y%m%d') END AS d
  FROM long),
valid AS (
  SELECT *, CASE WHEN blank THEN false WHEN type = 'string' THEN true WHEN type = 'date' THEN d IS NOT NULL
    WHEN type = 'int' THEN coalesce(x = floor(x), false) ELSE x IS NOT NULL END AS ok FROM parsed)"""

COUNTS_SQL = f"""WITH {legacy.LEGACY}, {PARSED}, c AS (
  SELECT field, type, count(*) AS total, count(*) FILTER (NOT blank) AS "count", count(*) FILTER (blank) AS missing,
    count(*) FILTER (NOT blank AND NOT ok) AS invalid, count(DISTINCT value) FILTER (NOT blank) AS "unique"
  FROM valid GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN "count" > 0 THEN "unique" / "count" ELSE 0 END AS ratio FROM c)
SELECT field, type, "count", missing, invalid, "unique", round_even(ratio, 4) AS unique_ratio,
  round_even(greatest(0, least(100, 100 - (missing / total * 40 + invalid / total * 40 + (1 - ratio) * 20))), 2) AS quality_score,
  round_even(missing / total * 100, 2) AS missing_pct, round_even(invalid / total * 100, 2) AS invalid_pct, round_even(ratio * 100, 2) AS unique_pct
FROM r"""


@query("profile_quality", COUNTS_SQL)
def profile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_counts(profile.value_counts(legacy.legacy_orders(spark, sf_dir), list(TYPES)), TYPES)


@query(
    "profile_counts",
    f"""WITH {legacy.LEGACY}, {PARSED} SELECT field, type, count(*) AS total, count(*) FILTER (blank) AS missing,
    count(*) FILTER (NOT blank) AS "count", count(*) FILTER (NOT blank AND NOT ok) AS invalid FROM valid GROUP BY 1, 2""",
)
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_stats(legacy.legacy_orders(spark, sf_dir), TYPES)


def _numeric_sql(rows: str) -> str:
    q = ", ".join(f"round_even(quantile_cont(x, {p}), 4) AS {n}" for n, p in profile.NUMERIC_POINTS.items())
    return f"""SELECT field, min(x) AS min, {q}, max(x) AS max, round_even(avg(x), 4) AS mean,
    round_even(stddev_samp(x), 4) AS std FROM {rows} WHERE x IS NOT NULL GROUP BY field"""


def _rounded(stats: DataFrame) -> DataFrame:
    exact = ("field", "min", "max")
    return stats.select(*[c if c in exact else F.bround(c, 4).alias(c) for c in stats.columns])


@query("profile_numeric", f"WITH {legacy.LEGACY}, {PARSED} " + _numeric_sql("valid"))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = profile.long_values(legacy.legacy_orders(spark, sf_dir), ["custnr", "total", "ordtime"])
    return _rounded(profile.numeric_stats(values, TYPES))


LINE_NUMBERS = {c: "decimal" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}


@query(
    "profile_numeric_lines",
    "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS x FROM lineitem" for c in LINE_NUMBERS) + ") " + _numeric_sql("v"),
)
def profile_numeric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.numeric_stats(profile.long_values(table(spark, sf_dir, "lineitem"), list(LINE_NUMBERS)), LINE_NUMBERS))


TEXTS = {"part": ["p_name", "p_brand", "p_type"], "customer": ["c_name", "c_mktsegment"], "pages": ["url"]}
TEXT_SQL = " UNION ALL ".join(long_sql(t, c) for t, c in TEXTS.items())
# Untidy versions of the same values: padding and case that depend on the value itself.
UNTIDY_SQL = f"""text AS (SELECT field, CASE WHEN value LIKE '%r%' THEN upper(value) WHEN value LIKE '%1%' THEN value || ' '
  WHEN value LIKE 'E%' THEN lower(value) ELSE value END AS value FROM ({TEXT_SQL}))"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [profile.long_values(table(spark, sf_dir, t), c) for t, c in TEXTS.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    v = F.col("value")
    untidy = (
        F.when(v.contains("r"), F.upper(v)).when(v.contains("1"), F.concat(v, F.lit(" ")))
        .when(v.startswith("E"), F.lower(v)).otherwise(v)
    )
    return rows.withColumn("value", untidy)


@query(
    "profile_length",
    f"""WITH {UNTIDY_SQL} SELECT field, CAST(min(length(value)) AS INT) AS len_min, CAST(floor(quantile_cont(length(value), 0.5)) AS INT) AS len_p50,
    CAST(floor(quantile_cont(length(value), 0.95)) AS INT) AS len_p95, CAST(max(length(value)) AS INT) AS len_max,
    round_even(avg(length(value)), 2) AS len_mean FROM text WHERE trim(value) <> '' GROUP BY 1""",
)
def profile_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.length_stats(_texts(spark, sf_dir))


@query(
    "profile_text",
    f"""WITH {UNTIDY_SQL}, u AS (SELECT *, upper(value) = value AND lower(value) <> value AS up, lower(value) = value AND upper(value) <> value AS low FROM text WHERE trim(value) <> '')
    SELECT field, count(*) FILTER (trim(value) <> value) AS leading_or_trailing,
    round_even(count(*) FILTER (up) / count(*), 4) AS upper_ratio, round_even(count(*) FILTER (low) / count(*), 4) AS lower_ratio,
    round_even(1 - count(*) FILTER (up) / count(*) - count(*) FILTER (low) / count(*), 4) AS mixed_ratio,
    round_even(avg(len(regexp_extract_all(value, '[0-9]')) / length(value)), 4) AS digit_ratio,
    round_even(avg(len(regexp_extract_all(value, '[A-Za-z]')) / length(value)), 4) AS alpha_ratio FROM u GROUP BY 1""",
)
def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.text_stats(_texts(spark, sf_dir))


def _event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.date_format("ts", "yyyyMMdd").alias("day"), F.date_format("ts", "HHmmss").alias("tod"))


EVENT_TIMES = "e AS (SELECT strftime(ts, '%Y%m%d') AS day, strftime(ts, '%H%M%S') AS tod FROM events)"


@query(
    "profile_date",
    f"""WITH {legacy.LEGACY}, {EVENT_TIMES}
    SELECT 'orddate' AS field, min(orddate) AS min, max(orddate) AS max FROM legacy WHERE orddate <> 'unknown'
    UNION ALL SELECT 'day', min(day), max(day) FROM e""",
)
def profile_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = profile.date_stats(legacy.legacy_orders(spark, sf_dir), ["orddate"])
    return orders.unionByName(profile.date_stats(_event_times(spark, sf_dir), ["day"]))


@query(
    "profile_time",
    f"""WITH {legacy.LEGACY}, {EVENT_TIMES}
    SELECT 'ordtime' AS field, min(ordtime) AS min, max(ordtime) AS max FROM legacy WHERE ordtime <> '240000'
    UNION ALL SELECT 'tod', min(tod), max(tod) FROM e""",
)
def profile_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = profile.time_stats(legacy.legacy_orders(spark, sf_dir), ["ordtime"])
    return orders.unionByName(profile.time_stats(_event_times(spark, sf_dir), ["tod"]))


def _histogram_sql(rows: str) -> str:
    edges = " + ".join(f"CAST(x >= lo + {i} * ((hi - lo) / 12) AS INT)" for i in range(1, 12))
    return f"""SELECT field, bin, round_even(lo + (bin - 1) * ((hi - lo) / 12), 6) AS bin_low,
      CASE WHEN bin = 12 THEN hi ELSE round_even(lo + bin * ((hi - lo) / 12), 6) END AS bin_high, coalesce(n, 0) AS "count"
    FROM (SELECT field, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
            CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM {rows} WHERE x IS NOT NULL GROUP BY field)
    CROSS JOIN (SELECT unnest(range(1, 13))::INT AS bin)
    LEFT JOIN (SELECT field, 1 + {edges} AS bin, count(*) AS n FROM {rows} JOIN
      (SELECT field, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
            CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM {rows} WHERE x IS NOT NULL GROUP BY field) USING (field)
      WHERE x IS NOT NULL GROUP BY 1, 2) USING (field, bin)"""


def _rounded_edges(histogram: DataFrame) -> DataFrame:
    return histogram.withColumns({"bin_low": F.bround("bin_low", 6), "bin_high": F.bround("bin_high", 6)})


@query(
    "hist_numeric",
    f"WITH {legacy.LEGACY}, {PARSED}, h AS (SELECT field, x FROM valid WHERE field IN ('custnr', 'total')) " + _histogram_sql("h"),
)
def hist_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = profile.long_values(legacy.legacy_orders(spark, sf_dir), ["custnr", "total"])
    return _rounded_edges(profile.numeric_histogram(values, TYPES))


@query(
    "hist_length",
    f"""WITH {legacy.LEGACY}, h AS (SELECT 'text' AS field, CAST(length(text) AS DOUBLE) AS x FROM documents
    UNION ALL SELECT 'prio', length(prio) FROM legacy UNION ALL SELECT 'remark', length(remark) FROM legacy WHERE remark IS NOT NULL) """
    + _histogram_sql("h"),
)
def hist_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = profile.long_values(table(spark, sf_dir, "documents"), ["text"])
    orders = profile.long_values(legacy.legacy_orders(spark, sf_dir), ["prio", "remark"])
    return _rounded_edges(profile.length_histogram(texts.unionByName(orders)))


@query(
    "hist_month",
    f"""WITH {legacy.LEGACY}, {EVENT_TIMES}, m AS (
      SELECT 'orddate' AS field, orddate[1:4] || '-' || orddate[5:6] AS month FROM legacy WHERE orddate <> 'unknown'
      UNION ALL SELECT 'day', day[1:4] || '-' || day[5:6] FROM e),
    c AS (SELECT field, month, count(*) AS "count" FROM m GROUP BY 1, 2)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY "count" DESC, month) <= 24""",
)
def hist_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = profile.long_values(legacy.legacy_orders(spark, sf_dir), ["orddate"])
    events = profile.long_values(_event_times(spark, sf_dir), ["day"])
    return profile.month_histogram(orders.unionByName(events), ["orddate", "day"])


@query(
    "hist_time",
    f"""WITH {legacy.LEGACY}, {EVENT_TIMES}, t AS (SELECT 'ordtime' AS field, ordtime AS v FROM legacy WHERE ordtime <> '240000' UNION ALL SELECT 'tod', tod FROM e),
    c AS (SELECT field, CAST(v[1:2] AS INT) // 2 AS b, count(*) AS n FROM t GROUP BY 1, 2)
    SELECT field, lpad(CAST(b * 2 AS VARCHAR), 2, '0') || ':00-' || lpad(CAST(b * 2 + 2 AS VARCHAR), 2, '0') || ':00' AS label, coalesce(n, 0) AS "count"
    FROM (SELECT DISTINCT field FROM t) CROSS JOIN (SELECT unnest(range(0, 12))::INT AS b) LEFT JOIN c USING (field, b)""",
)
def hist_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = profile.long_values(legacy.legacy_orders(spark, sf_dir), ["ordtime"])
    events = profile.long_values(_event_times(spark, sf_dir), ["tod"])
    return profile.time_histogram(orders.unionByName(events), ["ordtime", "tod"])


TOP = {"events": ["event_type", "user_id", "props"], "orders": ["o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey"]}
TOP_SQL = " UNION ALL ".join(long_sql(t, c, as_text=True) for t, c in TOP.items())
RANKED_SQL = f"""WITH l AS ({TOP_SQL}), c AS (SELECT field, value, count(*) AS "count" FROM l WHERE trim(value) <> '' GROUP BY 1, 2)
  SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY "count" DESC, value) AS INT) AS rank, value, "count" FROM c QUALIFY rank <= 10"""


@query("top_values", RANKED_SQL)
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [profile.value_counts(table(spark, sf_dir, t), c) for t, c in TOP.items()]
    return profile.top_values(parts[0].unionByName(parts[1]))


@query("export_top_values", f"""SELECT value AS "Value", "count" AS "Count" FROM ({RANKED_SQL}) WHERE field = 'o_custkey'""")
def export_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top values of one field, written as a file and read back."""
    path = new_output(spark, "top_values")
    sinks.write_load_file(sinks.top_values_export(top_values(spark, sf_dir), "o_custkey"), path)
    return spark.read.options(header=True).csv(path).select("Value", F.col("Count").cast("long").alias("Count"))


@query(
    "export_profile",
    COUNTS_SQL.replace("SELECT field, type, \"count\", missing", "SELECT field AS \"Field\", type AS \"Type\", \"count\" AS \"Count\", missing AS \"Missing\"")
    .replace("invalid, \"unique\", round_even(ratio, 4) AS unique_ratio,", "invalid AS \"Invalid\", \"unique\" AS \"Unique\",")
    .replace("AS quality_score", "AS \"Quality Score\"").replace("AS missing_pct", "AS \"Missing %\"")
    .replace("AS invalid_pct", "AS \"Invalid %\"").replace("AS unique_pct", "AS \"Unique %\""),
)
def export_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile in export layout, written as a file and read back."""
    path = new_output(spark, "profile")
    wanted = sinks.profile_export(profile_quality(spark, sf_dir))
    sinks.write_load_file(wanted, path)
    back = spark.read.options(header=True).csv(path)
    return back.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.schema])


@query(
    "sample_values",
    f"""WITH l AS (SELECT p_partkey, unnest([{{'field': 'p_name', 'value': p_name}}, {{'field': 'p_brand', 'value': p_brand}}, {{'field': 'p_type', 'value': p_type}}], recursive := true) FROM part),
    f AS (SELECT field, value, min(p_partkey) AS first_row FROM l GROUP BY 1, 2)
    SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY first_row, value) AS INT) AS rank, value, first_row FROM f QUALIFY rank <= 5""",
)
def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_values(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], "p_partkey")


PAIRS = [(m.target, m.source) for m in legacy.MAPPING if m.source and (m.target, m.source) != ("STATUS", "prio")]
SAMPLED = {"source": ["ordernr", "custnr", "status", "prio", "orddate", "total", "ordtime"], "target": [t.lower() for t in legacy.TARGETS]}


def _samples_sql(source: str, columns: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, order_no FROM {source}" for c in columns)
    return f"""SELECT field, list(value ORDER BY k) AS samples FROM (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY min(order_no), value) AS k
      FROM ({rows}) WHERE trim(value) <> '' GROUP BY field, value) WHERE k <= 5 GROUP BY 1"""


@query(
    "mapping_samples",
    f"""WITH {legacy.MAPPED}, m(target_field, source_header) AS (VALUES {", ".join(f"('{t}', '{s}')" for t, s in PAIRS)}),
    a AS ({_samples_sql("legacy", SAMPLED["source"])}), b AS ({_samples_sql("mapped", SAMPLED["target"])})
    SELECT target_field, source_header, coalesce(a.samples, []) AS source_samples, coalesce(b.samples, []) AS target_samples
    FROM m LEFT JOIN a ON a.field = source_header LEFT JOIN b ON b.field = lower(target_field)""",
)
def mapping_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame(PAIRS, "target_field string, source_header string")
    before = profile.sample_values(legacy.legacy_orders(spark, sf_dir), SAMPLED["source"], "order_no")
    after = profile.sample_values(legacy.mapped_orders(spark, sf_dir), SAMPLED["target"], "order_no")
    return report.mapping_with_samples(mapping, before, after)


FIRST_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS field_name, CAST(NULL AS VARCHAR) AS description, arg_min(trim({c}), order_no) FILTER (trim({c}) <> '') AS example,
    {i} AS ordinal, 'string' AS dtype, count(*) FILTER (coalesce(trim({c}), '') = '') > 0 AS nullable FROM legacy"""
    for i, c in enumerate(RAW_COLUMNS, 1)
)


@query("first_example", f"WITH {legacy.LEGACY} {FIRST_SQL}")
def first_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe_columns(legacy.legacy_orders(spark, sf_dir), "order_no", RAW_COLUMNS)


@query(
    "profile_table",
    f"""WITH counts AS ({COUNTS_SQL}), {legacy.LEGACY}, {PARSED}, numbers AS ({_numeric_sql("valid")}),
    lengths AS (SELECT field, CAST(min(length(value)) AS INT) AS len_min, CAST(floor(quantile_cont(length(value), 0.5)) AS INT) AS len_p50,
      CAST(floor(quantile_cont(length(value), 0.95)) AS INT) AS len_p95, CAST(max(length(value)) AS INT) AS len_max,
      round_even(avg(length(value)), 2) AS len_mean FROM valid WHERE NOT blank AND type = 'string' GROUP BY 1)
    SELECT * FROM counts LEFT JOIN numbers USING (field) LEFT JOIN lengths USING (field)""",
)
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = profile.profile_table(legacy.legacy_orders(spark, sf_dir), TYPES, list(TYPES))
    rounded = ("p25", "p50", "p75", "p95", "mean", "std")
    return whole.select(*[F.bround(c, 4).alias(c) if c in rounded else c for c in whole.columns])


@query(
    "key_figures",
    f"""WITH {legacy.CHECKED}, c AS (SELECT count(*) AS i, count(*) FILTER (len(errors) = 0) AS o, count(*) FILTER (len(errors) > 0) AS r FROM checked)
    SELECT unnest([{{'position': 1, 'label': 'Rows In', 'value': CAST(i AS VARCHAR)}}, {{'position': 2, 'label': 'Rows Out', 'value': CAST(o AS VARCHAR)}},
      {{'position': 3, 'label': 'Rejected', 'value': CAST(r AS VARCHAR)}}], recursive := true) FROM c""",
)
def key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablehaul.operators.validate import in_out_counts

    row = in_out_counts(legacy.checked_orders(spark, sf_dir))
    return report.key_figures(row, {"Rows In": F.col("rows_in"), "Rows Out": F.col("rows_out"), "Rejected": F.col("rows_rejected")})


@query(
    "sketched_profile",
    """SELECT 'o_custkey' AS field, count(o_custkey) AS "rows", count(DISTINCT o_custkey) AS distinct_values, true AS distinct_within, true AS median_within FROM orders
    UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(DISTINCT o_totalprice), true, true FROM orders
    UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(DISTINCT o_orderstatus), true, NULL FROM orders""",
)
def sketched_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures from states kept by month and merged, held against exact ones: distinct counts within 7 %, medians within 4 % of the rows."""
    orders, columns, numeric = table(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice", "o_orderstatus"], ["o_custkey", "o_totalprice"]
    states = cut_lineage(sketches.period_states(orders, F.date_format("o_orderdate", "yyyy-MM"), columns, numeric))
    found = sketches.estimates(sketches.merge_states(states))
    exact = profile.long_values(orders, columns).groupBy("field").agg(F.countDistinct("value").alias("distinct_values"))
    numbers = orders.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in numeric])))
    below = numbers.join(F.broadcast(found.select("field", "p50")), "field").groupBy("field").agg(
        (F.count_if(F.col("x") < F.col("p50")) / F.count("x")).alias("low"), (F.count_if(F.col("x") <= F.col("p50")) / F.count("x")).alias("high")
    )
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_values")) <= 0.07 * F.col("distinct_values")
    joined = found.join(exact, "field").join(below, "field", "left")
    return joined.select("field", "rows", "distinct_values", near.alias("distinct_within"), ((F.col("low") <= 0.54) & (F.col("high") >= 0.46)).alias("median_within"))


@query(
    "profile_record",
    f"""{COUNTS_SQL.replace('SELECT field, type, "count"', ', base AS (SELECT field, type, "count"').replace("FROM r", "FROM r)", 1)},
    tops AS (SELECT field, value, count(*) AS n FROM valid WHERE NOT blank GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) = 1),
    months AS (SELECT field, strftime(d, '%Y-%m') AS label, count(*) AS n FROM valid WHERE d IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, label) <= 24),
    bins AS (SELECT field, CAST(12 AS BIGINT) AS n_bins, CAST(count(x) AS BIGINT) AS binned FROM valid WHERE type IN ('int', 'decimal', 'time') GROUP BY 1
      UNION ALL SELECT field, 12, count(value) FROM valid WHERE type = 'string' GROUP BY 1 UNION ALL SELECT field, count(*), sum(n) FROM months GROUP BY 1),
    texts AS (SELECT field, CAST(floor(quantile_cont(length(value), 0.95)) AS INT) AS len_p95, count(*) FILTER (trim(value) <> value) AS padded,
      round_even(count(*) FILTER (upper(value) = value AND lower(value) <> value) / count(*), 4) AS upper_ratio,
      round_even(avg(len(regexp_extract_all(value, '[0-9]')) / length(value)), 4) AS digit_ratio FROM valid WHERE type = 'string' AND NOT blank GROUP BY 1),
    numbers AS (SELECT field, round_even(quantile_cont(x, 0.5), 4) AS p50, round_even(stddev_samp(x), 4) AS std FROM valid WHERE x IS NOT NULL GROUP BY 1),
    spans AS (SELECT field, min(trim(value)) AS "first", max(trim(value)) AS "last" FROM valid WHERE type IN ('date', 'time') AND ok GROUP BY 1)
    SELECT field, type, "unique", quality_score, tops.value AS top_value, tops.n AS top_count, n_bins, binned, len_p95, padded, upper_ratio, digit_ratio, p50, std, "first", "last"
    FROM base LEFT JOIN tops USING (field) LEFT JOIN bins USING (field) LEFT JOIN texts USING (field) LEFT JOIN numbers USING (field) LEFT JOIN spans USING (field)""",
)
def profile_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of the record of every column, one figure or two of each."""
    rows = profile.profile_record(legacy.legacy_orders(spark, sf_dir), TYPES, list(TYPES))
    top, bins = F.try_element_at("top_values", F.lit(1)), F.col("histogram")
    return rows.select(
        "field", "type", "unique", "quality_score", top["value"].alias("top_value"), top["count"].alias("top_count"), F.size(bins).cast("long").alias("n_bins"),
        F.aggregate(bins, F.lit(0).cast("long"), lambda a, b: a + b["count"]).alias("binned"), F.col("length.p95").alias("len_p95"),
        F.col("whitespace.leading_or_trailing").alias("padded"), "case_mix.upper_ratio", "characters.digit_ratio", F.bround("numeric.p50", 4).alias("p50"),
        F.bround("numeric.std", 4).alias("std"), F.col("span.min").alias("first"), F.col("span.max").alias("last"),
    )
