"""Column profiling: counts, quality, numbers, lengths, histograms, top values, samples.

Most figures are read from a long form (field, value, n). ``long_values`` makes it without a
shuffle (n = 1) and suits figures that are plain sums or small counts. ``value_counts`` counts each
distinct value once; distinct counts, top values and whole-table profiles need it and share it. It
combines on the map side, so a constant column sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.functions import parsing
from tablehaul.functions.classify import profile_type_of
from tablehaul.functions.text import is_blank, strip
from tablehaul.operators.project import quoted
from tablehaul.operators.quantiles import exact_quantiles
from tablehaul.session import cut_lineage

NUMERIC_POINTS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
LENGTH_POINTS = {"p50": 0.5, "p95": 0.95}
HISTOGRAM_BINS = 12


def column_types(df: DataFrame, rule_types: dict[str, str] | None = None, only: list[str] | None = None) -> dict[str, str]:
    """Logical type per column from rules, else from its name."""
    given = {k.lower(): v for k, v in (rule_types or {}).items()}
    return {c: profile_type_of(c, given.get(c.lower())) for c in (only or df.columns)}


def _valid(value: Column, kind: str) -> Column:
    blank = is_blank(value)
    if kind == "string":
        return ~blank
    parse = {"decimal": parsing.parse_number, "int": parsing.parse_integer,
             "date": parsing.parse_date, "time": parsing.parse_time}[kind]
    return ~blank & parse(value).isNotNull()


def _per_column(df: DataFrame, columns: list[str], stats) -> DataFrame:
    """One aggregation over all columns in one scan, turned into one row per column."""
    structs = [
        F.struct(F.lit(c).alias("field"), *[v.alias(k) for k, v in stats(c).items()]).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    return df.agg(*structs).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))


def empty_counts(df: DataFrame, columns: list[str] | None = None, missing: list[str] = ()) -> DataFrame:
    """Rows, empty cells and % empty per column; mapped columns the table lacks count as all empty."""
    def stats(c: str) -> dict[str, Column]:
        total = F.count(F.lit(1))
        empty = total if c in missing else F.count_if(is_blank(quoted(c)))
        return {
            "total": total,
            "empty_count": empty,
            "pct_empty": F.when(total > 0, F.bround(empty / total * 100, 2)).otherwise(0.0),
        }

    out = _per_column(df, [*(columns or df.columns), *missing], stats)
    return out.withColumnRenamed("field", "source_header")


def empty_columns(stats: DataFrame) -> DataFrame:
    """Columns without a single value, decided on counts and not on the rounded percentage."""
    return stats.filter(F.col("empty_count") == F.col("total")).select("source_header")


def column_stats(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Total, missing, count and invalid per column."""
    def stats(c: str) -> dict[str, Column]:
        value = quoted(c).cast("string")
        total, missing = F.count(F.lit(1)), F.count_if(is_blank(value))
        return {
            "type": F.lit(types[c]),
            "total": total,
            "missing": missing,
            "count": total - missing,
            "invalid": total - missing - F.count_if(_valid(value, types[c])),
        }

    return _per_column(df, list(types), stats)


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (field, value, n = 1) over text values; nulls stay null."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("field"), quoted(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(entries), F.lit(1).cast("long").alias("n"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form with one row per distinct value."""
    return long_values(df, columns).groupBy("field", "value").agg(F.sum("n").alias("n"))


def present_values(counts: DataFrame) -> DataFrame:
    return counts.filter(~is_blank(F.col("value")))


def distinct_counts(counts: DataFrame) -> DataFrame:
    """Exact distinct non-blank (untrimmed) values per field."""
    return present_values(counts).groupBy("field").agg(F.count(F.lit(1)).alias("unique"))


def quality_score(total: Column, missing: Column, invalid: Column, ratio: Column) -> Column:
    share = lambda c: F.when(total > 0, c / total).otherwise(0.0)
    score = 100 - (share(missing) * 40 + share(invalid) * 40 + (1 - ratio) * 20)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def profile_counts(counts: DataFrame, types: dict[str, str]) -> DataFrame:
    """Counts, distinct, ratios and quality score of every field, all from one long form.

    The scan is read once: each distinct value is classified once and weighted by its count.
    """
    value, n = F.col("value"), F.col("n")
    blank = is_blank(value)
    invalid = F.lit(False)
    for kind in ("decimal", "int", "date", "time"):
        fields = [c for c, t in types.items() if t == kind]
        if fields:
            invalid = F.when(F.col("field").isin(fields), ~blank & ~_valid(value, kind)).otherwise(invalid)
    total, missing = F.sum(n), F.sum(F.when(blank, n).otherwise(0))
    raw = counts.groupBy("field").agg(
        total.alias("total"),
        missing.alias("missing"),
        F.sum(F.when(invalid, n).otherwise(0)).alias("invalid"),
        F.count_if(~blank).alias("unique"),
    )
    figures = ["total", "missing", "invalid", "unique"]
    fields = counts.sparkSession.createDataFrame([(c,) for c in types], "field string")
    raw = fields.join(raw, "field", "left").fillna(0, figures)  # a table without rows has all its fields
    raw = raw.withColumn("count", F.col("total") - F.col("missing"))
    ratio = F.when(F.col("count") > 0, F.col("unique") / F.col("count")).otherwise(0.0)
    pct = lambda c: F.bround(F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(0.0), 2)
    kinds = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return raw.select(
        "field",
        F.element_at(kinds, F.col("field")).alias("type"),
        "count",
        "missing",
        "invalid",
        "unique",
        F.bround(ratio, 4).alias("unique_ratio"),
        F.bround(quality_score(F.col("total"), F.col("missing"), F.col("invalid"), ratio), 2).alias("quality_score"),
        pct("missing").alias("missing_pct"),
        pct("invalid").alias("invalid_pct"),
        F.bround(ratio * 100, 2).alias("unique_pct"),
    )


def top_values(counts: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values per field; equal counts are ordered by value.

    The rank filter lets Spark keep only k rows per field and task before the shuffle.
    """
    order = Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("value"))
    ranked = present_values(counts).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("field", "rank", "value", F.col("n").alias("count"))


def _parsed_numbers(counts: DataFrame, types: dict[str, str]) -> DataFrame:
    """Distinct valid numbers (field, x, n); times count as seconds."""
    value, field = F.col("value"), F.col("field")
    x = F.lit(None).cast("double")
    for kind, parse in (("decimal", parsing.parse_number), ("int", parsing.parse_integer), ("time", parsing.parse_time)):
        fields = [c for c, t in types.items() if t == kind]
        if fields:
            x = F.when(field.isin(fields), parse(value).cast("double")).otherwise(x)
    # The filter looks at an aggregate, so it cannot move below and parse every value twice.
    parsed = counts.select("field", x.alias("x"), "n")
    counted = parsed.groupBy("field", "x").agg(F.sum("n").alias("n"), F.count("x").alias("__present"))
    return counted.filter(F.col("__present") > 0).drop("__present")


def numeric_stats(counts: DataFrame, types: dict[str, str]) -> DataFrame:
    """min, p25, p50, p75, p95, max, mean and sample deviation per number or time column."""
    numbers = _parsed_numbers(counts, types)
    x, n = F.col("x"), F.col("n")
    moments = numbers.groupBy("field").agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.sum(n).alias("rows"), (F.sum(x * n) / F.sum(n)).alias("mean")
    )
    # Second pass around the mean: the plain sum of squares loses digits on large values.
    centred = numbers.join(F.broadcast(moments.select("field", "mean", "rows")), "field")
    spread = centred.groupBy("field").agg(
        F.sqrt(F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))) / F.nullif(F.max("rows") - 1, F.lit(0))).alias("std")
    )
    points = exact_quantiles(numbers, ["field"], "x", "n", NUMERIC_POINTS)
    return moments.join(points, "field").join(spread, "field").select(
        "field", "min", "p25", "p50", "p75", "p95", "max", "mean", "std"
    )


def length_stats(counts: DataFrame) -> DataFrame:
    """Length of non-blank values: min, p50, p95 (whole numbers), max and mean."""
    lengths = present_values(counts).groupBy("field", F.length("value").alias("len")).agg(F.sum("n").alias("n"))
    base = lengths.groupBy("field").agg(
        F.min("len").alias("len_min"),
        F.max("len").alias("len_max"),
        F.bround(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 2).alias("len_mean"),
    )
    points = exact_quantiles(lengths, ["field"], "len", "n", LENGTH_POINTS)
    return base.join(points, "field").select(
        "field", "len_min", F.col("p50").cast("int").alias("len_p50"), F.col("p95").cast("int").alias("len_p95"),
        "len_max", "len_mean",
    )


def text_stats(counts: DataFrame) -> DataFrame:
    """Surrounding white space, case mix and mean digit and letter ratio of non-blank values."""
    s, n = F.col("value"), F.col("n")
    upper = (F.upper(s) == s) & (F.lower(s) != s)
    lower = (F.lower(s) == s) & (F.upper(s) != s)
    rows = F.sum(n)
    share = lambda hit: F.sum(F.when(hit, n).otherwise(0)) / rows
    mean = lambda pattern: F.sum(F.regexp_count(s, F.lit(pattern)) / F.length(s) * n) / rows
    return present_values(counts).groupBy("field").agg(
        F.sum(F.when(strip(s) != s, n).otherwise(0)).alias("leading_or_trailing"),
        F.bround(share(upper), 4).alias("upper_ratio"),
        F.bround(share(lower), 4).alias("lower_ratio"),
        F.bround(1 - share(upper) - share(lower), 4).alias("mixed_ratio"),
        F.bround(mean(r"\p{Nd}"), 4).alias("digit_ratio"),
        F.bround(mean("[A-Za-z]"), 4).alias("alpha_ratio"),
    )


def date_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last valid date per column as eight digits."""
    def stats(c: str) -> dict[str, Column]:
        day = parsing.parse_date(quoted(c))
        return {"min": parsing.format_date(F.min(day)), "max": parsing.format_date(F.max(day))}

    return _per_column(df, columns, stats)


def time_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last valid time per column as six digits."""
    def stats(c: str) -> dict[str, Column]:
        seconds = parsing.parse_time(quoted(c))
        return {"min": parsing.format_time(F.min(seconds)), "max": parsing.format_time(F.max(seconds))}

    return _per_column(df, columns, stats)


def _edge(i: int, low: Column, high: Column) -> Column:
    if i == HISTOGRAM_BINS:
        return high
    return low + i * ((high - low) / HISTOGRAM_BINS)


def _equal_width(counted: DataFrame, x: str) -> DataFrame:
    """Twelve equal bins from the minimum to the maximum per field; constant data widens by 0.5.

    A value belongs to the last bin whose lower edge it reaches, so the top edge is closed.
    """
    span = counted.groupBy("field").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    same = F.col("lo") == F.col("hi")
    span = span.select(
        "field",
        F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double")).alias("lo"),
        F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi").cast("double")).alias("hi"),
    )
    low, high = F.col("lo"), F.col("hi")
    number = F.lit(1)
    for i in range(1, HISTOGRAM_BINS):
        number = number + (F.col(x) >= _edge(i, low, high)).cast("int")
    # One row per field on the small side: bounded by the number of columns.
    filled = counted.join(F.broadcast(span), "field").groupBy("field", number.alias("bin")).agg(F.sum("n").alias("count"))
    edges = F.array(
        *[
            F.struct(F.lit(i + 1).alias("bin"), _edge(i, low, high).alias("bin_low"), _edge(i + 1, low, high).alias("bin_high"))
            for i in range(HISTOGRAM_BINS)
        ]
    )
    every = span.select("field", F.inline(edges))
    return every.join(filled, ["field", "bin"], "left").select(
        "field", "bin", "bin_low", "bin_high", F.coalesce("count", F.lit(0).cast("long")).alias("count")
    )


def numeric_histogram(counts: DataFrame, types: dict[str, str]) -> DataFrame:
    numeric = {c: t for c, t in types.items() if t in ("int", "decimal")}
    return _equal_width(_parsed_numbers(counts, numeric), "x")


def length_histogram(counts: DataFrame) -> DataFrame:
    """Over the length of every non-null value, blanks included."""
    lengths = counts.filter(F.col("value").isNotNull()).groupBy("field", F.length("value").alias("len")).agg(F.sum("n").alias("n"))
    return _equal_width(lengths, "len")


def with_number_labels(histogram: DataFrame) -> DataFrame:
    return histogram.withColumn("label", F.format_string("%.2f-%.2f", "bin_low", "bin_high"))


def with_length_labels(histogram: DataFrame) -> DataFrame:
    """Whole-number labels; narrow bins may repeat one."""
    whole = lambda c: F.col(c).cast("int").cast("string")
    return histogram.withColumn("label", F.concat_ws("-", whole("bin_low"), whole("bin_high")))


def month_histogram(counts: DataFrame, columns: list[str], months: int = 24) -> DataFrame:
    """The most frequent months per date column, to be shown in month order."""
    day = parsing.parse_date(F.col("value"))
    by_month = (
        counts.filter(F.col("field").isin(columns) & day.isNotNull())
        .groupBy("field", F.date_format(day, "yyyy-MM").alias("month"))
        .agg(F.sum("n").alias("count"))
    )
    order = Window.partitionBy("field").orderBy(F.col("count").desc(), F.col("month"))
    ranked = by_month.withColumn("__rank", F.row_number().over(order))
    return ranked.filter(F.col("__rank") <= months).drop("__rank")


def time_histogram(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Twelve bins of two hours per time column, empty bins included."""
    seconds = parsing.parse_time(F.col("value"))
    some = counts.filter(F.col("field").isin(columns) & seconds.isNotNull()).select("field", seconds.alias("s"), "n")
    at = lambda hour: F.when(F.floor(F.col("s") / 7200) == hour, F.col("n")).otherwise(0)
    wide = some.groupBy("field").agg(*[F.sum(at(h)).alias(f"h{h}") for h in range(12)])
    bins = F.array(
        *[
            F.struct(F.lit(f"{2 * h:02d}:00-{2 * h + 2:02d}:00").alias("label"), F.col(f"h{h}").alias("count"))
            for h in range(12)
        ]
    )
    return wide.select("field", F.inline(bins))


def sample_values(df: DataFrame, columns: list[str], order_by: str, k: int = 5) -> DataFrame:
    """The first k distinct non-blank values per column in row order."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("field"), quoted(c).cast("string").alias("value")) for c in columns]
    )
    first = (
        df.select(quoted(order_by).alias("__at"), F.inline(entries))
        .filter(~is_blank(F.col("value")))
        .groupBy("field", "value")
        .agg(F.min("__at").alias("first_row"))
    )
    order = Window.partitionBy("field").orderBy("first_row", "value")
    ranked = first.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("field", "rank", "value", "first_row")


def describe_columns(df: DataFrame, order_by: str, columns: list[str] | None = None) -> DataFrame:
    """Source catalogue rows: ordinal, first example, nullability. One aggregation, no shuffle of rows."""
    names = columns or [c for c in df.columns if c != order_by]

    def stats(c: str) -> dict[str, Column]:
        value = strip(quoted(c).cast("string"))
        blank = is_blank(value)
        example = F.min_by(F.when(~blank, value), F.when(~blank, quoted(order_by)))
        return {
            "description": F.lit(None).cast("string"),
            "example": example,
            "ordinal": F.lit(names.index(c) + 1),
            "dtype": F.lit("string"),
            "nullable": example.isNull() | (F.count_if(blank) > 0),
        }

    return _per_column(df, names, stats).withColumnRenamed("field", "field_name")


def sample_rows(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Optional row sample with a fixed seed; every figure above reads all rows without it."""
    return df.sample(fraction, seed)


def profile_table(df: DataFrame, rule_types: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Counts and quality plus the number or length figures of every column, one row each.

    The long form is read once and shared by all parts.
    """
    types = column_types(df, rule_types, columns)
    counts = value_counts(df, list(types))
    base = profile_counts(counts, types)
    text_fields = [c for c, t in types.items() if t == "string"]
    lengths = length_stats(counts.filter(F.col("field").isin(text_fields)))
    numbers = numeric_stats(counts, types)
    return base.join(numbers, "field", "left").join(lengths, "field", "left")


def profile_record(df: DataFrame, rule_types: dict[str, str] | None = None, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """The whole record of every column, one row each: counts and quality, ``top_values``, ``histogram`` and, by type,
    ``length``, ``whitespace``, ``case_mix``, ``characters``, ``numeric`` (times as seconds) and ``span`` (first and last date or time).

    The distinct values are counted once and stored; every part is an aggregation over them. Lists hold ``k`` values and a
    histogram's bins, so a row stays small. Parts that a type does not have, or a column without values, are null or empty.
    """
    types = column_types(df, rule_types, columns)
    counts = cut_lineage(value_counts(df, list(types)))
    of = lambda *kinds: [c for c, t in types.items() if t in kinds]
    texts = counts.filter(F.col("field").isin(of("string")))

    def listed(rows: DataFrame, name: str, *parts: str) -> DataFrame:
        return rows.groupBy("field").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias(name))

    in_order = F.format_string("%02d", "bin").alias("at")
    bins = with_number_labels(numeric_histogram(counts, types)).select("field", in_order, "label", "count")
    bins = bins.unionByName(with_length_labels(length_histogram(texts)).select("field", in_order, "label", "count"))
    bins = bins.unionByName(month_histogram(counts, of("date")).select("field", F.col("month").alias("at"), F.col("month").alias("label"), "count"))
    bins = bins.unionByName(time_histogram(counts, of("time")).select("field", F.col("label").alias("at"), "label", "count"))
    histogram = listed(bins, "histogram", "at", "label", "count")
    histogram = histogram.select("field", F.transform("histogram", lambda b: F.struct(b["label"].alias("label"), b["count"].alias("count"))).alias("histogram"))
    day, seconds = parsing.parse_date(F.col("value")), parsing.parse_time(F.col("value"))
    days = counts.filter(F.col("field").isin(of("date"))).groupBy("field").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    times = counts.filter(F.col("field").isin(of("time"))).groupBy("field").agg(F.min(seconds).alias("a"), F.max(seconds).alias("b"))
    span = lambda form: F.struct(form(F.col("a")).alias("min"), form(F.col("b")).alias("max")).alias("span")
    spans = days.select("field", span(parsing.format_date)).unionByName(times.select("field", span(parsing.format_time)))
    lengths = length_stats(texts).select("field", F.struct(*[F.col(f"len_{n}").alias(n) for n in ("min", "p50", "p95", "max", "mean")]).alias("length"))
    mix = text_stats(texts).select(
        "field", F.struct("leading_or_trailing").alias("whitespace"), F.struct("upper_ratio", "lower_ratio", "mixed_ratio").alias("case_mix"),
        F.struct("digit_ratio", "alpha_ratio").alias("characters"),
    )
    numeric = numeric_stats(counts, types).select("field", F.struct("min", "p25", "p50", "p75", "p95", "max", "mean", "std").alias("numeric"))
    out = profile_counts(counts, types)
    for part in (listed(top_values(counts, k), "top_values", "rank", "value", "count"), histogram, lengths, mix, numeric, spans):
        out = out.join(part, "field", "left")
    return out
