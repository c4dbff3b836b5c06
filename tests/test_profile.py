import numpy as np
import pytest

from tablehaul.operators import profile, quantiles
from tablehaul.operators.quantiles import exact_quantiles


def column(frame, items, name="v"):
    return frame([(i,) for i in items], f"{name} string")


def counted(frame, items, kind):
    df = column(frame, items)
    counts = profile.value_counts(df, ["v"])
    return counts, profile.profile_counts(counts, {"v": kind}).first()


def test_text_column(frame):
    """Blank cells are missing; white space around a value makes it another value."""
    counts, row = counted(frame, ["Oslo", "\t", "Oslo", "Oslo", " Oslo", "Reykjavik", "Bern ", None, None, "Ulm", "Ulm", "x"], "string")
    assert (row["count"], row.missing, row.invalid, row.unique, row.unique_ratio) == (9, 3, 0, 6, 0.6667)
    lengths = profile.length_stats(counts).first()
    assert (lengths.len_min, lengths.len_max) == (1, 9)
    assert profile.text_stats(counts).first().leading_or_trailing == 2
    assert [(r.value, r["count"]) for r in profile.top_values(counts, 2).orderBy("rank").collect()] == [("Oslo", 3), ("Ulm", 2)]


@pytest.mark.parametrize(
    "items,kind,want",
    [
        (["-7", "1e3", ".25", "1,5", "12 kg", " ", None, None], "decimal", (5, 3, 2)),
        (["40", "4.0", "4.1", "99999999999999999999", "-0", "four", ""], "int", (6, 1, 2)),
        (["19991231", "20000230", "2000-01-01", "99991231", None], "date", (4, 1, 2)),
        (["000000", "235959", "240000", "126000", "1200", " ", "010203"], "time", (6, 1, 3)),
    ],
)
def test_typed_columns(frame, items, kind, want):
    _, row = counted(frame, items, kind)
    assert (row["count"], row.missing, row.invalid) == want
    direct = profile.column_stats(column(frame, items), {"v": kind}).first()
    assert (direct["count"], direct.missing, direct.invalid) == want


# Half of the cells missing costs 20; of two values in four cells the half that repeats costs 10; nothing but blanks costs 60.
@pytest.mark.parametrize("items,want", [(["k1", "k2", "k3"], 100), (["k1", "", None, "k2"], 80), (["k1", "k1", "k2", "k2"], 90), ([" ", None, ""], 40)])
def test_quality(frame, items, want):
    assert counted(frame, list(items), "string")[1].quality_score == want


def test_bank_country_column_as_stored(frame):
    counts, row = counted(frame, ["NL", "DE", "FR", "GER", "AT", "PL", "UK", "AT"], "string")
    assert (row["count"], row.unique, row.unique_ratio, row.quality_score) == (8, 7, 0.875, 97.5)
    assert tuple(profile.length_stats(counts).first())[1:] == (2, 2, 2, 3, 2.12)
    bins = profile.with_length_labels(profile.length_histogram(counts)).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [7] + [0] * 10 + [1]
    assert [b.label for b in bins] == ["2-2"] * 11 + ["2-3"]
    text = profile.text_stats(counts).first()
    assert (text.upper_ratio, text.lower_ratio, text.mixed_ratio, text.digit_ratio, text.alpha_ratio) == (1, 0, 0, 0, 1)


def test_bounds_of_dates_and_times(frame):
    df = frame([("19870615", "235959"), ("20001301", "000001"), ("20110911", "250000"), ("20051130", "120000")], "d string, t string")
    assert tuple(profile.date_stats(df, ["d"]).first()) == ("d", "19870615", "20110911")
    assert tuple(profile.time_stats(df, ["t"]).first()) == ("t", "000001", "235959")


def test_numbers_and_histogram_agree_with_numpy(frame):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(1000, 300, 400), np.repeat(5.0, 300), -rng.exponential(50, 100)]).round(3)
    values = profile.long_values(column(frame, [str(x) for x in data]), ["v"])
    row = profile.numeric_stats(values, {"v": "decimal"}).first()
    want = [data.min(), *np.percentile(data, [25, 50, 75, 95]), data.max(), data.mean(), data.std(ddof=1)]
    assert list(row)[1:] == pytest.approx(want, rel=1e-12)
    bins = profile.numeric_histogram(values, {"v": "decimal"}).orderBy("bin").collect()
    counts, edges = np.histogram(data, bins=12)
    assert [b["count"] for b in bins] == counts.tolist()
    assert [b.bin_low for b in bins] == pytest.approx(edges[:-1])


def test_constant_numbers_widen_the_histogram(frame):
    values = profile.long_values(column(frame, ["7"] * 5), ["v"])
    bins = profile.numeric_histogram(values, {"v": "int"}).orderBy("bin").collect()
    assert [b["count"] for b in bins] == np.histogram([7] * 5, bins=12)[0].tolist()
    assert (bins[0].bin_low, bins[-1].bin_high) == (6.5, 7.5)
    assert profile.numeric_stats(values, {"v": "int"}).first()["std"] == 0
    single = profile.long_values(column(frame, ["7"]), ["v"])
    assert profile.numeric_stats(single, {"v": "int"}).first()["std"] is None


def test_quantiles_of_skewed_groups(frame):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    points = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "low": 0.0, "high": 1.0}
    for group, size in (("big", 3000), ("one", 1), ("two", 2)):
        data = rng.lognormal(3, 2, size) * rng.choice([-1, 1], size)
        if group == "big":
            data[:1000] = 1.25
        rows += [(group, float(x), 1) for x in data]
        want[group] = np.quantile(data, list(points.values())).tolist()
    got = exact_quantiles(frame(rows, "g string, x double, n long"), ["g"], "x", "n", points).collect()
    assert {r.g: [r[p] for p in points] for r in got} == {g: pytest.approx(v, rel=1e-12) for g, v in want.items()}


def test_empty_columns_use_counts_and_list_missing_ones(frame):
    df = frame([("", "x")] + [("", None)] * 2, "a string, b string")
    stats = profile.empty_counts(df, missing=["c"])
    assert {r.source_header: (r.empty_count, r.pct_empty) for r in stats.collect()} == {"a": (3, 100.0), "b": (2, 66.67), "c": (3, 100.0)}
    assert {r.source_header for r in profile.empty_columns(stats).collect()} == {"a", "c"}


def test_month_and_time_histograms(frame):
    months = [f"20{y:02d}{m:02d}15" for y in range(20, 23) for m in range(1, 13)] + ["20220101"]
    df = frame([(m, "115959") for m in months] + [("x", "120000")], "d string, t string")
    values = profile.long_values(df, ["d", "t"])
    rows = profile.month_histogram(values, ["d"]).collect()
    assert len(rows) == 24 and ("2022-01", 2) in {(r.month, r["count"]) for r in rows}
    bins = {r.label: r["count"] for r in profile.time_histogram(values, ["t"]).collect()}
    assert bins["10:00-12:00"] == 37 and bins["12:00-14:00"] == 1 and len(bins) == 12


def test_samples_examples_and_wide_tables(frame):
    df = frame([(3, "c"), (1, ""), (2, "b"), (4, "b")], "at int, v string")
    assert [r.value for r in profile.sample_values(df, ["v"], "at").orderBy("rank").collect()] == ["b", "c"]
    row = profile.describe_columns(df, "at").first()
    assert (row.field_name, row.example, row.nullable) == ("v", "b", True)
    wide = frame([tuple("x" for _ in range(150))], ", ".join(f"c{i} string" for i in range(150)))
    assert profile.empty_counts(wide).count() == 150


def test_whole_table_profile(frame):
    df = frame([("a", "1"), ("b", "2"), ("", "x")], "name string, order_number string")
    rows = {r.field: r for r in profile.profile_table(df).collect()}
    assert rows["order_number"].type == "decimal" and rows["order_number"].p50 == 1.5 and rows["order_number"].invalid == 1
    assert rows["name"].len_max == 1 and rows["name"].missing == 1


def test_empty_table_has_all_fields(frame):
    empty = frame([], "a string, b string")
    types = profile.column_types(empty)
    rows = profile.profile_counts(profile.value_counts(empty, ["a", "b"]), types).orderBy("field").collect()
    assert [(r.field, r["count"], r.missing, r.quality_score) for r in rows] == [("a", 0, 0, 80.0), ("b", 0, 0, 80.0)]
    assert profile.profile_table(empty).count() == 2


def test_two_hundred_columns_in_one_scan(frame):
    wide = frame([tuple("1" for _ in range(200))], ", ".join(f"c{i} string" for i in range(200)))
    out = profile.empty_counts(wide)
    assert out.count() == 200


def test_small_numbers_do_not_share_a_bucket(spark):
    rates = spark.range(20000).selectExpr("'f' AS field", "(id + 1) / 1e9 AS x", "1L AS n")
    got = exact_quantiles(rates, ["field"], "x", "n", {"p50": 0.5, "p0": 0.0}).first()
    assert got.p50 == pytest.approx(10000.5 / 1e9) and got.p0 == 1e-9
    sizes = rates.groupBy(quantiles._bucket(rates.x)).count().agg({"count": "max"}).first()[0]
    assert sizes < 20
    signs = spark.createDataFrame([(x,) for x in (-5.0, -1e-9, 0.0, 1e-300, 2.0, 1e300)], "x double")
    buckets = [r[0] for r in signs.select(quantiles._bucket(signs.x)).collect()]
    assert buckets == sorted(set(buckets))
