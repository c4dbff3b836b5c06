import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablehaul import sinks
from tablehaul.operators import catalog, duplicates, migrate, project, rownum, rule_tables, scan, sketches, transform, validate, versions
from tablehaul.operators.project import MappingRow
from tablehaul.operators.transform import FieldTransform, Settings
from tablehaul.operators.validate import Rule
from tablehaul.sources import bucketed, metadata

VALUES = "target_field string, position int, source_value string, target_value string"
BANK = "banks string, bankl string, banka string, row int"


def bank(frame):
    return frame(
        [("NL ", "11000", "Paarden BANK", 1), (None, "12000", " ", 2), ("FR", "", "Water Bank", 3)], BANK
    )


def test_mapping_driven_projection(frame):
    raw = project.as_clean_text(bank(frame), ["banks", "bankl", "banka"])
    mapping = [MappingRow("COUNTRY", "bankl"), MappingRow("COUNTRY", "banks"), MappingRow("NAME", "nowhere"), MappingRow("KEY", None)]
    out = project.apply_mapping(raw, ["COUNTRY", "NAME", "KEY"], mapping, keep=["row"]).orderBy("row")
    assert [tuple(r) for r in out.collect()] == [(1, "NL", "", ""), (2, "", "", ""), (3, "FR", "", "")]
    assert project.missing_sources(raw, mapping) == ["nowhere"]


def test_reject_rows_carry_all_errors(frame):
    raw = project.as_clean_text(bank(frame), ["banks", "bankl", "banka"])
    rules = [Rule("BANKS", key=True, required=True), Rule("BANKL", required=True), Rule("BANKA", required=True)]
    checked = validate.with_errors(raw, validate.row_checks(rules))
    bad = validate.rejected(checked, "row").orderBy("__rownum").collect()
    assert [(r["__rownum"], r["__errors"], r["__first_error"]) for r in bad] == [
        (2, "BANKS.required|BANKA.required", "BANKS.required"), (3, "BANKL.required", "BANKL.required"),
    ]
    assert bad[0].asDict().keys() >= {"__timestamp", "BANKS", "BANKL", "BANKA"}
    assert [r.row for r in validate.accepted(checked).collect()] == [1]
    by_rule = {r.error_rule: r.errors for r in validate.errors_by_rule(checked).collect()}
    assert by_rule == {r.error_rule: r.errors for r in validate.rule_counts(raw, validate.row_checks(rules)).collect()}
    assert tuple(validate.in_out_counts(checked).first()) == (3, 1, 2)


def test_layout_follows_template(frame):
    raw = project.as_clean_text(bank(frame), ["banks", "bankl", "banka"])
    flags = {"BANKS": (True, True), "BANKL": (False, True), "BANKA": (False, False)}
    layout = project.plan_layout(["BANKS", "BANKL", "BANKA"], ["BANKA", "EXTRA", "banks(k/*)"], flags)
    assert project.apply_layout(raw, layout).columns == ["BANKA", "EXTRA", "BANKS(k/*)"]
    assert layout.ignored == ["BANKL"]
    assert [c for c, _ in project.plan_layout(["BANKS", "BANKL"], None, flags).columns] == ["BANKS(k/*)", "BANKL(*)"]


def test_extended_checks(frame):
    df = frame([("20240101", "1.5", "093000", "abc"), ("20241301", "x", "250000", "abcd"), ("", "", "", "")], "d string, n string, t string, s string")
    rules = [Rule("D", type="date"), Rule("N", type="decimal"), Rule("T", type="time"), Rule("S", max_length=3)]
    got = [r.errors for r in validate.with_errors(df, validate.row_checks(rules, extended=True)).collect()]
    assert got == [[], ["D.date", "N.decimal", "T.time", "S.max_length"], []]


def test_keys_with_nulls_and_blanks(frame):
    df = frame([("a", 1), ("a", 1), ("b", 1), (None, 2), (" ", 3)], "k string, n int")
    bad = {(r.k, r.n): r.rows_with_key for r in validate.duplicate_keys(df, ["k", "n"]).collect()}
    assert bad == {("a", 1): 2, (None, 2): 1, (" ", 3): 1}
    assert validate.rows_with_bad_key(df, ["k", "n"]).count() == 4


def test_orphans_and_reconciliation(frame):
    child, parent = frame([(1,), (2,), (None,)], "c int"), frame([(1,)], "p int")
    assert [r.c for r in validate.orphans(child, parent, ["c"], ["p"]).collect()] == [2]
    assert validate.reconcile(child, parent, parent).first().balanced is False


def test_rule_overlay_and_consistency(frame):
    base = frame([("a", True, True), ("b", False, True)], "field string, key boolean, required boolean")
    over = frame([("A", None, False), ("C", True, None)], "field string, key boolean, required boolean")
    rules = validate.overlay_rules(base, over)
    assert {tuple(r) for r in rules.collect()} == {("A", True, False), ("B", False, True), ("C", True, False)}
    with pytest.raises(ValueError, match="A"):
        validate.require_consistent(rules)
    validate.require_consistent(base)


def test_search_and_sort(frame):
    df = frame([("10", "x"), ("9", "Yes"), ("abc", "no"), ("", "yes")], "v string, w string")
    mixed = frame([("12abc",), ("NaN",), ("1.5d",), ("inf",), (" 3",), ("1e1x",)], "`odd``name` string")
    assert [r[0] for r in mixed.orderBy(*project.numeric_first_order("odd`name")).collect()] == ["1.5d", " 3", "1e1x", "12abc", "NaN", "inf"]
    with pytest.raises(ValueError, match="no column"):
        project.search(df, "9", "missing", "x")
    assert [r.v for r in df.orderBy(*project.numeric_first_order("v")).collect()] == ["9", "10", "", "abc"]
    assert [r.v for r in df.orderBy(*project.numeric_first_order("v", descending=True)).collect()] == ["10", "9", "abc", ""]
    assert project.search(df, "YES").count() == 2 and project.search(df, "9", "w", "YE").count() == 1
    assert project.drop_empty_rows(frame([("", " "), (None, "x")], "a string, b string")).count() == 1


def test_row_numbers_need_no_single_partition(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("v"))
    got = {r.k: r.row_no for r in rownum.number_rows(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got), 1)}


def test_row_numbers_within_a_hot_group(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), (F.col("id") * 37 % 4001).alias("k"))
    rows = rownum.number_within(df, ["g"], ["k"]).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append((r.k, r.row_no))
    assert len(rows) == 4000 and all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in groups.values())


def test_value_map_and_placeholders(frame):
    df = frame([(" Old ", ""), ("keep", None), (None, "x")], "a string, b string")
    rules = [FieldTransform("a", placeholder="?"), FieldTransform("b", placeholder="-")]
    values = frame([("A", 1, "OLD", "NEW"), ("a", 2, "old", "second"), ("z", 1, "keep", "no"), ("a", 1, None, "null")], VALUES)
    apply = lambda *settings: sorted((tuple(r) for r in rule_tables.apply_rule_tables(df, rules, values, *settings).collect()), key=str)
    assert apply() == [("?", "x"), ("NEW", "-"), ("keep", "-")]
    exact = Settings(case_sensitive_mappings=True, null_handling="error", empty_string_handling="keep", trim_whitespace=False)
    assert apply(exact) == [(" Old ", "", []), ("keep", None, ["B.null"]), (None, "x", ["A.null"])]
    skip = Settings(null_handling="skip", empty_string_handling="skip")
    assert [r[2] for r in apply(skip)] == [True, True, True]
    assert rule_tables.apply_rule_tables(df, rules, values.limit(0)).count() == 3
    assert rule_tables.apply_rule_tables(df.limit(0), rules, values).count() == 0
    constant = [FieldTransform("a", "constant", "c")]
    assert {r.a for r in rule_tables.apply_rule_tables(df, constant, values).collect()} == {"c"}


def test_value_tables_of_any_size_keep_every_row(spark):
    """A hot value, repeated rows, nulls and a long table against a plain loop."""
    rng = random.Random(3)
    rows = [("HOT" if rng.random() < 0.4 else f"v{rng.randrange(400)}", rng.choice([None, "", " x ", "X", f"w{rng.randrange(9)}"]), 1) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, c int")
    table = [("A", 0, "hot", "cold"), *(("a", i, f"V{i}", f"t{i}") for i in range(0, 400, 3)), ("b", 1, "x", "ten"), ("b", 0, "W3", "three"), ("b", 5, "w3", "late")]
    values = spark.createDataFrame(table, VALUES)
    known = {"a": {s.lower(): t for f, _, s, t in table if f.lower() == "a"}, "b": {"x": "ten", "w3": "three"}}
    plain = lambda f, v: "?" if v is None or v.strip() == "" else known[f].get(v.strip().lower(), v.strip())
    rules = [FieldTransform("A", placeholder="?"), FieldTransform("B", placeholder="?")]
    got = rule_tables.apply_rule_tables(df, rules, values)
    assert Counter(tuple(r) for r in got.collect()) == Counter((plain("a", a), plain("b", b), c) for a, b, c in rows)
    joins = got._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count("Join Inner") == 1  # one keyed join for all fields


def test_rule_documents_come_back(spark, frame, tmp_path):
    targets = frame([("o", "v", "B", "Bee", 1), ("o", "v", "A", None, 2), ("p", "v", "C", "", 1)], "object string, variant string, field_name string, description string, n int")
    rules = catalog.transform_rules(targets)
    pairs = F.when(F.col("target_field") == "A", F.from_json(F.lit('[{"source_value":"x","target_value":"y"}]'), "array<struct<source_value:string,target_value:string>>"))
    rules = rules.withColumn("value_mappings", F.coalesce(pairs, "value_mappings")).withColumn("expression", F.lit(None).cast("string"))
    settings = frame([("skip", False)], "null_handling string, trim_whitespace boolean")
    path = str(tmp_path / "rules")
    metadata.write_transform_rules(rules, settings, path)
    back, values, given = metadata.read_transform_rules(spark, path)
    assert sorted((r.object, r.position, r.target_field, r.target_field_description) for r in back.collect()) == [
        ("o", 0, "A", "Transform data for A"), ("o", 1, "B", "Bee"), ("p", 0, "C", "Transform data for C"),
    ]
    assert [tuple(r) for r in values.collect()] == [("o", "v", "A", 0, "x", "y")]
    assert rule_tables.collect_settings(given.filter("object = 'p'")) == Settings(null_handling="skip", trim_whitespace=False)
    assert rule_tables.collect_settings(given.filter("false")) == Settings()
    assert rule_tables.collect_transforms(back.filter("object = 'o'")) == [FieldTransform("A"), FieldTransform("B")]


def test_the_whole_command(spark, frame, tmp_path):
    raw = frame([(1, " 7 ", "old", "1.5"), (2, None, "new", "x"), (3, "9", "", "2"), (4, "8", "old", "")], "n int, id string, state string, amount string")
    job = migrate.Job(
        "o", "v", ["ID", "STATE", "AMOUNT", "NOTE"], [MappingRow("ID", "id"), MappingRow("STATE", "state"), MappingRow("AMOUNT", "amount"), MappingRow("NOTE", "gone")],
        [Rule("ID", key=True, required=True), Rule("STATE", required=True), Rule("AMOUNT", type="decimal")],
        [FieldTransform("STATE")], Settings(empty_string_handling="keep"), ["STATE", "ID(k/*)", "MORE"], extended=True,
    )
    values = frame([("STATE", 1, "old", "OLDER")], VALUES)
    for _ in range(2):  # the same run again takes its own place
        done = migrate.run(raw, job, values, str(tmp_path / "out"), "0007", "n")
    assert done.accepted.columns == ["STATE(*)", "ID(k/*)", "MORE"]
    assert [tuple(r) for r in done.accepted.orderBy("ID(k/*)").collect()] == [("OLDER", "7", ""), ("OLDER", "8", "")]
    rejects = {r["__rownum"]: r["__errors"] for r in done.rejected.collect()}
    assert rejects[2] == "ID.required|AMOUNT.decimal" and rejects[3] == "STATE.required"
    counts = {(r.part, r.name): r.n for r in done.summary.collect()}
    assert counts["rows", "in"] == 4 == counts["rows", "out"] + counts["rows", "rejected"] and counts["rows", "lost"] == 0
    assert counts["errors_by_rule", "ID.required"] == 1 and counts["errors_by_field", "STATE"] == 1
    assert done.warnings == [("missing_source_column", "gone"), ("target_not_in_template", "AMOUNT"), ("target_not_in_template", "NOTE")]
    with pytest.raises(ValueError, match="key=true"):
        migrate.checked(raw, migrate.Job("o", "v", ["ID"], [], [Rule("ID", key=True)]), values, "n")


def test_counts_taken_while_writing(spark, frame, tmp_path):
    df = frame([(i, "" if i % 3 else "x") for i in range(100)], "n int, a string")
    checks = validate.row_checks([Rule("A", required=True)])
    raw, given = sinks.count_rows(df)
    rows, outcomes = sinks.count_outcomes(validate.with_errors(raw.filter("n <> 5"), checks), ["A.required"])
    sinks.write_routed(rows, str(tmp_path / "out"))
    assert given.get == {"rows_in": 100} and outcomes.get == {"rows_out": 34, "rows_rejected": 65, "rule0": 65}
    found = {tuple(r) for r in sinks.summary(spark, 100, outcomes.get, ["A.required"]).collect()}
    assert found == {("rows", "in", 100), ("rows", "out", 34), ("rows", "rejected", 65), ("rows", "lost", 1), ("errors_by_rule", "A.required", 65), ("errors_by_field", "A", 65)}


def test_a_repeated_run_replaces_itself_alone(spark, frame, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *r: frame([*r], "object string, variant string, run_ts string, n int")
    sinks.write_by_address(rows(("o", "v", "01", 1), ("o", "w", "01", 2)), path)
    sinks.write_by_address(rows(("o", "v", "02", 3)), path)
    sinks.write_by_address(rows(("o", "v", "01", 4), ("o", "v", "01", 5)), path)
    got = lambda: sorted(tuple(r) for r in sinks.read_by_address(spark, path).select("variant", "run_ts", "n").collect())
    assert got() == [("v", "01", 4), ("v", "01", 5), ("v", "02", 3), ("w", "01", 2)]
    assert sorted((r.variant, r.run_ts, r.rows) for r in sinks.manifest(spark, path).collect()) == [("v", "01", 2), ("v", "02", 1), ("w", "01", 1)]
    # a write that broke off before its manifest: its address is empty until it is written again, the others stay
    broken = rows(("o", "v", "02", 9)).withColumn("commit_id", F.lit("lost"))
    broken.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*sinks.ADDRESS).parquet(path)
    assert got() == [("v", "01", 4), ("v", "01", 5), ("w", "01", 2)]
    sinks.write_by_address(rows(("o", "v", "02", 9)), path)
    assert ("v", "02", 9) in got()


def plain_log(old, new):
    out = set()
    for k in {*old, *new}:
        a, b = old.get(k), new.get(k)
        change = "insert" if a is None else "delete" if b is None else "update"
        a, b = a or (None, None), b or (None, None)
        fields = {(k, change, f, x, y) for f, x, y in zip("vw", a, b, strict=True) if x != y}
        out |= fields or ({(k, change, None, None, None)} if change != "update" else set())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_version_changes_equal_plain_comparison(spark, seed):
    rng = random.Random(seed)
    some = lambda: {k: (rng.choice([None, "", "a", "b"]), rng.choice([None, "x"])) for k in [*rng.sample(range(60), 40), None]}
    old, new = some(), some()
    table = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "k int, v string, w string")
    rows = versions.change_log(table(old), table(new), ["k"]).collect()
    assert {tuple(r) for r in rows} == plain_log(old, new) and len(rows) == len(plain_log(old, new))
    assert versions.change_log(table(old), table(old), ["k"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeated_keys_in_two_passes(spark, seed, monkeypatch):
    monkeypatch.setattr(duplicates, "AT_ONCE", [50, 10**6, 700][seed])
    monkeypatch.setattr(duplicates, "SPREAD", [64, 64, 1][seed])  # at 1 many hashes agree by chance
    rng = random.Random(seed)
    rows = [(rng.choice([None, "", "hot", *map(str, range(900))]), rng.choice([None, 1, 2]), i) for i in range(2000)]
    rows += [("hot", 1, 5000 + i) for i in range(1500)]
    df = spark.createDataFrame(rows, "a string, b int, i int").repartition(5)
    want = {r.i for r in validate.rows_with_bad_key(df, ["a", "b"]).collect()}
    got = [r.i for r in duplicates.rows_with_repeated_key(df, ["a", "b"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert duplicates.rows_with_repeated_key(df.limit(0), ["a"]).count() == 0


def test_few_repeated_keys_move_few_bytes(spark):
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") < n // 100, F.floor(F.col("id") / 2)).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    at = F.pmod(F.xxhash64("k"), F.lit(duplicates.SPREAD * n))
    sent = duplicates.packed(df.select(at.alias("at")), duplicates.SPREAD * n).agg(F.sum(F.octet_length("gaps"))).first()[0]
    assert sent <= 3 * n  # a key and a payload of 8 bytes each take 16 bytes a row and more
    survivors = duplicates.possible(df, ["k"]).count()
    assert n // 100 <= survivors < 0.04 * n
    assert duplicates.rows_with_repeated_key(df, ["k"]).count() == n // 100


def test_table_map_lookup_currency_dates(frame):
    df = frame([("NL", "EUR", 10.0), ("xx", "USD", 10.0), ("de", "GBP", 10.0)], "c string, cur string, amount double")
    table = frame([("nl", "528"), ("DE", "276")], "source_value string, target_value string")
    assert {r.c for r in transform.map_by_table(df, "c", table).collect()} == {"528", "xx", "276"}
    placed = frame([("nl", "9", 1), ("NL", "1", 2), ("de", "4", 1)], "source_value string, target_value string, position int")
    assert {r.c for r in transform.map_by_table(df, "c", placed).collect()} == {"9", "xx", "4"}
    rates = frame([("USD", "EUR", 0.91555), ("GBP", "USD", 9.0)], "from_currency string, to_currency string, rate double")
    got = {r.cur: r.converted for r in transform.convert_currency(df, "amount", "cur", rates, "EUR").collect()}
    assert float(got["EUR"]) == 10.0 and float(got["USD"]) == 9.16 and got["GBP"] is None
    dates = frame([("31.12.2024",), ("2024-02-30",), ("20240101",)], "d string")
    out = dates.select(transform.standardize_date(F.col("d"), "yyyyMMdd", "yyyy-MM-dd", "dd.MM.yyyy").alias("d"))
    assert [r.d for r in out.collect()] == ["20241231", None, "20240101"]


def test_change_log_lists_only_changes(frame):
    df = frame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    log = transform.change_log(df, "k", {"v": (F.col("v"), F.upper("v")), "w": (F.col("w"), F.coalesce("w", F.lit("-")))})
    assert {tuple(r) for r in log.collect()} == {(1, "v", "a", "A"), (2, "v", "b", "B"), (1, "w", None, "-")}


def plain_merged(cells, width):
    rows = sorted({c[:3] for c in cells})
    out = {}
    for file, sheet, row in rows:
        line = [None] * width
        for col in range(1, width + 1):
            own = [c[4] for c in cells if c[:4] == (file, sheet, row, col)]
            above = [(c[2], c[4]) for c in cells if c[:2] == (file, sheet) and c[3] == col and c[4] is not None and c[2] < row <= c[2] + (c[5] or 0)]
            line[col - 1] = own[0] if own else max(above)[1] if above else None
        out[file, sheet, row] = line
    return out


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_merged_cells_reach_over_partitions(spark, parts):
    rng = random.Random(int(parts))
    cells = []
    for file, sheet, n in (("a", "s", 60), ("a", "t", 25), ("b", "s", 1)):
        for row in range(1, n + 1):
            for col in range(1, 5):
                if rng.random() < 0.4:
                    cells.append((file, sheet, row * 2, col, rng.choice([None, f"{row}/{col}"]), rng.choice([None, 0, 0, 1, 7, 30, 500])))
    df = spark.createDataFrame(cells, "file string, sheet string, row_no int, col_no int, value string, merge_down int")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.file, r.sheet, r.row_no): r.cells for r in scan.fill_merged(df, 4).collect()}
        assert scan.fill_merged(df.limit(0), 4).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_merged(cells, 4)


def test_bucketed_tables_meet_without_a_shuffle(spark):
    child = spark.range(500).select((F.col("id") % 90).alias("k"), F.col("id").alias("i")).unionByName(spark.createDataFrame([(None, -1)], "k long, i long"))
    parent = spark.range(80).select(F.col("id").alias("p"))
    left, right = bucketed.store_bucketed(child, ["k"], 4), bucketed.store_bucketed(parent, ["p"], 4)
    found = validate.orphans(left, right.hint("merge"), ["k"], ["p"])
    assert sorted(r.i for r in found.collect()) == [i for i in range(500) if i % 90 >= 80]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_merged_states_stay_within_their_errors(spark):
    df = spark.range(60_000).select((F.col("id") % 37).alias("day"), (F.col("id") * 7919 % 50_021).cast("double").alias("x"), F.lit(None).cast("string").alias("none"))
    states = sketches.period_states(df, F.col("day"), ["x", "none"], ["x"])
    assert states.count() == 74 and states.filter("field = 'none' AND distinct_state IS NOT NULL").count() == 0
    rows = {r.field: r for r in sketches.estimates(sketches.merge_states(states)).collect()}
    true = df.select("x").distinct().count()
    assert rows["x"].rows == 60_000 and abs(rows["x"].distinct_estimate - true) < 0.05 * true
    values = sorted(r.x for r in df.collect())
    for p, name in ((0.25, "p25"), (0.5, "p50"), (0.95, "p95")):
        assert abs(sum(v <= rows["x"][name] for v in values) / len(values) - p) < 0.03
    assert rows["none"].distinct_estimate == 0 and rows["none"].p50 is None
    assert sketches.merge_states(states.limit(0)).count() == 0
