import pytest

from tablehaul.operators import match, memory

SOURCE = "object string, variant string, field_name string, description string, example string, ordinal int"
TARGET = "object string, variant string, field_name string, description string, table string, is_mandatory boolean, is_key boolean, ordinal int"

BANK_SOURCES = (
    "MANDT BANKS BANKL ERDAT ERNAM BANKA PROVZ STRAS ORT01 SWIFT BGRUP XPGRO LOEVM BNKLZ PSKTO ADRNR BRNCH CHKME VERS "
    "IBAN_RULE SDD_B2B SDD_COR1 SDD_RTRANS ZNOCHECK ZACC_LEN ZRES1 ZRES2 ZRES3 ZRES4 ZRES5 ZRES6 ZRES7 ZRES8 ZRES9 ZRES10 BICKY RCCODE"
).split()
BANK_TARGETS = [
    ("BANKS", "Bank Country/Region Key", True), ("BANKL", "Bank Key", True), ("BANKA", "Name of Bank", True),
    ("PROVZ", "Region (State, Province, Country)", False), ("STRAS", "House Number and Street", False), ("ORT01", "City", False),
    ("BRNCH", "Bank Branch", False), ("SWIFT", "SWIFT Code for International Payments", False),
    ("XPGRO", "Post Office Bank Current Account", False), ("BNKLZ", "Bank Number", False), ("BGRUP", "Bank Group (Bank Network)", False),
    ("ISNOTOVERWRITE", "Do Not Overwrite Existing Data", False),
]


def sources(frame, names, variant="v"):
    return frame([("o", variant, n, None, None, i) for i, n in enumerate(names, 1)], SOURCE)


def targets(frame, rows, variant="v"):
    return frame([("o", variant, n, d, variant, m, False, i) for i, (n, d, m) in enumerate(rows, 1)], TARGET)


def run(frame, names, rows, synonyms=None, **options):
    syn = frame(synonyms, "target string, variant string") if synonyms else None
    s = sources(frame, names)
    matched = match.match_targets(s, targets(frame, rows), syn, **options)
    return s, matched


def test_bank_catalogue_maps_as_stored(frame):
    s, matched = run(frame, BANK_SOURCES, BANK_TARGETS, [("BANKL", "Bank Key"), ("BANKA", "Bank Name")])
    rows = match.mapping_table(matched).orderBy("target_ordinal").collect()
    assert [r.source_header for r in rows] == [t[0] for t in BANK_TARGETS[:-1]] + [None]
    assert rows[-1].status == "unmapped" and rows[-1].rationale == match.UNMAPPED and rows[-1].source_field == match.UNKNOWN
    assert {r.rationale for r in rows[:-1]} == {"Exact field name match"}
    assert match.unused_sources(s, matched).count() == 26
    assert match.audit_list(matched).count() == 0
    c = match.coverage(matched, match.unused_sources(s, matched)).first()
    assert (c.targets, c.mapped, c.unmapped, c.unused_sources, c.coverage_pct) == (12, 11, 1, 26, 91.67)


def test_similar_names_as_stored(frame):
    _, matched = run(
        frame,
        ["ORDER_PROC_MODE", "FUNC_AREA", "Long Text", "Profit center short text for matchcode"],
        [("ORDERNUMBER", "Number", True), ("FUNC_AREA", "Functional Area", False), ("LTEXT", "Text", False), ("KTEXT", "Profit Center Name", False)],
    )
    rows = {r.target_field: r for r in matched.collect()}
    assert rows["ORDERNUMBER"].confidence == pytest.approx(0.8310314685314686)
    assert rows["ORDERNUMBER"].rationale == "Fuzzy match with 83% confidence (mandatory field)"
    # The spaced header never equals a target name with an underscore, so this is not exact.
    assert rows["FUNC_AREA"].rationale == "Fuzzy match with 100% confidence"
    assert rows["LTEXT"].confidence == pytest.approx(0.8875)
    assert rows["KTEXT"].confidence == pytest.approx(0.8650757575757576)
    reasons = {(r.target_field, r.reason) for r in match.audit_list(matched).collect()}
    assert {("LTEXT", "low_confidence_fuzzy"), ("KTEXT", "low_confidence_fuzzy"), ("ORDERNUMBER", "low_confidence_fuzzy")} <= reasons


def test_optional_target_needs_the_higher_score(frame):
    _, matched = run(frame, ["ORDER_PROC_MODE"], [("ORDERNUMBER", "Number", False)])
    assert matched.first().status == "unmapped"
    assert match.audit_list(matched).count() == 0


def test_cascade_ties_and_reuse(frame):
    names = ["bank key", "KUNNR2", "KUNNR1", "bank_key"]
    rows = [("BANKL", "x", True), ("KUNNR", "y", False), ("BANK KEY", "z", False), ("MISSING", "qqq", True)]
    _, matched = run(frame, names, rows, [("BANKL", "Bank-Key")])
    got = {r.target_field: (r.source_header, r.rationale.split()[0]) for r in matched.collect()}
    assert got["BANKL"] == ("bank key", "Matched")
    assert got["BANK KEY"] == ("bank key", "Exact")
    assert got["KUNNR"] == ("KUNNR2", "Fuzzy")
    audit = {(r.target_field, r.reason, r.source_header) for r in match.audit_list(matched).collect()}
    assert audit == {
        ("BANKL", "synonym_based", "bank key"), ("KUNNR", "tie_break", "KUNNR2"),
        ("BANK KEY", "reused_source", "bank key"), ("MISSING", "required_unmapped", None),
    }


def test_tie_prefers_longer_common_substring_then_shorter_header(frame):
    _, matched = run(frame, ["XABCD", "ABCDX", "ABCDXY"], [("ABCDE", "", False)])
    assert matched.first().source_header == "ABCDX"


def test_one_hot_object_does_not_mix_with_others(frame):
    s = sources(frame, ["NAME1", "NAME2"], "a").unionByName(sources(frame, ["NAME"], "b"))
    t = targets(frame, [("NAME", "", False)], "a").unionByName(targets(frame, [("NAME", "", False)], "b"))
    got = {r.variant: (r.source_header, r.confidence) for r in match.match_targets(s, t).collect()}
    assert got["b"] == ("NAME", 1.0) and got["a"][0] == "NAME1"


SKIP = "level int, object string, variant string, position int, source_field string, source_description string, skip boolean, comment string"
MANUAL = "level int, object string, variant string, position int, source_field string, source_description string, target string, target_description string, comment string"


def rules(frame):
    skip = frame(
        [(0, None, None, 1, "MANDT", "Client", True, "not needed"), (0, None, None, 2, "KEEP", "Kept", False, "stays"),
         (1, "o", "v", 1, "ERDAT", "Created", True, "own rule")], SKIP)
    manual = frame(
        [(0, None, None, 1, "ERNAM", "Created by USER", "CREATOR", "Creator", "by hand"),
         (1, "o", "v", 1, "MANDT", "Client two", "CLIENT", "Client", "local")], MANUAL)
    return skip, manual


def test_memory_describes_and_explains(frame):
    skip, manual = rules(frame)
    s = sources(frame, ["MANDT", "ERNAM", "KEEP", "OTHER"])
    told = {r.field_name: r.description for r in memory.describe_from_memory(s, skip, manual).collect()}
    assert told == {"MANDT": "Client", "ERNAM": "Created by USER", "KEEP": "Kept", "OTHER": None}
    why = {r.field_name: (r.confidence, r.comment, r.target_field) for r in memory.explain_unused(s, skip, manual).collect()}
    assert why == {"MANDT": (1.0, "not needed", None), "ERNAM": (0.0, "by hand", "CREATOR"), "KEEP": (None, None, None), "OTHER": (None, None, None)}
    kept, log = memory.skip_fields(s, skip)
    assert {r.field_name for r in kept.collect()} == {"ERNAM", "KEEP", "OTHER"} and log.count() == 1
    rest, hits = memory.apply_manual(kept, manual)
    assert {r.field_name for r in rest.collect()} == {"KEEP", "OTHER"} and hits.first().target_field == "CREATOR"


def test_unclear_headers(frame):
    _, manual = rules(frame)
    synonyms = frame([("AMOUNT", "betrag", 1)], "target string, variant string, position int")
    s = frame(
        [("o", "v", "Column1", None, "user", 1), ("o", "v", "", None, "client two", 2), ("o", "v", "Unnamed: 3", None, "Der Betrag", 3),
         ("o", "v", "", None, None, 4), ("o", "v", "GOOD", "d", "user", 5), ("o", "v", "field", None, "zzz", 6)], SOURCE)
    got = {r.ordinal: (r.field_name, r.fallback) for r in memory.name_unclear_headers(s, manual, synonyms).collect()}
    assert got == {
        1: ("CREATOR", "global_manual_mapping"), 2: ("CLIENT", "table_specific_mapping"), 3: ("AMOUNT", "synonyms"),
        4: ("Unknown_Field_4", "unknown_fallback"), 5: ("GOOD", None), 6: ("field", "unknown_fallback"),
    }
