import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablehaul.functions import classify, parsing, similarity, text
from tablehaul.functions.thesaurus import THESAURUS, thesaurus_rows
from tablehaul.operators.simjoin import name_score


def values(frame, items, *columns, schema="v string"):
    df = frame([(i,) if not isinstance(i, tuple) else i for i in items], schema)
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect()]


def test_normalize_name_follows_unicode_decomposition(frame):
    words = ["Försäkring_Nr", "ÇA-va?", "Straße", "ﬁeld", "Ångström 10", "", "日本", "KK"]
    want = []
    for w in words:
        ascii_ = unicodedata.normalize("NFD", w).encode("ascii", "ignore").decode()
        want.append("".join(c for c in ascii_.lower() if c.isalnum()))
    assert values(frame, words, text.normalize_name(F.col("v"))) == want


def test_strip_removes_every_kind_of_space(frame):
    assert values(frame, ["\t a b  \n", "\x0b\x1f", None], text.clean(F.col("v"))) == ["a b", "", ""]
    assert values(frame, [" 　", "x", None, ""], text.is_blank(F.col("v"))) == [True, False, True, True]


def test_spaced_name_and_description(frame):
    assert values(frame, ["FUNC_AREA", "  a--b  C "], text.spaced_name(F.col("v"))) == ["func area", "a b c"]
    assert values(frame, ["  Name  of\tBänk "], text.normalize_description(F.col("v"))) == ["name of bank"]
    assert values(frame, ["bankl(k/*)", " X ", "A(*)"], text.base_header(F.col("v"))) == ["BANKL", "X", "A"]


def test_numbers_dates_times(frame):
    n = ["1.5", " 2 ", "1.5d", "inf", "1e3", ".5", "x", "", None, "0x10", "5."]
    assert values(frame, n, parsing.parse_number(F.col("v"))) == [1.5, 2.0, None, None, 1000.0, 0.5, None, None, None, None, 5.0]
    assert values(frame, ["2.5", "3.0"], parsing.parse_integer(F.col("v"))) == [None, 3.0]
    d = ["20240229", "20230229", "99991231", "2024111", "20241301"]
    got = values(frame, d, parsing.format_date(parsing.parse_date(F.col("v"))))
    assert got == ["20240229", None, "99991231", None, None]
    t = ["093000", "240000", "235959", "12000", "1a0000"]
    assert values(frame, t, parsing.parse_time(F.col("v"))) == [34200, None, 86399, None, None]
    assert values(frame, ["235959", "000007"], parsing.format_time(parsing.parse_time(F.col("v")))) == ["235959", "000007"]


def test_lengths_and_flags(frame):
    assert values(frame, ["000010", "000000", "1x", " 8 ", ""], parsing.parse_length(F.col("v"))) == [10, 0, None, 8, None]
    assert values(frame, ["12.0", "abc", "", None], parsing.parse_length_lenient(F.col("v"))) == ["12", "abc", "", ""]
    assert values(frame, [" x", "no", None], parsing.is_marked(F.col("v"))) == [True, False, False]
    assert values(frame, ["Mandatory for sheet", "X", "yes", None], parsing.is_mandatory(F.col("v"))) == [True, True, False, False]
    assert values(frame, ["Mandatory", "yes", "x"], parsing.is_mandatory_strict(F.col("v"))) == [True, True, False]
    assert values(frame, ["1.234,50", "7", "1,2,3"], parsing.parse_decimal_text(F.col("v"))) == ["1234.50", "7", None]


def test_classifiers(frame):
    assert values(frame, ["ORDER_DATE", "NUM_DECIMALS", "POINT", "TIMESTAMP", "NAME"], classify.profile_type(F.col("v"))) == [
        "date", "decimal", "int", "time", "string",
    ]
    assert [classify.profile_type_of(n) for n in ["ORDER_DATE", "NUM_DECIMALS", "POINT", "TIMESTAMP", "NAME"]] == [
        "date", "decimal", "int", "time", "string",
    ]
    assert classify.profile_type_of("X_DATE", "INT") == "int" and classify.profile_type_of("X_DATE", "weird") == "date"
    assert values(frame, ["DELETE_FLAG", "X", "B", "name"], classify.is_constant(F.col("v"), F.lit(None))) == [True, True, False, False]
    rows = [("Date", None), ("Number", None), (None, 2), ("Text", 2), ("Text", None), ("TIME", None)]
    got = values(frame, rows, classify.rule_type(F.col("t"), F.col("d")), schema="t string, d int")
    assert got == ["date", "decimal", "string", "decimal", "string", "time"]


def test_thesaurus_terms_belong_to_one_concept():
    assert len(THESAURUS) == 27
    terms = [t for t, _ in thesaurus_rows()]
    assert len(terms) == len(set(terms))


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
        row = new
    return row[-1]


def jaro_winkler(a, b):
    """Written from the definition with index flags, unlike the library's code."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    fa, fb = [False] * len(a), [False] * len(b)
    for i in range(len(a)):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not fb[j] and a[i] == b[j]:
                fa[i] = fb[j] = True
                break
    x = [c for c, f in zip(a, fa) if f]
    y = [c for c, f in zip(b, fb) if f]
    if not x:
        return 0.0
    half = sum(p != q for p, q in zip(x, y)) / 2
    j = (len(x) / len(a) + len(x) / len(b) + (len(x) - half) / len(x)) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + 0.1 * p * (1 - j)


def best_score(a, b):
    longest = max(len(a), len(b))
    return max(1 - lev(a, b) / longest if longest else 1.0, jaro_winkler(a, b))


def test_known_scores(frame):
    pairs = [
        ("orderprocmode", "ordernumber", 0.8310314685314686),
        ("longtext", "ltext", 0.8875),
        ("profitcentershorttextformatchcode", "profitcentername", 0.8650757575757576),
        ("", "", 1.0),
        ("a", "", 0.0),
    ]
    got = values(frame, [p[:2] for p in pairs], name_score(F.col("a"), F.col("b")), schema="a string, b string")
    assert got == pytest.approx([p[2] for p in pairs], abs=1e-15)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.text("abcde", max_size=9), st.text("abcde", max_size=9)), min_size=40, max_size=60))
def test_measures_agree_with_definitions(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(similarity.jaro_winkler_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([jaro_winkler(a, b) for a, b in pairs])
    lcs = [r[0] for r in df.select(similarity.longest_common_substring(F.col("a"), F.col("b"))).collect()]
    subs = lambda s: {s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    assert lcs == [max([len(x) for x in subs(a) & subs(b)], default=0) for a, b in pairs]


def test_whole_numbers_of_any_length(frame):
    df = frame([("99999999999999999999",), ("1e20",), ("-7",), ("7.0",), ("7.5",), ("x",)], "v string")
    assert [r[0] is not None for r in df.select(parsing.parse_integer(F.col("v"))).collect()] == [True, True, True, True, False, False]
