"""Main text, WARC files and URL rules: expected values, plain loops and edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import time

import pytest

from tablehaul.llm import htmlmain, urlrules, warc
from tablehaul.session import new_output

PAGES = "page_id long, url string, html string"


def texts_of(spark, rows):
    return {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, PAGES)).collect()}


FULL = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>One <b>bold</b>
 line&nbsp;here<br>and on.<p>Two</p><script>x</script><div class="share">Share</div><!-- <p>gone</p> -->
<ul><li>first</li><li>second</ul><form><p>Mail</p><input></form><section class="comments"><p>Nice!</p></section></article>
<aside>Side</aside><div id="Comments"><article><p>Reader</p></article></div><footer>&copy; all</footer></body></html>"""


def test_article_without_the_rest(spark):
    found = texts_of(spark, [(1, "http://a.org/x", FULL), (2, None, None), (3, "no url", ""), (None, "http://a.org/y", "<p>a<p>b &lt; c")])
    assert found == {1: "Title & more\n\nOne bold line here and on.\n\nTwo\n\nfirst\n\nsecond", 2: "", 3: "", None: "a\n\nb < c"}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="layout has-sidebar"><article><p>A</p></article><div class="sidebar-left">no</div></div>', "A"),
        ('<article class="post comments-open"><p>A</p><div class="comment-list"><p>no</p></div></article>', "A"),
        ('<div id="search-page"><main><p>A</p></main></div>', "A"),
        ('<article><p class="notice-period">A</p><p class="cookie-notice">no</p></article>', "A"),
        ("<header>no</header><article><header><h1>A</h1></header><p>B</p><footer>no</footer></article>", "A\n\nB"),
        ('<div class="sidebar"><article><p>A</p></article></div>', "A"),
        ('<div class="related-posts"><article><p>no</p></article></div><p>A</p>', "A"),
        ('<div class="site-header ad-1">no</div><p class="entry page-footer">no</p><p>A</p>', "A"),
    ],
)
def test_names_take_out_elements_but_not_the_article(html, text):
    assert "\n\n".join(htmlmain.main_lines(*htmlmain.lines_of(html), None)) == text


def test_unmatched_end_tags_take_linear_time():
    start = time.process_time()
    assert htmlmain.lines_of("<b>" * 40_000 + "x" + "</i>" * 40_000)[0] == ["x"]
    assert time.process_time() - start < 5


def page(*lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


@pytest.mark.parametrize("parts", ["1", "7"])
def test_shared_lines_of_the_nearest_url_go(spark, parts):
    """The result does not depend on the number of ranges, although they part neighbours."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i, f"http://h.org/en/{i:03d}", page("Welcome", "Menu", f"own {i}", f"more {i}", "Bye")) for i in range(40)]
        rows += [(100, "http://h.org/zz/1", page("Welcome", "alone", "Bye")), (200, "http://other.org/", page("Welcome", "Bye"))]
        rows += [(300, "http://copy.org/a", page("same", "page")), (301, "http://copy.org/b", page("same", "page"))]
        found = texts_of(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == {i: f"own {i}\n\nmore {i}" for i in range(40)} | {100: "alone", 200: "Welcome\n\nBye", 300: "same\n\npage", 301: "same\n\npage"}


def test_main_text_edge_cases(spark):
    empty = htmlmain.extract(spark.createDataFrame([], PAGES))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    twice = spark.createDataFrame([(1, "http://a/b", long, 1)] * 2, PAGES + ", host int").withColumnRenamed("host", "part")
    assert [r.n_chars for r in htmlmain.extract(twice).collect()] == [20000 * 6 - 2] * 2


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 6])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(htmlmain, "TABLE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 10))] for _ in range(2))
        found = htmlmain.shared(a, b)
        rest = iter(b)
        assert found == sorted(set(found)) and all(a[i] in rest for i in found) and len(found) == plain_lcs(a, b)


def expected_records(rows, least=0):
    first = {}
    for i, _, html in rows:
        first.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in first[data] if x is not None]
        leader = min(ids) if ids else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = len(data) >= least and i != leader
        out.append((i, len(data), digest, "revisit" if revisit else "response", leader if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h/{i}", f"<p>body {i % 7} é</p>" * (1 + i % 5)) for i in range(60)] + [(70, None, None), (71, "http://h/\r\n", ""), (72, "u", "a\r\n\r\nWARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 40])
def test_archive_round_trip(spark, least):
    folder = new_output(spark, "warc")
    listed = warc.write(spark.createDataFrame(ROWS, PAGES), folder, least, range_bytes=500, file_bytes=700).collect()
    found = warc.read(spark, folder).drop("url").collect()
    assert sorted(map(tuple, found), key=str) == expected_records(ROWS, least)
    assert len({r.shard for r in listed}) > 2 and max(r.records for r in listed) < 20 and sum(r.records for r in listed) == len(ROWS)


def test_archive_is_the_same_however_rows_are_dealt(spark):
    made = []
    for n in (1, 5):
        rows = warc.write(spark.createDataFrame(ROWS, PAGES).repartition(n), new_output(spark, "warc"), range_bytes=500, file_bytes=700).collect()
        made.append(sorted(map(tuple, rows)))
    assert made[0] == made[1]


def test_archive_edge_cases(spark):
    folder = new_output(spark, "warc")
    assert warc.write(spark.createDataFrame([], PAGES), folder).count() == 0 and warc.read(spark, folder).count() == 0
    folder = new_output(spark, "warc")
    twice = spark.createDataFrame([(1, "u", "x", "k"), (1, "u", "x", "k"), (None, "v", "x", "k"), (None, "v", "y", "k"), (None, "v", "y", "k")], PAGES + ", kind string")
    warc.write(twice, folder)
    found = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.read(spark, folder).collect())
    assert found == [(0, "response", 0), (0, "revisit", 0), (0, "revisit", 1), (1, "response", 0), (1, "revisit", 1)]


def test_damaged_archive_is_noticed():
    data = warc.page_record(1, "u", b"payload", None, True)
    headers, block = warc.parsed(data)
    assert warc.row(headers, block)[1] == 7
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(data.replace(b"payload", b"paxload"))


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("parts", ["2", "16"])
def test_rules_match_a_loop(spark, parts):
    rng = random.Random(3)
    labels = ["a", "b", "net", "org", "Example", "x-y"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/en/", "/en/a", "/de/", "/EN/", "?q=/en/", "#/en/", "/en?x"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no", "://", "x://net/a://b", "http://example.net/en/25#top"]
    urls += ["http://net/same"] * 50
    rules = [(rng.choice(hosts).lower(), rng.choice(["/", "/en/", "/de/", "/e", ""]), rng.choice(["allow", "block"])) for _ in range(40)] + urlrules.RULES
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'z' AS key", "'z' AS html")
        found = urlrules.judge(rows, urlrules.rule_table(spark, rules)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_rules_edge_cases(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judge(none, urlrules.rule_table(spark, urlrules.RULES)).count() == 0
    rows = spark.createDataFrame([(None, "http://a.net/"), (1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in urlrules.judge(rows, urlrules.rule_table(spark, [])).collect()] == ["allow"] * 3
    with pytest.raises(ValueError, match="host"):
        urlrules.rule_table(spark, [("", "/", "block")])
