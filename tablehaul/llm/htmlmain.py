"""Main text of web pages: structure first, then differences between pages with near urls.

A page is cut into lines of text at block elements. Elements and attributes that name menus, headers, footers, sidebars,
notices, adverts, forms or comments take their lines out; lines inside an ``article`` or ``main`` element are the article.
On a page without such an element every remaining line is a candidate. It is paired with the page of the same host whose
path is nearest, the lines of both are aligned by a longest common subsequence, and the shared candidates are deleted.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.ranges import limits
from tablehaul.llm.text import dealt_by, sliced, width
from tablehaul.llm.urlrules import with_parts

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
DROPPED = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "header", "iframe", "map", "menu", "nav",
    "noscript", "object", "select", "svg", "template", "video",
}
#: Words of ``class`` and ``id`` that name what does not belong to an article.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup",
    "login", "sidebar", "side", "widget", "widgets", "related", "recommended", "recommendations", "share", "sharing", "social", "comment",
    "comments", "commentlist", "disqus", "respond", "reply", "replies", "breadcrumb", "breadcrumbs", "pagination", "pager", "menu", "menus",
    "nav", "navbar", "navigation", "footer", "header", "masthead", "toolbar", "search", "form",
}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
NEVER_NAMED = {"html", "body", "main"}
#: Elements that end an open element of the same kind when they begin.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Cells (bits) of an alignment table that are held at once; larger tables are halved first.
TABLE_BITS = 1 << 26
#: Words that may stand before and behind a name in a compound such as ``site-header`` or ``comment-list``; with any other word
#: (``has-sidebar``, ``comments-open``, ``notice-period``, ``search-page``) a compound says nothing about its element.
BEFORE = {"site", "page", "global", "top", "bottom", "left", "right", "primary", "secondary", "main", "sticky", "mobile", "block", "section"}
AFTER = {
    "list", "wrapper", "wrap", "container", "box", "area", "bar", "block", "section", "inner", "outer", "item", "items", "link", "links", "button",
    "buttons", "content", "body", "text", "group", "holder", "panel", "row", "column", "unit", "slot", "left", "right", "top", "bottom", "main",
    "primary", "secondary", "posts", "articles", "stories", "news", "title", "thread",
}
READER_COMMENTS = {"comment", "comments", "commentlist", "replies", "disqus", "respond"}
#: Lines outside, candidates, lines of the article; lines of an article inside an element that a name takes out, and that element's.
OUT, CANDIDATE, ARTICLE, INNER, NAMED = 0, 1, 2, 3, 4


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(text)} if text else {}


def named_out(name: str) -> bool:
    """Whether one word of a ``class`` or an ``id`` names what is not the article: as a whole, or as a compound of such a name."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    if words and words[-1] in READER_COMMENTS and words[0] not in ("has", "no", "with", "without"):
        return True
    at = 0
    while at < len(words) - 1 and words[at] in BEFORE:
        at += 1
    end = at
    while end < len(words) and words[end] in NAMES:
        end += 1
    return end > at and all(w in AFTER or w.isdigit() for w in words[end:])


def dropped(tag: str, given: dict[str, str], in_article: bool) -> int | None:
    """``OUT`` if the element itself or a role takes its lines out, ``NAMED`` if a name does. The header of an article stays."""
    if tag in NEVER_NAMED:
        return None
    if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role", "").lower() in ROLES:
        return OUT
    if tag in DROPPED:
        return None if in_article and tag == "header" else OUT
    return NAMED if any(map(named_out, f"{given.get('class', '')} {given.get('id', '')}".split())) else None


def lines_of(page: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page in order, and for each whether it is out, a candidate, or inside the article."""
    if not page:
        return [], []
    texts: list[str] = []
    zones: list[int] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    is_open: dict[str, int] = {}
    zone = CANDIDATE

    def end_line() -> None:
        line = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if line:
            texts.append(line)
            zones.append(zone)

    at = 0
    while True:
        found = TAG.search(page, at)
        if found is None:
            parts.append(page[at:])
            break
        parts.append(page[at : found.start()])
        at = found.end()
        closing, name, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        tag = name.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if closing:
            place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag) if is_open.get(tag) else None
            if tag in BLOCK:
                end_line()
            if place is not None:
                if stack[place][1] != zone:
                    end_line()
                zone = stack[place][1]
                while len(stack) > place:
                    is_open[stack.pop()[0]] -= 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            end_line()
            if tag in SIBLINGS and stack and stack[-1][0] in SIBLINGS[tag]:
                ended, zone = stack.pop()
                is_open[ended] -= 1
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        given = attributes(rest)
        before = zone
        stack.append((tag, before))
        is_open[tag] = is_open.get(tag, 0) + 1
        out = dropped(tag, given, zone in (ARTICLE, INNER)) if zone != OUT else None
        if out is not None:
            end_line()
            zone = out
        elif tag in ("article", "main") or given.get("role", "").lower() == "main" or given.get("itemprop") == "articleBody":
            in_form = zone == OUT and any(t == "form" for t, _ in stack) and not any(t in DROPPED - {"form"} for t, _ in stack)
            if zone != OUT or in_form:
                end_line()
                zone = INNER if zone in (NAMED, INNER) else ARTICLE
    end_line()
    return texts, zones


def row_vectors(a: list[str], b: list[str]) -> Iterator[int]:
    """Bit-parallel longest common subsequence: after each line of ``a``, bit j is 0 where the length grows at ``b[j]``."""
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    vector = full
    for line in a:
        hit = vector & where.get(line, 0)
        vector = ((vector + hit) | (vector - hit)) & full
        yield vector


def shared(a: list[str], b: list[str]) -> list[int]:
    """Positions in ``a`` of one longest common subsequence of lines."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    inner = aligned(a[start : len(a) - end], b[start : len(b) - end])
    return [*range(start), *(start + i for i in inner), *range(len(a) - end, len(a))]


def aligned(a: list[str], b: list[str]) -> list[int]:
    common = set(a) & set(b)
    if not common:
        return []
    b = [line for line in b if line in common]
    kept = [i for i, line in enumerate(a) if line in common]
    a = [a[i] for i in kept]
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        lengths = lambda x, y: prefix_lengths(list(row_vectors(x, y))[-1] if x else (1 << len(y)) - 1, len(y))
        left, right = lengths(a[:half], b), lengths(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return [kept[i] for i in [*aligned(a[:half], b[:cut]), *(half + i for i in aligned(a[half:], b[cut:]))]]
    rows = [(1 << len(b)) - 1, *row_vectors(a, b)]
    found, j = [], len(b)
    for i in range(len(a), 0, -1):
        while j and not rows[i] >> (j - 1) & 1 == 0:
            j -= 1  # the length does not grow at this line of b
        if not j:
            break
        length = prefix_zeros(rows[i], j)
        if prefix_zeros(rows[i - 1], j) < length:
            found.append(i - 1)
            j -= 1
    return [kept[i] for i in reversed(found)]


def prefix_zeros(vector: int, j: int) -> int:
    return j - (vector & ((1 << j) - 1)).bit_count()


def prefix_lengths(vector: int, n: int) -> list[int]:
    out = [0]
    for j in range(n):
        out.append(out[-1] + (1 - (vector >> j & 1)))
    return out


def main_lines(texts: list[str], zones: list[int], other: list[str] | None) -> list[str]:
    """The article's lines; without an article element, the candidates that the other page does not share; without these, the lines
    of an article inside an element whose name takes it out.

    Copies of a page tell nothing about it: if all candidates are shared, they all stay.
    """
    if ARTICLE in zones:
        return [t for t, z in zip(texts, zones, strict=True) if z == ARTICLE]
    candidates = [t for t, z in zip(texts, zones, strict=True) if z == CANDIDATE]
    if not candidates:  # a name took out what holds the article
        return [t for t, z in zip(texts, zones, strict=True) if z == INNER]
    if other is None:
        return candidates
    gone = set(shared(candidates, other))
    return candidates if len(gone) == len(candidates) else [t for i, t in enumerate(candidates) if i not in gone]


def nearest(key: tuple, before: tuple | None, after: tuple | None) -> int:
    """-1 or 1 for the neighbour of the same host whose path has the longer common start, 0 if there is none."""
    sides = [(len(commonprefix([key[1], other[1]])), -side, side) for side, other in ((-1, before), (1, after)) if other and other[0] == key[0]]
    return max(sides)[2] if sides else 0


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    Null html gives an empty text; pages without a host are neighbours of each other; null ids and repeated rows stay;
    an empty table gives an empty result; other columns are ignored. Pages are sorted by host, path and id into ranges;
    the page before and the page after each range are copied into it, so every page meets its true neighbours.
    """
    n = width(pages.sparkSession)
    ids = F.col("page_id").cast("long")
    keyed = with_parts(pages.select(ids.alias("page_id"), "url"))
    rank = F.coalesce("page_id", F.lit(-(2**63)))
    narrow = keyed.select("host", "path", rank.alias("rank"))
    cuts = limits(narrow, ["host", "path", "rank"], F.xxhash64("rank", "host", "path"), n)
    cuts = [(h.encode(), p.encode(), r) for h, p, r in cuts]

    def part_of(h: str, p: str, r: int) -> int:
        return bisect_right(cuts, (h.encode(), p.encode(), r))

    @F.pandas_udf("int")
    def place(host: pd.Series, path: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series([part_of(*k) for k in zip(host, path, rank, strict=True)], dtype="int32")

    ends = narrow.withColumn("part", place("host", "path", "rank")).groupBy("part")
    key = F.struct("host", "path", "rank")
    ends = sorted(ends.agg(F.min(key).alias("low"), F.max(key).alias("high")).collect())
    copies: dict[tuple, list[int]] = {}
    for left, right in zip(ends, ends[1:], strict=False):
        copies.setdefault(tuple(left["high"]), []).append(right["part"])
        copies.setdefault(tuple(right["low"]), []).append(left["part"])

    parts = with_parts(pages.select("url", F.struct(ids.alias("id"), "url", "html").alias("page_id")))
    rows = parts.select(
        F.col("page_id.id").alias("page_id"), F.col("page_id.url").alias("url"), "host", "path", F.col("page_id.html").alias("html")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: dict[str, list] = {name: [] for name in CUT.names}
            for page_id, url, host, path, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts, zones = lines_of(page)
                key = (host, path, -(2**63) if page_id is None else page_id)
                for place, own in [(part_of(*key), True), *((p, False) for p in copies.get(key, []))]:
                    for name, value in zip(out, (place, own, *key, page_id, url, texts, bytes(zones)), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=CUT)

    schema = "part int, own boolean, host string, path string, rank long, page_id long, url string, lines array<string>, zones binary"
    dealt = dealt_by(rows.mapInArrow(cut, schema), "part", "host", "path", "rank", F.col("own").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(one: dict, before: dict | None, after: dict | None) -> tuple:
            key = lambda x: (x["host"], x["path"]) if x and x["part"] == one["part"] else None
            other = None
            if ARTICLE not in one["zones"]:
                side = nearest(key(one), key(before), key(after))
                other = {-1: before, 0: None, 1: after}[side]
            text = "\n\n".join(main_lines(one["lines"], list(one["zones"]), other["lines"] if other else None))
            return one["page_id"], one["url"], text, len(text)

        before = current = None
        for batch in batches:
            out = []
            for after in batch.to_pylist():
                if current is not None and current["own"]:
                    out.append(finished(current, before, after))
                before, current = current, after
            yield result(out)
        if current is not None and current["own"]:
            yield result([finished(current, before, None)])

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")


CUT = pa.schema([
    ("part", pa.int32()), ("own", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("rank", pa.int64()),
    ("page_id", pa.int64()), ("url", pa.string()), ("lines", pa.list_(pa.string())), ("zones", pa.binary()),
])


def result(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "url", "text", "n_chars"])
