"""Benchmark decontamination by templates.

A text becomes a row of template tokens: numbers, names and units turn into typed placeholders, other words into lower case.
Windows of these tokens are joined by hash with the windows of the benchmark items. Every text is read in three ways: with
capitalised words as names except where a sentence begins, also there, and without regard to case and names. Matches of a
reading that lie in order at nearby offsets are one alignment. A window counts if its slots keep their values or change them
as most of the alignment does, so that a question with other numbers or names is found, and a chance mix of placeholders is not.
Windows with fewer than ``LEAST_PLAIN`` plain words say nothing and are not used. Items without any other window are found
where a document's tokens are exactly theirs.

Most documents hold no window of any item. They are told by arrays: every word between blanks is looked up once as its packed
tokens, readings are masks over them, and window hashes are tested against a table of bits. Only documents with a hit are read
token by token.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.text import mix, rolling, sliced, stored, without_ids

#: Template tokens of a window, tokens of a shorter item that are one window, and plain words that a window must have.
WINDOW, LEAST_TOKENS, LEAST_PLAIN = 8, 5, 3
#: A document holds an item if half of its windows match in one alignment, or so many.
LEAST_SHARE, ENOUGH = 0.5, 6
#: Offsets of one alignment lie in a band; bands overlap by half, so offsets that differ by up to half of it share one.
BAND = 16
#: How a text is read: names except at sentence starts, names also there, no names and no case.
READINGS = 3
#: Number of the reading in which a whole document is compared with a whole item, token by token.
WHOLE = READINGS
#: Bits of each window hash that are set in the table that is sent to all tasks, room for each hash in it, and its least and
#: greatest size (16 MB). A larger benchmark only makes it less selective; what passes is joined exactly.
PROBES = 4
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 15, 1 << 27
MOST_KNOWN = 150_000
TEXTS_AT_ONCE, CHARACTERS_AT_ONCE, ROWS_AT_ONCE = 256, 1_000_000, 1000
#: Numbers, words, and every other visible character or line end.
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[^\w\s]|\n")
ENDS = frozenset(".!?:;\n\"“”")
NUMBER_WORDS = {
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen",
    "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty",
    "ninety", "hundred", "thousand", "million", "billion", "dozen",
}
UNITS = {
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "metre", "metres", "meter", "meters",
    "kilometre", "kilometres", "kilometer", "kilometers", "g", "kg", "mg", "gram", "grams", "kilogram", "kilograms", "pound", "pounds",
    "lb", "lbs", "ounce", "ounces", "oz", "ton", "tons", "tonne", "tonnes", "l", "ml", "litre", "litres", "liter", "liters", "gallon",
    "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "h", "day", "days", "week", "weeks", "month", "months", "year",
    "years", "mph", "kmh", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "%", "€", "$", "£", "°",
}
SPECIAL = NUMBER_WORDS | UNITS
NUMBER, NAME, UNIT = "<n>", "<p>", "<u>"
#: Words seen in this process that are themselves in a template.
PLAIN: set[str] = set()
BASE = 0x9E3779B97F4A7C15


def templates(text: str | None) -> list[tuple[list[str], list[tuple[int, str, str]]]]:
    """Template tokens of a text, and its slots as (token position, kind, value), in each of the ``READINGS``.

    Names that follow each other are one. A text in capitals is read as lower case.
    """
    tokens: list[list[str]] = [[] for _ in range(READINGS)]
    slots: list[list[tuple[int, str, str]]] = [[] for _ in range(READINGS)]
    both = list(zip(tokens, slots, strict=True))
    if not text:
        return both
    if text.isupper():
        text = text.lower()
    if len(PLAIN) > MOST_KNOWN:
        PLAIN.clear()
    strict, loose, folded = tokens
    begins, number = True, False  # whether a sentence begins here, and whether a number is just before
    named = [False] * READINGS  # whether a name is just before
    for word in TOKEN.findall(text):
        if word in PLAIN:
            strict.append(word)
            loose.append(word)
            folded.append(word)
            begins = number = named[0] = named[1] = False
            continue
        lower = word.lower()
        if word == lower and word.isalpha() and word not in SPECIAL:
            PLAIN.add(word)
        kind = ""
        if word[0].isdigit() or lower in NUMBER_WORDS:
            kind = NUMBER
        elif lower in UNITS and (number or not word.isalpha()):
            kind = UNIT
        elif not word[0].isalpha():
            begins = begins or word in ENDS
            named[0] = named[1] = False
            continue
        upper = not kind and word[0].isupper()
        for reading, is_name in enumerate((upper and not begins, upper, False)):
            own, held = both[reading]
            if is_name and named[reading]:
                held[-1] = (held[-1][0], NAME, f"{held[-1][2]} {lower}")
                continue
            own_kind = NAME if is_name else kind
            if own_kind:
                held.append((len(own), own_kind, lower))
            own.append(own_kind or lower)
            named[reading] = is_name
        begins, number = False, kind == NUMBER
    return both


def template(text: str | None) -> tuple[list[str], list[tuple[int, str, str]]]:
    """The first reading of a text: a capitalised word is a name unless a sentence begins with it."""
    return templates(text)[0]


def window_hashes(tokens: list[str], width: int, known: dict[str, int], reading: int = 0) -> np.ndarray:
    """Hashes of all windows; the width and the reading are part of them."""
    if len(known) > MOST_KNOWN:
        known.clear()
    for t in set(tokens).difference(known):
        known[t] = xxhash.xxh64_intdigest(t)
    hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    return mix(rolling(hashes, width, BASE) + np.uint64(width + (reading << 32)))


#: What a token is, as bits. Among the words of a text one sign stands for a line end; where a text has it, it becomes another
#: sign that ends no sentence either.
PUNCTUATION, SENTENCE_END, IS_NUMBER, MAY_BE_UNIT, SIGN, CAPITAL = 1, 2, 4, 8, 16, 32
LINE_END, OTHER_SIGN = "\x00", "\x01"
HASH = xxhash.xxh64_intdigest
TOKEN_BYTES = struct.Struct("<QQ")
MARKS = {m: TOKEN_BYTES.pack(xxhash.xxh64_intdigest(m), PUNCTUATION | (SENTENCE_END if m in ENDS else 0)) for m in ".,;:!?"}
PLACEHOLDERS = {kind: xxhash.xxh64_intdigest(kind) for kind in (NUMBER, NAME, UNIT)}


class TokenMemory(dict):
    """For words between blanks their tokens as packed pairs of hash and class; two generations, so frequent words stay."""

    def __init__(self) -> None:
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.old.get(word) or packed_tokens(word)
        return found

    def age(self) -> None:
        if len(self) >= MOST_KNOWN:
            self.old = dict(self)
            self.clear()


def packed_tokens(word: str) -> bytes:
    mark = MARKS.get(word[-1])
    core = word if mark is None else word[:-1]
    if core.isalpha() and (lower := core.lower()) not in SPECIAL:  # most words: letters, perhaps with a mark behind them
        own = TOKEN_BYTES.pack(HASH(lower), CAPITAL if core[0].isupper() else 0)
        return own if mark is None else own + mark
    pairs: list[int] = []
    for token in ["\n"] if word == LINE_END else TOKEN.findall(word):
        lower, letters = token.lower(), token[0].isalpha()
        kind = IS_NUMBER if token[0].isdigit() or lower in NUMBER_WORDS else 0
        if not kind and lower in UNITS:
            kind = MAY_BE_UNIT | (0 if token.isalpha() else SIGN)
        if not kind and not letters:
            kind = PUNCTUATION | (SENTENCE_END if token in ENDS else 0)
        if letters and token[0].isupper():
            kind |= CAPITAL
        pairs += (HASH(lower), kind)
    return struct.pack(f"<{len(pairs)}Q", *pairs)


def blank_words(text: str) -> list[str]:
    if text.isupper():
        text = text.lower()
    return text.replace(LINE_END, OTHER_SIGN).replace("\n", f" {LINE_END} ").split()


class Readings:
    """Template tokens of many texts at once, as hashes."""

    def __init__(self, texts: list[str], known: TokenMemory) -> None:
        known.age()
        data = [b"".join(map(known.__getitem__, blank_words(t))) for t in texts]
        tokens = np.frombuffer(b"".join(data), np.uint64).reshape(-1, 2)
        doc = np.repeat(np.arange(len(texts)), [len(d) // 16 for d in data])
        kinds = tokens[:, 1]
        has = lambda bit: (kinds & np.uint64(bit)) > 0
        at = np.flatnonzero(~has(PUNCTUATION))
        ends = np.concatenate([[0], np.cumsum(has(SENTENCE_END))])
        self.doc = doc[at]
        starts = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if len(at) else np.zeros(0, bool)
        before = np.concatenate([[0], at[:-1]])[: len(at)]
        begins = starts | (ends[at] > ends[before])
        self.apart = starts | (at - before > 1)  # from the token before
        self.hashes, number = tokens[at, 0], has(IS_NUMBER)[at]
        after_number = np.concatenate([[False], number[:-1]])[: len(at)] & ~starts
        unit = has(MAY_BE_UNIT)[at] & (after_number | has(SIGN)[at])
        self.hashes = np.where(number, np.uint64(PLACEHOLDERS[NUMBER]), np.where(unit, np.uint64(PLACEHOLDERS[UNIT]), self.hashes))
        self.plain = ~(number | unit)
        upper = has(CAPITAL)[at] & self.plain
        self.names = (upper & ~begins, upper, np.zeros(len(at), bool))

    def hashed(self, reading: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that have enough plain words, and the text of each."""
        name = self.names[reading]
        kept = ~(name & np.concatenate([[False], name[:-1]])[: len(name)] & ~self.apart)
        hashes = np.where(name, np.uint64(PLACEHOLDERS[NAME]), self.hashes)[kept]
        doc, plain = self.doc[kept], np.concatenate([[0], np.cumsum((self.plain & ~name)[kept])])
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        valid = (doc[:n] == doc[width - 1 :]) & (plain[width:] - plain[:n] >= LEAST_PLAIN)
        return mix(rolling(hashes, width, BASE) + np.uint64(width + (reading << 32)))[valid], doc[:n][valid]

    def sizes(self, n_texts: int) -> np.ndarray:
        """Tokens of every text in the last reading."""
        return np.bincount(self.doc, minlength=n_texts)


@dataclass(frozen=True)
class Wanted:
    """The table of bits of the hashes looked for, and the sizes of items that are looked for whole."""

    bits: bytes
    n_bits: int
    widths: list[int]
    whole: frozenset[int]

    def hit(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes whose bits are all set."""
        table, left = np.frombuffer(self.bits, np.uint8), np.arange(len(hashes))
        for probe in range(PROBES):
            own = hashes[left]
            place = ((own & np.uint64(2**32 - 1)) + np.uint64(probe) * (own >> np.uint64(32))) & np.uint64(self.n_bits - 1)
            left = left[table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0]
        return left

    def may_hold(self, texts: list[str], known: TokenMemory) -> np.ndarray:
        """Which texts have a window that hits, or the size of an item that is looked for whole."""
        readings = Readings(texts, known)
        found = np.isin(readings.sizes(len(texts)), list(self.whole))
        for width in self.widths:
            for reading in range(READINGS):
                hashes, doc = readings.hashed(reading, width)
                found[doc[self.hit(hashes)]] = True
        return found


def wanted_of(own: DataFrame) -> Wanted:
    """Bits, widths and sizes of the windows of all items. The table's size is bounded whatever the number of items."""
    total = own.count()
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * total).bit_length()))
    low, high = F.col("hash").bitwiseAND(F.lit(2**32 - 1)), F.shiftrightunsigned("hash", 32)
    places = F.array(*[(low + F.lit(i) * high).bitwiseAND(F.lit(n_bits - 1)) + 1 for i in range(PROBES)])  # numbered from one, as parts are
    parts = (
        own.filter(F.col("reading") < WHOLE).select(F.explode(places).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    )
    bits = bytearray(n_bits // 8)
    for r in parts:
        bits[(r.b - 1) * 4096 : r.b * 4096] = r.bits[: n_bits // 8]
    widths = own.groupBy("width", F.col("reading") == WHOLE).agg(F.max("reading")).collect()
    return Wanted(bytes(bits), n_bits, sorted(r[0] for r in widths if not r[1]), frozenset(r[0] for r in widths if r[1]))


WINDOWS = "id long, reading int, width int, size int, at int, hash long, slots array<struct<at int, kind string, value string>>"
SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
WINDOW_ROWS = pa.schema([
    ("id", pa.int64()), ("reading", pa.int32()), ("width", pa.int32()), ("size", pa.int32()), ("at", pa.int32()), ("hash", pa.int64()), ("slots", SLOTS),
])


def text_windows(text: str | None, known: dict[str, int], wanted: Wanted | None = None) -> Iterator[tuple]:
    """``reading``, ``width``, ``size`` (their number), ``at``, hash and slots of every window with enough plain words.

    With ``wanted`` only those that may match are given. Without it the width is ``WINDOW`` or all tokens of a shorter text.
    """
    for reading, (tokens, slots) in enumerate(templates(text)):
        if len(tokens) < LEAST_TOKENS:
            continue
        plain = np.ones(len(tokens), np.int64)
        plain[[p for p, _, _ in slots]] = 0
        plain = np.concatenate([[0], np.cumsum(plain)])
        for width in [min(WINDOW, len(tokens))] if wanted is None else wanted.widths:
            hashes = window_hashes(tokens, width, known, reading)
            places = np.flatnonzero(plain[width:] - plain[: len(hashes)] >= LEAST_PLAIN) if len(hashes) else np.zeros(0, np.int64)
            kept = places if wanted is None else places[wanted.hit(hashes[places])]
            for at in kept.tolist():
                own = slots[bisect_left(slots, (at,)) : bisect_left(slots, (at + width,))]
                yield reading, width, len(places), at, hashes[at], [(p - at, kind, value) for p, kind, value in own]


def whole_text(text: str | None) -> tuple | None:
    """The window of a text as a whole, its values included."""
    tokens, slots = templates(text)[-1]
    if not tokens:
        return None
    values = {p: value for p, _, value in slots}
    digest = xxhash.xxh64_intdigest(" ".join(values.get(i, t) for i, t in enumerate(tokens)), WHOLE)
    return WHOLE, len(tokens), 1, 0, np.uint64(digest), []


def window_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows are id, reading, width, size, place, hash, slots."""
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    columns[5] = np.array(columns[5], np.uint64).view(np.int64)
    columns[6] = [[dict(zip(("at", "kind", "value"), x, strict=True)) for x in own] for own in columns[6]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, WINDOW_ROWS, strict=True)], schema=WINDOW_ROWS)


def item_windows(items: DataFrame) -> DataFrame:
    """The windows of all items; an item without any that says enough has one of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for part in sliced(batches):
            out = []
            for number, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = [(number, *w) for w in text_windows(text, known)]
                whole = None if found else whole_text(text)
                out += found if whole is None else [(number, *whole)]
            yield window_batch(out)

    return items.select(F.col("item_id").cast("long").alias("id"), "text").mapInArrow(run, WINDOWS)


def document_windows(docs: DataFrame, wanted: Wanted) -> DataFrame:
    """The windows of all documents that may match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        packed = TokenMemory()
        out: list[tuple] = []
        for number, text in texts_that(batches, lambda texts: wanted.may_hold(texts, packed)):
            out += ((number, *r) for r in text_windows(text, known, wanted))
            whole = whole_text(text) if wanted.whole else None
            if whole is not None and whole[1] in wanted.whole:
                out.append((number, *whole))
            if len(out) >= ROWS_AT_ONCE:
                yield window_batch(out)
                out = []
        if out:
            yield window_batch(out)

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, WINDOWS)


def texts_that(batches: Iterator[pa.RecordBatch], test: Callable[[list[str]], np.ndarray]) -> Iterator[tuple[int | None, str]]:
    """Ids and texts that pass a test of many texts at once; no more characters are tested together than one text may have."""
    held: list[tuple[int | None, str]] = []
    size = 0

    def passed() -> Iterator[tuple[int | None, str]]:
        found = test([t for _, t in held])
        return (h for h, ok in zip(held, found.tolist(), strict=True) if ok)

    for part in sliced(batches, TEXTS_AT_ONCE):
        for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            held.append(row)
            size += len(row[1])
            if len(held) >= TEXTS_AT_ONCE or size >= CHARACTERS_AT_ONCE:
                yield from passed()
                held, size = [], 0
    if held:
        yield from passed()


def leaks(docs: DataFrame, items: DataFrame, least_share: float = LEAST_SHARE, enough: int = ENOUGH) -> DataFrame:
    """Pairs ``doc_id``, ``item_id`` of a document and an item that it holds, with ``n_windows`` of the best alignment,
    ``share`` of the item's windows, and ``n_changed``, the slot values that differ.

    Null and empty texts hold nothing and are in nothing. Items of fewer than ``LEAST_TOKENS`` tokens, or with fewer than
    ``LEAST_PLAIN`` plain words in every window, are found in documents that consist of the same tokens and values. Rows that
    share an id are judged together; a null id is an id of its own. Texts of any length are read whole. Empty tables give no
    pairs; other columns are ignored.
    """
    own = stored(item_windows(items), "item-windows")
    found = document_windows(docs, wanted_of(own))
    left = found.select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), "hash", F.col("slots").alias("doc_slots"))
    right = own.select(
        F.col("id").alias("item_id"), "reading", F.col("size").alias("n_item"), F.col("at").alias("item_at"), F.col("hash").alias("item_hash"), F.col("slots").alias("item_slots")
    )
    met = left.join(right, F.col("hash") == F.col("item_hash"))
    same = lambda a, b: F.struct(a["kind"].alias("kind"), a["value"].alias("old"), b["value"].alias("new"))
    offset = F.col("doc_at") - F.col("item_at")
    bands = F.array(*(F.floor((offset + F.lit(shift)) / F.lit(BAND)) * 2 + F.lit(int(shift > 0)) for shift in (0, BAND // 2)))
    banded = (
        met.withColumn("pairs", F.zip_with("item_slots", "doc_slots", same))
        .select("doc_id", "item_id", "reading", "n_item", F.struct("item_at", "doc_at", "pairs").alias("window"), F.explode(bands).alias("band"))
        .groupBy("doc_id", "item_id", "reading", "band")
        .agg(F.max("n_item").alias("n_item"), F.collect_set("window").alias("windows"))
        .withColumn("most", F.least(F.lit(enough), F.ceil(F.col("n_item") * F.lit(least_share))).cast("int"))
        .filter(F.size(F.array_distinct(F.transform("windows", lambda w: w["item_at"]))) >= F.col("most"))
    )
    kept = banded.select("doc_id", "item_id", "n_item", "most", "windows").mapInArrow(judged, JUDGED)
    best = kept.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("n_windows", "n_item", "n_changed"), F.struct("n_windows", -F.col("n_changed"), -F.col("n_item"))).alias("best")
    )
    return best.select(
        "doc_id", "item_id", F.col("best.n_windows").alias("n_windows"),
        (F.col("best.n_windows") / F.col("best.n_item")).alias("share"), F.col("best.n_changed").alias("n_changed"),
    )


JUDGED = "doc_id long, item_id long, n_windows long, n_item int, n_changed int"


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The alignments that have enough windows, with their number and how many slot values differ."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            out = []
            for doc, item, n_item, most, windows in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                n, changed = aligned([(w["item_at"], w["doc_at"], [(p["kind"], p["old"], p["new"]) for p in w["pairs"]]) for w in windows])
                if n >= most:
                    out.append((doc, item, n, n_item, changed))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_windows", "n_item", "n_changed"])


def aligned(windows: list[tuple[int, int, list[tuple[str, str, str]]]]) -> tuple[int, int]:
    """Number of windows that lie in order and agree, and of slot values that differ in them.

    A value's new one is the most frequent one at the offset with the most windows that has the value. Several values may
    get the same new one.
    """
    by_offset: dict[int, list] = {}
    for item_at, doc_at, pairs in windows:
        by_offset.setdefault(doc_at - item_at, []).append(pairs)
    mapping: dict[tuple[str, str], str] = {}
    for _, own in sorted(by_offset.items(), key=lambda x: (-len(x[1]), x[0])):
        counts = Counter(p for pairs in own for p in pairs)
        found: dict[tuple[str, str], str] = {}
        for kind, old, new in sorted(counts, key=lambda p: (-counts[p], p[1] != p[2], p)):
            found.setdefault((kind, old), new)
        mapping = found | mapping
    agreed = [w for w in windows if all(old == new or mapping[kind, old] == new for kind, old, new in w[2])]
    agreed.sort(key=lambda w: (w[0], -w[1]))
    ends: list[int] = []  # smallest last document position of a chain of each length
    last: list[int] = []
    before: list[int] = []
    for i, (_, doc_at, _) in enumerate(agreed):
        at = bisect_left(ends, doc_at)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [doc_at], [i]
    changed, i = set(), last[-1] if last else -1
    while i >= 0:
        changed.update(p for p in agreed[i][2] if p[1] != p[2])
        i = before[i]
    return len(ends), len(changed)


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns they came with."""
    return without_ids(docs, leaks(docs, items).select("doc_id").distinct())
