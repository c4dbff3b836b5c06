"""Format-preserving pseudonyms for personal data.

A value that is found and validated (check digits, octets, calendar) is read as a number below the size of its format, moved by
a keyed Feistel permutation of that range, and written back in the same format with new check digits. Equal values of a kind
get equal pseudonyms in all documents, different values different ones, and nothing is stored: the key alone links them.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.text import sliced, unused

ROUNDS = 8
#: Only for tests and trial runs; production sets ``spark.tablehaul.pseudonym.key``.
TRIAL_KEY = "trial key"
KINDS = ["email", "secret", "iban", "ip", "date", "ssn", "card", "phone"]
#: Names of months by language, in the order of the calendar.
MONTHS = [
    names.split()
    for names in (
        "January February March April May June July August September October November December",
        "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    )
]
MONTH = "|".join(sorted({m for names in MONTHS for m in names}, key=lambda m: (-len(m), m)))
#: Groups of digits of a phone number that has neither a plus sign nor brackets: North America, and numbers dialled with a zero.
PLAIN_PHONE = re.compile(r"[2-9]\d\d([ .-])[2-9]\d\d\1\d{4}|0[1-9](?:([ .-])\d\d)(?:\2\d\d){3}|0\d{2,4}[ /-]\d{5,8}", re.ASCII)
FOUND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<secret>(?<![\w])(?:AKIA[0-9A-Z]{16}(?!\w)|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,})"
    r"|(?i:(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?)[A-Za-z0-9+/_-]{6,})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{3,39}(?![\w:.]))"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d))"
    rf"|(?P<written>(?<![\w.-])(?:\d{{1,2}}\.? (?:de )?(?i:{MONTH})(?: de)? \d{{4}}|(?i:{MONTH}) \d{{1,2}}, \d{{4}})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w+/,.-])0\d{2,4}[ /-]\d{5,8}(?![\w/-]|[.,]\d))",
    re.ASCII,
)
#: The same two patterns from a place where a group of characters begins, and the groups.
CARD_AT = re.compile(r"\d(?:[ -]?\d){12,18}(?![\w-])", re.ASCII)
IBAN_AT = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)
GROUP = re.compile(r"[A-Z0-9]+")
#: First digits and lengths of the numbers that card issuers give out.
ISSUED = re.compile(
    r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}"
    r"|3(?:0[0-5]|[689]\d)\d{11,16}|(?:35|6[0-9])\d{14,17}|(?:5[06-8])\d{11,17}|6\d{12,14}|220[0-4]\d{12,15}",
    re.ASCII,
)
IBAN_SIZES = {
    size: countries.split()
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
IBAN_SIZE = {country: size for size, countries in IBAN_SIZES.items() for country in countries}
#: Every value that is looked for holds one of these characters.
HINT = re.compile(r"[0-9@]|(?i:password|passwd|pwd|token|secret|api[_-]?key)")
SECRET_START = re.compile(r"AKIA|gh[pousr]_|sk-|(?i:(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?)")
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
DIGITS, UPPER, LOWER, HEX = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(size)`` that moves every value (if there are two).

    The range is laid out in the keyed order of ``walked``, and each value goes to the next one in that order.
    """
    return value if size < 2 else walked((walked(value, size, key, tweak, True) + 1) % size, size, key, tweak)


def walked(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A balanced Feistel network over the smallest even number of bits, walked on until it lands in the range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, n = (1 << half) - 1, (half + 7) // 8

    def mixed(number: int, part: int) -> int:
        text = b"%d %d %d " % (number, size, part) + tweak.encode()
        blocks = (hashlib.blake2b(text + b"%d" % i, key=key, digest_size=64).digest() for i in range(-(-n // 64)))
        return int.from_bytes(b"".join(blocks)[:n], "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for number in reversed(range(ROUNDS)):
                left, right = right ^ mixed(number, left), left
        else:
            for number in range(ROUNDS):
                left, right = right, left ^ mixed(number, right)
        value = left << half | right
        if value < size:
            return value


def shuffled(text: str, key: bytes, tweak: str, alphabets: list[str] | None = None) -> str:
    """Permutes the characters that belong to an alphabet, all together as one mixed-radix number; others stay."""
    kinds = alphabets or [next((a for a in (DIGITS, UPPER, LOWER) if c in a), "") for c in text]
    value, size = 0, 1
    for c, kind in zip(text, kinds, strict=True):
        if kind:
            value, size = value * len(kind) + kind.index(c), size * len(kind)
    value = permuted(value, size, key, f"{tweak} {''.join(k[:1] or '.' for k in kinds)}")
    out = []
    for c, kind in zip(reversed(text), reversed(kinds), strict=True):
        if kind:
            value, at = divmod(value, len(kind))
            c = kind[at]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def refilled(pattern: str, characters: str) -> str:
    """Puts the characters where the pattern has letters or digits, and keeps its separators."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits) or len(set(digits)) == 1:
        return None
    body = digits[0] + shuffled(digits[1:-1], key, f"card {digits[0]}")
    return refilled(text, body + str((10 - luhn(body + "0")) % 10))


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
        return None
    body = shuffled(plain[4:], key, f"iban {plain[:2]}")
    return refilled(text, f"{plain[:2]}{98 - iban_rest(plain[:2] + '00' + body):02d}{body}")


def ip(text: str, key: bytes) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    value = permuted(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def day(text: str, key: bytes) -> str | None:
    parts = re.split(r"\D", text)
    separator = text[len(parts[0])]
    orders = {"-": ["ymd"], ".": ["dmy"], "/": ["ymd"] if len(parts[0]) == 4 else ["mdy", "dmy"]}[separator]
    for order in orders:
        given = dict(zip(order, map(int, parts), strict=True))
        try:
            number = date(given["y"], given["m"], given["d"]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= number <= LAST_DAY:
            return None
        moved = moved_day(number, key)
        width = 2 if all(len(p) > 1 for p in parts) else 1
        written = {"y": f"{moved.year:04d}", "m": f"{moved.month:0{width}d}", "d": f"{moved.day:0{width}d}"}
        return separator.join(written[c] for c in order)
    return None


def moved_day(number: int, key: bytes) -> date:
    """The pseudonym of a day, the same however the day is written."""
    return date.fromordinal(FIRST_DAY + permuted(number - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))


def written_day(text: str, key: bytes) -> str | None:
    """A date with the month's name: the new month in the same language and case."""
    name = re.search(MONTH, text, re.I)[0]
    names = next(n for n in MONTHS if name.lower() in map(str.lower, n))
    numbers = re.findall(r"\d+", text)
    try:
        number = date(int(numbers[1]), [n.lower() for n in names].index(name.lower()) + 1, int(numbers[0])).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= number <= LAST_DAY:
        return None
    moved = moved_day(number, key)
    month = names[moved.month - 1]
    month = month.upper() if name.isupper() else month.lower() if name.islower() else month.capitalize()
    parts = iter((str(moved.day), f"{moved.year:04d}"))
    return re.sub(r"\d+", lambda _: next(parts), text.replace(name, month, 1))


def ip6(text: str, key: bytes) -> str | None:
    """An address in any valid form: the digits that are written are permuted, groups and gaps stay."""
    try:
        if ipaddress.IPv6Address(text).is_unspecified or not any(c.isdigit() for c in text):
            return None
    except ValueError:
        return None
    lower = text.lower()
    moved = shuffled(lower, key, "ip6", [HEX if c != ":" else "" for c in lower])
    return moved.upper() if text.isupper() else moved


def ssn(text: str, key: bytes) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permuted(value, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(text: str, key: bytes) -> str | None:
    """Ten digits of the North American plan keep valid area and exchange codes; other numbers keep their country code."""
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15 or not (text[0] in "+(" or PLAIN_PHONE.fullmatch(text)):
        return None
    country = re.match(r"\+(\d{1,3}(?!\d)|\d\d)", text)
    start = len(country[1]) if country else 0
    head, rest = digits[:start], digits[start:]
    from_two = "23456789"
    if len(rest) == 10 and rest[0] in from_two and rest[3] in from_two:
        kinds = [from_two, DIGITS, DIGITS, from_two, *[DIGITS] * 6]
    else:
        kinds = ["" if not i and c == "0" else DIGITS for i, c in enumerate(rest)]
    return refilled(text, head + shuffled(rest, key, f"phone {head}", kinds))


def email(text: str, key: bytes) -> str:
    """Local part and all of the domain but its last two labels; letters stay letters, digits digits, capitals where they were.

    Addresses that differ in case only get pseudonyms that do so too.
    """
    new = email_in_small(text.lower(), key)
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, text, strict=True))


def email_in_small(lower: str, key: bytes) -> str:
    name, domain = lower.split("@")
    labels = domain.split(".")
    inner, tail = ".".join(labels[:-2]), ".".join(labels[-2:])
    return f"{shuffled(f'{name}@{inner}' if inner else name, key, f'email {tail}')}{'.' if inner else '@'}{tail}"


def secret(text: str, key: bytes) -> str:
    start = SECRET_START.match(text).end()
    body = text[start:]
    kinds = [HEX] * len(body) if re.fullmatch(r"[0-9a-f]{12,}", body) else None
    return text[:start] + shuffled(body, key, "secret", kinds)


def inner(text: str, match: re.Match, key: bytes) -> tuple[int, int, str, str] | None:
    """Start, end, kind and pseudonym of the first valid card number or IBAN that begins inside a match that is none itself.

    Values begin and end where groups of characters do; a later end than the match's is possible. Of several ends the last
    valid one counts; an IBAN has the one that its country's length gives. Any part of a row of digits has good check digits now and then,
    so a card is a single group, four groups of four, or up to five groups that an issuer's first digits and length fit;
    inside what looks like an IBAN it must fit an issuer in any case.
    """
    looks_iban = match.lastgroup == "iban"
    for group in GROUP.finditer(text, *match.span()):
        start = group.start()
        if looks_iban and (found := IBAN_AT.match(text, start)):
            size = IBAN_SIZE.get(text[start : start + 2])
            for end in ends_of_groups(text, found):
                value = text[start:end]
                if size == len(value) - value.count(" ") and (new := iban(value, key)):
                    return start, end, "iban", new
        if found := CARD_AT.match(text, start):
            for end in ends_of_groups(text, found):
                value = text[start:end]
                sizes = [len(g) for g in re.split("[ -]", value)]
                issued = len(sizes) <= 5 and ISSUED.fullmatch(value.replace(" ", "").replace("-", ""))
                usual = not looks_iban and (sizes == [4] * 4 or len(sizes) == 1)
                if sum(sizes) >= 13 and (issued or usual) and (new := card(value, key)):
                    return start, end, "card", new
    return None


def ends_of_groups(text: str, found: re.Match) -> list[int]:
    """Ends of the groups of characters of a match, the last one first."""
    return [g.end() for g in GROUP.finditer(text, *found.span())][::-1]


MAKERS = {"email": email, "secret": secret, "iban": iban, "ip": ip, "date": day, "ssn": ssn, "card": card, "phone": phone, "ip6": ip6, "written": written_day}
#: Kinds that two patterns find.
COUNTED_AS = {"ip6": "ip", "written": "date"}


def pseudonymised(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """The text with every valid value replaced, and how many values of each kind were."""
    counts: dict[str, int] = {}
    if not text or not HINT.search(text):
        return text, counts

    out, done = [], 0
    while match := FOUND.search(text, done):
        kind, (start, end) = match.lastgroup, match.span()
        new = MAKERS[kind](match[0], key)
        if new is None and kind == "card":
            new = phone(match[0], key)
            kind = "card" if new is None else "phone"
        if new is None and kind in ("card", "iban") and (found := inner(text, match, key)):
            start, end, kind, new = found
        if new is None and kind == "phone":  # digits behind a number belong to something else
            for end in ends_of_groups(text, match)[1:]:
                if (new := phone(text[start:end], key)) is not None:
                    break
            else:
                end = match.end()
        if new is not None:
            kind = COUNTED_AS.get(kind, kind)
            counts[kind] = counts.get(kind, 0) + 1
            out += [text[done:start], new]
        else:
            out.append(text[done:end])
        done = end
    return "".join([*out, text[done:]]), counts


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with ``text`` pseudonymised, ``n_chars`` (if there) kept true, and the values found of each kind in ``pii_counts``.

    Null text stays null, empty text empty; ids do not matter; repeated rows give repeated rows; an empty table gives an
    empty result; texts of any length are searched whole. A column ``pii_counts`` of the input stays; the counts then
    have underscores behind their name.
    """
    secret_key = hashlib.blake2b(key.encode(), digest_size=32).digest()
    counts = unused("pii_counts", docs)
    at, names = docs.columns.index("text"), docs.columns
    long_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            done = [pseudonymised(t, secret_key) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], columns[at].type)
            if long_at is not None:
                old = columns[long_at].to_pylist()
                sizes = [n if n is None or t is None or not c else len(t) for n, (t, c) in zip(old, done, strict=True)]
                columns[long_at] = pa.array(sizes, columns[long_at].type)
            found = pa.array([[(k, c[k]) for k in KINDS if k in c] for _, c in done], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, found], [*names, counts])

    schema = docs.withColumn(counts, F.lit(None).cast("map<string,int>")).schema
    return docs.mapInArrow(run, schema)
