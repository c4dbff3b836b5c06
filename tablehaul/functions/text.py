"""Cell cleaning and name normalisation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space around a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _accent_table() -> tuple[str, str]:
    """Non-ASCII characters whose canonical decomposition has an ASCII base, and that base."""
    accented, base = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = [c for c in unicodedata.normalize("NFD", chr(code)) if ord(c) < 0x80]
        if plain:
            accented.append(chr(code))
            base.append(plain[0])
    return "".join(accented), "".join(base)


ACCENTED, BASE = _accent_table()


def strip(col: Column) -> Column:
    """Remove surrounding white space of any kind (``trim`` alone removes only spaces)."""
    return F.trim(col, F.lit(WHITESPACE))


def clean(col: Column) -> Column:
    """Cell normalisation: null becomes the empty string, then strip."""
    return strip(F.coalesce(col.cast("string"), F.lit("")))


def is_blank(col: Column) -> Column:
    """Null, empty or only white space."""
    return F.ltrim(F.coalesce(col.cast("string"), F.lit("")), F.lit(WHITESPACE)) == ""


def fold_accents(col: Column) -> Column:
    """Accented letters to their ASCII base; any other non-ASCII character is dropped."""
    return F.regexp_replace(F.translate(col, ACCENTED, BASE), r"[^\x00-\x7F]", "")


def normalize_name(col: Column) -> Column:
    """ASCII letters and digits only, lower case: ``Försäkring_Nr`` -> ``forsakringnr``."""
    folded = F.translate(F.coalesce(col, F.lit("")), ACCENTED, BASE)
    return F.lower(F.regexp_replace(folded, "[^a-zA-Z0-9]", ""))


def normalize_description(col: Column) -> Column:
    """ASCII, lower case, single spaces."""
    lowered = strip(F.lower(fold_accents(F.coalesce(col, F.lit("")))))
    return F.regexp_replace(lowered, r"\s+", " ")


def spaced_name(col: Column) -> Column:
    """Lower case with every run of other characters turned into one space."""
    lowered = F.lower(F.coalesce(col, F.lit("")))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def base_header(col: Column) -> Column:
    """Header text before its annotation: ``BANKL(k/*)`` -> ``BANKL``."""
    return F.upper(F.regexp_extract(strip(col), r"^([^()]+)", 1))
