"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with the reference of its
language by the Jensen-Shannon distance (base 2, 0 to 1). The references are counted over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.text import BLANKS, word_list

#: Common words by language, most frequent first.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "on", "this", "are", "an", "or", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"],
}
SYMBOLS = "#*$%&|<>"
DIGITS = "0-9"
PUNCTUATION = ".,;:!?'\"()\\-"
#: One character for each place in a list of common words.
PLACES = "abcdefghijklmnopqrst"
#: Below these lengths a histogram says too little, and the comparison is left out.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Largest distances that a kept document may have.
MOST_CLASS, MOST_COMMON = 0.28, 0.34


def only(text: Column, chars: str) -> Column:
    """The text reduced to the given characters of a regular-expression class."""
    return F.regexp_replace(text, f"[^{chars}]+", "")


def repeated_words(hashes: Column) -> Column:
    """3-word windows sorted by hash, so that equal ones are neighbours; null if no window occurs twice."""
    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
    )


def window_hashes(words: Column) -> Column:
    last = F.size(words) - 3
    one = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), one))


def repeated_positions(windows: Column) -> Column:
    twice = F.filter(
        windows,
        lambda x, i: (F.get(windows, i - 1)["h"] == x["h"]) | (F.get(windows, i + 1)["h"] == x["h"]),
    )
    return F.sort_array(F.transform(twice, lambda x: x["at"]))


def covered(starts: Column) -> Column:
    """Positions covered by windows of three that begin at the sorted ``starts``."""
    gaps = F.transform(starts, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - at, F.lit(3))))
    return F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")


def with_base(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``lang`` with the base counts; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return (
        docs.select("doc_id", "lang", text.alias("_text"))
        .withColumn("_words", word_list(F.col("_text")))
        .withColumn("_lines", lines)
        .withColumn("_hashes", window_hashes(F.col("_words")))
        .withColumn("_windows", repeated_words(F.col("_hashes")))
        .withColumn("_starts", repeated_positions(F.col("_windows")))
        .select(
            "doc_id",
            "lang",
            "_text",
            "_words",
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.length(only(F.col("_text"), SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            covered(F.col("_starts")).alias("n_repeat_words"),
        )
    )


def class_counts(text: Column, word_chars: Column) -> Column:
    """Characters by class: blanks, upper case, digits, punctuation, symbols, and all others (mostly lower case)."""
    rare = F.col("_rare")
    counts = [
        F.length(text) - word_chars,
        *(F.length(only(rare, chars)) for chars in ("\\p{Lu}", DIGITS, PUNCTUATION, SYMBOLS)),
        F.length(text) - F.length(rare) - (F.length(text) - word_chars),
    ]
    return F.array(*(c.cast("double") for c in counts))


def common_places(words: Column, common: list[str]) -> Column:
    """The listed words of a text, in order, as one character of ``PLACES`` each."""
    listed = F.array(*(F.lit(w) for w in common))
    hits = F.filter(words, lambda w: F.array_contains(listed, w))
    return F.array_join(F.transform(hits, lambda w: F.substring(F.lit(PLACES), F.array_position(listed, w).cast("int"), F.lit(1))), "")


def places_by_language(words: Column, lang: Column) -> Column:
    """As ``common_places`` with the list of the document's language; null for an unknown language."""
    (first, common), *others = COMMON.items()
    found = F.when(lang == first, common_places(words, common))
    for name, common in others:
        found = found.when(lang == name, common_places(words, common))
    return found


def with_histograms(counted: DataFrame) -> DataFrame:
    """Adds both histograms; the last bin of each holds the rest of the characters or words."""
    hits = [F.length(only(F.col("_places"), p)).cast("double") for p in PLACES]
    return (
        counted.withColumn("_rare", F.regexp_replace("_text", "[\\p{Ll} \t-\r]+", ""))
        .withColumn("_places", places_by_language(F.col("_words"), F.col("lang")))
        .withColumn("_classes", class_counts(F.col("_text"), F.col("word_chars")))
        .withColumn("_common", F.array(*hits, (F.col("n_words") - F.length("_places")).cast("double")))
        .drop("_rare", "_places", "_text", "_words")
    )


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: F.try_divide(x, total(a)))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(
        share(left), share(right), lambda p, q: 0.5 * part(p, (p + q) / 2) + 0.5 * part(q, (p + q) / 2)
    )
    return F.sqrt(F.greatest(F.lit(0.0), total(terms)))


def measure(docs: DataFrame) -> DataFrame:
    """Base counts and both histograms of every document; the only step that reads texts."""
    return with_histograms(with_base(docs))


def references(measured: DataFrame) -> DataFrame:
    """One row per known language: the summed histograms of all its documents that are long enough.

    At most one row per entry of ``COMMON``, so the result may be broadcast.
    """
    counted = measured.filter(F.col("lang").isin(list(COMMON)) & (F.col("n_words") >= LEAST_WORDS))
    classes = [F.sum(F.get("_classes", F.lit(i))) for i in range(6)]
    words = [F.sum(F.get("_common", F.lit(i))) for i in range(len(PLACES) + 1)]
    return counted.groupBy(F.col("lang").alias("ref_lang")).agg(
        F.array(*classes).alias("ref_classes"), F.array(*words).alias("ref_common")
    )


def judge(
    measured: DataFrame, refs: DataFrame, most_class: float = MOST_CLASS, most_common: float = MOST_COMMON
) -> DataFrame:
    """Base counts, both distances and the verdict, one row per measured document.

    A document fails the base rules with under 50 words, or if over half its words lie in repeated 3-word windows.
    Otherwise it is kept unless a distance exceeds its limit. A distance is null (and does not reject) if the text is
    shorter than the guard or its language is null or has no reference. Null text is empty; a null ``doc_id`` stays;
    repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    joined = measured.join(F.broadcast(refs), F.col("lang") == F.col("ref_lang"), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = lambda name, limit: F.coalesce(F.col(name) > limit, F.lit(False))
    return (
        joined.withColumn("base_failed", base)
        .withColumn("class_distance", F.when(F.col("word_chars") >= LEAST_CHARS, distance(F.col("_classes"), F.col("ref_classes"))))
        .withColumn("common_distance", F.when(F.col("n_words") >= LEAST_WORDS, distance(F.col("_common"), F.col("ref_common"))))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & ~far("class_distance", most_class) & ~far("common_distance", most_common)).alias("kept"),
            "class_distance", "common_distance",
        )
    )
