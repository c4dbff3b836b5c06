"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.llm import codes, htmlmain, leaks, packing, pieces, pii, quality, ranked, repeats, simhash, toxicity, urlrules, warc
from tablehaul.llm.text import stored, table
from tablehaul.session import new_output, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_file(spark: SparkSession) -> str:
    """The vocabulary file on the driver; ``spark.tablehaul.sentencepiece`` names another."""
    return spark.conf.get("spark.tablehaul.sentencepiece", "/opt/tokenizers/piece_bpe_32k.model")


def word_tokenizer(spark: SparkSession) -> str:
    """The content of the tokenizer file, read on the driver; ``spark.tablehaul.word_tokenizer`` names another file."""
    import public_tokenizers

    path = spark.conf.get("spark.tablehaul.word_tokenizer", None) or public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.tablehaul.pseudonym.key", pii.TRIAL_KEY)


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query under its function's name; the workers get this package first."""

    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = shipped
    return shipped


@query
def op1_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, decoded again: ``text_sha256`` is that of the decoded text."""
    vocabulary = pieces.Vocabulary.load(tokenizer_file(spark))
    decoded = pieces.decode_table(pieces.encode_table(table(spark, folder, "documents"), vocabulary), vocabulary)
    return decoded.select("doc_id", "ids", "n_pieces", F.sha2("text", 256).alias("text_sha256"))


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups(table(spark, folder, "documents"))


@query
def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmlmain.extract(table(spark, folder, "pages"))


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = new_output(spark, "warc")
    warc.write(table(spark, folder, "pages"), archive)
    return warc.read(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.judge(table(spark, folder, "pages"), urlrules.rule_table(spark, urlrules.RULES))


@query
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.dedup(table(spark, folder, "documents"))


@query
def op8_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with its personal data pseudonymised."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pseudonym_key(spark))


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))


@query
def op10_divergence(spark: SparkSession, folder: str) -> DataFrame:
    measured = stored(quality.measure(table(spark, folder, "documents")), "measured")
    judged = quality.judge(measured, quality.references(measured))
    distances = {c: F.round(c, 6) for c in ("class_distance", "common_distance")}
    return judged.withColumns(distances)


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors with their errors; ``codebooks_sha256`` is the same in every row."""
    coded, books = codes.compress(table(spark, folder, "embeddings"))
    kept = codes.with_label_error(stored(coded, "vector-codes"))
    return kept.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


@query
def op13_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; ``ids_crc32`` is that of a piece's packed ids."""
    pieces_of = packing.pack(table(spark, folder, "documents"), word_tokenizer(spark))
    return pieces_of.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SQL["op5_warc"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
coded AS (
  SELECT page_id, digest, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY digest) AS first_id,
    list_aggregate(list_transform(range(0, 32), lambda k:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST((CAST('0x' || substr(digest, 1 + 5 * CAST(floor(k / 4) AS INT), 5) AS INT)
        >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT)]), 'string_agg', '') AS payload_digest
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM coded
"""

SQL["op6_url_rules"] = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, 1 + length(regexp_extract(rest, '^[^/?#]*'))), '^[^?#]*') AS path
  FROM cut),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) + length(rule_path) DESC) AS k
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON h.page_id = p.page_id AND h.k = 1
"""

SQL["op7_repeats"] = """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM words WHERE len(w) >= 20),
hashed AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM starts),
later AS (SELECT doc_id, s FROM hashed QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
lists AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.p) AS kept FROM flat f ANTI JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p GROUP BY f.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(lists.gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

LISTED = ", ".join(f"('{lang}', {i}, '{w}')" for lang, words in quality.COMMON.items() for i, w in enumerate(words))
SQL["op10_divergence"] = f"""
WITH given AS (
  SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM documents),
starts AS (SELECT k, unnest(range(1, len(w) - 1)) AS s, w FROM given WHERE len(w) >= 3),
twice AS (SELECT k, s FROM starts QUALIFY count(*) OVER (PARTITION BY k, w[s:s + 2]) > 1),
repeated AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(s, s + 3)) AS p FROM twice) GROUP BY k),
base AS (
  SELECT g.k, doc_id, lang, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, regexp_replace(text, '[\\p{{Ll}} \\t-\\r]+', '', 'g') AS rare
  FROM given g LEFT JOIN repeated r ON r.k = g.k),
classes AS (
  SELECT k, lang, 'class' AS kind, unnest(range(6)) AS bin, unnest([length(text) - word_chars, length(regexp_replace(rare, '[^\\p{{Lu}}]+', '', 'g')),
    length(regexp_replace(rare, '[^0-9]+', '', 'g')), length(regexp_replace(rare, '[^.,;:!?''"()\\-]+', '', 'g')),
    length(regexp_replace(rare, '[^#*$%&|<>]+', '', 'g')), word_chars - length(rare)]) AS n FROM base),
listed(lang, bin, word) AS (VALUES {LISTED}),
words AS (SELECT k, lang, unnest(w) AS word FROM base),
hits AS (SELECT k, w.lang, bin, count(*) AS n FROM words w JOIN listed USING (lang, word) GROUP BY ALL),
common AS (
  SELECT k, lang, 'common' AS kind, bin, n FROM hits
  UNION ALL SELECT b.k, b.lang, 'common', 20, n_words - coalesce(sum(h.n), 0) FROM base b LEFT JOIN hits h ON h.k = b.k GROUP BY b.k, b.lang, n_words),
bins AS (SELECT * FROM classes UNION ALL SELECT * FROM common),
reference AS (
  SELECT b.lang, kind, bin, sum(n) AS n FROM bins b JOIN base USING (k) WHERE n_words >= {quality.LEAST_WORDS} AND b.lang IN (SELECT lang FROM listed) GROUP BY ALL),
totals AS (SELECT lang, kind, sum(n) AS total FROM reference GROUP BY ALL),
own AS (SELECT k, kind, sum(n) AS total FROM bins GROUP BY ALL),
shares AS (
  SELECT b.k, r.kind, coalesce(x.n, 0) / o.total AS p, r.n / t.total AS q
  FROM base b JOIN reference r ON r.lang = b.lang JOIN totals t ON t.lang = r.lang AND t.kind = r.kind JOIN own o ON o.k = b.k AND o.kind = r.kind
    LEFT JOIN bins x ON x.k = b.k AND x.kind = r.kind AND x.bin = r.bin WHERE o.total > 0
  UNION ALL SELECT x.k, x.kind, x.n / o.total, 0 FROM bins x JOIN own o ON o.k = x.k AND o.kind = x.kind AND o.total > 0
    JOIN totals t ON t.lang = x.lang AND t.kind = x.kind ANTI JOIN reference r ON r.lang = x.lang AND r.kind = x.kind AND r.bin = x.bin),
far AS (
  SELECT k, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END))) AS d
  FROM shares GROUP BY ALL),
judged AS (
  SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN word_chars >= {quality.LEAST_CHARS} THEN c.d END AS cd,
    CASE WHEN n_words >= {quality.LEAST_WORDS} THEN m.d END AS md
  FROM base LEFT JOIN far c ON c.k = base.k AND c.kind = 'class' LEFT JOIN far m ON m.k = base.k AND m.kind = 'common')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd <= {quality.MOST_CLASS}, true) AND coalesce(md <= {quality.MOST_COMMON}, true) AS kept,
  round(cd, 6) AS class_distance, round(md, 6) AS common_distance
FROM judged
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op11_ranked_search"] = f"""
WITH given AS (SELECT row_number() OVER () AS k, doc_id, {TERMS} AS t FROM documents),
counted AS (SELECT k, doc_id, t, len(t) AS n FROM given WHERE len(t) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM counted),
asked AS (SELECT item_id, text, unnest({TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
items AS (SELECT item_id, text, term, count(*) AS times FROM asked GROUP BY ALL),
flat AS (SELECT k, unnest(t) AS term FROM counted),
tf AS (SELECT k, term, count(*) AS tf FROM flat SEMI JOIN items USING (term) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
scored AS (
  SELECT item_id, text, doc_id, k, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN counted USING (k), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE r <= 20
"""


def code_rounds(rounds: int) -> str:
    """SQL of the assignments and updates: ``near0``, ``book1``, ``near1`` and so on, the last ``near`` with the final codebook."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""near{r} AS MATERIALIZED (
  SELECT k, p, min(struct_pack(d := list_sum(list_transform(list_zip(u, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM cut JOIN book{r} USING (p) GROUP BY k, p)""")
        if r < rounds:
            parts.append(f"""sum{r} AS (
  SELECT p, best.e AS e, i, sum(x) AS s, count(*) AS n FROM (
    SELECT k, p, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM cut) JOIN near{r} USING (k, p) GROUP BY ALL),
mean{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sum{r} GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)""")
    return ",\n".join(parts)


SQL["op12_vector_codes"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT k, p, v[CAST(p * len(v) // 16 + 1 AS BIGINT):CAST((p + 1) * len(v) // 16 AS BIGINT)] AS u FROM kept, range(16) t(p)),
book0 AS MATERIALIZED (SELECT p, k - 1 AS e, u AS c FROM cut WHERE k <= 64),
{code_rounds(codes.ROUNDS)},
coded AS (
  SELECT k, string_agg(lower(lpad(to_hex(CAST(best.e AS BIGINT)), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{codes.ROUNDS} GROUP BY k),
flat AS (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM book{codes.ROUNDS}),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM flat)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (k), digest
"""
