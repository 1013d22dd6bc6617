"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm.common import read
from leadspark.llm.decontaminate import contamination, item_digest
from leadspark.llm.filter_audit import filter_audit
from leadspark.llm.fingerprints import document_fingerprints
from leadspark.llm.language_id import identify
from leadspark.llm.near_dedup import near_components
from leadspark.llm.packing import pack
from leadspark.llm.quality_knn import quality_scores
from leadspark.llm.quality_rules import quality_rules
from leadspark.llm.secret_scan import secret_spans, span_digest
from leadspark.llm.spelling import spelling_groups
from leadspark.llm.substring_dedup import kept_digest, remove_repeated_windows
from leadspark.llm.token_counts import token_counts
from leadspark.llm.url_filter import Rule, canonical_url, filter_urls, url_host, url_path


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), _vocabulary(), limit=2048)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"), sample_per_language=600)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), _vocabulary(), end_id=2, window=4096)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digest(remove_repeated_windows(read(spark, sf_dir, "documents"), width=35))


# The rules of the contract.
URL_RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed: every address that a campaign link (utm_source) of the pages leads to."""
    pages = read(spark, sf_dir, "pages")
    address = canonical_url(url_host(F.col("url")), url_path(F.col("url")))
    listed = pages.where(F.col("url").contains("utm_source=")).select(address.alias("canonical"))
    return filter_urls(pages, listed, URL_RULES)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_digest(contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), length=10))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secret_spans(read(spark, sf_dir, "documents")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"), width=5, percent=85)


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), voters=2400)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(read(spark, sf_dir, "documents"))


# The letters of the contract.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHORTEST = 7


def misspelt_words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters of the texts, some of which lose a letter, with their occurrences; two at least."""
    lowered = F.translate("text", _UPPER, _LOWER)
    # Shorter runs cannot become a word: only whole runs that are long enough leave the text.
    runs = F.regexp_extract_all(lowered, F.lit(f"([A-Za-z\u00c0-\u00ff]{{{_SHORTEST},}})"), F.lit(1))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.left("run", place), F.substr("run", place + 2))
    word = F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run"))
    counted = hashed.groupBy(word.alias("word")).agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= 2) & (F.length("word") >= _SHORTEST))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(misspelt_words(read(spark, sf_dir, "documents")), ratio=10)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_knn": op10_quality_knn,
    "op11_filter_audit": op11_filter_audit,
    "op12_fingerprints": op12_fingerprints,
    "op13_spelling_groups": op13_spelling_groups,
}

_URL_SQL = r"""
WITH parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
        coalesce(contains(url, 'utm_source='), false) AS campaign
    FROM pages
), addressed AS (
    SELECT *, CASE WHEN host = '' THEN '' ELSE host || regexp_replace(path, '/+$', '') END AS address FROM parts
), rules(rule_host, rule_path, says) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(says, length(rule_host || rule_path)) AS says
    FROM addressed JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
), listed AS (
    SELECT DISTINCT address FROM addressed WHERE campaign AND address <> ''
)
SELECT a.page_id, a.host, a.path, f.rule,
    coalesce(f.says, CASE WHEN l.address IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM addressed a LEFT JOIN fitting f USING (page_id) LEFT JOIN listed l USING (address)
"""

_CONTAMINATION_SQL = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_starts AS (
    SELECT item, w, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
    FROM item_words WHERE len(w) > 0
), item_windows AS (
    SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS words FROM item_starts
), doc_starts AS (
    SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
    FROM split, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k
), met AS (
    SELECT doc_id, i, d.k, item FROM doc_starts d
    JOIN item_windows b ON b.k = d.k AND b.words = array_to_string(d.w[d.i : d.i + d.k - 1], ' ')
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM met) GROUP BY doc_id
), held AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""

_QUALITY_SQL = r"""
WITH d AS (
    SELECT doc_id, lang, text,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D.,;:!?()"]+'), lambda x: x <> '') AS v,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), langs AS (
    SELECT lang FROM d WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang
    HAVING count(*) >= 0.005 * (SELECT count(*) FROM d WHERE lang IS NOT NULL AND text IS NOT NULL)
), grams AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 7], ' ')) AS times
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)
), repeats AS (
    SELECT doc_id, count(DISTINCT place) AS n
    FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS place FROM grams WHERE times > 1) GROUP BY doc_id
), kinds AS (
    SELECT doc_id, lang, len(w) AS n_words, k, length(text) - length(regexp_replace(text, k, '', 'g')) AS n
    FROM d, (VALUES ('\p{Ll}+'), ('[\x20\x09-\x0D]+'), ('\p{Lu}+'), ('\p{Nd}+'), ('[.,;:?()"-]+')) AS patterns(k)
    WHERE text IS NOT NULL
), classes AS (
    SELECT * FROM kinds
    UNION ALL
    SELECT doc_id, any_value(lang), any_value(n_words), 'rest', any_value(length(text)) - sum(n)
    FROM kinds JOIN (SELECT doc_id, text FROM d) USING (doc_id) GROUP BY doc_id
), class_refs AS (
    SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM classes SEMI JOIN langs USING (lang) GROUP BY lang, k
), class_shares AS (
    SELECT doc_id, n_words, k, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM classes WHERE n_words >= 50
), class_distances AS (
    SELECT doc_id, r.lang, sqrt(greatest(0, sum(
        CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END
        )) / 2) AS distance
    FROM class_shares s JOIN class_refs r ON r.k = s.k GROUP BY doc_id, r.lang
), spoken AS (
    SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(v) AS word FROM d) AS t SEMI JOIN langs USING (lang) GROUP BY lang, word
), common AS (
    SELECT DISTINCT word
    FROM (SELECT word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM spoken) WHERE place <= 40
), word_refs AS (
    SELECT lang, coalesce(c.word, '') AS word, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q
    FROM spoken s LEFT JOIN common c ON c.word = s.word GROUP BY lang, coalesce(c.word, '')
), said AS (
    SELECT doc_id, coalesce(c.word, '') AS word, count(*) AS n
    FROM (SELECT doc_id, unnest(v) AS word FROM d WHERE len(w) >= 100) s LEFT JOIN common c ON c.word = s.word
    GROUP BY doc_id, coalesce(c.word, '')
), word_distances AS (
    SELECT doc_id, lang, sqrt(greatest(0, sum(
        p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) + 1 - sum(q)) / 2) AS distance
    FROM (
        SELECT doc_id, l.lang, n / sum(n) OVER (PARTITION BY doc_id, l.lang) AS p, coalesce(q, 0) AS q
        FROM said CROSS JOIN langs l LEFT JOIN word_refs r ON r.lang = l.lang AND r.word = said.word
    ) GROUP BY doc_id, lang
), far AS (
    SELECT doc_id FROM class_distances GROUP BY doc_id HAVING min(distance) > 0.3
    UNION
    SELECT doc_id FROM word_distances GROUP BY doc_id HAVING min(distance) > 0.41
), base AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM d LEFT JOIN repeats r USING (doc_id)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
)
SELECT *, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM far) AS kept FROM judged
"""

_AUDIT_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), labelled AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flags AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        list_filter([
            CASE WHEN len(w) < 100 THEN 'A' END,
            CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
            CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' END,
            CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
            CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END
        ], lambda x: x IS NOT NULL) AS failed
    FROM d LEFT JOIN labelled USING (doc_id)
), counts AS (
    SELECT part, failed, good, toxic, count(*) AS n FROM flags GROUP BY ALL
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), walked AS (
    SELECT part, filter_order, step, n, good, toxic, failed, filter_order[step] AS f,
        list_contains(failed, filter_order[step]) AS fails,
        len(list_intersect(failed, string_split(filter_order[: step - 1], ''))) > 0 AS gone
    FROM counts, orders, (SELECT CAST(unnest(generate_series(1, 5)) AS INTEGER) AS step)
), steps AS (
    SELECT part, filter_order, step, f,
        sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = [f] THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails AND good THEN n ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
    FROM walked GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps
"""

_FINGERPRINT_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents
), followed AS (
    SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS following, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
    FROM d WINDOW w AS (ORDER BY doc_id DESC)
), edits AS (
    SELECT *, left(t, n - n // 2) || left(following, n // 2) AS edited FROM followed
), versions AS (
    SELECT doc_id, 'own' AS side, t AS txt FROM edits UNION ALL SELECT doc_id, 'new', edited FROM edits
), paragraphs AS (
    SELECT doc_id, side, unnest(list_filter(string_split(array_to_string(list_transform(
        regexp_extract_all(txt, '[^.!?\n]*[.!?\n]+|[^.!?\n]+'),
        lambda s: CASE WHEN contains(s, chr(10)) OR length(s) % 4 = 0 THEN s || chr(0) ELSE s END), ''), chr(0)), lambda x: x <> '')) AS p
    FROM versions
), digests AS (
    SELECT DISTINCT doc_id, side, CAST('0x' || left(md5(p), 15) AS BIGINT) AS k FROM paragraphs
), sizes AS (
    SELECT doc_id, side, coalesce(count(k), 0) AS size, list(k) FILTER (k IS NOT NULL) AS ks
    FROM versions LEFT JOIN digests USING (doc_id, side) GROUP BY doc_id, side
), leveled AS (
    SELECT *, CASE WHEN size <= 12 THEN 0 ELSE length(bin((size + 11) // 12 - 1)) END AS level FROM sizes
), held AS (
    SELECT doc_id, side, k & ((1 << level) - 1) AS block, r * 8 + ((k >> (40 + 3 * r)) & 7) AS cell, count(*) AS c, bit_xor(k) AS k,
        bit_xor(((k % 2147483647) * (k % 2147483647) + (k >> 31) * 7) % 2147483647) AS h
    FROM digests JOIN leveled USING (doc_id, side), (SELECT unnest(generate_series(0, 2)) AS r) GROUP BY ALL
), cells AS (
    SELECT doc_id, side, level, block, unnest(generate_series(0, 23)) AS cell
    FROM (SELECT doc_id, side, level, unnest(generate_series(0, (1 << level) - 1)) AS block FROM leveled)
), blocks AS (
    SELECT doc_id, side, reverse(lpad(bin(block), CAST(greatest(level, 1) AS INTEGER), '0')) AS place,
        string_agg(CASE WHEN c IS NULL THEN '' ELSE c || ':' || lower(to_hex(k)) || ':' || lower(to_hex(h)) END, ',' ORDER BY cell) AS shown
    FROM cells LEFT JOIN held USING (doc_id, side, block, cell) GROUP BY doc_id, side, level, block
), prints AS (
    SELECT doc_id, side, string_agg(shown, ';' ORDER BY place) AS print FROM blocks GROUP BY doc_id, side
), compared AS (
    SELECT e.doc_id, len(list_intersect(o.ks, w.ks)) AS both_edited, o.size + w.size AS sum_edited,
        len(list_intersect(o.ks, x.ks)) AS both_next, o.size + x.size AS sum_next
    FROM edits e JOIN sizes o ON o.doc_id = e.doc_id AND o.side = 'own' JOIN sizes w ON w.doc_id = e.doc_id AND w.side = 'new'
    JOIN sizes x ON x.doc_id = e.next_id AND x.side = 'own'
)
SELECT e.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, f.print AS fingerprint, g.print AS edited_fingerprint,
    CASE WHEN sum_edited = 0 THEN 1.0 ELSE coalesce(both_edited, 0) / (sum_edited - coalesce(both_edited, 0)) END::DOUBLE AS near_edited,
    CASE WHEN sum_next = 0 THEN 1.0 ELSE coalesce(both_next, 0) / (sum_next - coalesce(both_next, 0)) END::DOUBLE AS near_next
FROM edits e JOIN compared USING (doc_id) JOIN prints f ON f.doc_id = e.doc_id AND f.side = 'own'
JOIN prints g ON g.doc_id = e.doc_id AND g.side = 'new'
"""

LLM_ORACLES: dict[str, str] = {
    "op12_fingerprints": _FINGERPRINT_SQL,
    "op2_quality_rules": _QUALITY_SQL,
    "op6_url_filter": _URL_SQL,
    "op7_decontamination": _CONTAMINATION_SQL,
    "op11_filter_audit": _AUDIT_SQL,
}
