"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from workloom.llm import (
    byte_pairs, compact_windows, host_rules, impact_search, language_id, license_scan, log_bilinear,
    near_copies, private_data, template_leaks, token_files, vector_codes, web_archives,
)
from workloom.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents are written to flat token files first; the counts come from the files alone."""
    order = token_files.write_token_files(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    counts = token_files.token_counts(order.select("path"))
    return order.join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")


def op2_private_data(spark: SparkSession, folder: str) -> DataFrame:
    return private_data.private_digest(table(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identified(table(spark, folder, "documents"))


def op4_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, folder, "documents"))


def op5_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return byte_pairs.encoding_digest(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op6_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.near_components(table(spark, folder, "documents")).drop("th")


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scanned(table(spark, folder, "documents"))


def op8_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return template_leaks.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_web_archives(spark: SparkSession, folder: str) -> DataFrame:
    manifest = web_archives.write_archives(table(spark, folder, "pages"))
    return web_archives.read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return host_rules.verdicts(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_impact_search(spark: SparkSession, folder: str) -> DataFrame:
    return impact_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    return log_bilinear.scored(table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.code_digest(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts, op2_private_data, op3_language_id, op4_repeated_passages, op5_byte_pairs,
        op6_near_copies, op7_license_scan, op8_template_leaks, op9_web_archives, op10_host_rules,
        op11_impact_search, op12_log_bilinear, op13_vector_codes)
}
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERMS = (rf"regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), "
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


def _assigned(parts: str, books: str) -> str:
    """Comparison SQL: the nearest entry of every part, ties to the lower index; parts of four."""
    square = " + ".join(f"(v.x[{i}] - b.x[{i}]) * (v.x[{i}] - b.x[{i}])" for i in range(1, 5))
    return f"""SELECT v.u, v.p, any_value(v.x) AS x, min(({square}) * 64 + b.k) // 64 AS e, min(({square}) * 64 + b.k) % 64 AS k
          FROM {parts} v JOIN {books} b ON v.p = b.p GROUP BY v.u, v.p"""


def _moved(books: str, assigned: str) -> str:
    mean = ", ".join(f"floor(sum(x[{i}]) / count(*))::BIGINT" for i in range(1, 5))
    return f"""SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM {books} b
          LEFT JOIN (SELECT p, k, [{mean}] AS x FROM {assigned} GROUP BY p, k) m ON b.p = m.p AND b.k = m.k"""

ORACLES: dict[str, str] = {
    "op6_near_copies": rf"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x20\x09-\x0D]+') AS words
          FROM documents),
        s AS (
          SELECT doc_id, list_distinct(CASE WHEN len(words) >= 2
            THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END) AS set FROM w),
        sets AS (SELECT doc_id, md5(list_aggregate(list_sort(set), 'string_agg', chr(10))) AS class, set, len(set) AS n FROM s),
        reps AS (SELECT class, min(doc_id) AS rep, any_value(set) AS set, any_value(n) AS n FROM sets WHERE n > 0 GROUP BY class),
        flat AS (SELECT rep, n, unnest(set) AS x FROM reps),
        inter AS (
          SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
          FROM flat a JOIN flat b ON a.x = b.x AND a.rep <> b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
          GROUP BY a.rep, b.rep),
        links AS (SELECT a, b FROM inter WHERE 100 * i >= 80 * (na + nb - i)),
        reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        comp AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
        SELECT t.doc_id, t.n AS n_shingles, coalesce(c.component, t.doc_id) AS component_id,
               t.doc_id = coalesce(c.component, t.doc_id) AS kept
        FROM sets t LEFT JOIN reps r ON t.class = r.class AND t.n > 0 LEFT JOIN comp c ON c.rep = r.rep""",
    "op9_web_archives": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
        SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
          CASE WHEN octet_length(encode(html)) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN octet_length(encode(html)) >= 1000 AND page_id < last THEN last END AS refers_to
        FROM p""",
    "op10_host_rules": rf"""
        WITH w AS (
          SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM documents),
        win AS (
          SELECT doc_id, i, words[i:i + 7] AS x FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
        m AS (
          SELECT w.doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
            len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
          FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
        f AS (
          SELECT *, base_failed::INT AS f1, (10 * n_symbols > n_words)::INT AS f2,
            (n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines)::INT AS f3,
            (n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words))::INT AS f4 FROM b),
        h AS (SELECT source, r, count(*) AS n, sum(CASE r WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE f4 END) AS x
              FROM f, range(1, 5) t(r) GROUP BY source, r),
        mo AS (
          SELECT r, sum(x) / sum(n) AS p, sum(1.0 / n) / count(*) AS inverse, coalesce(var_samp(x / n), 0) AS v FROM h GROUP BY r),
        pr AS (
          SELECT r, least(greatest(p, 1e-6), 1 - 1e-6) AS p,
            least(greatest(CASE WHEN v - p * (1 - p) * inverse <= p * (1 - p) / 1001 THEN 1000.0
              ELSE p * (1 - p) / (v - p * (1 - p) * inverse) - 1 END, 1.0), 1000.0) AS s FROM mo),
        bad AS (SELECT source, bool_or((x + p * s) / (n + s) >= 0.5) AS rejected FROM h JOIN pr ON h.r = pr.r GROUP BY source)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
          n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
          NOT base_failed AND NOT (rejected AND f2 + f3 + f4 > 0) AS kept
        FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source""",
    "op11_impact_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS u, doc_id, unnest({TERMS}) AS t FROM documents),
        tf AS (SELECT u, any_value(doc_id) AS doc_id, t, count(*) AS tf FROM d GROUP BY u, t),
        n AS (SELECT u, sum(tf)::BIGINT AS n FROM tf GROUP BY u),
        s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM n),
        q AS (SELECT i, any_value(item_id) AS item_id, t, count(*) AS times FROM (
          SELECT row_number() OVER () AS i, item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY i, t),
        w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, big_n),
        r AS (
          SELECT i, any_value(q.item_id) AS item_id, tf.u, any_value(tf.doc_id) AS doc_id,
            sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
          FROM q JOIN tf ON q.t = tf.t JOIN w ON w.t = tf.t JOIN n ON n.u = tf.u, s GROUP BY i, tf.u)
        SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 10""",
    "op13_vector_codes": f"""
        WITH v AS (
          SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS u, vec_id, label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        p AS (SELECT u, p, x[4 * p + 1:4 * p + 4] AS x FROM v, range(16) t(p)),
        b0 AS (SELECT p, u - 1 AS k, x FROM p WHERE u <= 64),
        a0 AS ({_assigned("p", "b0")}), b1 AS ({_moved("b0", "a0")}),
        a1 AS ({_assigned("p", "b1")}), b2 AS ({_moved("b1", "a1")}),
        a2 AS ({_assigned("p", "b2")}),
        c AS (SELECT u, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, sum(e)::BIGINT AS error FROM a2 GROUP BY u)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
          (SELECT sha256(string_agg(x[1] || ',' || x[2] || ',' || x[3] || ',' || x[4], ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256
        FROM v JOIN c ON v.u = c.u""",
}
