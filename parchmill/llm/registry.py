"""Queries of the corpus operators, with SQL where SQL can express them.

Beside the query of each operator stand queries of those of its columns that SQL can express.
"""

from pyspark.sql import functions as F

from parchmill.llm import byte_bpe, chat, line_dedup, media, packing, quality, secrets, sentence_spans, simhash, spelling, token_counts, warc, whitening


def quality_base(spark, sf_dir):
    """The base columns of the quality report."""
    return quality.query(spark, sf_dir).drop("score", "kept")


def token_bytes(spark, sf_dir):
    """The bytes of every text, as the token counts have them."""
    return token_counts.query(spark, sf_dir).select("doc_id", "n_bytes")


def media_payload(spark, sf_dir):
    """What the stored media hold, read back."""
    return media.query(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def warc_links(spark, sf_dir):
    """Type, address and date of the derived records, and how many records refer to one response."""
    out = warc.query(spark, sf_dir)
    return out.groupBy("page_id", "target_uri", "warc_date").agg(F.count("*").alias("records"), F.countDistinct("refers_to").alias("responses"), F.count_if(F.col("record_type") == "conversion").alias("conversions"))


QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_token_counts": token_counts.query,
    "op3_packing": packing.query,
    "op4_secret_scans": secrets.query,
    "op5_byte_bpe": byte_bpe.query,
    "op6_warc_derivatives": warc.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_media_columns": media.query,
    "op9_sentence_spans": sentence_spans.query,
    "op10_line_dedup": line_dedup.query,
    "op11_spelling_variants": spelling.query,
    "op12_embedding_whitening": whitening.query,
    "op13_chat_formatting": chat.query,
    "quality_base": quality_base,
    "token_bytes": token_bytes,
    "media_payload": media_payload,
    "warc_links": warc_links,
    "whitening_deviation": whitening.deviation_query,
}

ORACLES = {
    "op10_line_dedup": line_dedup.ORACLE,
    "op13_chat_formatting": chat.oracle(),
    "whitening_deviation": whitening.DEVIATION_ORACLE,
    "quality_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
t AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, three) AS n FROM t) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i) AS n FROM r GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(words) AS base_failed
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "token_bytes": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes FROM documents",
    "media_payload": "SELECT doc_id, n AS n_bytes, n + pad AS payload_bytes, sha256(text || repeat(chr(0), pad::INTEGER)) AS payload_sha256 FROM (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n, CASE WHEN strlen(coalesce(text, '')) = 0 THEN 64 ELSE (64 - strlen(text) % 64) % 64 END AS pad FROM documents)",
    "warc_links": "SELECT page_id, url AS target_uri, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS warc_date, 2::BIGINT AS records, 1::BIGINT AS responses, 1::BIGINT AS conversions FROM pages",
}
