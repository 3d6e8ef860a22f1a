"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideweave.llm import bpe, brown, neardup, packing, quality, tokencount, topk, toxicity, warc, wrapper

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": tokencount.op1_token_counts,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_warc": warc.op3_warc,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_ngram_jaccard": neardup.op6_ngram_jaccard,
    "op7_html_extraction": wrapper.op7_html_extraction,
    "op8_brown_lm": brown.op8_brown_lm,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_exact_topk": topk.op10_exact_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
        FROM g""",
    "op10_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
