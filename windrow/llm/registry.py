"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from windrow.llm import chat_format, decontaminate, embedding_dedup, html_extract, jaccard_join, packing, pii, quality, toxicity, warc

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_toxicity_ftrl": toxicity.op2_toxicity_ftrl,
    "op3_warc_round_trip": warc.op3_warc_round_trip,
    "op4_pii": pii.op4_pii,
    "op5_html_main_text": html_extract.op5_html_main_text,
    "op6_spaced_seed_decontamination": decontaminate.op6_spaced_seed_decontamination,
    "op7_partenum_jaccard": jaccard_join.op7_partenum_jaccard,
    "op8_collision_counting": embedding_dedup.op8_collision_counting,
    "op9_quality_qda": quality.op9_quality_qda,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

_OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""

_OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.vec_id),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id, n
"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op3_warc_round_trip": warc.OP3_SQL,
    "op7_partenum_jaccard": _OP7_SQL,
    "op8_collision_counting": _OP8_SQL,
}
