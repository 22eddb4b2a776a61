"""The queries of this subpackage and their SQL twins."""

from cartolith.llm.bpe import op8_sentencepiece_byte_bpe
from cartolith.llm.conversation_repair import op11_interval_parsing_repair
from cartolith.llm.fingerprints import op2_prefix_hash_fingerprints
from cartolith.llm.html_content import op12_tree_model_content
from cartolith.llm.language import op6_bloom_language
from cartolith.llm.mixing import op5_fair_queue_mix
from cartolith.llm.near_dedup import op10_dart_minhash_classes
from cartolith.llm.quality_classifier import op4_factorisation_machine_quality
from cartolith.llm.quality_rules import op7_risk_controlled_rules
from cartolith.llm.secret_scan import op1_secret_ownership
from cartolith.llm.sharding import op9_byte_shards
from cartolith.llm.source_divergence import OP13_SQL, op13_source_divergence
from cartolith.llm.toxicity import op3_crf_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_ownership,
        op2_prefix_hash_fingerprints,
        op3_crf_toxicity,
        op4_factorisation_machine_quality,
        op5_fair_queue_mix,
        op6_bloom_language,
        op7_risk_controlled_rules,
        op8_sentencepiece_byte_bpe,
        op9_byte_shards,
        op10_dart_minhash_classes,
        op11_interval_parsing_repair,
        op12_tree_model_content,
        op13_source_divergence,
    )
}

#: The mix and the audit of sources are within SQL: the others hash with state, train models or need crc32 and sha256 of ids and offsets.
ORACLE_SQL: dict[str, str] = {
    "op13_source_divergence": OP13_SQL,
    "op5_fair_queue_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws('|', 'mix-1', CAST(doc_id AS VARCHAR))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM s),
r AS (SELECT *, cap / weight AS ratio, sum(cap) OVER low - cap AS below, sum(weight) OVER () - sum(weight) OVER low + weight AS rest, row_number() OVER low AS i
    FROM w WINDOW low AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
rate AS (SELECT min_by(x, i) AS rate FROM (SELECT i, ratio, (1.5e0 * (SELECT sum(source_size) FROM s) - below) / rest AS x FROM r) q WHERE ratio >= x),
t AS (SELECT source, source_size, CASE WHEN cap < weight * rate THEN CAST(cap AS DOUBLE) ELSE weight * rate END AS target FROM w, rate),
p AS (SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT doc_id, source, k, e.epoch, size, target, floor(target) AS goal, source_size * e.epoch + before AS start FROM p, (VALUES (0), (1)) e(epoch) WHERE size > 0 AND target > 0),
f AS (SELECT *, size AS words, (start + size) / target AS finish FROM q WHERE NOT (start < goal AND start + size > target)
    UNION ALL SELECT *, goal - start, 1e0 FROM q WHERE start < goal AND start + size > target
    UNION ALL SELECT *, start + size - goal, (start + size) / target FROM q WHERE start < goal AND start + size > target),
g AS (SELECT *, sum(words) OVER (ORDER BY finish, source NULLS FIRST, epoch, k, doc_id ROWS UNBOUNDED PRECEDING) - words AS ahead FROM f),
x AS (SELECT doc_id, sum(greatest(0, least(words, (SELECT floor(sum(target) + 1e-6) FROM t) - ahead))) AS taken FROM g GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, source, CASE WHEN target > 0 THEN (before + size) / target END AS finish,
    CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p LEFT JOIN x ON p.doc_id = x.doc_id""",
}
