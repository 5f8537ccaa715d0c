"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.llm import bpe, fim, langid, lexical, mixing, neardup, packing, pii, quality, simhash, topk, toxicity, warc
from gaugeflow.llm.text import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents")).drop("row")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_warc_pages": warc.pages_archive,
    "op3_packed_rows": packing.document_packs,
    "op4_toxicity": toxicity.document_toxicity,
    "op5_language_id": langid.document_languages,
    "op6_quality_rules": quality.document_quality,
    "op7_pii_spans": pii.document_pii,
    "op8_near_duplicates": neardup.document_near_duplicates,
    "op9_top_k": topk.embedding_neighbours,
    "op10_mix_sources": op10_mix_sources,
    "op11_fill_in_middle": fim.document_fill_in_middle,
    "op12_near_fingerprints": simhash.document_near_fingerprints,
    "op13_ranked_search": lexical.document_search,
}

OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sizes GROUP BY source
), weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    1.5::DOUBLE * sum(source_size) OVER () AS goal FROM per
), levels AS (
  SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), stopped AS (SELECT *, cap <= level * weight AS stops FROM levels
), targets AS (
  SELECT *, CASE WHEN stops THEN cap ELSE (goal - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0))
    / sum(CASE WHEN NOT stops THEN weight END) OVER () * weight END AS target FROM stopped
), keyed AS (
  SELECT doc_id, size, source, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM sizes
), placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, floor(t.target)::BIGINT AS take,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY ('0x' || substr(key, 1, 7))::BIGINT
      % greatest(1, floor(sqrt((SELECT count(*) FROM sizes)))::BIGINT), key, k.doc_id, k.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE size * (take // source_size) + greatest(0, least(size, take % source_size - place)) END)::BIGINT AS taken
FROM placed
"""
OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words WHERE len(w) > 0
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id) + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x
), smallest AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN smallest c USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""
OP9_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
OP2_SQL = r"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT page_id, payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first_id FROM payloads
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (substr(unhex(hex)::BIT::VARCHAR, (i * 5 + 1)::BIGINT, 5)::BIT::INTEGER + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named
"""
OP11_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
    ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM lines
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
OP13_SQL = r"""
WITH tokens AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM tokens GROUP BY doc_id
), totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sizes
), held AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM tokens GROUP BY doc_id, t
), weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY t, docs
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN held USING (t) JOIN weights USING (t) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
ORACLE: dict[str, str] = {
    "op2_warc_pages": OP2_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op9_top_k": OP9_SQL,
    "op10_mix_sources": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}
