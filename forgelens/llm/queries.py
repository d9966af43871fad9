"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), end_id=0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.language import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.top_k import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.line_dedup import drop_repeated_runs

    return drop_repeated_runs(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.decontamination import digest, find_overlaps

    return digest(find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.tables import new_path
    from forgelens.llm.token_files import crc_of_ids, read_ids, write_ids

    path = new_path(spark, "token_files")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path(WORD_BPE), end_id=2)
    return crc_of_ids(read_ids(spark, path))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.tables import new_path
    from forgelens.llm.warc import read_warc, write_warc

    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).drop("url")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from forgelens.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_top_k": op5_top_k,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_decontamination": op9_decontamination,
    "op10_token_files": op10_token_files,
    "op11_divergence": op11_divergence,
    "op12_warc": op12_warc,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline,
}

#: Vectors are unnested: a product of two quantised vectors is a sum over positions.
_TOP_K_SQL = """
WITH flat AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS n FROM embeddings WHERE vec_id IS NOT NULL
), bad AS (
  SELECT DISTINCT vec_id FROM flat WHERE x IS NULL OR isnan(x) OR isinf(x)
), whole AS (
  SELECT vec_id, i, n, floor(256 * x)::BIGINT AS x FROM flat WHERE vec_id NOT IN (SELECT vec_id FROM bad)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.n = c.n AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""

_NEAR_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM d WHERE len(words) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle FROM starts
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), edges AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), ways AS (
  SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges
), components AS (
  WITH RECURSIVE reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM ways UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a)
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN components USING (doc_id)
"""

_OVERLAP_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), starts AS (
  SELECT item, words, least(10, len(words)) AS n, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM b WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(words[i : i + n - 1], ' ') AS w FROM starts
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lengths WHERE len(words) >= n
), hits AS (
  SELECT p.r, p.i, p.n, w.item FROM places p JOIN windows w ON w.n = p.n AND w.w = array_to_string(p.words[p.i : p.i + p.n - 1], ' ')
), counts AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counts USING (r) LEFT JOIN items USING (r)
"""

#: Dense: every kept term with every group of its language.
_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), t AS (
  SELECT lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3
), n AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY ALL
), langs AS (
  SELECT lang, sum(total)::HUGEINT AS total, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM groups g GROUP BY lang
), p AS (
  SELECT k.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 1) // (g.total + l.v) AS p
  FROM kept k JOIN groups g ON g.lang = k.lang JOIN langs l ON l.lang = k.lang LEFT JOIN n ON n.lang = k.lang AND n.term = k.term AND n.source = g.source
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(total) + any_value(v)) AS q FROM n JOIN langs USING (lang) GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.value), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS owner FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM o
"""

ORACLE_SQL: dict[str, str] = {"op5_top_k": _TOP_K_SQL, "op8_near_duplicates": _NEAR_SQL, "op9_decontamination": _OVERLAP_SQL, "op11_divergence": _DIVERGENCE_SQL, "op12_warc": _WARC_SQL}
