"""The registered queries: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resurvey.llm import alignment, bpe, decontam, line_dedup, near_dedup, packing, quality, rans, shards, token_counts, toxicity, warc, whitening
from resurvey.llm.base import ORACLES, QUERIES, fresh_path, query, table, written

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 16
END_ID = 2
PACKED_END_ID = 1


@query("op1_kd_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = shards.shard_documents(docs, shards=SHARDS)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


LINE_SQL = f"""
WITH lines AS (
    SELECT doc_id, source, u.pos AS pos, u.line AS raw, trim(u.line, ' ') AS line
    FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u
), spread AS (
    SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
), marked AS (
    SELECT l.doc_id, l.pos, l.raw, l.line, s.line IS NOT NULL AS boiler FROM lines l LEFT JOIN spread s ON l.line = s.line
), per_doc AS (
    SELECT doc_id, count(*) AS n_lines, sum(boiler::INT) AS n_boilerplate,
           coalesce(string_agg(CASE WHEN NOT boiler THEN raw END, chr(10) ORDER BY pos), '') AS rest,
           bool_and(boiler) FILTER (line <> '') AS whole, string_agg(line, chr(10) ORDER BY pos) FILTER (line <> '') AS own
    FROM marked GROUP BY doc_id
), twins AS (
    SELECT own FROM per_doc WHERE whole GROUP BY own HAVING count(*) > 1
), judged AS (
    SELECT p.*, p.n_boilerplate > 0 AND NOT coalesce(p.whole AND p.own IN (SELECT own FROM twins), FALSE) AS cut FROM per_doc p
)
SELECT d.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.n_boilerplate, 0)::BIGINT AS n_boilerplate,
       (CASE WHEN p.cut THEN p.n_boilerplate ELSE 0 END)::BIGINT AS n_removed, md5(CASE WHEN p.cut THEN p.rest ELSE d.text END) AS text_md5
FROM documents d LEFT JOIN judged p ON p.doc_id = d.doc_id
"""


@query("op4_line_dedup", LINE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_boilerplate", "n_removed", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


NEAR_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT hash(s) AS h, s, list(doc_id) AS ids FROM shingles GROUP BY s HAVING count(*) > 1
), holders AS (
    SELECT doc_id, row_number() OVER () AS k, ids FROM (SELECT h, unnest(ids) AS doc_id, ids FROM shared)
), common AS (
    SELECT a, b, count(*) AS c FROM (SELECT doc_id AS a, unnest(ids) AS b FROM holders) WHERE a < b GROUP BY a, b
), near AS (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
    WHERE 100 * c.c >= 85 * (x.n + y.n - c.c)
), links AS (
    SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reach AS (
    SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""


@query("op5_near_duplicates", NEAR_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_benchmark_overlap")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_rans_token_ids")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "token-ids")
    rans.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return rans.read_ids(spark, path).withColumnRenamed("key", "doc_id")


@query("op6_warc_captures")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    # three joins read the records, so they are parsed once
    records = written(warc.read_records(spark, path, with_payload=False), "warc-records")
    return warc.page_digests(warc.captures(records))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op11_cost_balanced_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), PACKED_END_ID, with_ids=False)


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, _ = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found
