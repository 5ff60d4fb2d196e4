"""The registered queries: shapes, SQL checks, and the pipeline against its operators by brute force."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from resurvey.llm import catalog, toxicity
from resurvey.llm.base import DOCUMENT_COLUMNS, fresh_path, shared_folder
from tests.llm.test_scores import brute_overlaps

SF = "/root/testdata/sf0.001"


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages(spark):
    """Each stage against its operator by brute force or SQL on the stage's own input; then run() against the chain."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    removed = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        before = {r.doc_id: r.text for r in rows}
        path = fresh_path(spark, f"stage-{k}")
        stage(spark, docs, SF).write.parquet(path)
        con = duckdb.connect()
        con.register("frame", docs.toPandas())
        con.execute("CREATE TABLE documents AS SELECT * FROM frame")
        judged = docs
        docs = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        removed[name] = set(before) - set(after)
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.toxicity(judged, labels).where("predicted = 1").collect()}
            assert removed[name] == want and want
        elif name == "line dedup":
            want = dict(con.execute(f"SELECT doc_id, text_md5 FROM ({catalog.LINE_SQL})").fetchall())
            assert {d: hashlib.md5(t.encode()).hexdigest() for d, t in after.items()} == want and after != before
        elif name == "near dedup":
            want = {d for d, kept in con.execute(f"SELECT doc_id, kept FROM ({catalog.NEAR_SQL})").fetchall() if not kept}
            assert removed[name] == want and want
        elif name == "decontamination":
            assert removed[name] == {d for d, _ in brute_overlaps(list(before.items()), items)} and removed[name]
        else:
            assert after == before
        if name not in ("line dedup", "byte bpe"):
            assert all(after[d] == before[d] for d in after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(DOCUMENT_COLUMNS)
    chain = {r.doc_id: (r.n_tokens, bytes(r.ids), r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, bytes(r.ids), r.text) for r in corpus_pipeline.run(spark, SF).collect()} == chain


def test_stages_take_odd_rows(spark, corner, corner_rows):
    """NULLs in any column, empty texts, repeated rows and further columns."""
    docs = corner.select("doc_id", "text", "lang", "source", "n_chars", F.lit(3).alias("extra"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert rows and (name == "byte bpe" or docs.columns == list(DOCUMENT_COLUMNS))
        # texts without words are copies of nothing
        assert {0, 1, 2, 3} <= {r.doc_id for r in rows}


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())


def test_warc_query(spark):
    con = duckdb.connect()
    want = con.execute(f"SELECT page_id, strlen(coalesce(html, '')) FROM '{SF}/pages.parquet'").fetchall()
    got = entry.queries()["op6_warc_captures"](spark, SF).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted(want)
