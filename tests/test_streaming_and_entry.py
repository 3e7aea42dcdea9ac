"""Streaming adapter and the driver entry points."""

import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from termweave.operators import terms as TM
from termweave.sources import docsets as DS
from termweave.streaming import per_document_stream


def test_per_document_stream_equals_batch(spark, sf_dir):
    out = tempfile.mkdtemp(prefix="tw-stream-")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet")
           .parquet(sf_dir).select(F.col("source").alias("set_id"), "doc_id", "text"))
    q = per_document_stream(src, f"{out}/sink", f"{out}/ckpt", ["de", "la"], (1,), 5,
                            trigger={"availableNow": True})
    q.awaitTermination(300)
    got = spark.read.parquet(f"{out}/sink").drop("batch_id")
    docs = DS.read_documents(spark, sf_dir)
    want = TM.density(TM.term_frequency(TM.doc_tokens(docs, ["de", "la"]), (1,)), 5)
    cols = ["set_id", "doc_id", "n", "term", "frequency", "rank"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50
