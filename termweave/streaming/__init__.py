"""Structured Streaming adapters.

The reference analyses a finite list of pages per request; it has no stream,
watermark or state.  What carries over to streams unchanged are the
per-document operators: a document (or page) is one row, so it never spans
two micro-batches and every per-document result of a micro-batch is final.
``per_document_stream`` runs them with ``foreachBatch`` and appends to a
table; set-level results (gaps, coverage, TF-IDF) need every document of a set
and stay batch jobs over the accumulated table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from termweave.operators import terms as TM


def per_document_stream(stream: DataFrame, sink_path: str, checkpoint: str,
                        stopwords: Iterable[str] | None, ns=(1, 2, 3), top_n: int = 30,
                        trigger: dict | None = None):
    """Top terms with density per (document, n) for a stream of
    ``(set_id, doc_id, text)`` rows, appended as Parquet to ``sink_path``.

    ``checkpoint`` must be on shared storage (the query's progress and the
    output commit log live there, so a restarted driver resumes exactly).
    Returns the started ``StreamingQuery``.
    """
    words = tuple(stopwords or ())

    def batch(df: DataFrame, batch_id: int) -> None:
        tf = TM.term_frequency(TM.doc_tokens(df, words), ns)
        out = TM.density(tf, top_n)
        # one folder per micro-batch, overwritten on a retry: idempotent output
        out.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**trigger) if trigger else writer
    return writer.start()
