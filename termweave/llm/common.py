"""Helpers shared by the training-data operators.

Row-wise operators go through :func:`map_texts`: one ``mapInArrow`` over the
scan, no shuffle, every column of the input kept by position (so clashing or
repeated column names cannot break it).
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.session import ensure_checkpoint_dir, ship_package, spread

# Rows turned into Python objects at a time inside a task.
SLICE_ROWS = 32


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A given table, spread over the cluster when it comes in too few partitions."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*cols) if cols else df)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete the shuffle files of finished phases
    now: it acts when the JVM collects the unreachable plans.  Spark's listener
    bus still holds the query that ended last, so a trivial one ends first, and
    the Python gateway lets go of its objects once a second."""
    gc.collect()
    spark.range(1).count()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def tidy() -> None:
    """Hand freed memory back to the system.  A Python worker waits for its next task
    with whatever its allocators keep, next to the executor's full heap; called
    where a block or a task is done."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positional(df: DataFrame) -> DataFrame:
    """Columns renamed c0, c1, ... by position."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named_back(out: DataFrame, names: Iterable[str], extra: Iterable[str]) -> DataFrame:
    """Undo :func:`positional`; a kept column whose name an added column takes is
    dropped, so the operator's own columns win a clash."""
    extra = list(extra)
    keep = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in extra]
    return out.select(*keep, *[F.col(f"r_{n}").alias(n) for n in extra])


def map_texts(df: DataFrame, col: str, added: str, make: Callable[[], Callable[[list], list]],
              as_arrow: bool = False) -> DataFrame:
    """Append the columns ``added`` (a DDL string) computed from text column
    ``col``.  ``make()`` runs once per task and returns a function from a list
    of texts (None for null; with ``as_arrow`` the Arrow array) to a list of column
    value lists."""
    ship_package(df.sparkSession)
    fields = T.StructType.fromDDL(added)
    base = positional(df)
    at = df.columns.index(col)
    schema = T.StructType(base.schema.fields
                          + [T.StructField(f"r_{f.name}", f.dataType) for f in fields])
    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(f.dataType) for f in fields]
    tail = [f"r_{f.name}" for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                got = apply(part.column(at) if as_arrow else part.column(at).to_pylist())
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(got, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays],
                                                 names=[*part.schema.names, *tail])
        del apply
        tidy()

    return named_back(base.mapInArrow(run, schema), df.columns, [f.name for f in fields])
