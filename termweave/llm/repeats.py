"""Exchange of window keys between blocks of documents.

The two exact deduplicators (words with suffix automata, bytes with a
difference cover) share this frame:

* ``ordered_blocks`` range-partitions the documents by id and text and packs them into
  blocks of a few MB (compressed Arrow).  Block numbers follow the document
  order, so "starts earlier" between two blocks is a comparison of two numbers
  and no document id has to travel with a window.
* A block first settles everything it can by itself: of several equal keys in
  one block only the first is sent.  A passage that a third of all documents
  hold therefore arrives once per block, not once per document.
* ``pack_keys`` sends the sorted distinct keys of a block to hash buckets as
  delta-coded bytes, and ``shared_keys`` answers two bits per key: does another
  block hold it, does an earlier block hold it.
* ``answer`` brings bits and blocks together again by block number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import checkpoint, positional, ship_package, shuffle_partitions, tidy

U = np.uint64
BLOCK_BYTES = 2_000_000  # a task holds some 40 bytes for each
KEYS_PER_BUCKET = 1 << 20
ZSTD_LEVEL = 5  # blocks travel twice and lie in the checkpoint folder meanwhile
RANGE_CHARS = 32  # of the text in range bounds, which the driver samples

KEYS_SCHEMA = "kind int, bucket int, block long, bits int, keys binary"
BITS_SCHEMA = "kind int, bucket int, block long, other binary, earlier binary"


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def open_block(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def ordered_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Checkpointed ``(block, n_bytes, payload)``; blocks ascend with
    ``(id, text)``, null ids first, and equal rows share a block."""
    ship_package(df.sparkSession)
    base = positional(df)
    i, t = df.columns.index(id_col), df.columns.index(text_col)
    limit = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def emit():
            nonlocal held, size, number
            table = pa.Table.from_batches(held)
            row = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([_ipc(table)], pa.binary())], names=["block", "n_bytes", "payload"])
            held, size, number = [], 0, number + 1
            return row

        last = last_text = None
        for batch in batches:
            ids, texts = batch.column(i).to_pylist(), batch.column(t)
            sizes = pc.fill_null(pc.binary_length(batch.column(t)), 0).to_pylist()
            lo = 0
            for k, (row_id, n) in enumerate(zip(ids, sizes)):
                if size + n > limit and size and (row_id != last or texts[k].as_py() != (
                        texts[k - 1].as_py() if k else last_text)):
                    if k > lo:
                        held.append(batch.slice(lo, k - lo))
                    lo = k
                    if held:
                        yield emit()
                size, last = size + n, row_id
            if batch.num_rows:
                last_text = texts[batch.num_rows - 1].as_py()
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
        if held:
            yield emit()
        tidy()

    n = shuffle_partitions(df.sparkSession)
    return checkpoint(base.repartitionByRange(n, F.col(f"c{i}").asc_nulls_first(),
                                              F.substring(f"c{t}", 1, RANGE_CHARS).asc_nulls_first())
                      .sortWithinPartitions(F.col(f"c{i}").asc_nulls_first(), f"c{t}")
                      .mapInArrow(run, "block long, n_bytes long, payload binary"))


def block_rows(payload: bytes, i: int, t: int) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """The block's table, its distinct (id, text) rows as UTF-8 in order, and
    for each table row the number of its distinct row."""
    table = open_block(payload)
    ids = table.column(i).to_pylist()
    texts = [b"" if x is None else x for x in
             table.column(t).cast(pa.binary()).to_pylist()]
    distinct: list[bytes] = []
    owner = np.zeros(len(ids), np.int64)
    for k, (row_id, text) in enumerate(zip(ids, texts)):
        if not k or row_id != ids[k - 1] or text != texts[k - 1]:
            distinct.append(text)
        owner[k] = len(distinct) - 1
    return table, distinct, owner


def text_keys(texts: list[bytes]) -> np.ndarray:
    """64 bits of each whole text's SHA-256, to find exact copies."""
    return np.array([int.from_bytes(hashlib.sha256(x).digest()[:8], "little") for x in texts], U)


def bucket_bits(keys: int) -> int:
    """Buckets are a power of two so that each holds about KEYS_PER_BUCKET keys."""
    return max(3, (max(keys, 1) // KEYS_PER_BUCKET).bit_length())


def pack_keys(kind: int, block: int, keys: np.ndarray, bits: int, width: int,
              times: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of KEYS_SCHEMA for sorted distinct ``keys``.  The top ``bits`` of a
    key choose its bucket; the next ``width`` bytes travel, delta-coded by byte
    plane.  Keys cut to fewer than 64 bits may only be used to rule out.  A last
    plane holds ``times``, rounded up to a power of two, where they are given."""
    cut = max(0, 64 - bits - 8 * width)
    top = (keys >> U(64 - bits)).astype(np.int64)
    rest = (keys << U(bits)) >> U(bits)
    rest >>= U(cut)
    power = b"" if times is None else np.ceil(np.log2(times)).astype(np.uint8).tobytes()
    starts = np.flatnonzero(np.diff(top, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(keys)]):
        delta = np.diff(rest[lo:hi], prepend=U(0)).astype("<u8")
        planes = delta.view(np.uint8).reshape(-1, 8)[:, :width].T
        yield kind, int(top[lo]), block, bits, np.ascontiguousarray(planes).tobytes() + power[lo:hi]


def _unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(-1, n)
    full = np.zeros((n, 8), np.uint8)
    full[:, :len(planes)] = planes.T
    return np.cumsum(full.reshape(-1).view("<u8"), dtype=U)


def key_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
        names=["kind", "bucket", "block", "bits", "keys"])


def share(kind: int, bucket: int, blocks: list[int], blobs: list[bytes], width: int,
          limit: int | None = None) -> pa.Table:
    """Rows of BITS_SCHEMA for the packed keys of one bucket (see ``shared_keys``)."""
    numbers = np.array(blocks, np.int64)
    order = np.argsort(numbers, kind="stable")
    counts = np.array([len(b) // (width + (limit is not None)) for b in blobs])
    sizes = counts[order]
    values = np.concatenate([_unpack(blobs[k][:width * counts[k]], counts[k]) for k in order])
    rank = np.argsort(values, kind="stable")  # equal keys stay in block order
    ordered = values[rank]
    same = ordered[1:] == ordered[:-1]
    earlier, other = np.zeros(len(values), bool), np.zeros(len(values), bool)
    earlier[rank[1:]] = same
    other[rank[1:]] = same
    other[rank[:-1]] |= same
    if limit is not None:
        power = np.concatenate([np.frombuffer(blobs[k], np.uint8)[width * counts[k]:] for k in order])
        heads = np.flatnonzero(np.append(True, ~same))
        total = np.add.reduceat(np.left_shift(1, power[rank].astype(np.int64)), heads)
        earlier[rank] = np.repeat(total > limit, np.diff(np.append(heads, len(values))))
    cuts = np.cumsum(sizes)[:-1]
    packed = [[np.packbits(x).tobytes() for x in np.split(a, cuts)] for a in (other, earlier)]
    n = len(order)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()),
                     "block": pa.array(numbers[order], pa.int64()),
                     "other": pa.array(packed[0], pa.binary()), "earlier": pa.array(packed[1], pa.binary())})


def shared_keys(keys: DataFrame, widths: dict[int, int], limits: dict[int, int] | None = None) -> DataFrame:
    """Two bits for each key of each block: held by another block, held by an
    earlier block.  A bucket has at most one copy of a key for each block.  Keys
    of a kind in ``limits`` come with ``times``, and their second bit says instead
    whether all blocks together hold the key more often than the limit."""
    limits = limits or {}

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        out = share(kind, group.column("bucket")[0].as_py(), group.column("block").to_pylist(),
                    group.column("keys").to_pylist(), widths[kind], limits.get(kind))
        tidy()
        return out

    return keys.groupBy("kind", "bucket").applyInArrow(run, BITS_SCHEMA)


def bits_of(answers: list[dict], kind: int, which: str, keys: np.ndarray, bits: int) -> np.ndarray:
    """The answered bits in the order of the block's sorted distinct ``keys``."""
    out = np.zeros(len(keys), bool)
    if not len(keys):
        return out
    top = (keys >> U(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(top, prepend=-1))
    span = {int(top[lo]): (lo, hi) for lo, hi in zip(starts, [*starts[1:], len(keys)])}
    for a in answers:
        if a["kind"] == kind:
            lo, hi = span[a["bucket"]]
            out[lo:hi] = np.unpackbits(np.frombuffer(a[which], np.uint8), count=hi - lo).astype(bool)
    return out


def answer(blocks: DataFrame, answers: DataFrame, fn: Callable[[int, bytes, list[dict]], pa.Table],
           schema: T.StructType | str) -> DataFrame:
    """``fn(block, payload, answers)`` for every block, answered or not."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [fn(r["block"], r["payload"], right.to_pylist()) for r in left.to_pylist()]
        tidy()
        return pa.concat_tables(out)

    return (blocks.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(run, schema))
