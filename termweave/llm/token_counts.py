"""Operator 13: token counts from one count per distinct pre-token.

No piece of the vocabulary reaches over certain borders: a space that follows
anything but a space, and the two sides of a character that stands in no piece
of several letters.  Merging never crosses them, so a text's tokens are those of
its pre-tokens (the stretches between borders), whatever stands around.

1. ``pre_token_blocks``: documents are packed into blocks of a few MB; a block
   holds each document's pre-token frequencies (numbers into the block's list of
   distinct pre-tokens) and the other columns, not the texts;
2. the blocks' pre-tokens are dealt out by hash into buckets, packed; a bucket's are
   read block after block and the library counts every distinct one of the
   corpus once;
3. the counts are joined to their blocks again, where each document's sum of
   frequency times count is taken.

The ids of a document are never made.  A pre-token travels once per block, so a
frequent word has at most one row for each block, however often it stands there.

Memory of a task: one block (``BLOCK_BYTES`` of text, or one longer text's distinct
pre-tokens; long texts are cut into pre-tokens a segment at a time), or the distinct
pre-tokens of a bucket, some ``BUCKET_WORDS`` at most.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and
repeated or null ids are rows of their own; an empty table gives an empty result;
the text column is left out of the result, every other column is kept, but one
named like an added column gives way to it.  Building the plan runs two jobs (the
blocks are checkpointed and their pre-tokens numbered).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import checkpoint, named_back, positional, ship_package, shuffle_partitions

BLOCK_BYTES = 32_000_000
SEGMENT_CHARS = 1 << 20
SPACE = "▁"  # the vocabulary's mark of a space
BUCKET_WORDS = 1 << 20
BLOCKS_SCHEMA = "block long, n_words long, rows binary, freqs binary, words binary"


class PieceModel:
    """A piece model file: its bytes, and the pattern that cuts pre-tokens."""

    def __init__(self, path: str):
        """Read on the driver; the size is that of the file."""
        from sentencepiece import sentencepiece_model_pb2 as proto
        with open(path, "rb") as f:
            self.data = f.read()
        spec = proto.ModelProto()
        spec.ParseFromString(self.data)
        rules, kinds = spec.normalizer_spec, proto.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or rules.name != "identity" \
                or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("only BPE piece models that keep texts as they are can be counted by pre-token")
        if any(p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError("user-defined pieces may reach over the borders of pre-tokens")
        pieces = [p.piece for p in spec.pieces if p.type == kinds.NORMAL and len(p.piece) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece reaches over the border before a space")
        joined = "".join(map(re.escape, sorted({c for p in pieces for c in p} - {SPACE})))
        self.pattern = f" *[{joined}]+| +|[^ {joined}]+"
        single = {p.piece for p in spec.pieces if p.type == kinds.NORMAL}
        self.border = next(c for c in map(chr, range(1, 256)) if c not in joined and c not in single and c != " ")


def segments(text: str) -> Iterator[str]:
    """A long text cut before spaces that follow something else."""
    border = re.compile("(?<=[^ ]) ")
    lo = 0
    while len(text) - lo > SEGMENT_CHARS:
        hit = border.search(text, lo + SEGMENT_CHARS)
        if hit is None:
            break
        yield text[lo:hit.start()]
        lo = hit.start()
    yield text[lo:]


def frequencies(text: str, cut: re.Pattern) -> Counter:
    """Pre-token frequencies of a whole text (with the space put before it)."""
    out: Counter = Counter()
    if text:
        for part in segments(" " + text.replace(SPACE, " ")):
            out.update(cut.findall(part))
    return out


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _open(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def pack_words(words: list[bytes]) -> tuple[int, int, bytes]:
    """Number of words, bytes when unpacked, and the packed words."""
    raw = np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words)
    return len(words), len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def open_words(n: int, size: int, packed: bytes) -> list[bytes]:
    raw = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
    ends = (4 * n + np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends], ends)]


def bucket_of(words: list[bytes]) -> np.ndarray:
    """32 bits of hash for each word; their first bits are its bucket."""
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def pack_pairs(cols: list[np.ndarray], times: list[np.ndarray]) -> bytes:
    """Numbers and frequencies of the documents of a block, by byte plane; the
    numbers of a document ascend and are kept as differences."""
    gaps, many = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for c, n in zip(cols, times):
        order = np.argsort(c)
        gaps.append(np.diff(c[order], prepend=0).astype(np.uint32))
        many.append(n[order].astype(np.uint32))
    planes = [np.ascontiguousarray(np.concatenate(x).view(np.uint8).reshape(-1, 4)[:, k])
              for x in (gaps, many) for k in range(4)]
    return _ipc(pa.table({f"p{k}": x for k, x in enumerate(planes)}))


def pair_sums(packed: bytes, sizes: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Sum of frequency times ``pieces`` for each document."""
    planes = _open(packed)
    gaps, times = (np.stack([planes.column(k).to_numpy() for k in x], axis=1).view("<u4").reshape(-1).astype(np.int64)
                   for x in (range(4), range(4, 8)))
    ends = np.cumsum(sizes)
    run = np.concatenate([[0], np.cumsum(gaps)])
    cols = run[1:] - np.repeat(run[ends - sizes], sizes)
    total = np.concatenate([[0], np.cumsum(pieces[cols] * times)])
    return total[ends] - total[ends - sizes]


def pre_token_blocks(df: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """Checkpointed blocks ``(block, n_words, rows, freqs, words)``: the rows without
    their texts, their pre-token frequencies, and the block's distinct pre-tokens,
    which are numbered in the order of their hashes, that is bucket by bucket."""
    base = positional(df)
    at, limit = df.columns.index(text_col), BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(pattern)
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        numbers: dict[str, int] = {}
        cols, times, lengths, size = [], [], [], 0

        def emit():
            nonlocal held, numbers, cols, times, lengths, size, number
            rows = pa.Table.from_batches(held).append_column("n_bytes", pa.array(lengths, pa.int64())).append_column(
                "pairs", pa.array([len(c) for c in cols], pa.int64()))
            words = [w.encode() for w in numbers]
            order = np.argsort(bucket_of(words), kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            packed = _ipc(pa.table({"word": pa.array([words[k] for k in order], pa.binary())}))
            row = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(words)], pa.int64()),
                 *[pa.array([x], pa.binary()) for x in (_ipc(rows), pack_pairs([place[c] for c in cols], times), packed)]],
                names=["block", "n_words", "rows", "freqs", "words"])
            held, numbers = [], {}
            cols, times, lengths, size = [], [], [], 0
            number += 1
            return row

        for batch in batches:
            lo = 0
            others = pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at],
                                                names=[n for k, n in enumerate(batch.schema.names) if k != at])
            bytes_of = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for k, (text, n_bytes) in enumerate(zip(batch.column(at), bytes_of)):
                if size and size + n_bytes > limit:
                    if k > lo:
                        held.append(others.slice(lo, k - lo))
                    lo = k
                    yield emit()
                found = frequencies(text.as_py() or "", cut)
                cols.append(np.fromiter([numbers.setdefault(w, len(numbers)) for w in found], np.int64, len(found)))
                times.append(np.fromiter(found.values(), np.int64, len(found)))
                lengths.append(n_bytes)
                size += n_bytes + 1
            if lo < batch.num_rows:
                held.append(others.slice(lo))
        if lengths:
            yield emit()

    return checkpoint(base.mapInArrow(run, BLOCKS_SCHEMA))


def dealt_words(blocks: DataFrame, bits: int) -> DataFrame:
    """``(bucket, block, n, size, words)``: each block's pre-tokens by bucket, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _open(payload).column(0).to_pylist()
                bucket = (bucket_of(words) >> np.uint32(32 - bits)).astype(np.int64)
                heads = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = [(int(bucket[lo]), block, *pack_words(words[lo:hi]))
                        for lo, hi in zip(heads, [*heads[1:], len(words)])]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int64(),
                                                                     pa.binary()))],
                        names=["bucket", "block", "n", "size", "words"])

    return blocks.select("block", "words").mapInArrow(run, "bucket int, block long, n int, size long, words binary")


def count_pieces(words: DataFrame, model: PieceModel) -> DataFrame:
    """``(of, bucket, pieces)`` for dealt words, the counts packed in their order.  The
    rows of a bucket follow each other in one task, which remembers the counts of
    the bucket: the library encodes each distinct pre-token once, behind a
    character that no piece joins to anything."""
    shared = words.sparkSession.sparkContext.broadcast((model.data, model.border))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor
        data, border = shared.value
        library = SentencePieceProcessor(model_proto=data)
        own = len(library.encode(border))
        now, known = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, block, n, size, packed = (c[row].as_py() for c in batch.columns)
                if bucket != now:
                    now, known = bucket, {}
                found = open_words(n, size, packed)
                new = [w for w in found if w not in known]
                for lo in range(0, len(new), 1024):
                    part = new[lo:lo + 1024]
                    ids = library.encode([border + w.decode() for w in part], num_threads=1)
                    known.update(zip(part, [len(x) - own for x in ids]))
                pieces = np.fromiter(map(known.__getitem__, found), "<u4", n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([bucket], pa.int32()),
                     pa.array([pa.compress(pieces.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
                     pa.array([n], pa.int32())], names=["of", "bucket", "pieces", "n"])

    return (words.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "of long, bucket int, pieces binary, n int"))


def count_tokens(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every row without its text, with ``n_bytes`` (UTF-8) and ``n_tokens`` of the
    whole text as the library gives them (no begin, end or added tokens)."""
    ship_package(df.sparkSession)
    model = PieceModel(path)
    at = df.columns.index(text_col)
    blocks = pre_token_blocks(df, text_col, model.pattern)
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = max(2 * shuffle_partitions(df.sparkSession), total // BUCKET_WORDS).bit_length()
    counted = count_pieces(dealt_words(blocks, bits), model)
    fields = [f for k, f in enumerate(positional(df).schema.fields) if k != at]
    schema = T.StructType(fields + T.StructType.fromDDL("r_n_bytes long, r_n_tokens long").fields)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(),
                           right.column("pieces").to_pylist()))
        pieces = np.concatenate([np.zeros(0, np.int64), *[
            np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4")
            for _, n, blob in parts]]).astype(np.int64)
        rows = _open(left.column("rows")[0].as_py())
        tokens = pair_sums(left.column("freqs")[0].as_py(), rows.column("pairs").to_numpy(), pieces)
        return rows.drop_columns(["pairs"]).append_column("n_tokens", pa.array(tokens)).rename_columns(schema.names)

    out = (blocks.select("block", "rows", "freqs").groupBy("block").cogroup(counted.groupBy("of"))
           .applyInArrow(run, schema))
    kept = [f"c{k}" for k in range(len(df.columns)) if k != at]
    return named_back(out.toDF(*[f"c{j}" for j in range(len(kept))], "r_n_bytes", "r_n_tokens"),
                      [n for k, n in enumerate(df.columns) if k != at], ["n_bytes", "n_tokens"])
