r"""Operator 2: substring deduplication with suffix automata of reference shards.

A window is ``window`` consecutive words of one document.  Every word covered
by a window whose word sequence also starts earlier (smaller id, or the same
document at an earlier word) is removed; windows are judged on the input.

The reference of a document is the corpus before it, so the automata cannot be
broadcast whole: they would grow with the corpus, and streaming every document
past every shard would be quadratic.  The shards are cut by content instead and
each document stretch is sent only to the shard that can match it:

1. the window's smallest k-gram hash (its anchor) is the same wherever the window
   stands; anchors that stand once in the corpus cannot repeat and drop out
   (``repeats.shared_keys``, four bytes an anchor), and anchors with more than
   ``CROWD`` stretches in the corpus become known;
2. consecutive windows with one anchor form a stretch of at most
   ``2 * window - k`` words, sent once per block to the shard of its anchor;
3. the shard builds one suffix automaton over the stretches of an anchor, with
   the earliest position of every state, and streams the stretches through it:
   the matching statistics say for each end of a window where it starts first;
4. the stretches of a crowded anchor grow with the corpus (a passage that many
   documents hold gives each of them stretches of its own at the borders), so
   their windows are dealt one by one, by the window's hash, and judged by the
   block they stand in first, as in operator 9.

Memory of a task follows the block (a few MB of text, or one longer text) and
a shard of about ``SHARD_WORDS`` words, in which no anchor has more than ``CROWD``
stretches.  Equal windows travel at most once per block.  Windows of crowded
anchors are equal if their 64-bit hashes are.

Edge cases: a null or empty text has no words; a text shorter than the window
loses nothing; rows that repeat id and text are one document (both keep the
same words); rows with one id and different texts are ordered by text; null ids
come first; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm import repeats as R
from termweave.llm.common import checkpoint, named_back, positional, release, tidy
from termweave.llm.rolling import Rolling, covered, mix

U = np.uint64
WINDOW, GRAM = 20, 8
SHARD_WORDS = 300_000  # words of the corpus for each shard
CROWD = 4_096  # stretches of an anchor that one automaton may have to hold


class Symbols(dict):
    """The 64-bit hash of a word (XXH64 of its bytes), remembered for a block."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit symbols of all words, and each text's first word and word count."""
    known = Symbols()
    parts = [np.fromiter(map(known.__getitem__, words), U, len(words)) for words in map(bytes.split, texts)]
    count = np.array([len(x) for x in parts], np.int64)
    return np.concatenate([np.zeros(0, U), *parts]), np.cumsum(count) - count, count


def smallest(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest value of every ``w`` in a row."""
    if len(values) < w:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(values)), 1
    best = values
    while size < w:
        step = min(size, w - size)
        take = best[:-step] <= best[step:]
        at = np.where(take, at[:-step], at[step:])
        best = np.where(take, best[:-step], best[step:])
        size += step
    return at


class Block:
    """The words, anchors and stretches of one block."""

    def __init__(self, payload: bytes, i: int, t: int, window: int, gram: int):
        self.table, self.texts, self.owner = R.block_rows(payload, i, t)
        self.symbols, self.first, self.count = word_symbols(self.texts)
        self.window = window
        n = len(self.symbols)
        rolling = self.rolling = Rolling(self.symbols)
        grams = rolling.every(gram)
        anchor = smallest(grams, window - gram + 1)
        ends = np.repeat(self.first + self.count, self.count)
        valid = np.flatnonzero(np.arange(n) + window <= ends)
        anchor = anchor[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
        head = np.flatnonzero(new)
        self.start = valid[head]  # first window of each stretch
        self.run = np.diff(np.append(head, len(valid)))  # its windows
        self.anchor = grams[anchor[head]]
        self.keys, self.inverse, self.times = np.unique(self.anchor, return_inverse=True, return_counts=True)
        self.doc = np.repeat(np.arange(len(self.texts)), self.count)[self.start]
        whole = R.text_keys(self.texts)
        self.whole, self.whole_at, self.whole_inverse = np.unique(whole, return_index=True, return_inverse=True)

    def settle(self, answers: list[dict], bits: int) -> None:
        """Copies of an earlier text, the stretches that may repeat, and the
        windows of crowded anchors."""
        earlier = R.bits_of(answers, 1, "earlier", self.whole, bits)
        self.copy = earlier[self.whole_inverse]
        self.copy |= self.whole_at[self.whole_inverse] < np.arange(len(self.texts))
        again = (self.times > 1) | R.bits_of(answers, 0, "other", self.keys, bits)
        chosen = np.flatnonzero(again[self.inverse] & ~self.copy[self.doc])
        crowded = R.bits_of(answers, 0, "earlier", self.keys, bits)[self.inverse[chosen]]
        self.chosen = chosen[~crowded]
        start, run = self.start[self.chosen], self.run[self.chosen]
        same = self.rolling.at(start, run + self.window - 1) ^ mix(run.astype(U))
        _, at, back = np.unique(same, return_index=True, return_inverse=True)
        self.is_first = at[back] == np.arange(len(back))
        start, run = self.start[chosen[crowded]], self.run[chosen[crowded]]
        self.windows = np.repeat(start - (np.cumsum(run) - run), run) + np.arange(run.sum())
        self.hashes, at, self.back = np.unique(self.rolling.at(self.windows, self.window),
                                               return_index=True, return_inverse=True)
        self.later = at[self.back] != np.arange(len(self.back))


def _keys(blocks: DataFrame, i: int, t: int, window: int, gram: int, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["payload"], i, t, window, gram)
                yield R.key_rows([*R.pack_keys(0, row["block"], b.keys, bits, 4, b.times),
                                  *R.pack_keys(1, row["block"], b.whole, bits, 8)])
        tidy()

    return blocks.mapInArrow(run, R.KEYS_SCHEMA)


STRETCHES = "kind int, bucket int, block long, anchor binary, start binary, run binary, symbols binary"


def _stretches(block: int, b: Block, shard_bits: int, window_bits: int) -> pa.Table:
    """Rows of STRETCHES: the first of each stretch, grouped by shard (kind 2), and
    the packed hashes of the windows of crowded anchors as symbols (kind 3)."""
    mine = b.chosen[b.is_first]
    shard = (b.anchor[mine] >> U(64 - shard_bits)).astype(np.int64)
    rows = []
    for s in np.unique(shard):
        of = mine[shard == s]
        spans = [b.symbols[x:x + n] for x, n in zip(b.start[of], b.run[of] + b.window - 1)]
        rows.append((2, int(s), block, b.anchor[of].tobytes(), b.start[of].astype(np.uint32).tobytes(),
                     b.run[of].astype(np.uint8).tobytes(), np.concatenate(spans).tobytes()))
    rows += [(kind, bucket, block, b"", b"", b"", keys) for kind, bucket, _, _, keys
             in R.pack_keys(3, block, b.hashes, window_bits, 8)]
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    names = ["kind", "bucket", "block", "anchor", "start", "run", "symbols"]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})


class SuffixAutomaton:
    """Suffix automaton of several sequences; every state knows the earliest
    end of its strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 62]

    def _state(self, nxt: dict, link: int, length: int, first: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list[int], base: int) -> None:
        """Insert a sequence whose first symbol stands at ``base``."""
        last = 0
        for k, symbol in enumerate(sequence):
            end = base + k
            q = self.next[last].get(symbol)
            if q is not None:  # an earlier sequence went this way
                if self.length[q] != self.length[last] + 1:
                    q = self._split(last, symbol, q)
                self.first[q] = min(self.first[q], end)
                last = q
                continue
            new = self._state({}, 0, self.length[last] + 1, end)
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
            last = new

    def close(self) -> None:
        """Hand the earliest ends on to the shorter suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.first[s] < self.first[p]:
                self.first[p] = self.first[s]

    def earliest(self, sequence: list[int], window: int) -> list[int]:
        """Matching statistics of a sequence, as the earliest end of the last
        ``window`` symbols at each place that has so many."""
        state, matched, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            while self.link[state] >= 0 and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window:
                out.append(self.first[state])
        return out


def _judge_shard(window: int):
    def run(group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_pylist()
        if group.column("kind")[0].as_py() == 3:
            return R.share(3, group.column("bucket")[0].as_py(), blocks, group.column("symbols").to_pylist(), 8)
        order = sorted(range(len(blocks)), key=blocks.__getitem__)
        rank = {k: r for r, k in enumerate(order)}
        members: dict[int, dict[bytes, list]] = {}
        masks = []
        for k, row in enumerate(group.to_pylist()):
            anchors = np.frombuffer(row["anchor"], U).tolist()
            starts = np.frombuffer(row["start"], np.uint32).tolist()
            runs = np.frombuffer(row["run"], np.uint8)
            ends = np.cumsum((runs.astype(np.int64) + window - 1) * 8).tolist()
            masks.append(np.zeros(len(runs), np.uint32))
            lo = 0
            for j, (a, s, hi) in enumerate(zip(anchors, starts, ends)):
                members.setdefault(a, {}).setdefault(row["symbols"][lo:hi], []).append(((rank[k] << 32) + s, k, j))
                lo = hi
        for found in members.values():
            heads = {seq: min(at)[0] for seq, at in found.items()}
            if len(found) > 1:
                auto = SuffixAutomaton()
                lists = {seq: np.frombuffer(seq, U).tolist() for seq in found}
                for seq in lists:
                    auto.add(lists[seq], heads[seq])
                auto.close()
            for seq, at in found.items():
                n = len(seq) // 8 - window + 1
                if len(found) > 1:
                    first = [e - window + 1 for e in auto.earliest(lists[seq], window)]
                else:
                    first = range(heads[seq], heads[seq] + n)
                for base, k, j in at:
                    masks[k][j] = sum(1 << o for o in range(n) if first[o] < base + o)
        n = len(blocks)
        return pa.table({"kind": pa.array([2] * n, pa.int32()), "bucket": group.column("bucket").cast(pa.int32()),
                         "block": pa.array(blocks, pa.int64()), "other": pa.array([b""] * n, pa.binary()),
                         "earlier": pa.array([m.tobytes() for m in masks], pa.binary())})

    return run


def dedup_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Append ``kept`` (kept words joined by one space), ``n_words`` and
    ``n_removed`` to every row.  ``window - gram`` must be below 32."""
    if not 1 <= gram <= window or window - gram >= 32:
        raise ValueError("gram must be at most window, and window - gram below 32")
    spark = df.sparkSession
    i, t = df.columns.index(id_col), df.columns.index(text_col)
    blocks = R.ordered_blocks(df, id_col, text_col)
    release(spark)
    words = (blocks.agg(F.sum("n_bytes")).first()[0] or 0) // 5
    bits = R.bucket_bits(2 * words // (window - gram + 2))
    shard_bits = max(3, (words // SHARD_WORDS).bit_length())
    window_bits = R.bucket_bits(words)
    seen = checkpoint(R.shared_keys(_keys(blocks, i, t, window, gram, bits), {0: 4, 1: 8}, {0: CROWD}))
    release(spark)

    def send(block: int, payload: bytes, answers: list[dict]) -> pa.Table:
        b = Block(payload, i, t, window, gram)
        b.settle(answers, bits)
        return _stretches(block, b, shard_bits, window_bits)

    judged = checkpoint(R.answer(blocks, seen, send, STRETCHES).groupBy("kind", "bucket")
                        .applyInArrow(_judge_shard(window), R.BITS_SCHEMA))
    release(spark)

    def finish(block: int, payload: bytes, answers: list[dict]) -> pa.Table:
        b = Block(payload, i, t, window, gram)
        b.settle(answers, bits)
        shard = (b.anchor[b.chosen] >> U(64 - shard_bits)).astype(np.int64)
        mask = np.full(len(b.chosen), (1 << 32) - 1, np.uint32)  # later copies in a block go whole
        for a in answers:
            if a["kind"] == 2:
                mask[b.is_first & (shard == a["bucket"])] = np.frombuffer(a["earlier"], np.uint32)
        start, run = b.start[b.chosen], b.run[b.chosen]
        gone = [start[hit] + o for o in range(int(run.max(initial=0)))
                if len(hit := np.flatnonzero((run > o) & (mask >> np.uint32(o) & np.uint32(1)).astype(bool)))]
        gone.append(b.windows[R.bits_of(answers, 3, "earlier", b.hashes, window_bits)[b.back] | b.later])
        removed = covered(np.concatenate(gone), window, len(b.symbols))
        kept, n_removed = [], []
        for k, text in enumerate(b.texts):
            lo, n = b.first[k], b.count[k]
            cut = np.full(n, n >= window) if b.copy[k] else removed[lo:lo + n]
            r = int(cut.sum())
            n_removed.append(r)
            kept.append(b" ".join(compress(text.split(), (~cut).tolist()) if r else text.split()))
        out = b.table
        for name, values in (("r_kept", pa.array(kept, pa.binary()).cast(pa.string())),
                             ("r_n_words", pa.array(b.count, pa.int64())),
                             ("r_n_removed", pa.array(n_removed, pa.int64()))):
            out = out.append_column(name, values.take(pa.array(b.owner)))
        return out

    schema = T.StructType(positional(df).schema.fields + T.StructType.fromDDL(
        "r_kept string, r_n_words long, r_n_removed long").fields)
    done = R.answer(blocks, seen.unionByName(judged), finish, schema)
    return named_back(done, df.columns, ["kept", "n_words", "n_removed"])
