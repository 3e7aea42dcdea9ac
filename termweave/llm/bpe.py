"""Operator 1: exact BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word, exactly one token can be the last one of the
prefix's encoding.  An automaton that reads the prefix backwards lists the
vocabulary tokens it ends with (its suffix matches); of these, the unique last
token is the one that is compatible with the last token of the prefix it
leaves over.  Two neighbouring tokens are compatible when, while each is being
merged, no merge across their border comes first.  Following the back-pointers from
the whole word gives the ids, without running merges over whole words.

Edge cases: a null or empty text has no ids and decodes to an empty text; a null
id list decodes to null; ids outside the vocabulary are skipped by ``decode``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from termweave.llm.common import map_texts

# Stretches of text a task remembers twice over (see Memory), of at most so many
# letters each, so that the memory is bounded in bytes; the prefixes and
# token pairs it remembers, the prefixes of at most so many letters.
WORD_MEMORY = 150_000
WORD_LETTERS = 64
SMALL_MEMORY = 300_000
PREFIX_LETTERS = 10
# Marks that end a word and never begin one of the pattern's contractions.
STOPS = ".,;:!?*%$&#|)"
SPLIT = regex.compile(r"\s+")


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file says: tokens by id, merges by rank, special tokens,
    the pattern of words and the mark of a word's end."""

    tokens: tuple
    merges: tuple
    special: tuple
    pattern: str
    word_end: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read on the driver; the size is that of the vocabulary file."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = dict(spec["model"]["vocab"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab.update(special)
        tokens = [None] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            tokens[i] = token
        merges = tuple(tuple(m.split(" ")) if isinstance(m, str) else tuple(m)
                       for m in spec["model"]["merges"])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return cls(tuple(tokens), merges, tuple(special.items()), split["pattern"]["Regex"],
                   spec["model"]["end_of_word_suffix"] or "")


def byte_letters() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Encoder:
    """Per-task state: the automaton and the memories of words and pairs."""

    def __init__(self, v: Vocabulary):
        self.ids = {t: i for i, t in enumerate(v.tokens) if t is not None}
        special = dict(v.special)
        self.rank = {pair: r for r, pair in enumerate(v.merges)}
        self.word_end = v.word_end
        self.letters = dict(enumerate(byte_letters()))
        # Backward automaton: state 0 has read nothing; accept[state] is the token.
        self.step: dict[tuple[int, str], int] = {}
        self.accept: list[str | None] = [None]
        for token in self.ids:
            if token in special:
                continue
            state = 0
            for symbol in reversed(self.split(token)):
                nxt = self.step.get((state, symbol))
                if nxt is None:
                    nxt = self.step[state, symbol] = len(self.accept)
                    self.accept.append(None)
                state = nxt
            self.accept[state] = token
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})  # both bounded by the vocabulary
        self.reachable: dict[str, bool] = {}
        self.prefixes: dict[str, str] = {}  # last token of a word's beginning
        self.stretches = Memory(self.stretch)
        self.others = Memory(self.word)  # short words that are not letters
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") \
            if special else None
        self.wide = regex.compile(v.pattern)

    def split(self, token: str) -> tuple:
        """A token's symbols: its byte letters, the last with the end mark."""
        if self.word_end and token.endswith(self.word_end) and len(token) > len(self.word_end):
            body = token[:-len(self.word_end)]
            return (*body[:-1], body[-1] + self.word_end)
        return tuple(token)

    def halves(self, token: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes ``token`` out of its own symbols;
        None if merging by rank does not end in it (or it is one symbol)."""
        parts = list(self.split(token))
        last = None
        while len(parts) > 1:
            r, k = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:])))
            if r == 1 << 60:
                return None
            last = parts[k], parts[k + 1]
            parts[k:k + 2] = ["".join(last)]
        return last

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts that stand at the left (0) or right (1) edge while ``token``
        is being merged, each with the rank of the merge that absorbs it."""
        got = self.edges[side].get(token)
        if got is None:
            got, part, absorbed = [], token, 1 << 60
            while part is not None:
                got.append((part, absorbed))
                two = self.halves(part)
                absorbed = self.rank[two] if two else 0
                part = two[side] if two else None
            self.edges[side][token] = got
        return got

    def compatible(self, a: str, b: str) -> bool:
        """No part of ``a``'s right edge merges with one of ``b``'s left edge while
        both stand at the border.  At equal rank the left merge comes first."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= SMALL_MEMORY:
                self.pairs.clear()
            rank, left = self.rank, self.edge(b, 0)
            ok = True
            for p, p_end in self.edge(a, 1):
                for q, q_end in left:
                    r = rank.get((p, q))
                    if r is not None and r < p_end and r <= q_end:
                        ok = False
            self.pairs[a, b] = ok
        return ok

    def alone(self, token: str) -> bool:
        """A token that merging can reach from its own symbols."""
        ok = self.reachable.get(token)
        if ok is None:
            ok = self.reachable[token] = len(self.split(token)) == 1 or self.halves(token) is not None
        return ok

    def word(self, word: str) -> bytes:
        """Ids of one word, packed: last token of every prefix, then back-pointers."""
        letters = [self.letters[b] for b in word.encode("utf-8")]
        letters[-1] += self.word_end
        step, accept, reachable, pairs = self.step, self.accept, self.reachable, self.pairs
        n, line, known = len(letters), "".join(letters), self.prefixes
        last: list[str | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        for end in range(1, n + 1):
            short = end <= PREFIX_LETTERS and end < n
            if short:
                token = known.get(line[:end])
                if token is not None:
                    last[end], back[end] = token, end - len(token)
                    continue
            state, start = 0, end
            while start:
                start -= 1
                state = step.get((state, letters[start]))
                if state is None:
                    break
                token = accept[state]
                if token is None or not (reachable.get(token) or self.alone(token)):
                    continue
                before = last[start]
                if not start or before is not None and (
                        pairs[before, token] if (before, token) in pairs else self.compatible(before, token)):
                    last[end], back[end] = token, start
                    break
            if short and last[end] is not None:
                if len(known) >= SMALL_MEMORY:
                    known.clear()
                known[line[:end]] = last[end]
        out, end = [], n
        while end:
            out.append(self.ids[last[end]])
            end = back[end]
        return array("i", out[::-1]).tobytes()

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids of the whole text."""
        return iter(np.frombuffer(self.packed(text), np.int32).tolist())

    def packed(self, text: str | None) -> bytes:
        """Ids of the whole text, four bytes each.  No word holds white space, so the
        text is cut there first and each stretch is looked up as a whole; the ids
        are joined as bytes and never become Python numbers one by one."""
        if not text:
            return b""
        if not self.cut or "<" not in text:
            return self.plain(text)
        return b"".join([array("i", [self.special[p]]).tobytes() if p in self.special else self.plain(p)
                         for p in self.cut.split(text)])

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # letter by letter: a final capital sigma is lower-cased like any other
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        # str.split() also cuts at four control characters that are no white space here
        cut = SPLIT.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.stretches.__getitem__, cut))

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch without white space.  A run of letters is one word, and
        the marks after it are another; other stretches are cut by the pattern."""
        head = text.rstrip(STOPS)
        if head.isalpha():
            return self.word(text) if head == text else self.stretches[head] + self.marks(text[len(head):])
        return b"".join(map(self.part, self.wide.findall(text)))

    def part(self, word: str) -> bytes:
        return self.stretches[word] if word.isalpha() else self.marks(word)

    def marks(self, word: str) -> bytes:
        return self.word(word) if len(word) > 8 else self.others[word]


class Memory(dict):
    """A dict that fills itself by ``fn``.  When full it keeps one older
    generation, so words in use survive; long keys are not kept."""

    def __init__(self, fn):
        super().__init__()
        self.fn, self.older = fn, {}

    def __missing__(self, key):
        if len(key) > WORD_LETTERS:
            return self.fn(key)
        if len(self) >= WORD_MEMORY:
            self.older = dict(self)
            self.clear()
        got = self.older.get(key)
        if got is None:
            got = self.fn(key)
        self[key] = got
        return got


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Append the ids of every whole text as ``out`` (array<int>).  The vocabulary
    file is read by the driver and broadcast; its size is fixed by the file."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def make():
        enc = Encoder(shared.value)  # for one task: an idle worker keeps nothing of it

        def apply(texts):
            blobs = [enc.packed(t) for t in texts]
            offsets = np.cumsum([0, *[len(b) // 4 for b in blobs]], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), np.int32)))]

        return apply

    return map_texts(df, text_col, f"`{out}` array<int>", make)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the text of ``ids_col``: this tokenizer has no decoder step, so the
    token strings (special ones included) are joined by one space."""
    tokens = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path).tokens)

    def make():
        table = pa.array(tokens.value, pa.string())
        known = table.is_valid().to_numpy(zero_copy_only=False)

        def apply(lists):
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            sizes = np.where(lists.is_valid(), lists.value_lengths().fill_null(0), 0)
            inside = (ids >= 0) & (ids < len(table))
            inside[inside] = known[ids[inside].astype(np.int64)]
            ends = np.concatenate([[0], np.cumsum(inside)])[np.concatenate([[0], np.cumsum(sizes)])]
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(pa.array(ids[inside].astype(np.int64))))
            return [pc.if_else(lists.is_valid(), pc.binary_join(words, " "), pa.scalar(None, pa.string()))]

        return apply

    return map_texts(df, ids_col, f"`{out}` string", make, as_arrow=True)
