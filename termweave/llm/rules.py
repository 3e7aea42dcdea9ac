r"""Operator 7: quality rules as a short-circuit cascade.

Each rule looks at one text and may reject it.  On a bounded sample the
operator measures what a rule costs and how often it rejects, orders the rules
by rejections per second and then stops at a document's first rejection.  The
order changes the time only: a document is kept when no rule rejects it.

Words are ``[^\x20\x09-\x0D]+``.  A null text has no words and is rejected; an
empty table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from termweave.llm.common import map_texts, ship_package

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Rows that only decide the order of the rules.
SAMPLE_ROWS = 500


class Document:
    """A text whose measures are computed when a rule first asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that stand at least twice in the text."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        n, free = 0, 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                n += i + 3 - max(i, free)
                free = i + 3
        return n

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))


@dataclass(frozen=True)
class Rule:
    """``rejects(document)`` is True when the document has to go."""

    name: str
    rejects: object


def too_short(d: Document) -> bool:
    return d.n_words < 50


def repeats_itself(d: Document) -> bool:
    return 100 * d.n_repeat_words > 50 * d.n_words


def too_many_symbols(d: Document) -> bool:
    return 10 * d.n_symbols > 3 * d.n_words


def repeated_lines(d: Document) -> bool:
    return 2 * d.n_dup_lines > len(d.lines)


def odd_word_length(d: Document) -> bool:
    """Mean word outside 2 to 14 characters."""
    return not 2 * d.n_words <= d.word_chars <= 14 * d.n_words


def few_letters(d: Document) -> bool:
    return 2 * d.letters < d.word_chars


RULES = (Rule("too_short", too_short), Rule("repeats_itself", repeats_itself),
         Rule("too_many_symbols", too_many_symbols), Rule("repeated_lines", repeated_lines),
         Rule("odd_word_length", odd_word_length), Rule("few_letters", few_letters))


def rule_order(df: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES) -> list[int]:
    """Rule numbers by rejections per second on at most ``SAMPLE_ROWS`` rows.
    Costs are taken alone: each rule gets a fresh document."""
    ship_package(df.sparkSession)

    def run(batches):
        seconds, hits = [1e-9] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    hits[k] += rule.rejects(Document(text))
                    seconds[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"k": list(range(len(rules))), "s": seconds, "hits": hits})

    sample = df.select(df[text_col].alias("t")).limit(SAMPLE_ROWS)
    rows = sample.mapInArrow(run, "k long, s double, hits long").collect()  # a row for each rule and task
    s, h = Counter(), Counter()
    for r in rows:
        s[r["k"]] += r["s"]
        h[r["k"]] += r["hits"]
    return sorted(range(len(rules)), key=lambda k: (-h[k] / max(s[k], 1e-9), s[k]))


def first_rejection(d: Document, rules: tuple[Rule, ...], order: list[int]) -> str | None:
    return next((rules[k].name for k in order if rules[k].rejects(d)), None)


def cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
            order: list[int] | None = None) -> DataFrame:
    """Append ``kept`` (boolean) and ``rejected_by`` (the first rule in the chosen
    order that rejects; null if kept)."""
    order = rule_order(df, text_col, rules) if order is None else order

    def make():
        def apply(texts):
            got = [first_rejection(Document(t), rules, order) for t in texts]
            return [[g is None for g in got], got]
        return apply

    return map_texts(df, text_col, "kept boolean, rejected_by string", make)


def measured_cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                     order: list[int] | None = None) -> DataFrame:
    """:func:`cascade` together with the base measures of every document; a
    measure a rule has asked for is not computed twice."""
    order = rule_order(df, text_col, rules) if order is None else order

    def make():
        def apply(texts):
            cols = [[] for _ in range(8)]
            for t in texts:
                d = Document(t)
                by = first_rejection(d, rules, order)
                failed = too_short(d) or repeats_itself(d)
                row = (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words,
                       failed, by is None and not failed, by)
                for c, v in zip(cols, row):
                    c.append(v)
            return cols
        return apply

    return map_texts(df, text_col,
                     "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                     "n_repeat_words long, base_failed boolean, kept boolean, rejected_by string", make)
