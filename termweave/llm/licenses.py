r"""Operator 6: licence scans by template-markup matching.

A template is wording with markup: ``[[ ... ]]`` is an optional region (may be
left out), ``{{n}}`` a replaceable region of at most n words (a name, a year).
Each template is compiled once into a small automaton over words; a text is
accepted where all mandatory wording stands in order, exactly, with nothing
else between but the optional and replaceable regions.  The automaton starts
only where a template's first word stands, so most texts cost one search.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.
Besides the templates, base phrases are counted where their words stand
consecutively.  A null or empty text has no words, no labels and score 0;
repeated rows give equal results; an empty table gives an empty result; extra
columns are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from termweave.llm.common import map_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of common notices, with the markup described above.
TEMPLATES = {
    "gpl-notice": "licensed under [[the terms of]] the [[gnu]] general public license "
                  "[[as published by the free software foundation]] [[version {{1}}]]",
    "gpl-grant": "you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] "
                 "general public license as published by the free software foundation",
    "cc-by-notice": "licensed under [[a]] [[creative commons]] cc by {{3}}",
    "cc-notice": "licensed under a creative commons {{6}} license",
    "all-rights-notice": "copyright [[c]] {{8}} all rights reserved",
    "rights-statement": "all rights reserved [[by {{4}}]] no part of this {{3}} may be reproduced",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-notice": "[[released]] [[licensed]] under the mit license",
    "apache-notice": "licensed under the apache license [[version {{2}}]]",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted",
    "public-domain": "[[dedicated to]] [[released into]] the public domain [[under cc0]] without restriction",
}

_TOKEN = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+")


@dataclass(frozen=True)
class Automaton:
    """``on[state]`` maps a word to a state, ``free[state]`` is the state any word
    leads to, ``skip[state]`` the states reached without a word."""

    on: tuple
    free: tuple
    skip: tuple
    final: int
    first: frozenset

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[str], at: int) -> int:
        """End of the longest acceptance that starts at word ``at``; -1 if none."""
        states, end, k = self.closure({0}), -1, at
        while states:
            if self.final in states:
                end = k
            if k == len(words):
                break
            w, k = words[k], k + 1
            nxt = {self.on[s][w] for s in states if w in self.on[s]}
            nxt |= {self.free[s] for s in states if self.free[s] is not None}
            states = self.closure(nxt)
        return end


def compile_template(template: str) -> Automaton:
    """Markup to automaton: a chain of states, a skip around each optional region,
    and n skippable any-word steps for a replaceable region of n words."""
    on, free, skip, opened = [{}], [None], [set()], []

    def grow() -> int:
        on.append({})
        free.append(None)
        skip.append(set())
        return len(on) - 1

    for token in _TOKEN.findall(template):
        here = len(on) - 1
        if token == "[[":
            opened.append(here)
        elif token == "]]":
            skip[opened.pop()].add(here)
        elif token.startswith("{{"):
            for _ in range(int(token[2:-2])):
                s = len(on) - 1
                free[s] = grow()
                skip[s].add(len(on) - 1)
        else:
            on[here][token] = grow()
    if opened:
        raise ValueError("an optional region is not closed")
    a = Automaton(tuple(on), tuple(free), tuple(map(frozenset, skip)), len(on) - 1, frozenset())
    begin = a.closure({0})
    if a.final in begin or any(free[s] is not None for s in begin):
        raise ValueError("a template begins with a mandatory or optional word")
    return Automaton(a.on, a.free, a.skip, a.final, frozenset(w for s in begin for w in on[s]))


class Scanner:
    """Templates and base phrases of a task."""

    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.base = [(p.split(" "), label) for p, label in base.items()]
        self.automata = {name: compile_template(t) for name, t in templates.items()}
        # a text without any of these letters has nothing to match
        keys = {max(p, key=len) for p, _ in self.base} | {
            max((w for s in a.on for w in s if self._needed(a, w)), key=len) for a in self.automata.values()}
        self.hint = re.compile("|".join(map(re.escape, sorted(keys))))

    @staticmethod
    def _needed(a: Automaton, word: str) -> bool:
        """Whether no acceptance avoids ``word``."""
        seen, todo = {0}, [0]
        while todo:
            s = todo.pop()
            for t in [*a.skip[s], *([a.free[s]] if a.free[s] is not None else []),
                      *[t for w, t in a.on[s].items() if w != word]]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return a.final not in seen

    def scan(self, text: str | None) -> tuple:
        text = (text or "").encode("utf-8").lower().decode("utf-8")  # bytes: A-Z only
        words = WORD.findall(text)
        if not self.hint.search(text):
            return len(words), 0, None, None, "", "", 0.0
        where: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            where.setdefault(w, []).append(k)
        places, base_labels, covered = [], set(), 0
        for phrase, label in self.base:
            for k in where.get(phrase[0], ()):
                if words[k:k + len(phrase)] == phrase:
                    places.append(k)
                    base_labels.add(label)
                    covered = max(covered, len(phrase))
        found = set()
        for name, a in self.automata.items():
            for k in (k for w in a.first for k in where.get(w, ())):
                end = a.accepts(words, k)
                if end >= 0:
                    found.add(name)
                    covered = max(covered, end - k)
        # whole notices count more than a phrase, and long wording more than short
        score = 0.0 if not covered else (0.5 if found else 0.25) + 0.5 * covered / (covered + 10)
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(base_labels | found)), score)


def scan(df: DataFrame, text_col: str = "text", base: dict[str, str] = BASE,
         templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Append ``n_words, n_base, first_word, last_word, base_labels, labels, score``."""

    def make():
        scanner = Scanner(base, templates)

        def apply(texts):
            return list(zip(*map(scanner.scan, texts)))
        return apply

    return map_texts(df, text_col, "n_words long, n_base long, first_word long, last_word long, "
                     "base_labels string, labels string, score double", make)
