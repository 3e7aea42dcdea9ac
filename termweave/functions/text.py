"""Text column functions (T1-T16): cleaning, tokenising, n-grams.

Every function maps ``Column -> Column`` using Spark built-ins only, so the
work stays in the JVM; the array lambdas are Spark higher-order functions.

Regex dialect notes.  The semantics follow Python ``re`` on ``str``:

* ``\\s`` there is every code point for which ``str.isspace()`` holds.  Java's
  ``\\s`` is narrower and RE2's (DuckDB) narrower still, so ``WS`` spells the
  class out; the same string works in Spark and in the DuckDB oracle.
* ``\\w`` there is Unicode letters, digits and ``_``: ``[\\p{L}\\p{N}_]``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's rules):
# - the Python whitespace class, written as code-point ranges
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# - the letters kept by the cleaner besides a-z and 0-9, in the order listed there
KEPT_LETTERS = "àâäæçéèêëïîôùûüÿœ"
# - URL and e-mail shapes removed by the cleaner (\S+ spelled with WS)
URL_PATTERN = rf"https?://[^{WS}]+|www\.[^{WS}]+"
EMAIL_PATTERN = rf"[^{WS}]+@[^{WS}]+"
# Same matches as EMAIL_PATTERN: a match always spans a whole non-space run
# (it can only start where a run starts and its greedy tail runs to the run's
# end), so anchoring the start at a run boundary removes the quadratic retries
# from every position inside long words.
EMAIL_AT_RUN_START = rf"(?<![^{WS}])[^{WS}]+@[^{WS}]+"
# - word tokens of the TF-IDF tokenisers: A = one or more word chars, B = two or more
WORD_A = r"[\p{L}\p{N}_]+"
WORD_B = r"[\p{L}\p{N}_]{2,}"

DEFAULT_MIN_LENGTH = 2


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def non_word_pattern(alphabet: str = KEPT_LETTERS) -> str:
    """Run of characters that are neither kept letters nor digits.

    The cleaner first maps every character outside ``a-z``, ``0-9``, the kept
    letters, whitespace and ``-`` to a space, then collapses runs of whitespace
    and hyphens to one space.  Both steps together replace each maximal run of
    "anything else" with one space, which is this single pattern.
    """
    return f"[^a-z0-9{alphabet}]+"


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: trim every Unicode whitespace code point."""
    return F.regexp_replace(_col(c), f"^[{WS}]+|[{WS}]+$", "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or whitespace-only text."""
    c = _col(c)
    return c.isNull() | ~c.rlike(f"[^{WS}]")


def clean_text(c: Column | str, alphabet: str = KEPT_LETTERS) -> Column:
    """T1 = T2..T7: lower, drop URLs, drop e-mails, keep the alphabet, collapse, strip.

    Null and empty input give ``''``.
    """
    return F.trim(F.regexp_replace(_without_addresses(c), non_word_pattern(alphabet), " "))


def _without_addresses(c: Column | str) -> Column:
    """Lower, drop URLs, drop e-mails."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    # the regexes only run on texts that can match (cheap substring tests first)
    t = F.when(t.contains("://") | t.contains("www."), F.regexp_replace(t, URL_PATTERN, "")).otherwise(t)
    return F.when(t.contains("@"), F.regexp_replace(t, EMAIL_AT_RUN_START, "")).otherwise(t)


def tokens_from_clean(cleaned: Column | str, stopwords: Iterable[str] | None = None,
                      min_length: int = DEFAULT_MIN_LENGTH) -> Column:
    """T8-T10 on an already cleaned column: split on spaces, keep tokens of at
    least ``min_length`` characters, drop stopwords (order and duplicates kept)."""
    return _kept(F.split(_col(cleaned), " "), stopwords, min_length)


def _kept(toks: Column, stopwords: Iterable[str] | None, min_length: int) -> Column:
    """Tokens of at least ``min_length`` characters that are no stopwords."""
    words = sorted(set(stopwords or ()))
    k = max(int(min_length), 1)  # '' (from splitting '') never survives

    def keep(x: Column) -> Column:
        cond = F.char_length(x) >= k
        if words:
            cond = cond & ~x.isin(words)
        return cond

    return F.filter(toks, keep)


def tokenize(c: Column | str, stopwords: Iterable[str] | None = None,
             min_length: int = DEFAULT_MIN_LENGTH, alphabet: str = KEPT_LETTERS) -> Column:
    """Clean + split + length filter + stopword removal -> ARRAY<STRING>.

    Pass ``stopwords=None`` for ``remove_stopwords=False``.  The runs of kept letters are
    taken out directly: the words that the cleaned text splits into.
    """
    runs = F.regexp_extract_all(_without_addresses(c), F.lit(f"[a-z0-9{alphabet}]+"), 0)
    return _kept(runs, stopwords, min_length)


def ngrams(tokens: Column | str, n: int) -> Column:
    """Every ``n`` consecutive tokens joined by one space, in order.

    ``n < 1`` or fewer than ``n`` tokens give an empty array; ``n == 1`` is the
    token array itself.  Built after stopword removal, so n-grams bridge
    removed words.
    """
    t = _col(tokens)
    if n < 1:
        return F.array().cast("array<string>")
    if n == 1:
        return t
    # shifted copies zipped element-wise: one lambda call per n-gram
    parts = [F.slice(t, i + 1, F.greatest(F.size(t) - n + 1, F.lit(0))) for i in range(n)]
    zipped = F.arrays_zip(*parts)
    fields = [str(i) for i in range(n)]
    joined = F.transform(zipped, lambda z: F.concat_ws(" ", *[z[f] for f in fields]))
    return F.when(F.size(t) >= n, joined).otherwise(F.array().cast("array<string>"))


def word_tokens(c: Column | str, min_chars: int = 1) -> Column:
    """The TF-IDF tokenisers on raw lower-cased text (no cleaning,
    no stopwords).  ``min_chars=1`` is tokeniser A (``\\b\\w+\\b``), ``2`` is
    tokeniser B (the vectorizer default ``\\b\\w\\w+\\b``)."""
    pattern = WORD_A if min_chars <= 1 else WORD_B
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(pattern), 0)


def ngram_range(tokens: Column | str, min_n: int, max_n: int) -> Column:
    """N-grams for every ``n`` in ``[min_n, max_n]``, smaller n first."""
    parts = [ngrams(tokens, n) for n in range(max(min_n, 1), max_n + 1)]
    if not parts:
        return F.array().cast("array<string>")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def sql_string_list(words: Sequence[str]) -> str:
    """A literal SQL list of strings (for the oracle queries)."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
