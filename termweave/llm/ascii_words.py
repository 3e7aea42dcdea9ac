"""Words of texts whose ASCII letters are lower-cased and whose other ASCII
characters, digits aside, separate words (operators 11 and 12).

Letters beyond ASCII stay as they are, so the work is done on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SEGMENT_BYTES = 1 << 20


def _fold() -> bytes:
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b if b in keep else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


FOLD = _fold()


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of one text in order, in lists that cover some SEGMENT_BYTES each
    (so a very long text never becomes one list); a word is never cut."""
    lo, n = 0, len(text)
    while lo < n:
        hi = lo + SEGMENT_BYTES
        if hi >= n:
            yield text[lo:].translate(FOLD).split()
            return
        folded = text[lo:hi].translate(FOLD)
        cut = folded.rfind(b" ")
        while cut <= 0:  # a word longer than a segment
            hi += SEGMENT_BYTES
            folded = text[lo:hi].translate(FOLD)
            cut = folded.rfind(b" ") if hi < n else len(folded)
        yield folded[:cut].split()
        lo += cut
