"""Work on whole Arrow batches as flat arrays: bytes, words and their hashes, without a Python object per text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Odd multipliers of the rolling hashes (fixed values).
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _pow or len(_pow[base][0]) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _pow[base] = (out[0], out[1])
    p, q = _pow[base]
    return p[:n], q[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, from one running sum."""
    p, q = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * p[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_pieces(texts: pa.Array, most: int = 1 << 21):
    """(first row, row after the last) of stretches of at most `most` bytes; a longer single text stands alone."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to, texts.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row (nulls as empty) and where each text starts; one more offset ends the last."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return b, off - off[0]


def words_between(b: np.ndarray, off: np.ndarray, separators: bytes = b" \n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte range of each non-empty piece between separators, and the index of the first word of each text."""
    keep = np.ones(len(b) + 1, bool)
    keep[-1] = False
    for s in separators:
        keep[:-1] &= b != s
    # a word begins where the byte before is a separator or belongs to another text
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    before = np.r_[False, keep[:-1]]
    start = np.flatnonzero(keep & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~keep))
    return start, end, np.searchsorted(start, off)


@lru_cache(1)
def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each BMP character (0 other, 1 space, 2 digit, 3 small letter, 4 capital, 5 other letter or mark) and its lower case."""
    cls = np.zeros(0x10000, np.uint8)
    low = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        k = unicodedata.category(c)
        cls[i] = 1 if c.isspace() else 2 if k[0] == "N" else 3 if k == "Ll" else 4 if k in ("Lu", "Lt") else 5 if k[0] in "LM" else 0
        if k in ("Lu", "Lt") and len(x := c.lower()) == 1:
            low[i] = ord(x)
    return cls, low


@lru_cache(1)
def word_table() -> np.ndarray:
    """Whether a character is a letter or a digit, for each code point."""
    out = np.zeros(0x110000, bool)
    for i in range(0x110000):
        out[i] = unicodedata.category(chr(i))[0] in "LN"
    return out


def shingle_sets(texts: list[str], k: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), sorted by both: the different k-word sequences of each text of at least `least_words` words.

    Words are the lower-cased unbroken stretches of letters and digits.
    """
    _, low_of = char_tables()
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    inside = word_table()[cp]
    before = np.r_[False, inside[:-1]]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    low = np.where(cp < 0x10000, low_of[np.minimum(cp, 0xFFFF)], cp)
    h = span_hash(low + np.uint32(1), start, end)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    words = np.bincount(text, minlength=len(texts))
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.arange(len(h) - k + 1)
    g, of = span_hash(h, i, i + k).view(np.int64), text[: len(i)]
    ok = (of == text[k - 1 :]) & (words[of] >= least_words)
    g, of = g[ok], of[ok]
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (of[1:] != of[:-1])] if len(g) else np.zeros(0, bool)
    return of[new], g[new]
