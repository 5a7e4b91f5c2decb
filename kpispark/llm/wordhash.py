"""Vectorised word and shingle hashing over Arrow string columns.

One Arrow batch is hashed as a whole: the UTF-8 buffer of the column is read
in place, so no Python object is made per word.  A word's hash is the
polynomial sum of its bytes, taken from one prefix sum over the buffer and
shifted back to the word's start by the inverse power (the base is odd, hence
invertible modulo 2**64), then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    key = str(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            out[done:2 * done] = out[:done] * step
            done *= 2
        _POWERS[key] = have = out
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-xor-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text).

    Words are runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z
    lower-cased; a word never runs over the end of its text.
    """
    n_texts = len(offsets) - 1
    if len(buf) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    low = buf + (((buf >= 65) & (buf <= 90)).view(np.uint8) << 5)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    first = space.copy()
    first[0] = True
    first[1:] = space[:-1]
    starts_at = offsets[:-1]
    first[starts_at[starts_at < len(buf)]] = True  # a text's first byte opens a word
    starts = np.flatnonzero(first & ~space)
    last = np.ones(len(buf), bool)
    last[:-1] = first[1:]
    last[:-1] |= space[1:]
    ends = np.flatnonzero(last & ~space) + 1
    sums = low.astype(np.uint64)
    sums += np.uint64(1)
    sums *= _powers(_BASE, len(buf))
    np.cumsum(sums, out=sums)
    h = sums[ends - 1]
    inner = starts > 0
    h[inner] -= sums[starts[inner] - 1]
    h *= _powers(_INV, len(buf))[starts]
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return mix64(h), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes sorted within each text, shingles per text).

    A text of 1 .. width-1 words has its whole word sequence as the one
    shingle; a text without words has none.
    """
    n_texts = len(counts)
    if len(words) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    ends = np.cumsum(counts)
    begins = ends - counts
    k = np.uint64(0xD1342543DE82EF95)
    rolled = np.zeros(len(words), np.uint64)
    full = len(words) - width + 1
    if full > 0:
        acc = words[:full].copy()
        for j in range(1, width):
            acc *= k
            acc += words[j:full + j]
        rolled[:full] = acc
    owner = np.repeat(np.arange(n_texts), counts)
    position = np.arange(len(words)) - begins[owner]
    keep = position <= (counts[owner] - width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    for t in short:  # at most width-1 words each
        acc = np.uint64(counts[t])
        with np.errstate(over="ignore"):
            for w in words[begins[t]:ends[t]]:
                acc = acc * k + w
        rolled[begins[t]] = acc
        keep[begins[t]] = True
    tokens, owner = mix64(rolled[keep]), owner[keep]
    per = np.bincount(owner, minlength=n_texts)
    cut = np.concatenate(([0], np.cumsum(per)))
    out = [np.unique(tokens[cut[t]:cut[t + 1]]) for t in range(n_texts)]
    sizes = np.fromiter((len(x) for x in out), np.int64, n_texts)
    return (np.concatenate(out) if n_texts else tokens), sizes
