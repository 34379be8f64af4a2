"""Word hashing of whole Arrow text columns with numpy: no Python object per word.

Texts of a batch lie end to end in one UTF-8 buffer. Words are maximal runs of word bytes within one text; each gets a
64-bit polynomial hash from one prefix sum, so the cost is linear in bytes, whatever the lengths of texts and words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but space and 0x09-0x0D.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of a multi-byte character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > 8 * CHUNK_BYTES:  # one very long text: don't keep its tables
            return up, down
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, from one prefix sum."""
    n = len(data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    first: int  #: index of the first text of the chunk in its batch
    n: int  #: texts in the chunk
    data: np.ndarray  #: lower-cased bytes of the chunk
    offsets: np.ndarray  #: n + 1 byte offsets of the texts in data
    hashes: np.ndarray  #: one per word
    starts: np.ndarray  #: byte offset of each word
    ends: np.ndarray
    bounds: np.ndarray  #: n + 1 word offsets of the texts


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lettered(texts: pa.Array) -> pa.Array:
    """texts in lower case, with a space for each character beyond ASCII that is no letter, digit or combining mark."""
    texts = pc.utf8_lower(texts)
    return pc.replace_substring_regex(texts, r"[^\x00-\x7F\pL\pN\pM]+", " ") if (text_buffer(texts)[0] >= 0x80).any() else texts


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most limit bytes together, or of one text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words(texts: pa.Array, word_bytes: np.ndarray = NON_SPACE) -> Iterator[Words]:
    """The hashed words of a string array, chunk by chunk; A-Z are lower-cased first."""
    data, offsets = text_buffer(texts)
    for lo, hi in chunks(offsets):
        base = offsets[lo]
        part, off = LOWER[data[base : offsets[hi]]], offsets[lo : hi + 1] - base
        n = len(part)
        if n == 0:
            none = np.zeros(0, np.int64)
            yield Words(lo, hi - lo, part, off, none.astype(np.uint64), none, none, np.zeros(hi - lo + 1, np.int64))
            continue
        inside = word_bytes[part]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[off[:-1][off[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[off[1:][off[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        hashes = prefix_hashes(part, starts, ends)
        yield Words(lo, hi - lo, part, off, hashes, starts, ends, np.searchsorted(starts, off))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the size consecutive words from each word on, and whether they lie within one text."""
    n = len(w.hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = w.hashes[: n - size + 1].copy()
    for k in range(1, size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hashes[k : n - size + 1 + k])
    ends = np.repeat(w.bounds[1:], np.diff(w.bounds))[: n - size + 1]
    return h, np.arange(size, n + 1) <= ends
