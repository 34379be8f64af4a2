"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Every n-gram of a test item is a seed. A pass over the documents joins them with items by seeds; around the seeds found, the words of
document and item are aligned by Smith-Waterman (match 2, mismatch and gap -1). The score is the best local alignment divided by that
of a perfect copy; a pair with min_score or more that has a seed in common is a leak.

A rare seed, of at most RARE items, opens its items to a document at once. A frequent one, such as an opening that thousands of items
share, opens an item only if the document holds as many of the item's words as the score needs, were they all matched; the same is
then asked of each stretch around seeds before it is aligned. Both are upper bounds of the score, so no pair is lost.

Items are read in blocks of about ITEM_BYTES bytes; a block is broadcast, and a larger benchmark takes more passes. Words are runs of
letters and digits of any script, lower-cased; all other characters part words. Han, Hiragana and Katakana are written without blanks,
so each of their characters is a word. An item with fewer words than an n-gram has its whole sequence as seed.
Null or empty texts and items match nothing. Repeated rows of documents give repeated pairs; repeated items likewise. Empty tables
give no rows; extra columns are ignored. Of several places in a document the best counts, the first of equals. Very long texts are
searched whole, by stretches around their seeds; stretches are aligned together only as far as their tables stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, map_batches, saved
from .words import ALNUM, Words, lettered, mix, shingles, text_buffer, words

SEED_WORDS, RARE, ITEM_BYTES, PLACES, CELLS = 3, 16, 6_000_000, 1_000_000, 1 << 20
#: Stretches that are gathered from several documents before they are aligned.
STRETCHES = 4096
_FILTER_BITS = 22


def parted(texts: pa.Array) -> pa.Array:
    """texts as lettered, with blanks around each character of a script that is written without them."""
    texts = lettered(texts)
    return pc.replace_substring_regex(texts, r"([\p{Han}\p{Hiragana}\p{Katakana}])", r" \1 ") if (text_buffer(texts)[0] >= 0x80).any() else texts


def _flat(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 ... of each range of count rows, end to end."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Items:
    """Test items and their seeds."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.words, keys, items, places = ids, [], [], [], []
        for w in words(parted(pa.array(texts, pa.string())), ALNUM):
            h, inside = shingles(w, SEED_WORDS)
            for i in range(w.n):
                lo, hi = w.bounds[i], w.bounds[i + 1]
                item = w.hashes[lo:hi]
                k = h[lo : hi - SEED_WORDS + 1] if hi - lo >= SEED_WORDS else _short(item)
                keys.append(k)
                items.append(np.full(len(k), len(self.words)))
                places.append(np.arange(len(k)))
                self.words.append(item)
        none = np.zeros(0, np.int64)
        keys, items, places = (np.concatenate(x) if x else none for x in (keys, items, places))
        order = np.argsort(keys, kind="stable")
        self.items, self.places = items[order], places[order]
        self.seeds, self.first = np.unique(keys[order].astype(np.uint64), return_index=True)
        self.first = np.append(self.first, len(order))
        self.short = sorted({len(x) for x in self.words if 0 < len(x) < SEED_WORDS})
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.vocabulary, self.word = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]), return_inverse=True)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of a chunk where a seed starts, and which seed."""
        at, seed = [], []
        for size in (*self.short, SEED_WORDS):
            h, inside = shingles(w, size)
            h = h if size == SEED_WORDS else _short_runs(h, size)
            found = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & inside)
            where = np.searchsorted(self.seeds, h[found])
            where[where == len(self.seeds)] = 0
            ok = self.seeds[where] == h[found] if len(self.seeds) else np.zeros(len(found), bool)
            at.append(found[ok])
            seed.append(where[ok])
        at, seed = np.concatenate(at), np.concatenate(seed)
        order = np.argsort(at, kind="stable")
        return at[order], seed[order]

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that items have too, and their numbers in the vocabulary."""
        where = np.searchsorted(self.vocabulary, hashes)
        where[where == len(self.vocabulary)] = 0
        at = np.flatnonzero(self.vocabulary[where] == hashes)
        return at, where[at]


def _short_runs(h: np.ndarray, size: int) -> np.ndarray:
    return mix(h ^ np.uint64(size))


def _short(item: np.ndarray) -> np.ndarray:
    if not len(item):
        return np.zeros(0, np.uint64)
    x = item[:1]
    for k in range(1, len(item)):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + item[k : k + 1])
    return _short_runs(x, len(item))


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each window against its item, and the window position (exclusive) where it first ends."""
    n, rows, cols = len(items), max(map(len, windows)), max(map(len, items))
    item, text = np.zeros((n, cols), np.uint64), np.zeros((rows, n), np.uint64)
    has, there = np.zeros((n, cols), bool), np.zeros((rows, n), bool)
    for i, (a, b) in enumerate(zip(windows, items, strict=True)):
        item[i, : len(b)], has[i, : len(b)] = b, True
        text[: len(a), i], there[: len(a), i] = a, True
    ramp = np.arange(cols, dtype=np.int32)
    above = np.zeros((n, cols + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for r in range(rows):
        same = (item == text[r][:, None]) & has & there[r][:, None]
        now = np.maximum(np.maximum(above[:, :-1] + np.where(same, 2, -1), above[:, 1:] - 1), 0)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        now[~has] = 0
        above[:, 1:] = now
        top = now.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], r + 1
    return best, end


class Document:
    """The words of one document that items have too."""

    def __init__(self, hashes: np.ndarray, items: Items):
        self.items, self.n = items, len(hashes)
        self.at, self.word = items.known(hashes)
        self.keys = np.sort(self.word * (self.n + 1) + self.at)

    def holds(self, item: np.ndarray) -> np.ndarray:
        """Share of each item's words that occur anywhere in the document."""
        here = np.zeros(len(self.items.vocabulary), bool)
        here[self.word] = True
        return self._shares(item, lambda rows, word: here[word])

    def holds_within(self, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Share of each item's words that occur between two words of the document."""

        def found(rows: np.ndarray, word: np.ndarray) -> np.ndarray:
            k = np.searchsorted(self.keys, word * (self.n + 1) + first[rows])
            inside = k < len(self.keys)
            inside[inside] = self.keys[k[inside]] < (word * (self.n + 1) + last[rows])[inside]
            return inside

        return self._shares(item, found)

    def _shares(self, item: np.ndarray, found) -> np.ndarray:
        out, n = np.zeros(len(item)), self.items.lengths[item]
        for rows in _parts(n):
            hit = found(np.repeat(rows, n[rows]), self.items.word[_flat(self.items.starts[item[rows]], n[rows])])
            out[rows] = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[rows]) - n[rows]) / n[rows]
        return out


def _parts(size: np.ndarray) -> list[np.ndarray]:
    """Row numbers in runs of about PLACES together, by the size of each row."""
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // PLACES, prepend=-1))
    return np.split(np.arange(len(size)), cuts[1:]) if len(size) else []


def _stretches(at: np.ndarray, seed: np.ndarray, hashes: np.ndarray, items: Items, min_score: float) -> Iterator[tuple[int, int, int]]:
    """item, first and last (exclusive) word of each stretch of one document that may reach min_score, from its seeds and where they are."""
    doc = Document(hashes, items)
    seeds, which, times = np.unique(seed, return_inverse=True, return_counts=True)
    shared = items.first[seeds + 1] - items.first[seeds]
    flat = _flat(items.first[seeds], shared)
    item, place, which_seed = items.items[flat], items.places[flat], np.repeat(np.arange(len(seeds)), shared)
    opened = np.zeros(len(items.words), bool)
    opened[item[shared[which_seed] <= RARE]] = True
    others = np.unique(item[~opened[item]])
    if len(others):
        opened[others[doc.holds(others) >= min_score]] = True
    keep = np.flatnonzero(opened[item])
    keep = keep[np.argsort(item[keep], kind="stable")]
    item, place, which_seed = item[keep], place[keep], which_seed[keep]
    by_seed, before = np.argsort(which, kind="stable"), np.cumsum(times) - times
    new = np.flatnonzero(np.diff(item, prepend=-1))  # stretches of an item come from all its seeds
    for part in _parts(np.add.reduceat(times[which_seed], new) if len(new) else new):
        lo, hi = new[part[0]], new[part[-1] + 1] if part[-1] + 1 < len(new) else len(item)
        n = times[which_seed[lo:hi]]
        of, start = np.repeat(item[lo:hi], n), at[by_seed[_flat(before[which_seed[lo:hi]], n)]] - np.repeat(place[lo:hi], n)
        order = np.lexsort((start, of))
        of, start = of[order], start[order]
        cut = np.ones(len(of), bool)
        cut[1:] = (of[1:] != of[:-1]) | (np.diff(start) > items.lengths[of[1:]])
        first = np.flatnonzero(cut)
        last, of = np.append(first[1:], len(cut)) - 1, of[first]
        slack = items.lengths[of] // 2 + 2
        a, b = np.maximum(start[first] - slack, 0), np.minimum(start[last] + items.lengths[of] + slack, doc.n)
        fits = np.flatnonzero(doc.holds_within(of, a, b) >= min_score)
        yield from zip(of[fits].tolist(), a[fits].tolist(), b[fits].tolist(), strict=True)


def find_in_chunk(w: Words, items: Items, min_score: float) -> Iterator[tuple[int, int, float, int, int]]:
    """document, item, score, first and last (exclusive) word of each leak in a chunk."""
    at, seed = items.hits(w)
    todo: list[tuple[int, int, int, int]] = []
    for d in np.unique(np.searchsorted(w.bounds, at, side="right") - 1).tolist():
        low, high = int(w.bounds[d]), int(w.bounds[d + 1])
        own = slice(*np.searchsorted(at, [low, high]))
        todo += [(d, i, low + a, low + b) for i, a, b in _stretches(at[own] - low, seed[own], w.hashes[low:high], items, min_score)]
        if len(todo) >= STRETCHES:
            yield from _leaks_among(todo, w, items, min_score)
            todo = []
    yield from _leaks_among(todo, w, items, min_score)


def _leaks_among(todo: list[tuple[int, int, int, int]], w: Words, items: Items, min_score: float) -> Iterator[tuple[int, int, float, int, int]]:
    todo.sort(key=lambda t: (t[3] - t[2], items.lengths[t[1]]))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for part in _together(todo, [t[3] - t[2] for t in todo]):
        score, end = align([w.hashes[a:b] for _, _, a, b in part], [items.words[i] for _, i, _, _ in part])
        for (d, i, a, _), s, e in zip(part, score, end, strict=True):
            share = float(s) / (2 * int(items.lengths[i]))
            old = best.get((d, i))
            if share >= min_score and (old is None or (share, -a) > (old[0], -old[1])):
                best[d, i] = share, int(a), int(a + e)
    found = sorted(best.items(), key=lambda x: x[1][2] - x[1][1])
    out = []
    for part in _together(found, [e - a for _, (_, a, e) in found]):
        _, back = align([w.hashes[a:e][::-1] for _, (_, a, e) in part], [items.words[i][::-1] for (_, i), _ in part])
        for ((d, i), (share, _, e)), b in zip(part, back, strict=True):
            out.append((d, i, share, int(e - b - w.bounds[d]), int(e - w.bounds[d])))
    yield from sorted(out)


def _together(rows: list, rising: list[int]) -> Iterator[list]:
    """Runs of rows that are aligned at once: at most 256, and CELLS words with what fills them up to the longest."""
    lo = 0
    for hi in range(1, len(rows) + 1):
        if hi == len(rows) or hi - lo == 256 or (hi + 1 - lo) * rising[hi] > CELLS:
            yield rows[lo:hi]
            lo = hi


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """Items in blocks of a bounded number of bytes, one at a time on the driver. An item longer than a block is in one of its own size."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    n = int(-(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)) or 1
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in block], [r.text for r in block])


def find_leaks(docs: DataFrame, items: DataFrame, min_score: float = 0.4, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, first_word and last_word (exclusive) of every document that holds a copy of a test item."""
    return _leaks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("mark")), items, min_score, item_id, item_text).drop("mark")


def _leaks(docs: DataFrame, items: DataFrame, min_score: float, item_id: str, item_text: str) -> DataFrame:
    """The same for docs (doc_id, text, mark), with the mark of each document."""
    sc, out = docs.sparkSession.sparkContext, None
    for block in _blocks(items, item_id, item_text):
        shared = sc.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for b in batches:
                ids, marks = b.column(0).to_pylist(), b.column(2).to_pylist()
                for w in words(parted(b.column(1)), ALNUM):
                    rows = [(ids[w.first + d], block.ids[i], round(s, 6), a, e, marks[w.first + d]) for d, i, s, a, e in find_in_chunk(w, block, min_score)]
                    if rows:
                        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word", "mark"])

        part = map_batches(docs, find, "doc_id long, item_id long, score double, first_word long, last_word long, mark long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, min_score: float = 0.4) -> DataFrame:
    """docs without those that hold a copy of a test item. A row goes by its doc_id and a hash of its text, so that of rows with one
    doc_id, or none, only those with such a text go."""
    mark = F.xxhash64("text")
    found = _leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark.alias("mark")), items, min_score, "item_id", "text")
    leak, marked = free_name(docs, "leak"), free_name(docs, "marked")
    leaks = saved(found.select(F.col("doc_id").alias(leak), F.col("mark").alias(marked)).distinct(), "leaks")
    return docs.join(broadcast_if_small(leaks), F.col("doc_id").cast("long").eqNullSafe(F.col(leak)) & (mark == F.col(marked)), "left_anti")
