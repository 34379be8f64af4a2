"""N-gram Jaccard join with size-banded tiles and bitmap signatures.

A document's set holds its distinct word shingles, as 64-bit hashes. Documents with equal sets form a class (a 64-bit hash of
the set), and classes are compared.

Tiles. Two sets with similarity p % or more differ in at most (100 - p) / (100 + p) of their sizes' sum. Sizes are cut into
bands; for a band the hash space is cut into one range more than the largest difference of a pair whose smaller set lies in it.
Then some range holds the same shingles of both. The hash of each range's shingles, with band and range, is a key, and the
classes with a key are a tile. A class has keys for its own band and for a smaller one that it can still match. Keys of ranges
with few shingles say little: in a tile with such a key, bit counts of bitmap signatures decide which classes can be similar at
all, and only those hang together. So no pair is lost and no tile or candidate is capped; a tile of more
than UNIT_CLASSES classes is compared in pairs of blocks.

Comparison. Tiles that share classes are compared together, each class shipped once: within such a unit rows are ordered by
size, bit counts of 1024-bit signatures bound the overlap from above, and sorted arrays of what is left are intersected
exactly. Pairs that are already connected are skipped. A unit with more than UNIT_CLASSES classes or UNIT_SHINGLES shingles is
cut into blocks: each is first compared with itself and with one hub of the unit; then only those that are not connected
with the hub are compared with the other blocks, in pairs of blocks of bounded size.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Fewer words than a shingle: the
whole sequence is the one shingle. Repeated rows are equal sets. Null doc_id: a row of its own, which joins its component and is
never its smallest id unless all are null. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, map_batches, saved
from .graph import components, thinned
from .words import mix, shingles, words

BAND_RATIO, WEAK, LEAST_BITS, UNIT_BITS = 1.3, 2, 512, 1024
UNIT_CLASSES, UNIT_SHINGLES = 4096, 4_000_000
_SET, _PART = np.uint64(0xA24BAED4963EE407), np.uint64(0x8EBC6AF09C88C6E3)


class Bands:
    """Bands of set sizes and, for each, the number of ranges of the hash space."""

    def __init__(self, percent: int):
        self.percent, self.starts, self.edges = percent, [1], {}

    def _start(self, k: int) -> int:
        while len(self.starts) <= k:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND_RATIO)))
        return self.starts[k]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self._start(len(self.starts))
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def emitted(self, n: int) -> range:
        """The bands for which a set of n shingles has keys: its own, and those of smaller sets that it may match."""
        return range(self.of(-(-n * self.percent // 100)), self.of(n) + 1)

    def ranges(self, band: int) -> np.ndarray:
        """Inner borders of the band's ranges; none if only equal sets match."""
        if band not in self.edges:
            largest, p = self._start(band + 1) - 1, self.percent
            k = (100 - p) * (largest + largest * 100 // p) // (100 + p) + 1
            self.edges[band] = np.array([(i << 64) // k for i in range(1, k)], dtype=np.uint64)
        return self.edges[band]


def _range_keys(s: np.ndarray, edges: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Key and count of the shingles in each range of the sorted set s."""
    at = np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s + salt), dtype=np.uint64)))
    number = np.arange(len(at) - 1, dtype=np.uint64)
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix(number + salt)), np.diff(at)


def class_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the set's tiles, the lowest bit telling a weak key."""
    out = [np.zeros(0, np.uint64)]
    for band in bands.emitted(len(s)):
        edges = bands.ranges(band)
        if len(edges):
            keys, count = _range_keys(s, edges, mix(np.uint64(band) ^ _PART))
            out.append(((keys >> np.uint64(1)) << np.uint64(1)) | (count <= WEAK).astype(np.uint64))
    return np.concatenate(out)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Signature of a set: the bit of each shingle's leading bits. bits: a power of two."""
    on = np.zeros(bits, np.uint8)
    on[(s >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = 1
    return np.packbits(on).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The same signature with fewer bits: neighbours fall together."""
    on = np.unpackbits(bits.view(np.uint8)).reshape(words * 64, -1)
    return np.packbits(on.any(axis=1)).view(np.uint64)


def most_common(bits: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of a set of n with others: a bit that one lacks stands for a shingle at least."""
    mine = n - np.bitwise_count(bits & ~others).sum(axis=1, dtype=np.int64)
    return np.minimum(mine, sizes - np.bitwise_count(others & ~bits).sum(axis=1, dtype=np.int64))


def document_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text, in order."""
    for w in words(texts):
        h, inside = shingles(w, size)
        n_words = np.diff(w.bounds)
        for i in range(w.n):
            lo, hi = w.bounds[i], w.bounds[i + 1]
            if n_words[i] >= size:
                yield np.unique(h[lo : hi - size + 1])
            elif n_words[i]:
                x = w.hashes[lo : lo + 1]
                for k in range(lo + 1, hi):
                    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w.hashes[k : k + 1])
                yield mix(x ^ np.uint64(int(n_words[i])))
            else:
                yield np.zeros(0, np.uint64)


def _set_hash(s: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(s ^ _SET), dtype=np.uint64) ^ np.uint64(len(s))).astype(np.int64))


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 32 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def classes_of(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, cls, keys and bits of every document, and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, h, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), document_sets(b.column(1), size), strict=True):
                    keys = class_keys(s, bands) if len(s) else s
                    bits = bitmap(s, max(LEAST_BITS, 1 << (2 * len(s)).bit_length())).tobytes() if (keys & np.uint64(1)).any() else b""
                    yield doc_id, len(s), _set_hash(s), keys.tobytes(), bits, h

        yield from _batches(rows(), ["doc_id", "n", "cls", "keys", "bits", "hash"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()])

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text")), run, "doc_id long, n long, cls long, keys binary, bits binary, hash long")


def _tile_rows(classes: DataFrame) -> DataFrame:
    """A row (key, cls) for each key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                keys = [np.unique(np.frombuffer(x, np.int64)) for x in part.column(1).to_pylist()]
                cls = np.repeat(part.column(0).to_numpy(), [len(x) for x in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(cls)], names=["key", "cls"])

    return map_batches(classes.select("cls", "keys"), run, "key long, cls long")


def _possible(weak_rows: DataFrame, with_keys: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that hang together what the signatures leave possible in each tile. weak_rows: key, cls, m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile, out = {}, None, []

        def compare() -> None:
            cls = sorted(held, key=lambda c: held[c][0])
            n = np.array([held[c][0] for c in cls], np.int64)
            raw = [np.frombuffer(held[c][1], np.uint64) for c in cls]
            least = min(map(len, raw))
            bits = np.stack([x if len(x) == least else folded(x, least) for x in raw])
            label = np.arange(len(cls))
            for i in range(len(cls) - 1):
                end = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
                others = np.arange(i + 1, end)[label[i + 1 : end] != label[i]]
                if len(others):
                    near = others[(100 + percent) * most_common(bits[i], n[i], bits[others], n[others]) >= percent * (n[i] + n[others])]
                    for j in near[np.unique(label[near], return_index=True)[1]]:
                        out.append((cls[i], cls[j]))
                        label[label == label[j]] = label[i]

        for b in batches:
            for t, c, n, bits in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if t != tile:
                    if len(held) > 1:
                        compare()
                    held, tile = {}, t
                held[c] = n, bits
                if len(out) > 100_000:
                    yield _link_rows(out)
                    out = []
        if len(held) > 1:
            compare()
        if out:
            yield _link_rows(out)

    blocks = F.ceil(F.col("m") / UNIT_CLASSES).cast("int")
    cut = weak_rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64(F.lit(6), "cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("cls", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"))
    rows = with_keys.select("cls", "n", "bits").join(cut, "cls").select("tile", "cls", "n", "bits")
    return map_batches(rows.repartition("tile").sortWithinPartitions("tile", "cls"), run, "a long, b long")


def _stars(rows: DataFrame) -> DataFrame:
    """rows with the least class (hub) and the number of classes (m) of the key, where there are several."""
    w = W.partitionBy("key")
    return rows.select("key", "cls", F.min("cls").over(w).alias("hub"), F.count("*").over(w).alias("m")).where("m > 1")


def _units_of(stars: DataFrame, with_keys: DataFrame, percent: int) -> DataFrame:
    """cls and unit of the classes that share a tile, tiles with weak keys counting only where signatures leave it possible.

    Such a tile is looked at only if it spans several units of the other tiles: within a unit all is compared anyway.
    """
    weak = F.expr("key % 2 <> 0")
    first = components(thinned(stars.where(~weak).where("cls <> hub"))).select(F.col("node").alias("cls"), F.col("label").alias("unit"))
    weak_rows = saved(stars.where(weak).select("key", "cls", "m").join(first, "cls", "left").select("key", "cls", "m", F.coalesce("unit", "cls").alias("unit")), "jaccard-weak")
    spans = saved(weak_rows.groupBy("key").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi")).where("lo <> hi").select("key"), "jaccard-spans")
    if spans.isEmpty():
        return first
    more = saved(_possible(weak_rows.join(broadcast_if_small(spans), "key").select("key", "cls", "m"), with_keys, percent).distinct(), "jaccard-possible")
    unit = saved(first.unionByName(weak_rows.select("cls", "unit")).distinct(), "jaccard-first-units")
    of = lambda c, n: unit.select(F.col("cls").alias(c), F.col("unit").alias(n))
    joined = components(more.join(of("a", "ua"), "a").join(of("b", "ub"), "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")).where("a <> b").distinct())
    return unit.join(joined, F.col("unit") == F.col("node"), "left").select("cls", F.coalesce("label", "unit").alias("unit"))


class Unit:
    """The sets that are compared together, ordered by size."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], percent: int):
        rows.sort(key=lambda r: len(r[1]))
        self.cls, self.sets, self.percent = [r[0] for r in rows], [r[1] for r in rows], percent
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.label = np.arange(len(rows))
        self.bits = np.stack([bitmap(s, UNIT_BITS) for s in self.sets])
        self.links: list[tuple[int, int]] = []

    def compare(self, i: int, others: np.ndarray) -> None:
        """Links i with those of the others that are similar and not yet connected with it."""
        p = self.percent
        others = others[(self.label[others] != self.label[i]) & (p * np.maximum(self.n[others], self.n[i]) <= 100 * np.minimum(self.n[others], self.n[i]))]
        if not len(others):
            return
        most = most_common(self.bits[i], self.n[i], self.bits[others], self.n[others])
        for j in others[(100 + p) * most >= p * (self.n[i] + self.n[others])]:
            if self.label[j] == self.label[i]:
                continue
            a, b = self.sets[i], self.sets[j]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            if (100 + p) * int((b[at] == a).sum()) >= p * (len(a) + len(b)):
                self.links.append((i, int(j)))
                old, new = max(self.label[i], self.label[j]), min(self.label[i], self.label[j])
                self.label[self.label == old] = new

    def all_pairs(self) -> None:
        for i in range(len(self.cls) - 1):
            end = int(np.searchsorted(self.n, self.n[i] * 100 // self.percent, side="right"))
            self.compare(i, np.arange(i + 1, end))


def _units(batches: Iterator[pa.RecordBatch], size: int, check: bool = True) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with one unit id; a row becomes (cls, set, role). A row whose text has another set than its class is dropped."""
    unit, held = None, []
    for b in batches:
        for u, cls, role, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), document_sets(b.column(3), size), strict=True):
            if u != unit:
                if held:
                    yield unit, held
                unit, held = u, []
            if _set_hash(s) == cls and not any(h[0] == cls and h[2] == role for h in held[-1:]):
                held.append((cls, s, role))
    if held:
        yield unit, held


def _link_rows(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _compare_units(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what is similar within each unit. Role 0: compared with all; role 1 (known to hang together): with role 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, held in _units(batches, size):
            role = {cls: r for cls, _, r in sorted(held, key=lambda h: -h[2])}
            unit = Unit(list({cls: (cls, s) for cls, s, _ in held}.values()), percent)
            settled = np.array([role[c] == 1 for c in unit.cls])
            if settled.any():
                unit.label[settled] = np.flatnonzero(settled)[0]
            unit.all_pairs()
            out += [(unit.cls[i], unit.cls[j]) for i, j in unit.links]
            if len(out) > 100_000:
                yield _link_rows(out)
                out = []
        if out:
            yield _link_rows(out)

    return map_batches(rows.repartition("unit").sortWithinPartitions("unit", "cls", "role").select("unit", "cls", "role", "text"), run, "a long, b long")


def _links(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between classes: a spanning forest of each component at least. members: cls, n and unit of each candidate class, and
    doc_id and hash of the text that stands for it, and how many rows have both."""
    w = W.partitionBy("unit")
    sized = members.groupBy("unit").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("cls").alias("hub"))
    sized = saved(sized.withColumn("blocks", F.greatest(F.ceil(F.col("m") / UNIT_CLASSES), F.ceil(F.col("total") / UNIT_SHINGLES)).cast("int")), "jaccard-units")
    members = saved(members.join(sized.select("unit", "blocks", "hub"), "unit"), "jaccard-members")
    texts = docs.select(F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__h"), "text")
    met = texts.join(broadcast_if_small(members), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("hash") == F.col("__h")))
    rows = met.select("cls", "unit", "blocks", "hub", "text")
    if not members.where("copies > 1").isEmpty():  # one text stands for a class
        rows = met.where("copies = 1").select(*rows.columns).unionByName(met.where("copies > 1").select(*rows.columns).dropDuplicates(["unit", "cls"]))
    zero = F.lit(0)
    found = _compare_units(rows.where("blocks = 1").select("unit", "cls", zero.alias("role"), "text"), size, percent)
    if sized.where("blocks > 1").isEmpty():
        return found

    big = saved(rows.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "cls"), F.col("blocks")).cast("int")), "jaccard-blocks")
    hubs = big.where("cls = hub").withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    own = big.where("cls <> hub").unionByName(hubs).select(F.xxhash64("unit", "block").alias("unit"), "cls", zero.alias("role"), "text")
    within = saved(_compare_units(own, size, percent), "jaccard-links")
    # those that hang together with their unit's hub need no comparison among themselves
    state = components(within)
    hub_label = state.join(sized.where("blocks > 1").select("hub"), state["node"] == F.col("hub")).select(F.col("label").alias("hub_label"))
    settled = state.join(hub_label, state["label"] == F.col("hub_label"), "left_semi").select(F.col("node").alias("s"))
    big = saved(big.join(settled, F.col("cls") == F.col("s"), "left").withColumn("role", F.col("s").isNotNull().cast("int")).drop("s"), "jaccard-roles")
    loose = big.where("role = 0")
    counts = loose.groupBy("unit").agg(F.ceil(F.count("*") / UNIT_CLASSES).cast("int").alias("parts"))
    if counts.isEmpty():
        return found.unionByName(within)
    part = F.pmod(F.xxhash64(F.lit(4), "cls"), F.col("parts")).cast("int")
    others = big.join(counts, "unit").withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))
    mine = loose.join(counts, "unit").withColumn("part", part).withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    cross = others.unionByName(mine).select(F.xxhash64("unit", "block", "part").alias("unit"), "cls", "role", "text")
    return found.unionByName(within).unionByName(_compare_units(cross, size, percent))


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of docs.

    Rows that share a doc_id, or have none, are told apart by their texts; a component without any doc_id has a null component_id.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = saved(classes_of(docs, shingle, percent), "jaccard-sets")
    # rows may share an id or have none: a class is stood for by its least id and, among that id's rows, its least hash of a text
    texts = every.where("n > 0").groupBy("cls", "doc_id", "hash").agg(F.count("*").alias("copies"), F.any_value("n").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "copies", "n")).alias("least")
    classes = saved(texts.groupBy("cls").agg(least).select("cls", *(f"least.{c}" for c in ("doc_id", "hash", "copies", "n"))), "jaccard-classes")
    first = classes.select(F.col("cls").alias("c"), F.col("doc_id").alias("d"), F.col("hash").alias("h"))
    with_keys = every.join(broadcast_if_small(first), (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left_semi")
    if not classes.where("copies > 1").isEmpty():
        with_keys = with_keys.dropDuplicates(["cls"])
    stars = saved(_stars(_tile_rows(with_keys)).where(F.expr("cls <> hub OR key % 2 <> 0")), "jaccard-tiles")
    units = _units_of(stars, with_keys, percent)
    members = classes.join(units, "cls")
    linked = components(_links(docs, members, shingle, percent))
    ids = saved(classes.select("cls", "doc_id").join(linked, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label")), "jaccard-labels")
    least = saved(ids.groupBy("label").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    named = saved(ids.select("cls", "label").join(least, "label").select("cls", "component_id"), "jaccard-components")
    return every.select("doc_id", "n", "cls").join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: of those with the smallest doc_id (a null one comes last) the first by a hash of the text.

    Rows are numbered, so repeated rows and those with a null doc_id are told apart. A row without words is a component of its own.
    """
    row, kept_row = free_name(docs, "row_number"), free_name(docs, "kept_row")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")
    found = jaccard_components(numbered, shingle, percent, doc_id=row).select(F.col("doc_id").alias("found"), "component_id")
    ids = numbered.select(F.col(row).alias("n"), "doc_id", F.xxhash64("text").alias("hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "n")).alias("first")
    kept = saved(ids.join(found, F.col("n") == F.col("found")).groupBy("component_id").agg(first).select(F.col("first.n").alias(kept_row)), "jaccard-kept")
    return numbered.join(broadcast_if_small(kept), F.col(row) == F.col(kept_row), "left_semi").drop(row)
