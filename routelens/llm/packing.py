"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

Documents become ids, then an end id; those longer than a sequence are cut into full pieces and a rest. Pieces of one length can
take each other's place, so how many there are of each length (at most `capacity` numbers) decides the packing. Bins are filled
greedily with the largest piece that fits. When nothing more fits, the bin's smallest piece makes way for two unpacked pieces that fill
the gap it leaves more tightly, if there are any. A bin's composition is repeated as often as the counts allow, which yields what bin by
bin packing would: counts only fall, so each choice stays the best one until one of its lengths runs short. The plan has a row
for each composition and length, a number that depends on `capacity` and not on the input. Pieces then look up their place by their length and
their rank among those of that length, which comes from counts for each part of the table. No piece passes through the driver.

Null and empty texts: the end id alone. Very long texts: encoded whole. Repeated rows are packed each for itself. Null doc_id: kept. Ties
among pieces of one length go to the earlier part of the table and the earlier row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved
from .words import LOWER, NON_SPACE, chunks, text_buffer

#: Distinct words, and bytes of them, that a worker remembers the ids of; beyond that it starts anew.
REMEMBERED, REMEMBERED_BYTES = 1 << 19, 1 << 24
CHUNK = 1 << 22
SIGN, PLAIN = np.zeros(256, bool), np.zeros(256, bool)
SIGN[33:48] = SIGN[58:65] = SIGN[91:97] = SIGN[123:127] = True
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = True


class WordEncoder:
    """The tokenizers library on distinct words.

    Exact for tokenizers that drop white space, compare in lower case, and part a word before a sign that follows an ASCII letter or digit. Signs that stand
    within special tokens don't part words, and letters keep their case where one of those may stand.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.signs = SIGN.copy()
        self.signs[list(b"".join(t[1:] for t in special))] = False
        self.openings = {t[:2].lower() for t in special}
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes, self.used = 0, 0
        self.ids, self.start, self.size = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Where each word's ids are; unknown words are encoded first."""
        if len(self.number) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.forget()
        known = self.number
        if new := [w for w in words if w not in known]:
            # words of ASCII letters are one pre-token as they are, so the model takes them without normalising
            tokenize = self.tokenizer.model.tokenize
            plain = [w for w in new if w.isalpha()]
            ids = [[t.id for t in tokenize(w.lower().decode())] for w in plain]
            other = [w for w in new if not w.isalpha()]
            ids += [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)]
            first = len(known)
            known.update(zip(plain + other, range(first, first + len(new)), strict=True))
            self.bytes += sum(map(len, new))
            size = np.fromiter(map(len, ids), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
            self.start = self._put(self.start, first, self.used + np.cumsum(size) - size)
            self.size = self._put(self.size, first, size)
            self.ids = self._put(self.ids, self.used, flat)
            self.used += len(flat)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    @staticmethod
    def _put(into: np.ndarray, at: int, what: np.ndarray) -> np.ndarray:
        if at + len(what) > len(into):
            into = np.concatenate([into, np.zeros(max(len(into), len(what)), into.dtype)])
        into[at : at + len(what)] = what
        return into

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in data, each with end_id behind, and where each text's begin (one more entry)."""
        low = LOWER[data]
        raw = low.tobytes()
        if not any(o in raw for o in self.openings):
            data = low
        inside = NON_SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1] & ~(self.signs[data[1:]] & PLAIN[data[:-1]])
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        starts = np.flatnonzero(inside & ~before)
        words_before = np.searchsorted(starts, offsets)
        # bytes of words end to end: a word runs to the start of the next one
        packed = np.cumsum(inside, dtype=np.int32)
        at = np.append(packed[starts] - 1, packed[-1:]) if len(starts) else np.zeros(1, np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data[inside].tobytes())])
        distinct = column.dictionary_encode()
        word = self.numbers(distinct.dictionary.to_pylist())[distinct.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        size = self.size[word]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(self.start[word] - total[:-1], size) + np.arange(total[-1])]
        bounds = total[words_before]
        return np.insert(flat, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(tokenizer_json: str) -> WordEncoder:
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, with_ids also the ids (packed), and where the piece stands among
    those of its length: part and rank, good only if the result is written before it is used twice."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(spec.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            for lo, hi in chunks(offsets, CHUNK):
                ids, bounds = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end_id)
                n = -(-np.diff(bounds) // capacity)
                doc = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                first = bounds[doc] + start
                length = np.minimum(bounds[doc + 1] - first, capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(first.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
                order = np.argsort(length, kind="stable")
                of = length[order]
                _, own, times = np.unique(of, return_index=True, return_counts=True)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(own, times) + seen[of]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    columns.append(pa.array([bytes(raw[4 * i : 4 * (i + k)]) for i, k in zip(first.tolist(), length.tolist(), strict=True)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """How counts[length] pieces of each length are packed: rows (length, first rank, rank behind the last, first sequence, pieces of this length
    in each sequence, offset of the first of them)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, bins, plan = np.zeros(capacity + 1, np.int64), 0, []
    sizes = np.flatnonzero(left).tolist()
    while sizes:
        greedy, gap = {}, capacity
        while gap and (k := bisect_right(sizes, gap)):
            while k and left[sizes[k - 1]] == greedy.get(sizes[k - 1], 0):
                k -= 1
            if not k:
                break
            size = sizes[k - 1]
            take = min(gap // size, int(left[size]) - greedy.get(size, 0))
            greedy[size] = greedy.get(size, 0) + take
            gap -= size * take
        need, final = dict(greedy), dict(greedy)
        smallest = min(greedy)
        pair = _closest_pair(left, greedy, smallest, gap + smallest) if gap and sum(greedy.values()) > 1 else None
        if pair:
            for size in pair:
                need[size] = need.get(size, 0) + 1
                final[size] = final.get(size, 0) + 1
            final[smallest] -= 1
        final = {size: n for size, n in final.items() if n}
        # as long as what the choice looked at is still there, the same choice is made again
        times = min((int(left[size]) - need[size]) // n for size, n in final.items()) + 1
        offset = 0
        for size, n in sorted(final.items(), reverse=True):
            plan.append((size, int(used[size]), int(used[size]) + n * times, bins, n, offset))
            used[size] += n * times
            left[size] -= n * times
            offset += n * size
        bins += times
        sizes = [s for s in sizes if left[s]]
    return plan


def _closest_pair(left: np.ndarray, taken: dict[int, int], smallest: int, gap: int) -> tuple[int, int] | None:
    """Lengths of two unpacked pieces that together come closest to gap from below, and are more than the smallest piece."""
    free = left[: gap + 1].copy()
    for size, n in taken.items():
        if size <= gap:
            free[size] -= n
    have = np.where(free > 0, np.arange(gap + 1), 0)
    below = np.maximum.accumulate(have)  # the largest free length up to each number
    a = np.flatnonzero(have)
    if not len(a):
        return None
    b = below[gap - a]
    alone = (b == a) & (free[a] < 2)
    b = np.where(alone, below[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    best = int(total.argmax())
    return (int(a[best]), int(b[best])) if total[best] > smallest else None


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """cut: pieces(), written. Adds sequence_id and offset."""
    spark = cut.sparkSession
    counts = saved(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")  # parts x lengths
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = np.array(sorted(best_two_fit(histogram, capacity)), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(plan)
    before = counts.select(F.col("length").alias("__length"), F.col("part").alias("__part"), (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("__before"))
    ranked = cut.join(before, (F.col("length") == F.col("__length")) & (F.col("part") == F.col("__part"))).withColumn("rank", F.col("rank") + F.col("__before"))
    kept = [c for c in cut.columns if c not in ("part", "rank")]
    ranked = ranked.select(*kept, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, _, base, each, offset = shared.value.T
        first = np.searchsorted(size, np.arange(capacity + 2))
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.empty(len(rank), np.int64)
            for k in np.unique(length):
                own = length == k
                at[own] = first[k] + np.searchsorted(low[first[k] : first[k + 1]], rank[own], "right") - 1
            inner = rank - low[at]
            place = [pa.array(base[at] + inner // each[at]), pa.array(offset[at] + inner % each[at] * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *place], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece, with_ids also its ids (packed little-endian unsigned 32-bit)."""
    return pack(saved(pieces(docs, tokenizer_path, capacity, end_id, text, doc_id, with_ids), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (packed), doc_ids and lengths of each sequence, from pack_documents(with_ids=True). A group is one sequence, so it is bounded."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("p"))
    return parts.select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda got, p: F.concat(got, p["ids"])).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths")
    )
