"""Phrase collocations by best-first branch and bound.

A phrase of 2 to 4 words scores floor(2000000 a / (l + r)) at its lowest-scoring cut. Growing a phrase to the right can't raise its count,
and the counts of its beginnings stay, so the count of a prefix bounds the score of all that grows from it: with a prefix of
count f that begins with a part of count l, nothing scores over 2000000 f / (l + f). The search goes down from the best bounds. Each round
has a threshold for each language, expands all prefixes whose bound reaches it, and counts their continuations in one pass a word. Then
every phrase that scores so much is known. To settle which of them survive, phrases that hold them are counted too: those to the right come
with the expansion, those to the left from prefixes that end with the phrase's beginning and occur often enough to absorb it. A language is
settled when `best` phrases survive at its threshold, ties included, or when its threshold is 0; the others get a lower one.

Texts are split into words once and kept as blocks of word numbers with the block's own vocabulary. What a pass counts is told by
bitmaps of hashes, which have a fixed size whatever the number of prefixes: a false hit costs a few rows, which the join with the prefixes
takes out again. Counts of pairs go by hash first, which can only overstate them, and then by text for those that may be frequent. All
counts cover the whole table and are partly summed by task before they are shuffled.

Null and empty texts: no words. Null lang: `und`. Very long texts: read whole; pieces never span texts. Repeated rows count each. Ties: by
score, count, then bytes of the phrase. A language with fewer surviving phrases gets all; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh_path, map_batches, saved
from .words import LOWER, chunks, mix, prefix_hashes, text_buffer

#: Bytes of text in a block, pairs that a task sorts together, and rows that it sends at a time.
BLOCK, SORTED, SENT = 1 << 18, 1 << 20, 1 << 16
#: Bits of a bitmap of hashes, and of one row of it (as Spark's bitmap functions have it).
BITS, ROW = 25, 1 << 15
#: Bytes of a row group of blocks: what a task holds of them when it writes them, and when it reads them by the batch.
GROUP = 8 << 20
SCALE = 2_000_000
#: Scores are counted in steps of so many to choose thresholds; results don't depend on it.
STEP = 100
END, BLANK = np.zeros(256, bool), np.zeros(256, bool)
END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK[[0x20, 0x09]] = True
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def blocks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, vocabulary, ids (packed 32-bit numbers of words in the vocabulary, -1 between pieces) and the number of words, for a few MB of texts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, 1024) for x in batches for k in range(0, x.num_rows, 1024)):
            langs = b.column(0).dictionary_encode()
            of = langs.indices.to_numpy()
            for k, name in enumerate(langs.dictionary.to_pylist()):
                data, offsets = text_buffer(b.column(1).take(pa.array(np.flatnonzero(of == k))))
                for lo, hi in chunks(offsets, BLOCK):
                    vocabulary, ids = _block(LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo:hi] - offsets[lo])
                    if len(ids):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name]), pa.array([vocabulary], pa.list_(pa.string())), pa.array([ids.tobytes()], pa.binary()), pa.array([int((ids >= 0).sum())])], names=["lang", "vocabulary", "ids", "words"]
                        )

    columns = [F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    return map_batches(docs.select(*columns), run, "lang string, vocabulary array<string>, ids binary, words long")


def saved_blocks(texts: DataFrame) -> DataFrame:
    """texts saved in row groups of GROUP bytes: by default a task would hold up to 128 MB of them, whether it writes or reads them."""
    path = fresh_path(texts.sparkSession, "phrase-blocks")
    texts.write.option("parquet.block.size", GROUP).option("parquet.page.size.row.check.min", 8).parquet(path)  # rows are large, so their size is looked at early
    return texts.sparkSession.read.schema(texts.schema).parquet(path)


def _block(data: np.ndarray, firsts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct words of texts that begin at firsts, and the words by number with -1 between pieces."""
    if not len(data):
        return [], np.zeros(0, np.int32)
    end = END[data]
    inside = ~(end | BLANK[data])
    cut = end.astype(np.int32)  # what parts a byte's piece from that of the byte before
    begins = np.zeros(len(data), bool)
    begins[firsts[firsts < len(data)]] = True
    cut += begins
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | begins))
    if not len(starts):
        return [], np.zeros(0, np.int32)
    packed = np.cumsum(inside, dtype=np.int32)
    at = np.append(packed[starts] - 1, packed[-1])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data[inside].tobytes())]).dictionary_encode()
    piece = np.cumsum(cut, dtype=np.int32)[starts]
    return words.dictionary.to_pylist(), np.insert(words.indices.to_numpy(), np.flatnonzero(np.diff(piece)) + 1, -1).astype(np.int32)


def _word_hashes(words: pa.Array, lang: str | None = None) -> np.ndarray:
    data, offsets = text_buffer(words)
    own = prefix_hashes(data, offsets[:-1], offsets[1:])
    return own if lang is None else mix(own ^ _lang_hash(lang))


def _lang_hash(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return mix(prefix_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mix(left * _TIMES + right)


def phrase_hashes(phrases: DataFrame) -> DataFrame:
    """A column h: the hashes of (lang, phrase), as blocks get them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).dictionary_encode()
            of_lang = np.array([_lang_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)
            words = pc.split_pattern(b.column(1), " ")
            n = words.value_lengths().to_numpy().astype(np.int64)
            h = mix(_word_hashes(words.flatten()) ^ np.repeat(of_lang[langs.indices.to_numpy()], n)) if b.num_rows else np.zeros(0, np.uint64)
            first = np.cumsum(n) - n
            out = h[first] if b.num_rows else h
            for k in range(1, int(n.max(initial=0))):
                more = np.flatnonzero(n > k)
                out[more] = _joined(out[more], h[first[more] + k])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])

    return map_batches(phrases.select("lang", "phrase"), run, "h long")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """2^BITS bits, set at the hashes (column h). At most 2^BITS / ROW rows of ROW bits come to the driver."""
    at = F.col("h").bitwiseAND((1 << BITS) - 1) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows:
        out[(r["row"] - 1) * ROW // 8 : r["row"] * ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns keys (numbers below 2^31), and how often each occurs."""
    one = keys[0].astype(np.int64)
    for k in keys[1:]:
        distinct, code = np.unique(one, return_inverse=True)
        one = code.astype(np.int64) << 32 | k.astype(np.int64)
    _, at, times = np.unique(one, return_index=True, return_counts=True)
    return [k[at] for k in keys], times


def _phrases(lang: str, vocabulary: pa.Array, keys: list[np.ndarray], times: np.ndarray) -> pa.RecordBatch:
    words = [vocabulary.take(pa.array(k)) for k in keys]
    phrase = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, " ")
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(times), pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(times), len(keys), np.int32)), pa.array(times)], names=["lang", "phrase", "size", "f"])


def _opened(b: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for k in range(b.num_rows):
        yield b.column("lang")[k].as_py(), b.column("vocabulary")[k].values, np.frombuffer(b.column("ids")[k].as_py(), np.int32)


PHRASE = "lang string, phrase string, size int, f long"


def _summed(counted: DataFrame, least: int) -> DataFrame:
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, vocabulary, ids in _opened(b):
                times = np.bincount(ids[ids >= 0], minlength=len(vocabulary))
                yield _phrases(lang, vocabulary, [np.arange(len(vocabulary))], times)

    return _summed(map_batches(texts, run, PHRASE), least)


def pair_counts(texts: DataFrame, frequent: np.ndarray, least: int) -> DataFrame:
    """Pairs of words that occur at least `least` times. frequent: bitmap of words that do."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def pairs(lang: str, vocabulary: pa.Array, ids: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _word_hashes(vocabulary, lang)
        good = np.append(_in(words, h), False)[ids]  # -1 is the last one
        at = np.flatnonzero(good[:-1] & good[1:])
        return at, ids, _joined(h[ids[at]], h[ids[at + 1]])

    def by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in (x for b in batches for x in _opened(b)):
            held.append(pairs(*block, shared.value)[2])
            n += len(held[-1])
            if n >= SORTED:
                yield from summed(held)
                held, n = [], 0
        if held:
            yield from summed(held)

    def summed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        h.sort()
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        times = np.diff(first, append=len(h))
        for k in range(0, len(first), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(h[first[k : k + SENT]].view(np.int64)), pa.array(times[k : k + SENT])], names=["h", "f"])

    # tasks have summed what they could; repartition() keeps Spark from trying again before the shuffle, which would take a large table in each task
    maybe = bitmap(map_batches(texts, by_hash, "h long, f long").repartition("h").groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    often = texts.sparkSession.sparkContext.broadcast(maybe)

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in _opened(b):
                at, ids, h = pairs(*block, shared.value)
                at = at[_in(often.value, h)]
                yield _phrases(block[0], block[1], *_counted(ids[at], ids[at + 1]))

    return _summed(map_batches(texts, by_text, PHRASE), least)


def continuations(texts: DataFrame, prefixes: DataFrame, pairs: np.ndarray, least: int) -> DataFrame:
    """Phrases of one word more than a prefix (lang, phrase: 2 or 3 words), counted over all texts. pairs: bitmap of frequent pairs, of which a frequent phrase is made."""
    shared = texts.sparkSession.sparkContext.broadcast((bitmap(phrase_hashes(prefixes)), pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted, frequent = shared.value
            for lang, vocabulary, ids in _opened(b):
                h = np.append(_word_hashes(vocabulary, lang), np.uint64(0))[ids]
                at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
                pair = np.zeros(len(ids), np.uint64)
                pair[at] = _joined(h[at], h[at + 1])
                good = np.zeros(len(ids) + 2, bool)  # a frequent pair begins here
                good[at] = _in(frequent, pair[at])
                at = np.flatnonzero(good[:-3] & good[1:-2])
                hit = at[_in(wanted, pair[at])]
                yield _phrases(lang, vocabulary, *_counted(ids[hit], ids[hit + 1], ids[hit + 2]))
                at = at[good[at + 2]]
                hit = at[_in(wanted, _joined(pair[at], h[at + 2]))]
                yield _phrases(lang, vocabulary, *_counted(ids[hit], ids[hit + 1], ids[hit + 2], ids[hit + 3]))

    got = _summed(map_batches(texts, run, PHRASE), least)
    wanted = prefixes.select("lang", F.col("phrase").alias("prefix"))
    return got.withColumn("prefix", _but_last(F.col("phrase"))).join(wanted, ["lang", "prefix"], "left_semi").drop("prefix")


def _but_last(phrase: Column) -> Column:
    return F.regexp_replace(phrase, " [^ ]+$", "")


def _but_first(phrase: Column) -> Column:
    return F.regexp_replace(phrase, "^[^ ]+ ", "")


def _wide(c: Column) -> Column:
    return c.cast("decimal(25,0)")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(SCALE a / (l + r)), with products beyond 64 bits."""
    return F.call_function("div", _wide(a) * SCALE, _wide(l) + _wide(r))


def _lowest_cut(a: Column, parts: list[tuple[Column, Column]]) -> Column:
    """score, k, l and r of the cut with the lowest score, of equal ones the first."""
    cuts = [F.struct(_score(a, l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")) for k, (l, r) in enumerate(parts, 1)]
    return F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    first = words.select("lang", F.col("phrase").alias("first"), F.col("f").alias("f1"))
    last = words.select("lang", F.col("phrase").alias("last"), F.col("f").alias("f2"))
    out = pairs.select("lang", "phrase", "f", F.substring_index("phrase", " ", 1).alias("first"), F.substring_index("phrase", " ", -1).alias("last")).join(first, ["lang", "first"]).join(last, ["lang", "last"])
    return out.withColumns({"bound": _score(F.col("f"), F.col("f1"), F.col("f")), "cut": _lowest_cut(F.col("f"), [(F.col("f1"), F.col("f2"))])})


def _scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    head = pairs.select("lang", F.col("phrase").alias("head"), F.col("f").alias("f12"), "f1")
    tail = pairs.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("f23"), F.col("f2").alias("f3"))
    out = triples.select("lang", "phrase", "f", _but_last(F.col("phrase")).alias("head"), _but_first(F.col("phrase")).alias("tail")).join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    f = F.col("f")
    return out.withColumns({"bound": F.least(_score(f, F.col("f1"), f), _score(f, F.col("f12"), f)), "cut": _lowest_cut(f, [(F.col("f1"), F.col("f23")), (F.col("f12"), F.col("f3"))])})


def _scored_quads(quads: DataFrame, triples: DataFrame) -> DataFrame:
    """Quads whose last three words were counted; the others are below the threshold and only absorb."""
    head = triples.select("lang", F.col("phrase").alias("head"), F.col("f").alias("f123"), "f1", "f12")
    tail = triples.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("f234"), F.col("f23").alias("f34"), F.col("f3").alias("f4"))
    out = quads.select("lang", "phrase", "f", _but_last(F.col("phrase")).alias("head"), _but_first(F.col("phrase")).alias("tail")).join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    return out.withColumn("cut", _lowest_cut(F.col("f"), [(F.col("f1"), F.col("f234")), (F.col("f12"), F.col("f34")), (F.col("f123"), F.col("f4"))]))


def _thresholds(scored: DataFrame, want: int) -> DataFrame:
    """lang and t: a score that `want` of its phrases reach, 0 if it has fewer. A window over at most SCALE / STEP rows for each language."""
    bins = scored.groupBy("lang", F.floor(F.col("cut.score") / STEP).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("bin")))
    reached = bins.withColumn("total", total).groupBy("lang").agg(F.max(F.when(F.col("total") >= want, F.col("bin") * STEP)).alias("t"))
    return reached.select("lang", F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def _survivors(scored: DataFrame, longer: DataFrame | None, limits: DataFrame, absorb: int) -> DataFrame:
    """Phrases whose score reaches the threshold and that no longer phrase absorbs."""
    top = scored.join(limits, "lang").where(F.col("cut.score") >= F.col("t"))
    if longer is not None:
        held = longer.select("lang", "f", F.explode(F.array(_but_last(F.col("phrase")), _but_first(F.col("phrase")))).alias("phrase"))
        held = held.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        top = top.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * absorb))
    return top.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def _unexpanded(wanted: DataFrame, done: DataFrame | None) -> DataFrame:
    wanted = wanted.select("lang", "phrase").distinct()
    return wanted if done is None else wanted.join(done, ["lang", "phrase"], "left_anti")


def _pair_prefixes(pairs: DataFrame, limits: DataFrame, least: int, absorb: int) -> DataFrame:
    """Pairs whose bound reaches the threshold, and those that end where one of them begins, often enough to absorb what grows from it."""
    open_ = pairs.join(limits, "lang").where(F.col("bound") >= F.col("t"))
    heads = open_.select("lang", F.col("first").alias("last"), F.col("f1").alias("head_f"), "t").distinct()
    # what grows from a head with count h scores t only with a count of at least t h / (SCALE - t)
    enough = (_wide(F.col("f")) * 100 * (SCALE - F.col("t")) >= _wide(F.col("t")) * absorb * F.col("head_f")) & (F.col("f") * 100 >= absorb * least)
    return open_.select("lang", "phrase").unionByName(pairs.join(heads, ["lang", "last"]).where(enough).select("lang", "phrase"))


def _triple_prefixes(triples: DataFrame, limits: DataFrame, absorb: int) -> tuple[DataFrame, DataFrame]:
    """Triples to expand, by bound or as they may absorb one that reaches the threshold; and the ends of the former, which scores of quads need."""
    known = triples.join(limits, "lang")
    open_ = known.where(F.col("bound") >= F.col("t"))
    top = known.where(F.col("cut.score") >= F.col("t")).groupBy("lang", F.col("head").alias("tail")).agg(F.min("f").alias("least_f"))
    left = triples.join(top, ["lang", "tail"]).where(F.col("f") * 100 >= F.col("least_f") * absorb)
    return open_.select("lang", "phrase").unionByName(left.select("lang", "phrase")), open_.select("lang", F.col("tail").alias("phrase"))


def mine(docs: DataFrame, least: int = 30, best: int = 2000, absorb: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `best` phrases of 2 to 4 words.

    least: smallest count of a phrase. absorb: a phrase is dropped if a longer one holds it and has at least so many hundredths of its count.
    """
    texts = saved_blocks(blocks(docs, text, lang))
    words = saved(word_counts(texts, least), "phrase-words")
    pairs = saved(_scored_pairs(pair_counts(texts, bitmap(phrase_hashes(words)), least), words), "phrase-pairs")
    often = bitmap(phrase_hashes(pairs))
    want, limits, triples, quads, done2, done3 = best, None, None, None, None, None
    while True:
        scored = [pairs] if triples is None else [pairs, triples, _scored_quads(quads, triples)]
        known = scored[0].select("lang", "cut")
        for x in scored[1:]:
            known = known.unionByName(x.select("lang", "cut"))
        lower = _thresholds(known, want)
        if limits is not None:  # settled languages keep theirs
            lower = limits.select("lang", F.col("t").alias("old"), "settled").join(lower, "lang").select("lang", F.when(F.col("settled"), F.col("old")).otherwise(F.least("t", "old")).alias("t"))
        lower = saved(lower, "phrase-thresholds")
        limits = broadcast_if_small(lower)

        more2 = saved(_unexpanded(_pair_prefixes(pairs, limits, least, absorb), done2), "phrase-prefixes")
        counted = saved(continuations(texts, more2, often, least), "phrase-triples").select("lang", "phrase", "f")
        fresh = _scored_triples(counted, pairs)
        triples = saved(fresh if triples is None else triples.unionByName(fresh), "phrase-triples")
        done2 = more2 if done2 is None else done2.unionByName(more2)

        wanted3, tails = _triple_prefixes(triples, limits, absorb)
        more3 = saved(_unexpanded(wanted3, done3), "phrase-prefixes")
        more2 = saved(_unexpanded(tails, done2), "phrase-prefixes")
        counted = saved(continuations(texts, more2.unionByName(more3), often, least), "phrase-quads")
        triples = saved(triples.unionByName(_scored_triples(counted.where("size = 3").select("lang", "phrase", "f"), pairs)), "phrase-triples")
        fresh = counted.where("size = 4").select("lang", "phrase", "f")
        quads = fresh if quads is None else quads.unionByName(fresh)
        done2, done3 = done2.unionByName(more2), more3 if done3 is None else done3.unionByName(more3)

        found = _survivors(pairs, triples, limits, absorb).unionByName(_survivors(triples, quads, limits, absorb)).unionByName(_survivors(_scored_quads(quads, triples), None, limits, absorb))
        found = saved(found, "phrase-survivors")
        limits = lower.join(found.groupBy("lang").agg(F.count("*").alias("found")), "lang", "left").withColumn("settled", (F.col("t") == 0) | (F.coalesce("found", F.lit(0)) >= best))
        limits = saved(limits, "phrase-thresholds")
        if limits.where(~F.col("settled")).isEmpty():
            break
        want *= 2
    totals = broadcast_if_small(saved(texts.groupBy("lang").agg(F.sum("words").alias("n")), "phrase-totals"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", rank).where(F.col("rank") <= best).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
