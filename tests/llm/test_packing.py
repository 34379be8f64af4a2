"""Best-two-fit packing: ids against the tokenizers library, the plan against packing bin by bin, whole results."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from routelens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "one", "one", "Don't  STOP'll 12345 *** é É é  x y", "<|endoftext|> a<|startoftext|>b", "中文 文字,没有空格 İstanbul ΣΑΣ ß", "a\x0bb\x0cc\x1cd\x85e", "́ ́a", "x" * 5000, "word " * 4000, "enenat$$$ A.B a,b= x≠ y≠z e,́ don'T,I'LL 1,2.3 <|EndOfText|> a<|startoftext|>,B |> é,è—,— ²½", "\x00 � 🙂🙂"]


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def bin_by_bin(counts, capacity):
    """Best two fit with one bin at a time."""
    left, bins = Counter(counts), 0
    while +left:
        took, gap = [], capacity
        while fits := [s for s in left if left[s] and s <= gap]:
            took.append(max(fits))
            left[took[-1]] -= 1
            gap -= took[-1]
        if gap and len(took) > 1:
            small = min(took)
            free = [s for s in left for _ in range(min(2, left[s]))]
            pairs = [a + b for i, a in enumerate(free) for b in free[:i] if small < a + b <= gap + small]
            if pairs:
                best = max(pairs)
                a, b = max((a, b) for i, a in enumerate(free) for b in free[:i] if a + b == best)
                left[small] += 1
                left[a] -= 1
                left[b] -= 1
        bins += 1
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_as_good_as_bin_by_bin(seed):
    rng = np.random.default_rng(seed)
    capacity = 60
    counts = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 61), 12, replace=False), rng.integers(1, 40, 12), strict=True)}
    plan = packing.best_two_fit(counts, capacity)
    ranks, filled = defaultdict(list), defaultdict(list)
    for size, low, high, first, each, offset in plan:
        ranks[size] += range(low, high)
        for k in range(high - low):
            filled[first + k // each].append((offset + k % each * size, size))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    total = sum(s * n for s, n in counts.items())
    assert -(-total // capacity) <= len(filled) <= bin_by_bin(counts, capacity) + 1


def test_a_pair_replaces_the_smallest():
    # greedily 6 + 3 leaves 1; 2 + 2 in place of 3 fills the bin
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert sorted((size, first, each) for size, _, _, first, each, _ in plan) == [(2, 0, 2), (3, 1, 1), (6, 0, 1)]


def test_plan_does_not_grow_with_the_counts():
    few = packing.best_two_fit({s: 3 + s % 5 for s in range(1, 200)}, 200)
    many = packing.best_two_fit({s: 3_000_000 + s % 5 for s in range(1, 200)}, 200)
    assert len(many) < 20 * len(few) and sum(h - low for _, low, h, *_ in many) == sum(3_000_000 + s % 5 for s in range(1, 200))


def test_pieces_and_sequences(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD * 3)] + [(None, "no id", "x"), (7, "again", "x"), (7, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    packed = packing.pack_documents(docs, PATH, 2048, 0, with_ids=True).cache()
    got = packed.collect()
    want = Counter()
    for i, t, _ in rows:
        ids = ids_of(t)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    seqs = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in seqs) == 4 * sum(r.length for r in got) and all(sum(r.lengths) * 4 == len(r.ids) for r in seqs)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, PATH).collect() == []


def test_memory_of_words_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    for text in ("a b c d", "e f g a b", "a b c d h", ""):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, bounds = encoder.encode(data, np.array([0, len(data)]), 0)
        assert ids.tolist() == ids_of(text) and bounds.tolist() == [0, len(ids)]
