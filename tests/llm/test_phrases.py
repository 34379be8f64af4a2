"""Phrase mining against counting all phrases."""

import re
from collections import Counter

import numpy as np
import pytest

from routelens.llm import phrases


def brute(rows, least, best, absorb):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = [(x, p) for (x, p), a in f.items() if len(p) > 1 and a >= least]
    dropped = {(x, p[i : i + k]) for x, p in candidates for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * f[x, p] >= absorb * f[x, p[i : i + k]]}
    out = []
    for x in sorted(n):
        mine = []
        for y, p in candidates:
            if y == x and (x, p) not in dropped:
                score, k = min((2_000_000 * f[x, p] // (f[x, p[:k]] + f[x, p[k:]]), k) for k in range(1, len(p)))
                mine.append((-score, -f[x, p], " ".join(p).encode(), f[x, p[:k]], f[x, p[k:]]))
        out += [(x, i + 1, p.decode(), -a, left, right, n[x], -s) for i, (s, a, p, left, right) in enumerate(sorted(mine)[:best])]
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "ß", "Δ", *(f"w{k}" for k in range(40))]
    p = 1 / np.arange(1, len(words) + 1)
    stock = ["new york city hall", "very Well known fact", "w1 w2 w3", "Δ ß Δ ß", "la la la la la la"]
    rows = [("en", None), ("en", ""), (None, "lone words. lone words"), ("fr", "a\x0bb\tb  c! a"), ("xx", " .,; ")]
    for k in range(260):
        out = []
        for _ in range(rng.integers(1, 30)):
            out.append(str(rng.choice(words, p=p / p.sum())) if rng.random() < 0.7 else str(rng.choice(stock)))
            if rng.random() < 0.1:
                out[-1] += str(rng.choice([".", ", ", "\n", "?!"]))
        rows.append((["en", "de", None][k % 3], " ".join(out)))
    return rows + rows[20:30] * 2


@pytest.mark.parametrize("seed,least,best,absorb", [(0, 3, 10_000, 80), (1, 3, 25, 80), (2, 5, 60, 50), (3, 2, 200, 80)])
def test_against_brute_force(spark, seed, least, best, absorb):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, x, t, "y") for k, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(4)
    got = [tuple(r) for r in phrases.mine(docs, least, best, absorb).collect()]
    assert sorted(got) == brute(rows, least, best, absorb)


def test_false_hits_of_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 15)
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.mine(docs, 3, 40).collect()) == brute(rows, 3, 40, 80)


def test_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_search_stops_before_everything_is_expanded(spark):
    """With few phrases asked for, low bounds stay unexpanded."""
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    seen = []
    real = phrases.continuations

    def counting(texts, prefixes, pairs, least):
        seen.append(prefixes.count())
        return real(texts, prefixes, pairs, least)

    phrases.continuations = counting
    try:
        for best in (10, 10_000):
            seen.append(None)
            phrases.mine(docs, 3, best).collect()
    finally:
        phrases.continuations = real
    few, all_ = " ".join(map(str, seen)).split("None")[1:]
    few, all_ = (sum(map(int, x.split())) for x in (few, all_))
    assert few < 0.9 * all_, (few, all_)
