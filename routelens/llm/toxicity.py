"""Toxicity by a gapped subsequence string kernel, Nystrom landmarks and a support vector machine.

The instances are words: letters and digits only, lower-cased, so that characters put between letters do not count; single letters
in a row form one word. A word is described by its subsequences of three characters within SPAN characters, each weighted by
DECAY to the number of characters skipped, so gapped and inserted-character forms share most subsequences with the plain word. The
kernel of two words is the product of these descriptions, divided by a norm for their lengths.

Landmarks are words that occur in many toxic and few other training documents, and the words of clean ones most like them. On
their Nystrom features a linear support vector machine is trained by multiple-instance rounds: a sentence scores as its highest
word; all sentences of clean documents are labelled clean, and of toxic documents the sentences whose word scores above 0 and
half the document's highest are labelled toxic; the first round takes the words' log odds for a score. As the kernel is linear in
the description, landmarks and machine fold into one weight for each subsequence. A document's score is a logistic curve, fitted
to the training documents, of its two highest words, the sum of its words above 0 and its number of words.

Fitted on about SAMPLE documents of each label, of at most SAMPLE_BYTES each, outside the held-out fold. Null, empty and
wordless texts get the score of a text without any matching word; if nothing could be learned, all scores are 0. Repeated rows get
equal scores, an empty table none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitted, free_name, held_out, map_batches, sample_rows
from .words import ALNUM, LOWER, NON_SPACE, chunks, text_buffer

SPAN, DECAY, LANDMARKS, PLAIN_LANDMARKS, LEAST_DOCS = 5, 0.5, 96, 96, 3
SAMPLE, SAMPLE_BYTES, ROUNDS, STEPS, REGULAR, SEEN, NEAR = 1000, 16_384, 2, 30, 1e-5, 0.15, 0.25
#: Six bits for a character: digits, letters, and the bytes of other scripts in 26 groups.
_KIND = np.array([36 + b % 26 if b >= 128 else (b - 48) % 10 for b in range(256)], np.int32)
_KIND[97:123] = np.arange(10, 36)
#: What stands before and after each word.
_BEGIN, _END = 1, 2
_KIND[_BEGIN], _KIND[_END] = 62, 63
_TRIPLES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _norms(longest: int) -> np.ndarray:
    """The norm of a word of each length, as if no subsequence came twice."""
    n = np.arange(longest + 1)
    return np.sqrt(np.maximum(sum(np.maximum(n - b, 0) * DECAY ** (2 * (b - 2)) for _, b in _TRIPLES), 1e-9))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes: the kept bytes, each word between marks, and for each word where it starts among them, its text, and where it starts in data."""
    n = len(data)
    kept = np.flatnonzero(ALNUM[data])
    if not len(kept):
        return data[:0], kept, kept, kept
    # a word begins where a space or a text border lies between two kept bytes
    border = np.zeros(n + 1, np.int64)
    border[1:] = np.cumsum(~NON_SPACE[data])
    text = np.searchsorted(offsets, kept, side="right") - 1
    word = border[kept] + text
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    length, of = np.diff(np.append(starts, len(kept))), text[starts]
    joined = np.zeros(len(starts), bool)
    joined[1:] = (length[1:] == 1) & (length[:-1] == 1) & (of[1:] == of[:-1])
    starts, of = starts[~joined], of[~joined]
    number = np.zeros(len(kept), np.int64)
    number[starts[1:]] = 1
    chars = np.full(len(kept) + 2 * len(starts), _END, np.uint8)
    chars[np.arange(len(kept)) + 2 * np.cumsum(number) + 1] = data[kept]
    first = starts + 2 * np.arange(len(starts))
    chars[first] = _BEGIN
    return chars, first, of, kept[starts]


def _triples(chars: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Position, code and weight of each subsequence, for one pattern of skips at a time."""
    kind = _KIND[chars]
    left = np.repeat(np.append(starts[1:], len(chars)), np.diff(np.append(starts, len(chars)))) - np.arange(len(chars))
    for a, b in _TRIPLES:
        at = np.flatnonzero(left > b)
        yield at, (kind[at] << 12) | (kind[at + a] << 6) | kind[at + b], DECAY ** (b - 2)


def word_scores(chars: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0)
    value = np.zeros(len(chars), np.float32)
    for at, code, w in _triples(chars, starts):
        value[at] += np.float32(w) * weights[code]
    length = np.diff(np.append(starts, len(chars)))
    return np.add.reduceat(value, starts) / _norms(int(length.max()))[length]


def _describe(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of a few words, and words x subsequences with their normed weights."""
    length = np.array([len(w) for w in words])
    chars, starts = np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum(length)[:-1])
    of = np.repeat(np.arange(len(words)), length)
    parts = [(of[at], code, np.full(len(at), weight)) for at, code, weight in _triples(chars, starts)]
    row, code, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    used, column = np.unique(code, return_inverse=True)
    out = np.zeros((len(words), len(used)))
    np.add.at(out, (row, column), weight)
    return used, out / _norms(int(length.max()))[length][:, None]


def _features(words: list[bytes], used: np.ndarray, columns: np.ndarray) -> Iterator[np.ndarray]:
    """Descriptions of words, part by part, times columns (subsequences used x features)."""
    slot = np.full(1 << 18, len(used), np.int32)
    slot[used] = np.arange(len(used))
    columns = np.concatenate([columns, np.zeros((1, columns.shape[1]))]).astype(np.float32)
    for lo in range(0, len(words), 2000):
        part = words[lo : lo + 2000]
        length = np.array([len(w) for w in part])
        chars, starts = np.frombuffer(b"".join(part), np.uint8), np.append(0, np.cumsum(length)[:-1])
        value = np.zeros((len(chars), columns.shape[1]), np.float32)
        for at, code, weight in _triples(chars, starts):
            value[at] += np.float32(weight) * columns[slot[code]]
        yield np.add.reduceat(value, starts, axis=0) / _norms(int(length.max()))[length][:, None].astype(np.float32)


def fit(sample: list[tuple[str, int]]) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Weight of each subsequence, bias, and the coefficients of the logistic curve; None without documents of both labels."""
    sample = [(t, int(y)) for t, y in dict.fromkeys(sample) if t]  # copies count once
    texts, label = [t for t, _ in sample], np.array([y for _, y in sample])
    if len(set(label.tolist())) < 2:
        return None
    data, offsets = text_buffer(pc.utf8_lower(pa.array(texts, pa.string())))
    vocabulary: dict[bytes, int] = {}
    parts, numbers, docs, sentences, ended = [], [], [], [], 0
    for lo, hi in chunks(offsets):  # some texts at a time: tokens takes many times their bytes
        part = data[offsets[lo] : offsets[hi]]
        chars, starts, of, place = tokens(LOWER[part], offsets[lo : hi + 1] - offsets[lo])
        raw, ends = chars.tobytes(), np.append(starts[1:], len(chars))[: len(starts)]
        numbers.append(np.array([vocabulary.setdefault(raw[a:b], len(vocabulary)) for a, b in zip(starts, ends, strict=True)], np.int64))
        # sentences end at . ! ? and line ends
        end = np.append(0, np.cumsum(np.isin(part, np.frombuffer(b".!?\n", np.uint8))))
        sentences.append(end[place] + ended + of + lo)
        parts.append((chars, starts))
        docs.append(of + lo)
        ended += int(end[-1])
    if not vocabulary:
        return None
    word, doc, sentence = (np.concatenate(x) for x in (numbers, docs, sentences))
    names = list(vocabulary)
    pairs = np.unique(np.stack([doc, word]), axis=1)
    toxic = np.bincount(pairs[1][label[pairs[0]] == 1], minlength=len(names))
    clean = np.bincount(pairs[1][label[pairs[0]] == 0], minlength=len(names))
    n1, n0 = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    usable = np.array([5 <= len(w) <= 26 for w in names])
    strength = np.where(usable & (toxic + clean >= LEAST_DOCS), odds * np.sqrt(toxic + clean), -np.inf)
    top = [i for i in np.argsort(-strength, kind="stable")[:LANDMARKS] if strength[i] > SEEN * strength.max() > 0]
    if not top:
        return None
    used, described = _describe([names[i] for i in top])
    alike = np.concatenate([f.max(axis=1) for f in _features(names, used, described.T)])
    plain = np.argsort(np.where(usable & (toxic * n0 <= clean * n1), -alike, 1), kind="stable")[:PLAIN_LANDMARKS]
    used, described = _describe([names[i] for i in dict.fromkeys([*top, *plain]) if usable[i]])
    value, vector = np.linalg.eigh(described @ described.T)
    keep = value > 1e-4 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    near = np.union1d(np.flatnonzero(alike >= NEAR), plain)  # the machine learns from these words; all others are far from every toxic landmark
    z = np.concatenate(list(_features([names[i] for i in near], used, described.T @ root)))

    guess = np.where(np.isfinite(strength), strength / strength.max() - SEEN, -1.0)
    by_doc, by_sentence = np.argsort(doc, kind="stable"), np.argsort(sentence, kind="stable")
    doc_starts = np.flatnonzero(np.append(True, np.diff(doc[by_doc]) != 0))
    sentence_starts = np.flatnonzero(np.append(True, np.diff(sentence[by_sentence]) != 0))
    for _ in range(ROUNDS):
        # of each toxic document the words that score above 0 and at least half its highest; of each clean sentence its highest word, and every word of clean documents once
        best = np.full(len(texts), -np.inf)
        best[doc[by_doc][doc_starts]] = np.maximum.reduceat(guess[word[by_doc]], doc_starts)
        chosen = (label[doc] == 1) & (guess[word] > 0) & (guess[word] >= best[doc] / 2)
        witness = np.bincount(word[chosen], minlength=len(names))
        top = np.maximum.reduceat(guess[word[by_sentence]], sentence_starts)
        highest = guess[word[by_sentence]] >= np.repeat(top, np.diff(np.append(sentence_starts, len(word))))
        negative = np.bincount(word[by_sentence[highest & (label[doc[by_sentence]] == 0)]], minlength=len(names))
        if not witness[near].any() or not negative.any():
            return None
        w, bias = _machine(z, (witness / witness.sum())[near], (negative / negative.sum() + (clean > 0) / (clean > 0).sum())[near])
        guess = np.full(len(names), -1.0)
        guess[near] = z @ w + bias
    weights = np.zeros(1 << 18, np.float32)
    weights[used] = described.T @ (root @ w)
    features = _document_features(doc, np.concatenate([word_scores(*x, weights) for x in parts]) + bias, len(texts))
    return weights, bias, _logistic(features, label.astype(float))


def _document_features(doc: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Highest and second highest word, sum of words above 0 (each counts up to 2), number of words, and a constant, for each of n documents."""
    order = np.lexsort((score, doc))
    number = np.bincount(doc, minlength=n)
    last = np.cumsum(number) - 1
    top = np.full((2, n), -2.0)
    for k in range(2):
        has = number > k
        top[k, has] = score[order[last[has] - k]]
    above = np.bincount(doc, np.clip(score, 0, 2), minlength=n)
    return np.stack([*np.clip(top, -2, 2), np.log1p(above), np.log1p(number), np.ones(n)], axis=1)


def _machine(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss, by Newton steps on the rows within the margin.

    toxic, clean: how much each row counts as an example of either label.
    """
    x = np.concatenate([z, np.ones((len(z), 1), np.float32)], axis=1)
    ridge = np.full(x.shape[1], REGULAR)
    ridge[-1] = 1e-9
    w, below, above = np.zeros(x.shape[1]), np.ones(len(z), bool), np.ones(len(z), bool)
    for _ in range(STEPS):
        t, c = toxic * below, clean * above
        used = np.flatnonzero(t + c)
        rows = x[used].astype(np.float64)
        w = np.linalg.solve((rows * (t + c)[used][:, None]).T @ rows + np.diag(ridge), rows.T @ (t - c)[used])
        f = x @ w
        if ((f < 1) == below).all() and ((f > -1) == above).all():
            break
        below, above = f < 1, f > -1
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a lightly regularised logistic regression, by Newton's method; labels count alike."""
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.1 * b
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def score_texts(texts: pa.Array, model: tuple[np.ndarray, float, np.ndarray] | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    weights, bias, curve = model
    data, offsets = text_buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    out = np.zeros(len(texts))
    for a, b in chunks(offsets):
        chars, starts, doc, _ = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        features = _document_features(doc, word_scores(chars, starts, weights) + bias, b - a)
        out[a:b] = 1 / (1 + np.exp(-np.clip(features @ curve, -30, 30)))
    return out


def learn(docs: DataFrame, labelled: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[np.ndarray, float, np.ndarray] | None:
    """labelled: doc_id and label (1: toxic) of documents in docs."""
    return fitted(sample_rows(docs, labelled, SAMPLE, SAMPLE_BYTES, doc_id, text), fit)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray] | None, threshold: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with held_out, score and predicted behind its columns: tox_held_out, tox_score and tox_predicted, or those names with
    underscores behind if docs has them already."""
    held, named, predicted = (free_name(docs, f"tox_{x}") for x in ("held_out", "score", "predicted"))
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(text_buffer(b.column(at))[1]):
                part = b.slice(lo, hi - lo)
                score = score_texts(part.column(at), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, named])

    scored = map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(named, T.DoubleType())]))
    return scored.withColumn(held, held_out(F.col(doc_id))).withColumn(predicted, (F.col(named) >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those predicted toxic; all of them if nothing could be learned."""
    model = learn(docs, labelled)
    return docs if model is None else score_documents(docs, model, threshold).where(F.col(free_name(docs, "tox_predicted")) == 0).select(*docs.columns)
