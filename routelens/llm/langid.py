"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams of length 1 to LONGEST, lower-cased, over the whole text; each falls into one of SPACE
hashed features that is present or absent. The kernel of two texts is the number of features they share over the geometric mean
of their numbers. Landmarks drawn from each language give Nystrom features K(x, landmarks) K(landmarks, landmarks)^-1/2, and one
kernel ridge regression per language is fitted on them. As the kernel is linear in the presence vector, landmarks and regressions
fold into one matrix, and a batch of texts is scored by one product of its presence matrix with it.

Fitted on at most about SAMPLE texts of each language, of at most SAMPLE_BYTES each, outside the held-out fold. Null texts and texts without a letter are `und`
with score 0; so is everything if nothing could be learned. Of equal scores the first language in alphabetical order wins. Repeated
rows get equal results, an empty table none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out
from .words import chunks, text_buffer

LONGEST, SPACE = 4, 1 << 14
SAMPLE, SAMPLE_BYTES, LANDMARKS, RIDGE = 400, 32_768, 60, 1e-3
_MULTIPLIER = np.uint32(0x9E3779B1)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x SPACE: which features each text of a chunk of bytes has."""
    n, size = len(offsets) - 1, len(data)
    out = np.zeros((n, SPACE), np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int64) * SPACE, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(size)  # bytes to the end of the text
    code, flat = np.zeros(size, np.uint32), out.reshape(-1)
    for length in range(1, LONGEST + 1):
        if size < length:
            break
        k = size - length + 1
        code = code[:k] * np.uint32(257) + data[length - 1 :].astype(np.uint32) + np.uint32(1)
        slot = ((code * _MULTIPLIER) ^ np.uint32(length * 0x3C6EF372 & 0xFFFFFFFF)) * _MULTIPLIER >> np.uint32(32 - SPACE.bit_length() + 1)
        inside = left[:k] >= length
        flat[row[:k][inside] + slot[inside]] = 1
    return out


def _matrix(texts: list[str]) -> np.ndarray:
    data, offsets = text_buffer(pc.utf8_lower(pa.array(texts, pa.string())))
    parts = [presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, SPACE), np.uint8)


def fit(sample: list[tuple[str, str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights of features (SPACE x languages) and offsets."""
    sample = [(t, lang) for t, lang in sample if t]
    langs = sorted({lang for _, lang in sample})
    if not langs:
        return [], np.zeros((SPACE, 0), np.float32), np.zeros(0)
    x = _matrix([t for t, _ in sample]).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    y = np.array([langs.index(lang) for _, lang in sample])
    marks = x[np.concatenate([np.flatnonzero(y == c)[:LANDMARKS] for c in range(len(langs))])]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = (x @ marks.T).astype(np.float64) @ root
    weight = 1 / np.bincount(y)[y]  # languages count alike
    mean = (weight[:, None] * z).sum(axis=0) / weight.sum()
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, 0.0)
    offset = (weight[:, None] * target).sum(axis=0) / weight.sum()
    zc = (z - mean) * np.sqrt(weight)[:, None]
    solved = np.linalg.solve(zc.T @ zc + RIDGE * np.eye(zc.shape[1]), zc.T @ ((target - offset) * np.sqrt(weight)[:, None]))
    return langs, (marks.T @ (root @ solved)).astype(np.float32), offset - mean @ solved


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(texts: pa.Array, langs: list[str], weights: np.ndarray, offset: np.ndarray) -> tuple[list[str], np.ndarray]:
    data, offsets = text_buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    best, score = [], []
    for a, b in chunks(offsets):
        x = presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        f = (x.astype(np.float32) @ weights) / np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))[:, None] + offset
        e = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
        top = f.argmax(axis=1)
        best.append(top)
        score.append((e / e.sum(axis=1, keepdims=True))[np.arange(len(top)), top])
    best, score = (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, int), np.zeros(0))
    ascii_letter = pc.match_substring_regex(texts, "[A-Za-z]").to_pylist()
    known = [bool(a) or _has_letter(t.as_py()) for a, t in zip(ascii_letter, texts, strict=True)]
    return [langs[i] if k else "und" for i, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. labelled: doc_id and label of the documents to learn from."""
    model = fit(bounded_sample(docs, labelled, SAMPLE, SAMPLE_BYTES, doc_id, text))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights, offset = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                lang, score = predict(part.column(2), langs, weights, offset) if langs else (["und"] * part.num_rows, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
