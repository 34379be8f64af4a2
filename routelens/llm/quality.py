"""Text quality by a factorisation machine.

Features of a whole text: its distinct words, lower-cased and hashed into SPACE columns; statistics of its structure, each cut
into bins at quantiles of the training texts; and numeric metadata columns, binned alike (a null has a bin of its own). All pairs
of features interact through FACTORS latent factors per feature. The pairwise sum is computed in linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), for a batch of texts at a time. The score is
the probability of label 1.

Fitted on about SAMPLE documents of each label, of at most SAMPLE_BYTES each, outside the held-out fold; labels are weighted by
what they are in all labelled documents. Null and empty texts are scored from their statistics. If nothing could be learned, all scores are 0.
Repeated rows get equal scores, an empty table none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitted, free_name, held_out, map_batches, sample_rows
from .words import NON_SPACE, chunks, text_buffer, words

SPACE, FACTORS, BINS = 8192, 8, 8
SAMPLE, SAMPLE_BYTES, EPOCHS, STEPS, BATCH, RATE, DECAY = 1500, 16_384, 15, 180, 256, 0.02, 1e-4
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False
#: Kinds of bytes whose shares are statistics.
_KINDS = [
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), (b"0123456789", "digit"), (b".,;:", "stop"), (b"!?", "shout"), (b"#$%&*@^~=+<>\\/_{}[]()|", "symbol"), (b"'\"-", "quote"), (b"\n\r", "line"), (b" \t\x0b\x0c", "blank")
]
_SHARES = np.zeros((len(_KINDS) + 1, 256), bool)
for _i, (_bytes, _) in enumerate(_KINDS):
    _SHARES[_i, list(_bytes)] = True
_SHARES[-1, 128:] = True
STATISTICS = [*(k for _, k in _KINDS), "wide", "bytes", "words", "word_bytes", "distinct", "commonest", "repeated", "long_words", "short_words", "lines", "line_bytes", "distinct_lines"]


class Machine(NamedTuple):
    edges: np.ndarray  #: statistics and metadata x (BINS - 1) borders
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def describe(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of each text, and its distinct word columns as flat values with bounds; texts of some bytes at a time."""
    parts = [_describe(texts[lo:hi]) for lo, hi in chunks(text_buffer(texts)[1])] or [_describe(texts)]
    sizes = np.concatenate([np.diff(p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(([0], np.cumsum(sizes)))


def _describe(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(texts)
    data, offsets = text_buffer(texts)
    stats = np.zeros((n, len(STATISTICS)))
    size = np.diff(offsets).astype(float)
    for k in range(len(_SHARES)):
        total = np.concatenate(([0], np.cumsum(_SHARES[k][data], dtype=np.int64)))
        stats[:, k] = np.diff(total[offsets]) / np.maximum(size, 1)
    k = len(_SHARES)
    stats[:, k] = np.log1p(size)
    columns, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in words(texts, NON_SPACE):
        rows = slice(w.first, w.first + w.n)
        number, length = np.diff(w.bounds), w.ends - w.starts
        doc = np.repeat(np.arange(w.n), number)
        many = np.maximum(number, 1)
        key, count = np.unique((doc << 20) | (w.hashes & np.uint64((1 << 20) - 1)).astype(np.int64), return_counts=True)
        most = np.zeros(w.n, np.int64)
        np.maximum.at(most, key >> 20, count)
        same = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
        stats[rows, k + 1] = np.log1p(number)
        stats[rows, k + 2] = np.bincount(doc, length, w.n) / many
        stats[rows, k + 3] = np.bincount(key >> 20, minlength=w.n) / many
        stats[rows, k + 4] = most / many
        stats[rows, k + 5] = np.bincount(doc[1:][same], minlength=w.n) / many
        stats[rows, k + 6] = np.bincount(doc[length > 20], minlength=w.n) / many
        stats[rows, k + 7] = np.bincount(doc[length < 3], minlength=w.n) / many
        column = np.unique((key >> 20) * SPACE + (key & (SPACE - 1)))
        columns.append(column % SPACE)
        counts.append(np.bincount(column // SPACE, minlength=w.n))
    for w in words(texts, _NOT_NEWLINE):
        rows = slice(w.first, w.first + w.n)
        number = np.diff(w.bounds)
        doc = np.repeat(np.arange(w.n), number)
        first = np.unique(w.hashes ^ (doc.astype(np.uint64) << np.uint64(40)), return_index=True)[1]
        stats[rows, k + 8] = np.log1p(number)
        stats[rows, k + 9] = np.log1p(np.bincount(doc, w.ends - w.starts, w.n) / np.maximum(number, 1))
        stats[rows, k + 10] = np.bincount(doc[first], minlength=w.n) / np.maximum(number, 1)
    return stats, np.concatenate(columns), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _bins(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Columns of the statistics' bins, behind those of the words."""
    out = np.empty(stats.shape, np.int64)
    for k in range(stats.shape[1]):
        bin_of = np.where(np.isnan(stats[:, k]), BINS, np.searchsorted(edges[k], stats[:, k], side="right"))
        out[:, k] = SPACE + k * (BINS + 1) + bin_of
    return out


def _rows(texts: pa.Array, metadata: np.ndarray, edges: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat columns, values and bounds of the texts' features, and the borders of the bins."""
    stats, column, bounds = describe(texts)
    stats = np.concatenate([stats, metadata], axis=1)
    if edges is None:
        edges = np.array([np.nanquantile(s, np.arange(1, BINS) / BINS) if np.isfinite(s).any() else np.zeros(BINS - 1) for s in np.where(np.isfinite(stats), stats, np.nan).T])
    bins = _bins(stats, edges)
    n, own, extra = len(texts), np.diff(bounds), bins.shape[1]
    out_bounds = bounds + extra * np.arange(n + 1)
    flat, value = np.empty(out_bounds[-1], np.int64), np.empty(out_bounds[-1], np.float32)
    at_bins = (out_bounds[:-1, None] + np.arange(extra)).ravel()
    mask = np.ones(len(flat), bool)
    mask[at_bins] = False
    flat[at_bins], value[at_bins] = bins.ravel(), 1 / np.sqrt(extra)
    flat[mask], value[mask] = column, np.repeat(1 / np.sqrt(np.maximum(own, 1)), own)
    return flat, value, out_bounds, edges


def fit(sample: list[tuple[str, np.ndarray, int]], prior: float) -> Machine | None:
    """prior: the share of label 1 in all labelled documents."""
    label = np.array([y for _, _, y in sample], float)
    if len(set(label.tolist())) < 2:
        return None
    metadata = np.array([m for _, m, _ in sample], float).reshape(len(sample), -1)
    flat, value, bounds, edges = _rows(pa.array([t for t, _, _ in sample], pa.string()), metadata, None)
    size = SPACE + len(edges) * (BINS + 1)
    weight = np.where(label > 0, prior / label.mean(), (1 - prior) / (1 - label.mean()))
    rng = np.random.default_rng(3)
    bias, w, v = np.log(prior / (1 - prior)), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)]
    t, epochs = 0, max(EPOCHS, -(-STEPS * BATCH // len(label)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(label)), -(-len(label) // BATCH)):
            x = np.zeros((len(part), size), np.float32)
            for i, d in enumerate(part):
                x[i, flat[bounds[d] : bounds[d + 1]]] = value[bounds[d] : bounds[d + 1]]
            sums, square = x @ v, x * x
            z = bias + x @ w + 0.5 * ((sums**2).sum(axis=1) - (square @ (v * v)).sum(axis=1))
            g = (weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / len(part)).astype(np.float32)
            grads = (x.T @ g + DECAY * w, x.T @ (g[:, None] * sums) - (square.T @ g)[:, None] * v + DECAY * v)
            t += 1
            for p, grad, m in zip((w, v), grads, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * grad * grad
                p -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
            bias -= rate * float(g.sum())
    return Machine(edges, float(bias), w, v)


def score_texts(texts: pa.Array, metadata: np.ndarray, machine: Machine | None) -> np.ndarray:
    if machine is None or not len(texts):
        return np.zeros(len(texts))
    flat, value, bounds, _ = _rows(texts, metadata, machine.edges)
    starts = bounds[:-1]  # every text has its statistics, so no row is empty
    scaled = machine.factors[flat] * value[:, None]
    sums = np.add.reduceat(scaled, starts, axis=0)
    pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((scaled * scaled).sum(axis=1), starts))
    z = machine.bias + np.add.reduceat(machine.linear[flat] * value, starts) + pairs
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def learn(docs: DataFrame, labelled: DataFrame, metadata: tuple[str, ...] = (), text: str = "text", doc_id: str = "doc_id") -> Machine | None:
    """labelled: doc_id and label (0 or 1) of documents in docs; metadata: numeric columns of docs."""
    drawn = sample_rows(docs, labelled, SAMPLE, SAMPLE_BYTES, doc_id, text, metadata)
    if drawn is None:
        return None
    prior = labelled.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.avg("label")).first()[0]
    return fitted(drawn, lambda rows: fit([(t, [np.nan if v is None else float(v) for v in more], int(y)) for t, y, *more in rows], float(prior)))


def score_documents(docs: DataFrame, model: Machine | None, threshold: float = 0.3, metadata: tuple[str, ...] = (), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with qual_held_out, qual_score and qual_predicted behind its columns, or those names with underscores behind if docs
    has them already."""
    held, named, predicted = (free_name(docs, f"qual_{x}") for x in ("held_out", "score", "predicted"))
    at, more_at = docs.columns.index(text), [docs.columns.index(m) for m in metadata]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(text_buffer(b.column(at))[1]):
                part = b.slice(lo, hi - lo)
                more = [pc.cast(part.column(m), pa.float64()).to_numpy(zero_copy_only=False) for m in more_at]
                score = score_texts(part.column(at), np.stack(more, axis=1) if more else np.zeros((part.num_rows, 0)), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, named])

    scored = map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(named, T.DoubleType())]))
    return scored.withColumn(held, held_out(F.col(doc_id))).withColumn(predicted, (F.col(named) >= threshold).cast("int"))


def drop_poor(docs: DataFrame, labelled: DataFrame, metadata: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """docs without those predicted to have label 0; all of them if nothing could be learned."""
    model = learn(docs, labelled, metadata)
    return docs if model is None else score_documents(docs, model, threshold, metadata).where(F.col(free_name(docs, "qual_predicted")) == 1).select(*docs.columns)
