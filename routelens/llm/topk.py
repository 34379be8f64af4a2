"""Exact top-k inner products by aggregation of sorted lists.

The grid of query blocks and candidate blocks is dealt out by cell. Within a cell each dimension is a sorted list of the
candidates' components. A query reads the lists one after the other, those first that weigh most in its scores, each in order from
the end that its component favours. What it has read of a candidate is its partial score. The rest is bounded from both sides by
the norms of what is unread (Cauchy and Schwarz), and from above by the unread lists' first entries. After every few lists outsiders
are dropped: those whose upper bound is below the k-th best lower bound. A list is read until everyone who is left has been met in
it. When outsiders cannot qualify against a short list of SHORT_LIST x k candidates, reading stops and the short list's scores are
resolved from its members' own remaining components, the only entries taken out of order; where ties keep more than that, reading
goes on to the end. Every score is an exact integer.

Vectors that are null, or hold null or non-finite components, take no part. Vectors of different lengths: missing components count
as 0. Ties go to the smaller vec_id; of repeated rows each is a candidate, and a query's own vec_id never is. A query with fewer than
k candidates gets them all; an empty table gives no rows; extra columns are ignored. Components beyond 64 bits are clipped to them
when quantised, and so are scores; long components are summed digit by digit, in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

CANDIDATES, QUERIES = 8192, 2048
#: Bounds are compared after so many lists; reading stops when at most so many times k candidates are left.
LISTS_A_LOOK, SHORT_LIST = 4, 8
SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v, the components as floor(scale * x); vectors that take no part are left out."""
    x = F.col(embedding)
    fits = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.where(fits).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole numbers as digits of so many bits, the lowest first; the last one has the sign."""
    out = []
    while x.size and (x.max() >= 1 << bits or x.min() < -(1 << bits)):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


class Lists:
    """The sorted lists of a cell's candidates, one for each dimension, to be read from either end.

    Components are held in digits of so few bits that sums of products of two digits are exact in floating point; common components
    have one digit. Norms are of components over their dimension's root mean square, which makes bounds tighter.
    """

    def __init__(self, c: np.ndarray):
        self.n, self.dims = c.shape
        self.bits = (51 - 2 * self.dims.bit_length()) // 2
        self.rows, self.ids = c, np.ascontiguousarray(np.argsort(c, axis=0, kind="stable").T)
        values = np.ascontiguousarray(np.take_along_axis(c.T, self.ids, axis=1))
        self.digits = limbs(values, self.bits)
        real = values.astype(np.float64)
        self.scale = np.sqrt((real * real).mean(axis=1))
        self.scale[self.scale == 0] = 1
        self.ends = real[:, [0, -1]].T
        self.squares = (real / self.scale[:, None]) ** 2
        self.norms = ((c / self.scale) ** 2).sum(axis=1)


class Reading:
    """One query's way through the lists: what it has read of each candidate, the bounds, and who can still qualify."""

    def __init__(self, w: np.ndarray, lists: Lists, k: int):
        self.lists, self.k, self.w, self.digits = lists, k, w.astype(np.float64), limbs(w, lists.bits)
        self.weight = (self.w * lists.scale) ** 2
        used = np.flatnonzero(w)  # a component of 0 adds nothing, so its list is not read
        self.order = used[np.argsort(-self.weight[used], kind="stable")]
        self.sums = np.zeros((len(self.digits) + len(lists.digits) - 1, lists.n))
        self.rest = lists.norms.copy()
        self.alive, self.left, self.reads = np.ones(lists.n, bool), lists.n, 0

    def run(self) -> np.ndarray:
        """The candidates that are left when outsiders cannot qualify, their scores resolved."""
        for at, d in enumerate(self.order):
            self.read(d)
            if at % LISTS_A_LOOK == LISTS_A_LOOK - 1:
                self.look(self.order[at + 1 :])
                if self.left <= SHORT_LIST * self.k:
                    return self.resolve(self.order[at + 1 :])
        return np.flatnonzero(self.alive)

    def resolve(self, unread: np.ndarray) -> np.ndarray:
        """Adds what the few that are left have in the unread lists."""
        here = np.flatnonzero(self.alive)
        rows = self.lists.rows[np.ix_(here, unread)]
        self.reads += rows.size
        for i, digit in enumerate(self.digits):
            for j, limb in enumerate(limbs(rows, self.lists.bits)):
                self.sums[i + j, here] += limb @ digit[unread]
        return here

    def read(self, d: int) -> None:
        """Reads list d from the end that the query favours until each candidate that is left has been met."""
        n, met, at = self.lists.n, 0, 0
        size = n if self.left * 8 > n else -(-n // 8)
        while at < n and met < self.left:  # whoever is left is met once in each list
            part = slice(at, at + size) if self.w[d] < 0 else slice(max(n - at - size, 0), n - at)
            ids, inside = self.lists.ids[d, part], slice(None)
            self.reads += len(ids)
            if self.left * 2 < n:
                inside = np.flatnonzero(self.alive[ids])
                ids = ids[inside]
            for i, digit in enumerate(self.digits):
                for j, limb in enumerate(self.lists.digits):
                    np.add.at(self.sums[i + j], ids, digit[d] * limb[d, part][inside])
            np.subtract.at(self.rest, ids, self.lists.squares[d, part][inside])
            met, at = met + len(ids), at + size

    def look(self, unread: np.ndarray) -> None:
        """Drops outsiders: those whose upper bound is below the k-th best lower bound."""
        here = np.flatnonzero(self.alive)
        if len(here) <= self.k:
            return
        score = sum(s[here] * 2.0 ** (self.lists.bits * i) for i, s in enumerate(self.sums))
        error = 1e-12 * np.sqrt(self.weight.sum() * self.lists.norms[here])
        norm = np.sqrt(self.weight[unread].sum() * np.maximum(self.rest[here] + 1e-12 * self.lists.norms[here], 0))
        frontier = (self.w * self.lists.ends[(self.w > 0).astype(int), np.arange(self.lists.dims)])[unread].sum()
        most = 2.0**63  # where scores are clipped
        lower, upper = (np.clip(x, -most, most) for x in (score - norm - error, score + np.minimum(norm, frontier) + error))
        cut = np.partition(lower, len(here) - self.k)[len(here) - self.k]
        out = here[upper < cut]
        self.alive[out] = False
        self.left -= len(out)

    def scores(self, here: np.ndarray) -> np.ndarray:
        """The whole scores of candidates, clipped to 64 bits."""
        if len(self.sums) == 1:
            return self.sums[0, here].astype(np.int64)
        whole = sum(s[here].astype(np.int64).astype(object) << (self.lists.bits * i) for i, s in enumerate(self.sums))
        return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, count: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, and the ids and scores of its k best candidates of this cell. count: gets the entries read for each query."""
    lists = Lists(c)
    for query_id, w in zip(q_ids, q, strict=True):
        reading = Reading(w, lists, k)
        left = reading.run()
        if count is not None:
            count.append(reading.reads)
        yield query_id, *_best(reading.scores(left), c_ids[left], query_id, k)


def _best(score: np.ndarray, ids: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best but the query's own; of equal scores the smaller ids."""
    other = ids != query_id
    score, ids = score[other], ids[other]
    if len(ids) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[score >= cut], ids[score >= cut]
    first = np.lexsort((ids, ~score))[:k]  # ~x falls as x rises, without overflow
    return ids[first], score[first]


def top_k(vectors: DataFrame, k: int = 10, query_every: int = 100, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row whose vec_id is divisible by query_every."""
    rows = saved(quantised(vectors, scale, vec_id, embedding), "topk-vectors")
    sizes = rows.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n")).first()
    dims, n = max(1, sizes.dims or 0), sizes.n
    rows = rows.withColumn("v", F.when(F.size("v") == dims, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0).cast("long"), dims - F.size("v")))))
    queries = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    c_blocks, q_blocks = -(-n // CANDIDATES) or 1, -(-queries.count() // QUERIES) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    salt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))
    left = queries.withColumn("qb", (salt % q_blocks).cast("int")).withColumn("cb", each(c_blocks))
    right = rows.withColumn("cb", (salt % c_blocks).cast("int")).withColumn("qb", each(q_blocks))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and c.num_rows:
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
            for query_id, ids, score in search_cell(q["vec_id"].to_numpy(), matrix(q), c["vec_id"].to_numpy(), matrix(c), k + 1):
                out.append((np.full(len(ids), query_id), ids, score))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({name: pa.array(x.astype(np.int64)) for name, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(cell, SCHEMA)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
