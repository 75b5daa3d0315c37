"""Exact top-k search by inner product, pruned by statistics of segments at several resolutions.

A vector is cut into segments, few at first and more later; the means and deviations of the segments of two vectors give
a lower bound of their distance, and with the lengths an upper bound of their inner product. Pairs whose bound is under
the query's k-th best so far are dropped, level by level; the inner product itself is taken of the pairs that are left,
one by one. Candidates come in steps that grow, so the k-th best is known early.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Batches, stored
from .vectors import finite

SCALE = 64
#: Queries and candidates that meet in one task. A task holds the queries with their statistics, 18 MB at 64 dimensions,
#: and goes through the candidates as they come.
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 8192
#: Pairs of a query and a candidate that a task looks at together.
PAIRS = 1 << 20
#: Segments in which vectors are summed up, coarse to fine: the last levels leave segments of one or two numbers at 64.
SEGMENTS = (1, 4, 16, 32, 48)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector of floor(scale x), of the rows that have an id and a whole, finite vector."""
    vector = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))


class Statistics:
    """Means and deviations of the segments at each level, times the root of the segment's length."""

    def __init__(self, x: np.ndarray) -> None:
        self.levels = []
        for n in SEGMENTS:
            if n > 1 and n > x.shape[1]:
                break
            cuts = np.linspace(0, x.shape[1], n + 1).astype(int)
            means, devs = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = x[:, a:b]
                mean = part.mean(axis=1) if b > a else np.zeros(len(x))
                means.append(mean * (b - a) ** 0.5)
                devs.append(np.sqrt(np.maximum(0, ((part - mean[:, None]) ** 2).sum(axis=1))))
            self.levels.append(np.stack([*means, *devs], axis=1))
        self.square = (x**2).sum(axis=1)

    def lower_bound(self, level: int, queries: "Statistics", rows: np.ndarray) -> np.ndarray:
        """Of the squared distance of each query and each of these rows."""
        mine, theirs = self.levels[level][rows], queries.levels[level]
        return queries.square[:, None] + self.square[rows][None] - 2 * theirs @ mine.T


class Best:
    """The k best candidates of each query so far: higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.stats = Statistics(x)
        self.least = np.full(len(ids), -np.inf)
        self.query, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.most = float(np.abs(x).max(initial=0))
        self.met = 0
        #: Of all pairs so far, how many there were and of how many the inner product was taken.
        self.pairs, self.scored = 0, 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        most, at = max(64, PAIRS // max(1, len(self.ids))), 0
        while at < len(ids):
            n = min(max(2 * self.k, self.met), most)
            self._add(ids[at : at + n], x[at : at + n])
            self.met, at = self.met + n, at + n

    def _add(self, ids: np.ndarray, x: np.ndarray) -> None:
        stats, cols, rows = Statistics(x), np.arange(len(ids)), np.arange(len(self.ids))
        norms = np.sqrt(self.stats.square)[:, None] * np.sqrt(stats.square)[None]
        alive = np.ones(norms.shape, dtype=bool)
        self.pairs += alive.size
        for level in range(len(stats.levels)) if np.isfinite(self.least).any() else ():
            sub = _some(self.stats, rows)
            bound = (sub.square[:, None] + stats.square[cols][None] - stats.lower_bound(level, sub, cols)) / 2
            alive &= bound >= self.least[rows][:, None] - 1e-9 * norms[np.ix_(rows, cols)] - 1e-6
            keep_rows, keep_cols = alive.any(axis=1), alive.any(axis=0)
            rows, cols, alive = rows[keep_rows], cols[keep_cols], alive[np.ix_(keep_rows, keep_cols)]
        q, c = np.nonzero(alive)
        q, c = rows[q], cols[c]
        self.scored += len(q)
        value = self._pairs(q, c, x)
        good = (value >= self.least[q]) & (self.ids[q] != ids[c])
        self._keep(q[good], ids[c[good]], value[good])

    def _whole(self, x: np.ndarray) -> bool:
        """Whether doubles hold every sum of products exactly; where not, numbers of 64 bits do as far as a score is a long."""
        return self.most * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2**53

    def _pairs(self, q: np.ndarray, c: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not self._whole(x):
            self.least = self.least.astype(np.longdouble)
            return (self.x[q].astype(np.longdouble) * x[c]).sum(axis=1)
        return np.concatenate([np.einsum("ij,ij->i", self.x[q[k : k + 65536]], x[c[k : k + 65536]]) for k in range(0, max(1, len(q)), 65536)])

    def _keep(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        query, vec, score = np.concatenate([self.query, query]), np.concatenate([self.vec, vec]), np.concatenate([self.score, score])
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(query)]])))
        keep = nth < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        full = nth == self.k - 1
        self.least[query[full]] = score[full]


def _some(stats: Statistics, rows: np.ndarray) -> Statistics:
    out = object.__new__(Statistics)
    out.levels, out.square = [level[rows] for level in stats.levels], stats.square[rows]
    return out


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of each length."""
    ids, lists = batch.column("vec_id").to_numpy(), batch.column("vector")
    lengths = np.diff(lists.offsets.to_numpy())
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lengths)
    for n in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == n)
        yield ids[mine], flat[(ends[mine] - n)[:, None] + np.arange(n)] if n else np.zeros((len(mine), 0))


def _search(k: int) -> Callable[[Batches], Batches]:
    """Rows come by cell, its queries first; each cell gives at most k rows a query."""

    def run(batches: Batches) -> Batches:
        cell, best, queries = None, {}, {}
        for batch in batches:
            cells, asked = batch.column("cell").to_numpy(), batch.column("candidate").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (asked[1:] != asked[:-1])])) if len(cells) else []
            for a, b in zip(edges, [*edges[1:], len(cells)], strict=True):
                if cells[a] != cell:
                    yield from map(_found, best.values())
                    cell, best, queries = cells[a], {}, {}
                for ids, x in _matrices(batch.slice(a, b - a)):
                    width = x.shape[1]
                    if not asked[a]:
                        queries.setdefault(width, []).append((ids, x))
                    elif width in queries or width in best:
                        if width in queries:
                            parts = queries.pop(width)
                            best[width] = Best(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), k)
                        best[width].add(ids, x)
        yield from map(_found, best.values())

    return run


def _found(b: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(b.ids[b.query], pa.int64()), pa.array(b.vec, pa.int64()), pa.array(np.asarray(b.score).astype(np.int64))], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id `every` divides, candidates all rows of another vec_id. Vectors that are null or hold
    null or non-finite components take no part, nor do rows without vec_id; vectors of different lengths have no score.
    A repeated query counts once, a repeated candidate as often as it is there. Other columns are left out.

    Queries and candidates are dealt to blocks by numbers of their own, so that repeated ids spread too, and each block of
    queries meets each block of candidates in a cell, which is one task's work and gives at most k rows a query. A row is
    sent to as many cells as the other side has blocks; nothing goes through the driver but the two counts.
    """
    rows = stored(quantised(vectors), "vectors")
    asked = stored(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "queries")
    across, down = max(1, -(-rows.count() // candidate_block)), max(1, -(-asked.count() // query_block))

    def dealt(side: DataFrame, blocks: int, others: int, candidate: bool) -> DataFrame:
        block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        both = side.withColumn("block", block).withColumn("other", other)
        cell = F.col("other") * F.lit(across) + F.col("block") if candidate else F.col("block") * F.lit(across) + F.col("other")
        return both.select(cell.cast("long").alias("cell"), F.lit(candidate).alias("candidate"), "vec_id", "vector")

    cells = dealt(asked, down, across, False).unionByName(dealt(rows, across, down, True))
    met = cells.repartition(across * down, "cell").sortWithinPartitions("cell", "candidate")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
