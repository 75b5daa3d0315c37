"""Compression of vectors to short codes: a codebook for each part of the vectors, searched by vantage-point trees.

Each part position has a tree over its codebook's entries. A node holds one entry and how near and far those below it are;
by the triangle inequality a whole branch is left out if none of it can be as near as the best so far. Distances of
branches are rounded outwards and equal ones are visited, so the trees give what comparing every entry would, ties included:
what decides between entries are integers.
"""

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, merged, stored
from .vectors import commonest_length, finite, matrix

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Entries that are compared one by one at the end of a branch.
LEAF = 6
#: Numbers below this have squared distances and sums that fit in 64 bits, for parts of up to 512.
SMALL = 1 << 26
#: Numbers of vectors that are worked on at once.
NUMBERS = 1 << 20
#: More than the relative error of a root or a difference of roots of integers.
SLACK = 1e-14
COLUMNS = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def _floor(x: Column) -> Column:
    """As a double, which holds every whole number it gives; from 2^53 on there are no fractions."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


class Tree:
    """The nearest of some entries for many points at once."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.compared = 0
        self.root = self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> tuple:
        """(entries to compare, border, branches): a branch is (nearest, farthest, node), as seen from the node's first entry."""
        if len(members) <= LEAF:
            return members, 0.0, []
        middle = self.entries[members].mean(axis=0)
        point = int(((self.entries[members] - middle).astype(float) ** 2).sum(axis=1).argmax())
        rest = np.delete(members, point)
        away = np.sqrt(_squares(self.entries[rest], self.entries[members[point]]).astype(float))
        order = np.argsort(away, kind="stable")
        rest, away, half = rest[order], away[order], len(rest) // 2
        branches = [(float(a[0]) * (1 - SLACK), float(a[-1]) * (1 + SLACK), self._grow(np.sort(m))) for m, a in ((rest[:half], away[:half]), (rest[half:], away[half:]))]
        return members[point : point + 1], float(away[half]), branches

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the place of its nearest entry, of equally near ones the first, and the squared distance."""
        self.points = points
        self.at = np.zeros(len(points), dtype=np.int64)
        self.best = _squares(points, self.entries[0])
        self._visit(self.root, np.arange(len(points)))
        return self.at, self.best

    def _visit(self, node: tuple, who: np.ndarray) -> None:
        if not len(who):
            return
        members, border, branches = node
        for k in members.tolist():
            self.compared += len(who)
            square = _squares(self.points[who], self.entries[k])
            better = ((square < self.best[who]) | ((square == self.best[who]) & (k < self.at[who]))).astype(bool)
            self.at[who[better]], self.best[who[better]] = k, square[better]
        if branches:
            away = np.sqrt(square.astype(float))
            for mask, (first, second) in ((away < border, branches), (away >= border, branches[::-1])):
                for nearest, farthest, below in (first, second):
                    group, d = who[mask], away[mask]
                    least = np.maximum(d * (1 - SLACK) - farthest, nearest - d * (1 + SLACK))
                    self._visit(below, group[least <= np.sqrt(self.best[group].astype(float)) * (1 + SLACK)])


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """Doubles without fractions as 64-bit numbers, or as Python's where squares and sums could be too large for these."""
    if np.abs(x).max(initial=0) < SMALL:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def _matrices(batches: Batches, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors, of about a million numbers: each step of a search costs the same for few points."""
    step = max(1, NUMBERS // d)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, whole_numbers(matrix(part.column("x"), d))


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Consecutive parts of one length; zeros are added where the last would be shorter."""
    width = -(-x.shape[1] // parts)
    padded = np.zeros((len(x), width * parts), dtype=x.dtype)
    padded[:, : x.shape[1]] = x
    return [padded[:, k * width : (k + 1) * width] for k in range(parts)]


def _trees(books: list[list[list[int]]]) -> list[Tree]:
    small = max((abs(v) for book in books for entry in book for v in entry), default=0) < SMALL
    return [Tree(np.array(book, dtype=np.int64 if small else object)) for book in books]


def _assigned(trees: list[Tree], x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: the parts, their entries and the squared distances."""
    return [(part, *tree.nearest(part)) for tree, part in zip(trees, _cut(x, len(trees)), strict=True)]


def _totals(books: list[list[list[int]]], d: int) -> Callable[[Batches], Batches]:
    """For each part position and entry, how many parts are its own, and their sum."""

    def run(batches: Batches) -> Batches:
        trees = _trees(books)
        total = [[[0] * (1 + len(entry)) for entry in book] for book in books]
        for _, x in _matrices(batches, d):
            for mine, (part, at, _) in zip(total, _assigned(trees, x), strict=True):
                order = np.argsort(at, kind="stable")
                used, starts, counts = np.unique(at[order], return_index=True, return_counts=True)
                for k, n, row in zip(used.tolist(), counts.tolist(), np.add.reduceat(part[order], starts).tolist(), strict=True):
                    mine[k] = [a + b for a, b in zip(mine[k], [n, *row], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(total).encode()], pa.binary())], names=["part"])

    return run


def _add(a: bytes, b: bytes) -> bytes:
    both = zip(json.loads(a), json.loads(b), strict=True)
    return json.dumps([[[u + v for u, v in zip(x, y, strict=True)] for x, y in zip(one, other, strict=True)] for one, other in both]).encode()


def codebooks(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """The entries of each part position, learned from rows with vec_id and x, vectors of d whole numbers."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = [part.tolist() for part in _cut(whole_numbers(np.array([r["x"] for r in first]).reshape(-1, d)), parts)]
    for _ in range(rounds if books[0] else 0):
        total = json.loads(merged(rows.mapInArrow(_totals(books, d), "part binary"), _add))
        books = [[[v // t[0] for v in t[1:]] if t[0] else entry for entry, t in zip(book, mine, strict=True)] for book, mine in zip(books, total, strict=True)]
    return books


def digest(books: list[list[list[int]]]) -> str:
    """Of all numbers of the codebooks, by part position, entry and place."""
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def coded(rows: DataFrame, books: list[list[list[int]]], d: int) -> DataFrame:
    """rows, with x, get code and error in place of x. An error that is no long is null."""
    names = [c for c in rows.columns if c != "x"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def run(batches: Batches) -> Batches:
        trees = _trees(books)
        for batch, x in _matrices(batches, d):
            found = _assigned(trees, x)
            codes = np.stack([at for _, at, _ in found], axis=1).astype(np.uint8)
            errors = sum(best.astype(object) for _, _, best in found)
            made = [pa.array([bytes(row).hex() for row in codes], pa.string()), pa.array([e if e < 2**63 else None for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "code", "error"])

    return rows.mapInArrow(run, f"{schema}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row.

    Rows whose vector is null, or holds null or non-finite numbers, take no part; of vectors of several lengths those of the
    commonest one do (ties: the longest), and vectors that `parts` doesn't divide get zeros at their end. Numbers become
    floor(scale c). Codebooks start as the parts of the rows of least vec_id (null last; ties by the vector), fewer than
    `entries` where there are fewer rows; each of `rounds` assigns every part to its nearest entry (ties: the first) and puts
    the floored mean of its parts in an entry's place; unused ones stay. A code has two hexadecimal digits a part, so entries
    are 256 at most. label_error adds up error over equal values of the column `label`, nulls together, and over all rows
    without such a column. Sums that are no long are null. An empty table gives no rows; other columns are left out.

    The driver and each task hold the codebooks and a sum for each of their numbers; these do not grow with the rows. The
    errors of labels are joined by value; Spark broadcasts them where the written table is small, else it can split hot ones.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two digits, so entries are 1 to 256")
    spark = vectors.sparkSession
    numbers = F.transform("embedding", lambda c: _floor(c.cast("double") * scale))
    group = F.col(f"`{label}`") if label in vectors.columns else F.lit(None).cast("string")
    rows = vectors.filter(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), group.alias("label"), numbers.alias("x"))
    rows = stored(rows, "numbers")
    d = commonest_length(rows, "x")
    if d == 0:
        return spark.createDataFrame([], COLUMNS)
    rows = rows.filter(F.size("x") == d)
    books = codebooks(rows.select("vec_id", "x"), d, parts, entries, rounds)
    done = stored(coded(rows, books, d), "codes")
    sums = done.groupBy(F.col("label").alias("of")).agg(F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).alias("sum"))
    sums = stored(sums.select("of", F.expr("try_cast(sum as bigint)").alias("label_error")), "label_errors")
    both = done.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
