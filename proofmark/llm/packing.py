"""Packing of token pieces into sequences of a fixed length, by exact complements and then best fit.

Lengths are few, pieces are many: the plan is made from the count of each length. It lists combinations of lengths and
how often each is used; the n-th piece of a length, counted over all tasks, then has its place by the plan alone. So no
text is shuffled, the driver sees one count for each length, and the work of planning does not grow with the pieces.
"""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_codec import codec
from .common import sliced, stored, texts, tidy

CAPACITY = 1024
END_OF_TEXT = 2

Combination = tuple[tuple[int, ...], int]


class Planner:
    """Combinations of lengths and how often each is used, from the count of every length from 1 to `capacity`."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.plan: list[Combination] = []

    def _use(self, *lengths: int) -> None:
        """As many times as the counts allow."""
        kinds, each = np.unique(lengths, return_counts=True)
        times = int((self.left[kinds] // each).min())
        if times:
            self.left[kinds] -= times * each
            self.plan.append((lengths, times))

    def _pairs(self, gap: int) -> np.ndarray:
        """Lengths b, from the longest, with b + (gap - b) both there and b at least the half."""
        b = np.arange(gap - 1, (gap - 1) // 2, -1)
        return b[(self.left[b] > 0) & (self.left[gap - b] > 0)]

    def exact(self, above: int) -> None:
        """From the longest piece to those over `above`: the gap is filled by one, two or three pieces that add up to it."""
        if self.left[self.capacity]:
            self._use(self.capacity)
        for length in range(self.capacity - 1, above, -1):
            gap = self.capacity - length
            if self.left[length]:
                self._use(length, gap)
            if self.left[length]:
                for b in self._pairs(gap).tolist():
                    self._use(length, b, gap - b)
                    if not self.left[length]:
                        break
            if self.left[length]:
                for c in range(gap - 2, (gap - 1) // 3, -1):
                    if not self.left[c] or not self.left[length]:
                        continue
                    for b in self._pairs(gap - c).tolist():
                        if b <= c and self.left[length]:
                            self._use(length, c, b, gap - c - b)

    def best_fit(self) -> None:
        """The rest, longest first, each into the fullest open sequence that has room for it."""
        room: list[list[list]] = [[] for _ in range(self.capacity + 1)]  # by gap: [lengths, how many]
        for length in range(self.capacity, 0, -1):
            n, gap = int(self.left[length]), length
            while n:
                while gap <= self.capacity and not room[gap]:
                    gap += 1
                if gap > self.capacity:
                    fit = self.capacity // length
                    many, rest = divmod(n, fit)
                    for k, times in ((fit, many), (rest, 1)):
                        if k and times:
                            room[self.capacity - k * length].append([(length,) * k, times])
                    break
                lengths, times = room[gap].pop()
                used = min(n, times)
                if times > used:
                    room[gap].append([lengths, times - used])
                room[gap - length].append([(*lengths, length), used])
                n -= used
                gap = length
            self.left[length] = 0
        self.plan += [(lengths, times) for at in room for lengths, times in at]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Combination]:
    """Exact complements and then best fit. Short pieces that fill some gap exactly are missed by others, so it is tried how
    far down the lengths exact filling should go; the plan of the fewest sequences holds."""
    plans = []
    for share in (13, 12, 11, 8, 0):
        planner = Planner(counts, capacity)
        planner.exact(capacity * share // 16)
        planner.best_fit()
        plans.append(planner.plan)
    return min(plans, key=lambda p: sum(times for _, times in p))


class Places:
    """For the n-th piece of a length: its sequence and its place there."""

    def __init__(self, combinations: list[Combination]) -> None:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for lengths, times in combinations:
            at = 0
            for length in lengths:
                rows.setdefault(length, []).append((used.get(length, 0), sequence, at))
                used[length] = used.get(length, 0) + times
                at += length
            sequence += times
        self.rows = {k: np.array(v, dtype=np.int64) for k, v in rows.items()}
        self.sequences = sequence

    def find(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            mine = np.flatnonzero(length == k)
            first, base, at = self.rows[k].T
            row = np.searchsorted(first, nth[mine], side="right") - 1
            sequence[mine] = base[row] + nth[mine] - first[row]
            offset[mine] = at[row]
        return sequence, offset


def _pieces(file: str, pattern: str, capacity: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        tail = end.to_bytes(4, "little")
        for batch in sliced(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = codec(file, pattern).encode(text) + tail
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    stop = start + (n % capacity or capacity if piece == 0 else capacity)
                    out.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), task, int(seen[stop - start])))
                    seen[stop - start] += 1
                    start, piece = stop, piece + 1
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
        codec(file, pattern).kept.clear()

    return tidy(run)


def _placed(places: Places) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, file: str, pattern: str, capacity: int = CAPACITY, end: int = END_OF_TEXT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of `docs`.

    A document is its ids and then `end`; one longer than `capacity` is cut into pieces of it, the first one shorter where
    they don't come out even. A null or empty text is one piece of `end` alone. Repeated rows are packed each. An empty
    table gives no rows; other columns are left out.
    """
    pieces = stored(texts(docs).mapInArrow(_pieces(file, pattern, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    ranked = pieces.join(starts, ["length", "task"]).withColumn("nth", F.col("first") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
    return ranked.select(columns).mapInArrow(_placed(Places(plan(by_length, capacity))), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
