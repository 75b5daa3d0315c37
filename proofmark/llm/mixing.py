"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is to be taken equally often, a whole number of times and a fraction. The fractions are
inclusion probabilities, and the cube method makes them noughts and ones while the source's words and documents stay
what they are: of three documents at a time, the probabilities move along the one direction that changes neither sum
until one of them is settled. What blocks of documents leave, two each, meets in larger blocks, until two a source are left.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Batches, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
#: How many times a source may be repeated.
MOST = 3.0
#: Documents that a block settles, one after another; two of each block are left.
BLOCK = 1024
#: Copies that one row is spread into at once.
SPREAD = 65_536
#: Probabilities this near to 0 or 1 are settled.
NEAR = 1e-9


def _direction(sizes: list[int]) -> tuple[float, float, float]:
    """A change of three probabilities that leaves their sum, and that of sizes times probabilities."""
    a, b, c = sizes
    if a == b:
        return 1.0, -1.0, 0.0
    most = max(abs(b - c), abs(c - a), abs(a - b))
    return (b - c) / most, (c - a) / most, (a - b) / most


class Flight:
    """Settles the documents of a block, one by one as they come."""

    def __init__(self) -> None:
        #: row, size, probability of those not settled yet: two at most between documents.
        self.open: list[tuple[int, int, float]] = []
        self.settled: list[tuple[int, float]] = []

    def add(self, row: int, size: int, probability: float, draw: float) -> None:
        """draw: from 0 to 1, which of two ends a move goes to."""
        self.open.append((row, size, probability))
        while len(self.open) > 2 or (len(self.open) == 2 and self.open[0][1] == self.open[1][1]):
            mine = sorted(self.open, key=lambda x: x[1])
            if len(mine) == 3 and mine[1][1] == mine[2][1]:
                mine.reverse()
            way = _direction([s for _, s, _ in mine]) if len(mine) == 3 else (1.0, -1.0)
            up = min((1 - p) / u if u > 0 else p / -u for (_, _, p), u in zip(mine, way, strict=True) if u)
            down = min(p / u if u > 0 else (1 - p) / -u for (_, _, p), u in zip(mine, way, strict=True) if u)
            step = up if draw * (up + down) < down else -down
            draw = draw * 7919 % 1
            moved = [(r, s, p + step * u) for (r, s, p), u in zip(mine, way, strict=True)]
            self.settled += [(r, float(round(p))) for r, _, p in moved if not NEAR < p < 1 - NEAR]
            self.open = [x for x in moved if NEAR < x[2] < 1 - NEAR]


def _flown(batches: Batches) -> Batches:
    """Rows come by source and block; each gets the probability that its block leaves it."""
    held: list[pa.RecordBatch] = []
    flight, key = Flight(), None

    def given(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        left = np.empty(table.num_rows)
        for row, p in [*flight.settled, *((r, p) for r, _, p in flight.open)]:
            left[row] = p
        at = table.schema.get_field_index("p")
        yield from table.set_column(at, "p", pa.array(left)).combine_chunks().to_batches()

    count = 0
    for batch in batches:
        start = 0
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("nth", "block")), strict=True))
        sizes, ps, draws = (batch.column(c).to_pylist() for c in ("size", "p", "draw"))
        for k in range(batch.num_rows):
            if keys[k] != key:
                if start < k:
                    held.append(batch.slice(start, k - start))
                if held:
                    yield from given(held)
                held, flight, key, count, start = [], Flight(), keys[k], 0, k
            flight.add(count, sizes[k], ps[k], draws[k])
            count += 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield from given(held)


def _sources(units: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """nth, source, source_size, target of each source, nth from 0 by code point, null last."""
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    sums = stored(sums.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()), "sources")
    # read again, rows need not come as they were written: places are counted a range of names at a time
    ranges = sums.select("*", F.input_file_name().alias("file"))
    ranges = ranges.select("*", F.row_number().over(W.partitionBy("file").orderBy(F.col("source").asc_nulls_last())).alias("within"))
    ends = ranges.groupBy("file").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("source").isNull().alias("last"), "source")).alias("first"))
    before = F.sum("rows").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1))
    starts = ends.select("file", F.coalesce(before, F.lit(0)).alias("start"))
    placed = ranges.join(starts, "file").select("source", "source_size", "units", (F.col("start") + F.col("within") - 1).alias("nth"))
    weight = F.get(F.array(*map(F.lit, map(float, weights))), F.pmod(F.col("nth"), F.lit(len(weights))).cast("int"))
    placed = stored(placed.withColumn("weight", weight), "placed")
    room = F.col("source_size") * F.lit(float(most))
    total, level, capped = placed.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = room <= F.col("weight") * F.lit(level)
        row = placed.agg(
            F.count_if(over).alias("capped"),
            F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("full"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weights"),
        ).first()
        if row["capped"] == capped or not row["weights"]:
            break
        capped, level = row["capped"], max(level, (total - most * row["full"]) / row["weights"])
    return placed.withColumn("target", F.least(room, F.col("weight") * F.lit(level)))


def _draw(*columns: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of `docs`.

    size: words of the text, null: none. Sources, by code point and null last, get `weights` in turn, and share as many words
    as all documents have, none more than `most` times its own: what is over goes to the others by weight. Each document is
    taken target / source_size times, rounded up or down so that its source's words and documents come out right; the two
    documents a source that are open at the end are cut to what is missing, so a source takes its target to the word. No
    document is taken more than `most` times (rounded up). A source without words takes none.

    Rows of one doc_id, source and size are one unit with a count: of n such rows, whole ones are settled at once and only a
    fraction of one flies. So rows that repeat, or have no doc_id, don't meet in one block. What happens depends on doc_id,
    source and size alone, not on how rows lie: reruns agree. An empty table gives no rows; other columns are left out.
    Texts are not moved, and blocks are of about 1,024 units, whatever a source's share.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    units = stored(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "units")
    sources = stored(_sources(units, weights, most).select("nth", F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("units") / block).alias("blocks")), "targets")

    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parts = units.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("base", F.floor(times))
    parts = parts.withColumn("wanted", (times - F.col("base")) * F.col("n")).withColumn("whole", F.floor(F.col("wanted") + NEAR))
    p = F.greatest(F.col("wanted") - F.col("whole"), F.lit(0.0))
    place = _draw(F.lit("block"), "doc_id", "size")
    parts = parts.select("nth", "doc_id", "size", "n", "source_size", "target", "base", "whole", F.when((p > NEAR) & (F.col("size") > 0), p).otherwise(0.0).alias("p"), F.floor(place * F.col("blocks")).alias("block"), "blocks", _draw("doc_id", "size").alias("draw"))
    live = stored(parts, "parts")
    open_ = (F.col("p") > NEAR) & (F.col("p") < 1 - NEAR)
    settled = live.filter(~open_)
    live = live.filter(open_)
    while True:
        flown = live.repartition("nth", "block").sortWithinPartitions("nth", "block", F.desc("size"), "draw", "doc_id").mapInArrow(_flown, live.schema)
        flown = stored(flown, "flown")
        settled = settled.unionByName(flown.filter(~open_))
        if flown.filter("blocks > 1").isEmpty():
            break
        # two are left of each block: so many blocks fill one again
        live = flown.filter(open_).withColumns({"block": F.floor(F.col("block") * 2 / block), "blocks": F.ceil(F.col("blocks") * 2 / block)})
    last = flown.filter(open_)

    whole = settled.groupBy("nth").agg(F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("whole") + F.col("p").cast("long"))).alias("taken"))
    rest = last.groupBy("nth").agg(F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("whole"))).alias("more"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("nth").orderBy("size", "draw", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    missing = F.round("target").cast("long") - F.coalesce("taken", F.lit(0)) - F.col("more") - F.col("before")
    cut = last.withColumn("before", before).join(rest, "nth").join(whole, "nth", "left")
    cut = cut.withColumn("part", F.least(F.greatest(missing, F.lit(0).cast("long")), F.col("size"))).drop("before", "more", "taken")
    done = settled.withColumn("part", F.when(F.col("p") > 0.5, F.col("size")).otherwise(F.lit(0).cast("long"))).unionByName(cut)

    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SPREAD).cast("long")))
    each = F.explode(F.sequence(F.col("start"), F.least(F.col("start") + SPREAD, F.col("n")) - 1))
    spread = done.select("*", copies.alias("start")).select("*", each.alias("copy"))
    extra = F.when(F.col("copy") < F.col("whole"), F.col("size")).when(F.col("copy") == F.col("whole"), F.col("part")).otherwise(0)
    return spread.select("doc_id", "size", "source_size", "target", (F.col("base") * F.col("size") + extra).cast("long").alias("taken"))
