"""CSV files with line breaks inside quotes, read by as many tasks as plain text would be.

Whether a line begins inside quotes depends on all lines before it, but a line only turns one of two states into one of two
states. So each split tells where it would end from either state, the splits of a file are strung together from these, and
a second pass, which knows where each split begins, puts lines together to records.
"""

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
#: A field in quotes that ends on the line, at the start of a field; quotes elsewhere are characters like others.
_CLOSED = re.compile(r'(?:^|(?<=,))"(?:[^"]|"")*"(?!")')
_OPEN = re.compile(r'(?:^|,)"')
_REST = re.compile(r'(?:[^"]|"")*"(?!")')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of the line is inside quotes, if its start is or is not."""
    if '"' not in line:
        return inside
    if inside:
        closed = _REST.match(line)
        if closed is None:
            return True
        line = "x" + line[closed.end() :]
    return _OPEN.search(_CLOSED.sub("x", line)) is not None


ENDS = pa.schema([("file", pa.string()), ("split", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_())])
PIECES = pa.schema([("file", pa.string()), ("split", pa.int64()), ("nth", pa.int64()), ("kind", pa.int64()), ("record", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _ends(batches: Batches) -> Batches:
    """file, split, from_outside, from_inside: the state at the end of each split, from either state at its start."""
    done, key, state = [], None, (False, True)
    for batch in batches:
        for file, split, line in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value")), strict=True):
            if (file, split) != key:
                if key is not None:
                    done.append((*key, *state))
                key, state = (file, split), (False, True)
            if '"' in line:
                state = ends_inside(line, state[0]), ends_inside(line, state[1])
    if key is not None:
        done.append((*key, *state))
    if done:
        yield _batch(done, ENDS)


#: What a piece of a record is: all of it, or its start, a whole split of its middle, or its end.
WHOLE, START, MIDDLE, END = 0, 1, 2, 3


def _pieces(batches: Batches) -> Batches:
    """file, split, nth, kind, record: records, and what begins or ends beyond the split."""
    key, nth, held, inside, headless = None, 0, [], False, False

    def rest() -> list[tuple]:
        if not held:
            return []
        kind = (MIDDLE if inside else END) if headless else (START if inside else WHOLE)
        return [(*key, nth, kind, "\n".join(held))]

    for batch in batches:
        out: list[tuple] = []
        for file, split, begins, line in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "begins_inside", "value")), strict=True):
            if (file, split) != key:
                out += rest()
                key, nth, held, inside, headless = (file, split), 0, [], begins, begins
            elif held and not inside:
                out.append((*key, nth, END if headless else WHOLE, "\n".join(held)))
                nth, held, headless = nth + 1, [], False
            held.append(line)
            inside = ends_inside(line, inside)
        if out:
            yield _batch(out, PIECES)
    if last := rest():
        yield _batch(last, PIECES)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, split, nth and record of every record of the files below `path`: in a file they go by split, then by nth.

    Each split is read twice; its state is a row, and these rows, one a split, are broadcast. Only pieces of records that
    cross a split are moved. Quotes that never close take the rest of their file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    ends = lines.mapInArrow(_ends, "file string, split long, from_outside boolean, from_inside boolean")
    by = W.partitionBy("file").orderBy("split")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    # a split ends in one state wherever it begins, or it keeps the state, or it swaps the two
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    turns = ends.withColumn("fixed", fixed).withColumn("swaps", (F.col("fixed").isNull() & F.col("from_outside")).cast("int"))
    turns = turns.withColumns({"last": F.last("fixed", ignorenulls=True).over(before), "era": F.coalesce(F.count("fixed").over(before), F.lit(0)), "swapped": F.sum("swaps").over(before)})
    first = F.min("swapped").over(W.partitionBy("file", "era"))
    odd = F.coalesce((F.col("swapped") - F.coalesce(first, F.lit(0))) % 2 == 1, F.lit(False))
    starts = turns.select("file", "split", (F.coalesce("last", F.lit(False)) != odd).alias("begins_inside"))
    known = lines.join(F.broadcast(starts), ["file", "split"]).select("file", "split", "begins_inside", "value")
    pieces = known.mapInArrow(_pieces, "file string, split long, nth long, kind long, record string")
    parts = pieces.filter(F.col("kind") != WHOLE)
    owner = F.count_if(F.col("kind") == START).over(W.partitionBy("file").orderBy("split", "nth"))
    parts = parts.withColumn("owner", owner).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("split", "nth", "record"))).alias("parts"))
    joined = parts.select("file", F.get("parts", 0)["split"].alias("split"), F.get("parts", 0)["nth"].alias("nth"), F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return pieces.filter(F.col("kind") == WHOLE).select("file", "split", "nth", "record").unionByName(joined)


def _heads(records: DataFrame) -> Column:
    return (F.col("split") == 0) & (F.col("nth") == 0)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with one header, all columns strings; empty lines are none. Of columns of one name (whatever its
    case, without the white space about it) the first has it, further ones get a number.

    ValueError if there is no header, or files have different ones.
    """
    records = csv_records(spark, path)
    heads = [r["record"].removeprefix("\ufeff") for r in records.filter(_heads(records)).select("record").distinct().limit(2).collect()]
    if not heads or not heads[0].strip():
        raise ValueError("The file has no header.")
    if len({h.removeprefix("\ufeff") for h in heads}) > 1:
        raise ValueError("The files have different headers.")
    names: list[str] = []
    taken: set[str] = set()
    for name in next(csv.reader([heads[0]])):
        given, n = name, 1
        while given.strip().lower() in taken:
            n += 1
            given = f"{name.strip()}_{n}"
        taken.add(given.strip().lower())
        names.append(given)
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    row = F.from_csv("record", F.lit(schema), {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    rows = records.filter(~_heads(records) & (F.col("record") != "")).select(row.alias("r"))
    return rows.select(*(F.col(f"r.c{k}").alias(name) for k, name in enumerate(names)))
