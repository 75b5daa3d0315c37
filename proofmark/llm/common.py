"""What the operators share: the shared folder, and the two columns they read of a table."""

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all run on
    this machine, else ValueError: on a cluster each would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of the tables written since `settled` began, if it runs.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read again: lineage ends here, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """The table at `path` is deleted, in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What `make` makes, stored; the tables that were stored on the way, which only it reads, are removed."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        made = make()
    finally:
        _written.reset(token)
    result = stored(made, label)
    for path in paths:
        removed(spark, path)
    return result


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so other columns, whatever their names, neither clash nor travel; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of the table that tells which documents may have work left: at least, at most (128 MB), and for each row asked for.
SLOTS, MOST_SLOTS, PER_ROW = 1 << 23, 1 << 30, 16
MARK = "marked__"


def slots_for(rows: int) -> int:
    """The power of two that gives each row PER_ROW bits, so about one document in 16 is marked in vain; within the bounds."""
    return min(MOST_SLOTS, max(SLOTS, 1 << (PER_ROW * rows - 1).bit_length()))


@dataclass
class Marks:
    """A table of 4 kB strings of bits, and how many bits there are."""

    table: DataFrame
    slots: int

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(self.slots))


def marks(ids: DataFrame) -> Marks:
    """A bit for each slot that a doc_id of `ids` falls in; `ids` is a written table, which is counted first. Beyond 67
    million rows the bits for each get fewer, and at last all documents are marked: that costs moves and no result."""
    found = Marks(ids, slots_for(ids.count()))
    slots = ids.select(found.slot().alias("slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits__"))
    return Marks(bits, found.slots)


def with_mark(docs: DataFrame, marked: Marks) -> DataFrame:
    """`docs` with MARK: false only where the doc_id is not among those of the marks. No shuffle of `docs`."""
    bit = F.bitmap_bit_position(marked.slot())
    byte = F.conv(F.hex(F.substring("bits__", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0
    joined = docs.withColumn("bucket__", F.bitmap_bucket_number(marked.slot())).join(F.broadcast(marked.table), "bucket__", "left")
    return joined.withColumn(MARK, F.coalesce(hit, F.lit(False))).drop("bucket__", "bits__")


#: Bytes of column data, about, at which an Arrow batch ends.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end at BATCH_BYTES, or before if the session says so; a single row may be more.

    A task's JVM holds a batch twice on its way to the worker and once on its way back, outside the heap, and the worker
    makes its objects of it. At Spark's 64 MB, and with it 10,000 rows, that is several times what one core needs.
    """
    now = spark.conf.get(_BATCH_LIMIT, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_LIMIT, f"{BATCH_BYTES}b")


Batches = Iterator[pa.RecordBatch]
#: Parts that are merged at once, in a task or at last on the driver.
FAN = 32


def merged(parts: DataFrame, merge: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """What `merge` makes of all values of the binary column `part`, or None if there is none.

    Parts are of one size each, a few a task, and meet in a tree: tasks merge about 32 at a time, and the driver the last 32.
    """

    def run(batches: Batches) -> Batches:
        total = None
        for batch in batches:
            for part in batch.column("part").to_pylist():
                total = part if total is None else merge(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.binary())], names=["part"])

    parts = stored(parts.select("part"), "parts")
    while (n := parts.count()) > FAN:
        parts = stored(parts.repartition(-(-n // FAN)).mapInArrow(run, "part binary"), "parts")
    total = None
    for row in parts.collect():
        total = bytes(row["part"]) if total is None else merge(total, bytes(row["part"]))
    return total


#: Rows that a task turns into Python objects at once.
SLICE = 2000


def sliced(batches: Batches) -> Batches:
    """The same rows in batches of a few thousand."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), SLICE):
            yield batch.slice(at, SLICE)


def release() -> None:
    """Hands memory that a finished task held back to the system: workers live on, and the next stage needs it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`run`, with `release` at the end of the task."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
