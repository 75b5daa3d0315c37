"""Weighted rendezvous hashing of record keys over shards.

Every shard draws a number from the key and its own index, and the least draw, weighed, takes the record. A further
shard changes no draw of the others, so it takes only the records where its own is the least.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A record's size beyond its text, in bytes.
OVERHEAD = 8
#: Parts of each shard in which places are numbered apart, so that no task holds a whole shard.
PARTS = 1024


def _draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential variable of rate `weight`, and the shard."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.struct((-F.log(unit) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that takes `key`; shares are in proportion to the weights, which have to be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    draws = [_draw(key, k, w) for k, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard(docs: DataFrame, weights: Sequence[float], grown: float = 1.0, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of `docs`.

    The key is doc_id: it and the weights alone decide the shard; rows that repeat a doc_id, or have none, share one.
    `grown_shard` is the shard with one more of weight `grown`. A null text has no bytes, so size 8 and the checksum of
    nothing. `slot` numbers a shard's rows from 0 without gaps. An empty table gives no rows; other columns are left out.

    Slots need no task with a whole shard: rows are dealt to 1024 parts of a shard by a number of their own, so that rows
    of one key or of none spread too, and each part begins where the counts of those before it end. The numbers are
    written with the rows (28 bytes each, no text), which every later step reads. The table of counts has at most shards x
    parts rows.
    """
    doc_id = F.col("doc_id").cast("long")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "records")
    rows = rows.withColumn("shard", rendezvous(F.col("doc_id"), weights)).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    rows = rows.withColumn("grown_shard", rendezvous(F.col("doc_id"), [*weights, grown]))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return (
        rows.withColumn("within", within)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("within") - 1).alias("slot"), "grown_shard")
    )
