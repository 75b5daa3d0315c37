"""Canonical exact digests: equal fingerprints for texts that are the same after folding, and only for those.

A text is folded (Unicode compatibility composition, full case folding, runs of white space to one space) and hashed to
128 bits; within a group of equal hashes the folded texts themselves are compared, and one that differs gets a digest
of its own as an ending.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts


def canonical(text: Column) -> Column:
    """The folded text. ICU, which Spark carries, does the Unicode work; a null counts as empty."""
    compose = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = compose(fold(compose(F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}]+", " "))


def _wide(folded: str, names: tuple[str, str]) -> list[Column]:
    return [F.xxhash64(folded).alias(names[0]), F.xxhash64(F.lit("wide"), folded).alias(names[1])]


def _hex(high: Column, low: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (high, low)))


#: What tells rows apart: two hashes of doc_id and text, 128 bits together. Rows that agree in both are copies.
UNIT = ["u1", "u2"]


def _unit() -> list[Column]:
    missing, doc_id = F.col("doc_id").isNull(), F.col("doc_id")
    return [F.xxhash64(missing, doc_id, F.xxhash64("text")).alias("u1"), F.xxhash64(missing, doc_id, F.xxhash64(F.lit("unit"), "text")).alias("u2")]


def _hashed(docs: DataFrame) -> DataFrame:
    """One row for all copies, with their number: copies of one row meet as counts."""
    rows = texts(docs).select("doc_id", *_unit(), F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("raw"), canonical(F.col("text")).alias("folded"))
    rows = rows.select("doc_id", *UNIT, "raw", "n_chars", *_wide("folded", ("h1", "h2")))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


_ORDER = ["doc_id", "raw", *UNIT]


def _in_order(rows: DataFrame) -> DataFrame:
    """Each row with the rows before and after it; the last is before the first.

    The order is doc_id, then the text's hash. Ranges of both are worked on apart, so rows without an id are dealt out too;
    the ranges' ends, a row for each, meet.
    """
    ranged = stored(rows.repartitionByRange(*_ORDER).withColumn("range", F.spark_partition_id()), "ranges")
    placed = ranged.select("range", F.struct(*_ORDER, "n_chars", "h1", "h2", "copies").alias("me"))
    w = Window.partitionBy("range").orderBy("me")
    ends = placed.groupBy("range").agg(F.min("me").alias("first"), F.max("me").alias("last"))
    ring = Window.partitionBy(F.lit(0)).orderBy("range")
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range",
        F.coalesce(F.lead("first").over(ring), F.first("first").over(every)).alias("after"),
        F.coalesce(F.lag("last").over(ring), F.last("last").over(every)).alias("before"),
    )
    near = placed.select("range", "me", F.lead("me").over(w).alias("next"), F.lag("me").over(w).alias("previous"))
    joined = near.join(F.broadcast(ends), "range")  # a row for each range of the shuffle
    return joined.select("me", F.coalesce("next", "after").alias("next"), F.coalesce("previous", "before").alias("previous"))


def _with_groups(rows: DataFrame) -> DataFrame:
    """in_group: whether another row has the same hash; leads: whether the row is the one its group is held against."""
    groups = rows.groupBy("me.h1", "me.h2").agg(F.count("*").alias("n"), F.min(F.struct("me.u1", "me.u2")).alias("lead"))
    # written, so that the join is of two shuffled tables and a large group of rows can be split
    groups = stored(groups.filter("n > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "lead"), "groups")
    joined = rows.join(groups, (F.col("me.h1") == F.col("g1")) & (F.col("me.h2") == F.col("g2")), "left")
    is_lead = F.col("lead") == F.struct("me.u1", "me.u2")
    return joined.select("me.u1", "me.u2", "me", "next", "previous", F.col("lead").isNotNull().alias("in_group"), F.coalesce(is_lead, F.lit(False)).alias("leads"))


def _edited(docs: DataFrame, order: DataFrame) -> DataFrame:
    """Each row with the folded text's hashes before and after the edit, and the folded text where others hash alike.

    Text is dealt out once, by the row's hashes; of the next document only the part that is put in goes to the row before it.
    Of copies each is followed by the next and only the last by another row: these are two rows, with times telling how often.
    """
    body = texts(docs).select(*_unit(), "text").dropDuplicates(UNIT)
    rows = body.join(order, UNIT)
    moved = rows.select(F.col("previous.u1").alias("u1"), F.col("previous.u2").alias("u2"), F.left("text", (F.col("previous.n_chars") / 4).cast("int")).alias("part"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    follows = lambda times, row, part, ends: F.struct(times.alias("times"), row.alias("next"), part.alias("part"), F.lit(ends).alias("ends"))
    more = F.col("me.copies") - 1
    last = follows(F.lit(1).cast("long"), F.col("next"), F.col("part"), True)
    among = follows(more, F.col("me"), F.left("text", quarter), False)
    every = F.explode_outer(F.when(more > 0, F.array(last, among)).otherwise(F.array(last))).alias("after")
    joined = rows.join(moved, UNIT).select(*UNIT, "text", "me", "in_group", "leads", every)
    edited = F.concat(F.left("text", n - quarter), F.col("after.part"))
    folded = joined.select(*UNIT, "me", "after", "in_group", "leads", edited.alias("edited"), canonical(F.col("text")).alias("folded"))
    folded = folded.select("*", canonical(F.col("edited")).alias("edited_folded"))
    return folded.select(
        *UNIT, "me.doc_id", "me.n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "me.h1", "me.h2", *_wide("edited_folded", ("e1", "e2")), (F.col("folded") == F.col("edited_folded")).alias("same"),
        "after.times", "after.next", "leads", F.when(F.col("in_group") & F.col("after.ends"), F.col("folded")).alias("proof"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of `docs`.

    The edited text has its last quarter replaced by the start of the next document, by ascending doc_id (repeated ids
    by their text's hash, null first; the last is followed by the first). A likeness is 1 for equal folded texts, else 0.
    A null text is empty. A single document follows itself; an empty table gives no rows; other columns are left out.
    No row, however often it is repeated, and no doc_id, missing ones included, gathers its texts in one place.
    """
    rows = stored(_edited(docs, _with_groups(_in_order(_hashed(docs)))), "edited")
    proofs = rows.filter(F.col("proof").isNotNull())
    leads = proofs.filter("leads").select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), F.col("proof").alias("lead"))
    odd = proofs.join(leads, (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2"))).filter(F.col("proof") != F.col("lead"))
    odd = odd.select(*UNIT, F.concat(F.lit("-"), F.sha2(F.encode("proof", "UTF-8"), 256)).alias("ending"))
    others = odd.select(F.col("u1").alias("n1"), F.col("u2").alias("n2"), F.col("ending").alias("next_ending"))
    joined = rows.drop("proof", "leads").join(odd, UNIT, "left")
    joined = joined.join(others, (F.col("next.u1") == F.col("n1")) & (F.col("next.u2") == F.col("n2")), "left")
    fingerprint = F.concat(_hex(F.col("h1"), F.col("h2")), F.coalesce("ending", F.lit("")))
    next_fingerprint = F.concat(_hex(F.col("next.h1"), F.col("next.h2")), F.coalesce("next_ending", F.lit("")))
    plain = _hex(F.col("e1"), F.col("e2"))
    edited = F.when(F.col("same"), fingerprint).when(plain == fingerprint, F.concat(plain, F.lit("-edited"))).otherwise(plain)
    made = joined.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.alias("fingerprint"), edited.alias("edited_fingerprint"),
        F.col("same").cast("double").alias("near_edited"), (fingerprint == next_fingerprint).cast("double").alias("near_next"), "times",
    )
    return made.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("time", "times")
