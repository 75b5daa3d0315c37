"""The corpus pipeline: each stage reads what the one before it wrote, and all but the last return the columns of documents."""

from collections.abc import Callable
from functools import partial, wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmark.llm import language, packing, pseudonyms, simhash, suffix_dedup
from proofmark.llm.common import MARK, documents, marks, settled, small_batches, stored, with_mark

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go: null texts, those without a letter, and those that the network rejects, as it holds all
    their windows of 64 bytes or more for none, by a margin over every labelled window it has learned from. Mixed texts stay.

    Where nothing could be learned, only what shows in the text itself counts: all texts with a letter stay.
    """
    net = language.train(docs)
    return language.with_letter(docs) if net is None else language.of_a_language(docs, net)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one of the smallest doc_id stays, and one row of a repeated doc_id.

    Groups are those of op7, by SimHash fingerprints and their index; texts that share 0.8 of their shingles by exact count,
    but whose fingerprints differ in more bits, join them. Only documents in question are moved: a table of bits of bounded
    size tells the others. Rows without doc_id stay.
    """
    known = docs.filter("doc_id is not null")
    groups = stored(simhash.merged_groups(simhash.simhash_components(known), simhash.similar_groups(known)), "groups")
    repeated = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).filter("n > 1")
    either = groups.join(repeated, "doc_id", "full").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n", F.lit(1)).alias("n"))
    doubtful = stored(either.filter("doc_id <> component_id or n > 1"), "doubtful")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("order"))
    marked = with_mark(rows, marks(doubtful))
    asked = marked.filter(MARK).drop(MARK).join(doubtful.select("doc_id", "component_id"), "doc_id", "left")
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("order"))
    kept = asked.filter("component_id is null or doc_id = component_id").withColumn("first", first).filter("first = 1 or doc_id is null")
    return marked.filter(~F.col(MARK)).select("row.*").unionByName(kept.select("row.*"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start at more than one place go from the texts; no document goes. n_chars follows."""
    return suffix_dedup.cut_repeats(docs).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by pseudonyms of their format; n_chars follows."""
    return pseudonyms.pseudonymise(docs, pseudonyms.key_of(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def in_small_batches(stage: Stage) -> Stage:
    """`stage` with Arrow batches of few MB: executors run all stages, and what one of them took outside the heap the next finds taken."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES: list[tuple[str, Stage]] = [
    ("language", in_small_batches(identify_language)),
    ("near_copies", in_small_batches(drop_near_copies)),
    ("repeats", in_small_batches(drop_repeats)),
    ("personal_data", in_small_batches(hide_personal_data)),
    ("packing", in_small_batches(pack_sequences)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in turn over the documents, each result but the last written and read again; what a stage wrote on the way goes
    when its result is there. That of the stages themselves stays, so a run that broke off can be looked into."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
