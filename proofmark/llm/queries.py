"""The queries that apply each operator, with its production parameters, to a whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import codes, fingerprints, language, mixing, packing, pseudonyms, sharding, simhash, suffix_dedup, token_counts, topk, whitening, word_codec
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), [1.0] * 24)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised_texts(documents(spark, sf_dir), pseudonyms.key_of(spark))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op6_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op9_word_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_codec.encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.train(docs))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_best_fit_packing, op3_rendezvous_shards, op4_pseudonyms, op5_fingerprints,
        op6_segment_top_k, op7_simhash, op8_suffix_dedup, op9_word_codec, op10_language,
        op11_whitening, op12_vector_codes, op13_mixture,
    )
}

_DISTANCE = "({0}.a - {1}.a) ** 2 + ({0}.b - {1}.b) ** 2 + ({0}.c - {1}.c) ** 2 + ({0}.d - {1}.d) ** 2"


def _assigned_sql(book: str) -> str:
    """The parts with the entry of `book` that is nearest, and how near it is."""
    return f"""
        select vec_id, label, p, any_value(q.a) as a, any_value(q.b) as b, any_value(q.c) as c, any_value(q.d) as d,
            min(cast({_DISTANCE.format("q", "k")} as bigint) * 64 + e) as best
        from parts q join {book} k using (p) group by vec_id, label, p
    """


def _learned_sql(assigned: str, book: str) -> str:
    means = ", ".join(f"coalesce(cast(floor(m.{c} / m.n) as bigint), k.{c}) as {c}" for c in "abcd")
    sums = ", ".join(f"sum({c}) as {c}" for c in "abcd")
    return f"select p, e, {means} from {book} k left join (select p, best % 64 as e, count(*) as n, {sums} from {assigned} group by all) m using (p, e)"


_CODES_SQL = f"""
    with kept as (
        select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), parts as (
        select vec_id, label, p, v[4 * p + 1] as a, v[4 * p + 2] as b, v[4 * p + 3] as c, v[4 * p + 4] as d from kept, range(16) t(p)
    ), book0 as (
        select p, e, a, b, c, d from (select *, row_number() over (partition by p order by vec_id) - 1 as e from parts) where e < 64
    ), first as materialized ({_assigned_sql("book0")}), book1 as ({_learned_sql("first", "book0")}),
    second as materialized ({_assigned_sql("book1")}), book2 as ({_learned_sql("second", "book1")}),
    last as materialized ({_assigned_sql("book2")}), done as (
        select vec_id, label, string_agg(format('{{:02x}}', best % 64), '' order by p) as code, cast(sum(best // 64) as bigint) as error
        from last group by vec_id, label
    ), digest as (
        select sha256(string_agg(concat_ws(',', a, b, c, d), ',' order by p, e)) as codebooks_sha256 from book2
    )
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from done, digest
"""

ORACLE_SQL: dict[str, str] = {
    "op6_segment_top_k": """
        with vectors as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scores as (
            select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
            from vectors q join vectors c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from scores qualify rank <= 20
    """,
    "op8_suffix_dedup": """
        with docs as (
            select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents
        ), blocks as (  -- of 2000 starts, so that no long text is cut from its beginning again and again
            select r, b, substr(h, cast(4000 * b + 1 as bigint), 4398) as h from (select r, h, unnest(range(0, length(h) // 4000 + 1)) as b from docs)
        ), starts as (
            select r, 2000 * b + q as p, md5_number(substr(h, cast(2 * q + 1 as bigint), 400)) as name
            from (select r, b, h, unnest(range(0, length(h) // 2 - 199)) as q from blocks where length(h) >= 400)
        ), repeated as (
            select r, p from starts join (select name from starts group by name having count(*) > 1) using (name)
        ), marked as (
            select r, p, coalesce(p > lag(p) over (partition by r order by p) + 200, true) as begins from repeated
        ), spans as (
            select r, min(p) as a, max(p) + 200 as b from (select r, p, count_if(begins) over (partition by r order by p) as nth from marked) group by r, nth
        ), pieces as (
            select r, coalesce(lag(b) over (partition by r order by a), 0) as a, a as b from spans
            union all select r, coalesce(max(b), 0), max(length(h) // 2) from docs left join spans using (r) group by r
        ), kept as (
            select r, string_agg(substr(h, cast(2 * a + 1 as bigint), cast(2 * (b - a) as bigint)), '' order by a) as h from pieces join docs using (r) group by r
        )
        select doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast(length(d.h) // 2 - length(k.h) // 2 as bigint) as n_removed,
            coalesce(n, 0) as n_spans, sha256(unhex(k.h)) as kept_sha256
        from docs d join kept k using (r) left join (select r, cast(count(*) as bigint) as n from spans group by r) using (r)
    """,
    "op12_vector_codes": _CODES_SQL,
}
