"""From fields to verdicts, buckets, counts and words."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.functions.constants import BUCKETS, PASS_SUMMARY, SHOWN, SHOWN_STATUS, UNREADABLE_SUMMARY

from .checks import FIELD, display_order
from .labels import is_readable


def problem_count(fields: Column) -> Column:
    return F.size(F.filter(fields, lambda f: f["status"].isin("mismatch", "not_found")))


def review_count(fields: Column) -> Column:
    return F.size(F.filter(fields, lambda f: f["status"] == "review"))


def status_counts(field_results: DataFrame) -> DataFrame:
    """problems and reviews of each application, from one row a field."""
    return field_results.groupBy("app_id").agg(F.count_if(F.col("status").isin("mismatch", "not_found")).alias("problems"), F.count_if(F.col("status") == "review").alias("reviews"))


def verdict(problems: Column, reviews: Column, readable: Column) -> Column:
    return F.when(~readable, "unreadable").when(problems > 0, "fail").when(reviews > 0, "review").otherwise("pass")


def summary(problems: Column, reviews: Column, readable: Column) -> Column:
    many = lambda n: F.when(n == 1, "").otherwise("s")
    return (
        F.when(~readable, UNREADABLE_SUMMARY)
        .when(problems > 0, F.concat(problems.cast("string"), F.lit(" problem"), many(problems), F.lit(" found.")))
        .when(reviews > 0, F.concat(reviews.cast("string"), F.lit(" item"), many(reviews), F.lit(" to check by eye.")))
        .otherwise(PASS_SUMMARY)
    )


def roll_up(rows: DataFrame) -> DataFrame:
    """verdict and summary of rows with fields, characters and confidence."""
    readable = is_readable(F.col("characters"), F.col("confidence"))
    counted = rows.withColumns({"problems": problem_count(F.col("fields")), "reviews": review_count(F.col("fields"))})
    args = (F.col("problems"), F.col("reviews"), readable)
    return counted.withColumns({"verdict": verdict(*args), "summary": summary(*args)}).drop("problems", "reviews")


def build_results(field_results: DataFrame) -> DataFrame:
    """One row an application with its fields in display order, from one row a field."""
    one = F.struct("key", "title", "status", "expected", "found", "note").cast(FIELD)
    return field_results.groupBy("app_id").agg(F.collect_list(one).alias("fields")).withColumn("fields", display_order(F.col("fields")))


def bucket(verdict_: Column, state: Column) -> Column:
    """Where an outcome is sorted in: errors and unreadable labels with the failures."""
    return F.when((state == "error") | (verdict_ == "unreadable"), "fail").otherwise(verdict_)


def filter_bucket(outcomes: DataFrame, name: str) -> DataFrame:
    return outcomes if name == "all" else outcomes.filter(F.col("bucket") == name)


def bucket_counts(outcomes: DataFrame) -> DataFrame:
    """How many outcomes each bucket has, none too, and all."""
    counts = [F.struct(F.lit(b).alias("bucket"), F.count_if(F.col("bucket") == b).alias("n")) for b in BUCKETS]
    total = F.struct(F.lit("all").alias("bucket"), F.count("*").alias("n"))
    return outcomes.groupBy().agg(F.array(*counts, total).alias("counts")).select(F.inline("counts"))


def attention_fields(fields: Column) -> Column:
    return F.filter(fields, lambda f: f["status"] != "match")


def details_text(fields: Column) -> Column:
    """Title and note of each field that is no match."""
    return F.array_join(F.transform(attention_fields(fields), lambda f: F.concat(f["title"], F.lit(": "), f["note"])), " | ")


def shown(code: Column) -> Column:
    """The words for a verdict."""
    return F.create_map(*(F.lit(x) for pair in SHOWN.items() for x in pair))[code]


def shown_status(code: Column) -> Column:
    """The words for a field's status."""
    return F.create_map(*(F.lit(x) for pair in SHOWN_STATUS.items() for x in pair))[code]


def all_outcomes(done: DataFrame, errors: DataFrame) -> DataFrame:
    """Checked and rejected rows in one table, each with its state and bucket."""
    both = done.withColumn("state", F.lit("done")).unionByName(errors.withColumn("state", F.lit("error")), allowMissingColumns=True)
    return both.withColumn("bucket", bucket(F.col("verdict"), F.col("state")))


def score_against_expected(outcomes: DataFrame, manifest: DataFrame) -> DataFrame:
    """filename, expected_verdict, verdict and whether they agree."""
    wanted = manifest.select(F.lower("filename").alias("key__"), "expected_verdict")
    joined = outcomes.withColumn("key__", F.lower("filename")).join(wanted, "key__")
    return joined.select("filename", "expected_verdict", "verdict", F.coalesce(F.col("verdict") == F.col("expected_verdict"), F.lit(False)).alias("agrees"))


def confusion(scored: DataFrame) -> DataFrame:
    """How often each pair of expected and given verdict occurs."""
    return scored.groupBy("expected_verdict", "verdict").agg(F.count("*").alias("n"))


def accuracy(scored: DataFrame) -> DataFrame:
    """labels, agreeing, accuracy (null without labels) and all_agree, in one row."""
    counted = scored.groupBy().agg(F.count("*").alias("labels"), F.count_if("agrees").alias("agreeing"))
    return counted.select("labels", "agreeing", F.try_divide("agreeing", "labels").alias("accuracy"), (F.col("labels") == F.col("agreeing")).alias("all_agree"))
