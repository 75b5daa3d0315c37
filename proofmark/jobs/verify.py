"""Whole jobs: checking many labels, auditing warnings, reports, evaluation and triage."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmark.operators import checks, labels, outcomes
from proofmark.sources.tables import admit, image_signature_ok

RESULTS = ("verdict", "summary", "fields", "extracted_text", "ocr_confidence")


def widest_strokes(strokes: DataFrame) -> DataFrame:
    """name_key, heading_stroke and body_stroke: of repeated rows the one with the widest heading."""
    one = strokes.groupBy(F.lower("filename").alias("name_key")).agg(F.max(F.struct("heading_stroke", "body_stroke")).alias("widths"))
    return one.select("name_key", "widths.heading_stroke", "widths.body_stroke")


def label_table(label_lines: DataFrame, strokes: DataFrame | None = None) -> DataFrame:
    """One row a label with all that does not depend on an application, worked out once however many there are.

    Of repeated rows of stroke widths the one with the widest heading counts.
    """
    rows = labels.assemble_labels(label_lines)
    if strokes is not None:
        rows = rows.join(widest_strokes(strokes), "name_key", "left")
    return checks.check_warning(labels.label_facts(rows))


def outcome_rows(rows: DataFrame) -> DataFrame:
    """All columns of an outcome for rows with an application, a label's facts, and its image's length and is_image.

    A row that is not admitted has its message and no result. No shuffle.
    """
    checked = outcomes.roll_up(checks.check_fields(admit(rows))).withColumn("ocr_confidence", F.round("confidence", 3))
    checked = checked.withColumnRenamed("error_message", "message")
    state = F.when(F.col("message").isNotNull(), "error").otherwise("done")
    results = (F.when(F.col("message").isNull(), F.col(c)).alias(c) for c in RESULTS)
    done = checked.select("app_id", "filename", "brand_name", *results, state.alias("state"), "message")
    row = F.struct("*", outcomes.bucket(F.col("verdict"), F.col("state")).alias("bucket"))
    # of one row each; but a filter by bucket or verdict stays above it, where pushed down it would work all fields out again
    return done.select(F.explode_outer(F.array(row)).alias("o")).select("o.*")


def verify_batch(apps: DataFrame, label_lines: DataFrame, strokes: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """The outcome of every application: verdict, summary, fields, extracted_text, ocr_confidence, state, message, bucket.

    The lines are shuffled once, by label; then the applications go to the labels. With `images` (name_key, length, content,
    and modificationTime and path where files may share a name: the last one counts) rows are first admitted by their image;
    without, an application of a label without lines has no image. A label whose lines have an error could not be read: its
    applications get the message of a file that is no image.
    """
    facts = label_table(label_lines, strokes).withColumn("known__", F.lit(True))
    joined = apps.withColumn("name_key", F.lower("filename")).join(facts, "name_key", "left")
    if images is None:
        joined = joined.withColumns({"length": F.when(F.col("known__"), F.lit(0)), "is_image": F.col("read_error").isNull()})
    else:
        order = [c for c in ("modificationTime", "path") if c in images.columns]
        about = labels.latest_image(images.select("name_key", *order, "length", image_signature_ok(F.col("content")).alias("is_image")))
        joined = joined.join(about.drop(*order), "name_key", "left").withColumns(_blank_label(joined))
        joined = joined.withColumn("is_image", F.col("is_image") & F.col("read_error").isNull())
    return outcome_rows(joined)


def _blank_label(rows: DataFrame) -> dict:
    """What an image without any line counts as."""
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    missing = F.array(checks.field("warning_wording", "not_found", F.lit(checks.STATEMENT), F.lit(None), "No government warning statement found on the label."))
    return {
        **{c: F.coalesce(F.col(c), F.lit("")) for c in ("raw", "squashed", "open")},
        **{c: empty(c) for c in ("places", "alcohol_values", "proof_values", "volumes", "extracted_text")},
        "characters": F.coalesce("characters", F.lit(0)),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "warning_fields": F.coalesce("warning_fields", missing),
    }


def audit_warnings(label_lines: DataFrame, strokes: DataFrame | None = None) -> DataFrame:
    """name_key, key, status, found and note of the warning's fields of every label."""
    facts = label_table(label_lines, strokes).select("name_key", F.col("warning_fields").alias("fields"))
    # outer, though none is empty: for an inner one the optimizer asks for the array's size further down, and works it out anew for that
    return facts.select("name_key", F.explode_outer("fields").alias("f")).select("name_key", "f.key", "f.status", "f.found", "f.note")


def heading_shares(label_lines: DataFrame) -> DataFrame:
    """For whoever measures stroke widths: name_key and share, how far into its line the warning's heading reaches (null: no
    line holds it)."""
    rows = labels.assemble_labels(label_lines)
    return rows.select("name_key", labels.heading_boundary(F.col("extracted_text")).alias("share"))


def field_results(done: DataFrame) -> DataFrame:
    """One row for each field of each outcome, in display order: app_id, nth (from 1) and the field's columns."""
    each = done.select("app_id", F.posexplode_outer("fields").alias("at", "f")).filter("f is not null")
    return each.select("app_id", (F.col("at") + 1).alias("nth"), "f.*")


def report(done: DataFrame) -> DataFrame:
    """filename, brand_name, result, summary, details of outcomes."""
    failed = F.col("state") == "error"
    return done.select(
        "filename", "brand_name", F.when(failed, "Not checked").otherwise(outcomes.shown(F.col("verdict"))).alias("result"),
        F.when(failed, F.col("message")).otherwise(F.col("summary")).alias("summary"),
        F.coalesce(outcomes.details_text(F.col("fields")), F.lit("")).alias("details"),
    )


def evaluate(done: DataFrame, manifest: DataFrame) -> DataFrame:
    """How often each pair of expected and given verdict occurs."""
    return outcomes.confusion(outcomes.score_against_expected(done, manifest))


def accuracy(done: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: labels, how many agree with the manifest, their share, and whether all do."""
    return outcomes.accuracy(outcomes.score_against_expected(done, manifest))


def triage(done: DataFrame, bucket: str = "all") -> DataFrame:
    """The outcomes of a bucket with their fields, the worst first."""
    return outcomes.filter_bucket(done, bucket).withColumn("fields", checks.problems_first(F.col("fields")))
