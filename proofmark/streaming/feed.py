"""Labels checked one by one as they come: the batch job's steps on rows that carry their own lines, a sink that a repeated
batch does not fill twice, and counts that run along."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from proofmark.jobs.verify import outcome_rows, widest_strokes
from proofmark.operators import checks, labels, outcomes
from proofmark.sources.tables import image_signature_ok

#: The column, and folder, of the batch that a row was written with.
BATCH = "batch_id"


def verify_stream(labelled: DataFrame, strokes: DataFrame | None = None) -> DataFrame:
    """For a stream, or table, of applications with an array `lines`: the columns of the batch job. Stateless.

    Lines count as in the batch job: trimmed, blank ones not at all, those without a place last. A row is admitted as there,
    by its brand and its image. With a column `content`, and `length` where the bytes are not all there, that is the image;
    without, a row whose lines are null has no image. `strokes` is a table of stroke widths by filename, joined to each
    batch; where it is left out, columns heading_stroke and body_stroke of the rows count, if there are any.
    """
    rows = labelled
    if strokes is not None:
        held = rows.drop("heading_stroke", "body_stroke").withColumn("key__", F.lower("filename"))
        rows = held.join(widest_strokes(strokes).withColumnRenamed("name_key", "key__"), "key__", "left").drop("key__")
    if "content" in labelled.columns:
        length = F.octet_length("content").cast("long")
        length = F.coalesce(F.col("length").cast("long"), length) if "length" in labelled.columns else length
        rows = rows.withColumns({"length": length, "is_image": image_signature_ok(F.col("content"))}).drop("content")
    else:
        rows = rows.withColumns({"length": F.when(F.col("lines").isNotNull(), F.lit(0)), "is_image": F.lit(True)})
    return outcome_rows(checks.check_warning(labels.label_facts(labels.with_text(rows))))


def _batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """One folder a batch, written as a whole: a batch that runs again, after a stop in the middle, replaces what it had left."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")

    return write


def outcome_sink(checked: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer, to be started, of the stream `checked` to Parquet below `path`, a folder a batch; read it with `written_outcomes`.

    Batches are numbered in `checkpoint`, which belongs to this path alone: a query that is started again goes on where it
    stopped, and what it repeats it writes over. So every row is there once.
    """
    return checked.writeStream.foreachBatch(_batch_writer(path)).option("checkpointLocation", checkpoint)


def written_outcomes(checked: DataFrame, path: str) -> DataFrame:
    """What `outcome_sink` has written of the stream `checked`, with batch_id."""
    schema = checked.schema.add(BATCH, "long")
    return checked.sparkSession.read.schema(schema).parquet(path)


def running_counts(checked: DataFrame) -> DataFrame:
    """bucket and n of the stream `checked` so far: how many outcomes each bucket has, none too, and all.

    For output modes update and complete. The state is one row; each task counts its own rows first.
    """
    return outcomes.bucket_counts(checked)


def progress_sink(checked: DataFrame, total: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer, to be started, that keeps bucket, n, total and batch_id at `path`: the counts after the last batch.

    `total` is the table of all applications that the stream will bring; it is counted anew with each batch.
    """

    def write(counts: DataFrame, batch: int) -> None:
        all_ = total.agg(F.count("*").alias("total"))
        counts.crossJoin(F.broadcast(all_)).withColumn(BATCH, F.lit(batch).cast("long")).coalesce(1).write.mode("overwrite").parquet(path)

    return running_counts(checked).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
