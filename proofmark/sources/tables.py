"""Reading applications, labels and images, and writing reports and results."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmark.functions.constants import APPLICATION_FIELDS, MAX_IMAGE_BYTES
from proofmark.functions.text import strip

from .records import read_csv

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LABEL_LINES = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("box", T.ArrayType(POINT)),
    ]
)
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("filename", *APPLICATION_FIELDS, "expected_verdict", "description")])


def shape_applications(raw: DataFrame) -> DataFrame:
    """app_id, filename and the six fields of a table with headers as they come.

    Headers are trimmed and lower-cased, values trimmed; columns that are not there are empty, others are ignored. Rows
    without a file name go. Of columns of one name the first counts. ValueError if filename or brand_name is no column.
    """
    named = {c.strip().lower(): c for c in reversed(raw.columns)}
    for needed in ("filename", "brand_name"):
        if needed not in named:
            raise ValueError(f"The file needs a {needed} column.")
    value = lambda c: strip(F.coalesce(F.col(f"`{named[c]}`"), F.lit(""))) if c in named else F.lit("")
    rows = raw.select(*(value(c).alias(c) for c in ("filename", *APPLICATION_FIELDS))).filter("filename <> ''")
    return rows.select(F.monotonically_increasing_id().alias("app_id"), "*")


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    """The applications of CSV files with a header; ValueError if no row is left. Large files are read by many tasks, also
    where values have line breaks."""
    rows = shape_applications(read_csv(spark, path))
    if rows.isEmpty():
        raise ValueError("The file has no rows with a file name.")
    return rows


def shape_manifest(raw: DataFrame) -> DataFrame:
    """Applications with the verdict that each should get and a description; values as they are, missing ones empty."""
    more = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("filename", *APPLICATION_FIELDS, "expected_verdict", "description")]
    return raw.select(F.monotonically_increasing_id().alias("app_id"), *more)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """`shape_manifest` of a CSV file with exact headers."""
    return shape_manifest(read_csv(spark, path))


def name_key(path: Column) -> Column:
    """The lower-cased last part of a path."""
    return F.lower(F.element_at(F.split(path, "/"), -1))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """filename, name_key, length, content, modificationTime and path of every file below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), name_key(F.col("path")).alias("name_key"), "length", "content", "modificationTime", "path")


def shape_label_lines(lines: DataFrame) -> DataFrame:
    """Lines with trimmed text; blank ones are none, before anything is counted. What tells of an image that could not be read
    stays."""
    kept = "text <> '' or error is not null" if "error" in lines.columns else "text <> ''"
    return lines.withColumn("text", strip(F.col("text"))).filter(kept)


def read_label_lines(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return shape_label_lines(spark.read.format(kind).schema(LABEL_LINES).load(path))


#: Rows that a file has at the most.
FILE_ROWS = 1_000_000


def _folder(path: str, batch: str | None) -> str:
    if batch is not None and not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError("a batch is named by letters, digits, points and dashes")
    return path if batch is None else f"{path}/batch={batch}"


def write_report(report: DataFrame, path: str, batch: str | None = None) -> None:
    """A report as CSV files with headers. With `batch` it is a folder of `path` that is written anew as a whole."""
    mode = "errorifexists" if batch is None else "overwrite"
    report.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).csv(_folder(path, batch), header=True, quote='"', escape='"')


def write_results(results: DataFrame, path: str, kind: str = "parquet", batch: str | None = None, file_rows: int = FILE_ROWS) -> None:
    """Results or outcomes as files, in folders by bucket where they have one, so that a bucket is read without the others.

    With `batch`, a day say, they go to a folder of it: writing a batch again replaces that batch, all its buckets, also
    those that have no rows any more, and no other. Rows are dealt anew so that a bucket's files are of a size, however many
    tasks there are and however large one bucket is.
    """
    mode = "errorifexists" if batch is None else "overwrite"
    rows = results.hint("rebalance", "bucket") if "bucket" in results.columns else results
    writer = rows.write.mode(mode).format(kind).option("maxRecordsPerFile", file_rows)
    (writer.partitionBy("bucket") if "bucket" in results.columns else writer).save(_folder(path, batch))


def read_results(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """What `write_results` has written below `path` of rows of this schema, and of which batch, if there are any."""
    return spark.read.schema(T.StructType([*(f for f in schema if f.name != "batch"), T.StructField("batch", T.StringType())])).format(kind).load(path)


def image_signature_ok(content: Column) -> Column:
    """Whether bytes begin as PNG, JPEG, GIF, BMP, TIFF or WebP do."""
    start = F.hex(F.substring(content, 1, 12))
    # The first bytes of the formats.
    return F.coalesce(start.rlike("^(89504E470D0A1A0A|FFD8FF|47494638|424D|49492A00|4D4D002A|52494646.{8}57454250)"), F.lit(False))


def admit(apps: DataFrame) -> DataFrame:
    """error_message for rows with brand_name, length (null: no image) and is_image: the first that applies, or null."""
    message = (
        F.when(F.col("length").isNull(), "No image was chosen with this file name.")
        .when(strip(F.coalesce("brand_name", F.lit(""))) == "", "Enter the brand name from the application.")
        .when(F.col("length") > MAX_IMAGE_BYTES, "This image is too large. The limit is 15 MB.")
        .when(~F.coalesce("is_image", F.lit(False)), "This file could not be opened as an image. Use a JPG or PNG of the label.")
    )
    return apps.withColumn("error_message", message)
