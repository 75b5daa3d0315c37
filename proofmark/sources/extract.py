"""Lines from images by a reader that the user brings."""

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import LABEL_LINES

#: A reader takes an image's bytes and gives its lines: (text, confidence, four corners as (x, y)).
Reader = Callable[[bytes], list[tuple[str, float, list[tuple[float, float]]]]]
#: `LABEL_LINES`, and why an image could not be read.
READ_LINES = T.StructType([*LABEL_LINES.fields, T.StructField("error", T.StringType())])
#: Readers that a worker keeps from one task to the next, the last ones used: an engine takes long to load.
MOST_READERS = 4
#: Lines that a task holds before it hands them on, and those of one more image.
HELD_LINES = 4096
_readers: dict[str, Reader] = {}


def _reader(name: str, make_reader: Callable[[], Reader]) -> Reader:
    found = _readers.pop(name, None) or make_reader()
    _readers[name] = found
    while len(_readers) > MOST_READERS:
        _readers.pop(next(iter(_readers)))
    return found


def _read(read: Reader, name: str, content: bytes | None) -> list[tuple]:
    if content is None:
        return []
    try:
        return [(name, k, text, float(confidence), [{"x": float(x), "y": float(y)} for x, y in box], None) for k, (text, confidence, box) in enumerate(read(bytes(content)))]
    except Exception as e:  # noqa: BLE001  whatever a reader makes of a broken image, the others are to be read
        return [(name, None, None, None, None, f"{type(e).__name__}: {e}")]


def _handed_on(read: Reader, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of all images, in batches of HELD_LINES and at most one more image's."""
    schema = to_arrow_schema(READ_LINES)
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for file, content in zip(batch.column("filename"), batch.column("content"), strict=True):
            rows += _read(read, file.as_py(), content.as_py())
            if len(rows) >= HELD_LINES:
                yield made()
                rows = []
    if rows:
        yield made()


def extract_lines(images: DataFrame, make_reader: Callable[[], Reader], partitions: int | None = None) -> DataFrame:
    """`label_lines` of a table with filename and content, and the column error.

    A worker makes the reader once and keeps it for its further tasks. An image that the reader fails on has one row, without
    text, with the error: `verify_batch` gives its applications the message of a file that is no image. A null content has no
    rows. Reading takes seconds an image, so the images are dealt out over `partitions` tasks first. A task hands lines on as they
    come, so it holds a few thousand however many rows a batch of images makes.
    """
    maker = cloudpickle.dumps(make_reader)
    name = hashlib.sha256(maker).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _handed_on(_reader(name, lambda: cloudpickle.loads(maker)()), batches)

    dealt = images.select("filename", "content")
    return (dealt.repartition(partitions) if partitions else dealt).mapInArrow(run, READ_LINES)


def unread_images(lines: DataFrame) -> DataFrame:
    """filename and error of the images that `extract_lines` could not read."""
    return lines.filter(F.col("error").isNotNull()).select("filename", "error")
