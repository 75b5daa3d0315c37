"""From OCR lines to one row a label: reading order, text, readability, and all that needs no application."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.functions import quantities as Q
from proofmark.functions import text as T
from proofmark.functions.constants import MIN_CHARACTERS, MIN_CONFIDENCE, SAME_ROW

#: Lines that are numbered together.
BLOCK = 128


def shaped(lines: Column) -> Column:
    """An array of line structs, `measured`, with trimmed text; blank ones and nulls are none, and no array is an empty one."""
    trimmed = F.transform(F.coalesce(lines, F.array()), lambda v: measured(lambda c: T.strip(v[c]) if c == "text" else v[c], box=False))
    return F.filter(trimmed, lambda v: v["text"] != "")


def has_place(box: Column) -> Column:
    """Whether a box has its four corners, each with finite x and y; never null."""
    known = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce((F.size(box) >= 4) & F.forall(box, lambda p: p.isNotNull() & known(p["x"]) & known(p["y"])), F.lit(False))


def measured(line: Callable[[str], Column], box: bool = True) -> Column:
    """A struct of a line's line_no, text, confidence and, if asked for, box, and of what its place is told by: placed, angle,
    height, and the mean x and y of its corners. Boxes of four corners, as nearly all are, need no function over arrays."""
    corners = [F.get(line("box"), k) for k in range(4)]
    known = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    four = F.size(line("box")) == 4
    plain = reduce(lambda a, b: a & b, (known(c[axis]) for c in corners for axis in ("x", "y")))
    mean = lambda axis: F.when(four, (F.lit(0.0) + corners[0][axis] + corners[1][axis] + corners[2][axis] + corners[3][axis]) / 4).otherwise(
        F.aggregate(line("box"), F.lit(0.0), lambda a, p: a + p[axis]) / F.size(line("box"))
    )
    return F.struct(
        *(line(c).alias(c) for c in ("line_no", "text", "confidence", *(["box"] if box else []))),
        F.when(four, plain).otherwise(has_place(line("box"))).alias("placed"),
        F.atan2(corners[1]["y"] - corners[0]["y"], corners[1]["x"] - corners[0]["x"]).alias("angle"),
        F.hypot(corners[0]["x"] - corners[3]["x"], corners[0]["y"] - corners[3]["y"]).alias("height"),
        mean("x").alias("x"),
        mean("y").alias("y"),
    )


def _middle(ordered: str) -> Column:
    """The middle of a sorted array column, of the two middle ones their mean."""
    n = F.size(ordered)
    return (F.get(F.col(ordered), F.floor((n - 1) / 2).cast("int")) + F.get(F.col(ordered), F.floor(n / 2).cast("int"))) / 2


def row_numbers(placed: Column, limit: Column) -> Column:
    """The row, from 1, of each struct with y in an array that is sorted by it: one is in the row begun above it as long as it
    is no lower than the row's first by over `limit`.

    Every step of an `aggregate` copies what it carries, so a first pass carries one state a block, and a second one, from
    these, the rows of a block: time is in proportion to the array.
    """
    count = F.size(placed)
    blocks = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    members = lambda block: F.transform(F.sequence(block * BLOCK, F.least(count, (block + 1) * BLOCK) - 1), lambda k: F.get(placed, k))
    begins = lambda acc, v: (acc["row"] == 0) | (v["y"] - acc["top"] > limit)
    top = lambda acc, v: F.when(begins(acc, v), v["y"]).otherwise(acc["top"]).alias("top")
    row = lambda acc, v: acc["row"] + F.when(begins(acc, v), 1).otherwise(0)
    state = F.struct(F.lit(0.0).alias("top"), F.lit(0).alias("row"))
    after = lambda acc, block: F.aggregate(members(block), acc, lambda a, v: F.struct(top(a, v), row(a, v).alias("row")))
    states = F.aggregate(blocks, F.array(state), lambda acc, block: F.concat(acc, F.array(after(F.element_at(acc, -1), block))))

    def rows(acc: Column, block: Column) -> Column:
        start = F.struct(acc["top"].alias("top"), acc["row"].alias("row"), F.array().cast("array<int>").alias("rows"))
        return F.aggregate(members(block), start, lambda a, v: F.struct(top(a, v), row(a, v).alias("row"), F.concat(a["rows"], F.array(row(a, v))).alias("rows")), lambda a: a["rows"])

    few = F.aggregate(placed, F.struct(F.lit(0.0).alias("top"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows")),
        lambda a, v: F.struct(top(a, v), row(a, v).alias("row"), F.concat(a["rows"], F.array(row(a, v))).alias("rows")), lambda a: a["rows"])
    many = F.flatten(F.zip_with(states, blocks, lambda acc, block: F.when(block.isNotNull(), rows(acc, block)).otherwise(F.array().cast("array<int>"))))
    return F.when(count <= BLOCK, few).otherwise(many)


def in_reading_order(rows: DataFrame, lines: str = "lines") -> DataFrame:
    """Rows with their array of `measured` lines from top to bottom and left to right, tilted or not.

    Centres are turned back by the median angle of the lines. From the top, a line is in the row begun above it as long as
    it is no lower than the row's first line by over 0.6 of the median height; rows read by the turned x. Lines whose box has
    no place count for no median and come last, by line_no. Each step is a column, so that nothing is worked out once for
    each line that is the label's; a label may have any number of lines.
    """
    boxed = F.filter(lines, lambda v: v["placed"])
    rows = rows.withColumns({"boxed__": boxed, "rest__": F.sort_array(F.filter(lines, lambda v: ~v["placed"]))})
    rows = rows.withColumns({"angles__": F.sort_array(F.transform("boxed__", lambda v: v["angle"])), "heights__": F.sort_array(F.transform("boxed__", lambda v: v["height"]))})
    rows = rows.withColumns({"angle__": _middle("angles__"), "limit__": _middle("heights__") * SAME_ROW})
    rows = rows.withColumns({"sin__": F.sin(-F.col("angle__")), "cos__": F.cos(-F.col("angle__"))})
    turned = lambda v: F.struct(
        (v["x"] * F.col("sin__") + v["y"] * F.col("cos__")).alias("y"), v["line_no"].alias("line_no"), (v["x"] * F.col("cos__") - v["y"] * F.col("sin__")).alias("x"), v.alias("line")
    )
    rows = rows.withColumn("placed__", F.sort_array(F.transform("boxed__", turned)))
    rows = rows.withColumn("rows__", row_numbers(F.col("placed__"), F.col("limit__")))
    numbered = F.zip_with("placed__", "rows__", lambda v, row: F.struct(row.alias("row"), v["x"].alias("x"), v["y"].alias("y"), v["line_no"].alias("line_no"), v["line"].alias("line")))
    ordered = F.transform(F.sort_array(numbered), lambda v: v["line"])
    rows = rows.withColumn(lines, F.when(F.size(lines) < 2, F.col(lines)).otherwise(F.concat(ordered, "rest__")))
    return rows.drop("boxed__", "rest__", "angles__", "heights__", "angle__", "limit__", "sin__", "cos__", "placed__", "rows__")


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with trimmed text and reading_pos, from 1, within their label; blank ones are none."""
    grouped = in_reading_order(_grouped(lines, box=True))
    # outer: for an inner one the optimizer asks for the array's size further down and works the order out anew for that
    each = grouped.select("name_key", F.posexplode_outer("lines").alias("at", "line")).filter("line is not null")
    return each.select("name_key", *(f"line.{c}" for c in ("line_no", "text", "confidence", "box")), (F.col("at") + 1).alias("reading_pos"))


def _grouped(lines: DataFrame, box: bool = False) -> DataFrame:
    """One row a label, also if all its lines are blank, with its `measured` lines: the only shuffle of the lines, and of the
    columns in use; their boxes stay behind unless asked for. Lines with a column error give read_error, why the image could
    not be read."""
    error = F.col("error") if "error" in lines.columns else F.lit(None).cast("string")
    trimmed = lines.select(F.lower("filename").alias("name_key"), "line_no", T.strip(F.col("text")).alias("text"), "confidence", "box", error.alias("error"))
    keyed = trimmed.select("name_key", F.when(F.col("text") != "", measured(F.col, box)).alias("line"), "error")
    return keyed.groupBy("name_key").agg(F.sort_array(F.collect_list("line")).alias("lines"), F.max("error").alias("read_error"))


def with_text(rows: DataFrame, lines: str = "lines") -> DataFrame:
    """Rows with an array of lines get raw, extracted_text, squashed, characters and confidence: no shuffle, so streams have it too.

    Text is trimmed and blank lines count for nothing. The mean confidence adds up in reading order, so it does not depend
    on how the data lie; a line without one counts 0.
    """
    ordered = in_reading_order(rows if "placed" in rows.schema[lines].dataType.elementType.names else rows.withColumn(lines, shaped(F.col(lines))), lines)
    texts = F.transform(F.col(lines), lambda v: v["text"])
    total = F.aggregate(F.col(lines), F.lit(0.0), lambda a, v: a + F.nanvl(F.coalesce(v["confidence"].cast("double"), F.lit(0.0)), F.lit(0.0)))
    return ordered.withColumns(
        {
            "extracted_text": texts,
            "raw": F.array_join(texts, "\n"),
            "confidence": F.when(F.size(lines) > 0, total / F.size(lines)).otherwise(0.0),
        }
    ).withColumn("squashed", T.squash(F.col("raw"))).withColumn("characters", F.length("squashed"))


def assemble_labels(lines: DataFrame) -> DataFrame:
    """name_key, raw, extracted_text, squashed, characters and confidence of each label, and read_error, null where it was read."""
    return with_text(_grouped(lines)).drop("lines")


def is_readable(characters: Column, confidence: Column) -> Column:
    return (characters >= MIN_CHARACTERS) & (confidence >= MIN_CONFIDENCE)


def label_facts(labels: DataFrame) -> DataFrame:
    """What every application of a label needs of its text, worked out once: squashed text, figures and volumes."""
    rows = labels if "squashed" in labels.columns else labels.withColumn("squashed", T.squash(F.col("raw")))
    with_places = rows.withColumn("flat__", T.flatten(F.col("raw"))).withColumn("places", T.positions(F.col("flat__"))).drop("flat__")
    return with_places.withColumns({"alcohol_values": Q.label_alcohol(F.col("raw")), "proof_values": Q.proofs(F.col("raw")), "volumes": Q.quantities(F.col("raw"))})


def latest_image(images: DataFrame) -> DataFrame:
    """Of files with one lower-cased name the last one: by modificationTime, then by path, then by the other columns.

    The largest struct of all columns in that order: each task keeps one a name before anything is moved.
    """
    order = [c for c in ("modificationTime", "path") if c in images.columns]
    order += [c for c in images.columns if c not in (*order, "name_key")]
    last = images.groupBy("name_key").agg(F.max(F.struct(*(F.col(f"`{c}`") for c in order))).alias("last"))
    return last.select(*(F.col("name_key") if c == "name_key" else F.col(f"last.`{c}`") for c in images.columns))


def match_images(apps: DataFrame, images: DataFrame) -> DataFrame:
    """Every application with the image or label of its file name, whatever the case; nulls where there is none."""
    keyed = apps.withColumn("name_key", F.lower("filename"))
    return keyed.join(images.drop("filename"), "name_key", "left")


def missing_images(apps: DataFrame, images: DataFrame) -> DataFrame:
    """The applications whose file name no image has."""
    return apps.withColumn("name_key", F.lower("filename")).join(images.select("name_key"), "name_key", "left_anti")


def heading_boundary(lines: Column) -> Column:
    """Of the first text that holds the warning's heading: the share of its characters up to the heading's end."""
    key = "governmentwarning"
    held = F.get(F.filter(lines, lambda t: F.contains(T.squash(t), F.lit(key))), 0)
    places = T.positions(T.flatten(held))
    end = F.position(F.lit(key), T.squash(held)) - 1 + len(key)
    return (F.get(places, end - 1) + 1) / F.length(held)
