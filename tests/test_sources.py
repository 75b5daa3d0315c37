"""Files in and out: messy CSV, images, a user's reader, reports and results."""

import csv
import io
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofmark.jobs import verify
from proofmark.operators import labels
from proofmark.sources import extract, records, tables

MESSY = """ Filename ,BRAND_NAME,extra,Net_Contents
a.png, Old Tom ,x," 750 mL"

 ,No file,x,1 L
B.PNG,"Harbor, Light",,
"""


def test_applications(spark, tmp_path):
    (tmp_path / "apps.csv").write_text(MESSY)
    rows = tables.read_applications(spark, str(tmp_path / "apps.csv")).orderBy("filename").collect()
    assert [(r["filename"], r["brand_name"], r["net_contents"], r["bottler"]) for r in rows] == [("B.PNG", "Harbor, Light", "", ""), ("a.png", "Old Tom", "750 mL", "")]
    (tmp_path / "bad.csv").write_text("filename,brand\na.png,x\n")
    with pytest.raises(ValueError, match="brand_name"):
        tables.read_applications(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "none.csv").write_text("filename,brand_name\n,x\n")
    with pytest.raises(ValueError, match="no rows"):
        tables.read_applications(spark, str(tmp_path / "none.csv"))


def test_duplicate_headers(spark, tmp_path):
    """The first column of a name counts, whatever the case and the white space of the others."""
    (tmp_path / "a.csv").write_text("\ufefffilename,brand_name,Brand_Name,brand_name, FILENAME \na.png,first,second,third,b.png\n")
    (row,) = tables.read_applications(spark, str(tmp_path / "a.csv")).collect()
    assert (row["filename"], row["brand_name"]) == ("a.png", "first")


def _odd_value(rng):
    return rng.choice(["", "plain", "a b", 'say "x"', "two\nlines", "\n", '"', '",', "a,b", 'inch 5"', "end\n\n", '""', "x" * rng.randint(1, 90)])


@pytest.mark.parametrize("size", [60, 4000])
def test_splits_anywhere(spark, tmp_path, size):
    """However a file is split, its records are those that one reader gives that reads it from start to end."""
    rng = random.Random(size)
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [[f"{name}{k}", *(_odd_value(rng) for _ in range(3))] for k in range(50)]
        text = io.StringIO()
        writer = csv.writer(text, lineterminator="\n")
        writer.writerow(["id", "v\n1", "v2", "v3"])
        for r in rows:
            writer.writerow(r)
            if rng.random() < 0.1:
                text.write("\n")
        (tmp_path / name).write_text(text.getvalue())
        want += rows
    (tmp_path / "b.csv").write_text((tmp_path / "b.csv").read_text() + 'last,5" pipe,12"x12",z"\nopen,"never closed\n,')
    want += [["last", '5" pipe', '12"x12"', 'z"']]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = records.read_csv(spark, str(tmp_path))
        assert df.columns == ["id", "v\n1", "v2", "v3"]
        got = [["" if v is None else v for v in r] for r in df.collect()]
        splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert splits > (10 if size < 1000 else 1)
    assert [r[0] for r in got if r[0] == "open"] == ["open"]
    assert sorted(r for r in got if r[0] != "open") == sorted(want)


def test_lines_within_quotes():
    rng = random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choice(['"', '""', ",", "a", "b,", "\n"]) for _ in range(rng.randint(1, 14)))
        inside, start, state = False, True, []
        k = 0
        while k < len(text):  # a plain reader, a character at a time
            c = text[k]
            if c == "\n":
                state.append(inside)
            if inside:
                if c == '"' and text[k + 1 : k + 2] == '"':
                    k += 1
                elif c == '"':
                    inside = False
                start = False
            else:
                inside = start and c == '"'
                start = c in ",\n"
            k += 1
        state.append(inside)
        now, got = False, []
        for line in text.split("\n"):
            now = records.ends_inside(line, now)
            got.append(now)
        assert got == state, text


def test_unequal_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("filename,brand_name\na,b\n")
    (tmp_path / "b.csv").write_text("filename,other\na,b\n")
    with pytest.raises(ValueError, match="different"):
        records.read_csv(spark, str(tmp_path))
    (tmp_path / "c.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        records.read_csv(spark, str(tmp_path / "c.csv"))


def test_white_space_and_manifest(spark, tmp_path):
    raw = spark.createDataFrame([("\u00a0a.png\t", "\u2003"), ("\u202f", "x")], "`\u00a0FILENAME ` string, brand_name string")
    assert [tuple(r) for r in tables.shape_applications(raw).select("filename", "brand_name").collect()] == [("a.png", "")]
    (tmp_path / "manifest.csv").write_text("filename,brand_name,class_type,alcohol_content,net_contents,bottler,country_of_origin,expected_verdict,description\na.png,Old Tom,,45%,,,,pass,\"Plain, simple\"\n")
    (row,) = tables.read_manifest(spark, str(tmp_path / "manifest.csv")).collect()
    assert (row["filename"], row["class_type"], row["alcohol_content"], row["expected_verdict"], row["description"]) == ("a.png", "", "45%", "pass", "Plain, simple")


def test_images_and_reader(spark, tmp_path):
    (tmp_path / "A.png").write_bytes(b"\x89PNG\r\n\x1a\nrest")
    (tmp_path / "b.txt").write_bytes(b"hello")
    images = tables.read_images(spark, str(tmp_path))
    got = {r["name_key"]: (r["length"], r["ok"]) for r in images.withColumn("ok", tables.image_signature_ok(images["content"])).collect()}
    assert got == {"a.png": (12, True), "b.txt": (5, False)}

    def make_reader():
        return lambda content: [(f"{len(content)} bytes", 0.9, [(0, 0), (1, 0), (1, 1), (0, 1)]), ("  ", 0.1, [(0, 2), (1, 2), (1, 3), (0, 3)])]

    lines = tables.shape_label_lines(extract.extract_lines(images, make_reader, 2))
    assert {(r["filename"], r["text"]) for r in lines.collect()} == {("A.png", "12 bytes"), ("b.txt", "5 bytes")}
    assert {r["name_key"]: r["raw"] for r in labels.assemble_labels(lines).collect()} == {"a.png": "12 bytes", "b.txt": "5 bytes"}


def test_one_reader_a_worker_and_broken_images(spark, tmp_path):
    """A reader is made once a worker, not once a task; an image it fails on has an error, and the others their lines."""
    made = str(tmp_path / "made")
    Path(made).mkdir()

    def make_reader():
        import os
        import uuid

        open(f"{made}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def read(content):
            if content == b"broken":
                raise OSError("no image in it")
            return [("Old Tom Distillery, Kentucky", 0.9, [(0, 0), (1, 0), (1, 1), (0, 1)])]

        return read

    rows = [(f"{k}.png", bytearray(b"broken" if k % 5 == 0 else b"\x89PNG")) for k in range(40)] + [("none.png", None)]
    images = spark.createDataFrame(rows, "filename string, content binary")
    lines = extract.extract_lines(images, make_reader, 12)
    got = lines.collect()
    assert len(got) == 40 and {r["error"] for r in got if r["text"] is None} == {"OSError: no image in it"}
    each = [p.name.split("-")[0] for p in Path(made).iterdir()]
    assert len(each) == len(set(each)) <= 8
    assert sorted(r["filename"] for r in extract.unread_images(lines).collect()) == sorted(f"{k}.png" for k in range(0, 40, 5))
    assert tables.shape_label_lines(lines).count() == 40
    apps = spark.createDataFrame([(k, f"{k}.PNG", "Old Tom", "", "", "", "", "") for k in range(10)] + [(99, "none.png", "Old Tom", "", "", "", "", "")], "app_id long, filename string, brand_name string, class_type string, alcohol_content string, net_contents string, bottler string, country_of_origin string")
    files = images.selectExpr("lower(filename) as name_key", "cast(length(content) as long) as length", "cast('\x89PNG\r\n\x1a\n' as binary) as content").withColumn("content", F.lit(bytearray(b"\x89PNG\r\n\x1a\n")))
    for out in (verify.verify_batch(apps, lines), verify.verify_batch(apps, lines, images=files.withColumn("length", F.lit(9).cast("long")))):
        said = {r["app_id"]: r["message"] for r in out.collect()}
        assert {k for k, m in said.items() if m == "This file could not be opened as an image. Use a JPG or PNG of the label."} == {0, 5}
        assert all(said[k] is None for k in (1, 2, 3, 4, 6, 7, 8, 9))


RESULT = "app_id long, filename string, verdict string, fields array<struct<key:string,note:string>>, ocr_confidence double, bucket string"


def test_batches_of_results(spark, tmp_path):
    """A batch that is written again replaces its own rows, also in buckets it has left; others stay. All fields come back."""
    path = str(tmp_path / "results")

    def results(day, n, fails):
        return [(k, f"{day}_{k}.png", "fail" if k < fails else "pass", [("brand_name", 'says "x"\n| y'), ("net_contents", None)], 0.987, "fail" if k < fails else "pass") for k in range(n)]

    frame = lambda rows: spark.createDataFrame(rows, RESULT).repartition(4)
    tables.write_results(frame(results("mon", 50, 5)), path, batch="2024-01-01")
    tables.write_results(frame(results("tue", 20, 20)), path, batch="2024-01-02", file_rows=6)
    tables.write_results(frame(results("mon", 30, 0)), path, batch="2024-01-01")
    back = tables.read_results(spark, path, frame([]).schema)
    want = [("2024-01-01", *r) for r in results("mon", 30, 0)] + [("2024-01-02", *r) for r in results("tue", 20, 20)]
    plain = lambda r: (r["batch"], r["app_id"], r["filename"], r["verdict"], [tuple(f) for f in r["fields"]], r["ocr_confidence"], r["bucket"])
    assert sorted(map(plain, back.collect())) == sorted(want)
    assert not (tmp_path / "results/batch=2024-01-01/bucket=fail").exists() and len(list((tmp_path / "results/batch=2024-01-02/bucket=fail").glob("part-*"))) >= 4
    assert back.filter("bucket = 'fail'").count() == 20
    with pytest.raises(ValueError):
        tables.write_results(frame([]), path, batch="../x")
    tables.write_results(frame(results("wed", 3, 1)), str(tmp_path / "once"), "json")
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_results(frame(results("wed", 3, 1)), str(tmp_path / "once"), "json")


def test_report_files(spark, tmp_path):
    report = spark.createDataFrame([("a.png", 'Say "Gin", twice', "Problems found", "1 problem found.", "x | y")], "filename string, brand_name string, result string, summary string, details string")
    tables.write_report(report, str(tmp_path / "report"))
    back = spark.read.csv(str(tmp_path / "report"), header=True, quote='"', escape='"')
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in report.collect()]
    tables.write_results(report, str(tmp_path / "results"), "json")
    assert spark.read.json(str(tmp_path / "results")).count() == 1


def test_lines_are_handed_on_as_they_come():
    """What a task holds does not grow with the images of a batch."""
    import pyarrow as pa

    images = pa.RecordBatch.from_pydict({"filename": [f"{k}.png" for k in range(2000)], "content": [b"x" if k % 7 else None for k in range(2000)]})
    read = lambda content: [(f"line {k}", 0.9, [(0, 0), (1, 0), (1, 1), (0, 1)]) for k in range(20)]
    sizes = [b.num_rows for b in extract._handed_on(read, iter([images, images]))]
    assert sum(sizes) == 2 * 20 * sum(1 for k in range(2000) if k % 7) and len(sizes) > 10
    assert max(sizes) < extract.HELD_LINES + 20
