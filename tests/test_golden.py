"""The eleven labels end to end, as a batch, as a stream, and their report, evaluation and triage."""

import pytest
from pyspark.sql import functions as F

from proofmark.jobs import verify
from proofmark.operators import labels, outcomes
from proofmark.sources.tables import LABEL_LINES
from proofmark.streaming.feed import verify_stream
from tests.samples import SAMPLES, sample_lines


@pytest.fixture(scope="module")
def apps(spark):
    rows = [(k, name.upper() if k == 3 else name, *app) for k, (name, app, *_) in enumerate(SAMPLES)]
    return spark.createDataFrame(rows, "app_id long, filename string, brand_name string, class_type string, alcohol_content string, net_contents string, bottler string, country_of_origin string")


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(sample_lines(), LABEL_LINES).repartition(3)


@pytest.fixture(scope="module")
def strokes(spark):
    return spark.createDataFrame([(s[0], 3.0, 2.0 if s[5] else 2.9) for s in SAMPLES], "filename string, heading_stroke double, body_stroke double")


@pytest.fixture(scope="module")
def done(apps, lines, strokes):
    return verify.verify_batch(apps, lines, strokes).cache()


def test_verdicts(done):
    got = {r["filename"].lower(): (r["verdict"], [(f["key"], f["status"], f["note"]) for f in r["fields"] if f["status"] != "match"]) for r in done.collect()}
    for name, *_, verdict in SAMPLES:
        assert got[name][0] == verdict, (name, got[name])


def test_notes(done):
    got = {(r["filename"].lower(), f["key"]): f for r in done.collect() for f in r["fields"]}
    assert got["stones_throw_gin.png", "net_contents"]["note"] == "Same volume in different units."
    assert got["glen_cairn_british_spelling.png", "class_type"]["note"].startswith("Same wording as the application, in a different spelling")
    assert got["glen_cairn_british_spelling.png", "class_type"]["found"] == "Honey Flavoured Whisky Liqueur"
    assert got["blue_herron_brand_typo.png", "brand_name"]["found"] == "BLUE HERRON"
    assert got["blue_herron_brand_typo.png", "bottler"]["status"] == "match"
    assert got["old_tom_wrong_abv.png", "alcohol_content"]["found"] == "40%"
    assert got["silver_creek_titlecase_warning.png", "warning_capitals"]["found"] == "Government Warning"
    assert got["old_tom_bourbon.png", "alcohol_content"]["found"] == "45% (90 proof)"
    assert ("harbor_light_missing_warning.png", "warning_bold") not in got
    keys = [f["key"] for f in done.filter("app_id = 6").first()["fields"]]
    assert keys == ["brand_name", "class_type", "alcohol_content", "net_contents", "bottler", "country_of_origin", "warning_wording", "warning_capitals", "warning_bold"]


def test_stream_equals_batch(spark, tmp_path, apps, lines, strokes, done):
    held = lines.groupBy("filename").agg(F.collect_list(F.struct("line_no", "text", "confidence", "box")).alias("lines"))
    one = apps.withColumn("filename", F.lower("filename")).join(held, "filename").join(strokes, "filename")
    one.write.parquet(str(tmp_path / "in"))
    feed = verify_stream(spark.readStream.schema(one.schema).parquet(str(tmp_path / "in")))
    query = feed.writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    checked = spark.table("checked")
    assert checked.columns == done.columns
    columns = [c for c in done.columns if c != "filename"]
    assert {r["app_id"]: tuple(r) for r in checked.select(columns).collect()} == {r["app_id"]: tuple(r) for r in done.select(columns).collect()}


def test_stream_admission(spark):
    png, nothing = bytearray(b"\x89PNG\r\n\x1a\nrest"), bytearray(b"hello")
    line = [(0, "Old Tom", 0.9, [(0.0, 0.0)] * 4)]
    rows = [(0, "Old Tom", png, 11, line), (1, "\u00a0\t", png, 11, line), (2, "Old Tom", png, 16 * 2**20, line), (3, "Old Tom", nothing, 5, line), (4, "Old Tom", None, None, line), (5, "Old Tom", png, 11, None), (6, None, png, 11, line)]
    lines = "array<struct<line_no:int,text:string,confidence:double,box:array<struct<x:double,y:double>>>>"
    df = spark.createDataFrame([(k, "a.png", b, "", "", "", "", "", c, n, li) for k, b, c, n, li in rows], f"app_id long, filename string, brand_name string, class_type string, alcohol_content string, net_contents string, bottler string, country_of_origin string, content binary, length long, lines {lines}")
    out = {r["app_id"]: r for r in verify_stream(df).collect()}
    assert {k: (r["state"], r["bucket"]) for k, r in out.items()} == {0: ("done", "fail"), 5: ("done", "fail"), **dict.fromkeys((1, 2, 3, 4, 6), ("error", "fail"))}
    said = {k: r["message"] for k, r in out.items() if r["message"]}
    assert said == {1: "Enter the brand name from the application.", 2: "This image is too large. The limit is 15 MB.", 3: "This file could not be opened as an image. Use a JPG or PNG of the label.", 4: "No image was chosen with this file name.", 6: "Enter the brand name from the application."}
    without = {r["app_id"]: r["message"] for r in verify_stream(df.drop("content", "length")).collect()}
    assert without[5] == "No image was chosen with this file name." and without[4] is None


def test_odd_labels(spark, apps):
    """A label without confidences is unreadable, one of blank lines alone too; neither stops the others."""
    box = [(0.0, 0.0)] * 4
    rows = [("stones_throw_gin.png", k, "Stone's Throw London Dry Gin", None, box) for k in range(3)] + [("old_tom_bourbon.png", k, t, 0.9, box) for k, t in enumerate((" ", None, "\u2003"))]
    lines = spark.createDataFrame(rows, LABEL_LINES)
    out = {r["app_id"]: r for r in verify.verify_batch(apps.filter("app_id < 3"), lines).collect()}
    assert [(out[k]["state"], out[k]["verdict"], out[k]["ocr_confidence"]) for k in (0, 1)] == [("done", "unreadable", 0.0)] * 2
    assert out[0]["extracted_text"] == [] and out[2]["message"] == "No image was chosen with this file name."
    assert {r["name_key"]: r["status"] for r in verify.audit_warnings(lines).collect()} == {"old_tom_bourbon.png": "not_found", "stones_throw_gin.png": "not_found"}
    assert labels.reading_order(lines).count() == 3


def test_blank_lines_change_nothing(spark, apps, lines, strokes, done):
    """Blank lines of low confidence, in and out of place, and white space about the others: as if they were not there."""
    names = lines.select("filename").distinct()
    corner = "array(struct(1d as x, 2d as y), struct(1d as x, 9d as y), struct(5d as x, 9d as y), struct(5d as x, 2d as y))"
    blanks = [names.selectExpr("filename", f"{k} as line_no", f"{t} as text", "0.01d as confidence", f"{b} as box") for k, (t, b) in enumerate((("' '", corner), ("''", "null"), ("null", corner), ("'\u00a0\t'", f"slice({corner}, 1, 3)")))]
    more = lines.withColumn("text", F.concat(F.lit("\u00a0 "), "text", F.lit("\t")))
    for b in blanks:
        more = more.unionByName(b)
    columns = ["app_id", "verdict", "summary", "fields", "extracted_text", "ocr_confidence", "state"]
    want = {r["app_id"]: tuple(r) for r in done.select(columns).collect()}
    assert {r["app_id"]: tuple(r) for r in verify.verify_batch(apps, more, strokes).select(columns).collect()} == want
    held = more.groupBy(F.lower("filename").alias("filename")).agg(F.collect_list(F.struct("line_no", "text", "confidence", "box")).alias("lines"))
    one = apps.withColumn("filename", F.lower("filename")).join(held, "filename")
    assert {r["app_id"]: tuple(r) for r in verify_stream(one, strokes.unionByName(strokes)).select(columns).collect()} == want


def plain_order(lines):
    """Texts by the rule, from (line_no, text, box)."""
    import math
    from statistics import median

    placed = [v for v in lines if v[2] is not None and len(v[2]) >= 4]
    if placed:
        angle = -median(math.atan2(b[1][1] - b[0][1], b[1][0] - b[0][0]) for *_, b in placed)
        limit = 0.6 * median(math.hypot(b[0][0] - b[3][0], b[0][1] - b[3][1]) for *_, b in placed)
    at = []
    for no, text, b in placed:
        x, y = sum(p[0] for p in b) / len(b), sum(p[1] for p in b) / len(b)
        at.append((x * math.sin(angle) + y * math.cos(angle), no, x * math.cos(angle) - y * math.sin(angle), text))
    rows, top = [], None
    for v in sorted(at):
        if top is None or v[0] - top > limit:
            top = v[0]
            rows.append([])
        rows[-1].append((v[2], v[0], v[1], v[3]))
    return [v[3] for row in rows for v in sorted(row)] + [t for _, t, _ in sorted((v for v in lines if v not in placed), key=lambda v: v[0])]


def test_any_number_of_lines(spark):
    import random

    rng = random.Random(5)
    made = {}
    for name, n in (("b.png", 127), ("c.png", 128), ("d.png", 129), ("e.png", 700), ("f.png", 2)):
        step = rng.choice([3.0, 12.0, 40.0])
        made[name] = []
        for k in range(n):
            x, y = rng.choice([0.0, 300.0, 600.0]), step * rng.randrange(n)
            made[name].append((k, f"{name} {k}", [(x, y), (x + 50, y + 2), (x + 50, y + 32), (x, y + 30)]))
        made[name] += [(n + 3, "no box", None), (n + 2, "short box", [(0.0, 0.0)]), (n + 1, "odd", [(0.0, 0.0), (1.0, None), (1.0, 1.0), (0.0, 1.0)])]
    rows = [(name, no, text, 0.9, b) for name, lines in made.items() for no, text, b in lines]
    rng.shuffle(rows)
    got = {}
    for r in labels.reading_order(spark.createDataFrame(rows, LABEL_LINES).repartition(4)).orderBy("reading_pos").select("name_key", "text").collect():
        got.setdefault(r["name_key"], []).append(r["text"])
    for name, lines in made.items():
        assert got[name] == plain_order([(no, t, b if t != "odd" else None) for no, t, b in lines]), name


def test_very_many_lines(spark):
    """Each line of 100,001 in a row of its own."""
    n = 100_001
    x, y = (F.col("id") % 5) * 100.0, (F.col("id") * 7919 % n) * 40.0
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    box = F.array(corner(0.0, 0.0), corner(50.0, 0.0), corner(50.0, 30.0), corner(0.0, 30.0))
    lines = spark.range(n).select(F.lit("a.png").alias("filename"), F.col("id").cast("int").alias("line_no"), F.lit("x").alias("text"), F.lit(0.9).alias("confidence"), box.alias("box"))
    right = F.count_if(F.col("reading_pos") == F.col("line_no").cast("long") * 7919 % n + 1)
    assert tuple(labels.reading_order(lines).agg(F.count("*"), right).first()) == (n, n)


def test_repeated_images(spark, apps, lines, strokes):
    png = bytearray(b"\x89PNG\r\n\x1a\nrest")
    images = spark.createDataFrame([("old_tom_bourbon.png", 5, bytearray(b"hello"), 2, "a"), ("old_tom_bourbon.png", 11, png, 2, "b"), ("old_tom_bourbon.png", 5, bytearray(b"hello"), 1, "c")], "name_key string, length long, content binary, modificationTime int, path string")
    out = verify.verify_batch(apps.filter("app_id = 0"), lines, strokes.unionByName(strokes), images).collect()
    assert [(r["state"], r["verdict"]) for r in out] == [("done", "pass")]


def test_errors_and_counts(spark, apps, lines, strokes):
    more = apps.unionByName(apps.filter("app_id = 0").selectExpr("100L as app_id", "'nowhere.png' as filename", *apps.columns[2:])).unionByName(
        apps.filter("app_id = 0").selectExpr("101L as app_id", "filename", "' ' as brand_name", *apps.columns[3:])
    )
    out = verify.verify_batch(more, lines, strokes).cache()
    assert {r["app_id"]: r["message"] for r in out.filter("state = 'error'").collect()} == {100: "No image was chosen with this file name.", 101: "Enter the brand name from the application."}
    assert {r["bucket"]: r["n"] for r in outcomes.bucket_counts(out).collect()} == {"fail": 6, "review": 2, "pass": 5, "all": 13}
    words = {r["filename"]: r for r in verify.report(out).collect()}
    assert words["nowhere.png"]["result"] == "Not checked"
    assert words["old_tom_wrong_abv.png"]["details"] == "Alcohol content: Label shows 40% but the application says 45%."
    first = verify.triage(out, "fail").filter("app_id = 2").first()["fields"][0]
    assert first["key"] == "alcohol_content"


def test_evaluation(spark, done):
    manifest = spark.createDataFrame([(s[0], s[-1]) for s in SAMPLES], "filename string, expected_verdict string")
    assert {(r["expected_verdict"], r["verdict"], r["n"]) for r in verify.evaluate(done, manifest).collect()} == {("pass", "pass", 5), ("fail", "fail", 4), ("review", "review", 2)}
    assert tuple(verify.accuracy(done, manifest).first()) == (11, 11, 1.0, True)
    wrong = manifest.replace({"pass": "fail"}, subset="expected_verdict")
    assert tuple(verify.accuracy(done, wrong).first())[:2] == (11, 6)


def test_unreadable(spark, apps):
    blank = spark.createDataFrame([("old_tom_bourbon.png", 0, "Old Tom 45%", 0.9, [(0.0, 0.0)] * 4)], LABEL_LINES)
    row = verify.verify_batch(apps.filter("app_id = 0"), blank).first()
    assert (row["verdict"], row["bucket"]) == ("unreadable", "fail") and row["fields"]


def test_images(spark, apps, lines, strokes):
    png = bytearray(b"\x89PNG\r\n\x1a\n0000")
    images = spark.createDataFrame([("old_tom_bourbon.png", 10, png), ("stones_throw_gin.png", 16 * 2**20, png), ("old_tom_wrong_abv.png", 5, bytearray(b"hello"))], "name_key string, length long, content binary")
    out = {r["app_id"]: r for r in verify.verify_batch(apps, lines, strokes, images).collect()}
    assert out[0]["verdict"] == "pass"
    assert out[1]["message"].startswith("This image is too large") and out[2]["message"].startswith("This file could not be opened")
    assert out[4]["message"] == "No image was chosen with this file name."
    no_lines = {r["app_id"]: r["verdict"] for r in verify.verify_batch(apps, lines.filter("filename <> 'old_tom_bourbon.png'"), strokes, images).filter("state = 'done'").collect()}
    assert no_lines == {0: "unreadable"}


def test_reading_order(spark, lines):
    texts = {r["name_key"]: r["extracted_text"] for r in labels.assemble_labels(lines).collect()}
    for name in ("old_tom_bourbon.png", "old_tom_photo.jpg"):
        assert texts[name][:5] == ["OLD TOM DISTILLERY", "Kentucky Straight Bourbon Whiskey", "45% Alc./Vol. (90 Proof)", "750 mL", "Distilled and Bottled by Old Tom Distillery, Bardstown, Kentucky"]
        assert texts[name][5].startswith("GOVERNMENT WARNING:")
