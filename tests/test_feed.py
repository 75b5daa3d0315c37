"""The stream with its sinks: stopped, started again, and with a batch that runs twice."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofmark.operators import outcomes
from proofmark.sources.tables import LABEL_LINES
from proofmark.streaming import feed
from tests.samples import SAMPLES, sample_lines

APPLICATION = "app_id long, filename string, brand_name string, class_type string, alcohol_content string, net_contents string, bottler string, country_of_origin string"


@pytest.fixture(scope="module")
def one(spark, tmp_path_factory):
    """Applications with their lines, written as a table of three files."""
    lines = spark.createDataFrame(sample_lines(), LABEL_LINES)
    held = lines.groupBy("filename").agg(F.collect_list(F.struct("line_no", "text", "confidence", "box")).alias("lines"))
    apps = spark.createDataFrame([(k, name, *app) for k, (name, app, *_) in enumerate(SAMPLES)], APPLICATION)
    apps = apps.unionByName(apps.filter("app_id = 0").withColumns({"app_id": F.lit(50).cast("long"), "brand_name": F.lit(" ")}))
    path = str(tmp_path_factory.mktemp("feed") / "all")
    apps.join(held, "filename").repartition(3, "app_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def strokes(spark):
    return spark.createDataFrame([(s[0].upper(), 3.0, 2.0 if s[5] else 2.9) for s in SAMPLES], "filename string, heading_stroke double, body_stroke double")


def _files(one):
    return sorted(Path(f.removeprefix("file:")) for f in one.inputFiles())


def _rows(df):
    columns = [c for c in df.columns if c != feed.BATCH]
    return sorted((str(tuple(r)) for r in df.select(columns).collect()))


def test_sink_survives_stops_and_repeats(spark, tmp_path, one, strokes):
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    batch = feed.verify_stream(one, strokes)
    want = _rows(batch)
    assert len(want) == 12

    def run():
        stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        checked = feed.verify_stream(stream, strokes)
        query = feed.outcome_sink(checked, sink, state).trigger(availableNow=True).start()
        query.awaitTermination()
        return feed.written_outcomes(checked, sink)

    files = _files(one)
    for f in files[:1]:
        shutil.copy(f, source)
    first = run()
    n = first.count()
    assert 0 < n < 12 and run().count() == n  # started again, nothing new
    # the last batch ends before it is noted as done, with half of its files left behind
    commits = sorted((p for p in Path(state, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (Path(state) / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    left = Path(sink) / f"{feed.BATCH}={commits[-1].name}"
    half = sorted(left.glob("part-*.parquet"))[0]
    shutil.copy(half, left / "part-99999-left-behind.parquet")
    for f in files[1:]:
        shutil.copy(f, source)
    out = run()
    assert _rows(out) == want
    assert out.select(feed.BATCH).distinct().count() == len(list(Path(sink).glob(f"{feed.BATCH}=*")))


def test_strokes_of_the_table_count(spark, one, strokes):
    given = one.withColumns({"heading_stroke": F.lit(1.0), "body_stroke": F.lit(9.0)})
    assert _rows(feed.verify_stream(given, strokes)) == _rows(feed.verify_stream(one, strokes))


def test_counts_run_along(spark, tmp_path, one, strokes):
    source = tmp_path / "in"
    source.mkdir()
    sink, state, counts = str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "counts")
    seen = []
    for some in (_files(one)[:2], _files(one)[2:]):
        for f in some:
            shutil.copy(f, source)
        stream = spark.readStream.schema(one.schema).parquet(str(source))
        query = feed.progress_sink(feed.verify_stream(stream, strokes), one, counts, state).trigger(availableNow=True).start()
        query.awaitTermination()
        now = {r["bucket"]: (r["n"], r["total"]) for r in spark.read.parquet(counts).collect()}
        so_far = feed.verify_stream(spark.read.schema(one.schema).parquet(str(source)), strokes)
        assert now == {r["bucket"]: (r["n"], 12) for r in outcomes.bucket_counts(so_far).collect()}
        seen.append(now["all"][0])
    assert seen == sorted(seen) and seen[-1] == 12 and set(now) == {"fail", "review", "pass", "all"}
    assert not Path(sink).exists()
