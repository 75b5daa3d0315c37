"""The report's query does the whole job, in Spark and in SQL: every column of the download, and in details all that is off."""

import duckdb

from proofmark.jobs import field_queries  # noqa: F401  enters its queries
from proofmark.jobs.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = ["filename", "brand_name", "result", "summary", "details"]


def test_report_is_whole(spark):
    rows = QUERIES["report"](spark, DATA)
    assert rows.columns == COLUMNS
    got = [tuple(r) for r in rows.orderBy("filename").collect()]
    con = duckdb.connect()
    for name in ("part", "supplier", "nation"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    assert con.execute(f"select {', '.join(COLUMNS)} from ({ORACLE_SQL['report']}) order by filename").fetchall() == got
    (parts,) = con.execute("select count(*) from part").fetchall()[0]
    assert len(got) == parts
    details = {name: text for name, *_, text in got}
    assert details["Label_3.png"] == 'Warning heading in capitals: Heading must be in capital letters: "GOVERNMENT WARNING:".'
    assert details["Label_4.png"] == "Government warning wording: No government warning statement found on the label."
    assert details["Label_1.png"] == ""
    assert all(not text for _, _, result, _, text in got if result == "Label matches the application")
    assert all(text for _, _, result, _, text in got if result in ("Problems found", "Needs a closer look"))
