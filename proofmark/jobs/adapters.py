"""Applications and label lines made of the star tables part, supplier and nation, with a known defect on most labels.

p_partkey % 11 says what is off: 2 another percentage, 3 a heading in title case, 4 no warning, 5 an altered warning,
7 a tilted photo, 8 a heading that is not bold, 9 a brand with a letter doubled, 10 British spelling. Labels that are
next to each other in `APPLICATIONS_SQL` and `LINES_SQL` say the same in DuckDB's SQL.
"""

from math import cos, radians, sin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.functions.constants import STATEMENT

WARNING_LINES = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not",
    "drink alcoholic beverages during pregnancy because of the risk of birth defects.",
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or",
    "operate machinery, and may cause health problems.",
)
assert " ".join(WARNING_LINES) == STATEMENT
TITLE_CASE = WARNING_LINES[0].replace("GOVERNMENT WARNING", "Government Warning")
ALTERED = "drink alcoholic beverages during pregnancy."
TILT = 5
VERDICTS = "case p_partkey % 11 when 2 then 'fail' when 3 then 'fail' when 4 then 'fail' when 5 then 'fail' when 8 then 'review' when 9 then 'review' else 'pass' end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame) -> Column:
    """The number of rows of a table, as a subquery: counted when the query runs, not while it is planned."""
    return df.agg(F.count("*")).scalar()


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    keyed = part.withColumn("s_suppkey", F.col("p_partkey") % rows_of(supplier))
    return keyed.join(supplier, "s_suppkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


def _pick(cases: dict[int, str], otherwise: str, by: int = 11) -> str:
    return f"case p_partkey % {by} " + " ".join(f"when {k} then {v}" for k, v in cases.items()) + f" else {otherwise} end"


_FIELDS = {
    "app_id": "p_partkey",
    "filename": "'Label_' || cast(p_partkey as string) || '.png'",
    "brand_name": "p_name",
    "class_type": _pick({10: "p_type || ' Flavored Whiskey'"}, "p_type || ' Straight Rye'"),
    "alcohol_content": "cast(p_size as string) || '% Alc./Vol.'",
    "net_contents": _pick({0: "'750 mL'", 1: "'75 cL'", 2: "'1 L'"}, "'12 fl oz'", by=4),
    "bottler": "s_name || ', ' || n_name",
    "country_of_origin": "case when p_partkey % 3 = 0 then n_name else '' end",
}
_LINES = (
    _pick({1: "upper(p_name)", 9: "substr(p_name, 1, 3) || substr(p_name, 3)"}, "p_name"),
    _pick({10: "p_type || ' Flavoured Whisky'"}, "p_type || ' Straight Rye'"),
    "case when p_partkey % 3 = 0 then 'PRODUCT OF ' || n_name else '' end",
    _pick({2: "cast(p_size + 1 as string)"}, "cast(p_size as string)") + " || '% Alc./Vol.' || case when p_size >= 5 and p_partkey % 2 = 0 then ' (' || cast(2 * (p_size + " + _pick({2: "1"}, "0") + ") as string) || ' Proof)' else '' end",
    _pick({0: "'750 mL'", 1: "'750 mL'", 2: "'1 L'"}, "'12 FL OZ'", by=4),
    "'Bottled by ' || s_name || ', ' || n_name",
    _pick({3: f"'{TITLE_CASE}'", 4: "''"}, f"'{WARNING_LINES[0]}'"),
    _pick({4: "''", 5: f"'{ALTERED}'"}, f"'{WARNING_LINES[1]}'"),
    _pick({4: "''"}, f"'{WARNING_LINES[2]}'"),
    _pick({4: "''"}, f"'{WARNING_LINES[3]}'"),
)
_JOINED = "part join supplier on s_suppkey = p_partkey % (select count(*) from supplier) join nation on n_nationkey = s_nationkey"


def _duck(expr: str) -> str:
    return expr.replace("as string)", "as varchar)")


APPLICATIONS_SQL = "select " + ", ".join(f"{_duck(v)} as {k}" for k, v in _FIELDS.items()) + f" from {_JOINED}"
#: An application with its keys and what its label says, line by line (l0 to l9).
PRODUCTS_SQL = "select " + ", ".join(["p_partkey", "p_size", *(f"{_duck(v)} as {k}" for k, v in _FIELDS.items()), *(f"{_duck(v)} as l{k}" for k, v in enumerate(_LINES))]) + f" from {_JOINED}"
LINES_SQL = " union all ".join(f"select p_partkey, 'label_' || p_partkey || '.png' as name_key, {k} as pos, {_duck(v)} as text from {_JOINED}" for k, v in enumerate(_LINES))
LINES_SQL = f"select * from ({LINES_SQL}) where text <> ''"
RAW_SQL = f"select p_partkey, name_key, string_agg(text, chr(10) order by pos) as raw, list(text order by pos) as texts from ({LINES_SQL}) group by all"


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir).select(*(F.expr(v).alias(k) for k, v in _FIELDS.items()))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines from the bottom up, on a grid that is tilted on some labels; lines of one row side by side."""
    texts = F.array(*(F.expr(v) for v in _LINES))
    rows = _products(spark, sf_dir).select("p_partkey", F.posexplode(texts).alias("at", "text")).filter("text <> ''")
    x, y = F.when(F.col("at") == 4, 600.0).otherwise(0.0), (F.col("at") - F.when(F.col("at") == 4, 1).otherwise(0)) * 50.0
    tilted = F.col("p_partkey") % 11 == 7
    c, s = F.when(tilted, cos(radians(TILT))).otherwise(1.0), F.when(tilted, sin(radians(TILT))).otherwise(0.0)
    corner = lambda dx, dy: F.struct(((x + dx) * c - (y + dy) * s).alias("x"), ((x + dx) * s + (y + dy) * c).alias("y"))
    width = F.length("text") * 6.0
    name = F.concat(F.lit("label_"), F.col("p_partkey").cast("string"), F.lit(".png"))
    confidence = F.when(F.col("p_partkey") % 17 == 0, 0.5).otherwise(0.9)
    box: Column = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(width, F.lit(0.0)), corner(width, F.lit(30.0)), corner(F.lit(0.0), F.lit(30.0)))
    return rows.select(name.alias("filename"), (20 - F.col("at")).cast("int").alias("line_no"), "text", confidence.alias("confidence"), box.alias("box"))


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    body = F.when(F.col("p_partkey") % 11 == 8, 2.9).otherwise(2.0)
    return part.select(F.concat(F.lit("label_"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("filename"), F.lit(3.0).alias("heading_stroke"), body.alias("body_stroke"))
