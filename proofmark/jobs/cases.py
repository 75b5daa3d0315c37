"""Texts for every branch of the checks, made of the keys and sizes of `part`, with what each check has to say of them.

A case is written once, as a template with figures in braces; `said` makes an expression of it that Spark and DuckDB read.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.functions.constants import HEADING, STATEMENT

from .adapters import WARNING_LINES, table

NBSP, NARROW, WIDE = "\u00a0", "\u202f", "\u2003"
_FIGURES = {"n": "p_size", "a": "p_size + 10", "b": "p_size + 11", "c": "p_size + 12", "d": "2 * (p_size + 10)", "e": "2 * (p_size + 10) + 10"}

_PERCENT_MATCHES, _BOTH_MATCH = "Alcohol percentage matches.", "Alcohol percentage and proof match."
# label, application, status, found, note
ALCOHOL = (
    ("{a}% Alc./Vol.", "forty", "review", None, "Could not read a percentage from the application value."),
    ("Batch {a}", "{a}%", "not_found", None, "No alcohol percentage found on the label."),
    ("Alc. {a}% by vol., {b}% ABV", "{c}%", "mismatch", "{a}%, {b}%", "Label shows {a}%, {b}% but the application says {c}%."),
    (f"{{a}}{NBSP}% Alc./Vol.", "{a}", "match", "{a}%", _PERCENT_MATCHES),
    ("{a}% alc/vol ({d} Proof)", "{a}% ({d} proof)", "match", "{a}% ({d} proof)", _BOTH_MATCH),
    ("{a}% Alc./Vol. ({d} Proof)", "{a}% ({e} proof)", "mismatch", "{a}% ({d} proof)", "Percentage matches, but the label shows {d} proof and the application says {e} proof."),
    ("{a}% Alc./Vol. ({e} Proof)", "{a}%", "review", "{a}% ({e} proof)", "Percentage matches, but {e} proof is not twice {a}%."),
    ("100% Blue Agave  {a}% Alc./Vol.", "{a}%", "match", "{a}%", _PERCENT_MATCHES),
    ("100% Blue Agave  {a}% Alc./Vol.", "100%", "mismatch", "{a}%", "Label shows {a}% but the application says 100%."),
    ("{a},5 % vol", "{a}.5%", "match", "{a}.5%", _PERCENT_MATCHES),
    (f"{{a}}%{NARROW}vol {{d}}{NBSP}PROOF", f"{WIDE}{{a}}%\t", "match", "{a}% ({d} proof)", _BOTH_MATCH),
    ("Contains {a}%", "{a}%", "match", "{a}%", _PERCENT_MATCHES),
    ("٤٥% vol", "45%", "match", "45%", _PERCENT_MATCHES),
)
_OTHER_UNITS = "Same volume in different units."
# label, application, status, found, note, and the label's volumes as written, with their millilitres by the figure n
VOLUMES = (
    ("{n}0mL", "{n} cL", "match", "{n}0mL", _OTHER_UNITS, (("{n}0mL", "10.0 * p_size"),)),
    (f"{{n}}{NBSP}Pints", "{n} pt.", "match", "{n} Pints", _OTHER_UNITS, (("{n} Pints", "473.176 * p_size"),)),
    ("{n} quarts", f"{NBSP}{{n}} QUARTS", "match", "{n} quarts", "Net contents match.", (("{n} quarts", "946.353 * p_size"),)),
    ("{n} gal", "{n} gallons", "match", "{n} gal", _OTHER_UNITS, (("{n} gal", "3785.41 * p_size"),)),
    ("{n} fl. oz.", "{n} FL OZ", "match", "{n} fl. oz.", _OTHER_UNITS, (("{n} fl. oz.", "29.5735 * p_size"),)),
    ("{n} L", "{n}5 L", "mismatch", "{n} L", "Label shows {n} L but the application says {n}5 L.", (("{n} L", "1000.0 * p_size"),)),
    ("Batch {n}", "{n} L", "not_found", None, "No volume found on the label.", ()),
    ("{n} cL", "a bottle", "review", None, "Could not read a volume from the application value.", (("{n} cL", "10.0 * p_size"),)),
    ("{n} L, {n} oz", "{n} fluid ounces", "match", "{n} oz", _OTHER_UNITS, (("{n} L", "1000.0 * p_size"), ("{n} oz", "29.5735 * p_size"))),
    ("{n},5 litres", "{n}.5 liters", "match", "{n},5 litres", _OTHER_UNITS, (("{n},5 litres", "1000.0 * p_size + 500.0"),)),
)


def said(template: str | None) -> str:
    """A SQL expression for the text of a template; null for None."""
    if template is None:
        return "cast(null as varchar(200))"
    parts = []
    for k, piece in enumerate(template.split("{")):
        figure, text = piece.split("}", 1) if k else ("", piece)
        if figure:
            parts.append(f"cast({_FIGURES[figure]} as varchar(20))")
        if text:
            parts.append("'" + text.replace("'", "''") + "'")
    return " || ".join(parts) or "''"


def chosen(values: list[str]) -> str:
    """The expression of a row's own case."""
    return f"case p_partkey % {len(values)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end"


def compared_sql(cases: tuple) -> str:
    """The rows of `compared`."""
    return f"select p_partkey, {chosen([said(c[0]) for c in cases])} as on_label, {chosen([said(c[1]) for c in cases])} as applied from part"


def compared(spark: SparkSession, sf_dir: str, cases: tuple) -> DataFrame:
    """p_partkey, what the label says and what the application says."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.expr(chosen([said(c[0]) for c in cases])).alias("on_label"), F.expr(chosen([said(c[1]) for c in cases])).alias("applied"))


def checked_sql(cases: tuple) -> str:
    """What a check has to give for each row, as the cases say; the tests read it."""
    column = lambda k: chosen([said(c[k]) for c in cases])
    return f"select p_partkey, {column(2)} as status, {column(3)} as found, {column(4)} as note from part"


# --- warnings, by p_partkey % 8 ---------------------------------------------------------------------------------------

WARNINGS = 8
_MISREAD = {1: (("machinery", "machinory"),), 2: (("WARNING:", "WARNINg:"),), 3: (("WARNING:", "WARNlNG:"),), 5: (("drink", "drynk"), ("birth", "byrth"), ("drive", "dryve"), ("operate", "operute"))}


def _misread(case: int, line: str) -> str:
    for right, wrong in _MISREAD.get(case, ()):
        line = line.replace(right, wrong)
    return "" if case == 4 else line


_ALMOST = "Almost word-for-word. Please check the label at: {}."
_WORDINGS = {1: '"machinery,"', 3: '"WARNING:"', 5: '"drink"; "birth"; "drive"; and more'}
_CAPITALS = "Heading is in capital letters.", "Heading looks mostly capitalized. Please check it is all capital letters."
_BOLD = "Heading appears to be in bold.", "Could not tell whether the heading is bold. Please check by eye.", "Heading does not look bolder than the text beside it. Please check by eye."


def _warning_sql() -> str:
    rows = []
    for case in range(WARNINGS):
        where = f"from part where p_partkey % {WARNINGS} = {case}"
        add = lambda key, status, found, note, where=where: rows.append(
            f"select 'warned_' || p_partkey as name_key, '{key}' as key, '{status}' as status, {said(found)} as found, {said(note)} as note {where}"
        )
        if case == 4:
            add("warning_wording", "not_found", None, "No government warning statement found on the label.")
            continue
        printed = _misread(case, STATEMENT)
        if case in _WORDINGS:
            add("warning_wording", "review", printed, _ALMOST.format(_WORDINGS[case]))
        else:
            add("warning_wording", "match", printed, "Word-for-word match with the required statement.")
        lower = case in (2, 3)
        add("warning_capitals", "review" if lower else "match", printed[: len(HEADING)], _CAPITALS[lower])
        bold = 2 if case == 1 else case in (6, 7)
        add("warning_bold", "review" if bold else "match", ("Looks bold", None, "Looks regular weight")[bold], _BOLD[bold])
    return " union all ".join(rows)


WARNINGS_SQL = _warning_sql()


def warned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines with a brand and a warning, misread in one way or another."""
    texts = [F.col("p_name"), *(F.expr(chosen([said(_misread(case, line)) for case in range(WARNINGS)])) for line in WARNING_LINES)]
    each = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(*texts)).alias("at", "text")).filter("text <> ''")
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), (F.col("at") * 50.0 + y).alias("y"))
    name = F.concat(F.lit("warned_"), F.col("p_partkey").cast("string"))
    return each.select(name.alias("filename"), F.col("at").alias("line_no"), "text", F.lit(0.9).alias("confidence"), F.array(corner(0.0, 0.0), corner(500.0, 0.0), corner(500.0, 30.0), corner(0.0, 30.0)).alias("box"))


def warned_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("p_partkey") % WARNINGS
    heading = F.when(case == 6, None).when(case == 1, 2.2).otherwise(3.0)
    body = F.when(case == 7, 0.0).otherwise(2.0)
    name = F.concat(F.lit("Warned_"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(name.alias("filename"), heading.alias("heading_stroke"), body.alias("body_stroke"))
