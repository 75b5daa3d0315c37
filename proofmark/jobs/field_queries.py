"""Queries whose results are single fields, rows as they are read, and outcomes with all their columns."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.functions import quantities as Q
from proofmark.functions import text as T
from proofmark.functions.constants import HEADING, MISREAD_CAPITALS, MISREAD_CHARACTERS, SHOWN_STATUS, STATEMENT, TEXT_FIELDS, TITLES
from proofmark.operators import checks, labels, outcomes
from proofmark.sources import extract
from proofmark.sources import tables as S
from proofmark.streaming import feed

from . import verify
from .adapters import APPLICATIONS_SQL, LINES_SQL, PRODUCTS_SQL, RAW_SQL, VERDICTS, WARNING_LINES, applications, label_lines, strokes, table
from .cases import ALCOHOL, NBSP, VOLUMES, WARNINGS_SQL, WIDE, compared, compared_sql, said, warned_lines, warned_strokes
from .catalog import DUCK_VERDICTS, IMAGES_SQL, SUMMARY_SQL, WORDS_SQL, batch_outcomes, fold_sql, order_images, squash_sql
from .figures_sql import alcohol_sql, label_volumes_sql, volume_sql
from .registry import query

# --- fields, from what the labels say -----------------------------------------------------------------------------------

_EXACT, _LOOSE = "Matches the application exactly.", "Same wording as the application. Only capitalization, spacing or punctuation differs."
_CLOSE, _SPELT = "Close to the application but not the same. Please compare.", "Same wording as the application, in a different spelling (British or American)."
_WARNED = "p_partkey % 11 <> 4"
# what the label's own text says of the warning
_RAW = f"concat_ws(chr(10), {', '.join(f"nullif(l{k}, '')" for k in range(10))})"
_READ = f"select *, regexp_extract({_RAW}, '(?i)government\\s+warning') as heading, regexp_replace(regexp_extract({_RAW}, '(?is)government\\s+warning.*?health\\s+problems\\S*'), '\\s+', ' ', 'g') as warning from ({PRODUCTS_SQL})"
_DISTANCE = f"levenshtein({squash_sql('warning')}, '{T.squash_text(STATEMENT)}')"
_LOWER = r"length(regexp_replace(heading, '[^\p{Ll}]', '', 'g'))"
#: key, rows that have the field, status, expected, found, note
_RULES = (
    (
        "warning_wording", "true", f"case when heading = '' then 'not_found' when {_DISTANCE} = 0 then 'match' when {_DISTANCE} <= {MISREAD_CHARACTERS} then 'review' else 'mismatch' end",
        f"'{STATEMENT}'", "case when heading <> '' then warning end",
        f"case when heading = '' then 'No government warning statement found on the label.' when {_DISTANCE} = 0 then 'Word-for-word match with the required statement.' else 'Wording differs from the required statement at: \"because of the risk of birth defects.\".' end",
    ),
    (
        "warning_capitals", "heading <> ''", f"case when {_LOWER} = 0 then 'match' when {_LOWER} <= {MISREAD_CAPITALS} then 'review' else 'mismatch' end", f"'{HEADING}'", "heading",
        f"case when {_LOWER} = 0 then 'Heading is in capital letters.' when {_LOWER} <= {MISREAD_CAPITALS} then 'Heading looks mostly capitalized. Please check it is all capital letters.' else 'Heading must be in capital letters: \"GOVERNMENT WARNING:\".' end",
    ),
    (
        "warning_bold", _WARNED, "case when p_partkey % 11 = 8 then 'review' else 'match' end", "'Bold'", "case when p_partkey % 11 = 8 then 'Looks regular weight' else 'Looks bold' end",
        "case when p_partkey % 11 = 8 then 'Heading does not look bolder than the text beside it. Please check by eye.' else 'Heading appears to be in bold.' end",
    ),
)
_KEPT = r"list_filter(list_transform(string_split(raw, ''), lambda c, i: case when regexp_matches(strip_accents(c), '[\p{L}\p{N}]') then i - 1 end), lambda x: x is not null)"


def _text_sql(key: str) -> str:
    """p_partkey, expected, status, found and note of a text field: where its letters stand in the label's, as they are or
    under one spelling, or else which line is near. Labels of these tables have no field inside another one's first place."""
    given = f"select p_partkey, {key} as expected, {_RAW} as raw from ({PRODUCTS_SQL}) where {key} <> ''"
    squashed = f"select *, {squash_sql('raw')} as letters, {squash_sql('expected')} as needle, {_KEPT} as p, string_split(raw, chr(10)) as lines from ({given})"
    away = f"levenshtein({squash_sql('x')}, needle)"
    placed = f"select *, instr(letters, needle) as place, contains({fold_sql('letters')}, {fold_sql('needle')}) as spelt, list_sort(list_transform(lines, lambda x: {{'away': {away}, 'line': x}}))[1] as near from ({squashed})"
    read = f"select *, case when place > 0 then raw[p[place] + 1:p[place + length(needle) - 1] + 1] when spelt or near.away <= 0.2 * length(needle) then near.line end as found from ({placed})"
    note = f"case when place > 0 and found = expected then '{_EXACT}' when place > 0 then '{_LOOSE}' when spelt then '{_SPELT}' when found is not null then '{_CLOSE}' else 'Not found on the label.' end"
    return f"select p_partkey, expected, case when place > 0 or spelt then 'match' when found is not null then 'review' else 'not_found' end as status, found, {note} as note from ({read})"


_FIGURES = (("alcohol_content", alcohol_sql), ("net_contents", volume_sql))
_RANK = {key: k for k, key in enumerate(TITLES)}
_EVERY = " union all ".join(
    [
        f"select p_partkey, {_RANK[key]} as rank, '{key}' as key, '{TITLES[key]}' as title, {status} as status, {expected} as expected, {found} as found, {note} as note from ({_READ}) where {where}"
        for key, where, status, expected, found, note in _RULES
    ]
    + [
        f"select p_partkey, {_RANK[key]}, '{key}', '{TITLES[key]}', status, {key}, found, note from ({checked(f'select p_partkey, {_RAW} as on_label, {key} as applied from ({PRODUCTS_SQL})')}) join (select p_partkey, {key} from ({PRODUCTS_SQL})) using (p_partkey)"
        for key, checked in _FIGURES
    ]
    + [f"select p_partkey, {_RANK[key]}, '{key}', '{TITLES[key]}', status, expected, found, note from ({_text_sql(key)})" for key in TEXT_FIELDS]
)
_SHOWN_SQL = "case status " + " ".join(f"when '{k}' then '{v}'" for k, v in SHOWN_STATUS.items()) + " end"


@query(f"select p_partkey as app_id, cast(row_number() over (partition by p_partkey order by rank) as integer) as nth, key, title, status, {_SHOWN_SQL} as shown, expected, found, note from ({_EVERY})")
def field_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every outcome."""
    return verify.field_results(batch_outcomes(spark, sf_dir)).withColumn("shown", outcomes.shown_status(F.col("status")))


@query(f"select 'label_' || p_partkey || '.png' as name_key, key, status, found, note from ({_EVERY}) where key like 'warning_%'")
def audit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.audit_warnings(label_lines(spark, sf_dir), strokes(spark, sf_dir))


@query(WARNINGS_SQL)
def warning_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings that are almost right, and stroke widths that can't be told."""
    return verify.audit_warnings(warned_lines(spark, sf_dir), warned_strokes(spark, sf_dir))


@query(alcohol_sql(compared_sql(ALCOHOL)))
def alcohol_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(spark, sf_dir, ALCOHOL)
    made = rows.select("p_partkey", checks.check_alcohol(Q.label_alcohol(F.col("on_label")), Q.proofs(F.col("on_label")), T.strip(F.col("applied"))).alias("f"))
    return made.select("p_partkey", "f.status", "f.found", "f.note")


@query(volume_sql(compared_sql(VOLUMES)))
def volume_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(spark, sf_dir, VOLUMES)
    made = rows.select("p_partkey", checks.check_net_contents(Q.quantities(F.col("on_label")), T.strip(F.col("applied"))).alias("f"))
    return made.select("p_partkey", "f.status", "f.found", "f.note")


@query(label_volumes_sql(compared_sql(VOLUMES)))
def label_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every volume in a text, in all units."""
    each = compared(spark, sf_dir, VOLUMES).select("p_partkey", F.posexplode_outer(Q.quantities(F.col("on_label"))).alias("at", "q")).filter("q is not null")
    return each.select("p_partkey", (F.col("at") + 1).alias("nth"), "q.text", F.round("q.milliliters", 6).alias("milliliters"))


# --- places and orders ------------------------------------------------------------------------------------------------


@query(f"select name_key, cast(len(p) as bigint) as n, md5(array_to_string(p, ',')) as digest from (select name_key, {_KEPT} as p from ({RAW_SQL}))")
def squash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.assemble_labels(label_lines(spark, sf_dir)).select("name_key", T.positions(T.flatten(F.col("raw"))).alias("p"))
    return rows.select("name_key", F.size("p").cast("long").alias("n"), F.md5(F.encode(F.array_join("p", ","), "UTF-8")).alias("digest"))


@query(f"select name_key, case when p_partkey % 11 <> 4 then round({float(len(HEADING))} / {len(WARNING_LINES[0])}, 6) end as share from ({RAW_SQL})")
def heading_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.heading_shares(label_lines(spark, sf_dir)).select("name_key", F.round("share", 6).alias("share"))


_SLOTS = " union all ".join(f"select app_id, {k} as slot, {squash_sql(f)} as needle from ({APPLICATIONS_SQL}) where trim({f}) <> ''" for k, f in enumerate(TEXT_FIELDS))


@query(f"select app_id, string_agg(needle, '>' order by length(needle) desc, slot) as needles from ({_SLOTS}) group by 1")
def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text fields in the order in which they are searched."""
    order = checks.claim_order([F.coalesce(F.col(f), F.lit("")) for f in TEXT_FIELDS])
    return applications(spark, sf_dir).select("app_id", F.array_join(F.transform(order, lambda e: e["needle"]), ">").alias("needles"))


# --- outcomes ---------------------------------------------------------------------------------------------------------

_DETAILS = f"select p_partkey, coalesce(string_agg(title || ': ' || note, ' | ' order by rank) filter (status <> 'match'), '') as details from ({_EVERY}) group by 1"
_REPORT = f"select 'Label_' || p_partkey || '.png' as filename, p_name as brand_name, {WORDS_SQL} as result, {SUMMARY_SQL} as summary, details from part join ({_DETAILS}) using (p_partkey)"


@query(_REPORT)
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five columns, as a user downloads them."""
    return verify.report(batch_outcomes(spark, sf_dir))


@query(_REPORT)
def report_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.report(batch_outcomes(spark, sf_dir))


_WORST = "case status when 'mismatch' then 1 when 'not_found' then 2 when 'review' then 3 else 4 end"


@query(
    f"""select p_partkey as app_id, {DUCK_VERDICTS} as verdict, titles from part
    join (select p_partkey, string_agg(title, ', ' order by {_WORST}, rank) as titles from ({_EVERY}) group by 1) using (p_partkey) where {DUCK_VERDICTS} in ('fail', 'unreadable')"""
)
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures, their fields the worst first."""
    failed = verify.triage(batch_outcomes(spark, sf_dir), "fail")
    return failed.select("app_id", "verdict", F.array_join(F.transform("fields", lambda f: f["title"]), ", ").alias("titles"))


_AGREE = f"select count(*) as labels, count_if({VERDICTS} = {DUCK_VERDICTS}) as agreeing from part"


@query(f"select labels, cast(agreeing as bigint) as agreeing, agreeing / labels as accuracy, labels = agreeing as all_agree from ({_AGREE})")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").select(F.expr("'label_' || cast(p_partkey as string) || '.png'").alias("filename"), F.expr(VERDICTS).alias("expected_verdict"))
    return verify.accuracy(batch_outcomes(spark, sf_dir), wanted)


_NO_IMAGE = "No image was chosen with this file name."
_IMAGED = f"lower(filename) in (select lower(filename) from ({IMAGES_SQL}))"
_APP_VERDICTS = f"select a.*, {VERDICTS} as verdict from ({APPLICATIONS_SQL}) a join part on p_partkey = app_id"


@query(
    f"""select app_id, verdict, 'done' as state, cast(null as varchar) as message, verdict as bucket from ({_APP_VERDICTS}) where {_IMAGED}
    union all select app_id, null, 'error', '{_NO_IMAGE}', 'fail' from ({_APP_VERDICTS}) where not {_IMAGED}"""
)
def all_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with an image, given the verdict that is due, and those without, in one table."""
    apps, images = applications(spark, sf_dir), order_images(spark, sf_dir)
    due = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("app_id"), F.expr(VERDICTS).alias("verdict"))
    missing = labels.missing_images(apps, images).select("app_id", F.lit(_NO_IMAGE).alias("message"))
    done = due.join(missing, "app_id", "left_anti")
    return outcomes.all_outcomes(done, missing).select("app_id", "verdict", "state", "message", "bucket")


_BLANK_BRAND = f"case when app_id % 5 = 0 then '{WIDE}\t' else brand_name end"
_LATEST = f"select lower(filename) as k, o_orderkey, length from ({IMAGES_SQL}) qualify row_number() over (partition by lower(filename) order by o_orderdate desc, o_orderkey desc) = 1"
_MESSAGES = f"""select app_id, case when k is null then '{_NO_IMAGE}' when app_id % 5 = 0 then 'Enter the brand name from the application.'
when length > 15728640 then 'This image is too large. The limit is 15 MB.' when o_orderkey % 7 = 0 then 'This file could not be opened as an image. Use a JPG or PNG of the label.' end as message
from ({APPLICATIONS_SQL}) left join ({_LATEST}) on lower(filename) = k"""
_OUTCOME = f"""select app_id, case when message is null then {DUCK_VERDICTS} end as verdict, case when message is null then 'done' else 'error' end as state, message,
case when message is not null or {DUCK_VERDICTS} = 'unreadable' then 'fail' else {DUCK_VERDICTS} end as bucket"""


@query(f"{_OUTCOME} from ({_MESSAGES}) join part on p_partkey = app_id")
def verify_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files of one name, of which the last counts, blank brands, and stroke widths given twice."""
    png, other = F.lit(bytearray(b"\x89PNG\r\n\x1a\nrest")), F.lit(bytearray(b"hello"))
    images = order_images(spark, sf_dir).withColumn("content", F.when(F.col("path").cast("long") % 7 == 0, other).otherwise(png))
    apps = applications(spark, sf_dir).withColumn("brand_name", F.expr(_BLANK_BRAND))
    widths = strokes(spark, sf_dir)
    twice = widths.unionByName(widths.withColumn("heading_stroke", F.lit(1.0)))
    return verify.verify_batch(apps, label_lines(spark, sf_dir), twice, images).select("app_id", "verdict", "state", "message", "bucket")


_STREAMED = f"select app_id, case when app_id % 13 = 0 then '{_NO_IMAGE}' when app_id % 5 = 0 then 'Enter the brand name from the application.' end as message from ({APPLICATIONS_SQL})"


@query(f"{_OUTCOME} from ({_STREAMED}) join part on p_partkey = app_id")
def verify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's job on a table of applications that carry their lines; some have none, or no brand.

    Texts have white space about them, and on every label are blank lines that nothing was read from, in and out of place.
    """
    padded = F.concat(F.lit(f"{NBSP} "), "text", F.lit(f"\t{WIDE}"))
    line = F.struct("line_no", padded.alias("text"), "confidence", "box")
    held = label_lines(spark, sf_dir).groupBy(F.col("filename").alias("name_key")).agg(F.collect_list(line).alias("lines"), F.any_value("box").alias("box"))
    blank = lambda no, text, box: F.struct(F.lit(no).alias("line_no"), F.lit(text).cast("string").alias("text"), F.lit(0.0).alias("confidence"), box.alias("box"))
    nowhere = F.lit(None).cast(held.schema["box"].dataType)
    blanks = F.array(blank(-1, WIDE, F.col("box")), blank(0, "", nowhere), blank(50, "\t", F.col("box")), blank(51, None, F.slice("box", 1, 2)))
    apps = applications(spark, sf_dir).withColumns({"name_key": F.lower("filename"), "brand_name": F.expr(_BLANK_BRAND)})
    rows = apps.join(held.select("name_key", F.concat("lines", blanks).alias("lines")), "name_key")
    rows = rows.withColumn("lines", F.when(F.col("app_id") % 13 != 0, F.col("lines")))
    return feed.verify_stream(rows, strokes(spark, sf_dir)).select("app_id", "verdict", "state", "message", "bucket")


# --- reading ----------------------------------------------------------------------------------------------------------


@query(f"select filename, brand_name, '' as class_type, '' as alcohol_content, net_contents, '' as bottler, '' as country_of_origin from ({APPLICATIONS_SQL}) where app_id % 10 <> 0")
def shaped_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications under headers as people write them, with white space about, some columns missing, some rows blank."""
    apps = applications(spark, sf_dir)
    raw = apps.select(
        F.when(F.col("app_id") % 10 == 0, WIDE).otherwise(F.concat(F.lit(NBSP), "filename", F.lit(" \t"))).alias(" FileName "),
        F.concat(F.lit("\n"), "brand_name", F.lit(WIDE)).alias("BRAND_NAME"), F.lit("x").alias("Notes"), F.concat(F.lit(" "), "net_contents").alias("Net_Contents "),
    )
    return S.shape_applications(raw).drop("app_id")


@query(f"select filename, brand_name, class_type, alcohol_content, net_contents, bottler, country_of_origin, {VERDICTS} as expected_verdict, '' as description from ({APPLICATIONS_SQL}) join part on p_partkey = app_id")
def shaped_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = applications(spark, sf_dir).withColumn("country_of_origin", F.nullif("country_of_origin", F.lit("")))
    raw = apps.withColumnRenamed("app_id", "p_partkey").withColumns({"expected_verdict": F.expr(VERDICTS), "description": F.lit(None).cast("string")})
    return S.shape_manifest(raw).drop("app_id")


@query(f"select name_key as filename, cast(20 - pos as integer) as line_no, text from ({LINES_SQL}) where (20 - pos) % 5 <> 0")
def shaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with white space about; every fifth is blank."""
    padded = F.concat(F.lit(f"{NBSP}\t"), F.when(F.col("line_no") % 5 != 0, F.col("text")).otherwise(""), F.lit(WIDE))
    return S.shape_label_lines(label_lines(spark, sf_dir).withColumn("text", padded)).select("filename", "line_no", "text")


#: First bytes of files, in hexadecimal, and whether they are an image's; by p_partkey.
_FIRST_BYTES = (
    ("89504E470D0A1A0A0000", True), ("FFD8FFE000104A464946", True), ("474946383961", True), ("424D", True), ("49492A00", True),
    ("4D4D002A", True), ("524946460000000057454250", True), ("524946460000000041564920", False), ("255044462D312E37", False), ("", False),
)


@query(f"select p_partkey, case p_partkey % {len(_FIRST_BYTES)} " + " ".join(f"when {k} then {str(ok).lower()}" for k, (_, ok) in enumerate(_FIRST_BYTES)) + " end as is_image from part")
def image_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(F.array(*(F.unhex(F.lit(h)) for h, _ in _FIRST_BYTES)), (F.col("p_partkey") % len(_FIRST_BYTES)).cast("int"))
    content = F.concat(first, F.encode("p_name", "UTF-8"))
    return table(spark, sf_dir, "part").select("p_partkey", S.image_signature_ok(content).alias("is_image"))


def _line_reader() -> extract.Reader:
    def read(content: bytes) -> Iterator[tuple]:
        for k, line in enumerate(content.decode().split("\n")):
            yield line, 0.9, [(0.0, 50.0 * k), (600.0, 50.0 * k), (600.0, 50.0 * k + 30), (0.0, 50.0 * k + 30)]

    return read


@query(r"""select 'doc_' || doc_id as filename, cast(i - 1 as integer) as line_no, trim(regexp_replace(parts[i], '^\s+|\s+$', '', 'g')) as text
    from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, string_split(text, chr(10)) as parts from documents))
    where trim(regexp_replace(parts[i], '^\s+|\s+$', '', 'g')) <> ''""")
def extract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by a reader that the user brings; here one that takes a document's bytes for a page."""
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    return S.shape_label_lines(extract.extract_lines(pages, _line_reader)).select("filename", "line_no", "text")
