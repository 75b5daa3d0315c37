"""The library's queries over the driver's tables, and the same in DuckDB's SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.functions import matching as M
from proofmark.functions import quantities as Q
from proofmark.functions import text as T
from proofmark.functions.constants import HEADING, SHOWN, SPELLINGS, STATEMENT, TITLES, UNREADABLE_SUMMARY
from proofmark.operators import checks, labels, outcomes
from proofmark.sources import tables as S

from . import verify
from .adapters import APPLICATIONS_SQL, RAW_SQL, VERDICTS, applications, label_lines, rows_of, strokes, table
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]

SQUASH_SQL = r"regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]', '', 'g')"


def squash_sql(x: str) -> str:
    return SQUASH_SQL.format(x)


def fold_sql(x: str) -> str:
    for variant, standard in SPELLINGS:
        x = f"replace({x}, '{variant}', '{standard}')"
    return x


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# --- text -------------------------------------------------------------------------------------------------------------


@query(f"select doc_id, length({squash_sql('text')}) as n_kept, md5({squash_sql('text')}) as digest from documents")
def squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = T.squash(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", kept.alias("kept")).select("doc_id", F.length("kept").cast("long").alias("n_kept"), F.md5(F.encode("kept", "UTF-8")).alias("digest"))


@query(f"select doc_id, md5({fold_sql(squash_sql('text'))}) as digest from documents")
def fold_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(F.encode(T.fold_spelling(T.squash(F.col("text"))), "UTF-8")).alias("digest"))


@query(r"select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as digest from documents")
def clean_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(F.encode(T.clean_spaces(F.col("text")), "UTF-8")).alias("digest"))


_HAYS = f"select doc_id, {squash_sql('text')} as hay, doc_id % (select count(*) from benchmark) as share from documents"
_ITEMS = f"select item_id, {squash_sql('text')} as needle, item_id % (select count(*) from benchmark) as share from benchmark"
_PASSAGES = f"""select doc_id, item_id, hay, needle from ({_HAYS}) left join ({_ITEMS}) using (share)
union all select doc_id, null, hay, substr(hay, length(hay) // 3 + 1, 25) from ({_HAYS})"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each squashed document with whole passages, mostly not in it, and (item_id null) with a piece out of its own middle."""
    items = table(spark, sf_dir, "benchmark")
    n = rows_of(items)
    hays = _documents(spark, sf_dir).select("doc_id", T.squash(F.col("text")).alias("hay"))
    needles = items.select("item_id", T.squash(F.col("text")).alias("needle"), (F.col("item_id") % n).alias("share"))
    whole = hays.withColumn("share", F.col("doc_id") % n).join(needles, "share", "left").select("doc_id", "item_id", "hay", "needle")
    own = F.substring("hay", F.floor(F.length("hay") / 3).cast("int") + 1, F.lit(25))
    return whole.unionByName(hays.select("doc_id", F.lit(None).cast("long").alias("item_id"), "hay", own.alias("needle")))


@query(f"select doc_id, item_id, case when needle <> '' and instr(hay, needle) > 0 then instr(hay, needle) - 1 end as at from ({_PASSAGES})")
def find_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("doc_id", "item_id", T.find_exact(F.col("hay"), F.col("needle")).cast("long").alias("at"))


@query(
    f"""select doc_id, item_id, instr(hay, needle) - 1 as at, length(hay) as n,
    md5(substr(hay, 1, instr(hay, needle) - 1) || repeat('*', length(needle)) || substr(hay, instr(hay, needle) + length(needle))) as digest
    from ({_PASSAGES}) where needle <> '' and instr(hay, needle) > 0"""
)
def claim_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode_outer(F.array(T.find_exact(F.col("hay"), F.col("needle"))))  # of one each: the filter stays above the squashing
    found = _passages(spark, sf_dir).select("*", at.alias("at")).filter("at is not null")
    left = found.withColumn("open", T.claim(F.col("hay"), F.col("at"), F.col("at") + F.length("needle")))
    shown = F.replace("open", F.lit(T.NUL), F.lit("*"))
    return left.select("doc_id", "item_id", F.col("at").cast("long").alias("at"), F.length("open").cast("long").alias("n"), F.md5(F.encode(shown, "UTF-8")).alias("digest"))


@query("select s_suppkey, levenshtein(s_name, n_name) as distance from supplier join nation on s_nationkey = n_nationkey")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", F.levenshtein("s_name", "n_name").cast("long").alias("distance"))


def _found(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    """A field of each application in its label's text, exact, by spelling or close."""
    apps = applications(spark, sf_dir).withColumn("name_key", F.lower("filename"))
    joined = labels.assemble_labels(label_lines(spark, sf_dir)).join(apps, "name_key")
    hit = M.finder(80.0)(T.squash(F.col("raw")), F.array(T.squash(F.col(field))))
    found = joined.select("app_id", F.get(hit, 0).alias("hit"))
    return found.select("app_id", F.round("hit.score", 6).alias("score"), "hit.start", "hit.end", "hit.spelling")


_PRINTED = f"select p_partkey, {squash_sql('texts[1]')} as brand, {squash_sql('texts[2]')} as kind from ({RAW_SQL})"


@query(
    f"""select app_id, case when n < length(brand) then round(100.0 * (n - 1) / n, 6) else 100.0 end as score, 0 as start, cast(n as integer) as "end", false as spelling
    from (select p.*, app_id, length({squash_sql('brand_name')}) as n from ({_PRINTED}) p join ({APPLICATIONS_SQL}) a on p_partkey = app_id)"""
)
def find_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands; the one with a letter doubled is found but for its last letter."""
    return _found(spark, sf_dir, "brand_name")


@query(f"""select p_partkey as app_id, cast(100 as double) as score, cast(length(brand) as integer) as start, cast(length(brand) + length(kind) as integer) as "end", p_partkey % 11 = 10 as spelling from ({_PRINTED})""")
def find_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, of which some are spelled in the British way."""
    return _found(spark, sf_dir, "class_type")


@query(f"select name_key, case p_partkey % 11 when 4 then null when 5 then 'because of the risk of birth defects.' else '' end as phrases from ({RAW_SQL})")
def differing_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the statement that labels change."""
    rows = checks.find_warning(labels.label_facts(labels.assemble_labels(label_lines(spark, sf_dir))))
    span = F.substring("squashed", F.col("warning.start") + 1, F.col("warning.end") - F.col("warning.start"))
    return rows.select("name_key", F.array_join(M.differing_phrases(span), " | ").alias("phrases"))


# --- figures ----------------------------------------------------------------------------------------------------------

_LABEL = f"({RAW_SQL})"
_PARTS = f"select name_key, string_split(raw, '%') as parts from {_LABEL}"
_PERCENT = r"""select name_key, i as nth, cast(replace(regexp_extract(parts[i], '(\d{1,3}(?:[.,]\d{1,2})?)\s*$', 1), ',', '.') as double) as value,
regexp_matches(lower(right(regexp_replace(parts[i], '(\d{1,3}(?:[.,]\d{1,2})?)\s*$', ''), 15) || ' ' || left(parts[i + 1], 15)), 'alc|vol|abv') as is_alcohol
from (select *, unnest(range(1, len(parts))) as i from (""" + _PARTS + r""")) where regexp_matches(parts[i], '\d\s*$')"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.assemble_labels(label_lines(spark, sf_dir)).select("name_key", "raw")


@query(f"select name_key, cast(row_number() over (partition by name_key order by nth) as bigint) as nth, value, is_alcohol from ({_PERCENT})")
def percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir).select("name_key", F.posexplode_outer(Q.percentages(F.col("raw"))).alias("at", "p")).filter("p is not null")
    return rows.select("name_key", (F.col("at") + 1).cast("long").alias("nth"), "p.value", "p.is_alcohol")


@query(rf"select name_key, array_to_string(regexp_extract_all(raw, '(?i)(\d{{2,3}}(?:\.\d+)?)\s*proof', 1), ',') as proofs from {_LABEL}")
def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform(Q.proofs(F.col("raw")), T.format_g), ",")
    return _raw(spark, sf_dir).select("name_key", shown.alias("proofs"))


_AMOUNT = r"cast(regexp_extract({0}, '^(\d+)', 1) as double) * case when lower({0}) like '%ml' then 1.0 when lower({0}) like '%cl' then 10.0 when lower({0}) like '%fl oz' then 29.5735 else 1000.0 end"


@query(f"select app_id, net_contents as text, round({_AMOUNT.format('net_contents')}, 6) as milliliters from ({APPLICATIONS_SQL})")
def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applications(spark, sf_dir).select("app_id", F.explode(Q.quantities(F.col("net_contents"))).alias("q"))
    return rows.select("app_id", "q.text", F.round("q.milliliters", 6).alias("milliliters"))


# --- labels -----------------------------------------------------------------------------------------------------------


@query(f"select name_key, cast(p as bigint) as reading_pos, texts[p] as text from (select name_key, texts, unnest(range(1, len(texts) + 1)) as p from {_LABEL})")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.reading_order(label_lines(spark, sf_dir)).select("name_key", F.col("reading_pos").cast("long").alias("reading_pos"), "text")


@query(
    f"""select name_key, md5(raw) as digest, cast(length({squash_sql("raw")}) as bigint) as characters, cast(case when p_partkey % 17 = 0 then 0.5 else 0.9 end as double) as confidence,
    length({squash_sql("raw")}) >= 15 and p_partkey % 17 <> 0 as readable from {_LABEL}"""
)
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.assemble_labels(label_lines(spark, sf_dir))
    return rows.select("name_key", F.md5(F.encode("raw", "UTF-8")).alias("digest"), F.col("characters").cast("long").alias("characters"), F.round("confidence", 3).alias("confidence"), labels.is_readable(F.col("characters"), F.col("confidence")).alias("readable"))


IMAGES_SQL = "select 'Label_' || o_custkey % 700 || '.PNG' as filename, o_orderkey, o_orderdate, cast(o_totalprice * 100 as bigint) as length from orders"


def order_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_custkey") % 700
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Label_"), number.cast("string"), F.lit(".PNG")).alias("filename"),
        F.concat(F.lit("label_"), number.cast("string"), F.lit(".png")).alias("name_key"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"),
        F.col("o_orderdate").alias("modificationTime"),
        (F.col("o_totalprice") * 100).cast("long").alias("length"),
    )


@query(f"select lower(filename) as name_key, o_orderkey from ({IMAGES_SQL}) qualify row_number() over (partition by lower(filename) order by o_orderdate desc, o_orderkey desc) = 1")
def latest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.latest_image(order_images(spark, sf_dir)).select("name_key", F.col("path").cast("long").alias("o_orderkey"))


@query(f"select app_id, filename from ({APPLICATIONS_SQL}) where lower(filename) not in (select lower(filename) from ({IMAGES_SQL}))")
def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.missing_images(applications(spark, sf_dir), order_images(spark, sf_dir)).select("app_id", "filename")


_ADMIT = f"""select app_id, case when i.k is null then 'No image was chosen with this file name.'
when trim(case when app_id % 5 = 0 then ' ' else brand_name end) = '' then 'Enter the brand name from the application.'
when length > 15728640 then 'This image is too large. The limit is 15 MB.'
when app_id % 7 = 0 then 'This file could not be opened as an image. Use a JPG or PNG of the label.' end as error_message
from ({APPLICATIONS_SQL}) a left join (select lower(filename) as k, max(length) as length from ({IMAGES_SQL}) group by 1) i on lower(a.filename) = i.k"""


@query(_ADMIT)
def admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = order_images(spark, sf_dir).groupBy("name_key").agg(F.max("length").alias("length"))
    apps = applications(spark, sf_dir).withColumn("brand_name", F.when(F.col("app_id") % 5 == 0, " ").otherwise(F.col("brand_name")))
    joined = labels.match_images(apps, images.withColumn("filename", F.lit(None))).withColumn("is_image", F.col("app_id") % 7 != 0)
    return S.admit(joined).select("app_id", "error_message")


# --- checks -----------------------------------------------------------------------------------------------------------

_GIVEN = " union all ".join(f"select app_id, '{k}' as key, '{TITLES[k]}' as title, trim({k}) as expected from ({APPLICATIONS_SQL})" for k in ("brand_name", "class_type", "alcohol_content", "net_contents", "bottler", "country_of_origin"))
DUCK_VERDICTS = f"case when p_partkey % 17 = 0 then 'unreadable' else {VERDICTS} end"


@query(f"select * from ({_GIVEN} union all select app_id, 'warning_wording', '{TITLES['warning_wording']}', '{STATEMENT}' from ({APPLICATIONS_SQL})) where expected <> ''")
def provided_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.provided_fields(applications(spark, sf_dir))


_FACTS = f"""select a.*, p_size, p_partkey, case when p_partkey % 11 = 2 then p_size + 1 else p_size end as shown, p_size >= 5 and p_partkey % 2 = 0 as has_proof
from ({APPLICATIONS_SQL}) a join part on p_partkey = app_id"""


@query(
    f"""select app_id, case when shown <> p_size then 'mismatch' else 'match' end as status,
    case when shown <> p_size then shown || '%' when has_proof then p_size || '% (' || 2 * p_size || ' proof)' else p_size || '%' end as found,
    case when shown <> p_size then 'Label shows ' || shown || '% but the application says ' || p_size || '%.'
    when has_proof then 'Alcohol percentage and proof match.' else 'Alcohol percentage matches.' end as note from ({_FACTS})"""
)
def check_alcohol(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = labels.label_facts(labels.assemble_labels(label_lines(spark, sf_dir))).select("name_key", "alcohol_values", "proof_values")
    joined = applications(spark, sf_dir).withColumn("name_key", F.lower("filename")).join(facts, "name_key")
    made = joined.select("app_id", checks.check_alcohol(F.col("alcohol_values"), F.col("proof_values"), F.trim("alcohol_content")).alias("f"))
    return made.select("app_id", "f.status", "f.found", "f.note")


@query(
    f"""select app_id, 'match' as status, case app_id % 4 when 0 then '750 mL' when 1 then '750 mL' when 2 then '1 L' else '12 FL OZ' end as found,
    case when app_id % 4 = 1 then 'Same volume in different units.' else 'Net contents match.' end as note from ({APPLICATIONS_SQL})"""
)
def check_net_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = labels.label_facts(labels.assemble_labels(label_lines(spark, sf_dir))).select("name_key", "volumes")
    joined = applications(spark, sf_dir).withColumn("name_key", F.lower("filename")).join(facts, "name_key")
    made = joined.select("app_id", checks.check_net_contents(F.col("volumes"), F.trim("net_contents")).alias("f"))
    return made.select("app_id", "f.status", "f.found", "f.note")


_STATEMENT = T.squash_text(STATEMENT)
_WARNED = f"""select name_key, p_partkey, sq, instr(sq, '{T.squash_text(HEADING)}') as h,
instr(substr(sq, greatest(instr(sq, '{T.squash_text(HEADING)}'), 1)), 'healthproblems') as e from (select name_key, p_partkey, {squash_sql("raw")} as sq from {_LABEL})"""
_SPANNED = f"select *, case when e > 0 and e - 1 <= {1.5 * len(_STATEMENT)} then substr(sq, h, e - 1 + 14) else substr(sq, h, {len(_STATEMENT)}) end as span from ({_WARNED}) where h > 0"


@query(
    f"""select name_key, 'warning_wording' as key, case when d = 0 then 'match' when d <= 4 then 'review' else 'mismatch' end as status
    from (select *, levenshtein(span, '{_STATEMENT}') as d from ({_SPANNED}))
    union all select name_key, 'warning_wording', 'not_found' from ({_WARNED}) where h = 0
    union all select name_key, 'warning_capitals', case when p_partkey % 11 = 3 then 'mismatch' else 'match' end from ({_WARNED}) where h > 0
    union all select name_key, 'warning_bold', case when p_partkey % 11 = 8 then 'review' else 'match' end from ({_WARNED}) where h > 0"""
)
def audit_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.audit_warnings(label_lines(spark, sf_dir), strokes(spark, sf_dir)).select("name_key", "key", "status")


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verify_batch(applications(spark, sf_dir), label_lines(spark, sf_dir), strokes(spark, sf_dir))


SUMMARY_SQL = f"""case {DUCK_VERDICTS} when 'unreadable' then '{UNREADABLE_SUMMARY}' when 'fail' then '1 problem found.'
when 'review' then '1 item to check by eye.' else 'Everything on the label matches the application.' end"""


@query(f"select p_partkey as app_id, {DUCK_VERDICTS} as verdict, {SUMMARY_SQL} as summary, case {DUCK_VERDICTS} when 'unreadable' then 'fail' else {DUCK_VERDICTS} end as bucket from part")
def verify_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_outcomes(spark, sf_dir).select("app_id", "verdict", "summary", "bucket")


_BUCKET = f"select case v when 'unreadable' then 'fail' else v end as bucket from (select {DUCK_VERDICTS} as v from part)"


@query(f"select b.bucket, cast(count(x.bucket) as bigint) as n from (values ('fail'), ('review'), ('pass')) b(bucket) left join ({_BUCKET}) x using (bucket) group by 1 union all select 'all', count(*) from part")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.bucket_counts(batch_outcomes(spark, sf_dir))


@query(f"select {VERDICTS} as expected_verdict, {DUCK_VERDICTS} as verdict, count(*) as n from part group by 1, 2")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").select(F.expr("'label_' || cast(p_partkey as string) || '.png'").alias("filename"), F.expr(VERDICTS).alias("expected_verdict"))
    return verify.evaluate(batch_outcomes(spark, sf_dir), wanted)


WORDS_SQL = "case " + DUCK_VERDICTS + " " + " ".join(f"when '{k}' then '{v}'" for k, v in SHOWN.items()) + " end"


# --- counting fields, on the order lines ------------------------------------------------------------------------------

_KEYS = list(TITLES)
_STATUS = "case (l_partkey + l_linenumber) % 7 when 0 then 'mismatch' when 1 then 'not_found' when 2 then 'review' else 'match' end"
_ONE_SQL = f"(select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem where l_linenumber <= {len(_KEYS)} group by 1, 2)"
_FIELD_SQL = f"select l_orderkey as app_id, l_linenumber, {_STATUS} as status from {_ONE_SQL}"


def _field_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field result for each line number of an order: the number says which field, the least of its parts the status."""
    key = F.get(F.array(*map(F.lit, _KEYS)), F.col("l_linenumber") - 1)
    title = F.get(F.array(*map(F.lit, TITLES.values())), F.col("l_linenumber") - 1)
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") <= len(_KEYS)).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return rows.select(F.col("l_orderkey").alias("app_id"), key.alias("key"), title.alias("title"), F.expr(_STATUS).alias("status"), F.lit("").alias("expected"), F.lit(None).cast("string").alias("found"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("note"))


@query(f"select app_id, count_if(status in ('mismatch', 'not_found')) as problems, count_if(status = 'review') as reviews from ({_FIELD_SQL}) group by 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.status_counts(_field_results(spark, sf_dir))


@query(
    f"""select app_id, case when p > 0 then 'fail' when r > 0 then 'review' else 'pass' end as verdict,
    case when p > 0 then p || ' problem' || case when p = 1 then '' else 's' end || ' found.' when r > 0 then r || ' item' || case when r = 1 then '' else 's' end || ' to check by eye.'
    else 'Everything on the label matches the application.' end as summary
    from (select app_id, cast(count_if(status in ('mismatch', 'not_found')) as bigint) as p, cast(count_if(status = 'review') as bigint) as r from ({_FIELD_SQL}) group by 1)"""
)
def roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = outcomes.status_counts(_field_results(spark, sf_dir))
    args = (F.col("problems"), F.col("reviews"), F.lit(True))
    return counts.select("app_id", outcomes.verdict(*args).alias("verdict"), outcomes.summary(*args).alias("summary"))


_TITLE_SQL = "case l_linenumber " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(TITLES.values(), 1)) + " end"
_LINE_SQL = f"select l_orderkey as app_id, l_linenumber, l_partkey, {_STATUS} as status, {_TITLE_SQL} as title from {_ONE_SQL}"
_RANK_SQL = "case status when 'mismatch' then 1 when 'not_found' then 2 when 'review' then 3 else 4 end"


@query(f"select app_id, coalesce(string_agg(title || ': part ' || l_partkey, ' | ' order by l_linenumber) filter (status <> 'match'), '') as details from ({_LINE_SQL}) group by 1")
def details_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.build_results(_field_results(spark, sf_dir)).select("app_id", outcomes.details_text(F.col("fields")).alias("details"))


@query(f"select app_id, string_agg(title, ', ' order by {_RANK_SQL}, l_linenumber) as titles from ({_LINE_SQL}) group by 1")
def problems_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes.build_results(_field_results(spark, sf_dir)).select("app_id", checks.problems_first(F.col("fields")).alias("fields"))
    return rows.select("app_id", F.array_join(F.transform("fields", lambda f: f["title"]), ", ").alias("titles"))
