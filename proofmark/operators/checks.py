"""The field checks: each gives a struct of key, title, status, expected, found and note."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.functions import matching as M
from proofmark.functions import quantities as Q
from proofmark.functions import text as T
from proofmark.functions.constants import (
    APPLICATION_FIELDS,
    BOLD_RATIO,
    HEADING,
    HEADING_SCORE,
    MISREAD_CAPITALS,
    MISREAD_CHARACTERS,
    REVIEW_SCORE,
    STATEMENT,
    STATEMENT_END,
    STATUSES,
    TEXT_FIELDS,
    TITLES,
    VOLUME_TOLERANCE,
    WINDOW_FACTOR,
)

FIELD = "struct<key:string,title:string,status:string,expected:string,found:string,note:string>"

_find_heading = M.finder(HEADING_SCORE)
_find_fields = M.finder(REVIEW_SCORE)
_STATEMENT = T.squash_text(STATEMENT)
_HEADING = T.squash_text(HEADING)
_END = T.squash_text(STATEMENT_END)


def field(key: str | Column, status: Column | str, expected: Column, found: Column, note: Column | str) -> Column:
    text = lambda c: (F.lit(c) if isinstance(c, str) else c).cast("string")
    title = F.lit(TITLES[key]) if isinstance(key, str) else F.create_map(*(F.lit(x) for k in TEXT_FIELDS for x in (k, TITLES[k])))[key]
    return F.struct(text(key).alias("key"), title.alias("title"), text(status).alias("status"), expected.cast("string").alias("expected"), found.cast("string").alias("found"), text(note).alias("note"))


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _with(rule: Callable[[Column], Column], **parts: Column) -> Column:
    """A rule on the parts as one struct: each is worked out once, however often the rule names it."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(k) for k, c in parts.items()))), rule), 0)


# --- figures -----------------------------------------------------------------------------------------------------------


def _percent_list(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(T.format_g(v), F.lit("%"))), ", ")


def check_alcohol(values: Column, label_proofs: Column, expected: Column) -> Column:
    """From the label's alcohol percentages and proofs, and the application's value (trimmed, not blank)."""
    return _with(_alcohol_rule, wanted=Q.expected_alcohol(expected), stated=Q.proofs(expected), values=values, proofs=label_proofs, expected=expected)


def _alcohol_rule(s: Column) -> Column:
    wanted, stated, values, label_proofs, expected = (s[k] for k in ("wanted", "stated", "values", "proofs", "expected"))
    shown, g = _percent_list(values), T.format_g(wanted)
    percent = F.concat(g, F.lit("%"))
    proof, asked = T.format_g(F.get(label_proofs, 0)), T.format_g(F.get(stated, 0))
    both = F.concat(percent, F.lit(" ("), proof, F.lit(" proof)"))
    make = lambda status, found, note: field("alcohol_content", status, expected, found, note)
    differs = F.concat(F.lit("Percentage matches, but the label shows "), proof, F.lit(" proof and the application says "), asked, F.lit(" proof."))
    return (
        F.when(wanted.isNull(), make("review", _nothing(), "Could not read a percentage from the application value."))
        .when(F.size(values) == 0, make("not_found", _nothing(), "No alcohol percentage found on the label."))
        .when(~F.array_contains(values, wanted), make("mismatch", shown, F.concat(F.lit("Label shows "), shown, F.lit(" but the application says "), g, F.lit("%."))))
        .when(F.size(label_proofs) == 0, make("match", percent, "Alcohol percentage matches."))
        .when((F.size(stated) > 0) & ~F.array_contains(label_proofs, F.get(stated, 0)), make("mismatch", both, differs))
        .when(~F.array_contains(label_proofs, wanted * 2), make("review", both, F.concat(F.lit("Percentage matches, but "), proof, F.lit(" proof is not twice "), g, F.lit("%."))))
        .otherwise(make("match", both, "Alcohol percentage and proof match."))
    )


def check_net_contents(volumes: Column, expected: Column) -> Column:
    """From the label's volumes and the application's value: equal within 1 percent, in whatever units."""
    return _with(_volume_rule, wanted=Q.quantities(expected), volumes=volumes, expected=expected)


def _volume_rule(s: Column) -> Column:
    wanted, volumes, expected = (s[k] for k in ("wanted", "volumes", "expected"))
    target = F.get(wanted, 0)
    ml = target["milliliters"]
    same = F.get(F.filter(volumes, lambda q: F.abs(q["milliliters"] - ml) <= ml * VOLUME_TOLERANCE), 0)
    plain = lambda t: F.lower(F.replace(t, F.lit(" "), F.lit("")))
    shown = F.array_join(F.transform(volumes, lambda q: q["text"]), ", ")
    make = lambda status, found, note: field("net_contents", status, expected, found, note)
    return (
        F.when(F.size(wanted) == 0, make("review", _nothing(), "Could not read a volume from the application value."))
        .when(F.size(volumes) == 0, make("not_found", _nothing(), "No volume found on the label."))
        .when(same.isNull(), make("mismatch", shown, F.concat(F.lit("Label shows "), shown, F.lit(" but the application says "), target["text"], F.lit("."))))
        .when(plain(same["text"]) == plain(target["text"]), make("match", same["text"], "Net contents match."))
        .otherwise(make("match", same["text"], "Same volume in different units."))
    )


# --- the warning -------------------------------------------------------------------------------------------------------


def find_warning(labels: DataFrame) -> DataFrame:
    """heading and warning, spans in the squashed text (null: no heading), and open, the text that is left to other fields."""
    at = T.find_exact(F.col("squashed"), F.lit(_HEADING))
    rows = labels.withColumn("at__", at)
    asks = F.col("at__").isNull() & can_be_close(F.col("squashed"), F.lit(_HEADING), HEADING_SCORE)
    hit = F.get(_find_heading(F.when(asks, F.col("squashed")), F.array(F.lit(_HEADING))), 0)
    rows = rows.withColumn("hit__", hit)
    start = F.coalesce("at__", F.col("hit__.start"))
    end = F.coalesce(F.col("at__") + len(_HEADING), F.col("hit__.end"))
    rows = rows.withColumn("heading", F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))).drop("at__", "hit__")
    start = F.col("heading.start")
    close = F.position(F.lit(_END), F.col("squashed"), start + 1) - 1
    near = (close >= 0) & (close - start <= WINDOW_FACTOR * len(_STATEMENT))
    stop = F.when(near, close + len(_END)).otherwise(F.least(F.length("squashed"), start + len(_STATEMENT)))
    rows = rows.withColumn("warning", F.when(F.col("heading").isNotNull(), F.struct(start.alias("start"), stop.alias("end"))))
    return rows.withColumn("open", T.claim(F.col("squashed"), F.col("warning.start"), F.col("warning.end")))


def check_warning(labels: DataFrame) -> DataFrame:
    """warning_fields: the wording, and if there is a heading its capitals and its weight, from heading_stroke and
    body_stroke where the table has them. Only wordings that differ go through the edit script."""
    rows = find_warning(labels) if "heading" not in labels.columns else labels
    span = F.substring("squashed", F.col("warning.start") + 1, F.col("warning.end") - F.col("warning.start"))
    rows = rows.withColumn("on_label__", span)
    # -1 for more than counts as misread: how much more makes no difference, and would take the product of the lengths to count
    distance = F.when(F.col("on_label__") == _STATEMENT, 0).otherwise(F.levenshtein("on_label__", F.lit(_STATEMENT), MISREAD_CHARACTERS))
    rows = rows.withColumn("distance__", distance)
    rows = rows.withColumn("phrases__", M.differing_phrases(F.when(F.col("distance__") != 0, F.col("on_label__"))))
    quoted = F.array_join(F.transform(F.slice("phrases__", 1, 3), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), "; ")
    where = F.concat(quoted, F.when(F.size("phrases__") > 3, "; and more").otherwise(""))
    statement = F.lit(STATEMENT)
    found = T.raw_span(F.col("raw"), F.col("places"), F.col("warning.start"), F.col("warning.end"), whole_words=True)
    wording = (
        F.when(F.col("heading").isNull(), field("warning_wording", "not_found", statement, _nothing(), "No government warning statement found on the label."))
        .when(F.col("distance__") == 0, field("warning_wording", "match", statement, found, "Word-for-word match with the required statement."))
        .when(F.col("distance__") > 0, field("warning_wording", "review", statement, found, F.concat(F.lit("Almost word-for-word. Please check the label at: "), where, F.lit("."))))
        .otherwise(field("warning_wording", "mismatch", statement, found, F.concat(F.lit("Wording differs from the required statement at: "), where, F.lit("."))))
    )
    heading = T.raw_span(F.col("raw"), F.col("places"), F.col("heading.start"), F.col("heading.end"))
    strokes = [F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double") for c in ("heading_stroke", "body_stroke")]
    rest = F.array(check_warning_capitals(heading), check_warning_bold(*strokes))
    fields = F.concat(F.array(wording), F.when(F.col("heading").isNotNull(), rest).otherwise(F.array().cast(f"array<{FIELD}>")))
    return rows.withColumn("warning_fields", fields).drop("on_label__", "distance__", "phrases__")


def check_warning_capitals(heading: Column) -> Column:
    lower = F.length(F.regexp_replace(heading, r"[^\p{IsLowercase}]", ""))
    make = lambda status, note: field("warning_capitals", status, F.lit(HEADING), heading, note)
    return (
        F.when(lower == 0, make("match", "Heading is in capital letters."))
        .when(lower <= MISREAD_CAPITALS, make("review", "Heading looks mostly capitalized. Please check it is all capital letters."))
        .otherwise(make("mismatch", 'Heading must be in capital letters: "GOVERNMENT WARNING:".'))
    )


def check_warning_bold(heading_stroke: Column, body_stroke: Column) -> Column:
    """From stroke widths; never a mismatch. Without both, or with a body of no width, it can't be told."""
    ratio = heading_stroke / F.nullif(body_stroke, F.lit(0.0))
    make = lambda status, found, note: field("warning_bold", status, F.lit("Bold"), found, note)
    return (
        F.when(ratio.isNull(), make("review", _nothing(), "Could not tell whether the heading is bold. Please check by eye."))
        .when(ratio >= BOLD_RATIO, make("match", F.lit("Looks bold"), "Heading appears to be in bold."))
        .otherwise(make("review", F.lit("Looks regular weight"), "Heading does not look bolder than the text beside it. Please check by eye."))
    )


# --- text fields -------------------------------------------------------------------------------------------------------


def text_field(key: str | Column, expected: Column, hit: Column, found: Column) -> Column:
    """From a hit (score, spelling) or null, the text on the label, and the application's value with single spaces."""
    status = F.when(hit.isNull(), "not_found").when(hit["score"] < 100, "review").otherwise("match")
    note = (
        F.when(hit.isNull(), "Not found on the label.")
        .when(hit["score"] < 100, "Close to the application but not the same. Please compare.")
        .when(hit["spelling"], "Same wording as the application, in a different spelling (British or American).")
        .when(found == expected, "Matches the application exactly.")
        .otherwise("Same wording as the application. Only capitalization, spacing or punctuation differs.")
    )
    return field(key, status, expected, found, note)


def claim_order(values: list[Column]) -> Column:
    """slot, needle (squashed) and expected of the values that are given, the longest needle first, equal ones as they come."""
    made = F.transform(F.array(*values), lambda v, k: F.struct(k.alias("slot"), T.squash(v).alias("needle"), T.clean_spaces(v).alias("expected")))
    given = F.filter(made, lambda e: e["expected"] != "")
    return F.sort_array(F.transform(given, lambda e: F.struct((-F.length(e["needle"])).alias("by"), e["slot"].alias("slot"), e["needle"].alias("needle"), e["expected"].alias("expected"))))


def claim_exact(text: Column, order: Column) -> Column:
    """The place of each needle, or null, in what the needles before it have left of the text."""

    def step(state: Column, e: Column) -> Column:
        at = T.find_exact(state["open"], e["needle"])
        return F.struct(T.claim(state["open"], at, at + F.length(e["needle"])).alias("open"), F.concat(state["at"], F.array(at)).alias("at"))

    return F.aggregate(order, F.struct(text.alias("open"), F.array().cast("array<int>").alias("at")), step, lambda state: state["at"])


def find_folded(text: Column, needle: Column) -> Column:
    """start and end, in the text, of its first part that is the needle under one spelling; null where there is none.

    Only where text or needle have a variant is anything folded.
    """
    folds = T.has_variant(text) | T.has_variant(needle)
    folded = F.when(folds, T.fold_in_place(text))
    wanted = F.when(folds, T.fold_spelling(needle))

    def place(v: Column) -> Column:
        at = T.find_exact(T.without_gaps(v["folded"]), v["wanted"])
        return F.when(at.isNotNull(), F.struct(at.alias("at"), F.length(v["wanted"]).alias("n"), T.fold_positions(v["folded"]).alias("places")))

    found = _with(lambda v: place(v), folded=folded, wanted=wanted)
    return _with(
        lambda v: F.when(v["hit"].isNotNull(), F.struct(F.get(v["hit"]["places"], v["hit"]["at"]).alias("start"), (F.get(v["hit"]["places"], v["hit"]["at"] + v["hit"]["n"] - 1) + 1).alias("end"))),
        hit=found,
    )


def can_be_close(text: Column, needle: Column, least: float) -> Column:
    """Whether text and needle have so many characters in common that a part of the text may be as close as `least`."""
    shorter = F.least(F.length(text), F.length(needle))
    return (shorter > 0) & (T.shared_characters(needle, text) >= shorter * F.lit(M.least_shared(least)))


HITS = "array<struct<score:double,start:int,end:int,spelling:boolean>>"


def claim_spelled(text: Column, order: Column) -> Column:
    """hits, of the needles in order, exact or under one spelling, each in what the needles before it have left of the text,
    and null for what can't be there; and asks: some needle may be there closely, so that only the finder can tell.

    From there on nothing is searched: what the finder finds is closed to later needles.
    """

    def step(state: Column, e: Column) -> Column:
        return F.when(state["asks"] | (F.length(e["needle"]) == 0), _passed(state)).otherwise(_searched(state, e))

    def _passed(state: Column) -> Column:
        return F.struct(state["open"].alias("open"), F.concat(state["hits"], F.array(F.lit(None))).cast(HITS).alias("hits"), state["asks"].alias("asks"))

    def _searched(state: Column, e: Column) -> Column:
        exact = T.find_exact(state["open"], e["needle"])
        exact = F.struct(exact.alias("start"), (exact + F.length(e["needle"])).alias("end"))
        return _with(lambda v: _spelled(state, e, v["exact"]), exact=exact)

    def _spelled(state: Column, e: Column, exact: Column) -> Column:
        folded = F.when(exact["start"].isNull(), find_folded(state["open"], e["needle"]))
        return _with(lambda v: _next(state, e, exact, v["folded"]), folded=folded)

    def _next(state: Column, e: Column, exact: Column, folded: Column) -> Column:
        start, end = F.coalesce(exact["start"], folded["start"]), F.coalesce(exact["end"], folded["end"])
        hit = F.when(start.isNotNull(), F.struct(F.lit(100.0).alias("score"), start.alias("start"), end.alias("end"), exact["start"].isNull().alias("spelling")))
        asks = F.when(start.isNotNull(), F.lit(False)).otherwise(can_be_close(state["open"], e["needle"], REVIEW_SCORE))
        return F.struct(T.claim(state["open"], start, end).alias("open"), F.concat(state["hits"], F.array(hit)).cast(HITS).alias("hits"), asks.alias("asks"))

    begin = F.struct(text.alias("open"), F.array().cast(HITS).alias("hits"), F.lit(False).alias("asks"))
    return F.aggregate(order, begin, step)


def with_exact_claims(rows: DataFrame) -> DataFrame:
    """exact__: what `claim_spelled` gives for the needles of order__ if each is in the text as it stands; null otherwise.

    One step a field, in columns of their own, which run as compiled code: most labels need no more.
    """
    rows = rows.withColumn("open__", F.col("open"))
    hits, settled = [], F.lit(True)
    for k in range(len(TEXT_FIELDS)):
        needle, at = F.get(F.col("order__"), k)["needle"], F.col(f"at{k}__")
        rows = rows.withColumn(f"needle{k}__", needle)
        needle = F.col(f"needle{k}__")
        rows = rows.withColumn(f"at{k}__", T.find_exact(F.col("open__"), needle))
        rows = rows.withColumn("open__", T.claim(F.col("open__"), at, at + F.length(needle)))
        hits.append(F.when(at.isNotNull(), F.struct(F.lit(100.0).alias("score"), at.alias("start"), (at + F.length(needle)).alias("end"), F.lit(False).alias("spelling"))))
        settled = settled & (F.coalesce(F.length(needle), F.lit(0)).eqNullSafe(0) | at.isNotNull())
    state = F.struct(F.col("open__").alias("open"), F.slice(F.array(*hits), 1, F.size("order__")).cast(HITS).alias("hits"), F.lit(False).alias("asks"))
    rows = rows.withColumn("exact__", F.when(settled, state))
    return rows.drop("open__", *(f"{c}{k}__" for c in ("needle", "at") for k in range(len(TEXT_FIELDS))))


def check_text_fields(rows: DataFrame) -> DataFrame:
    """text_fields: the given ones of the four text fields, searched longest first, each in what the ones before left.

    Columns search for exact text, for other spellings, and tell where a needle has too few characters in the text to be
    close; a row where some needle may be close goes to the finder as a whole.
    """
    rows = rows.withColumn("order__", claim_order([F.coalesce(F.col(k), F.lit("")) for k in TEXT_FIELDS]))
    # by a generator of one row: as a column the optimizer may write it out again in each that reads it, inside the finder's
    # arguments too, where functions in functions can't be told to be the same
    rows = with_exact_claims(rows)
    rows = rows.select("*", F.explode_outer(F.array(F.coalesce("exact__", claim_spelled(F.col("open"), F.col("order__"))))).alias("state__"))
    asks = F.col("state__.asks")
    needles = F.transform("order__", lambda e: e["needle"])
    rows = rows.withColumn("hits__", _find_fields(F.when(asks, F.col("open")), F.when(asks, needles)))
    rows = rows.withColumn("hits__", F.coalesce("hits__", "state__.hits"))
    span = lambda hit, whole: T.raw_span(F.col("raw"), F.col("places"), hit["start"], hit["end"], whole)
    found = F.zip_with(
        "order__", "hits__", lambda e, hit: F.struct(e.alias("e"), hit.alias("hit"), F.when(hit["score"] < 100, span(hit, True)).otherwise(span(hit, False)).alias("found"))
    )
    key = lambda e: F.get(F.array(*map(F.lit, TEXT_FIELDS)), e["slot"])
    made = F.transform(found, lambda x: text_field(key(x["e"]), x["e"]["expected"], x["hit"], x["found"]))
    return rows.withColumn("text_fields", made).drop("order__", "exact__", "state__", "hits__")


def check_fields(rows: DataFrame) -> DataFrame:
    """fields, in display order, of rows that have a label's facts, its warning and an application."""
    rows = check_text_fields(rows)
    value = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    alcohol = F.when(value("alcohol_content") != "", check_alcohol(F.col("alcohol_values"), F.col("proof_values"), value("alcohol_content")))
    volume = F.when(value("net_contents") != "", check_net_contents(F.col("volumes"), value("net_contents")))
    every = F.filter(F.concat(F.col("text_fields"), F.array(alcohol, volume), F.col("warning_fields")), lambda f: f.isNotNull())
    return rows.withColumn("fields", display_order(every)).drop("text_fields")


def _rank(key: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), key)


def _sorted(fields: Column, rank: Callable[[Column], Column]) -> Column:
    """Fields by rank, equal ones as they come. Each rank is worked out once, which a comparison of two would do again and again."""
    ranked = F.transform(fields, lambda f, i: F.struct(rank(f).alias("rank"), i.alias("i"), f.alias("f")))
    return F.transform(F.sort_array(ranked), lambda r: r["f"])


def display_order(fields: Column) -> Column:
    """Fields in the order they are shown in."""
    return _sorted(fields, lambda f: _rank(f["key"], list(TITLES)).cast("int"))


def problems_first(fields: Column) -> Column:
    """Fields by status, the worst first, and in display order within one."""
    return _sorted(fields, lambda f: (_rank(f["status"], list(STATUSES)) * 100 + _rank(f["key"], list(TITLES))).cast("int"))


def provided_fields(apps: DataFrame) -> DataFrame:
    """app_id, key, title, expected for each field that is given; the warning is always checked."""
    given = [F.struct(F.lit(k).alias("key"), F.lit(TITLES[k]).alias("title"), T.strip(F.col(k)).alias("expected")) for k in APPLICATION_FIELDS]
    warning = F.struct(F.lit("warning_wording").alias("key"), F.lit(TITLES["warning_wording"]).alias("title"), F.lit(STATEMENT).alias("expected"))
    return apps.select("app_id", F.explode(F.array(*given, warning)).alias("f")).select("app_id", "f.*").filter("expected <> ''")
