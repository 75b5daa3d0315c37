"""The checks of figures once more, in DuckDB's SQL: worked out of the two texts of each row, from nothing else."""

from proofmark.functions.constants import ALCOHOL_CONTEXT, ALCOHOL_WORDS, UNITS, VOLUME_TOLERANCE
from proofmark.functions.quantities import all_digits

# DuckDB's patterns know white space and digits of ASCII alone by their short names
_SPACE = r"[\s\v\x1C-\x1F\x{85}\p{Z}]"
_NUMBER = r"(\p{Nd}{1,3}(?:[.,]\p{Nd}{1,2})?)"
_PROOF = rf"(?i)(\p{{Nd}}{{2,3}}(?:\.\p{{Nd}}+)?){_SPACE}*proof"
_UNITS = tuple((unit.replace(r"\s", _SPACE), ml) for unit, ml in UNITS)
_VOLUME = rf"(?i)^((\p{{Nd}}+(?:[.,]\p{{Nd}}+)?){_SPACE}*({'|'.join(u for u, _ in _UNITS)}))(?:[^a-z]|$)"


def _decimal(x: str) -> str:
    digits, plain = all_digits()
    return f"cast(replace(translate({x}, '{digits}', '{plain}'), ',', '.') as double)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def _number(x: str) -> str:
    return f"format('{{:g}}', {x})"


def _shown(values: str, one: str) -> str:
    return f"array_to_string(list_transform({values}, lambda v: {one}), ', ')"


def _percentages(parts: str) -> str:
    """number and near, whether a word for alcohol is near, of each part before a percent sign that ends in a number."""
    pattern = f"{_NUMBER}{_SPACE}*$"
    head, tail = f"right(regexp_replace({parts}[i], '{pattern}', ''), {ALCOHOL_CONTEXT})", f"left({parts}[i + 1], {ALCOHOL_CONTEXT})"
    near = f"regexp_matches({head} || ' ' || {tail}, '(?i){ALCOHOL_WORDS}')"
    each = f"list_transform(range(1, len({parts})), lambda i: {{'number': regexp_extract({parts}[i], '{pattern}', 1), 'near': {near}}})"
    return f"list_filter({each}, lambda x: x.number <> '')"


def _volumes(text: str) -> str:
    """text and ml of each volume: a number that no digit, point or comma precedes, and a unit that no letter follows."""
    said = lambda k: f"regexp_extract({text}[i:], '{_VOLUME}', {k})"
    begins = f"regexp_matches({text}[i], '\\p{{Nd}}') and (i = 1 or not regexp_matches({text}[i - 1], '[\\p{{Nd}}.,]'))"
    starts = f"list_filter(list_filter(range(1, length({text}) + 1), lambda i: {begins}), lambda i: {said(1)} <> '')"
    factor = "case " + " ".join(f"when regexp_full_match({said(3)}, '(?i){unit}') then {ml}" for unit, ml in _UNITS) + " end"
    return f"list_transform({starts}, lambda i: {{'text': {_clean(said(1))}, 'ml': {_decimal(said(2))} * {factor}}})"


def alcohol_sql(rows: str) -> str:
    """p_partkey, status, found and note for rows of p_partkey, on_label and applied."""
    percent = f"regexp_extract(applied, '{_NUMBER}{_SPACE}*%', 1)"
    bare = f"regexp_extract(applied, '^{_SPACE}*{_NUMBER}{_SPACE}*$', 1)"
    proofs = lambda x: f"list_transform(regexp_extract_all({x}, '{_PROOF}', 1), lambda x: {_decimal('x')})"
    near = "list_filter(every, lambda x: x.near)"
    g, shown, proof, asked = _number("wanted"), _shown("vals", _number("v") + " || '%'"), _number("proofs[1]"), _number("stated[1]")
    both = f"{g} || '% (' || {proof} || ' proof)'"
    # outcome: condition, status, found, note
    rules = (
        ("wanted is null", "review", "null", "'Could not read a percentage from the application value.'"),
        ("len(vals) = 0", "not_found", "null", "'No alcohol percentage found on the label.'"),
        ("not list_contains(vals, wanted)", "mismatch", shown, f"'Label shows ' || {shown} || ' but the application says ' || {g} || '%.'"),
        ("len(proofs) = 0", "match", f"{g} || '%'", "'Alcohol percentage matches.'"),
        ("len(stated) > 0 and not list_contains(proofs, stated[1])", "mismatch", both, f"'Percentage matches, but the label shows ' || {proof} || ' proof and the application says ' || {asked} || ' proof.'"),
        ("not list_contains(proofs, 2 * wanted)", "review", both, f"'Percentage matches, but ' || {proof} || ' proof is not twice ' || {g} || '%.'"),
        ("true", "match", both, "'Alcohol percentage and proof match.'"),
    )
    return f"""
        with texts as (select p_partkey, on_label, string_split(on_label, '%') as parts, {_strip('applied')} as applied from ({rows})),
        found as (select p_partkey, {_percentages('parts')} as every, {proofs('on_label')} as proofs, {proofs('applied')} as stated,
            case when {percent} <> '' then {_decimal(f"nullif({percent}, '')")} when {bare} <> '' then {_decimal(f"nullif({bare}, '')")} end as wanted from texts),
        figures as (select *, list_transform(case when len({near}) > 0 then {near} else every end, lambda x: {_decimal('x.number')}) as vals from found)
        select p_partkey, {_outcome(rules)} from figures"""


def volume_sql(rows: str) -> str:
    """The same for volumes."""
    shown = _shown("volumes", "v.text")
    plain = lambda x: f"lower(replace({x}, ' ', ''))"
    rules = (
        ("target is null", "review", "null", "'Could not read a volume from the application value.'"),
        ("len(volumes) = 0", "not_found", "null", "'No volume found on the label.'"),
        ("same is null", "mismatch", shown, f"'Label shows ' || {shown} || ' but the application says ' || target.text || '.'"),
        (f"{plain('same.text')} = {plain('target.text')}", "match", "same.text", "'Net contents match.'"),
        ("true", "match", "same.text", "'Same volume in different units.'"),
    )
    return f"""
        with texts as (select p_partkey, on_label, {_strip('applied')} as applied from ({rows})),
        found as (select p_partkey, {_volumes('on_label')} as volumes, ({_volumes('applied')})[1] as target from texts),
        figures as (select *, list_filter(volumes, lambda v: abs(v.ml - target.ml) <= target.ml * {VOLUME_TOLERANCE})[1] as same from found)
        select p_partkey, {_outcome(rules)} from figures"""


def label_volumes_sql(rows: str) -> str:
    """p_partkey, nth, text and milliliters of each volume of on_label."""
    found = f"select p_partkey, {_volumes('on_label')} as volumes from ({rows})"
    each = f"select p_partkey, volumes, unnest(range(1, len(volumes) + 1)) as nth from ({found})"
    return f"select p_partkey, cast(nth as integer) as nth, volumes[nth].text as text, round(volumes[nth].ml, 6) as milliliters from ({each})"


def _outcome(rules: tuple) -> str:
    column = lambda k, name, quote="": "case " + " ".join(f"when {r[0]} then {quote}{r[k]}{quote}" for r in rules) + f" end as {name}"
    return ", ".join((column(1, "status", "'"), column(2, "found"), column(3, "note")))
