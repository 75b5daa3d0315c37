"""Text, figures, close matching and edit scripts against plain Python, and the cases of each check."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from proofmark.functions import matching as M
from proofmark.functions import quantities as Q
from proofmark.functions import text as T
from proofmark.functions.constants import STATEMENT
from proofmark.operators import checks, labels


def _plain_squash(text):
    kept = [(unicodedata.normalize("NFKD", c)[0].lower(), k) for k, c in enumerate(text)]
    kept = [(c, k) for c, k in kept if len(c) == 1 and c.isalnum()]
    return "".join(c for c, _ in kept), [k for _, k in kept]


def test_squash_and_positions(spark):
    texts = ["STONE’S THROW", "CHÂTEAU ½ ﬁ", "", "—", "a\n b\tC", "ÀÉîõü 12,5 %", "𝐀b"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = df.select(T.squash(F.col("t")).alias("s"), T.positions(T.flatten(F.col("t"))).alias("p")).collect()
    for t, r in zip(texts, got, strict=False):
        s, p = _plain_squash(t)
        assert (r["s"], r["p"]) == (s, p), t
    assert got[-1]["s"] is None


def test_fold():
    assert M.fold("honeyflavouredwhiskey")[0] == "honeyflavoredwhisky"
    assert M.fold("greyharbour")[0] == "grayharbor"
    folded, places = M.fold("xcolourx")
    assert folded == "xcolorx" and places == [0, 1, 2, 3, 5, 6, 7]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for k, d in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if c == d else max(row[k], row[k - 1])
    return row[-1]


def _plain_closest(needle, text):
    def best(s, t):
        n, m = len(s), len(t)
        spans = [(0, k) for k in range(1, n)] + [(k, k + n) for k in range(m - n + 1)] + [(m - k, m) for k in range(n - 1, 0, -1)]
        return max(((200 * _lcs(s, t[a:b]) / (n + b - a), -k, a, b) for k, (a, b) in enumerate(spans)))

    if len(needle) > len(text):
        return best(text, needle)[0], 0, len(text)
    score, _, a, b = best(needle, text)
    if len(needle) == len(text) and (other := best(text, needle)[0]) > score:
        return other, 0, len(text)
    return score, a, b


def test_closest():
    rng = random.Random(3)
    for _ in range(300):
        word = lambda n: "".join(rng.choice("abcde\0") for _ in range(n))  # noqa: E731, B023
        needle, text = word(rng.randint(1, 12)).replace("\0", "f"), word(rng.randint(1, 30))
        want = _plain_closest(needle, text)
        got = M.closest(needle, text, 0.0)
        assert got == pytest.approx((min(want[0], 99.9), *want[1:])), (needle, text)
    long = "".join(rng.choice("ab") for _ in range(90))
    assert M.closest(long, long[:70] + "c" + long[70:], 0)[0] == pytest.approx(_plain_closest(long, long[:70] + "c" + long[70:])[0])
    assert M.closest("blueheron", "blueherronsmallbatchrum", 80)[1:] == (0, 9)
    assert M.closest("oldtomdistillery", "silvercreekvodka", 80) is None
    assert M.find("abc", "ab", 80) == (99.9, 0, 2, False)


def test_edits():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, old = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        assert len(list(M.edits(a, b))) == row[-1], (a, b)
    assert M.changed_phrases(T.squash_text(STATEMENT.replace("machinery", "machinory"))) == ["machinery,"]


# Label text, application value, status, found.
ALCOHOL = [
    ("45% Alc./Vol. (90 Proof)", "45% Alc./Vol. (90 Proof)", "match", "45% (90 proof)"),
    ("45%Alc.Vol. (90 Proof)", "45% Alc./Vol. (90 Proof)", "match", "45% (90 proof)"),
    ("ALC. 45% BY VOL.", "45% Alc./Vol. (90 Proof)", "match", "45%"),
    ("45.0 % ABV", "45% Alc./Vol. (90 Proof)", "match", "45%"),
    ("13.5% Alc./Vol.", "13.5", "match", "13.5%"),
    ("40% Alc./Vol. (80 Proof)", "45% Alc./Vol. (90 Proof)", "mismatch", "40%"),
    ("13.5% Alc./Vol.", "13%", "mismatch", "13.5%"),
    ("OLD TOM DISTILLERY 750 mL", "45%", "not_found", None),
    ("100% Blue Agave  40% Alc./Vol.", "40%", "match", "40%"),
    ("100% Blue Agave  40% Alc./Vol.", "100%", "mismatch", "40%"),
    ("45% Alc./Vol. (80 Proof)", "45%", "review", "45% (80 proof)"),
    ("45% Alc./Vol. (80 Proof)", "45% (90 Proof)", "mismatch", "45% (80 proof)"),
    ("45% Alc./Vol.", "forty-five", "review", None),
    ("45\u00a0% Alc./Vol. 90\u202fproof", "45%", "match", "45% (90 proof)"),
    ("\u0664\u0665 % vol", "\u20094\uff15\t%", "match", "45%"),
]
VOLUMES = [("750 mL", 750), ("750ML", 750), ("75 cL", 750), ("1 L", 1000), ("1.75 Liters", 1750), ("1 Litre", 1000), ("0,7 l", 700), ("12 FL OZ", 354.882), ("12 fl. oz.", 354.882), ("1 Pint", 473.176), ("750\u00a0mL", 750), ("1\u20021\u202fL", 1000), ("\u0661\u0662 fl\u00a0oz", 354.882), ("1\tquart", 946.353), ("2 gallons", 7570.82), ("6 L", 6000)]
CONTENTS = [
    ("OLD TOM 750mL", "750 mL", "match", "Net contents match."),
    ("750 mL", "75 cL", "match", "Same volume in different units."),
    ("25.4 FL OZ", "750 mL", "match", "Same volume in different units."),
    ("700 mL", "750 mL", "mismatch", "Label shows 700 mL but the application says 750 mL."),
    ("OLD TOM DISTILLERY", "750 mL", "not_found", "No volume found on the label."),
    ("750 mL", "a bottle", "review", "Could not read a volume from the application value."),
]


def test_alcohol(spark):
    df = spark.createDataFrame([(k, a, b) for k, (a, b, *_) in enumerate(ALCOHOL)], "k int, raw string, value string")
    rows = df.select("k", checks.check_alcohol(Q.label_alcohol(F.col("raw")), Q.proofs(F.col("raw")), F.col("value")).alias("f")).orderBy("k").collect()
    for r, (*_, status, found) in zip(rows, ALCOHOL, strict=True):
        assert (r["f"]["status"], r["f"]["found"]) == (status, found), r


def test_volumes(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(VOLUMES)], "k int, t string")
    rows = df.select("k", Q.quantities(F.col("t")).alias("q")).orderBy("k").collect()
    for r, (t, ml) in zip(rows, VOLUMES, strict=True):
        assert r["q"][0]["milliliters"] == pytest.approx(ml) and len(r["q"]) == 1, t
    none = spark.createDataFrame([("45% Alc./Vol. (90 Proof) (1) According to the Surgeon General (2) Consumption",)], "t string")
    assert none.select(Q.quantities(F.col("t")).alias("q")).first()["q"] == []
    df = spark.createDataFrame([(k, a, b) for k, (a, b, *_) in enumerate(CONTENTS)], "k int, raw string, value string")
    rows = df.select("k", checks.check_net_contents(Q.quantities(F.col("raw")), F.col("value")).alias("f")).orderBy("k").collect()
    assert [(r["f"]["status"], r["f"]["note"]) for r in rows] == [(s, n) for *_, s, n in CONTENTS]


# Label text, wording status, capitals status (None: no heading), what the note names.
WARNINGS = [
    ("OLD TOM\n" + STATEMENT, "match", "match", ""),
    (STATEMENT.upper(), "match", "match", ""),
    (STATEMENT.replace("GOVERNMENT WARNING", "Government Warning"), "match", "mismatch", ""),
    (STATEMENT.replace("should not drink", "should limit"), "mismatch", "match", "not drink"),
    (STATEMENT.split(" (2)")[0] + "\nBottled in Kentucky", "mismatch", "match", ""),
    (STATEMENT.replace("machinery", "machinory"), "review", "match", "machinery"),
    (STATEMENT.replace("alcoholic beverages impairs", "alcoholic draughts impairs"), "mismatch", "match", ""),
    ("HARBOR LIGHT\nIndia Pale Ale\n12 FL OZ", "not_found", None, ""),
    (STATEMENT + "\nCONTAINS SULFITES", "match", "match", ""),
]


def test_white_space(spark):
    rows = spark.createDataFrame([("\u00a0 a\u2003 b\t\x1c",), ("\u202f",), (None,)], "t string").select(T.strip(F.col("t")).alias("s"), T.clean_spaces(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("a\u2003 b", "a b"), ("", ""), (None, None)]


def test_warnings(spark):
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(WARNINGS)], "k int, raw string")
    rows = checks.check_warning(labels.label_facts(df)).select("k", "warning_fields").orderBy("k").collect()
    for r, (_, wording, capitals, part) in zip(rows, WARNINGS, strict=True):
        fields = {f["key"]: f for f in r["warning_fields"]}
        assert fields["warning_wording"]["status"] == wording, r
        assert (fields["warning_capitals"]["status"] if capitals else None) == capitals and part in fields["warning_wording"]["note"]
        assert len(fields) == (3 if capitals else 1)
