"""Percentages, proofs and volumes in texts, as array columns."""

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ALCOHOL_CONTEXT, ALCOHOL_WORDS, NUMBER, PROOF, QUANTITY, UNITS
from .text import SPACE, clean_spaces, is_ascii


@cache
def all_digits() -> tuple[str, str]:
    """The decimal digits of all scripts but ASCII's, and what each stands for."""
    every = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(every), "".join(str(unicodedata.digit(c)) for c in every)


def _decimal(text: Column) -> Column:
    return F.replace(F.when(is_ascii(text), text).otherwise(F.translate(text, *all_digits())), F.lit(","), F.lit(".")).cast("double")


def percentages(text: Column) -> Column:
    """value and is_alcohol of every percentage, in order.

    The text falls into parts at its percent signs. A part that ends in a number is a percentage; it is alcohol if one of
    the words alc, vol, abv stands in the 15 characters before or after it, no other percent sign between.
    """
    parts = F.split(text, "%", -1)
    pattern = rf"(?U){NUMBER}{SPACE}*\z"
    rows = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 2),
        lambda i: F.struct(F.regexp_extract(F.get(parts, i), pattern, 1).alias("number"), F.regexp_replace(F.get(parts, i), pattern, "").alias("head"), F.get(parts, i + 1).alias("tail")),
    )
    found = F.filter(rows, lambda r: r["number"] != "")
    words = lambda r: F.concat(F.right(r["head"], F.lit(ALCOHOL_CONTEXT)), F.lit(" "), F.left(r["tail"], F.lit(ALCOHOL_CONTEXT)))
    made = F.transform(found, lambda r: F.struct(_decimal(r["number"]).alias("value"), words(r).rlike(f"(?i){ALCOHOL_WORDS}").alias("is_alcohol")))
    none = F.array().cast("array<struct<value:double,is_alcohol:boolean>>")
    return F.when(text.isNull(), None).when(F.size(parts) < 2, none).otherwise(made)


def label_alcohol(text: Column) -> Column:
    """The percentages stated as alcohol; all of them if none is."""
    every = percentages(text)
    alcohol = F.filter(every, lambda p: p["is_alcohol"])
    return F.transform(F.when(F.size(alcohol) > 0, alcohol).otherwise(every), lambda p: p["value"])


def proofs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?iU){PROOF}"), F.lit(1)), _decimal)


def expected_alcohol(text: Column) -> Column:
    """The first percentage, or a value that is a bare number; null otherwise."""
    percent = F.regexp_extract(text, rf"(?U){NUMBER}{SPACE}*%", 1)
    bare = F.regexp_extract(text, rf"(?U)\A{SPACE}*{NUMBER}{SPACE}*\z", 1)
    return F.when(percent != "", _decimal(percent)).when(bare != "", _decimal(bare))


def unit_to_ml(unit: Column) -> Column:
    """Millilitres of a unit as written; the first that fits it whole."""
    out = F.when(F.lit(False), F.lit(0.0))
    for pattern, ml in UNITS:
        out = out.when(unit.rlike(rf"(?iU)\A(?:{pattern})\z"), F.lit(ml))
    return out


def quantities(text: Column) -> Column:
    """text and milliliters of every volume, in order."""
    group = lambda whole, k: F.regexp_extract(whole, f"(?iU){QUANTITY}", k)
    rows = F.transform(F.regexp_extract_all(text, F.lit(f"(?iU){QUANTITY}"), F.lit(0)), lambda w: F.struct(w.alias("whole"), group(w, 1).alias("amount"), group(w, 2).alias("unit")))
    return F.transform(rows, lambda r: F.struct(clean_spaces(r["whole"]).alias("text"), (_decimal(r["amount"]) * unit_to_ml(r["unit"])).alias("milliliters")))
