"""Text as columns: the squashed form that comparisons are made on, its positions, spellings and spans.

Squashed text has letters and digits only, lower case and without accents: for each character the first one of its
compatibility decomposition. Positions are counted from 0.
"""

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import SPELLINGS

NUL = "\0"
#: White space as texts may hold it: Unicode's, and the separators of ASCII that count as such too.
SPACE = r"[\s\x1C-\x1F]"


def squash_character(ch: str) -> str:
    """The squashed form of one character: one character or none."""
    base = unicodedata.normalize("NFKD", ch)[0].lower()
    return base if len(base) == 1 and base.isalnum() else ""


def squash_text(text: str) -> str:
    return "".join(map(squash_character, text))


@cache
def _character_map() -> tuple[str, str]:
    """Characters that squash to another, and these; letters and digits by Java's rule that squash to none go to a space."""
    changed = [(c, s) for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and (s := squash_character(c) or (" " if unicodedata.category(c)[0] in "LN" else c)) != c]
    return "".join(c for c, _ in changed), "".join(s for _, s in changed)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What squashing takes out of ASCII texts, and its white space.
_OTHERS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_ASCII_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


def is_ascii(col: Column) -> Column:
    """Whether no character needs more than one byte: then a few characters by name do for Unicode's classes, at a fraction of
    the time."""
    return F.length(col) == F.octet_length(col)


def flatten(col: Column) -> Column:
    """Each character's squashed form in its place; what squashes to nothing stays as something that is no letter or digit."""
    return F.when(is_ascii(col), F.translate(col, _UPPER, _LOWER)).otherwise(F.translate(col, *_character_map()))


def squash_flat(flat: Column) -> Column:
    return F.regexp_replace(flat, r"[^\p{L}\p{N}]", "")


def squash(col: Column) -> Column:
    """Letters and digits of `col` in lower case without accents; null for null."""
    return F.when(is_ascii(col), F.translate(col, _UPPER + _OTHERS, _LOWER)).otherwise(squash_flat(F.translate(col, *_character_map())))


def positions(flat: Column) -> Column:
    """The place in the text of each character that squashing keeps."""
    marked = F.when(is_ascii(flat), F.translate(flat, _OTHERS, " " * len(_OTHERS))).otherwise(F.regexp_replace(flat, r"[^\p{L}\p{N}]", " "))
    return F.array_remove(F.transform(F.split(marked, ""), lambda c, i: F.when(c > " ", i).otherwise(-1)), -1)


def fold_spelling(squashed: Column) -> Column:
    """One spelling for those that are taken as the same word, each pair applied to what the one before left."""
    for variant, standard in SPELLINGS:
        squashed = F.replace(squashed, F.lit(variant), F.lit(standard))
    return squashed


#: In folded text, where a spelling has a letter less.
GAP = "\x01"


def kept_letters(variant: str, standard: str) -> list[int]:
    """For each letter of the standard spelling, which letter of the variant it stands for: spread evenly, first to last."""
    return [round(k * (len(variant) - 1) / (len(standard) - 1)) for k in range(len(standard))]


def has_variant(squashed: Column) -> Column:
    return squashed.rlike("|".join(variant for variant, _ in SPELLINGS))


def fold_in_place(squashed: Column) -> Column:
    """`fold_spelling` with as many characters as before, so that each keeps its place: a GAP stands for a letter that goes.

    Gaps that an earlier pair has left may lie between the letters of a variant, and stay where they are.
    """
    folded = squashed
    for variant, standard in SPELLINGS:
        letter = dict(zip(kept_letters(variant, standard), standard, strict=True))
        pattern = f"({GAP}*)".join(variant)
        given = "".join(letter.get(k, GAP) + (f"${k + 1}" if k + 1 < len(variant) else "") for k in range(len(variant)))
        folded = F.regexp_replace(folded, pattern, given)
    return F.when(has_variant(squashed), folded).otherwise(squashed)


def without_gaps(folded: Column) -> Column:
    return F.replace(folded, F.lit(GAP), F.lit(""))


def fold_positions(folded: Column) -> Column:
    """For each character that `without_gaps` leaves of a text folded in place, its place in the text before."""
    at = F.transform(F.split(folded, ""), lambda c, i: F.when((c != GAP) & (c != ""), i))
    return F.filter(at, lambda i: i.isNotNull())


def shared_characters(needle: Column, text: Column) -> Column:
    """How many characters of `needle` can be paired off with equal ones of `text`, wherever they stand."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(needle, "")), F.lit(0), lambda total, c: total + F.least(count(needle, c), count(text, c)))


def strip(col: Column) -> Column:
    """`col` without the white space around it."""
    return F.when(is_ascii(col), F.btrim(col, F.lit(_ASCII_SPACE))).otherwise(F.regexp_replace(col, rf"(?U)\A{SPACE}+|{SPACE}+\z", ""))


def clean_spaces(col: Column) -> Column:
    """`col` without the white space around it, and single spaces within."""
    plain = F.regexp_replace(col, r"[ \t-\r\x1C-\x1F]{2,}|[\t-\r\x1C-\x1F]", " ")
    return F.trim(F.when(is_ascii(col), plain).otherwise(F.regexp_replace(col, rf"(?U){SPACE}+", " ")))


def find_exact(hay: Column, needle: Column) -> Column:
    """The place of the first occurrence, or null; an empty needle is nowhere."""
    at = F.position(needle, hay)
    return F.when((F.length(needle) > 0) & (at > 0), at - 1)


def claim(hay: Column, start: Column, end: Column) -> Column:
    """`hay` with NULs in place of a span, so that no other field can use it; unchanged where start is null."""
    claimed = F.concat(F.substring(hay, F.lit(1), start), F.repeat(F.lit(NUL), end - start), F.substring(hay, end + 1, F.length(hay)))
    return F.coalesce(claimed, hay)


def raw_span(raw: Column, places: Column, start: Column, end: Column, whole_words: bool = False) -> Column:
    """The text of a squashed span with single spaces; with `whole_words` it grows to the white space around it."""
    first, last = F.get(places, start), F.get(places, end - 1) + 1
    span = F.substring(raw, first + 1, last - first)
    if whole_words:
        begins = (first == 0) | F.substring(raw, first, F.lit(1)).rlike(rf"(?U){SPACE}")
        before = F.when(begins, "").otherwise(F.regexp_extract(F.substring(raw, F.lit(1), first), r"(?U)([^\s\x1C-\x1F]*+)\z", 1))
        after = F.regexp_extract(F.substring(raw, last + 1, F.length(raw)), r"(?U)\A([^\s\x1C-\x1F]*)", 1)
        span = F.concat(before, span, after)
    return clean_spaces(span)


def format_g(value: Column) -> Column:
    """A number of up to six significant digits as short as it goes: 45.0 gives 45, 13.5 gives 13.5."""
    whole = F.length(F.abs(value).cast("long").cast("string"))
    rounded = F.when(whole >= 6, F.round(value, 0)).when(whole == 5, F.round(value, 1)).when(whole == 4, F.round(value, 2)).when(whole == 3, F.round(value, 3)).otherwise(F.round(value, 4))
    return F.regexp_replace(F.format_string("%.4f", rounded), r"\.?0+$", "")
