"""Text columns: normalisation, clean-up, quality gate."""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# What counts as white space for the two trims.
_COMMON_SPACE = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
RECOGNISER_SPACE = _COMMON_SPACE + "\u001c\u001d\u001e\u001f\u0085"
BROWSER_SPACE = _COMMON_SPACE + "\ufeff"
# Fixed value: characters that survive normalisation (Thai block, Latin, digits, marks).
ALLOWED = (
    "".join(map(chr, range(0x0E00, 0x0E80)))
    + string.ascii_letters + string.digits + " .,!?%()-/\n"
)

# Acceptance threshold, band edges, snippet length.
MIN_CONFIDENCE = 50.0
HIGH_CONFIDENCE = 80.0
SNIPPET_CHARS = 22



def outside(chars: str) -> str:
    """Pattern for any character but these, written as the ranges between them: the regex engine
    runs through such a class several times faster than through a negated one. Up to 255 each character
    is named, which makes a table of bits of them instead of one test per range."""
    ranges, low = [f"\\x{{{p:X}}}" for p in range(256) if chr(p) not in chars], 256
    for point in [*sorted({ord(c) for c in chars if ord(c) > 255}), 0x110000]:
        if point > low:
            ranges.append(f"\\x{{{low:X}}}-\\x{{{point - 1:X}}}")
        low = point + 1
    return "[" + "".join(ranges) + "]"


def any_of(chars: str) -> str:
    """Pattern for any of these characters."""
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


_NOT_ALLOWED = outside(ALLOWED)

# White space of browsers, behind a test that most characters fail at once: beyond 255 the regex
# engine asks one character after the other.
_BROWSER_BLANK = f"[[^!-~]&&{any_of(BROWSER_SPACE)}]"

# NFC quick check, decided in the JVM so that only text which may change goes to Python.
# Latin-1/extended Latin, Thai and general punctuation never compose or decompose
# (U+2000 and U+2001 do), and Thai marks move only when a mark of higher combining class
# stands before one of lower class.
_MAY_CHANGE = (
    r"[\x{0300}-\x{0DFF}\x{0E80}-\x{2001}\x{20D0}-\x{10FFFF}]"
    r"|[\x{0E48}-\x{0E4B}][\x{0E38}-\x{0E3A}]|[\x{0E38}\x{0E39}]\x{0E3A}"
)


@F.pandas_udf(T.StringType())
def _nfc_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def may_change_under_nfc(text: Column) -> Column:
    return text.rlike(_MAY_CHANGE)


def nfc(text: Column) -> Column:
    """F1. Text the quick check clears is never copied to Python."""
    return F.coalesce(_nfc_batch(F.when(may_change_under_nfc(text), text)), text)


def keep_allowed(text: Column) -> Column:
    """F2. Every other character becomes one space."""
    return F.regexp_replace(text, _NOT_ALLOWED, " ")


def collapse(text: Column) -> Column:
    """F3. White space runs to one space, ends trimmed, null to empty; case is kept."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def normalize(text: Column) -> Column:
    """F1, F2 and F3 in this order."""
    return collapse(keep_allowed(nfc(text)))


def _begins_plain(text: Column) -> Column:
    """Whether the first character is of one of two ranges without white space, told by
    comparing bytes: most texts begin and end so."""
    return ((text >= "!") & (text < "\x7f")) | ((text >= "\u00a1") & (text < "\u1680"))


def stripped(rows: DataFrame, name: str = "text") -> DataFrame:
    """P2. Recogniser output trimmed at both ends; rows without any text are dropped.

    ``btrim`` looks up each character at both ends in the whole set, which is left to the texts that
    do not begin and end plainly once blanks are gone. Each step is a column, so that no call is
    repeated inside one expression and the generated code stays short enough to be compiled."""
    rows = rows.where(has_text(F.col(name))).withColumn("_bare", F.trim(name))
    rows = rows.withColumn("_last", F.substring("_bare", -1, 1))
    plain = _begins_plain(F.col("_bare")) & _begins_plain(F.col("_last"))
    return rows.withColumn(name, F.when(plain, F.col("_bare")).otherwise(strip(F.col("_bare")))).drop("_bare", "_last")


def strip(text: Column) -> Column:
    """P2, first half: trim recogniser output at both ends."""
    return F.btrim(text, F.lit(RECOGNISER_SPACE))


def has_text(text: Column) -> Column:
    """P2, second half: something is left after ``strip``. Stops at the first such character."""
    return text.rlike(outside(RECOGNISER_SPACE))


def browser_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BROWSER_SPACE))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(outside(BROWSER_SPACE)), F.lit(False))


def second_engine_cleanup(text: Column) -> Column:
    """F4. Line breaks to a space, then runs of two or more blanks to one, trimmed."""
    joined = F.regexp_replace(browser_trim(text), r"\r?\n+", " ")
    return browser_trim(F.regexp_replace(joined, _BROWSER_BLANK + "{2,}", " "))


def accepted(clean_text: Column, confidence: Column, minimum: float = MIN_CONFIDENCE) -> Column:
    """P6. Non-empty text with enough confidence; an unknown confidence is not enough."""
    return (clean_text != "") & F.coalesce(confidence >= minimum, F.lit(False))


def confidence_band(
    confidence: Column, medium: float = MIN_CONFIDENCE, high: float = HIGH_CONFIDENCE
) -> Column:
    """P7."""
    return (
        F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")
    )


def snippet(text: Column, length: int = SNIPPET_CHARS) -> Column:
    """P8."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)
