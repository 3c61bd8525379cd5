"""Predicates and parsers of single cells as Column expressions (null counts as missing)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cell patterns and blank sets that the results depend on. Each operator has its own set.
NUMBER = r"^\(?-?[\p{Nd},]+(\.\p{Nd}+)?%?\)?$"
CASTABLE = r"^[(\-+−]?\s*[\p{Nd},]+(\.\p{Nd}+)?\s*[)%*†§¶#‡]?$"
MERGED = r"\p{Nd}[\p{Nd},]*(\.\p{Nd}+)?\s+[(]?\p{Nd}"
RUN_OF_NUMBERS = r"^(\(?-?[\p{Nd},]+(\.\p{Nd}+)?%?\)?\s+){3,}\(?-?[\p{Nd},]+(\.\p{Nd}+)?%?\)?$"
VALUE = (
    r"(?i)^\(?(\p{Nd}{4}\s*[-–]\s*\p{Nd}{2,4}|(rs\.?|₹|inr)\s*[\p{Nd},]+(\.\p{Nd}+)?\s*(lakh|lakhs|crore|cr\.?|thousand|k)?"
    r"|[\p{Nd},]+(\.\p{Nd}+)?\s*(lakh|lakhs|crore|cr\.?|%)|\p{Nd}{1,2}[./-]\p{Nd}{1,2}[./-]\p{Nd}{2,4}|\p{Nd}{1,3}[.)])\)?$"
)
MONTH = r"(?i)^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?|sep(t(ember)?)?|oct(ober)?|nov(ember)?|dec(ember)?)\.?$"
YEAR_CELL = r"^(19|20)\p{Nd}{2}\s*([-–/]\s*\p{Nd}{2,4})?$"
FLOAT = r"^[+-]?(\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)([eE][+-]?\p{Nd}+)?$"
MISSING = ("", "nan", "None")
BLANK = ("", "nan", "none", "-", "–", "—")
HEADER_PLACEHOLDERS = ("", "nan", "none", "-", "–", "—", "−", "n.a.", "na", "n/a", "nil", "..", "...", "*")
NUMERIC_PLACEHOLDERS = (*HEADER_PLACEHOLDERS, "neg", "negligible")
SCORE_PLACEHOLDERS = ("-", "–", "—", "−", "na", "n.a.", "n/a", "nil", "..", "...", "*")
FOOTNOTES = "%*†§¶#‡"
#: Decimal digits of other scripts (as the character database has them) and what they stand for.
DIGITS = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd")
DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in DIGITS)


def strip(v: Column) -> Column:
    """Without white space at the ends, any Unicode kind; null becomes empty."""
    return F.regexp_replace(F.coalesce(v, F.lit("")), r"(?U)^\s+|\s+$", "")


def ascii_digits(v: Column) -> Column:
    """With decimal digits of any script as 0 to 9."""
    return F.when(v.rlike(r"[^\x00-\x7F]"), F.translate(v, DIGITS, DIGIT_VALUES)).otherwise(v)


def missing(v: Column) -> Column:
    return strip(v).isin(*MISSING)


def populated(v: Column) -> Column:
    return ~missing(v)


def is_number(v: Column) -> Column:
    return strip(v).rlike(NUMBER)


def is_value(v: Column) -> Column:
    """A number, a fiscal year, an amount with a unit, a date or a serial."""
    return strip(v).rlike(NUMBER) | strip(v).rlike(VALUE)


def is_float(v: Column) -> Column:
    return F.regexp_replace(strip(v), ",", "").rlike(FLOAT)


def is_month(v: Column) -> Column:
    return strip(v).rlike(MONTH)


def is_year(v: Column) -> Column:
    """A fiscal span anywhere, or a bare year of 1900 to 2099."""
    return strip(v).rlike(r"\p{Nd}{4}[-–]\p{Nd}{2}") | strip(v).rlike(r"^(19|20)\p{Nd}{2}$")


def words(v: Column) -> Column:
    return F.filter(F.split(strip(v), r"(?U)\s+"), lambda w: w != "")


def word_count(v: Column) -> Column:
    return F.size(words(v))


def lettered_words(v: Column) -> Column:
    """How many runs of two letters and more."""
    return F.regexp_count(F.coalesce(v, F.lit("")), F.lit("[A-Za-z]{2,}"))


def to_number(v: Column) -> Column:
    """One formatted number: brackets negate, footnote signs, per cent and thousands commas go; else null."""
    s = strip(v)
    signed = F.regexp_replace(s, "^[−–]", "-")
    ends = f"[{FOOTNOTES}]+$"
    negative = s.startswith("(") & F.regexp_replace(signed, ends, "").endswith(")")
    bare = strip(F.regexp_replace(signed, r"^[()]+|[()]+$", ""))
    bare = ascii_digits(F.regexp_replace(strip(F.regexp_replace(bare, ends, "")), ",", ""))
    value = F.when(bare.rlike(FLOAT), bare.try_cast("double"))
    return F.when(F.lower(s).isin(*NUMERIC_PLACEHOLDERS), F.lit(None).cast("double")).otherwise(F.when(negative, -value).otherwise(value))
