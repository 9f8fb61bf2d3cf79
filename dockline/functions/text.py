"""Text / identifier / number cleaning as native Column expressions (no UDFs).

Spark's ``trim`` strips only U+0020, while the semantics we reproduce strip any
Unicode whitespace, so every whitespace test uses ``(?U)\\s``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace stripped from both ends of a cell: every character Python's
# str.isspace() accepts (the strip semantics being reproduced), derived by rule.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
# Integer text written with a trailing ".0" by a spreadsheet (80117458.0).
_DOT_ZERO = r"^[+-]?\d*\.0+$"
# What counts as a number: optional sign, digits with an optional fraction or a
# bare fraction, optional exponent, optional surrounding blanks.  "1,000",
# "$5", "0x10" and "1d" are not numbers (try_cast alone would accept "1d").
NUMERIC_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Identifier text that stands for a missing value (any case).
ID_NULL_TEXT = ("", "nan", "none", "nat")
# Text that a missing value may have been stringified into,
# compared upper-cased.
MATCH_NULL_TEXT = ("", "NAN", "NAT", "NONE", "<NA>")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once for all its places in it.

    As the variable of a lambda it stays one value wherever the optimizer moves the
    expression to (a filter pushed below a projection gets the whole text of its columns,
    and branches of a CASE share nothing); the rest is evaluated without generated code,
    which for long CASE chains is more than the JVM compiles."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ustrip(c: Column) -> Column:
    """Unicode-aware strip of both ends (a character-set trim, no regex).  A text that
    begins and ends with printable ASCII has nothing to strip, which is cheaper to see:
    texts are compared byte by byte, so those from "!" to below DEL begin with it."""
    def printable(text: Column) -> Column:
        return (text >= "!") & (text < "\x7f")
    return F.when(printable(c) & printable(F.substring(c, -1, 1)), c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def blank_to_null(c: Column) -> Column:
    """B1: whitespace-only cell -> null."""
    return F.when(ustrip(c) == "", F.lit(None).cast("string")).otherwise(c)


def clean_text(c: Column) -> Column:
    """Null -> '', otherwise stripped."""
    return F.coalesce(ustrip(c), F.lit(""))


def clean_identifier(c: Column) -> Column:
    """Stripped text; null-like -> ''; '00123.0' -> '123'; other text kept as is.

    The ".0" repair is exact (decimal), so identifiers beyond 2^53 survive.
    """
    s = ustrip(c)
    repaired = s.try_cast("decimal(38,0)").cast("string")
    return (F.when(s.isNull() | F.lower(s).isin(*ID_NULL_TEXT), F.lit(""))
            .when(s.rlike(_DOT_ZERO), F.coalesce(repaired, s))
            .otherwise(s))


def to_number(c: Column) -> Column:
    """Lenient numeric parse: a number, or null when the text is not one."""
    return F.when(c.rlike(NUMERIC_RE), c.try_cast("double"))


def is_bad_number(c: Column) -> Column:
    """Present, not blank, and not a number."""
    return c.isNotNull() & (ustrip(c) != "") & to_number(c).isNull()


def match_key(c: Column) -> Column:
    """Upper-cased, whitespace-collapsed, stripped; null-like text -> ''."""
    up = F.upper(F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(WHITESPACE)))
    return once(up, lambda key: F.when(key.isNull() | key.isin(*MATCH_NULL_TEXT), F.lit("")).otherwise(key))


def first_word(c: Column) -> Column:
    """First whitespace-separated word of the stripped text, case kept."""
    return F.split(ustrip(c), r"(?U)\s+").getItem(0)
