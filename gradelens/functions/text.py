"""Text normalisers over whole strings, as built-in column expressions.

Whitespace means the Unicode whitespace of Python's ``str.split``; a line ends at ``\\n``
only. Java's own ``\\s`` and ``$`` are narrower and wider than that, so both are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the whitespace code points
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# the same set as a pattern: the control characters one by one, the rest as separators
WS = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\p{Z}]"
WS_NOT_NEWLINE = r"[ \t\x0b\f\r\x1c\x1d\x1e\x1f\x85\p{Z}]"


def lines(text: Column) -> Column:
    """Lines of a text; a trailing newline gives a last empty line."""
    return F.split(text, "\n", -1)


def strip(text: Column) -> Column:
    """Text without whitespace at either end."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, WS + "+", -1)
    )


def spaced(text: Column) -> Column:
    """The words joined by one blank: equal for two texts exactly when their words are."""
    return F.regexp_replace(strip(text), WS + "+", " ")


def squash(text: Column) -> Column:
    """Text without any whitespace (N5); blanks go first, by a native search."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), WS + "+", "")


def squash_lines(text: Column) -> Column:
    """Text without whitespace inside its lines; the line breaks stay."""
    return F.regexp_replace(text, WS_NOT_NEWLINE + "+", "")


def number_lines(text: Column) -> Column:
    """Replace each line's diff marker by the line's number and a blank."""
    numbered = F.transform(
        lines(text),
        lambda line, i: F.concat((i + 1).cast("string"), F.lit(" "), F.substr(line, F.lit(2))),
    )
    return F.array_join(numbered, "\n")


def strip_markers(text: Column) -> Column:
    """Drop the first character of every line."""
    return F.regexp_replace(text, "(?md)^.", "")


def drop_line_numbers(text: Column) -> Column:
    """Drop the first two characters of every line.

    Right for one-digit line numbers only, which is what the published scores rest on.
    """
    return F.regexp_replace(text, "(?md)^.{1,2}", "")


def remove_comments(text: Column) -> Column:
    """Delete block comments, ``//`` to the line's end, and lines that start with ``#``."""
    slashes = F.when(
        F.contains(text, F.lit("//")) | F.contains(text, F.lit("/*")),
        F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", ""),
    ).otherwise(text)
    return F.when(
        F.contains(text, F.lit("#")),
        F.regexp_replace(slashes, rf"(?md)^{WS}*#[^\n]*", ""),
    ).otherwise(slashes)
