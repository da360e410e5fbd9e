"""Text expressions. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank (the Unicode whitespace of
# Python's str.strip and of \s in its re module), as a set and as the pattern of
# a run of them.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The intersection spares most characters the test of every rare blank, which made counting words many times slower.
_RARE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_BLANK = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0" + _RARE
BLANKS = f"[{_BLANK}]+"
NOT_BLANKS = f"[^{_BLANK}]+"
ELLIPSIS = "\u2026"


def strip(text: Column) -> Column:
    """Drop blanks at both ends, in time linear in the text."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Runs of non-blank characters, in order; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def falsy(value: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def doc_text(title: Column, body: Column) -> Column:
    """Title, blank line, body."""
    empty = F.lit("")
    return strip(F.concat(F.coalesce(title, empty), F.lit("\n\n"), F.coalesce(body, empty)))


def clip(text: Column, length: int) -> Column:
    """Hard cut after ``length`` code points."""
    return F.substring(text, 1, length)


def snippet(text: Column, length: int = 220) -> Column:
    """Cut after ``length`` code points and mark the cut; 0 means no cut."""
    if not length:
        return text
    cut = F.concat(clip(text, length), F.lit(ELLIPSIS))
    return F.when(F.length(text) > length, cut).otherwise(text)
