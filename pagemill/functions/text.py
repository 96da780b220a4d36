"""Text expressions shared by all operators. The patterns are written so that Java's and RE2's dialects agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and str.strip see it (Java's \s alone misses no-break and ideographic spaces).
WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
#: The same, one by one: trimming by characters is linear, a pattern anchored at the end is not.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word as Python's \w+ sees it, without combining marks.
WORD = r"[\p{L}\p{N}_]+"
#: All but letters and combining marks.
NOT_LETTERS = r"[^\p{L}\p{M}]+"
#: All but letters, combining marks and digits.
NOT_ALNUM = r"[^\p{L}\p{M}\p{N}]+"


def norm(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, WS, " "))


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.btrim(c, F.lit(WS_CHARS))


def word_count(c: Column) -> Column:
    """Number of word runs; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0))


def ws_words(c: Column) -> Column:
    """Array of the white-space separated words; empty for null and blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WS), lambda x: x != "")


def fingerprint(c: Column) -> Column:
    """SHA-256 of the white-space normalised text; null counts as empty."""
    return F.sha2(norm(F.coalesce(c, F.lit(""))), 256)


def lines(c: Column) -> Column:
    """Array of the normalised, non-empty lines; empty for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), norm), lambda x: x != "")


def letters_key(c: Column) -> Column:
    """Letters and combining marks of the lower-cased text: the key under which lines are the same."""
    return F.regexp_replace(F.lower(c), NOT_LETTERS, "")


def alnum_key(c: Column) -> Column:
    """Letters, combining marks and digits of the lower-cased text."""
    return F.regexp_replace(F.lower(c), NOT_ALNUM, "")


def sanitize(c: Column, longest: int) -> Column:
    """Without control characters, trimmed and cut; null is empty."""
    return F.left(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x{00}-\x{1f}\x{7f}]", "")), F.lit(longest))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def simple_markdown(c: Column) -> Column:
    """Bold, block quotes and line breaks of an answer as HTML; everything else escaped."""
    x = F.regexp_replace(html_escape(c), r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>")
    x = F.regexp_replace(x, r"(?m)^&gt; (.*)$", "<blockquote>$1</blockquote>")
    return F.replace(x, F.lit("\n"), F.lit("<br>"))


def time_ago(at: Column, now: Column) -> Column:
    """How long ago in the largest whole unit: just now, Nm ago, Nh ago, Nd ago; null stays null."""
    s = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1_000_000)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(f"{u} ago"))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))
