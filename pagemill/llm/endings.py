"""How a text ends: shared by the operators for cut-off answers (problem 1) and cut-off documents (problem 10).

``cut`` decides from the terminal context: marks put after the cut are taken off, then the last line is a closing line of its own,
or the text ends with a sentence mark that really closes a sentence, or it stops inside a word or sentence. What closes a text is
learnt from all texts of the corpus (``learn``): the last lines that many of them share, and for each frequent word how often a
sentence ends with it and how often one goes on behind it; a stop behind a word that no sentence ends with was put there after the
cut. Beside that stand fixed shapes of closing lines (signature, tags, contact, price, reference, address, list).
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS_CHARS
from ..session import materialize

# Marks that someone puts after a cut.
AFTER_CUT = re.compile(r"(?:\s|\u200b|\ufeff|\ufffd|\u2026|\.{2,}+|[\[(<{]\s*(?:\u2026|\.{2,}|more|read more|continued?|cont(?:inue)?d?\.?|truncated|cut(?: off)?|snip(?:ped)?)\s*[\])>}]|[\[({<]$|(?:read|see|show|view) more\s*[\u00bb\u203a>\u2192]*$|continue reading\s*[\u00bb\u203a>\u2192]*$|[\u2192\u00bb\u203a]$|<[a-z/][^<>]{0,40}$|&[a-z#0-9]{0,8};?$)+$", re.I)
# Marks that end a sentence, and what may follow them.
STOPS = ".!?\u0964\u0965\u3002\uff01\uff1f\u061f\u06d4"
STOPS_SET = frozenset(STOPS)
CLOSERS = "\"'\u201d\u2019\u00bb\u203a)]}*_`\u201c\u2018"
LAST_WORD = re.compile(r"(?:^|\s)([^\W\d_]\S*?)[.\u0964]$")
# Abbreviations after which a sentence goes on.
ABBREVIATION = re.compile(r"(?:^|[\s(])(?:rs|no|nos|mr|mrs|ms|dr|st|prof|sr|jr|vs|viz|cf|fig|approx|tel|ph|ext|ref|vol|pp|p|e\.g|i\.e|\u09a1\u09be|\u0921\u0949|\u09a1\u0983)\.$", re.I)
# Shapes of a closing line.
CLOSING_LINE = re.compile(
    r"^(?:[-*\u2022\u00b7\u25cf\u2013\u2014\u25aa+]\s*\S.*"  # list item or signature
    r"|\d{1,3}[.)]\s+\S.*"
    r"|(?:#[^\s#]+\s*)+"  # tags
    r"|(?:see\s+|more:\s*|source:\s*|link:\s*)?(?:https?://|www\.)\S+"
    r"|ref(?:erence)?\b[.:]?.{0,60}"
    r"|(?:contact|price|tags?|fare|rates?|cost|tel|ph|phone|mobile|call|e-?mail|fax|address|desk|office|source|author|by|written by|posted|published|filed(?: under)?|categor(?:y|ies)|keywords?|topics?|date|updated|hours|timings?|photos?|credits?|signed|editor|ref(?:erence)?|যোগাযোগ|মূল্য|টেগ|ট্যাগ|ঠিকনা|ঠিকানা|লেখক|উৎস|संपर्क|मूल्य|टैग|पता|लेखक|स्रोत)\s*[:：]\s*\S.{0,120}"
    r"|(?:tel|ph|phone|call|email|e-mail|fax)\b.*|\S+@\S+\.\S+"
    r"|(?:rs\.?|\u20b9|\$|\u20ac)\s*[\d,.]+(?:/-)?"
    r")$",
    re.I,
)


# Lines above a signature.
SALUTATION = re.compile(r"^(?:(?:(?:with )?(?:best|kind|warm)?\s*)(?:regards|wishes)|(?:yours )?(?:sincerely|faithfully|truly)(?: yours)?|thanks(?: and regards)?|thank you|cheers|respectfully|signed|ধন্যবাদ|ইতি|ধন্যবাদান্তে|শুভেচ্ছাৰে|धन्यवाद|सादर|भवदीय|आपका)\W*$", re.I)


class Terminal(NamedTuple):
    """What ``learn`` has learnt: closing lines, and words that go on."""

    closing: frozenset = frozenset()
    goes_on: frozenset = frozenset()


NOTHING_LEARNT = Terminal()


def skeleton(line: Column) -> Column:
    """A line with its numbers levelled and its white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"\p{Nd}+", "0"), r"\s+", " "))


def closing_lines(rows: DataFrame, text: str, *, least: int = 5, share: float = 0.001) -> frozenset:
    """Last lines (numbers levelled) of at least ``least`` different texts and ``share`` of all that have more than one line. Counted
    over all texts, by hash; with a share of 0.001 there can't be more than 1000."""
    x = rows.select(F.rtrim(F.col(text).cast("string"), F.lit(WS_CHARS)).alias("t")).where("t is not null and t <> ''")
    last = x.select(F.substring_index("t", "\n", -1).alias("l"), (F.instr("t", "\n") > 0).alias("many"), F.xxhash64("t").alias("h"))
    total = x.count()
    last = last.where("many").select(skeleton(F.col("l")).alias("l"), "h").withColumn("k", F.xxhash64("l"))
    often = [r["k"] for r in last.select("k", "h").distinct().groupBy("k").count().where(F.col("count") >= max(least, share * total)).select("k").collect()]
    return frozenset(r["l"] for r in last.where(F.col("k").isin(often)).groupBy("k").agg(F.min("l").alias("l")).collect()) if often else frozenset()


def going_on(rows: DataFrame, text: str, *, least: int = 1000, share: float = 1e-5, ends: float = 0.002) -> frozenset:
    """Words that stand ``least`` times and ``share`` of all words in the texts and end a sentence or line in under ``ends`` of the cases.
    Counted over all texts, in the tasks first; with a share of 1e-5 there can't be more than 100,000."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            stop, on = Counter(), Counter()
            for token, n in seen.items():
                bare = token.strip(STOPS + CLOSERS + "\n")
                if bare and len(bare) <= 40:  # a longer token is no word that recurs
                    (stop if token[-1] == "\n" or token.rstrip(CLOSERS)[-1:] in STOPS_SET else on)[bare] += n
            words = list(stop.keys() | on.keys())
            return pa.record_batch([pa.array(words, pa.string()), pa.array([stop[w] for w in words], pa.int64()), pa.array([on[w] for w in words], pa.int64())], names=["w", "stop", "on"])

        for b in batches:
            for t in b.column(0).to_pylist():
                for line in t.lower().split("\n"):
                    ws = line.split()
                    if ws:
                        ws[-1] += "\n"
                        seen.update(ws)
            if len(seen) > 500_000:
                yield rows()
                seen.clear()
        yield rows()

    texts = rows.select(F.col(text).cast("string").alias("t")).where("t is not null and t <> ''")
    c = texts.mapInArrow(count, "w string, stop bigint, on bigint").groupBy("w").agg(F.sum("stop").alias("stop"), F.sum("on").alias("on"))
    c = materialize(c, "word-ends")
    total = c.agg(F.sum(F.col("stop") + F.col("on"))).first()[0] or 0
    kept = c.where((F.col("on") >= max(least, share * total)) & (F.col("stop") <= ends * F.col("on")) & F.col("w").rlike(r"^[\p{L}\p{M}]+$"))
    return frozenset(r["w"] for r in kept.select("w").collect())


def learn(rows: DataFrame, text: str) -> Terminal:
    """The terminal contexts of all texts; at most 101,000 short strings."""
    return Terminal(closing_lines(rows, text), going_on(rows, text))


def _skeleton(line: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", line)).strip()


def stripped(text: str) -> str:
    """The text without white space and marks after the cut. Looked at in pieces from the end, as long as nothing is left of one."""
    while True:
        head, tail = text[:-400], AFTER_CUT.sub("", text[-400:])
        if tail or not head:
            return head + tail
        text = head


def ends_sentence(text: str) -> bool:
    """Whether the text's last character closes a sentence; brackets and quotes may follow a sentence mark, and a bracketed or
    quoted piece may follow a whole sentence."""
    x = text.rstrip()
    for _ in range(3):
        core = x.rstrip(CLOSERS + " ")
        if core and core[-1] in STOPS and not (core[-1] == "." and ABBREVIATION.search(core[-12:])):
            return True
        if x and x[-1] in ")]}\u201d\"\u00bb\u2019":
            pair = {")": "(", "]": "[", "}": "{", "\u201d": "\u201c", "\u00bb": "\u00ab", "\u2019": "\u2018"}.get(x[-1], x[-1])
            k = x.rfind(pair, 0, len(x) - 1)
            if k < 0 or len(x) - k > 200:
                return False
            x = x[:k].rstrip()
            continue
        return False
    return False


def _closes(line: str, learnt: Terminal) -> bool:
    return bool(CLOSING_LINE.match(line)) or _skeleton(line) in learnt.closing


def signed(head: str, last: str) -> bool:
    """Whether the last line is a name of a few words below a salutation; a line (a post, a place) may stand between."""
    above = [x.strip() for x in head.rstrip().rsplit("\n", 3)[-3:] if x.strip()]
    return len(last.split()) <= 6 and any(SALUTATION.match(x) for x in above[-2:])


def cut(text: str | None, learnt: Terminal = NOTHING_LEARNT) -> bool:
    """Whether a text stops inside a word or sentence, whatever was put after the cut. None and blank texts don't."""
    if not text or not text.strip():
        return False
    x = stripped(text)
    if not x:
        return False
    marked = len(x) < len(text.rstrip().rstrip("\u200b\ufeff"))
    if not marked:
        head, _, last = x.rpartition("\n")
        last = last.strip()
        if head.strip() and last and not ends_sentence(last):
            if signed(head, last):
                return False
            if _closes(last, learnt):
                before = head.rstrip().rpartition("\n")[2].strip()
                return not (ends_sentence(head) or _closes(before, learnt) or len(before) <= 80)
    if not ends_sentence(x):
        return True
    # a stop right behind a word that sentences go on from
    word = LAST_WORD.search(x[-60:])
    return bool(word) and word.group(1).lower() in learnt.goes_on
