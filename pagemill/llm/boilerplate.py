"""Page boilerplate mixed with main content (problem 3): site template removal.

A page is read as a tree of two levels: its lines, and the pieces of a line that menu marks separate. Each piece is levelled
(rare words, which are names, become a placeholder) and hashed; that is the element's hash, and a line's is that of its pieces.
Spark counts for every host on how many pages each element stands and from that how likely an element that one page of the host
has stands on another page of it as well, (m-1) over (n-1). A template's elements do, a paragraph's or a timetable's do not. The
host's own count decides; on hosts of fewer than ``few_pages`` pages, what all hosts show does: the mean of that over the pages
that have the element, where no host weighs more than ``few_pages`` times the share of its pages. Elements above
``recurs`` are deleted. Two kinds of element change from page to page and hang below one that
does not: the links of a sidebar below its heading, and the page's name at the end of a breadcrumb. A heading is an element
whose next line is mostly a title of another page; its run of title-like lines goes with it. Page tools vary as well; like
everything above the page's own heading they belong to the subtree that precedes the main content and go with it.

A title has at most 160 characters here, without its date; longer lines are no headings and no links.

Cost: four scans (words, titles, elements, labelling) and narrow shuffles of hashes, all combined before they are written; texts are
shuffled only where a page was delivered more than once.
The elements of a host are bounded by the lines of its pages; the joined sets are broadcast only below ``broadcast_rows``.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SEPARATOR = re.compile(r"\s*[|·»›>•▪●¦]\s*|\s{2,}|\t")
BREADCRUMB = re.compile(r"(?<!\s)\s++[»›>/→]\s+")
DATED = re.compile(r"\s*\(\d{1,2}\s+\S{3,9}(?:\s+\d{4})?\)\s*$")
TITLE_WORD = r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*"
_letters = regex.compile(r"[\p{L}\p{M}]+").findall
_title_words = regex.compile(TITLE_WORD).findall
_not_word = re.compile(r"\W+")
_word_character = re.compile(r"\w").search
_may_trail = re.compile(r"[»›>/→]").search
_may_part = re.compile(r"[|·»›>•▪●¦\t]|\s\s").search


def _words(text: str) -> list[str]:
    return _letters(text.lower())


class Words(frozenset):
    """Known words that remember the short pieces they levelled: menus come back on page after page."""

    def level(self, text: str) -> str:
        if len(text) > 60:
            return _level(text, self)
        memo = self.__dict__.setdefault("memo", {})
        x = memo.get(text)
        if x is None:
            if len(memo) >= 100_000:
                memo.clear()
            x = memo[text] = _level(text, self)
        return x


def levelled(text: str, known: frozenset) -> str:
    """Words of a piece, lower-cased; a placeholder stands for those not known and for capitalised ones behind the first, which
    are names. Where nothing but placeholders would be left, the words stay; empty where there is no word."""
    return known.level(text) if isinstance(known, Words) else _level(text, known)


def _level(text: str, known: frozenset) -> str:
    own = _letters(text)
    if not own:
        return ""
    first = own[0].lower()
    ws = [first if first in known else "*", *[w if w in known else "*" for w in own[1:]]]  # a capitalised word is in no lower-case set
    return " ".join(ws) if any(w != "*" for w in ws) else " ".join(own).lower()


def title_shape(text: str, known: frozenset) -> str:
    """A title's frame: its frequent words, and the script of the others."""
    return " ".join(w if w in known else ("L" if w[0] < "ɐ" else "I") for w in _title_words(text.lower()))


def pieces_of(line: str) -> list[str]:
    return [p for p in SEPARATOR.split(line) if p] if _may_part(line) else [line] if line else []


def ends_sentence(line: str) -> bool:
    return line.rstrip("'\"”’)]")[-1:] in tuple(".!?।॥…")


class Shapes(frozenset):
    """Title shapes that remember the short lines they were asked about."""

    def fit(self, line: str, known: frozenset) -> bool:
        memo = self.__dict__.setdefault("memo", {})
        x = memo.get(line)
        if x is None:
            if len(memo) >= 100_000:
                memo.clear()
            x = memo[line] = title_shape(line, known) in self
        return x


def title_like(line: str, shapes: frozenset, known: frozenset) -> bool:
    if len(line) > 400 or line.endswith((".", "।")):
        return False
    x = line.strip()
    if x.endswith(")"):
        x = DATED.sub("", x)
    if not x or len(x) > 160 or "|" in x or ends_sentence(x) or x[0] in "-•*#" or x[0].isdecimal():
        return False
    return shapes.fit(x, known) if isinstance(shapes, Shapes) else title_shape(x, known) in shapes


class Names(frozenset):
    """A page's names by their word characters, with what a line needs to be one of them."""

    def __init__(self, names=()):
        self.first, self.longest = frozenset(n[:1] for n in self), 400 + max(map(len, self), default=0)


def own_titles(title: str | None) -> Names:
    """The page's name: its title, and its parts where a site's name is put before or behind."""
    if not title or not title.strip():
        return Names()
    x = re.sub(r"\s+", " ", title.strip())
    out = {x}
    for m in re.finditer(r"\s+[-|–—·:»]\s+", x):
        out |= {x[: m.start()].strip(), x[m.end() :].strip()}
    return Names(_not_word.sub("", t.lower()) for t in out if t)


def _same(line: str, names: Names) -> bool:
    if not names or len(line) > names.longest:
        return False
    m = _word_character(line)
    return (m.group().lower()[:1] if m else "") in names.first and _not_word.sub("", line.lower()) in names


def elements(content: str, title: str | None, words: frozenset, shapes: frozenset, title_words: frozenset) -> dict[str, bool]:
    """Levelled element -> whether the next line is the title of another page, for the elements of one page."""
    lines = [x.strip() for x in content.split("\n") if x.strip()]
    names, out = own_titles(title), {}
    for i, line in enumerate(lines):
        after = i + 1 < len(lines) and title_like(lines[i + 1], shapes, title_words) and not _same(lines[i + 1], names)
        pieces = pieces_of(line)
        for p in pieces:
            k = levelled(p, words)
            if k:
                out[k] = out.get(k, False) or (after and len(pieces) == 1)
    return out


def noise_lines(content: str | None, title: str | None, template: set, heads: set, words: frozenset, shapes: frozenset, title_words: frozenset) -> list[int]:
    """Numbers (from 1) of the lines that belong to the site, not to the page. ``template`` and ``heads`` are the host's elements."""
    if not content or not content.strip():
        return []
    lines = [x.strip() for x in content.split("\n")]
    names = own_titles(title)
    at = [i for i, x in enumerate(lines) if x]
    kinds: dict[int, str] = {}
    for i in at:
        pieces = [(p, k) for p, k in ((p, levelled(p, words)) for p in pieces_of(lines[i])) if k]
        keys = [k for _, k in pieces]
        whole = levelled(lines[i], words) if len(pieces) > 1 else ""
        if pieces and (all(k in template for k in keys) or (whole and whole in template)):
            kinds[i] = "head" if len(pieces) == 1 and keys[0] in heads else "template"
        else:
            trail = [p for p in BREADCRUMB.split(lines[i]) if p.strip()] if _may_trail(lines[i]) else ()
            if len(trail) > 1 and all(levelled(p, words) in template for p in trail[:-1]):
                kinds[i] = "template"
                if not names:
                    names = own_titles(trail[-1])
    # the links below a sidebar's heading
    run, in_run = set(), False
    for i in at:
        if kinds.get(i) == "head":
            in_run = True
        elif i in kinds or _same(lines[i], names) or not title_like(lines[i], shapes, title_words):
            in_run = False
        elif in_run:
            run.add(i)
    heading = next((i for i in at if _same(lines[i], names)), None)
    if heading is None:
        # no title: the heading is the title-like line before the first sentence of the body; outside a sidebar if there is one
        first = next((i for i in at if i not in kinds and ends_sentence(lines[i]) and len(_words(lines[i])) > 5), None)
        titles = [i for i in at if first is not None and i < first and i not in kinds and title_like(lines[i], shapes, title_words)]
        free = [i for i in titles if i not in run]
        heading = free[0] if free else titles[-1] if titles else None
    run.discard(heading)
    kinds |= dict.fromkeys(run, "link")
    if heading is not None:  # the page's own content begins with its heading; what stands above it is the site's
        kinds |= {i: "above" for i in at if i < heading and i not in kinds}
        kinds.pop(heading, None)
    return [i + 1 for i in sorted(kinds)]


def _source(pages: DataFrame, page_id: str, host: str, title: str, content: str) -> DataFrame:
    from .site_lines import site_of

    return pages.select(F.col(page_id).alias("id"), F.coalesce(site_of(F.col(host).cast("string")), F.lit("")).alias("host"), F.col(title).cast("string").alias("title"), F.col(content).cast("string").alias("t")).where("id is not null and t is not null")


def _once(src: DataFrame, broadcast_rows: int) -> DataFrame:
    """Each page once: only those delivered more than once are shuffled."""
    again = materialize(src.groupBy("id").count().where("count > 1").select("id"), "delivered-again")
    again = F.broadcast(again) if again.count() <= broadcast_rows else again
    return src.join(again, "id", "left_anti").unionByName(src.join(again, "id", "left_semi").dropDuplicates(["id"]))


def _words_of_hosts(batches):
    """host hash and word, each once for a good part of a task."""
    seen: set = set()

    def rows():
        hosts, words = zip(*seen) if seen else ((), ())
        return pa.record_batch([pa.array(hosts, pa.int64()), pa.array(words, pa.string())], names=["h", "w"])

    for b in batches:
        for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen.update((h, w) for w in set(_letters(t.lower())))
        if len(seen) > 1_000_000:
            yield rows()
            seen.clear()
    yield rows()


def _vocabulary(src: DataFrame, most: int) -> tuple[frozenset, frozenset, frozenset]:
    """(words, shapes, title words): words of at least 2 % of the hosts (3 at least), frames of at least 0.05 % of the titles, so that
    there are at most 2000, and the words these keep, which 2 % of the titles have. Were there more than ``most`` words, which the
    frequent words of no handful of languages are, more hosts would have to have one."""
    hosts = src.select("host").distinct().count()
    per = src.select(F.xxhash64("host").alias("h"), "t").mapInArrow(_words_of_hosts, "h bigint, w string").distinct().groupBy("w").count()
    per = materialize(per.where(F.col("count") >= max(min(3, hosts), 0.02 * hosts)), "host-words")
    need = 0
    while per.where(F.col("count") > need).count() > most:
        need = max(2 * need, hosts // 50)
    words = frozenset(r["w"] for r in per.where(F.col("count") > need).select("w").collect())
    titles = src.where("title is not null").select(F.regexp_replace("title", r"\s+[-|–—]\s+.*$", "").alias("title")).distinct()
    n = titles.count()
    tw = titles.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(TITLE_WORD), F.lit(0)))).alias("w")).groupBy("w").count()
    known = frozenset(r["w"] for r in tw.where(F.col("count") >= max(3, 0.02 * n)).select("w").collect())
    kept = F.array(*[F.lit(w) for w in sorted(known)]) if known else F.array().cast("array<string>")
    tokens = F.regexp_extract_all(F.lower("title"), F.lit(TITLE_WORD), F.lit(0))
    shape = F.array_join(F.transform(tokens, lambda w: F.when(F.array_contains(kept, w), w).when(w < "ɐ", "L").otherwise("I")), " ")
    counts = titles.select(shape.alias("s")).where("s <> ''").groupBy("s").count()
    return words, frozenset(r["s"] for r in counts.where(F.col("count") >= max(2, 0.0005 * n)).select("s").collect()), known


def boilerplate_lines(pages: DataFrame, *, page_id: str = "raw_id", host: str = "seed_url", title: str = "title", content: str = "content", recurs: float = 0.4, few_pages: int = 20, most_words: int = 20_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """page_id, line_no: every line that belongs to the page's site, once. Line numbers count from 1 at each line feed.

    Null ids and null or blank contents give no row; blank lines are never one. A null title is no obstacle: a page's heading
    is then the last title-like line before its first paragraph. Pages of one host without letter case and last slash belong
    together; null hosts are one host. Pages are taken whole. Other columns are ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    src = _source(pages, page_id, host, title, content)
    shared = spark.sparkContext.broadcast(_vocabulary(src, most_words))  # at most most_words and some 3000 short strings

    def emit(batches):
        words, shapes, known = shared.value
        words, shapes = Words(words), Shapes(shapes)
        for b in batches:
            hosts, keys, heads = [], [], []
            for h, title_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for k, after in elements(t, title_, words, shapes, known).items():
                    hosts.append(h)
                    keys.append(k)
                    heads.append(int(after))
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(keys, pa.string()), pa.array(heads, pa.int32())], names=["host", "k", "head"])

    one = _once(src, broadcast_rows)
    found = one.select("host", "title", "t").mapInArrow(emit, "host string, k string, head int")
    # the words of an element are only needed as its hash from here on
    per_host = materialize(found.groupBy("host", F.xxhash64("k").alias("k")).agg(F.count("*").alias("m"), F.sum("head").alias("heads")), "elements")
    totals = one.groupBy("host").agg(F.count("*").alias("n"))
    x = per_host.join(totals, "host")
    # a host of few pages says little: its elements are scored over all hosts, where one of many pages weighs as one of few_pages
    x = x.withColumn("own", F.try_divide(F.col("m") - 1, F.col("n") - 1)).withColumn("weight", F.least(F.lit(1.0), F.lit(few_pages) / F.col("n")) * F.col("m"))
    x = x.withColumn("weight", F.when(F.col("n") > 1, F.col("weight")).otherwise(0.0))
    score = x.groupBy("k").agg(F.try_divide(F.sum(F.col("weight") * F.col("own")), F.sum("weight")).alias("again"), F.sum("m").alias("pages"), (F.sum("heads") / F.sum("m")).alias("head"))
    score = score.where("pages > 1").select("k", "again", (F.col("head") >= 0.5).alias("head"))
    # a host's own count decides where it has enough pages; on fewer, a timetable that it shows twice would pass
    decided = F.when(F.col("n") >= few_pages, F.col("own")).otherwise(F.col("again")) >= recurs
    # elements of each host; a host's are few, as each stands on a good part of its pages or of those of others
    of_host = materialize(x.join(score, "k").where(decided).groupBy("host").agg(F.collect_list("k").alias("template"), F.collect_list(F.when(F.col("head"), F.col("k"))).alias("heads")), "templates")
    small = of_host.select(F.sum(F.size("template")).alias("n")).first()["n"] or 0
    joined = src.join(F.broadcast(of_host) if small <= broadcast_rows else of_host, "host", "left")

    def label(batches):
        words, shapes, known = shared.value
        words, shapes = Words(words), Shapes(shapes)
        for b in batches:
            ids, nos = [], []
            for i, ti, t, tm, hd in zip(*(b.column(c).to_pylist() for c in range(5))):
                got = noise_lines(t, ti, _Hashed(tm), _Hashed(hd), words, shapes, known)
                ids += [i] * len(got)
                nos += got
            yield pa.record_batch([pa.array(ids, b.column(0).type), pa.array(nos, pa.int32())], names=["id", "line_no"])

    kind = src.schema["id"].dataType.simpleString()
    out = joined.select("id", "title", "t", "template", "heads").mapInArrow(label, f"id {kind}, line_no int")
    return out.distinct().withColumnRenamed("id", page_id)


class _Hashed:
    """A set of elements by their hash (xxhash64 with seed 42, as Spark makes it)."""

    __slots__ = ("_set",)
    _memo: dict = {}

    def __init__(self, hashes):
        self._set = frozenset(hashes or ())

    def __contains__(self, text: str) -> bool:
        h = self._memo.get(text)
        if h is None:
            import xxhash

            h = xxhash.xxh64_intdigest(text.encode(), 42)
            h = h - (1 << 64) if h >= 1 << 63 else h
            if len(self._memo) > 100_000:
                self._memo.clear()
            self._memo[text] = h
        return h in self._set


def main_content(pages: DataFrame, *, page_id: str = "raw_id", content: str = "content", **kw) -> DataFrame:
    """page_id, content: every page with its body lines only. A null content stays null."""
    gone = boilerplate_lines(pages, page_id=page_id, content=content, **kw).groupBy(page_id).agg(F.collect_set("line_no").alias("gone")).withColumnRenamed(page_id, "id")
    src = pages.select(F.col(page_id).alias("id"), F.col(content).cast("string").alias("t")).join(gone, "id", "left")
    kept = F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i + 1))
    return src.select(F.col("id").alias(page_id), F.array_join(kept, "\n").alias("content"))
