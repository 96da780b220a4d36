"""Cleaning the pages of a crawl: junk pages, block pages and copies go, boilerplate and widget lines go, gates keep what matters.

All steps are column expressions over one row a page; only line frequencies and the sums of a job are aggregated. A job's
boilerplate lines come back to its pages as one array of hashes, so lines are exploded once and never joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..session import materialize

MIN_PAGES, MIN_KEPT_WORDS, TOP_LINES, THRESHOLD = 10, 0.40, 6, 0.30
# Messages that stand where a page should be, and the window in which they are looked for.
SEARCH_BLOCK = ("unusual traffic", "really you sending", "our systems have detected")
OTHER_BLOCK = ("access denied", "403 forbidden", "429 too many requests", "just a moment", "attention required", "signaturedoesnotmatch", "email protection | cloudflare", "error 1020", "you have been blocked", "verify you are human")
BLOCK_WINDOW, SEARCH_WORDS, OTHER_WORDS = 700, 400, 120
# Whole lines that are buttons or widget labels.
UI_LINES = (
    "more", "view more", "read more", "read full story", "read the full story", "learn more", "know more", "see more", "see all", "view all",
    "click here", "continue reading", "load more", "show more", "get a free quote", "get a quote", "enquire now", "inquire now", "book now",
    "contact us", "share", "like", "tweet", "x", "whatsapp", "telegram", "facebook", "twitter", "linkedin", "pinterest", "email", "print",
    "advertisement", "advertisements", "sponsored", "post a comment", "no comments", "no comments:", "leave a reply", "leave a comment",
    "subscribe", "subscribe now", "login", "log in", "sign in", "sign up", "register", "menu", "search", "skip to content", "skip to main content",
    "back to top", "scroll to top", "close", "next", "previous", "prev", "home", "related", "related posts", "related articles", "you may also like",
    "recent posts", "popular posts", "trending", "tags", "categories", "loading...", "posted on google", "on this day", "follow us", "share this",
    "আৰু পঢ়ক", "অধিক পঢ়ক", "শ্বেয়াৰ", "বিজ্ঞাপন", "लोड अधिक", "और पढ़ें", "ज़्यादा पढ़ें",
)
UI_TRIM = " .:|-–—•»«>"
# Whole-line patterns of widgets, written for Java and RE2.
UI_PATTERNS = (
    r"(?i)^share on [\p{L}\p{N}_ ]+( \(opens in new window\))?$",
    r"(?i)^\(?opens in (a )?new (window|tab)\)?$",
    r"(?i)^comments?:?\s*\(?\p{Nd}*\)?$",
    r"(?i)^\p{Nd}+\s+(comments?|views?|shares?|likes?)$",
    r"(?i)^(©|copyright([^\p{L}\p{N}_]|$)).{0,80}$",
    r"(?i)^all rights reserved\.?$",
    r"(?i)^(powered|crafted|designed|developed) (with|by)([^\p{L}\p{N}_].{0,59})?$",
    r"^https?://\S+$",
    r"^[^\p{L}\p{N}]{1,6}$",
)
UI_PATTERN = "|".join(f"(?:{p})" for p in UI_PATTERNS)
# Lines that are kept wherever they stand.
DAY_LABEL = r"(?i)^(day|दिन|দিন)\s*\p{Nd}+\s*[:.\-–]?\s*$"
PROTECT = r"(₹|(^|[^\p{L}\p{N}_])Rs\.?\s?\p{Nd}|(^|[^\p{L}\p{N}_])INR([^\p{L}\p{N}_]|$)|\$\s?\p{Nd}|€\s?\p{Nd}|@[\p{L}\p{N}_]+\.[\p{L}\p{N}_]|\+\p{Nd}{2}[\s\p{Nd}-]{8,}|(^|[^\p{L}\p{N}_])\p{Nd}{10}([^\p{L}\p{N}_]|$))"
# What is junk on every site, and the page that is a list by nature.
DEFAULT_JUNK = (
    r"[?&](share|replytocom|print|fbclid|gclid|utm_[a-z]+|nb)=", r"[?&](page|paged|p)=\d+", r"/page/\d+/?$", r"[?&](s|q|query|search)=",
    r"/feed/?$", r"/wp-json/", r"/wp-admin", r"/wp-login", r"/cart/?$", r"/checkout", r"/my-account", r"/(login|signin|sign-in|register|signup)/?$",
    r"/tags?/", r"\.(jpg|jpeg|png|gif|svg|webp|zip|mp4|mp3)(\?|$)", r"/\d{4}/\d{2}(/\d{2})?/?$",
)
DEFAULT_KEEP = (r"^https?://[^/]+/?$",)


def is_ui_line(line: Column) -> Column:
    """Whether a line as a whole is a button or widget label."""
    bare = F.btrim(F.trim(F.lower(line)), F.lit(UI_TRIM))
    t = F.trim(line)
    # all patterns but two are short by themselves; most lines are long and need no look
    may = (F.length(t) <= 120) | F.startswith(t, F.lit("http")) | (F.lower(F.left(t, F.lit(8))) == "share on")
    return bare.isin(*UI_LINES) | (may & t.rlike(UI_PATTERN))


def is_block_page(content: Column) -> Column:
    """Whether a page is a firewall's or search engine's message; null content is none."""
    head, n = F.lower(F.left(F.coalesce(content, F.lit("")), F.lit(BLOCK_WINDOW))), T.word_count(content)
    any_of = lambda ms: F.greatest(*[F.contains(head, F.lit(m)) for m in ms])
    return ((n < SEARCH_WORDS) & any_of(SEARCH_BLOCK)) | ((n < OTHER_WORDS) & any_of(OTHER_BLOCK))


def _any_pattern(patterns: Column) -> Column:
    """Many patterns as one alternation that matches nothing where there are none."""
    p = F.filter(patterns, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(p) > 0, F.array_join(F.transform(p, lambda x: F.concat(F.lit("(?:"), x, F.lit(")"))), "|")).otherwise("(?!)")


def with_profile(pages: DataFrame, profiles: DataFrame | None, seed: str = "seed_url") -> DataFrame:
    """Adds p_on, p_auto, p_threshold, p_top, p_junk, p_keep and p_terms: the site's profile, or the automatic one where it has none.

    A profile with ``enabled`` false or null switches cleaning off. Null settings take the defaults.
    """
    auto = {"p_junk": F.array(*[F.lit(x) for x in DEFAULT_JUNK]), "p_keep": F.array(*[F.lit(x) for x in DEFAULT_KEEP]), "p_terms": F.array().cast("array<string>")}
    x = pages.withColumn("p_domain", U.clean_host(F.col(seed)))
    if profiles is None:
        return x.withColumns({"p_on": F.lit(True), "p_auto": F.lit(True), "p_threshold": F.lit(THRESHOLD), "p_top": F.lit(0), **auto})
    empty = F.array().cast("array<string>")
    p = profiles.select(F.col("domain").alias("p_domain"), F.lit(True).alias("p_has"), F.coalesce("enabled", F.lit(False)).alias("e"), F.coalesce("threshold", F.lit(THRESHOLD)).alias("t"), F.coalesce("top_lines", F.lit(TOP_LINES)).alias("n"), F.coalesce("junk_urls", empty).alias("j"), F.coalesce("keep_pages", empty).alias("k"), F.filter(F.coalesce("terms", empty), lambda v: v.isNotNull() & (v != "")).alias("m")).dropDuplicates(["p_domain"])
    x = x.join(p, "p_domain", "left")
    own = F.col("p_has").isNotNull()
    return x.withColumns({"p_on": ~own | F.col("e"), "p_auto": ~own, "p_threshold": F.when(own, F.col("t")).otherwise(THRESHOLD), "p_top": F.when(own, F.col("n")).otherwise(0), "p_junk": F.when(own, F.col("j")).otherwise(auto["p_junk"]), "p_keep": F.when(own, F.col("k")).otherwise(auto["p_keep"]), "p_terms": F.when(own, F.col("m")).otherwise(auto["p_terms"])}).drop("p_has", "e", "t", "n", "j", "k", "m")


def judged_pages(pages: DataFrame, profiles: DataFrame | None, *, job: str = "job_id", page_id: str = "page_id", idx: str = "page_idx", seed: str = "seed_url", url: str = "url", title: str = "title", content: str = "content", check_blocks: bool = True, empty_copies: bool = False) -> DataFrame:
    """One row a page: job, id, idx, url, title, content, lines, reason (null for kept pages) and the profile's columns.

    Reasons in this order: ``junk URL``, ``block page (not the real page)``, ``exact copy of <url>``. The first page of equal
    text stays; junk and block pages are no first pages; a page without text is no copy unless ``empty_copies``. A url that
    comes twice in a job with text is dropped in both rows, as its text is known by url. Rows delivered twice count once.
    """
    x = pages.select(F.col(job).alias("job"), F.col(page_id).alias("id"), F.col(idx).alias("idx"), F.col(seed).cast("string").alias("seed_url"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.col(title).cast("string").alias("title"), F.col(content).cast("string").alias("content")).dropDuplicates(["id"])
    x = with_profile(x, profiles).withColumn("lines", T.lines(F.col("content")))
    x = x.withColumn("junk", F.rlike("url", _any_pattern(F.col("p_junk")))).withColumn("block", is_block_page(F.col("content")) if check_blocks else F.lit(False))
    x = x.withColumn("h", F.md5(F.array_join("lines", " ")))
    live = ~F.col("junk") & ~F.col("block")
    same = Window.partitionBy("job", "h").orderBy("idx", "id")
    first = F.first(F.when(live, F.struct("url", "id")), ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    twice = F.count("*").over(Window.partitionBy("job", "url")) > 1
    has = F.lit(True) if empty_copies else F.size("lines") > 0
    x = x.withColumn("first", first).withColumn("twice", twice)
    reason = F.when(F.col("junk"), "junk URL").when(F.col("block"), "block page (not the real page)")
    reason = reason.when(has & (F.col("first.id") != F.col("id")), F.concat(F.lit("exact copy of "), F.col("first.url"))).when(F.col("twice") & (F.size("lines") > 0), F.concat(F.lit("exact copy of "), F.col("url")))
    return x.withColumn("reason", reason).drop("junk", "block", "h", "first", "twice")


def line_frequency(judged: DataFrame) -> DataFrame:
    """job, line, pages: on how many kept pages of its job each line stands."""
    return judged.where("reason is null").select("job", F.explode(F.array_distinct("lines")).alias("line")).groupBy("job", "line").agg(F.count("*").alias("pages"))


def boilerplate(judged: DataFrame) -> DataFrame:
    """job, line, pages, kept: lines on at least max(3, ceil(threshold * kept pages)) kept pages, in jobs of at least 10."""
    kept = judged.where("reason is null").groupBy("job").agg(F.count("*").alias("kept"), F.first("p_threshold").alias("t")).where(F.col("kept") >= MIN_PAGES)
    return line_frequency(judged).join(kept, "job").where(F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("t") * F.col("kept")))).select("job", "line", "pages", "kept")


def with_line_facts(judged: DataFrame) -> DataFrame:
    """The judged pages with ``facts``: line, words, ui and fixed (protected whatever the page) of every line, looked at once."""
    fact = lambda v: F.struct(v.alias("line"), T.word_count(v).alias("words"), is_ui_line(v).alias("ui"), (v.rlike(PROTECT) | v.rlike(DAY_LABEL)).alias("fixed"))
    return judged.withColumn("facts", F.transform("lines", fact)).withColumn("norm_title", T.norm(F.coalesce("title", F.lit("")))).withColumn("words", T.word_count(F.array_join("lines", " ")))


def _protected(v: Column) -> Column:
    top = (F.col("p_top") > 0) & (v["words"] >= 3) & F.array_contains(F.slice("lines", F.lit(1), F.greatest(F.col("p_top"), F.lit(1))), v["line"])
    return (v["line"] == F.col("norm_title")) | (v["words"] >= 40) | v["fixed"] | top


def cleaned(judged: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """The judged pages with kept_lines, removed_lines, clean (text), word_count, hub; null for dropped pages."""
    x = judged if "facts" in judged.columns else with_line_facts(judged)
    per_job = (frequent if frequent is not None else boilerplate(x)).groupBy("job").agg(F.collect_set("line").alias("boiler"))  # at most lines / threshold a job
    x = x.join(per_job, "job", "left").withColumn("boiler", F.coalesce("boiler", F.array().cast("array<string>")))
    x = x.withColumn("hub", F.rlike("url", _any_pattern(F.col("p_keep"))))
    bad = lambda v: (v["ui"] | F.array_contains("boiler", v["line"])) & ~_protected(v)
    x = x.withColumn("gone", F.transform("facts", lambda v: ~F.col("hub") & bad(v)))
    pairs = F.arrays_zip("facts", "gone")
    x = x.withColumn("removed_lines", F.transform(F.filter(pairs, lambda v: v["gone"]), lambda v: v["facts"]["line"]))
    x = x.withColumn("stay", F.transform(F.filter(pairs, lambda v: ~v["gone"]), lambda v: v["facts"]))
    x = x.withColumn("names", F.transform("stay", lambda v: v["line"]))
    # where no line comes again, which an unordered set tells at once, no line needs its place looked up
    again = ~F.col("hub") & (F.size(F.array_distinct("names")) < F.size("names"))
    x = x.withColumn("kept", F.when(again, F.filter("stay", lambda v, i: (v["words"] < 4) | (F.array_position("names", v["line"]) == i + 1))).otherwise(F.col("stay")))
    x = x.withColumn("kept_lines", F.transform("kept", lambda v: v["line"]))
    x = x.withColumn("clean", F.array_join("kept_lines", "\n\n"))
    x = x.withColumn("word_count", F.aggregate("kept", F.lit(0), lambda s, v: s + v["words"]))
    only = F.col("reason").isNull()
    return x.withColumns({c: F.when(only, F.col(c)) for c in ("removed_lines", "kept_lines", "clean", "word_count")}).drop("stay", "kept", "names", "gone", "facts", "boiler")


def summary(x: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """One row a job of ``cleaned`` pages: sums, shares rounded to 3, lost terms, and whether cleaning is applied (gates)."""
    n_lines = F.col("words")
    s = x.groupBy("job").agg(
        F.first("p_on").alias("on"), F.first("p_auto").alias("auto"), F.count("*").alias("pages_in"), F.count_if(F.col("reason").isNull()).alias("pages_out"), F.sum(n_lines).alias("words_before"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), n_lines)), F.lit(0)).alias("words_kept"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words_after"),
    )
    t = x.select("job", "lines", "clean", F.posexplode("p_terms").alias("at", "term"))
    has = t.groupBy("job", "at", "term").agg(F.bool_or(F.contains(F.lower(F.array_join("lines", "\n")), F.lower("term"))).alias("before"), F.bool_or(F.coalesce(F.contains(F.lower("clean"), F.lower("term")), F.lit(False))).alias("after"))
    lost = has.where("before and not after").groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda v: v["term"]).alias("lost_terms"))
    b = (frequent if frequent is not None else boilerplate(x)).groupBy("job").agg(F.count("*").alias("boilerplate_lines"))
    s = s.join(lost, "job", "left").join(b, "job", "left").withColumn("boilerplate_lines", F.coalesce("boilerplate_lines", F.lit(0)))
    share = lambda a, w: F.when(F.col(w) > 0, F.round(F.try_divide(F.col(a), F.col(w)), 3)).otherwise(1.0)
    gate = F.when(~F.col("on"), "switched off").when(F.col("lost_terms").isNotNull(), F.concat(F.lit("must-keep phrases would be lost: "), F.array_join(F.slice("lost_terms", 1, 10), ", ")))
    gate = gate.when((F.col("words_kept") > 0) & (F.col("words_after") < MIN_KEPT_WORDS * F.col("words_kept")), "would remove more than 60% of the words")
    return s.select("job", F.when(F.col("auto"), "auto").otherwise("profile").alias("mode"), "pages_in", "pages_out", "boilerplate_lines", "words_before", "words_after", share("words_after", "words_before").alias("kept_share"), share("words_after", "words_kept").alias("kept_pages_share"), gate.alias("refused"))


def clean_pages(pages: DataFrame, profiles: DataFrame | None, **names: str) -> tuple[DataFrame, DataFrame]:
    """(pages, summaries): id, job, idx, url, title, content, word_count, applied of the pages that stay; one summary row a job.

    Where a gate refuses, or the profile is switched off, the pages of the job come back untouched and ``applied`` is false.
    Null contents count as empty. An empty table gives empty results. Columns other than those named are ignored.
    """
    judged = materialize(with_line_facts(judged_pages(pages, profiles, **names)), "judged")
    frequent = materialize(boilerplate(judged), "frequent-lines")
    x = materialize(cleaned(judged, frequent).drop("removed_lines", "kept_lines"), "cleaned")
    s = materialize(summary(x, frequent), "summaries")
    y = x.join(s.select("job", "refused"), "job")
    ok = F.col("refused").isNull()
    out = y.where(~ok | F.col("reason").isNull()).select("id", "job", "idx", "url", "title", F.when(ok, F.col("clean")).otherwise(F.col("content")).alias("content"), F.when(ok, F.col("word_count")).otherwise(T.word_count(F.col("content"))).alias("word_count"), ok.alias("applied"))
    return out, s


def sitewide_lines(x: DataFrame, most: int = 200) -> DataFrame:
    """job, at, line: lines removed from every page they were on, by first appearance, at most ``most`` a job (a report's length)."""
    removed = x.where("reason is null").select("job", "idx", "id", F.posexplode("removed_lines").alias("pos", "line"))
    first = removed.groupBy("job", "line").agg(F.min(F.struct("idx", "id", "pos")).alias("first"))
    present = x.where("reason is null").select("job", F.explode(F.array_distinct("kept_lines")).alias("line")).distinct()
    left = first.join(present, ["job", "line"], "left_anti")
    return left.withColumn("at", F.row_number().over(Window.partitionBy("job").orderBy("first"))).where(F.col("at") <= most).select("job", "at", "line")


def retention(x: DataFrame) -> DataFrame:
    """id, before, after, retention (1.0 for pages without words) of every kept page."""
    before = F.col("words")
    return x.where("reason is null").select("job", "id", before.alias("before"), F.col("word_count").alias("after"), F.when(before > 0, F.round(F.try_divide(F.col("word_count"), before), 6)).otherwise(1.0).alias("retention"))


def report_lines(judged: DataFrame) -> DataFrame:
    """The kept pages of a dry run with kept_lines, removed_lines, before and after: lines on max(3, ceil(threshold * kept)) pages go
    in crawls of any size, but for protected ones; the first lines of a page are always protected and lines that come again stay."""
    kept = judged.where("reason is null")
    need = kept.groupBy("job").agg(F.greatest(F.lit(3), F.ceil(F.lit(THRESHOLD) * F.count("*"))).alias("need"))
    boiler = line_frequency(judged).join(need, "job").where("pages >= need").groupBy("job").agg(F.collect_set("line").alias("boiler"))
    x = with_line_facts(kept).join(boiler, "job", "left").withColumn("boiler", F.coalesce("boiler", F.array().cast("array<string>"))).withColumn("p_top", F.lit(TOP_LINES))
    x = x.withColumn("removed", F.filter("facts", lambda v: F.array_contains("boiler", v["line"]) & ~_protected(v)))
    x = x.withColumn("removed_lines", F.transform("removed", lambda v: v["line"]))
    x = x.withColumn("kept_lines", F.filter("lines", lambda v: ~F.array_contains("removed_lines", v)))
    return x.withColumn("before", F.col("words")).withColumn("after", F.col("words") - F.aggregate("removed", F.lit(0), lambda s, v: s + v["words"])).drop("facts", "removed", "boiler")


def report(judged: DataFrame, *, min_words: int = 100) -> DataFrame:
    """One row a job of ``judged`` pages (``check_blocks=False, empty_copies=True``): pages_in, dropped, kept, words_before, words_after,
    flagged, unique_removed, sitewide_lines, sitewide_words and dropped_with_own_lines. Nothing is changed.

    A page is flagged when it is left with under ``min_words`` words or 60 % of them. Lines removed from every page they were on
    count once in words_after. ``unique_removed`` are removed lines that stand on one page only; it must be 0.
    """
    x = materialize(report_lines(judged), "report-lines")
    pages = judged.groupBy("job").agg(F.count("*").alias("pages_in"), F.count_if(F.col("reason").isNotNull()).alias("dropped"), F.sum(T.word_count(F.array_join("lines", " "))).alias("words_before"))
    keep = (F.col("before") == 0) | (F.col("after") >= 0.60 * F.col("before"))
    sums = x.groupBy("job").agg(F.count("*").alias("kept"), F.sum("after").alias("after"), F.count_if((F.col("after") < min_words) | ~keep).alias("flagged"))
    gone = x.select("job", "id", F.explode(F.array_distinct("removed_lines")).alias("line")).groupBy("job", "line").agg(F.count("*").alias("removed"))
    on = line_frequency(judged)
    present = x.select("job", F.explode(F.array_distinct("kept_lines")).alias("line")).distinct()
    unique = gone.join(on.where("pages = 1"), ["job", "line"], "left_semi").groupBy("job").agg(F.count("*").alias("unique_removed"))
    left = gone.join(present, ["job", "line"], "left_anti").groupBy("job").agg(F.count("*").alias("sitewide_lines"), F.sum(T.word_count(F.col("line"))).alias("sitewide_words"))
    lines = lambda v: v.select("job", "url", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    lost = lines(judged.where("reason is not null")).join(lines(judged.where("reason is null")).select("job", "line").distinct(), ["job", "line"], "left_anti").groupBy("job").agg(F.countDistinct("url").alias("dropped_with_own_lines"))
    s = pages
    for t in (sums, unique, left, lost):
        s = s.join(t, "job", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return s.select("job", "pages_in", "dropped", zero("kept").alias("kept"), "words_before", (zero("after") + zero("sitewide_words")).alias("words_after"), *[zero(c).alias(c) for c in ("flagged", "unique_removed", "sitewide_lines", "sitewide_words", "dropped_with_own_lines")])


def report_samples(x: DataFrame, *, worst: int = 2, more: int = 3) -> DataFrame:
    """job, id, worst: of each job the pages that lose the most, and some others in the order of a hash of their urls, to be read."""
    share = F.when(F.col("before") > 0, F.try_divide(F.col("after"), F.col("before"))).otherwise(1.0)
    by = Window.partitionBy("job")
    y = x.select("job", "id", F.row_number().over(by.orderBy(share, "id")).alias("a"), F.md5("url").alias("u")).withColumn("worst", F.col("a") <= worst)
    y = y.withColumn("b", F.row_number().over(Window.partitionBy("job", "worst").orderBy("u", "id")))
    return y.where(F.col("worst") | (F.col("b") <= more)).select("job", "id", "worst")
