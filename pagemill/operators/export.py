"""Content-only views of a crawl: page names without the site's common suffix, texts without widgets and repeated headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from .cleaning import is_ui_line

# What stands between a page's name and its site's.
SEPARATORS = (" | ", " - ", " – ", " — ", " :: ", " « ", " » ")


def _title_case(s: Column) -> Column:
    """Upper case after every character that is no letter, lower case elsewhere."""
    chars = F.split(F.lower(s), "")
    return F.array_join(F.transform(chars, lambda ch, i: F.when((i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit(" ")).rlike(r"[\p{L}\p{M}]"), F.upper(ch)).otherwise(ch)), "")


def page_name(title: Column, url: Column) -> Column:
    """The title unless it is empty or a url; else the last part of the path as words; Home for a root, Untitled for nothing."""
    t, u = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(url, F.lit("")))
    path = F.btrim(F.coalesce(F.try_url_decode(F.replace(U.part(u, 3), F.lit("+"), F.lit("%2B"))), U.part(u, 3)), F.lit("/"))
    slug = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.(html?|php|aspx?)$", "")
    words = F.trim(F.regexp_replace(slug, "[-_]+", " "))
    own = (t != "") & (t != u) & ~t.rlike(r"(?i)^https?://")
    return F.when(own, t).when(path == "", "Home").when(words == "", "Untitled").otherwise(_title_case(words))


def common_suffix(names: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """group, suffix: the separator and site name that at least 3 and 60 % of a group's names end with, if longer than 3.

    A name counts once for each separator in it, with what stands behind the last one; ties go to the first seen.
    """
    x = names.select(F.col(group).alias("g"), F.col(name).alias("name"), F.col(order).alias("o"))
    n = x.groupBy("g").agg(F.count("*").alias("names"))
    seps = x.select("g", "name", "o", F.posexplode(F.array(*[F.lit(s) for s in SEPARATORS])).alias("k", "sep")).where(F.instr(F.col("name"), F.col("sep")) > 0)
    tails = seps.select("g", "o", "k", F.concat("sep", F.trim(F.element_at(F.split(F.col("name"), F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E"))), -1))).alias("tail"))
    c = tails.groupBy("g", "tail").agg(F.count("*").alias("n"), F.min(F.struct("o", "k")).alias("first"))
    best = c.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "first"))).where("r = 1")
    return best.join(n, "g").where((F.col("names") >= 3) & (F.col("n") >= 3) & (F.col("n") >= 0.6 * F.col("names")) & (F.length("tail") > 3)).select(F.col("g").alias(group), F.col("tail").alias("suffix"))


def short_name(name: Column, suffix: Column) -> Column:
    ends = suffix.isNotNull() & F.endswith(name, suffix) & (F.length(name) > F.length(suffix))
    return F.when(ends, F.trim(F.left(name, F.length(name) - F.length(suffix)))).otherwise(name)


def page_text(content: Column, names: Column) -> Column:
    """Paragraphs without widget lines, and without the page's names while nothing else has come."""
    ls = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), T.strip), lambda v: (v != "") & ~is_ui_line(v))
    other = F.filter(F.transform(ls, lambda v, i: F.when(~F.array_contains(names, v), i)), lambda i: i.isNotNull())
    start = F.coalesce(F.get(other, F.lit(0)), F.size(ls))
    return F.array_join(F.slice(ls, start + 1, F.greatest(F.size(ls), F.lit(1))), "\n\n")


def named_pages(pages: DataFrame, *, job: str = "job_id", page_id: str = "page_id", idx: str = "page_idx", url: str = "url", title: str = "title", content: str = "content") -> DataFrame:
    """job, id, idx, url, name, short, text of every page, rows delivered twice once."""
    x = pages.select(F.col(job).alias("job"), F.col(page_id).alias("id"), F.col(idx).alias("idx"), F.col(url).cast("string").alias("url"), F.col(title).cast("string").alias("title"), F.col(content).cast("string").alias("content")).dropDuplicates(["id"])
    x = x.withColumn("name", page_name(F.col("title"), F.col("url")))
    x = x.join(common_suffix(x, "job", "name", "idx"), "job", "left").withColumn("short", short_name(F.col("name"), F.col("suffix")))
    return x.withColumn("text", page_text(F.col("content"), F.array("name", "short"))).select("job", "id", "idx", "url", "name", "short", "text")


def content_export(pages: DataFrame, **names: str) -> DataFrame:
    """job, idx, page, content: the name and text of every page that has a text."""
    return named_pages(pages, **names).where("text <> ''").select("job", "idx", F.col("short").alias("page"), F.col("text").alias("content"))


def html_document(export: DataFrame, group: str = "job") -> DataFrame:
    """group, html: one printable document for each group; the pages of a job are bounded by its page limit."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    paras = F.array_join(F.transform(F.split("content", "\n\n"), lambda p: F.concat(F.lit("<p>"), esc(p), F.lit("</p>"))), "")
    x = export.select(group, "idx", F.concat(F.lit("<h2>"), esc(F.col("page")), F.lit("</h2>"), paras).alias("part"))
    return x.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "part"))), lambda v: v["part"]), "\n").alias("html"))
