"""Lines that come back all over one site (problem 7).

Lines are compared by the letters and combining marks of the lower-cased line. For every line of every site two counts are compared:
the distinct urls of the site that carry it, and those of all other sites. Dunning's log-likelihood ratio of the two gives a p-value,
and Benjamini-Hochberg over all lines of all sites, those that stand once included, controls the false-discovery rate. A line is
flagged when it is in excess by that test and stands on ``min_urls`` and ``min_share`` of the site's urls. ``require_significance``
tells what becomes of a line that reaches both shares but stands on other sites just as often: with it, it is kept; without, as
this project defines excess by the shares alone, it is flagged too, with ``significant`` false.

Cost: one explode of the lines and one aggregation on 24-byte keys, with (line, url) as key first, so that no hot site or hot line
ends in one task; all counts of the test come from that table. The lines flagged are bounded: at most lines-per-page / min_share a
site. They are written to the shared folder; the lines of all pages meet them by broadcast when they are under ``broadcast_rows``
rows, else by a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import letters_key
from ..session import materialize


def site_of(c: Column) -> Column:
    """A site without regard to letter case and its last slash."""
    return F.regexp_replace(F.lower(c), "/$", "")


def _lines(pages: DataFrame) -> DataFrame:
    """id, s (site), u (url), line_no and k (hash of site and line's letters) of every line with a letter."""
    keys = F.transform(F.split(F.col("t"), "\n"), letters_key)
    e = pages.select("id", "s", "u", F.posexplode(keys).alias("line_no", "letters"))
    return e.where(F.col("letters").rlike(r"\p{L}")).withColumn("line_no", F.col("line_no") + 1)


def _pages(pages: DataFrame, page_id: str, site: str, url: str, content: str) -> DataFrame:
    return pages.select(F.col(page_id).alias("id"), site_of(F.col(site).cast("string")).alias("s"), F.col(url).cast("string").alias("u"), F.col(content).cast("string").alias("t"))


def _counts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): sh, k, urls of every line of every site, and s, sh, site_urls of every site."""
    src = pages.where("s is not null and u is not null")
    totals = src.groupBy("s").agg(F.countDistinct("u").alias("site_urls")).withColumn("sh", F.xxhash64("s"))
    rows = _lines(src.where("t is not null")).select(F.xxhash64("s").alias("sh"), F.xxhash64("letters").alias("k"), F.xxhash64("u").alias("h"))
    return rows.distinct().groupBy("sh", "k").agg(F.count("*").alias("urls")), totals


def _shares(counts: DataFrame, totals: DataFrame, min_urls: int, min_share: float, min_site_urls: int) -> DataFrame:
    x = counts.where(F.col("urls") >= min_urls).join(totals.where(F.col("site_urls") >= min_site_urls), "sh")
    return x.where(F.col("urls") >= min_share * F.col("site_urls") - 1e-9).withColumn("share", F.col("urls") / F.col("site_urls"))


def excessive_lines(pages: DataFrame, *, page_id: str = "page_id", site: str = "seed_url", url: str = "url", content: str = "content", min_urls: int = 5, min_share: float = 0.2, min_site_urls: int = 10) -> DataFrame:
    """s, sh, k, urls, site_urls, share: one row for each line of a site that stands on at least ``min_urls`` and ``min_share`` of
    the site's distinct urls; sh and k are the hashes of the site and of the line's letters. No test is made.

    Null sites, urls and contents and blank lines are left out; a page crawled or delivered again counts once by its url; sites
    of fewer than ``min_site_urls`` urls have no row. An empty table gives an empty result.
    """
    counts, totals = _counts(_pages(pages, page_id, site, url, content))
    return _shares(counts, totals, min_urls, min_share, min_site_urls).select("s", "sh", "k", "urls", "site_urls", "share")


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n at rate p, with 0 log 0 = 0."""
    return F.when((k > 0) & (p > 0), k * F.log(p)).otherwise(0.0) + F.when((n - k > 0) & (p < 1), (n - k) * F.log(1 - p)).otherwise(0.0)


def tested_lines(pages: DataFrame, *, page_id: str = "page_id", site: str = "seed_url", url: str = "url", content: str = "content", fdr: float = 0.01) -> DataFrame:
    """One row for each line of each site: s, sh, k, urls, site_urls, share, other_urls, llr, p_value and significant.

    ``other_urls`` are the urls of all other sites that carry the line. ``significant`` holds where the line is over-represented in
    its site and passes Benjamini-Hochberg at ``fdr`` over all rows. Nulls and repeats as in ``excessive_lines``.
    """
    counts, totals = _counts(_pages(pages, page_id, site, url, content))
    counts, totals = materialize(counts, "line-counts"), materialize(totals, "site-urls")
    n = totals.agg(F.sum("site_urls")).first()[0] or 0
    x = counts.join(counts.groupBy("k").agg(F.sum("urls").alias("n_all")), "k").join(totals, "sh")
    a, b = F.col("urls").cast("double"), (F.col("n_all") - F.col("urls")).cast("double")
    n1, n2 = F.col("site_urls").cast("double"), F.lit(float(n)) - F.col("site_urls")
    rate = lambda k, m: F.when(m > 0, k / m).otherwise(0.0)
    both = (a + b) / (n1 + n2)
    llr = 2 * (_log_likelihood(a, n1, rate(a, n1)) + _log_likelihood(b, n2, rate(b, n2)) - _log_likelihood(a, n1, both) - _log_likelihood(b, n2, both))
    # one-sided; p of a chi-square with one degree of freedom, by the erfc bound exp(-x/2) / sqrt(pi x / 2 + 1): an upper bound
    x = x.select("s", "sh", "k", "urls", "site_urls", "n_all", F.when(rate(a, n1) > rate(b, n2), F.greatest(llr, F.lit(0.0))).otherwise(0.0).alias("llr"))
    x = x.withColumn("p_value", F.exp(-F.col("llr") / 2) / F.sqrt(F.lit(3.141592653589793) * F.col("llr") / 2 + 1))
    # Benjamini-Hochberg by counts of p in steps of a quarter power of ten, rounded up, instead of a global sort in one task
    x = x.withColumn("step", F.least(F.floor(-F.log10(F.greatest(F.col("p_value"), F.lit(1e-300))) * 4), F.lit(1200)).cast("int"))
    x = materialize(x, "line-tests")
    by = sorted(((r["step"], r["count"]) for r in x.groupBy("step").count().collect()), reverse=True)  # at most 1201 rows
    tests, at_most, cut = sum(c for _, c in by), 0, None
    for step, c in by:
        at_most += c
        if 10 ** (-step / 4) <= fdr * at_most / tests:
            cut = step
    significant = F.col("step") >= cut if cut is not None else F.lit(False)
    return x.select("s", "sh", "k", "urls", "site_urls", (F.col("urls") / F.col("site_urls")).alias("share"), (F.col("n_all") - F.col("urls")).alias("other_urls"), "llr", "p_value", (significant & (F.col("llr") > 0)).alias("significant"))


def flagged_lines(pages: DataFrame, *, page_id: str = "page_id", site: str = "seed_url", url: str = "url", content: str = "content", min_urls: int = 5, min_share: float = 0.2, min_site_urls: int = 10, fdr: float = 0.01, require_significance: bool = False, broadcast_rows: int = 1_000_000) -> DataFrame:
    """page_id, line_no, share, llr, significant: every line in excess of every page; line numbers count from 1 at each line feed.

    A page delivered twice gives each line once. See ``excessive_lines`` for nulls and small sites.
    """
    tested = tested_lines(pages, page_id=page_id, site=site, url=url, content=content, fdr=fdr)
    reaches = (F.col("urls") >= min_urls) & (F.col("site_urls") >= min_site_urls) & (F.col("share") >= min_share - 1e-12)
    hits = tested.where(reaches & F.col("significant") if require_significance else reaches)
    marks = materialize(hits.select("sh", "k", "share", "llr", "significant"), "site-lines")
    rows = _lines(_pages(pages, page_id, site, url, content).where("s is not null and t is not null"))
    rows = rows.select("id", "line_no", F.xxhash64("s").alias("sh"), F.xxhash64("letters").alias("k"))
    out = rows.join(F.broadcast(marks) if marks.count() <= broadcast_rows else marks, ["sh", "k"])
    return out.groupBy("id", "line_no").agg(F.max("share").alias("share"), F.max("llr").alias("llr"), F.max("significant").alias("significant")).withColumnRenamed("id", "page_id")


def without_lines(pages: DataFrame, *, page_id: str = "page_id", site: str = "seed_url", url: str = "url", content: str = "content", **kw) -> DataFrame:
    """page_id, content: each page without its excessive lines, the rest in order. Null content stays null; one row a page row."""
    flagged = flagged_lines(pages, page_id=page_id, site=site, url=url, content=content, **kw)
    drop = flagged.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))  # bounded by the lines of one page
    src = pages.select(F.col(page_id).alias("page_id"), F.col(content).cast("string").alias("t")).join(drop, "page_id", "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains(gone, i + 1))
    return src.select("page_id", F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("content"))
