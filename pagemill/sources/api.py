"""Posts read from a site's API: which types and items hold content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U

# Post types and prefixes of types that hold templates or settings, not content.
SKIP_TYPES = ("attachment", "nav_menu_item", "wp_block", "wp_template", "wp_template_part", "wp_navigation", "wp_global_styles", "wp_font_family", "wp_font_face", "revision", "customize_changeset", "oembed_cache", "user_request", "custom_css")
SKIP_PREFIXES = ("elementor", "e-floating", "e-landing", "acf-", "rank_math", "wpcf7", "shop_", "product_variation", "scheduled-action", "jet-", "fusion_", "et_", "wpforms", "ct_template", "oxy_", "tablepress", "mc4wp", "amp_", "wp_", "nav_menu", "wc_", "yith", "elementskit")
# Last parts of paths that are a theme's utility pages.
JUNK_SLUG = r"(?i)^(users?|members?|login|log-in|logout|register|signup|sign-up|reset|reset-password|lost-password|forgot-password|my-account|account|profile|dashboard|cart|checkout|wishlist|compare|search|sitemap|404|home|home-\d+|homepage|homepage-\d+|author|authors|sample-page(-\d+)?|page-without-ads|bs-[\p{L}\p{N}_-]+)$"
PAGE_WORDS, POST_WORDS, REAL_PAGES = 30, 8, 3


def content_type(slug: Column) -> Column:
    """Whether a post type holds content."""
    known = F.array(*[F.lit(p) for p in SKIP_PREFIXES])
    return slug.isNotNull() & ~slug.isin(*SKIP_TYPES) & ~F.exists(known, lambda p: F.startswith(slug, p))


def plain(fragment: Column) -> Column:
    """A fragment of HTML without tags, its commonest entities decoded."""
    x = F.regexp_replace(F.coalesce(fragment, F.lit("")), r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&#8217;", "’"), ("&#8211;", "–"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return T.strip(x)


def article_text(title: Column, text: Column) -> Column:
    """The text below its title, unless it begins with it."""
    t, x = F.coalesce(title, F.lit("")), T.strip(F.coalesce(text, F.lit("")))
    return F.when((t != "") & ~F.startswith(x, t), F.concat(t, F.lit("\n\n"), x)).otherwise(x)


def usable_items(items: DataFrame) -> DataFrame:
    """Items with a link, not protected, no utility page, and enough words (30 for pages, 8 for all others): item_id, host, kind, link,
    title, text, published_at. A null kind counts as post."""
    link = F.substring_index(F.coalesce("link", F.lit("")), "#", 1)
    slug = F.substring_index(F.btrim(U.part(link, 3), F.lit("/")), "/", -1)
    text = article_text(plain(F.col("title")), F.col("content"))
    x = items.dropDuplicates(["item_id"]).select("item_id", U.clean_host(link).alias("host"), F.lower(F.coalesce("item_type", F.lit("post"))).alias("kind"), link.alias("link"), plain(F.col("title")).alias("title"), text.alias("text"), "published_at", F.coalesce("is_protected", F.lit(False)).alias("p"), F.when(slug == "", "home").otherwise(slug).alias("slug"))
    x = x.where((F.col("link") != "") & ~F.col("p") & ~F.col("slug").rlike(JUNK_SLUG))
    return x.where(T.word_count(F.col("text")) >= F.when(F.col("kind") == "page", PAGE_WORDS).otherwise(POST_WORDS)).drop("p", "slug")


def enough(items: DataFrame) -> DataFrame:
    """Hosts with at least three items of 30 words: the others are better crawled."""
    return items.groupBy("host").agg(F.count_if(T.word_count(F.col("text")) >= PAGE_WORDS).alias("real")).where(F.col("real") >= REAL_PAGES).select("host")
