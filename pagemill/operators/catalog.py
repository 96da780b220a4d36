"""Change detection against a catalog of known urls, and the choice of the latest version of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U


def change_status(pages: DataFrame, catalog: DataFrame, *, url: str = "url", content: str = "content", force: bool = False) -> DataFrame:
    """The pages with key, content_hash and status: ``new``, ``updated`` or ``skipped_unchanged``.

    A page is looked up by its normalised url, then by the url as it is. With ``force`` an unchanged page is new again. Null
    urls are new. ``catalog`` has url and content_hash, each url once.
    """
    x = pages.withColumn("key", U.normalize(F.col(url))).withColumn("content_hash", T.fingerprint(F.col(content)))
    c = catalog.select(F.col("url").alias("c_key"), F.col("content_hash").alias("c_hash"))
    r = catalog.select(F.col("url").alias("r_key"), F.col("content_hash").alias("r_hash"))
    x = x.join(c, F.col("key") == F.col("c_key"), "left").join(r, F.col(url) == F.col("r_key"), "left")
    known = F.coalesce("c_hash", "r_hash")
    same = F.lit("new") if force else F.lit("skipped_unchanged")
    return x.withColumn("status", F.when(known.isNull(), "new").when(known == F.col("content_hash"), same).otherwise("updated")).drop("c_key", "c_hash", "r_key", "r_hash")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; both have the same columns, each key once."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def catalog_of(pages: DataFrame, *, url: str = "url", content: str = "content", at: str = "crawled_at", tie: str = "page_id") -> DataFrame:
    """url, content_hash, title, job_id, last_crawled_at: the last page of each normalised url. The last is found by a combined
    maximum, without a window; null times come first, ties go to the greatest id."""
    x = pages.where(F.col(url).isNotNull()).select(U.normalize(F.col(url)).alias("url"), F.struct(F.coalesce(F.col(at), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.col(tie).alias("tie"), T.fingerprint(F.col(content)).alias("content_hash"), F.col("title"), F.col("job_id"), F.col(at).alias("last_crawled_at")).alias("v"))
    return x.groupBy("url").agg(F.max("v").alias("v")).select("url", "v.content_hash", "v.title", "v.job_id", "v.last_crawled_at")


def latest_versions(rows: DataFrame, key: Column, order: list[Column], columns: list[str]) -> DataFrame:
    """key and ``columns`` of the row with the greatest ``order`` for each key; a combined maximum instead of a window."""
    names = [f"o{i}" for i in range(len(order))]
    v = F.struct(*[c.alias(n) for c, n in zip(order, names)], *[F.col(c) for c in columns])
    return rows.select(key.alias("key"), v.alias("v")).where("key is not null").groupBy("key").agg(F.max("v").alias("v")).select("key", *[F.col(f"v.{c}").alias(c) for c in columns])


def by_priority(ranked: DataFrame, key: str, rank: str) -> DataFrame:
    """One row for each key: the one with the smallest rank."""
    return ranked.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where("__r = 1").drop("__r")


def delete_rows(store: DataFrame, gone: Column) -> tuple[DataFrame, int]:
    """(rest, deleted): the rows for which ``gone`` does not hold (null keeps a row), and how many went."""
    rest = store.where(~F.coalesce(gone, F.lit(False)))
    return rest, store.count() - rest.count()


def truncate(store: DataFrame) -> tuple[DataFrame, int]:
    """(empty, rows): an empty table of the same columns, and how many rows the old one had."""
    return store.limit(0), store.count()
