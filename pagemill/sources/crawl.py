"""Reading and writing crawls: saved job documents, the raw archive, exports, batches to a service, a frontier over a link graph."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from ..functions import url as U
from ..session import materialize

JOB_SCHEMA = "job_id string, seed_url string, status string, total_pages_crawled int, created_at string, completed_at string, duration_seconds double, stats struct<started_at:string,max_pages_limit:int,max_depth_limit:int,render_js:boolean,force_recrawl:boolean,pages_new:int,pages_updated:int,pages_skipped:int,errors:array<string>>, pages array<struct<url:string,title:string,content:string,word_count:int,change_status:string>>"


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Saved job documents (one JSON object a file) with file_name and file_size; unreadable ones and other files are left out."""
    x = spark.read.schema(JOB_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    return x.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size")).where("job_id is not null")


def job_pages(jobs: DataFrame) -> DataFrame:
    """The pages of jobs, one row each, with job_id, seed_url and page_idx."""
    return jobs.select("job_id", "seed_url", F.posexplode("pages").alias("page_idx", "p")).select("job_id", "seed_url", "page_idx", "p.*")


def save_pages(cleaned: DataFrame, raw: DataFrame, path: str) -> None:
    """Write both tables by job: the raw archive first and never over an existing one, then the cleaned pages over their own jobs."""
    spark = cleaned.sparkSession
    try:
        done = spark.read.parquet(f"{path}/raw").select("job_id").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # anything else must not lead to a second copy
            raise
        done = None  # nothing archived yet
    if done is not None:
        raw = raw.join(done, "job_id", "left_anti")
    raw.write.mode("append").partitionBy("job_id").parquet(f"{path}/raw")
    cleaned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(f"{path}/pages")


def write_csv(export: DataFrame, path: str) -> None:
    """Page and Content as quoted CSV in UTF-8; each file begins with a byte-order mark in its header, as spreadsheets want it."""
    export.select(F.col("page").alias("﻿Page"), F.col("content").alias("Content")).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(export: DataFrame, path: str) -> None:
    """One JSON object a line; ``json_list`` makes a list of them for one crawl."""
    export.select("page", "content").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_list(export: DataFrame) -> DataFrame:
    """job, json: the export of each crawl as one JSON list of page and content; a crawl is bounded by its page limit."""
    item = F.to_json(F.struct(F.coalesce("page", F.lit("")).alias("page"), F.coalesce("content", F.lit("")).alias("content")))
    x = export.groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("item")))), lambda v: v["item"]).alias("items"))
    return x.select("job", F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]")).alias("json"))


class TableReader(DataSourceReader):
    """Pages of a stored table as if they were fetched: one partition for each row group, so that each row is read once."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        import pyarrow.dataset as ds

        return [InputPartition((f.path, g.row_groups[0].id)) for f in ds.dataset(self.path, format="parquet").get_fragments() for g in f.split_by_row_group()] or [InputPartition(None)]

    def read(self, partition) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        if partition.value is None:
            return
        path, group = partition.value
        for b in pq.ParquetFile(path).iter_batches(row_groups=[group], columns=["url", "html"]):
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())


class PageSource(DataSource):
    """``spark.read.format("pages")``: a connector with the interface of a fetcher over a stored table (url, html)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return TableReader(self.options)


def sitemap_urls(sitemaps: DataFrame, start: list[str], *, depth: int = 2, first: int = 5, most: int = 1000) -> DataFrame:
    """loc of the pages that the sitemaps (url, text) list, from ``start``: indexes are followed to ``depth``, ``first`` of each."""
    locs = sitemaps.select("url", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("pos", "loc"), F.col("text").rlike(r"(?i)<sitemapindex").alias("index"))
    now = sitemaps.where(F.col("url").isin(*start)).select("url").distinct()
    out = None
    for _ in range(depth + 1):
        x = locs.join(now, "url", "left_semi")
        pages = x.where("not index").select("url", "pos", "loc")
        out = pages if out is None else out.unionByName(pages)
        now = x.where(f"index and pos < {int(first)}").select(F.col("loc").alias("url")).distinct()
    return out.groupBy("loc").agg(F.min(F.struct("url", "pos")).alias("o")).orderBy("o").limit(most).select("loc")


def frontier(links: DataFrame, seed: str, *, max_pages: int = 50, max_depth: int = 3, subdomains: bool = False) -> DataFrame:
    """url, depth, place of the pages that a crawl from ``seed`` visits, breadth first. ``links`` has source, pos and href.

    A loop over depths on the driver; each step is a join of the new urls with the links and an anti-join with those seen.
    """
    spark = links.sparkSession
    base = F.lit(seed)
    ok = U.crawlable(F.col("href")) & U.same_domain(F.col("href"), base, subdomains)
    edges = links.where(ok).select(U.normalize(F.col("source"), U.authority(base)).alias("source"), "pos", U.normalize(F.col("href"), U.authority(base)).alias("url"))
    seen = spark.range(1).select(U.normalize(base, U.authority(base)).alias("url"), F.lit(0).alias("depth"), F.array(F.lit(0).cast("bigint")).alias("place"))
    level = seen
    for k in range(1, max_depth + 1):
        step = edges.join(level.select(F.col("url").alias("source"), "place"), "source").groupBy("url").agg(F.min(F.concat("place", F.array(F.col("pos").cast("bigint")))).alias("place"))
        level = materialize(step.join(seen.select("url"), "url", "left_anti").select("url", F.lit(k).alias("depth"), "place"), "frontier")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.orderBy("depth", "place").limit(max_pages)


#: What a batch came to.
SENT = "rows int, tries int, status int, error string, created bigint, updated bigint, embedded bigint"


def to_send(pages: DataFrame) -> DataFrame:
    """url, title and content of the pages that have some; nulls are empty."""
    return pages.where(T.strip(F.coalesce(F.col("content"), F.lit(""))) != "").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("url", "title", "content")])


def push(pages: DataFrame, send: Callable[[list[dict]], tuple[int, dict]], *, size: int = 200, tries: int = 3, waits: tuple[float, ...] = (2, 6, 12)) -> DataFrame:
    """Send the pages that have content in batches from the executors; one row a batch comes back, to be added up by ``push_totals``.

    ``send`` gets url, title and content of a batch and returns the status and the reply, of which created, updated and embedded
    count. 200 is success; any other status and any exception is tried again after the waits, ``tries`` times in all; 401 and 403
    end the task's sending at once. Batches are filled across Arrow batches; the last of a task may be smaller.
    """

    def attempt(part: list[dict]) -> tuple:
        for n in range(1, tries + 1):
            error, reply = None, {}
            try:
                status, reply = send(part)
            except Exception as e:  # a timeout says nothing but its kind
                status, error = 0, f"{type(e).__name__}: {e}"
            if status == 200 or status in (401, 403):
                break
            if n < tries and waits:
                time.sleep(waits[min(n, len(waits)) - 1])
        return len(part), n, status, error, *(int((reply or {}).get(k) or 0) if status == 200 else 0 for k in ("created", "updated", "embedded"))

    def run(batches):
        import pyarrow as pa

        held, out = [], []
        stopped = False
        for b in [*batches, None]:
            held += b.to_pylist() if b is not None else []
            while not stopped and (len(held) >= size or (b is None and held)):
                part, held = held[:size], held[size:]
                out.append(attempt(part))
                stopped = out[-1][2] in (401, 403)
        cols = list(zip(*out)) if out else [[]] * 7
        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["rows", "tries", "status", "error", "created", "updated", "embedded"])

    return to_send(pages).mapInArrow(run, SENT)


def push_totals(sent: DataFrame) -> DataFrame:
    """One row: pages and batches sent, failed_batches, created, updated, embedded, aborted."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return sent.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("pages"), F.count("*").alias("batches"), F.count_if(F.col("status") != 200).alias("failed_batches"), total("created"), total("updated"), total("embedded"), F.coalesce(F.bool_or(F.col("status").isin(401, 403)), F.lit(False)).alias("aborted"))


def read_table(spark: SparkSession, url: str, table: str, *, where: str | None = None, properties: dict | None = None) -> DataFrame:
    """A table of a database over JDBC; Spark pushes the filter and the columns that are used down to it."""
    x = spark.read.jdbc(url, table, properties=properties or {})
    return x.where(where) if where else x
