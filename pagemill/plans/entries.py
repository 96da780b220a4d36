"""All queries of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import catalog, chunks, cleaning, export, intake, ops, vectors
from ..session import table
from ..sources import api as sources_api
from ..sources import crawl, html
from . import sql as S


# ---- text, urls


def doc_word_count(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", T.word_count(F.col("text")).alias("words"), F.size(T.ws_words(F.col("text"))).alias("ws_words"))


def doc_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("content_hash"))


def doc_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))


def url_normalize(spark, d):
    x = table(spark, d, "import_records").select("rec_id", "url")
    return x.select("rec_id", U.normalize(F.col("url")).alias("url"))


def url_hosts(spark, d):
    x = table(spark, d, "import_records").where("url is not null").select("rec_id", U.clean_host(F.col("url")).alias("clean_host"), U.root_domain(U.clean_host(F.col("url"))).alias("root"), U.host(F.col("url")).alias("host"))
    return x


def url_crawlable(spark, d):
    return table(spark, d, "import_records").where("url is not null").select("rec_id", U.crawlable(F.col("url")).alias("crawlable"))


def url_same_domain(spark, d):
    x = table(spark, d, "crawl_pages").where("url is not null").select("page_id", "url", "seed_url").distinct()
    return x.select("page_id", U.same_domain(F.col("url"), F.col("seed_url"), False).alias("same"), U.same_domain(F.col("url"), F.col("seed_url"), True).alias("same_root"))


def host_histogram(spark, d):
    x = table(spark, d, "import_records").where("url is not null").groupBy(U.clean_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return x.orderBy(F.desc("n"), "host").limit(4)


def storage_paths(spark, d):
    return table(spark, d, "crawl_jobs").select("job_id", U.storage_path(F.col("job_id"), F.col("seed_url")).alias("path"))


# ---- cleaning


def _judged(spark, d, **kw):
    return cleaning.judged_pages(table(spark, d, "crawl_pages"), table(spark, d, "site_profiles"), **kw)


def drop_reasons(spark, d):
    return _judged(spark, d).select(F.col("id").alias("page_id"), "reason")


def drop_histogram(spark, d):
    x = _judged(spark, d).where("reason is not null")
    return x.groupBy("job", F.substring_index("reason", " of ", 1).alias("reason")).agg(F.count("*").alias("n"))


def line_boilerplate(spark, d):
    return cleaning.boilerplate(_judged(spark, d)).select("job", F.md5("line").alias("line"), "pages", "kept")


def ui_lines(spark, d):
    x = table(spark, d, "raw_pages").select("raw_id", F.explode(T.lines(F.col("content"))).alias("line")).where(cleaning.is_ui_line(F.col("line")))
    return x.groupBy("line").agg(F.count("*").alias("n"))


def block_pages(spark, d):
    return table(spark, d, "crawl_pages").select("page_id", cleaning.is_block_page(F.col("content")).alias("block")).distinct()


def clean_pages(spark, d):
    pages, _ = cleaning.clean_pages(table(spark, d, "crawl_pages"), table(spark, d, "site_profiles"))
    return pages.select(F.col("id").alias("page_id"), "job", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"), "word_count", "applied")


def clean_summary(spark, d):
    _, s = cleaning.clean_pages(table(spark, d, "crawl_pages"), table(spark, d, "site_profiles"))
    return s


def sitewide_lines(spark, d):
    return cleaning.sitewide_lines(cleaning.cleaned(_judged(spark, d)))


def removed_lines_top(spark, d):
    x = cleaning.cleaned(_judged(spark, d)).where("reason is null").select("job", F.explode(F.array_distinct(F.array_except("lines", "kept_lines"))).alias("line"))
    n = x.groupBy("job", "line").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("n"), "line"))).where("r <= 25")


def page_retention(spark, d):
    return cleaning.retention(cleaning.cleaned(_judged(spark, d))).select(F.col("id").alias("page_id"), "before", "after", "retention")


def typical_and_worst_pages(spark, d):
    w = Window.partitionBy("job").orderBy("retention", "id")
    x = cleaning.retention(cleaning.cleaned(_judged(spark, d))).withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("job")))
    half = F.floor(F.col("n") / 2) + 1
    return x.where((F.col("r") <= 4) | (F.col("r") == half)).select("job", F.col("id").alias("page_id"), F.col("r").cast("int").alias("rank"), (F.col("r") == half).alias("typical"))


def copies_only_lines(spark, d):
    x = _judged(spark, d)
    lines = lambda v: v.select("job", "url", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    gone = lines(x.where("reason is not null")).join(lines(x.where("reason is null")).select("job", "line").distinct(), ["job", "line"], "left_anti")
    return gone.groupBy("job", "url").agg(F.count("*").alias("lines"))


def report_copies(spark, d):
    return _judged(spark, d, check_blocks=False, empty_copies=True).select(F.col("id").alias("page_id"), "reason")


def refetch_candidates(spark, d):
    x = _judged(spark, d).where((F.col("reason") == "block page (not the real page)"))
    return x.select(F.col("id").alias("page_id"), "url")


# ---- exports


def page_names(spark, d):
    return export.named_pages(table(spark, d, "crawl_pages")).select(F.col("id").alias("page_id"), "name", "short")


def common_suffixes(spark, d):
    x = table(spark, d, "crawl_pages").dropDuplicates(["page_id"]).withColumn("name", export.page_name(F.col("title"), F.col("url")))
    return export.common_suffix(x, "job_id", "name", "page_idx")


def content_export(spark, d):
    return export.content_export(table(spark, d, "crawl_pages")).select("job", "idx", "page", F.md5("content").alias("content_md5"))


def export_documents(spark, d):
    return export.html_document(export.content_export(table(spark, d, "crawl_pages"))).select("job", F.md5("html").alias("html_md5"))


# ---- change detection


def _crawls(spark, d):
    x = table(spark, d, "crawl_pages").dropDuplicates(["page_id"])
    split = F.lit("2024-07-01").cast("timestamp_ntz")
    late = F.coalesce(F.col("crawled_at") >= split, F.lit(False))  # pages without a time are old
    return x.where(~late), x.where(late)


def change_status(spark, d):
    old, new = _crawls(spark, d)
    return catalog.change_status(new, catalog.catalog_of(old)).select("page_id", "status")


def change_counts(spark, d):
    old, new = _crawls(spark, d)
    return catalog.change_status(new, catalog.catalog_of(old)).groupBy("job_id").agg(F.count_if(F.col("status") == "new").alias("pages_new"), F.count_if(F.col("status") == "updated").alias("pages_updated"), F.count_if(F.col("status") == "skipped_unchanged").alias("pages_skipped"))


def catalog_upsert(spark, d):
    old, new = _crawls(spark, d)
    return catalog.upsert(catalog.catalog_of(old), catalog.catalog_of(new), "url").select("url", "content_hash", "job_id")


def latest_version(spark, d):
    x = table(spark, d, "crawl_pages").join(table(spark, d, "crawl_jobs").select("job_id", "completed_at"), "job_id")
    never = F.lit("0001-01-01").cast("timestamp_ntz")
    return catalog.latest_versions(x, F.col("url"), [F.coalesce("completed_at", never), F.col("page_idx"), F.col("page_id")], ["page_id"]).withColumnRenamed("key", "url")

# ---- chunks, passages


def chunk_pages(spark, d):
    x = chunks.chunks(table(spark, d, "crawl_pages").dropDuplicates(["page_id"]))
    return x.select("chunk_id", "job_id", "url", "chunk_index", F.md5("text").alias("text_md5"), "char_count")


def passages(spark, d):
    qa, _ = chunks.qa_pages(table(spark, d, "crawl_pages"))
    return qa.select("job", "url", "title", F.md5("content").alias("content_md5"))


def pages_left_whole(spark, d):
    _, plain = chunks.qa_pages(table(spark, d, "crawl_pages"), most=20)
    return plain.select(F.col("id").alias("page_id"))


def valid_questions(spark, d):
    return table(spark, d, "qa_pairs").select("qa_id", chunks.valid_question(F.col("question")).alias("valid"))


def _existing(spark, d):
    """All pair rows, and the urls of those that came with the last imports, which replace the older ones of their pages."""
    x = table(spark, d, "qa_pairs")
    again = x.where("created_at >= timestamp_ntz '2024-06-01'").select("url").where("url is not null")
    return x.select(F.col("qa_id").alias("id"), "url", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5")), again


def qa_rows_to_replace(spark, d):
    existing, again = _existing(spark, d)
    return chunks.rows_to_replace(existing, again).select(F.col("id").alias("qa_id"))


def qa_rows_backup(spark, d):
    existing, again = _existing(spark, d)
    backup, rest = chunks.backup_and_delete(existing, chunks.rows_to_replace(existing, again))
    return backup.withColumn("state", F.lit("backup")).unionByName(rest.withColumn("state", F.lit("kept"))).select(F.col("id").alias("qa_id"), "content_md5", "state")


def _plan(spark, d):
    return chunks.push_plan(table(spark, d, "crawl_pages"), table(spark, d, "qa_pairs").select(F.col("qa_id").alias("id"), "url"))


def push_items(spark, d):
    return _plan(spark, d)[0].select("job", "url", "title", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"), "passage")


def push_replaced(spark, d):
    return _plan(spark, d)[1].select(F.col("id").alias("qa_id"))


def passage_stats(spark, d):
    return chunks.passage_stats(*chunks.qa_pages(table(spark, d, "crawl_pages")))


def import_totals(spark, d):
    sent = crawl.push(table(spark, d, "crawl_pages").dropDuplicates(["page_id"]), lambda part: (200, {"created": len(part), "embedded": sum(len(r["content"]) > 200 for r in part)}))
    return crawl.push_totals(sent).select("pages", "failed_batches", "created", "updated", "embedded", "aborted")


def send_projection(spark, d):
    return crawl.to_send(table(spark, d, "crawl_pages")).select("url", "title", F.md5("content").alias("content_md5"))


def qa_by_site(spark, d):
    x = table(spark, d, "qa_pairs").groupBy("source_name").agg(F.count("*").alias("pairs"), F.countDistinct(chunks.base_url(F.col("url"))).alias("pages"), F.count_if(chunks.valid_question(F.col("question"))).alias("questions"))
    return x


def pages_with_passages(spark, d):
    existing = table(spark, d, "crawl_pages").where("url is not null").select(F.concat("url", F.lit("#c1")).alias("url"))
    return chunks.unchanged_with_passages(table(spark, d, "crawl_pages").select("url", "change_status"), existing)


def pages_todo(spark, d):
    x = table(spark, d, "crawl_pages").dropDuplicates(["page_id"])
    skip = chunks.unchanged_with_passages(x.select("url", "change_status"), x.where("url is not null").select(F.concat("url", F.lit("#c1")).alias("url")))
    return x.where("url is not null").join(skip, chunks.base_url(F.col("url")) == F.col("base"), "left_anti").select("page_id")


def import_batches(spark, d):
    x = table(spark, d, "crawl_pages").dropDuplicates(["page_id"]).where(T.strip(F.coalesce("content", F.lit(""))) != "")
    return ops.batch_numbers(x, "job_id", ["page_idx", "page_id"], 8).groupBy("job_id", "batch").agg(F.count("*").alias("rows"), F.min("page_idx").alias("first_idx"))


# ---- vectors


def _one_query(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id = 0").first()["embedding"]


def vector_topk(spark, d):
    e, q = _one_query(spark, d)
    x = vectors.top_k(e, q, 10)
    return x.select("vec_id", F.round(F.greatest(F.lit(0.0), 1 - F.col("d") / 2), 3).alias("similarity"), F.round("d", 4).alias("distance"))


def vector_search(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k_many(e, e.where("vec_id % 50 = 0"), 4).select("query_id", "vec_id", F.round("d", 4).alias("distance"), "rank")


def _matches(spark, d):
    e = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("vec_id"), "text", "url", "title")
    x = vectors.matches(vectors.top_k_many(e, e.where("vec_id % 50 = 0"), 4), docs)
    return x.withColumn("question", F.concat(F.lit("What is near "), "query_id", F.lit("?")))


def rag_prompts(spark, d):
    return vectors.prompt(_matches(spark, d)).select("query_id", F.md5("prompt").alias("prompt_md5"))


def rag_answers(spark, d):
    return vectors.grounded_answer(_matches(spark, d)).select("query_id", F.md5("answer").alias("answer_md5"))


def rag_sources(spark, d):
    return vectors.sources(_matches(spark, d)).select("query_id", "rank", "url", "title", "similarity")


def vector_upsert(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    moved = e.select((F.col("vec_id") + 100).alias("vec_id"), (F.col("label") + 100).alias("label"), "embedding")  # the whole table again under other ids
    return catalog.upsert(e, moved, "vec_id").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("first"))


def vector_delete(spark, d):
    rest, gone = catalog.delete_rows(table(spark, d, "embeddings"), F.col("label") == 3)
    return rest.select("vec_id", "label", F.lit(gone).cast("bigint").alias("deleted"))


def vector_truncate(spark, d):
    empty, rows = catalog.truncate(table(spark, d, "embeddings"))
    return empty.agg(F.count("*").alias("left")).withColumn("deleted", F.lit(rows).cast("bigint"))


def vector_index(spark, d):
    x = chunks.chunks(table(spark, d, "crawl_pages").dropDuplicates(["page_id"])).withColumn("chunk_id", F.concat_ws("_", "chunk_id", F.md5(F.coalesce("url", F.lit("")))))
    store = x.limit(0).select("chunk_id", "job_id", "url", "text", F.array().cast("array<float>").alias("embedding"))
    return vectors.index_chunks(x, store, vectors.feature_hash).groupBy("job_id").agg(F.count("*").alias("vectors"), F.count_if(F.col("embedding").isNull()).alias("without_words"))


def answers(spark, d):
    m = _matches(spark, d)
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("What is near "), "vec_id", F.lit("?")).alias("question"))
    providers = [("down", lambda p: 1 / 0), ("terse", lambda p: "Short." if len(p) < 2000 else " ")]
    return vectors.answers(asked, m, providers).select("query_id", "provider")


def vector_stats(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"))


# ---- uploaded documents


def tidy_pages(spark, d):
    x = intake.upload_pages(table(spark, d, "uploads"))
    return x.select("upload_id", "at", F.md5(intake.clean_text(F.col("text"))).alias("text_md5"))


def layer_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", intake.layer_quality(F.col("text")).alias("quality"))


def page_review(spark, d):
    x = intake.upload_pages(table(spark, d, "uploads")).withColumn("j", intake.judge(F.col("text"), F.col("engine")))
    return x.select("upload_id", "at", "j.review", "j.reason")


def text_agreement(spark, d):
    x = intake.upload_pages(table(spark, d, "uploads")).select("upload_id", "at", "text")
    y = x.select("upload_id", (F.col("at") - 1).alias("at"), F.col("text").alias("other"))
    return x.join(y, ["upload_id", "at"]).select("upload_id", "at", F.round(intake.agreement(F.col("text"), F.col("other")), 6).alias("agreement"))


def repeated_line_strip(spark, d):
    x = intake.strip_repeated_lines(intake.upload_pages(table(spark, d, "uploads")))
    return x.select("upload_id", "at", F.md5("text").alias("text_md5"), "removed")


def upload_list(spark, d):
    return intake.upload_list(table(spark, d, "uploads")).orderBy(F.desc_nulls_last("created_at"), "upload_id")


def read_summary(spark, d):
    return intake.upload_pages(table(spark, d, "uploads")).groupBy("engine").agg(F.count("*").alias("pages"), F.count_if(F.coalesce("review", F.lit(False))).alias("review"))


def upload_crawl_pages(spark, d):
    u = table(spark, d, "uploads")
    return intake.as_crawl_pages(intake.upload_pages(u), u).select("upload_id", "url", "title", F.md5("content").alias("content_md5"), "word_count")


# ---- jobs, quotas, streaks


def job_list(spark, d):
    return table(spark, d, "crawl_jobs").select("job_id", F.lower("status").alias("status"), "total_pages_crawled", "completed_at").orderBy(F.desc_nulls_last("completed_at"), "job_id")


def job_page(spark, d):
    x = table(spark, d, "crawl_jobs").select("job_id", "completed_at")
    return ops.page_of(x, [F.desc_nulls_last("completed_at"), F.col("job_id")], 3)


def job_search(spark, d):
    x = table(spark, d, "crawl_jobs").select("job_id", "seed_url")
    has = lambda c: F.contains(F.lower(c), F.lit("edu"))
    return x.where(has(F.col("job_id")) | has(F.col("seed_url")) | has(U.host(F.col("seed_url"))))


def job_totals(spark, d):
    return table(spark, d, "crawl_jobs").agg(F.count("*").alias("jobs"), F.sum("total_pages_crawled").alias("pages"), F.count_if(F.lower("status").isin("queued", "running")).alias("active"))


def job_errors(spark, d):
    x = table(spark, d, "crawl_jobs").select("job_id", F.col("stats.max_pages_limit").alias("max_pages"), F.coalesce("stats.pages_new", F.lit(0)).alias("pages_new"), F.size(F.coalesce("stats.errors", F.array().cast("array<string>"))).alias("errors"), "total_pages_crawled")
    return x.withColumn("progress", F.least(F.lit(100), F.round(F.try_divide(100 * F.col("total_pages_crawled"), F.col("max_pages"))).cast("int")))


def job_union(spark, d):
    x = table(spark, d, "crawl_jobs").select("job_id", "total_pages_crawled")
    live = table(spark, d, "crawl_jobs").where("lower(status) <> 'completed'").select("job_id", F.lit("running").alias("state"), F.lit(0).alias("pri"))
    saved = x.select("job_id", F.lit("saved").alias("state"), F.lit(1).alias("pri"))
    return catalog.by_priority(live.unionByName(saved), "job_id", "pri").select("job_id", "state")


def latest_pages(spark, d):
    x = table(spark, d, "crawl_pages").dropDuplicates(["page_id"]).select("job_id", "page_id", "page_idx")
    return ops.latest(x, "job_id", [F.desc("page_idx"), F.desc("page_id")], 5)


def daily_quota(spark, d):
    return ops.daily_counts(table(spark, d, "events"), "ts", "event_type").select(F.col("day").cast("string").alias("day"), "event_type", "n", (F.col("n") > 100).alias("over"))


def failure_streaks(spark, d):
    return ops.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)


def lockouts(spark, d):
    x = table(spark, d, "events").where("event_type in ('error', 'signup')")
    return ops.lockouts(x.withColumn("ok", F.col("event_type") == "signup"), key="user_id", at="ts", ok="ok").select("user_id", F.col("locked_at").cast("timestamp_ntz").alias("locked_at"), F.col("until").cast("timestamp_ntz").alias("until"))


def cleanup_runs(spark, d):
    return ops.spaced(table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts"), "user_id", "ts", 20).select("user_id", "event_id")


def retention_plan(spark, d):
    x = table(spark, d, "uploads").dropDuplicates(["upload_id"]).select("upload_id", "doc_kind", "size_bytes", F.datediff(F.lit("2025-06-01").cast("date"), F.to_date("created_at")).alias("age"))
    return ops.retention_plan(x.where("age is not null"), kind="doc_kind", age_days="age", size="size_bytes", name="upload_id", days=7).select("upload_id", "delete")


def source_quota(spark, d):
    return sources_api.usable_items(table(spark, d, "source_items")).transform(lambda x: ops.type_quota(x, site="host", kind="kind", order=[F.desc_nulls_last("published_at"), F.col("item_id")], most=6)).select("item_id", "host", "kind", "rank")


def usable_items(spark, d):
    return sources_api.usable_items(table(spark, d, "source_items")).select("item_id", "kind")

# ---- small functions, schedules, samples


def text_utilities(spark, d):
    x = table(spark, d, "qa_pairs")
    return x.select("qa_id", T.sanitize(F.col("question"), 40).alias("short"), F.md5(T.html_escape(F.coalesce("content", F.lit("")))).alias("escaped"), F.md5(T.simple_markdown(F.coalesce("content", F.lit("")))).alias("marked"), T.time_ago(F.col("created_at"), F.lit("2026-01-01").cast("timestamp_ntz")).alias("ago"))


def site_names(spark, d):
    x = table(spark, d, "crawl_jobs")
    return x.select("job_id", U.site_label(F.col("seed_url")).alias("site"), U.brand(F.col("seed_url")).alias("brand"), F.concat(F.lit("Crawl: "), U.site_label(F.col("seed_url"))).alias("title"))


def schedules(spark, d):
    return ops.schedule(table(spark, d, "crawl_jobs"), F.lit("2024-11-15").cast("timestamp_ntz"))


def due_schedules(spark, d):
    x = ops.schedule(table(spark, d, "crawl_jobs"), F.lit("2024-11-15").cast("timestamp_ntz"))
    return x.where("due").orderBy("next_run", "seed").limit(1).select("seed", "next_run")


def systematic_sample(spark, d):
    return ops.every_nth(table(spark, d, "qa_pairs"), "source_name", ["qa_id"], 5).select("qa_id", "step")


def _registered(spark, d):
    jobs, split = table(spark, d, "crawl_jobs"), F.lit("2024-07-01").cast("timestamp_ntz")
    late = F.coalesce(F.col("completed_at") >= split, F.lit(False))
    x = ops.register_crawls(ops.register_crawls(None, jobs.where(~late)), jobs.where(late))
    failed = jobs.where("lower(status) = 'failed'").select(F.col("seed_url").alias("seed"))
    return ops.set_enabled(x, failed, False), jobs


def schedule_changes(spark, d):
    return _registered(spark, d)[0]


def schedules_left(spark, d):
    x, jobs = _registered(spark, d)
    return ops.remove_schedules(x, jobs.where("lower(status) = 'stopped'").select(F.col("seed_url").alias("seed"))).select("seed", "enabled")


def lock_remaining(spark, d):
    x = lockouts(spark, d)
    return x.select("user_id", "locked_at", ops.remaining(F.col("until"), F.lit("2024-01-20 06:30:15").cast("timestamp_ntz")).alias("r")).select("user_id", "locked_at", "r.*")


def quota_used(spark, d):
    x = table(spark, d, "uploads").dropDuplicates(["upload_id"]).groupBy(F.to_date("created_at").alias("day")).agg(F.coalesce(F.sum("page_count"), F.lit(0)).alias("used"))
    limit = F.when(F.dayofweek("day") == 1, 0).otherwise(20)
    return x.select(F.col("day").cast("string").alias("day"), "used", ops.quota_percent(F.col("used"), limit).alias("q")).select("day", "used", "q.*")


def upload_ids(spark, d):
    h = F.md5(F.coalesce("file_name", F.lit("")))
    return table(spark, d, "uploads").select("upload_id", intake.valid_id(F.left(h, F.lit(12))).alias("id"), intake.valid_id(F.col("file_name")).alias("name"), intake.valid_session(F.left(h, F.lit(16))).alias("session"), intake.valid_session(F.left(h, F.lit(12))).alias("short_session"))


def stored_names(spark, d):
    return table(spark, d, "uploads").select("upload_id", U.stored_name(F.concat(F.lit("up/"), "file_name", F.lit(" (copy) #1?.pdf"))).alias("name"))


def backup_names(spark, d):
    return table(spark, d, "crawl_jobs").select("job_id", U.backup_name(F.col("seed_url"), F.lit("20240101-0000")).alias("name"))


def upload_pictures(spark, d):
    first = F.get(F.col("pages"), F.lit(0))["image"]
    return table(spark, d, "uploads").select("upload_id", intake.has_picture(F.col("pages"), first).alias("first"), intake.has_picture(F.col("pages"), F.lit("p7.jpg")).alias("seventh"), intake.has_picture(F.col("pages"), F.lit("none.jpg")).alias("none"))


def read_paths(spark, d):
    x = intake.upload_pages(table(spark, d, "uploads"))
    return x.groupBy(intake.read_path(F.col("text"), F.col("engine")).alias("path")).agg(F.count("*").alias("pages"))


def upload_limits(spark, d):
    x = table(spark, d, "uploads").dropDuplicates(["upload_id"]).groupBy("uploader").agg(F.sum("size_bytes").alias("bytes"), F.bool_or(F.coalesce(F.lower("status") == "processing", F.lit(False))).alias("busy"))
    return x.withColumn("fits", F.coalesce(F.col("bytes") <= 30 * 1024 * 1024, F.lit(False)))


def retention_freed(spark, d):
    x = table(spark, d, "uploads").dropDuplicates(["upload_id"]).select("upload_id", "doc_kind", "size_bytes", F.datediff(F.lit("2025-06-01").cast("date"), F.to_date("created_at")).alias("age"))
    return ops.freed(ops.retention_plan(x.where("age is not null"), kind="doc_kind", age_days="age", size="size_bytes", name="upload_id", days=7), "size_bytes")


def stale_sessions(spark, d):
    return ops.stale(table(spark, d, "events"), "user_id", "ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


def model_order(spark, d):
    names = F.array(*[F.lit(x) for x in ("gemini-1.5-flash", "gemini-2.0-flash", "gemini-2.0-flash-lite", "gemini-1.5-pro", "gemini-2.5-flash-lite", "gemini-2.5-flash", "text-embedding-004")])
    return spark.range(1).select(F.posexplode(ops.model_order(names, F.array(F.lit("gemini-2.0-flash"), F.lit("other")))).alias("place", "model"))


def first_pages(spark, d):
    x = table(spark, d, "crawl_pages").dropDuplicates(["page_id"]).select("job_id", "page_id", "page_idx")
    return ops.latest(x, "job_id", [F.asc("page_idx"), F.asc("page_id")], 5).select("job_id", "page_id", F.col("r").cast("int").alias("r"))


def feed_entries(spark, d):
    link = F.regexp_replace(F.substring_index(F.coalesce("link", F.lit("")), "?", 1), "^http://", "https://")
    items = table(spark, d, "source_items").dropDuplicates(["item_id"]).withColumn("link", link).where("link <> ''")
    blocked = refetch_candidates(spark, d).select(F.col("url").alias("link")).distinct()
    known = table(spark, d, "crawl_pages").where("url is not null").select(F.col("url").alias("link")).distinct()
    mark = lambda x, n: x.withColumn(n, F.lit(True))
    x = items.join(mark(blocked, "b"), "link", "left").join(mark(known, "k"), "link", "left")
    return x.select("item_id", "link", F.coalesce("b", F.lit(False)).alias("wanted"), F.when(F.col("k"), "filled").otherwise("added").alias("state"))


def cleaning_report(spark, d):
    return cleaning.report(cleaning.judged_pages(table(spark, d, "crawl_pages"), None, check_blocks=False, empty_copies=True))


def report_samples(spark, d):
    x = cleaning.report_lines(cleaning.judged_pages(table(spark, d, "crawl_pages"), None, check_blocks=False, empty_copies=True))
    return cleaning.report_samples(x).select("job", F.col("id").alias("page_id"), "worst")


def profile_dry_run(spark, d):
    x = table(spark, d, "crawl_pages").dropDuplicates(["page_id"]).where("url is not null")
    never = F.lit("0001-01-01").cast("timestamp_ntz")
    last = catalog.latest_versions(x.join(table(spark, d, "crawl_jobs").select("job_id", "completed_at"), "job_id"), F.col("url"), [F.coalesce("completed_at", never), F.col("page_idx"), F.col("page_id")], ["page_id"])
    x = x.join(last.select("page_id"), "page_id", "left_semi").withColumn("job_id", U.clean_host(F.col("seed_url")))
    return cleaning.clean_pages(x, table(spark, d, "site_profiles"))[1].select("job", "pages_in", "pages_out", "words_before", "words_after", "refused")


def job_documents(spark, d):
    pages = table(spark, d, "crawl_pages").dropDuplicates(["page_id"]).groupBy("job_id").agg(F.count("*").alias("n"))
    x = table(spark, d, "crawl_jobs").join(pages, "job_id", "left")
    return x.select("job_id", "seed_url", F.lower("status").alias("status"), "completed_at", F.coalesce("n", F.lit(0)).alias("pages"))


def job_view(spark, d):
    pages = table(spark, d, "crawl_pages").dropDuplicates(["page_id"]).select("job_id", "page_id", "page_idx", "url")
    last = ops.latest(pages, "job_id", [F.desc("page_idx"), F.desc("page_id")], 5).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("r", F.coalesce("url", F.lit("")).alias("url")))).alias("v"))
    x = table(spark, d, "crawl_jobs").join(last, "job_id", "left")
    errors = F.coalesce("stats.errors", F.array().cast("array<string>"))
    return x.select("job_id", F.array_join(F.transform("v", lambda v: v["url"]), " ").alias("last_urls"), F.array_join(F.slice(errors, F.greatest(F.size(errors) - 9, F.lit(1)), F.lit(10)), "|").alias("last_errors"))


def html_pages(spark, d):
    x = table(spark, d, "raw_pages").select("url", F.concat(F.lit("<html><head><title> "), T.html_escape(F.coalesce("title", F.lit(""))), F.lit(" </title></head><body><nav>Menu</nav><article><p>"), F.replace(T.html_escape(F.coalesce("content", F.lit(""))), F.lit("\n"), F.lit("</p><p>")), F.lit('</p></article><a href="/a.ods">x</a><a href="#top">up</a><footer>end</footer></body></html>')).alias("html"))
    return html.parsed_pages(x).select("url", "title", F.md5("content").alias("content_md5"), "link_count", "document_count")


def job_status(spark, d):
    pages = table(spark, d, "crawl_pages").dropDuplicates(["page_id"]).groupBy("job_id").agg(F.count("*").alias("pages"), F.max_by("url", F.struct("page_idx", "page_id")).alias("last_url"))
    x = table(spark, d, "crawl_jobs").select("job_id", F.lower("status").alias("status"), F.coalesce("duration_seconds", F.lit(0.0)).alias("seconds"), "stats.max_depth_limit")
    return x.join(pages, "job_id", "left").select("job_id", "status", F.round("seconds", 1).alias("seconds"), "max_depth_limit", F.coalesce("pages", F.lit(0)).alias("pages"), "last_url")


QUERIES: dict = {f.__name__: f for f in [
    doc_word_count, doc_fingerprint, doc_lines, url_normalize, url_hosts, url_crawlable, url_same_domain, host_histogram, storage_paths, drop_reasons, drop_histogram, line_boilerplate, ui_lines, block_pages, clean_pages, clean_summary, sitewide_lines, removed_lines_top, page_retention, typical_and_worst_pages, copies_only_lines, report_copies, refetch_candidates, page_names, common_suffixes, content_export, export_documents, change_status, change_counts, catalog_upsert, latest_version,
    chunk_pages, passages, pages_left_whole, valid_questions, qa_rows_to_replace, qa_by_site, pages_with_passages, pages_todo, import_batches, vector_topk, vector_search, rag_prompts, rag_answers, rag_sources, vector_upsert, vector_delete, vector_stats, tidy_pages, layer_quality, page_review, text_agreement, repeated_line_strip, upload_list, read_summary, upload_crawl_pages, job_list, job_page, job_search, job_totals, job_errors, job_union, latest_pages, daily_quota, failure_streaks, lockouts, cleanup_runs, retention_plan, source_quota, usable_items,
    text_utilities, site_names, schedules, due_schedules, systematic_sample, job_status,
    qa_rows_backup, push_items, push_replaced, passage_stats, import_totals, send_projection, vector_truncate, vector_index, answers, schedule_changes, schedules_left, lock_remaining, quota_used, upload_ids, stored_names, backup_names, upload_pictures, read_paths, upload_limits, retention_freed, stale_sessions, model_order, first_pages, feed_entries, cleaning_report, report_samples, profile_dry_run, job_documents, job_view, html_pages,
]}

SQL: dict = {
    "doc_word_count": f"SELECT doc_id, CAST(coalesce({S.wc('text')}, 0) AS INTEGER) words, CAST(len(list_filter(string_split_regex(coalesce(text, ''), {S.q(T.WS)}), lambda x: x <> '')) AS INTEGER) ws_words FROM documents",
    "doc_fingerprint": f"SELECT doc_id, sha256({S.norm('coalesce(text, chr(32))')}) content_hash FROM documents",
    "doc_lines": f"SELECT doc_id, CAST(i - 1 AS INTEGER) pos, l[i] line FROM (SELECT doc_id, {S.lines('text')} l FROM documents), unnest(range(1, len(l) + 1)) u(i)",
    "url_normalize": rf"""
WITH p AS (SELECT rec_id, url, {S.part('url', 1)} s, lower({S.part('url', 2)}) a, {S.part('url', 3)} p, {S.part('url', 4)} q FROM import_records),
k AS (SELECT *, list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains([{', '.join(S.q(t) for t in U.TRACKING)}], lower(split_part(x, '=', 1))) AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')),
      lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END) ps FROM p)
SELECT rec_id, CASE WHEN url IS NULL THEN NULL ELSE (CASE WHEN s = '' THEN 'https' ELSE lower(s) END) || '://' || a || (CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END)
  || (CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END) END url FROM k""",
    "url_hosts": rf"""
WITH h AS (SELECT rec_id, {S.clean_host('url')} c, {S.part('url', 2)} a, url FROM import_records WHERE url IS NOT NULL), p AS (SELECT *, string_split(c, '.') p FROM h)
SELECT rec_id, c clean_host, CASE WHEN len(p) >= 3 AND length(p[-1]) = 2 AND list_contains([{', '.join(S.q(t) for t in U.SECOND_LEVEL)}], p[-2]) THEN array_to_string(p[-3:], '.') WHEN len(p) >= 2 THEN array_to_string(p[-2:], '.') ELSE c END root,
  CASE WHEN a <> '' THEN a ELSE url END host FROM p""",
    "url_crawlable": rf"SELECT rec_id, lower({S.part('url', 1)}) IN ('http', 'https') AND NOT regexp_matches(lower({S.part('url', 3)}), '\.(png|jpg|jpeg|gif|webp|svg|bmp|ico|mp3|mp4|wav|avi|mkv|mov|flv|zip|tar|gz|7z|rar|bz2|exe|msi|bin|dmg|apk|css|js|json|xml|woff|woff2|ttf|eot)$') crawlable FROM import_records WHERE url IS NOT NULL",
    "url_same_domain": rf"""
WITH x AS (SELECT DISTINCT page_id, url, seed_url, {S.clean_host('url')} a, {S.clean_host('seed_url')} b FROM crawl_pages WHERE url IS NOT NULL)
SELECT page_id, a = b same, array_to_string(string_split(a, '.')[-2:], '.') = array_to_string(string_split(b, '.')[-2:], '.') same_root FROM x""",
    "host_histogram": f"SELECT {S.clean_host('url')} host, count(*) n FROM import_records WHERE url IS NOT NULL GROUP BY 1 ORDER BY n DESC, host LIMIT 4",
    "storage_paths": f"SELECT job_id, job_id || '_' || regexp_replace({S.clean_host('seed_url')}, '[^A-Za-z0-9._-]', '_', 'g') || '.json' path FROM crawl_jobs",
    "drop_reasons": f"WITH {S.JUDGED} SELECT id page_id, reason FROM jd",
    "drop_histogram": f"WITH {S.JUDGED} SELECT job, split_part(reason, ' of ', 1) reason, count(*) n FROM jd WHERE reason IS NOT NULL GROUP BY 1, 2",
    "line_boilerplate": f"WITH {S.JUDGED}, {S.BOILER} SELECT job, md5(line) line, pages, kept FROM bl",
    "ui_lines": f"WITH l AS (SELECT unnest({S.lines('content')}) line FROM raw_pages) SELECT line, count(*) n FROM l WHERE {S.ui('line')} GROUP BY 1",
    "block_pages": f"SELECT DISTINCT page_id, {S.block('content')} block FROM crawl_pages",
    "clean_pages": f"WITH {S.JUDGED}, {S.BOILER}, {S.CLEANED} SELECT jd.id page_id, jd.job, md5(CASE WHEN refused IS NULL THEN clean ELSE coalesce(jd.content, '') END) content_md5, CAST(CASE WHEN refused IS NULL THEN {S.wc('clean')} ELSE coalesce({S.wc('jd.content')}, 0) END AS INTEGER) word_count, refused IS NULL applied FROM jd JOIN su USING (job) LEFT JOIN (SELECT id, clean FROM cl) c USING (id) WHERE refused IS NOT NULL OR reason IS NULL",
    "clean_summary": f"""WITH {S.JUDGED}, {S.BOILER}, {S.CLEANED} SELECT job, CASE WHEN own THEN 'profile' ELSE 'auto' END AS "mode", pages_in, pages_out, coalesce((SELECT count(*) FROM bl WHERE bl.job = su.job), 0) boilerplate_lines, CAST(wb AS BIGINT) words_before, CAST(wa AS BIGINT) words_after,
  CASE WHEN wb > 0 THEN round(wa / wb, 3) ELSE 1.0 END kept_share, CASE WHEN wk > 0 THEN round(wa / wk, 3) ELSE 1.0 END kept_pages_share, refused FROM su""",
    "sitewide_lines": f"""WITH {S.JUDGED}, {S.BOILER}, {S.CLEANED}, f AS (SELECT job, line, min((idx, id, pos)) o FROM rm WHERE gone GROUP BY 1, 2), p AS (SELECT DISTINCT job, line FROM kk),
r AS (SELECT job, line, row_number() OVER (PARTITION BY job ORDER BY o) AS n FROM f ANTI JOIN p USING (job, line)) SELECT job, CAST(n AS INTEGER) AS "at", line FROM r WHERE n <= 200""",
    "removed_lines_top": f"""WITH {S.JUDGED}, {S.BOILER}, {S.CLEANED}, g AS (SELECT DISTINCT job, id, line FROM rm ANTI JOIN kk USING (job, id, line)), c AS (SELECT job, line, count(*) n FROM g GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY job ORDER BY n DESC, line) AS INTEGER) r FROM c) SELECT * FROM r WHERE r <= 25""",
    "page_retention": f"""WITH {S.JUDGED}, {S.BOILER}, {S.CLEANED}, w AS (SELECT job, id, {S.wc("array_to_string(ls, ' ')")} b, {S.wc('clean')} a FROM cl) SELECT id page_id, CAST(b AS INTEGER) AS "before", CAST(a AS INTEGER) AS "after", CASE WHEN b > 0 THEN round(a / b, 6) ELSE 1.0 END retention FROM w""",
    "typical_and_worst_pages": f"""WITH {S.JUDGED}, {S.BOILER}, {S.CLEANED}, w AS (SELECT job, id, {S.wc("array_to_string(ls, ' ')")} b, {S.wc('clean')} a FROM cl), v AS (SELECT job, id, CASE WHEN b > 0 THEN round(a / b, 6) ELSE 1.0 END t FROM w),
r AS (SELECT job, id, row_number() OVER (PARTITION BY job ORDER BY t, id) r, count(*) OVER (PARTITION BY job) n FROM v) SELECT job, id page_id, CAST(r AS INTEGER) AS "rank", r = n // 2 + 1 typical FROM r WHERE r <= 4 OR r = n // 2 + 1""",
    "copies_only_lines": f"WITH {S.JUDGED}, a AS (SELECT DISTINCT job, url, unnest(ls) line FROM jd WHERE reason IS NOT NULL), b AS (SELECT DISTINCT job, unnest(ls) line FROM jd WHERE reason IS NULL) SELECT job, url, count(*) AS lines FROM a ANTI JOIN b USING (job, line) GROUP BY 1, 2",
    "report_copies": f"WITH {S.JUDGED.replace(S.block('content') + ' blk', 'false blk').replace('len(ls) > 0 AND fid <> id', 'fid <> id')} SELECT id page_id, reason FROM jd",
    "refetch_candidates": f"WITH {S.JUDGED} SELECT id page_id, url FROM jd WHERE reason LIKE 'block page%'",
    "latest_version": "SELECT url, arg_max(page_id, (coalesce(completed_at, TIMESTAMP '0001-01-01'), page_idx, page_id)) page_id FROM crawl_pages JOIN crawl_jobs USING (job_id) WHERE url IS NOT NULL GROUP BY 1",
}

_URL = SQL["url_normalize"]
_NURL = _URL[_URL.rindex("CASE WHEN url IS NULL") : _URL.rindex(" url FROM k")]


def _with_key(src: str, cols: str) -> str:
    """The rows of ``src`` with their normalised url as ``key``."""
    body = _URL.replace("rec_id, url", f"{cols}, url").replace("FROM import_records", f"FROM ({src})")
    return body[: body.rindex("SELECT rec_id")] + f"SELECT {cols}, url, {_NURL} AS key FROM k"


_CRAWL = "SELECT DISTINCT ON (page_id) page_id, job_id, title, content, crawled_at, url FROM crawl_pages ORDER BY page_id"
_CATALOG = f"""
oldp AS (SELECT * FROM ({_with_key(_CRAWL, 'page_id, job_id, title, content, crawled_at')}) WHERE NOT coalesce(crawled_at >= TIMESTAMP '2024-07-01', false)),
newp AS (SELECT * FROM ({_with_key(_CRAWL, 'page_id, job_id, title, content, crawled_at')}) WHERE crawled_at >= TIMESTAMP '2024-07-01'),
oc AS (SELECT key, arg_max(page_id, (coalesce(crawled_at, TIMESTAMP '0001-01-01'), page_id)) page_id FROM oldp WHERE url IS NOT NULL GROUP BY 1),
nc AS (SELECT key, arg_max(page_id, (crawled_at, page_id)) page_id FROM newp WHERE url IS NOT NULL GROUP BY 1),
hs AS (SELECT page_id, job_id, sha256({S.norm("coalesce(content, '')")}) h FROM (SELECT * FROM oldp UNION ALL SELECT * FROM newp)),
st AS (SELECT n.page_id, n.job_id, CASE WHEN coalesce(a.h, b.h) IS NULL THEN 'new' WHEN coalesce(a.h, b.h) = hs.h THEN 'skipped_unchanged' ELSE 'updated' END status FROM newp n JOIN hs USING (page_id)
      LEFT JOIN (SELECT key, h FROM oc JOIN hs USING (page_id)) a ON a.key = n.key LEFT JOIN (SELECT key, h FROM oc JOIN hs USING (page_id)) b ON b.key = n.url)"""
SQL |= {
    "change_status": f"WITH {_CATALOG} SELECT page_id, status FROM st",
    "change_counts": f"WITH {_CATALOG} SELECT job_id, count(*) FILTER (status = 'new') pages_new, count(*) FILTER (status = 'updated') pages_updated, count(*) FILTER (status = 'skipped_unchanged') pages_skipped FROM st GROUP BY 1",
    "catalog_upsert": f"WITH {_CATALOG} SELECT key url, h content_hash, job_id FROM (SELECT * FROM nc UNION ALL SELECT * FROM oc ANTI JOIN nc USING (key)) JOIN hs USING (page_id)",
}

_ESC = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
SQL |= {
    "page_names": f"WITH {S.NAMED} SELECT id page_id, name, short FROM n4",
    "common_suffixes": f"WITH {S.NAMED} SELECT job job_id, suffix FROM s4",
    "content_export": f"WITH {S.NAMED} SELECT job, idx, short page, md5(text) content_md5 FROM nm WHERE text <> ''",
    "export_documents": f"WITH {S.NAMED} SELECT job, md5(string_agg('<h2>' || {_ESC('short')} || '</h2>' || (SELECT string_agg('<p>' || {_ESC('p')} || '</p>', '' ORDER BY i) FROM (SELECT unnest(string_split(text, chr(10) || chr(10))) p, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) i)), chr(10) ORDER BY idx)) html_md5 FROM nm WHERE text <> '' GROUP BY 1",
}

_WS = S.q(T.WS)
_BASE = "split_part(url, '#', 1)"
_VALID = "coalesce(length(trim(question)) BETWEEN 8 AND 220 AND (contains(question, '?') OR contains(question, '？')), false)"
_DIST = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))"
_TOP = f"tp AS (SELECT * FROM (SELECT b.vec_id query_id, a.vec_id, {_DIST} d, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_DIST}, a.vec_id) r FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE r <= 4)"
_MATCH = f"{_TOP}, mt AS (SELECT tp.*, text, url, title, round(greatest(0, 1 - d / 2), 3) similarity FROM tp LEFT JOIN (SELECT DISTINCT ON (doc_id) * FROM documents ORDER BY doc_id) x ON x.doc_id = tp.vec_id)"
_PAGES = "up AS (SELECT upload_id, CAST(i - 1 AS INTEGER) AS pos, pages[i].n n, coalesce(pages[i].text, '') t, pages[i].engine engine, pages[i].review review FROM (SELECT DISTINCT ON (upload_id) * FROM uploads ORDER BY upload_id), unnest(range(1, len(pages) + 1)) u(i))"
_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), {S.q(T.WORD)}))"


def _tidy(c: str) -> str:
    x = rf"regexp_replace(regexp_replace(regexp_replace({c}, {S.q(intake.CONTROL)}, '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '\r\n?', chr(10), 'g')"
    return S.strip(rf"regexp_replace(array_to_string(list_transform(string_split({x}, chr(10)), lambda v: {S.strip("regexp_replace(v, '[ \t]+', ' ', 'g')")}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")


_SOLID = f"regexp_replace(coalesce(text, ''), {_WS}, '', 'g')"
_LINK = "split_part(coalesce(link, ''), '#', 1)"


def _plain(c: str) -> str:
    x = f"regexp_replace(coalesce({c}, ''), '<[^>]+>', '', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&#8217;", "’"), ("&#8211;", "–"), ("&amp;", "&")):
        x = f"replace({x}, {S.q(a)}, {S.q(b)})"
    return S.strip(x)


_ITEMS = f"""
i0 AS (SELECT DISTINCT ON (item_id) item_id, {_LINK} l, lower(coalesce(item_type, 'post')) kind, {_plain('title')} t, {S.strip("coalesce(content, '')")} c, coalesce(is_protected, false) p, published_at FROM source_items ORDER BY item_id),
i1 AS (SELECT *, {S.clean_host('l')} host, string_split(trim({S.part('l', 3)}, '/'), '/')[-1] sl, CASE WHEN t <> '' AND NOT starts_with(c, t) THEN t || chr(10) || chr(10) || c ELSE c END x FROM i0),
it AS (SELECT * FROM i1 WHERE l <> '' AND NOT p AND NOT regexp_matches(CASE WHEN sl = '' THEN 'home' ELSE sl END, {S.q(sources_api.JUNK_SLUG)}) AND {S.wc('x')} >= CASE WHEN kind = 'page' THEN 30 ELSE 8 END)"""
SQL |= {
    "valid_questions": f"SELECT qa_id, {_VALID} valid FROM qa_pairs",
    "qa_rows_to_replace": f"SELECT qa_id FROM qa_pairs WHERE {_BASE} IN (SELECT {_BASE} FROM qa_pairs WHERE created_at >= TIMESTAMP '2024-06-01' AND url IS NOT NULL)",
    "qa_rows_backup": f"SELECT qa_id, md5(coalesce(content, '')) content_md5, CASE WHEN {_BASE} IN (SELECT {_BASE} FROM qa_pairs WHERE created_at >= TIMESTAMP '2024-06-01' AND url IS NOT NULL) THEN 'backup' ELSE 'kept' END state FROM qa_pairs",
    "import_totals": f"SELECT count(*) pages, CAST(0 AS BIGINT) failed_batches, count(*) created, CAST(0 AS BIGINT) updated, count(*) FILTER (length(content) > 200) embedded, false aborted FROM (SELECT DISTINCT page_id, content FROM crawl_pages) WHERE {S.strip('content')} <> ''",
    "send_projection": f"SELECT coalesce(url, '') url, coalesce(title, '') title, md5(content) content_md5 FROM crawl_pages WHERE {S.strip('content')} <> ''",
    "qa_by_site": f"SELECT source_name, count(*) pairs, count(DISTINCT {_BASE}) pages, count(*) FILTER ({_VALID}) questions FROM qa_pairs GROUP BY 1",
    "pages_with_passages": f"SELECT DISTINCT {_BASE} base FROM crawl_pages WHERE change_status = 'skipped_unchanged' AND url IS NOT NULL",
    "pages_todo": f"SELECT DISTINCT page_id FROM crawl_pages WHERE url IS NOT NULL AND {_BASE} NOT IN (SELECT {_BASE} FROM crawl_pages WHERE change_status = 'skipped_unchanged' AND url IS NOT NULL)",
    "import_batches": f"WITH x AS (SELECT DISTINCT page_id, job_id, page_idx, content FROM crawl_pages), n AS (SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY page_idx, page_id) - 1) // 8 + 1 b FROM x WHERE {S.strip('content')} <> '') SELECT job_id, CAST(b AS INTEGER) batch, count(*) AS rows, min(page_idx) first_idx FROM n GROUP BY 1, 2",
    "vector_topk": f"SELECT a.vec_id, round(greatest(0, 1 - {_DIST} / 2), 3) similarity, round({_DIST}, 4) distance FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {_DIST}, a.vec_id LIMIT 10",
    "vector_search": f"WITH {_TOP} SELECT query_id, vec_id, round(d, 4) distance, CAST(r AS INTEGER) AS rank FROM tp",
    "rag_prompts": f"""WITH {_MATCH} SELECT query_id, md5('You are the assistant. Answer only from the passages, in the language of the question, and cite them as [Passage 1].' || chr(10) || string_agg(chr(10) || '[Passage ' || r || '] (Source: ' || coalesce(url, 'N/A') || ')' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY r)
  || chr(10) || 'Question: What is near ' || query_id || '?' || chr(10) || 'Answer:') prompt_md5 FROM mt GROUP BY query_id""",
    "rag_answers": """WITH """ + _MATCH + """ SELECT query_id, md5(string_agg(CASE WHEN r = 1 THEN 'Based on the knowledge crawled from **' || coalesce(title, 'the crawled website') || '**:' || chr(10) || chr(10) || '> ' || trim(coalesce(text, '')) || chr(10) || chr(10) || 'This information was retrieved from the official indexed documents.'
  ELSE (CASE WHEN r = 2 THEN chr(10) || chr(10) || '**Additional Context:**' ELSE '' END) || chr(10) || '- *[Passage ' || r || ']*: ' || left(trim(coalesce(text, '')), 200) || '...' END, '' ORDER BY r)) answer_md5 FROM mt GROUP BY query_id""",
    "rag_sources": f"WITH {_MATCH}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY r) k FROM mt WHERE url IS NOT NULL AND url <> '') SELECT query_id, CAST(r AS INTEGER) AS rank, url, coalesce(nullif(title, ''), url) title, similarity FROM s WHERE k = 1",
    "vector_upsert": 'SELECT vec_id + 100 AS vec_id, label + 100 AS label, CAST(embedding[1] AS DOUBLE) AS "first" FROM embeddings UNION ALL SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) FROM embeddings WHERE vec_id NOT IN (SELECT vec_id + 100 FROM embeddings)',
    "vector_delete": "SELECT vec_id, label, (SELECT count(*) FROM embeddings WHERE label = 3) deleted FROM embeddings WHERE label <> 3 OR label IS NULL",
    "vector_truncate": 'SELECT CAST(0 AS BIGINT) AS "left", count(*) deleted FROM embeddings',
    "vector_stats": "SELECT label, count(*) vectors FROM embeddings GROUP BY 1",
    "tidy_pages": f"WITH {_PAGES} SELECT upload_id, pos AS \"at\", md5({_tidy('t')}) text_md5 FROM up",
    "layer_quality": f"""WITH x AS (SELECT doc_id, {S.strip("coalesce(text, '')")} t, {_SOLID} s, list_sort(list_transform({S.lines('text')}, lambda v: length(v))) l FROM documents)
SELECT doc_id, CASE WHEN length(t) < 40 THEN 'empty' WHEN length(regexp_replace(s, '[\\x{{00}}-\\x{{7f}}{intake.GOOD}]', '', 'g')) > 0.10 * length(s) THEN 'garbled' WHEN len(l) >= 8 AND l[len(l) // 2 + 1] <= 5 THEN 'garbled' ELSE 'good' END quality FROM x""",
    "page_review": f"""WITH {_PAGES}, w AS (SELECT *, len({_WORDS('t')}) c FROM up)
SELECT upload_id, pos AS "at", CASE WHEN c < 5 AND engine IN ('gemini', 'openai') AND {S.strip('t')} = '' THEN false WHEN c < 5 THEN true ELSE coalesce(engine = 'tesseract', false) END review,
CASE WHEN c < 5 AND engine IN ('gemini', 'openai') AND {S.strip('t')} = '' THEN '' WHEN c < 5 THEN 'very little text' WHEN engine = 'tesseract' THEN 'read by Tesseract only' ELSE '' END reason FROM w""",
    "text_agreement": f"""WITH {_PAGES}, w AS (SELECT upload_id, pos, {_WORDS('t')} a FROM up)
SELECT x.upload_id, x.pos AS "at", round(coalesce(len(list_intersect(x.a, y.a)) / nullif(least(len(x.a), len(y.a)), 0), 0), 6) agreement FROM w x JOIN w y ON y.upload_id = x.upload_id AND y.pos = x.pos + 1""",
    "repeated_line_strip": f"""WITH {_PAGES}, l AS (SELECT upload_id, pos, i, string_split(t, chr(10))[i] line FROM up, unnest(range(1, len(string_split(t, chr(10))) + 1)) u(i)),
n AS (SELECT upload_id, count(*) FILTER ({S.strip('t')} <> '') full_ FROM up GROUP BY 1),
c AS (SELECT upload_id, lower({S.norm('line')}) k, count(DISTINCT pos) c FROM l WHERE {S.strip('line')} <> '' AND length({S.strip('line')}) <= 120 GROUP BY 1, 2),
g AS (SELECT upload_id, k FROM c JOIN n USING (upload_id) WHERE full_ >= 6 AND c >= greatest(5, floor(0.4 * full_))),
k AS (SELECT l.*, {S.strip('line')} <> '' solid, g.k IS NOT NULL AND {S.strip('line')} <> '' gone FROM l LEFT JOIN g ON g.upload_id = l.upload_id AND g.k = lower({S.norm('line')})),
m AS (SELECT upload_id, pos, min(i) FILTER (solid AND NOT gone) a, max(i) FILTER (solid AND NOT gone) z FROM k GROUP BY 1, 2),
f AS (SELECT k.*, NOT gone AND coalesce(i IN (a, z), false) AND length({S.strip('line')}) <= 12 AND regexp_matches({S.strip('line')}, {S.q(intake.PAGE_NO)}) num FROM k JOIN m USING (upload_id, pos)),
r AS (SELECT upload_id, pos, count(*) FILTER (gone OR num) removed, coalesce(string_agg(CASE WHEN num THEN '' ELSE line END, chr(10) ORDER BY i) FILTER (NOT gone), '') x FROM f GROUP BY 1, 2)
SELECT upload_id, pos AS "at", md5(CASE WHEN full_ >= 6 THEN {_tidy('x')} ELSE t END) text_md5, CAST(CASE WHEN full_ >= 6 THEN removed ELSE 0 END AS INTEGER) removed FROM r JOIN n USING (upload_id) JOIN up USING (upload_id, pos)""",
    "upload_list": """SELECT upload_id, file_name, doc_kind, lower(status) status, created_at, CAST(coalesce(len(pages), 0) AS INTEGER) pages, CAST(coalesce(len(list_filter(pages, lambda v: coalesce(v.review, false))), 0) AS INTEGER) review_pages,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(pages, lambda v: v.engine), lambda e: e IS NOT NULL AND e <> ''))), ','), '') engines FROM (SELECT DISTINCT ON (upload_id) * FROM uploads ORDER BY upload_id)""",
    "read_summary": f"WITH {_PAGES} SELECT engine, count(*) pages, count(*) FILTER (coalesce(review, false)) review FROM up GROUP BY 1",
    "upload_crawl_pages": f"""WITH {_PAGES}, c AS (SELECT upload_id, count(*) many FROM up GROUP BY 1), f AS (SELECT DISTINCT ON (upload_id) upload_id, file_name FROM uploads ORDER BY upload_id)
SELECT upload_id, 'https://uploads.invalid/' || upload_id || '#p' || n url, coalesce(file_name, '') || CASE WHEN many > 1 THEN ' - page ' || n ELSE '' END title, md5(t) content_md5, CAST(len(list_filter(string_split_regex(t, {_WS}), lambda v: v <> '')) AS INTEGER) word_count FROM up JOIN c USING (upload_id) JOIN f USING (upload_id) WHERE {S.strip('t')} <> ''""",
    "job_list": "SELECT job_id, lower(status) status, total_pages_crawled, completed_at FROM crawl_jobs ORDER BY completed_at DESC NULLS LAST, job_id",
    "job_page": "SELECT job_id, completed_at FROM crawl_jobs ORDER BY completed_at DESC NULLS LAST, job_id LIMIT 10 OFFSET (SELECT (least(3, greatest(1, CAST(ceil(count(*) / 10) AS INTEGER))) - 1) * 10 FROM crawl_jobs)",
    "job_search": "SELECT job_id, seed_url FROM crawl_jobs WHERE contains(lower(job_id), 'edu') OR contains(lower(seed_url), 'edu')",
    "job_totals": "SELECT count(*) jobs, CAST(sum(total_pages_crawled) AS BIGINT) pages, count(*) FILTER (lower(status) IN ('queued', 'running')) active FROM crawl_jobs",
    "job_errors": "SELECT job_id, stats.max_pages_limit max_pages, coalesce(stats.pages_new, 0) pages_new, CAST(coalesce(len(stats.errors), 0) AS INTEGER) errors, total_pages_crawled, least(100, CAST(round(100.0 * total_pages_crawled / nullif(stats.max_pages_limit, 0)) AS INTEGER)) progress FROM crawl_jobs",
    "job_union": "SELECT job_id, CASE WHEN lower(status) <> 'completed' THEN 'running' ELSE 'saved' END state FROM crawl_jobs",
    "latest_pages": "SELECT job_id, page_id, page_idx, CAST(r AS INTEGER) r FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page_idx DESC, page_id DESC) r FROM (SELECT DISTINCT job_id, page_id, page_idx FROM crawl_pages)) WHERE r <= 5",
    "daily_quota": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) n, count(*) > 100 AS over FROM events GROUP BY 1, 2",
    "failure_streaks": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) g FROM events)
SELECT user_id, min(ts) AS start, max(ts) AS stop, CAST(count(*) AS INTEGER) AS length FROM x WHERE event_type = 'error' GROUP BY user_id, g HAVING count(*) >= 3""",
    "cleanup_runs": "WITH x AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) b FROM events WHERE event_type = 'purchase') SELECT user_id, event_id FROM x WHERE b IS NULL OR epoch_us(ts) - epoch_us(b) >= 20 * 3600000000",
    "retention_plan": """WITH x AS (SELECT DISTINCT upload_id, doc_kind, date_diff('day', CAST(created_at AS DATE), DATE '2025-06-01') age FROM uploads), r AS (SELECT *, row_number() OVER (PARTITION BY doc_kind ORDER BY age, upload_id) r, count(*) OVER (PARTITION BY doc_kind) m FROM x WHERE age IS NOT NULL)
SELECT upload_id, CASE WHEN m = 1 THEN age > 30 ELSE r > 1 AND age > 7 END AS "delete" FROM r""",
    "usable_items": f"WITH {_ITEMS} SELECT item_id, kind FROM it",
    "source_quota": f"""WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY host, kind ORDER BY published_at DESC NULLS LAST, item_id) r FROM it),
k AS (SELECT *, CASE kind WHEN 'page' THEN 0 WHEN 'post' THEN 2 ELSE 1 END pl FROM r WHERE r <= CASE kind WHEN 'post' THEN 6 WHEN 'page' THEN 2 ELSE 3 END), q AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY pl, kind, r) rank FROM k)
SELECT item_id, host, kind, CAST(rank AS INTEGER) AS rank FROM q WHERE rank <= 6""",
}

_ESC5 = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"
_SITE = f"regexp_replace(lower({S.part('seed_url', 2)}), '^www\\.', '')"
_AGO = "(epoch_us(TIMESTAMP '2026-01-01') - epoch_us(created_at)) // 1000000"
_SCHED = "s0 AS (SELECT rtrim(lower(seed_url), '/') seed, max(completed_at) c, CAST(count(*) AS INTEGER) runs FROM crawl_jobs GROUP BY 1), s1 AS (SELECT *, c + INTERVAL 10 DAY nx, (epoch_us(c + INTERVAL 10 DAY) - epoch_us(TIMESTAMP '2024-11-15')) / 86400000000 lf FROM s0)"
SQL |= {
    "text_utilities": rf"""SELECT qa_id, left({S.strip(r"regexp_replace(coalesce(question, ''), '[\x{00}-\x{1f}\x{7f}]', '', 'g')")}, 40) short, md5({_ESC5("coalesce(content, '')")}) escaped,
  md5(replace(regexp_replace(regexp_replace({_ESC5("coalesce(content, '')")}, '\*\*([^*\n]+)\*\*', '<strong>\1</strong>', 'g'), '(?m)^&gt; (.*)$', '<blockquote>\1</blockquote>', 'g'), chr(10), '<br>')) marked,
  CASE WHEN created_at IS NULL THEN NULL WHEN {_AGO} < 60 THEN 'just now' WHEN {_AGO} < 3600 THEN ({_AGO}) // 60 || 'm ago' WHEN {_AGO} < 86400 THEN ({_AGO}) // 3600 || 'h ago' ELSE ({_AGO}) // 86400 || 'd ago' END ago FROM qa_pairs""",
    "site_names": f"SELECT job_id, {_SITE} site, upper(left(split_part({_SITE}, '.', 1), 1)) || substr(split_part({_SITE}, '.', 1), 2) brand, 'Crawl: ' || {_SITE} title FROM crawl_jobs",
    "schedules": f"WITH {_SCHED} SELECT seed, runs, c last_crawled, nx next_run, CAST(CASE WHEN lf IS NOT NULL THEN greatest(0, floor(lf)) END AS INTEGER) days_remaining, coalesce(lf <= 0, false) due FROM s1",
    "due_schedules": f"WITH {_SCHED} SELECT seed, nx next_run FROM s1 WHERE lf <= 0 ORDER BY nx, seed LIMIT 1",
    "systematic_sample": "WITH x AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY qa_id) r, CAST(greatest(1, count(*) OVER (PARTITION BY source_name) // 5) AS INTEGER) AS step FROM qa_pairs) SELECT qa_id, step FROM x WHERE (r - 1) % step = 0",
    "job_status": """WITH p AS (SELECT job_id, count(*) pages, arg_max(url, (page_idx, page_id)) last_url FROM (SELECT DISTINCT ON (page_id) * FROM crawl_pages ORDER BY page_id) GROUP BY 1)
SELECT job_id, lower(status) status, round(coalesce(duration_seconds, 0), 1) AS "seconds", stats.max_depth_limit max_depth_limit, coalesce(pages, 0) pages, last_url FROM crawl_jobs LEFT JOIN p USING (job_id)""",
}

SQL |= {
    "passages": f"""WITH RECURSIVE {S.NAMED},
pa AS (SELECT id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda v: {S.strip('v')}), lambda v: v <> '') l FROM nm),
pw AS (SELECT id, i, l[i] p, len(list_filter(string_split_regex(l[i], {_WS}), lambda v: v <> '')) w FROM pa, unnest(range(1, len(l) + 1)) u(i)),
rc AS (SELECT id, i, w, w n, 1 g FROM pw WHERE i = 1
       UNION ALL SELECT x.id, x.i, x.w, CASE WHEN rc.n >= {chunks.TARGET} OR rc.n + x.w > {chunks.MOST} THEN x.w ELSE rc.n + x.w END, CASE WHEN rc.n >= {chunks.TARGET} OR rc.n + x.w > {chunks.MOST} THEN rc.g + 1 ELSE rc.g END FROM rc JOIN pw x ON x.id = rc.id AND x.i = rc.i + 1),
gs AS (SELECT id, g, sum(w) s, max(g) OVER (PARTITION BY id) m FROM rc GROUP BY 1, 2),
gm AS (SELECT id, g, CASE WHEN g = m AND m > 1 AND s < {chunks.LAST} THEN g - 1 ELSE g END h FROM gs),
ps AS (SELECT id, h, string_agg(p, chr(10) || chr(10) ORDER BY i) x, sum(w) s FROM rc JOIN gm USING (id, g) JOIN (SELECT id, i, p FROM pw) q USING (id, i) GROUP BY 1, 2),
pn AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY h) n FROM ps WHERE s >= {chunks.TINY})
SELECT job, split_part(url, '#', 1) || '#c' || n url, left(trim(short || ': ' || array_to_string(list_filter(string_split_regex(x, {_WS}), lambda v: v <> '')[1:12], ' ')), {chunks.QUESTION[1]}) title, md5(short || chr(10) || chr(10) || x) content_md5 FROM pn JOIN nm USING (id)""",
    "lockouts": """WITH RECURSIVE x AS (SELECT user_id, epoch_us(ts) t, event_type = 'signup' ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_type = 'signup') r FROM events WHERE event_type IN ('error', 'signup')),
a(user_id, r, n, until, lk, t) AS (SELECT user_id, r, CASE WHEN ok THEN 0 ELSE 1 END, CAST(-1 AS BIGINT), false, t FROM x WHERE r = 1
  UNION ALL SELECT x.user_id, x.r, CASE WHEN x.t < a.until THEN a.n WHEN x.ok THEN 0 WHEN a.n + 1 >= 3 THEN 0 ELSE a.n + 1 END, CASE WHEN x.t >= a.until AND NOT x.ok AND a.n + 1 >= 3 THEN x.t + 86400000000 ELSE a.until END, x.t >= a.until AND NOT x.ok AND a.n + 1 >= 3, x.t
  FROM a JOIN x ON x.user_id = a.user_id AND x.r = a.r + 1)
SELECT user_id, make_timestamp(t) locked_at, make_timestamp(until) AS until FROM a WHERE lk""",
}
_SEP = "chr(10) || chr(10)"
SQL["chunk_pages"] = rf"""WITH RECURSIVE
c0 AS (SELECT DISTINCT ON (page_id) page_id, job_id, page_idx, url, {S.strip("coalesce(content, '')")} t FROM crawl_pages ORDER BY page_id),
c1 AS (SELECT page_id, k, {S.strip('p')} p FROM (SELECT page_id, unnest(string_split_regex(t, '\n+')) p, unnest(range(1, len(string_split_regex(t, '\n+')) + 1)) k FROM c0 WHERE length(t) > {chunks.CHUNK})),
c2 AS (SELECT page_id, k, CASE WHEN length(p) > {chunks.CHUNK} THEN string_split(regexp_replace(p, '([.!?।])' || {_WS}, '\1' || chr(1), 'g'), chr(1)) ELSE [p] END l, length(p) > {chunks.CHUNK} big FROM c1 WHERE p <> ''),
c3 AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k, j) u, l[j] x, CASE WHEN NOT big THEN 'p' WHEN j = 1 THEN 'f' ELSE 's' END kind FROM c2, unnest(range(1, len(l) + 1)) v(j)),
rc AS (SELECT page_id, CAST(0 AS BIGINT) u, '' AS cur, CAST([] AS VARCHAR[]) done FROM c0 WHERE length(t) > {chunks.CHUNK}
  UNION ALL SELECT rc.page_id, c3.u,
    CASE WHEN kind = 'f' THEN x WHEN length(cur) + length(x) + 1 <= {chunks.CHUNK} THEN CASE WHEN cur = '' THEN x WHEN kind = 's' THEN cur || ' ' || x ELSE cur || {_SEP} || x END
         WHEN kind = 's' THEN x WHEN cur <> '' THEN right({S.strip('cur')}, {chunks.OVERLAP}) || ' ' || x WHEN len(done) > 0 THEN right(done[-1], {chunks.OVERLAP}) || ' ' || x ELSE x END,
    CASE WHEN cur <> '' AND (kind = 'f' OR length(cur) + length(x) + 1 > {chunks.CHUNK}) THEN list_append(done, CASE WHEN kind = 's' THEN cur ELSE {S.strip('cur')} END) ELSE done END
  FROM rc JOIN c3 ON c3.page_id = rc.page_id AND c3.u = rc.u + 1),
fin AS (SELECT page_id, arg_max(cur, u) cur, arg_max(done, u) done FROM rc GROUP BY 1),
ch AS (SELECT page_id, CASE WHEN cur <> '' AND NOT list_contains(done, cur) THEN list_append(done, {S.strip('cur')}) ELSE done END l FROM fin
  UNION ALL SELECT page_id, [t] FROM c0 WHERE t <> '' AND length(t) <= {chunks.CHUNK}),
o AS (SELECT job_id, page_idx, url, CAST(i - 1 AS INTEGER) n, l[i] x FROM ch JOIN c0 USING (page_id), unnest(range(1, len(l) + 1)) v(i))
SELECT job_id || '_p' || page_idx || '_c' || n chunk_id, job_id, url, n chunk_index, md5(x) text_md5, CAST(length(x) AS INTEGER) char_count FROM o"""
_PASS = SQL["passages"]
SQL["pages_left_whole"] = (
    _PASS[: _PASS.rindex("SELECT job, split_part")].rstrip()
    + """,
nc AS (SELECT job, nm.id, idx, coalesce(c, 0) c, row_number() OVER (PARTITION BY job ORDER BY idx) r FROM nm LEFT JOIN (SELECT id, count(*) c FROM pn GROUP BY 1) k USING (id)),
bu AS (SELECT job, id, r, CASE WHEN c > 0 AND c <= 20 THEN c ELSE 0 END used, c > 0 AND c <= 20 fits FROM nc WHERE r = 1
  UNION ALL SELECT n.job, n.id, n.r, CASE WHEN n.c > 0 AND bu.used + n.c <= 20 THEN bu.used + n.c ELSE bu.used END, n.c > 0 AND bu.used + n.c <= 20 FROM bu JOIN nc n ON n.job = bu.job AND n.r = bu.r + 1)
SELECT id page_id FROM bu WHERE NOT fits"""
)

_SEED = "rtrim(seed_url, '/')"
_REG = f"""j AS (SELECT {_SEED} seed, max(completed_at) last_crawled, NOT bool_or(lower(status) = 'failed') enabled, bool_or(lower(status) = 'stopped') stopped,
  max(completed_at) FILTER (completed_at >= TIMESTAMP '2024-07-01') late FROM crawl_jobs WHERE seed_url IS NOT NULL GROUP BY 1)"""
_LOCKS = SQL["lockouts"]
_HEX = "md5(coalesce(file_name, ''))"
_BARE = f"regexp_replace({_SITE}, '[^a-z0-9.]+', '-', 'g')"
_REPORT = S.JUDGED.replace(S.block("content") + " blk", "false blk").replace("len(ls) > 0 AND fid <> id", "fid <> id").replace("FROM pg LEFT JOIN pr ON pr.domain = " + S.clean_host("seed_url"), "FROM pg LEFT JOIN pr ON false")
_REPORT += f""",
kp AS (SELECT job, count(*) kept FROM jd WHERE reason IS NULL GROUP BY 1),
ln AS (SELECT job, id, url, i pos, ls[i] line, ls, title FROM jd, unnest(range(1, len(ls) + 1)) u(i) WHERE reason IS NULL),
ld AS (SELECT job, line, count(DISTINCT id) pages FROM ln GROUP BY 1, 2),
bl AS (SELECT job, line FROM ld JOIN kp USING (job) WHERE pages >= greatest(3, ceil(0.3 * kept))),
rm AS (SELECT ln.*, {S.wc('ln.line')} n, bl.line IS NOT NULL AND NOT (ln.line = {S.norm("coalesce(title, '')")} OR {S.wc('ln.line')} >= 40 OR regexp_matches(ln.line, {S.q(cleaning.PROTECT)}) OR regexp_matches(ln.line, {S.q(cleaning.DAY_LABEL)})
  OR ({S.wc('ln.line')} >= 3 AND list_contains(ls[1:6], ln.line))) gone FROM ln LEFT JOIN bl ON bl.job = ln.job AND bl.line = ln.line),
pw AS (SELECT job, id, url, sum(n) AS b, sum(n) FILTER (NOT gone) AS a FROM rm GROUP BY 1, 2, 3),
pa AS (SELECT jd.job, jd.id, jd.url, coalesce(b, 0) b, coalesce(a, 0) a FROM jd LEFT JOIN (SELECT id, a, b FROM pw) p USING (id) WHERE reason IS NULL)"""
SQL |= {
    "schedule_changes": f"WITH {_REG} SELECT seed, enabled, last_crawled, last_crawled + INTERVAL 10 DAY next_run FROM j",
    "schedules_left": f"WITH {_REG} SELECT seed, enabled FROM j WHERE NOT stopped",
    "lock_remaining": _LOCKS[: _LOCKS.rindex("SELECT user_id, make_timestamp")] + """, w AS (SELECT user_id, make_timestamp(t) locked_at, CAST(greatest(0, floor((until - epoch_us(TIMESTAMP '2024-01-20 06:30:15')) / 1000000)) AS INTEGER) s FROM a WHERE lk)
SELECT user_id, locked_at, s // 3600 "hours", s % 3600 // 60 mins, s "seconds" FROM w""",
    "quota_used": """WITH u AS (SELECT CAST(created_at AS DATE) dd, CAST(coalesce(sum(page_count), 0) AS BIGINT) used FROM (SELECT DISTINCT upload_id, created_at, page_count FROM uploads) GROUP BY 1),
p AS (SELECT *, CAST(CASE WHEN dayofweek(dd) = 0 THEN 100 ELSE least(100, floor(used * 100 / 20 + 0.5)) END AS INTEGER) AS "percent" FROM u) SELECT CAST(dd AS VARCHAR) AS day, used, "percent", "percent" >= 80 AS high FROM p""",
    "upload_ids": f"SELECT upload_id, regexp_full_match(left({_HEX}, 12), '[a-f0-9]{{12}}') id, coalesce(regexp_full_match(file_name, '[a-f0-9]{{12}}'), false) AS name, regexp_full_match(left({_HEX}, 16), '[a-f0-9]{{16}}') AS session, false short_session FROM uploads",
    "stored_names": r"SELECT upload_id, CASE WHEN file_name IS NULL THEN '' ELSE left(regexp_replace(string_split(file_name || ' (copy) #1?.pdf', '/')[-1], '[^\p{L}\p{N}_ .()-]', '_', 'g'), 120) END AS name FROM uploads",
    "backup_names": f"SELECT job_id, 'qa-replaced-' || {_BARE} || '-20240101-0000.json' AS name FROM crawl_jobs",
    "upload_pictures": """SELECT upload_id, coalesce(list_contains(list_transform(pages, lambda p: p.image), pages[1].image) AND pages[1].image IS NOT NULL, false) AS "first", coalesce(list_contains(list_transform(pages, lambda p: p.image), 'p7.jpg'), false) seventh, coalesce(list_contains(list_transform(pages, lambda p: p.image), 'none.jpg'), false) AS "none" FROM uploads""",
    "read_paths": f"""WITH {_PAGES}, x AS (SELECT engine, {S.strip('t')} st, regexp_replace(t, {_WS}, '', 'g') s, list_sort(list_transform({S.lines('t')}, lambda v: length(v))) l FROM up)
SELECT CASE WHEN st = '' THEN 'blank' WHEN engine = 'pdf-text' AND length(st) >= 40 AND (length(regexp_replace(s, '[\\x{{00}}-\\x{{7f}}{intake.GOOD}]', '', 'g')) > 0.10 * length(s) OR (len(l) >= 8 AND l[len(l) // 2 + 1] <= 5)) THEN 'garbled_layer' WHEN engine = 'pdf-text' THEN 'text_layer' ELSE 'pictures' END AS path, count(*) pages FROM x GROUP BY 1""",
    "upload_limits": "WITH u AS (SELECT DISTINCT upload_id, uploader, size_bytes, status FROM uploads) SELECT uploader, CAST(sum(size_bytes) AS BIGINT) bytes, bool_or(coalesce(lower(status) = 'processing', false)) busy, coalesce(sum(size_bytes) <= 31457280, false) fits FROM u GROUP BY 1",
    "retention_freed": SQL["retention_plan"].replace("SELECT DISTINCT upload_id, doc_kind,", "SELECT DISTINCT upload_id, size_bytes, doc_kind,").replace("SELECT upload_id, CASE WHEN m = 1", ", k AS (SELECT size_bytes, CASE WHEN m = 1").replace('AS "delete" FROM r', 'AS gone FROM r) SELECT count(*) FILTER (gone) deleted, count(*) FILTER (NOT gone) kept, CAST(coalesce(sum(size_bytes) FILTER (gone), 0) AS BIGINT) freed_bytes FROM k'),
    "stale_sessions": "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 06:00:00'",
    "model_order": "SELECT CAST(p AS INTEGER) place, m model FROM (VALUES (0, 'gemini-2.0-flash'), (1, 'other'), (2, 'gemini-2.5-flash-lite'), (3, 'gemini-2.0-flash-lite'), (4, 'gemini-2.5-flash'), (5, 'gemini-1.5-flash')) v(p, m)",
    "first_pages": "SELECT job_id, page_id, CAST(r AS INTEGER) r FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page_idx, page_id) r FROM (SELECT DISTINCT job_id, page_id, page_idx FROM crawl_pages)) WHERE r <= 5",
    "feed_entries": f"""WITH {S.JUDGED}, i AS (SELECT DISTINCT item_id, regexp_replace(split_part(coalesce(link, ''), '?', 1), '^http://', 'https://') link FROM source_items)
SELECT item_id, link, link IN (SELECT url FROM jd WHERE reason LIKE 'block page%') wanted, CASE WHEN link IN (SELECT url FROM crawl_pages WHERE url IS NOT NULL) THEN 'filled' ELSE 'added' END state FROM i WHERE link <> ''""",
    "cleaning_report": f"""WITH {_REPORT},
pg2 AS (SELECT job, count(*) pages_in, count(*) FILTER (reason IS NOT NULL) dropped, sum({S.wc("array_to_string(ls, ' ')")}) wb FROM jd GROUP BY 1),
su AS (SELECT job, count(*) kept, sum(a) wa, count(*) FILTER (a < 100 OR (b > 0 AND a < 0.6 * b)) flagged FROM pa GROUP BY 1),
va AS (SELECT job, count(*) n, sum({S.wc('line')}) w FROM (SELECT DISTINCT job, line FROM rm WHERE gone) x ANTI JOIN (SELECT DISTINCT job, line FROM rm WHERE NOT gone) y USING (job, line) GROUP BY 1),
lo AS (SELECT job, count(DISTINCT url) n FROM (SELECT DISTINCT job, url, unnest(ls) line FROM jd WHERE reason IS NOT NULL) x ANTI JOIN (SELECT DISTINCT job, line FROM ln) y USING (job, line) GROUP BY 1)
SELECT job, pages_in, dropped, coalesce(kept, 0) kept, CAST(wb AS BIGINT) words_before, CAST(coalesce(wa, 0) + coalesce(va.w, 0) AS BIGINT) words_after, coalesce(flagged, 0) flagged, CAST(0 AS BIGINT) unique_removed, coalesce(va.n, 0) sitewide_lines, CAST(coalesce(va.w, 0) AS BIGINT) sitewide_words, coalesce(lo.n, 0) dropped_with_own_lines
FROM pg2 LEFT JOIN su USING (job) LEFT JOIN va USING (job) LEFT JOIN lo USING (job)""",
    "report_samples": f"""WITH {_REPORT}, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY CASE WHEN b > 0 THEN a / b ELSE 1.0 END, id) x FROM pa),
k AS (SELECT *, row_number() OVER (PARTITION BY job, x <= 2 ORDER BY md5(url), id) y FROM r) SELECT job, id page_id, x <= 2 worst FROM k WHERE x <= 2 OR y <= 3""",
    "job_documents": "SELECT j.job_id, j.seed_url, lower(status) status, completed_at, coalesce(n, 0) pages FROM crawl_jobs j LEFT JOIN (SELECT job_id, count(DISTINCT page_id) n FROM crawl_pages GROUP BY 1) p USING (job_id)",
    "job_view": """WITH p AS (SELECT job_id, coalesce(url, '') url, row_number() OVER (PARTITION BY job_id ORDER BY page_idx DESC, page_id DESC) r FROM (SELECT DISTINCT ON (page_id) * FROM crawl_pages ORDER BY page_id)),
l AS (SELECT job_id, string_agg(url, ' ' ORDER BY r) u FROM p WHERE r <= 5 GROUP BY 1)
SELECT job_id, u last_urls, coalesce(array_to_string(stats.errors[-10:], '|'), '') last_errors FROM crawl_jobs LEFT JOIN l USING (job_id)""",
    "html_pages": f"""WITH x AS (SELECT url, title, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda v: {S.strip('v')}), lambda v: v <> '') l FROM raw_pages), y AS (SELECT *, array_to_string(l, chr(10) || chr(10)) b FROM x)
SELECT url, CASE WHEN {S.strip("coalesce(title, '')")} = '' THEN coalesce(url, '') ELSE {S.strip('title')} END title, md5(CASE WHEN length(b) > 60 OR b = '' THEN b || CASE WHEN b = '' THEN 'x' || chr(10) || chr(10) || 'up' ELSE '' END ELSE b || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || 'up' END) content_md5, CAST(0 AS INTEGER) link_count, CAST(1 AS INTEGER) document_count FROM y""",
}
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY coalesce(completed_at, TIMESTAMP '0001-01-01') DESC, page_idx DESC, page_id DESC) rr FROM (SELECT DISTINCT ON (page_id) p.*, completed_at FROM crawl_pages p JOIN crawl_jobs USING (job_id) WHERE url IS NOT NULL ORDER BY page_id)) WHERE rr = 1"
SQL["profile_dry_run"] = f"WITH {S.JUDGED.replace('SELECT DISTINCT ON (page_id) job_id job,', f'SELECT {S.clean_host("seed_url")} job,').replace('FROM crawl_pages ORDER BY page_id', f'FROM ({_LATEST})')}, {S.BOILER}, {S.CLEANED} SELECT job, pages_in, pages_out, CAST(wb AS BIGINT) words_before, CAST(wa AS BIGINT) words_after, refused FROM su"
_SKIP = f"{_BASE} IN (SELECT {_BASE} FROM crawl_pages WHERE change_status = 'skipped_unchanged' AND url IS NOT NULL) AND {_BASE} IN (SELECT {_BASE} FROM qa_pairs WHERE contains(url, '#c'))"
_TODO = f"(SELECT * FROM crawl_pages WHERE url IS NULL OR NOT ({_SKIP}))"
_LEFT = SQL["pages_left_whole"].replace("<= 20", f"<= {chunks.MAX_PASSAGES}")
_BUILT = _LEFT[: _LEFT.rindex("SELECT id page_id FROM bu")].replace("FROM crawl_pages ORDER BY page_id", f"FROM {_TODO} ORDER BY page_id")
_ITEM = _PASS[_PASS.rindex("SELECT job, split_part") :].replace("JOIN nm USING (id)", "JOIN nm USING (id) JOIN bu USING (job, id) WHERE fits")
_FITS = _LEFT[: _LEFT.rindex("SELECT id page_id FROM bu")]
SQL |= {
    "push_items": f"{_BUILT}, it AS ({_ITEM}) SELECT job, url, title, content_md5, true AS passage FROM it UNION ALL SELECT p.job_id, p.url, p.title, md5(coalesce(p.content, '')), false FROM (SELECT DISTINCT ON (page_id) * FROM crawl_pages ORDER BY page_id) p JOIN bu ON bu.id = p.page_id WHERE NOT fits",
    "push_replaced": f"{_BUILT}, it AS ({_ITEM}) SELECT qa_id FROM qa_pairs WHERE {_BASE} IN (SELECT {_BASE} FROM it)",
    "passage_stats": f"{_FITS}, q AS (SELECT job, count(*) n FROM pn JOIN nm USING (id) JOIN bu USING (job, id) WHERE fits GROUP BY 1), w AS (SELECT job, count(*) n FROM bu WHERE NOT fits GROUP BY 1) SELECT coalesce(q.job, w.job) job, coalesce(q.n, 0) passages, CAST(0 AS BIGINT) asked, coalesce(q.n, 0) fallback, coalesce(w.n, 0) pages_plain FROM q FULL JOIN w ON q.job = w.job",
}
