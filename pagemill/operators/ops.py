"""Operational queries: numbering, paging, streaks, quotas, retention, folds over a key's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_numbers(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """The rows with ``batch``: number, from 1, of the batch of ``size`` rows of the group that a row falls in."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("batch", (F.floor((F.row_number().over(w) - 1) / size) + 1).cast("int"))


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 10) -> DataFrame:
    """Rows of one page, counted from 1; a page beyond the last gives the last. The count and an ordered offset, no global numbering."""
    n = rows.count()
    last = max(1, -(-n // size))
    k = min(max(page, 1), last)
    return rows.orderBy(*order).offset((k - 1) * size).limit(size)


def latest(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group with their place ``r``. Spark limits each task's groups before the shuffle."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("r") <= n)


def streaks(rows: DataFrame, group: str, order: list[str], bad: Column, least: int) -> DataFrame:
    """group, start, stop, length of every run of at least ``least`` bad rows in a row (gaps and islands)."""
    w, wb = Window.partitionBy(group).orderBy(*order), Window.partitionBy(group, "bad").orderBy(*order)
    x = rows.withColumn("bad", bad).withColumn("island", F.row_number().over(w) - F.row_number().over(wb)).where("bad")
    return x.groupBy(group, "island").agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("stop"), F.count("*").cast("int").alias("length")).where(F.col("length") >= least).drop("island")


def retention_plan(entries: DataFrame, *, kind: str, age_days: str, size: str, name: str, days: int) -> DataFrame:
    """The entries with ``delete``: older than ``days`` (3 at least), never the newest of a kind; the only one of a kind waits
    max(4 * days, 30)."""
    d = max(3, days)
    w = Window.partitionBy(kind)
    r = F.row_number().over(w.orderBy(age_days, name))
    x = entries.withColumn("r", r).withColumn("many", F.count("*").over(w))
    gone = F.when(F.col("many") == 1, F.col(age_days) > max(4 * d, 30)).otherwise((F.col("r") > 1) & (F.col(age_days) > d))
    return x.withColumn("delete", gone).drop("r", "many")


def lockouts(attempts: DataFrame, *, key: str, at: str, ok: str, limit: int = 3, hours: int = 24) -> DataFrame:
    """key, locked_at, until: every lock of a key's attempts in order. ``limit`` failures lock for ``hours``; attempts while
    locked don't count; a success or the end of a lock starts anew. A fold over one key's attempts, given to one task each."""
    rows = F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(ok).alias("ok"))))
    span = hours * 3_600_000_000
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).cast("bigint").alias("until"), F.array().cast("array<bigint>").alias("locks"))

    def step(s, r):
        free = r["t"] >= s["until"]
        n = F.when(~free, s["n"]).when(r["ok"], 0).otherwise(s["n"] + 1)
        lock = free & ~r["ok"] & (n >= limit)
        return F.struct(F.when(lock, 0).otherwise(n).alias("n"), F.when(lock, r["t"] + span).otherwise(s["until"]).alias("until"), F.when(lock, F.concat(s["locks"], F.array(r["t"]))).otherwise(s["locks"]).alias("locks"))

    x = attempts.groupBy(key).agg(rows.alias("rows")).select(key, F.explode(F.aggregate("rows", start, step)["locks"]).alias("t"))
    return x.select(key, F.timestamp_micros("t").alias("locked_at"), F.timestamp_micros(F.col("t") + span).alias("until"))


def daily_counts(rows: DataFrame, at: str, by: str | None = None) -> DataFrame:
    keys = [F.to_date(at).alias("day")] + ([F.col(by)] if by else [])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def spaced(rows: DataFrame, group: str, at: str, hours: float) -> DataFrame:
    """Rows that come at least ``hours`` after the one before them in their group; the first of a group stays."""
    before = F.lag(at).over(Window.partitionBy(group).orderBy(at))
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 3.6e9
    return rows.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= hours)).drop("gap")


def type_quota(items: DataFrame, *, site: str, kind: str, order: list[Column], most: int) -> DataFrame:
    """Items of a site by kind (pages, other kinds, posts), each kind up to its quota (a third of ``most`` for pages, a half for
    others, all for posts, 1 at least), and ``most`` in all; with ``rank`` in that order."""
    quota = F.when(F.col(kind) == "post", most).when(F.col(kind) == "page", max(1, most // 3)).otherwise(max(1, most // 2))
    place = F.when(F.col(kind) == "page", 0).when(F.col(kind) == "post", 2).otherwise(1)
    x = items.withColumn("r", F.row_number().over(Window.partitionBy(site, kind).orderBy(*order))).where(F.col("r") <= quota).withColumn("place", place)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(site).orderBy("place", kind, "r"))).where(F.col("rank") <= most).drop("r", "place")


def every_nth(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """A systematic sample: every n-th row of each group, n chosen so that about ``most`` are left; ``step`` is n."""
    w = Window.partitionBy(group)
    x = rows.withColumn("r", F.row_number().over(w.orderBy(*order))).withColumn("step", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most)).cast("int"))
    return x.where((F.col("r") - 1) % F.col("step") == 0).drop("r")


def schedule(jobs: DataFrame, now: Column, *, seed: str = "seed_url", at: str = "completed_at", every_days: int = 10) -> DataFrame:
    """seed, last_crawled, next_run, days_remaining (null without a date, 0 at least), due: one row a seed without its last slash."""
    x = jobs.groupBy(F.rtrim(F.lower(seed), F.lit("/")).alias("seed")).agg(F.max(at).alias("last_crawled"), F.count("*").cast("int").alias("runs"))
    nxt = F.col("last_crawled") + F.make_dt_interval(F.lit(every_days))
    left = (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 86_400_000_000
    return x.select("seed", "runs", "last_crawled", nxt.alias("next_run"), F.when(left.isNotNull(), F.greatest(F.lit(0), F.floor(left))).cast("int").alias("days_remaining"), F.coalesce(left <= 0, F.lit(False)).alias("due"))


def pieces(chunks: DataFrame, *, session: str, index: str, total: str, data: str) -> DataFrame:
    """session, complete, bytes: uploads put together from pieces; complete when every index below ``total`` is there. Pieces sent
    again count once; a session's pieces are bounded by the size of an upload."""
    x = chunks.groupBy(session, index).agg(F.max(data).alias("d"), F.max(total).alias("t"))
    y = x.groupBy(session).agg(F.count("*").alias("n"), F.max(index).alias("last"), F.max("t").alias("t"), F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col("d")))).alias("parts"))
    whole = (F.col("n") == F.col("t")) & (F.col("last") == F.col("t") - 1)
    return y.select(session, whole.alias("complete"), F.when(whole, F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["d"])), ""))).alias("bytes"))


def register_crawls(schedules: DataFrame | None, crawls: DataFrame, *, seed: str = "seed_url", at: str = "completed_at", every_days: int = 10) -> DataFrame:
    """seed, enabled, last_crawled, next_run: the schedules after these crawls. A known seed keeps its switch and gets new times (a
    crawl without a time leaves them), a new one is enabled. Seeds are told apart without their last slashes."""
    new = crawls.groupBy(F.rtrim(F.col(seed), F.lit("/")).alias("seed")).agg(F.max(at).alias("at")).where("seed is not null")
    if schedules is None:
        x = new.select("seed", F.lit(True).alias("enabled"), F.col("at").alias("last_crawled"))
    else:
        x = schedules.select("seed", "enabled", "last_crawled").join(new, "seed", "full").select("seed", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("at", "last_crawled").alias("last_crawled"))
    return x.withColumn("next_run", F.col("last_crawled") + F.make_dt_interval(F.lit(every_days)))


def set_enabled(schedules: DataFrame, seeds: DataFrame, enabled: bool) -> DataFrame:
    """The schedules with the switch of these seeds (seed) set; unknown seeds change nothing."""
    hit = seeds.select(F.rtrim("seed", F.lit("/")).alias("seed")).distinct().withColumn("__hit", F.lit(True))
    return schedules.join(hit, "seed", "left").withColumn("enabled", F.when(F.col("__hit"), F.lit(enabled)).otherwise(F.col("enabled"))).drop("__hit")


def remove_schedules(schedules: DataFrame, seeds: DataFrame) -> DataFrame:
    return schedules.join(seeds.select(F.rtrim("seed", F.lit("/")).alias("seed")).distinct(), "seed", "left_anti")


def remaining(until: Column, now: Column) -> Column:
    """hours, mins and seconds (all of them) that a lock has left, none below 0; null stays null."""
    s = F.greatest(F.lit(0), F.floor((F.unix_micros(until.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1_000_000))
    s = F.when(until.isNotNull() & now.isNotNull(), s)
    return F.struct(F.floor(s / 3600).cast("int").alias("hours"), F.floor((s % 3600) / 60).cast("int").alias("mins"), s.cast("int").alias("seconds"))


def quota_percent(used: Column, limit: Column) -> Column:
    """percent and high: the used share of a limit, halves up, at most 100, and 100 where there is no limit; high from 80 on."""
    p = F.when(F.coalesce(limit, F.lit(0)) == 0, 100).otherwise(F.least(F.lit(100), F.floor(used * 100 / limit + 0.5))).cast("int")
    return F.struct(p.alias("percent"), (p >= 80).alias("high"))


def freed(plan: DataFrame, size: str) -> DataFrame:
    """deleted, kept, freed_bytes of a retention plan."""
    return plan.agg(F.count_if("delete").alias("deleted"), F.count_if(~F.col("delete")).alias("kept"), F.coalesce(F.sum(F.when(F.col("delete"), F.col(size))), F.lit(0)).alias("freed_bytes"))


def stale(rows: DataFrame, group: str, at: str, now: Column, hours: float = 6) -> DataFrame:
    """group, last: sessions whose last sign of life is older than so many hours."""
    x = rows.groupBy(group).agg(F.max(at).alias("last"))
    return x.where(F.unix_micros(F.col("last").cast("timestamp")) < F.unix_micros(now.cast("timestamp")) - int(hours * 3_600_000_000))


def model_order(names: Column, known: Column) -> Column:
    """``known`` and behind it the other flash models of ``names``: lite ones first, then the newest version first."""
    good = F.filter(names, lambda n: n.rlike(r"^gemini-[\d.]+-flash(-lite)?$"))
    version = lambda n: F.transform(F.regexp_extract_all(n, F.lit(r"\d+"), F.lit(0)), lambda v: -v.cast("int"))
    keyed = F.array_sort(F.transform(good, lambda n: F.struct((~F.contains(n, F.lit("lite"))).alias("a"), version(n).alias("b"), n.alias("n"))))
    return F.array_union(known, F.transform(keyed, lambda v: v["n"]))
