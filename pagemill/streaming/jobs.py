"""Stateful queries on streams. Each gives the rows of its batch counterpart once all input has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..functions import url as U


def daily_counts(events: DataFrame, at: str = "ts", by: str = "event_type", late: str = "1 day") -> DataFrame:
    """day, by, n: a tumbling window of a day; what comes later than ``late`` is dropped and a day is given once it is over."""
    x = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return x.groupBy(F.window("at", "1 day").alias("w"), F.col(by)).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), by, "n")


def sliding_rates(events: DataFrame, at: str = "ts", key: str = "user_id", window: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    x = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return x.groupBy(F.window("at", window, slide).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "6 hours", late: str = "6 hours") -> DataFrame:
    """Sessions that end after a gap, as an upload's pieces do: start, stop, key, n."""
    x = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return x.groupBy(F.session_window("at", gap).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def change_status(pages: DataFrame, url: str = "url", content: str = "content", at: str = "crawled_at", page_id: str = "page_id") -> DataFrame:
    """key, page_id, status: each page against the last hash of its url, which is the state. Pages of one micro-batch are taken
    in order of time and id; a page older than the state's is compared all the same. The state is one hash a url."""
    x = pages.where(F.col(url).isNotNull()).select(U.normalize(F.col(url)).alias("key"), F.col(page_id).cast("long").alias("page_id"), F.col(at).cast("timestamp").alias("at"), T.fingerprint(F.col(content)).alias("hash"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "page_id"], na_position="first")
        out = []
        for i, h in zip(rows["page_id"], rows["hash"]):
            out.append("new" if last is None else "skipped_unchanged" if last == h else "updated")
            last = h
        state.update((last,))
        yield pd.DataFrame({"key": key[0], "page_id": rows["page_id"].to_numpy(), "status": out})

    return x.groupBy("key").applyInPandasWithState(step, "key string, page_id long, status string", "hash string", "append", GroupStateTimeout.NoTimeout)


def lockouts(attempts: DataFrame, key: str = "user_id", at: str = "ts", ok: str = "ok", limit: int = 3, hours: int = 24) -> DataFrame:
    """key, locked_at: locks as they happen; the state of a key is its failures and the end of its lock."""
    x = attempts.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(ok).alias("ok"))
    span = hours * 3_600_000_000

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        n, until = state.get if state.exists else (0, -1)
        locks = []
        for t, good in pd.concat(list(batches)).sort_values(["t", "ok"])[["t", "ok"]].itertuples(index=False):
            if t < until:
                continue
            n = 0 if good else n + 1
            if n >= limit:
                n, until = 0, t + span
                locks.append(t)
        state.update((int(n), int(until)))
        yield pd.DataFrame({"key": [k[0]] * len(locks), "t": locks}, columns=["key", "t"]).astype("int64")

    y = x.groupBy("key").applyInPandasWithState(step, "key long, t long", "n long, until long", "append", GroupStateTimeout.NoTimeout)
    return y.select(F.col("key").alias(key), F.timestamp_micros("t").alias("locked_at"))
