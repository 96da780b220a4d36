"""Text cut off by field limits (problem 10).

Two kinds of evidence, both over whole texts and all documents:

* Copies: a text that is a strict prefix of a longer one shares with it the hash of its first ``HEAD`` characters. Texts (without
  what follows their last word) whose head no other text has are done with; the others are sorted over the cluster, where a
  strict prefix stands right before a text that goes on from it, so that one look at the next text decides it and no group of texts
  with a common beginning is ever joined or collected. Texts shorter than a head are looked up in the beginnings of all others.
  If the longer copy goes on before a sentence ends, the text was cut.
* Terminal context (``endings.py``), learnt from all texts: closing lines, words that sentences go on from, marks after the cut. Most
  cut texts have no longer copy anywhere, so this decides them.

Cost: two passes to learn (combined counts), one to judge that writes a few numbers for each text, one over the texts with a head in
common, which alone are shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import endings

_GOES_ON = re.compile(r"[\wऀ-ॣঀ-৿,;:-]")
_IN_WORD = re.compile(r"[\wऀ-ःऺ-ॏ॑-ॣঁ-ঃ়-্ৗৢৣ]")


def until_last_word(text: str) -> str:
    """The text without what follows its last word."""
    n = len(text)
    while n and not _IN_WORD.match(text[n - 1]):
        n -= 1
    return text[:n]


#: Characters of a text's beginning that are hashed.
HEAD = 64


def inside(k: str, longer: str) -> bool:
    """Whether a longer text that begins with k goes on there inside its sentence."""
    rest = longer[len(k) :].lstrip()
    return bool(rest) and rest[0] not in endings.STOPS + endings.CLOSERS + "…" and bool(_GOES_ON.match(rest))


def continued(rows: DataFrame) -> DataFrame:
    """Of a table (h, k) of distinct texts k with a hash h: h of each k that is a strict prefix of another one which goes on
    inside the sentence, once. Empty texts are left out."""
    by = rows.where("k <> ''").select("h", "k").repartitionByRange("k").sortWithinPartitions("k")

    def walk(batches):
        from pyspark import TaskContext

        pid, last, first = TaskContext.get().partitionId(), None, None
        for b in batches:
            out = []
            for h, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if last is None:
                    first = (h, k)
                elif k != last[1] and k.startswith(last[1]) and inside(last[1], k):
                    out.append(last[0])
                last = (h, k)
            if out:
                yield pa.record_batch([pa.array(out, pa.int64()), pa.array(["in"] * len(out)), pa.array([pid] * len(out), pa.int32()), pa.nulls(len(out), pa.string())], names=["h", "kind", "pid", "k"])
        if last is not None:
            yield pa.record_batch([pa.array([first[0], last[0]], pa.int64()), pa.array(["first", "last"]), pa.array([pid, pid], pa.int32()), pa.array([first[1], last[1]])], names=["h", "kind", "pid", "k"])

    got = materialize(by.mapInArrow(walk, "h bigint, kind string, pid int, k string"), "continued")
    # the last text of a partition against the first of the next one that has rows: two rows a partition
    order = sorted(r["pid"] for r in got.where("kind = 'first'").select("pid").collect())
    spark = rows.sparkSession
    after = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] or [(-1, -1)], "pid int, next int")
    edge = got.where("kind = 'last'").join(after, "pid").join(got.where("kind = 'first'").select(F.col("pid").alias("next"), F.col("k").alias("longer")), "next")
    rest = F.ltrim(F.expr("substring(longer, length(k) + 1)"))
    edge = edge.where((F.col("k") != F.col("longer")) & F.startswith("longer", "k") & rest.rlike(r"^[\p{L}\p{M}\p{N}_,;:-]"))
    return got.where("kind = 'in'").select("h").unionByName(edge.select("h")).distinct()


def _hash(text: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def ends(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str | None = "source", broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, source, cut, reason: one row for every row of ``docs``; reason is ``context`` or ``copy`` where cut is true.

    Null, empty and blank texts are not cut. Texts that end with a full sentence or a closing line of their own are whole.
    Null ids and sources are kept; repeated rows are kept. Columns other than those named are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), (F.col(source) if source else F.lit(None)).cast("string").alias("source"), F.col(text).cast("string").alias("t"))
    learnt = spark.sparkContext.broadcast(endings.learn(src, "t"))  # bounded, see there

    def judge(batches):
        for b in batches:
            ts = b.column(2).to_pylist()
            cut = pa.array([endings.cut(t, learnt.value) for t in ts], pa.bool_())
            keys = [until_last_word(t) if t else "" for t in ts]
            h, head = pa.array([_hash(k) for k in keys], pa.int64()), pa.array([_hash(k[:HEAD]) if len(k) >= HEAD else None for k in keys], pa.int64())
            short = pa.array([k if 0 < len(k) < HEAD else None for k in keys], pa.string())
            yield pa.record_batch([b.column(0), b.column(1), cut, h, head, short], names=["doc_id", "source", "cut", "h", "head", "short"])

    kind = src.schema["doc_id"].dataType.simpleString()
    judged = materialize(src.mapInArrow(judge, f"doc_id {kind}, source string, cut boolean, h bigint, head bigint, short string"), "judged")
    heads = materialize(judged.where("head is not null").groupBy("head").agg((F.min("h") < F.max("h")).alias("several")).where("several").select("head"), "heads")
    shorts = materialize(judged.where("short is not null").groupBy("short").agg(F.first("h").alias("h")), "shorts")
    common = spark.sparkContext.broadcast(frozenset(r["head"] for r in heads.toLocalIterator()) if heads.count() <= broadcast_rows else None)
    known = spark.sparkContext.broadcast({r["short"]: r["h"] for r in shorts.toLocalIterator()} if shorts.count() <= broadcast_rows else None)

    def gather(batches):
        """The texts to be sorted, and the hashes of the short ones that others go on from."""
        heads, shorts = common.value, known.value
        lengths = sorted({len(k) for k in shorts}) if shorts is not None else []
        for b in batches:
            hs, ks, found = [], [], set()
            for t in b.column(0).to_pylist():
                k = until_last_word(t)
                for n in lengths:
                    if n >= len(k):
                        break
                    h = shorts.get(k[:n])
                    if h is not None and h not in found and inside(k[:n], k):
                        found.add(h)
                if k and (heads is None or shorts is None or (len(k) >= HEAD and _hash(k[:HEAD]) in heads)):
                    hs.append(_hash(k))
                    ks.append(k)
            yield pa.record_batch([pa.array([*hs, *found], pa.int64()), pa.array([*ks, *[None] * len(found)], pa.string())], names=["h", "k"])

    got = src.select("t").where("t is not null and t <> ''").mapInArrow(gather, "h bigint, k string").groupBy("h").agg(F.min("k").alias("k"), F.count_if(F.col("k").isNull()).alias("short"))
    got = materialize(got, "to-sort")
    copies = continued(got.where("k is not null").select("h", "k")).union(got.where("short > 0").select("h")).distinct().withColumn("copy", F.lit(True))
    return judged.join(copies, "h", "left").select("doc_id", "source", (F.col("cut") | F.coalesce("copy", F.lit(False))).alias("cut"), F.when(F.col("cut"), "context").when(F.col("copy"), "copy").alias("reason"))


def cut_documents(docs: DataFrame, **kw) -> DataFrame:
    """doc_id of every cut document, once."""
    return ends(docs, **kw).where("cut and doc_id is not null").select("doc_id").distinct()


def cut_by_source(docs: DataFrame, **kw) -> DataFrame:
    """source, documents, cut, share: how often each source truncates. Null sources are one row."""
    x = ends(docs, **kw).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"))
    return x.withColumn("share", F.col("cut") / F.col("documents"))
