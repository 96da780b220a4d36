"""Vector search and what is built from its matches.

One query is a projection and a top-k that Spark keeps as such. Many queries go in blocks of ``block`` vectors: each block is
broadcast (block * dimension * 8 bytes), every Arrow batch of the corpus is one matrix product, each task keeps the best k for
each query of the block, and the tasks' few rows are merged. No pair of query and row is ever written.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(corpus: DataFrame, query: list[float], k: int, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and squared distance of the k nearest rows; ties by id. Null vectors are left out."""
    q = F.array(*[F.lit(float(v)) for v in query])
    d = F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    return corpus.where(F.col(vector).isNotNull()).select(F.col(vec_id).alias("vec_id"), d.alias("d")).orderBy("d", "vec_id").limit(k)


def top_k_many(corpus: DataFrame, queries: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", block: int = 4096, without_self: bool = True) -> DataFrame:
    """query_id, vec_id, d, rank: the k nearest rows of every query. Both tables have vec_id and vector."""
    spark = corpus.sparkSession
    out = None
    src = corpus.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    for part in _blocks(queries.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("v is not null"), block):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            qi, q = shared.value
            qq = (q * q).sum(1)
            best_d = np.full((len(qi), 0), np.inf)
            best_i = np.zeros((len(qi), 0), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                i = b.column(0).to_numpy()
                v = np.asarray(b.column(1).flatten()).reshape(len(i), -1)
                d = np.maximum(qq[:, None] - 2 * q @ v.T + (v * v).sum(1)[None, :], 0)
                if without_self:
                    d[qi[:, None] == i[None, :]] = np.inf
                d, i = np.concatenate([best_d, d], 1), np.concatenate([best_i, np.broadcast_to(i, (len(qi), len(i)))], 1)
                n = min(k, d.shape[1])
                # all that tie with the k-th could be cut by a partition, so order by distance and id
                at = np.lexsort((i, d), axis=1)[:, :n]
                best_d, best_i = np.take_along_axis(d, at, 1), np.take_along_axis(i, at, 1)
            ok = np.isfinite(best_d)
            ids = np.repeat(qi, ok.sum(1)) if best_d.shape[1] else qi[:0]
            yield pa.record_batch([pa.array(ids), pa.array(best_i[ok]), pa.array(best_d[ok])], names=["query_id", "vec_id", "d"])

        got = src.mapInArrow(run, "query_id bigint, vec_id bigint, d double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, d double, rank int")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, block: int):
    ids, vs = [], []
    for r in queries.toLocalIterator():
        ids.append(r["i"])
        vs.append(r["v"])
        if len(ids) == block:
            yield np.array(ids, np.int64), np.array(vs, np.float64)
            ids, vs = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vs, np.float64)


# The words of an answer that is put together from the matches.
BASED_ON, SITE, RETRIEVED = "Based on the knowledge crawled from **", "the crawled website", "This information was retrieved from the official indexed documents."
MORE, NOTHING_FOUND = "**Additional Context:**", "No relevant crawled knowledge was found to answer this question. Please crawl and index more web pages."


def matches(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Matches as the api gives them: similarity max(0, 1 - d/2) to 3 places, distance to 4. ``chunks`` has vec_id, text, url, title."""
    x = found.join(chunks, "vec_id", "left")
    return x.withColumns({"similarity": F.round(F.greatest(F.lit(0.0), 1 - F.col("d") / 2), 3), "distance": F.round("d", 4)})


def _ordered(x: DataFrame, key: str, part) -> DataFrame:
    """One text for each key from the parts of its matches in order of rank; a query has at most k."""
    return x.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda v: v["part"]), "").alias("text"))


def prompt(x: DataFrame, question: str = "question", key: str = "query_id", assistant: str = "the assistant") -> DataFrame:
    """query_id, prompt: the question with its numbered passages and the rules to answer by."""
    part = F.concat(F.lit("\n[Passage "), F.col("rank"), F.lit("] (Source: "), F.coalesce("url", F.lit("N/A")), F.lit(")\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    head = f"You are {assistant}. Answer only from the passages, in the language of the question, and cite them as [Passage 1].\n"
    q = x.groupBy(key).agg(F.first(question).alias("q"))
    return _ordered(x, key, part).join(q, key).select(key, F.concat(F.lit(head), F.col("text"), F.lit("\nQuestion: "), F.col("q"), F.lit("\nAnswer:")).alias("prompt"))


def grounded_answer(x: DataFrame, key: str = "query_id") -> DataFrame:
    """query_id, answer: the first match quoted, and the first 200 characters of each other one."""
    t = F.trim(F.coalesce("text", F.lit("")))
    first = F.concat(F.lit(BASED_ON), F.coalesce("title", F.lit(SITE)), F.lit("**:\n\n> "), t, F.lit("\n\n" + RETRIEVED))
    other = F.concat(F.when(F.col("rank") == 2, "\n\n" + MORE).otherwise(""), F.lit("\n- *[Passage "), F.col("rank"), F.lit("]*: "), F.left(t, F.lit(200)), F.lit("..."))
    return _ordered(x, key, F.when(F.col("rank") == 1, first).otherwise(other)).withColumnRenamed("text", "answer")


def answers(questions: DataFrame, x: DataFrame, providers: list[tuple[str, Callable[[str], str | None]]] = (), *, key: str = "query_id", question: str = "question") -> DataFrame:
    """query_id, answer, provider: the first provider (name, ask) in order that answers a question's prompt; its matches put together
    (``local_synthesizer``) where none does; a fixed sentence where it has no matches. A provider that fails gives no answer.

    ``questions`` has one row a question, ``x`` its matches. Asking runs on the executors, a prompt at a time.
    """
    asked = questions.select(F.col(key), F.col(question)).join(prompt(x, question, key), key, "left").join(grounded_answer(x, key), key, "left")
    local = F.coalesce("answer", F.lit(NOTHING_FOUND))
    if not providers:
        return asked.select(key, local.alias("answer"), F.lit("local_synthesizer").alias("provider"))
    kind = asked.schema[key].dataType.simpleString()

    def ask(batches):
        for b in batches:
            got = []
            for p in b.column(1).to_pylist():
                found = (None, None)
                for name, call in providers if p is not None else ():
                    try:
                        reply = call(p)
                    except Exception:  # the next one is asked
                        reply = None
                    if reply and reply.strip():
                        found = (reply.strip(), name)
                        break
                got.append(found)
            text, by = (pa.array(c, pa.string()) for c in zip(*got)) if got else (pa.array([], pa.string()),) * 2
            yield pa.record_batch([b.column(0), pa.compute.if_else(pa.compute.is_valid(text), text, b.column(2)), pa.compute.coalesce(by, pa.scalar("local_synthesizer"))], names=[key, "answer", "provider"])

    return asked.select(key, "prompt", local.alias("local")).mapInArrow(ask, f"{key} {kind}, answer string, provider string")


def index_chunks(chunks: DataFrame, store: DataFrame, embed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The store (chunk_id, job_id, url, text, embedding) after the chunks were embedded and put in; chunks replace those of their id."""
    from .catalog import upsert

    new = embed(chunks.select("chunk_id", "job_id", "url", "text"), "text").select("chunk_id", "job_id", "url", "text", "embedding")
    return upsert(store.select("chunk_id", "job_id", "url", "text", "embedding"), new, "chunk_id")


def sources(x: DataFrame, key: str = "query_id") -> DataFrame:
    """query_id, url, title, similarity: each url of a query's matches once, at its best rank."""
    w = Window.partitionBy(key, "url").orderBy("rank")
    y = x.where("url is not null and url <> ''").withColumn("r", F.row_number().over(w)).where("r = 1")
    return y.select(key, "rank", "url", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url")).alias("title"), "similarity")


def feature_hash(texts: DataFrame, text: str, dimension: int = 64) -> DataFrame:
    """The rows with ``embedding``: a signed feature hash of the words, of unit length. A stand-in for a model, stable and
    without knowledge of meaning; texts without words have a null."""

    def run(batches):
        import regex
        import xxhash

        find, memo = regex.compile(r"[\p{L}\p{N}_]+").findall, {}
        for b in batches:
            out = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                v = np.zeros(dimension)
                for w in find(t.lower()) if t else ():
                    if w not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                        memo[w] = (h % dimension, 1.0 if h >> 63 else -1.0)
                    k, sign = memo[w]
                    v[k] += sign
                n = np.sqrt(v @ v)
                out.append((v / n).astype(np.float32) if n else None)
            yield pa.record_batch([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    x = texts.withColumn(text, F.col(text).cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields)
    return x.mapInArrow(run, f"{fields}, embedding array<float>")
