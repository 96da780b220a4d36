"""Near-duplicate records with small edits: a parity-sketch join (problem 2).

A record is the set of its distinct runs of ``run`` successive words. Each run is hashed to one position of a bit sketch, which it
flips: the sketch is the XOR of its runs, so the Hamming distance of two sketches, and the number of blocks in which they differ,
are lower bounds of the sets' symmetric difference. Two widths of the sketch are used, one of 2**64 positions.

* Positions. Likeness t of sets of sizes n <= m leaves at most n - o of the smaller and m - o of the larger set's positions without a
  partner, where o = ceil(t / (1 + t) * (n + m)). By the pigeonhole principle one of any n - o + 1 positions of the one is in the
  other, and with one order of all positions for both, one of the first so many of each. A record joins its first
  floor((1 - t) * n) + 1 positions as the larger one and its first n - ceil(2t / (1 + t) * n) + 1 as the smaller one. The order is from rare to
  frequent, by counts over all records, so that phrases which a third of all records share meet only where a record has nothing
  rarer. The join refuses sizes outside the band [t * n, n / t] and positions too far back in either record to leave o in common.
* Whole sketches. Pairs whose 256-bit sketches differ in more than n + m - 2o bits are refused.
* What is left is verified on the full sets.

No pair is lost: every step is a necessary condition of likeness t. Equal texts are one class from the start; only class
representatives are joined. Tables are broadcast below ``broadcast_rows`` rows, counted first; beyond, the same joins run shuffled.

Blocks of several positions, one cut of the sketch for each band of sizes, were built and measured as well: at likeness 0.6 half of all
positions may differ, so a band needs more blocks than a record has pairs of positions, and the bound holds for both sets together.
Figures are in the README.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Words and their hashes; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Runs:
    """Texts as sorted distinct hashes of their word runs; words are hashed once. Texts of fewer than ``least`` words have none."""

    def __init__(self, run: int, least: int = 0):
        self.run, self.least, self.memo = run, max(run, least), Hashes()

    def of(self, words: list[str]) -> np.ndarray:
        return self.sets([words])[1]

    def sets(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, all hashes one after the other) of texts given as words; a whole batch is hashed at once."""
        size = np.fromiter((len(w) if len(w) >= self.least else 0 for w in texts), dtype=np.int64, count=len(texts))
        flat = [w for ws in texts if len(ws) >= self.least for w in ws]
        x = np.fromiter(map(self.memo.__getitem__, flat), dtype=np.uint64, count=len(flat))
        if not len(x):
            return size, x
        n = len(x) - self.run + 1
        with np.errstate(over="ignore"):
            h = x[:n]
            for k in range(1, self.run):
                h = _mix(h) * _GOLD + x[k : n + k]
        h = _mix(h)
        stop = np.cumsum(size)
        parts = [np.sort(h[e - s : e - self.run + 1]) for s, e in zip(size.tolist(), stop.tolist()) if s]
        h = np.concatenate(parts)
        size[size > 0] -= self.run - 1
        doc = np.repeat(np.arange(len(size)), size)
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        return np.bincount(doc[new], minlength=len(size)), h[new]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.sets([words_of(t) for t in texts])


def words_of(text: str) -> list[str]:
    return text.lower().split()


def digest(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()


def _positions(run: int, least: int):
    """Rows (id, text) -> all positions."""

    def go(batches):
        runs = Runs(run, least)
        for b in batches:
            yield pa.record_batch([pa.array(runs.batch(b.column(1).to_pylist())[1].view(np.int64))], names=["key"])

    return go


def _rows(run: int, least: int, t: float, counts):
    """Rows (id, text) -> key, id, size and place of the first positions of each record; with ``counts`` None of all positions, the
    place still to be told."""

    def go(batches):
        runs = Runs(run, least)
        for b in batches:
            sizes, bits = runs.batch(b.column(1).to_pylist())
            key, doc = bits.view(np.int64), np.repeat(np.arange(len(sizes)), sizes)
            place = np.full(len(key), -1, dtype=np.int64)
            if counts is not None:
                keys, ns = counts.value
                n = np.zeros(len(key), dtype=np.int64)
                if len(keys) and len(key):
                    k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    n = np.where(keys[k] == key, ns[k], 0)
                # keys are in order in each record already, so a stable sort by count is enough
                by = np.argsort(doc * (int(n.max(initial=0)) + 1) + n, kind="stable")
                place = np.arange(len(key)) - (np.cumsum(sizes) - sizes)[doc]
                first = place <= np.floor((1 - t) * sizes + 1e-9)[doc]
                key, doc, place = key[by][first], doc[first], place[first]
            yield pa.record_batch([pa.array(key), b.column(0).take(pa.array(doc)), pa.array(sizes[doc].astype(np.int32)), pa.array(place.astype(np.int32))], names=["key", "id", "size", "place"])

    return go


_SKETCH = ["size", "s0", "s1", "s2", "s3"]


def _sketches(run: int, least: int):
    """Rows (id, text) -> id, digest of the words, size and 256-bit parity sketch, of records of enough words."""

    def go(batches):
        runs = Runs(run, least)
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            keep = [i for i, w in enumerate(words) if len(w) >= runs.least]
            sizes, u = runs.sets([words[i] for i in keep])
            at = np.cumsum(sizes) - sizes
            word, one = (u >> np.uint64(6)) & np.uint64(3), np.uint64(1) << (u & np.uint64(63))
            s = [np.bitwise_xor.reduceat(np.where(word == w, one, np.uint64(0)), at).view(np.int64) if len(u) else np.empty(0, dtype=np.int64) for w in range(4)]
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), pa.array([digest(words[i]) for i in keep], pa.binary()), pa.array(sizes.astype(np.int32)), *map(pa.array, s)], names=["id", "h", *_SKETCH])

    return go


def _verify(run: int):
    """Rows (a, b, text of a, text of b) -> a, b, elements in both and in either."""

    def go(batches):
        runs = Runs(run)
        for x in batches:
            a, b = x.column(0).to_pylist(), x.column(1).to_pylist()
            sets: dict = {}
            for ids, texts in ((a, x.column(2)), (b, x.column(3))):
                for i, t in zip(ids, texts):
                    if i not in sets:
                        sets[i] = t.as_py()
            sizes, flat = runs.batch(list(sets.values()))
            sets = dict(zip(sets, np.split(flat, np.cumsum(sizes)[:-1])))
            both = [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)]
            either = [len(sets[i]) + len(sets[j]) - n for i, j, n in zip(a, b, both)]
            yield pa.record_batch([x.column(0), x.column(1), pa.array(both, pa.int32()), pa.array(either, pa.int32())], names=["a", "b", "n", "u"])

    return go


def _checked(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """A written table, marked for broadcast where it has at most so many rows."""
    return F.broadcast(df) if df.count() <= broadcast_rows else df


def similar_classes(rows: DataFrame, *, id_col: str, text: str, run: int = 5, likeness: float = 0.8, min_words: int = 20, hot: int = 10, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has id and rep, the smallest id with the same words; pairs has a < b and likeness, each pair of
    representatives that are alike to at least ``likeness``, once.

    Records with a null id, null or blank text or under ``min_words`` words are in neither. Rows of one id with equal texts count
    once; of an id delivered with different texts the one with the smallest digest counts. Texts are taken whole. Columns other
    than the two named are ignored. An empty table gives two empty results. Positions of fewer than ``hot`` records all count as
    rare, which leaves each at most so many partners and changes no result.
    """
    spark, t, least = rows.sparkSession, likeness, max(min_words, run)
    src = rows.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t")).where("id is not null and t is not null")
    kind = src.schema["id"].dataType.simpleString()
    seen = src.mapInArrow(_sketches(run, least), f"id {kind}, h binary, size int, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    seen = seen.groupBy("id", "h", *_SKETCH).agg(F.count("*").alias("n"))
    ids = materialize(seen.groupBy("id").agg(F.min(F.struct("h", *_SKETCH)).alias("v"), F.sum("n").alias("n")).select("id", "v.*", "n"), "ids")
    reps = ids.groupBy("h").agg(F.min("id").alias("rep"))
    members = materialize(ids.join(reps, "h"), "members")
    # one row for each representative: those delivered once as they are, the others by digest
    skip = materialize(members.where("id <> rep or n > 1").select("id"), "not-once")
    again = materialize(members.where("id = rep and n > 1").select("id", "h"), "again")

    def chosen(batches):
        for b in batches:
            yield b.select([0, 1]).filter(pa.array([digest(words_of(x)) == h for x, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.bool_()))

    often = src.join(_checked(again, broadcast_rows), "id").select("id", "t", "h").mapInArrow(chosen, f"id {kind}, t string").dropDuplicates(["id"])
    one = src.join(_checked(skip, broadcast_rows), "id", "left_anti").unionByName(often)

    counts = materialize(one.mapInArrow(_positions(run, least), "key bigint").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= hot), "frequent")
    schema = f"key bigint, id {kind}, size int, place int"
    if counts.count() <= broadcast_rows:
        got = counts.orderBy("key").toArrow()
        found = one.mapInArrow(_rows(run, least, t, spark.sparkContext.broadcast((got.column("key").to_numpy(), got.column("n").to_numpy()))), schema)
    else:
        found = one.mapInArrow(_rows(run, least, t, None), schema).join(counts, "key", "left")
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(0)), "key")) - 1  # the positions of one record
        found = found.withColumn("place", place).where(F.col("place") <= F.floor((1 - t) * F.col("size") + 1e-9)).select("key", "id", "size", "place")
    # l is the smaller one, by size and then id
    l, r = found.alias("l"), found.alias("r")
    near = F.col("l.place") <= F.col("l.size") - F.ceil(2 * t / (1 + t) * F.col("l.size") - 1e-9)
    near &= (F.col("l.key") == F.col("r.key")) & (F.struct("l.size", "l.id") < F.struct("r.size", "r.id")) & (F.col("l.size") >= t * F.col("r.size") - 1e-9)
    least_both = t / (1 + t) * (F.col("l.size") + F.col("r.size")) - 1e-9
    near &= (F.col("l.size") - F.col("l.place") >= least_both) & (F.col("r.size") - F.col("r.place") >= least_both)
    cand = l.join(r, near).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))

    sketch = members.where("id = rep").select("id", F.struct(*_SKETCH).alias("v"))
    l, r = sketch.select(F.col("id").alias("a"), F.col("v").alias("l")), sketch.select(F.col("id").alias("b"), F.col("v").alias("r"))
    if members.count() <= broadcast_rows // 4:  # 56 bytes a row; both joins and the filter run right behind the join of positions
        x = cand.join(F.broadcast(l), "a").join(F.broadcast(r), "b")
    else:
        x = materialize(cand.distinct(), "candidates").join(l, "a").join(r, "b")
    apart = sum((F.bit_count(F.col(f"l.s{k}").bitwiseXOR(F.col(f"r.s{k}"))) for k in range(4)), F.lit(0))
    near = materialize(x.where(apart <= (1 - t) / (1 + t) * (F.col("l.size") + F.col("r.size")) + 1e-9).select("a", "b").distinct(), "near")
    need = _checked(materialize(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "to-verify"), broadcast_rows)
    texts = one.join(need, "id", "left_semi")
    x = near.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    x = x.select("a", "b", "ta", "tb").mapInArrow(_verify(run), f"a {kind}, b {kind}, n int, u int").where(F.col("n") >= t * F.col("u") - 1e-9)
    return members.select("id", "rep"), x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("n") / F.col("u")).alias("likeness"))


def similar_pairs(rows: DataFrame, *, id_col: str, text: str, **kw) -> DataFrame:
    """id_a < id_b, likeness: all pairs of alike records, those of equal texts (likeness 1) and of class members included."""
    members, pairs = similar_classes(rows, id_col=id_col, text=text, **kw)
    pairs = materialize(pairs, "alike")
    m = members.alias("m")
    same = m.join(members.alias("n"), (F.col("m.rep") == F.col("n.rep")) & (F.col("m.id") < F.col("n.id"))).select(F.col("m.id").alias("x"), F.col("n.id").alias("y"), F.lit(1.0).alias("likeness"))
    across = pairs.join(members.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a").join(members.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b").where("x <> y").select("x", "y", "likeness")
    return same.unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "likeness")


def similar_groups(rows: DataFrame, *, id_col: str, text: str, rounds: int = 40, **kw) -> DataFrame:
    """id, group, links: one row for every record with enough words; group is the smallest id of its connected component and
    links the number of representatives that are alike to its own.

    Components by repeated minimum over the links between representatives, shortened by jumping to the label's own label; each
    round is written to the shared folder. Records without a partner are a group of their own.
    """
    members, pairs = similar_classes(rows, id_col=id_col, text=text, **kw)
    pairs = materialize(pairs, "alike")
    edges = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    label = materialize(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("g")), "label")
    for _ in range(rounds):
        seen = edges.join(label.select(F.col("x").alias("y"), "g"), "y").groupBy("x").agg(F.min("g").alias("near"))
        step = label.join(seen, "x").select("x", F.least("g", "near").alias("g"), F.col("g").alias("old"))
        jump = step.join(step.select(F.col("x").alias("g"), F.col("g").alias("far")), "g", "left")
        new = materialize(jump.select("x", F.least("g", F.coalesce("far", "g")).alias("g"), "old"), "label")
        label = new.select("x", "g")
        if new.where("g <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    links = edges.groupBy("x").agg(F.count("*").alias("links"))
    rep = members.select(F.col("rep").alias("x")).distinct().join(label, "x", "left").join(links, "x", "left")
    return members.join(rep.withColumnRenamed("x", "rep"), "rep").select("id", F.coalesce("g", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
