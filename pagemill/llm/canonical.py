"""Duplicates hidden by formatting differences (problem 4): recursive radix partitioning on canonical bytes, counted in tries.

1. Each map task makes a record's canonical bytes, url then content, in the JVM and combines equal ones of its batches, with the
   ids they stand for; the combined rows are written to the shared folder. A group that holds a third of all rows shrinks here.
2. All rows are one bucket to begin with. A bucket of more than ``limit`` bytes is split by the next byte of the canonical bytes,
   and again, until each part fits. A pass counts rows and bytes for every next byte of all oversized buckets at once, combined in
   the map tasks, and finds what the rows of each part have in common from there on, which is skipped: a shared scheme or host
   costs one pass, not one for each of its letters. An oversized bucket that is a single key is split by salt instead.
   Only the split points reach the driver: at most total bytes / ``limit`` a pass, and ``limit`` keeps that under ``most_splits``.
3. Rows are shuffled by bucket; each bucket is put into a trie with path compression, whose terminals count the copies and keep the
   smallest id. Comparison is on whole canonical bytes; terminals of salted buckets, which are one key, are added up.
4. Terminals of more than one copy meet the narrow combined rows (bucket, digest and ids, no text) again, which gives every copy
   the first id of its group. Spark's skew join may split this join, as one side has each key once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_key
from ..session import cores_hint, materialize

#: Bytes that a map task combines at a time, and bytes that a pass looks ahead for what keys have in common.
TOGETHER, WINDOW = 64_000_000, 64
FIELD_LINE = r"^[^:\n]{1,60}:"


def canonical_url(c: Column) -> Column:
    """Letters, marks and digits of the lower-cased url; the parts of the query, each canonical, in order."""
    path, query = F.substring_index(c, "?", 1), F.when(F.instr(c, "?") > 0, F.expr("substring({0}, instr({0}, '?') + 1)".format("__u"))).otherwise("")
    parts = F.array_sort(F.filter(F.transform(F.split(query, "&"), alnum_key), lambda x: x != ""))
    return F.concat(alnum_key(path), F.lit("?"), F.array_join(parts, "&"))


def canonical_content(c: Column) -> Column:
    """Canonical fields in order for a JSON object and for lines that all are ``field: value``; canonical prose otherwise."""
    bare = F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}]+", "")
    obj = F.when(F.startswith(bare, F.lit("{")), F.from_json(bare, "map<string,string>"))
    fields = F.transform(F.map_entries(obj), lambda e: alnum_key(F.concat(e["key"], F.coalesce(e["value"], F.lit("")))))
    rows = F.filter(F.split(c, r"[\r\n\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]+"), lambda x: alnum_key(x) != "")
    is_fields = (F.size(rows) > 1) & F.forall(rows, lambda x: x.rlike(FIELD_LINE))
    joined = lambda a: F.array_join(F.array_sort(a), "\x1e")
    return F.when(F.size(fields) > 0, joined(fields)).when(is_fields, joined(F.transform(rows, alnum_key))).otherwise(alnum_key(c))


def _canonical(rows: DataFrame, id_col: str, url: str, content: str) -> DataFrame:
    x = rows.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("__u"), F.col(content).cast("string").alias("__c")).where("id is not null and __u is not null and __c is not null")
    x = x.where(F.regexp_replace("__c", r"[\s\p{Z}\p{Cf}\p{Cc}]+", "") != "")
    x = x.select("id", canonical_url(F.col("__u")).alias("u"), canonical_content(F.col("__c")).alias("c"))
    text = F.concat_ws("\x1f", "u", "c")
    return x.select("id", F.encode(text, "UTF-8").alias("key"), F.unhex(F.md5(text)).alias("digest"))


def _combine(batches):
    """Equal keys become one row: key, digest, ids (in order); over batches of ``TOGETHER`` bytes."""
    groups: dict[bytes, tuple[bytes, list]] = {}
    held, kind = 0, None

    def rows():
        return pa.record_batch([pa.array(list(groups), pa.binary()), pa.array([d for d, _ in groups.values()], pa.binary()), pa.array([sorted(i) for _, i in groups.values()], pa.list_(kind))], names=["key", "digest", "ids"])

    for b in batches:
        kind = b.column(0).type
        for i, k, d in zip(*(c.to_pylist() for c in b.columns)):
            got = groups.get(k)
            if got is None:
                groups[k] = (d, [i])
                held += len(k)
            else:
                got[1].append(i)
        if held > TOGETHER or sum(len(i) for _, i in groups.values()) > 200_000:
            yield rows()
            groups, held = {}, 0
    if groups:
        yield rows()


class Splits:
    """The split points: node 0 is all rows; ``at[n]`` is the byte that parts node n, ``to[n]`` its parts by that byte."""

    def __init__(self):
        self.at, self.to, self.salt, self.nodes = {}, {}, {}, 1

    def find(self, key: bytes) -> tuple[int, int]:
        """The node a key ends in, and the place of the last byte looked at (-1 for none)."""
        n, last = 0, -1
        while n in self.to:
            at = last = self.at[n]
            child = self.to[n].get(key[at] if at < len(key) else -1)
            if child is None:
                return n, last
            n = child
        return n, last


def _histogram(shared):
    """Keys and digests -> for each open node and next byte: rows, bytes, the least and greatest of the next bytes and of the digests."""

    def go(batches):
        splits, opened, window = shared.value
        seen: dict[tuple[int, int], list] = {}
        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, _ = splits.find(k)
                at = opened.get(n)
                if at is None:
                    continue
                more = k[at + 1 : at + 1 + window]
                got = seen.get(p := (n, k[at] if at < len(k) else -1))
                if got is None:
                    seen[p] = [1, len(k), more, more, d, d]
                else:
                    got[0] += 1
                    got[1] += len(k)
                    if more < got[2]:
                        got[2] = more
                    elif more > got[3]:
                        got[3] = more
                    got[4], got[5] = min(got[4], d), max(got[5], d)
        rows = [(n, c, *v) for (n, c), v in seen.items()]
        cols = list(zip(*rows)) if rows else [[]] * 8
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=["node", "digit", "n", "bytes", "lo", "hi", "dlo", "dhi"])

    return go


def find_splits(pre: DataFrame, limit: int) -> Splits:
    """The split points under which no bucket holds more than ``limit`` bytes, single keys aside, which get a number of salts."""
    spark, splits = pre.sparkSession, Splits()
    opened, window = {0: 0}, WINDOW
    while opened:
        shared = spark.sparkContext.broadcast((splits, opened, window))
        h = pre.select("key", "digest").mapInArrow(_histogram(shared), "node int, digit int, n bigint, bytes bigint, lo binary, hi binary, dlo binary, dhi binary")
        h = h.groupBy("node", "digit").agg(F.sum("bytes").alias("bytes"), *[F.min(c).alias(c) for c in ("lo", "dlo")], *[F.max(c).alias(c) for c in ("hi", "dhi")])
        # small parts of a node stay in it, one bucket for each first byte is not needed for them
        big = h.where(F.col("bytes") > limit).collect()
        at, opened = opened, {}
        for n in at:
            splits.at[n], splits.to[n] = at[n], {}
        for r in big:
            child, splits.nodes = splits.nodes, splits.nodes + 1
            splits.to[r["node"]][r["digit"]] = child
            lo, hi = bytes(r["lo"]), bytes(r["hi"])
            same = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
            if r["digit"] < 0 or (lo == hi and len(lo) < window) or r["dlo"] == r["dhi"]:
                splits.salt[child] = -(-r["bytes"] // limit)  # a single key
            else:
                opened[child] = at[r["node"]] + 1 + same
        window = min(2 * window, 1 << 20)  # long keys that are long the same take few passes
    return splits


def _place(shared):
    """Combined rows with their bucket: the node, the byte that leads out of it, and a salt in oversized single keys."""

    def go(batches):
        splits = shared.value
        for b in batches:
            out = []
            for j, k in enumerate(b.column(0).to_pylist()):
                n, last = splits.find(k)
                digit = (k[last] if last < len(k) else 256) if n in splits.to else 257
                out.append((n, digit, j % splits.salt.get(n, 1)))
            node, digit, salt = zip(*out) if out else ((), (), ())
            yield pa.record_batch([*b.columns, pa.array(node, pa.int32()), pa.array(digit, pa.int32()), pa.array(salt, pa.int32())], names=["key", "digest", "ids", "node", "digit", "salt"])

    return go


class Trie:
    """A byte trie with path compression; a terminal counts its key's copies and keeps the smallest id and the digest."""

    __slots__ = ("root",)

    def __init__(self):
        self.root: dict = {}  # first byte -> [edge, children, terminal]

    def add(self, key: bytes, first, copies: int, digest: bytes) -> None:
        children, at = self.root, 0
        while True:
            node = children.get(key[at])
            if node is None:
                children[key[at]] = [key[at:], {}, [first, copies, digest]]
                return
            edge = node[0]
            if not key.startswith(edge, at):
                k, most = 1, min(len(edge), len(key) - at)
                while k < most and edge[k] == key[at + k]:
                    k += 1
                children[key[at]] = node = [edge[:k], {edge[k]: [edge[k:], node[1], node[2]]}, None]
                edge = node[0]
            at += len(edge)
            if at == len(key):
                if node[2] is None:
                    node[2] = [first, copies, digest]
                else:
                    node[2][0] = min(node[2][0], first)
                    node[2][1] += copies
                return
            children = node[1]

    def terminals(self):
        stack = list(self.root.values())
        while stack:
            _, children, end = stack.pop()
            if end is not None:
                yield end
            stack.extend(children.values())


def _count(table: pa.Table) -> pa.Table:
    trie = Trie()
    for key, digest, first, n in zip(*(table.column(c).to_pylist() for c in ("key", "digest", "first", "n"))):
        trie.add(key, first, n, digest)
    rows = list(trie.terminals())
    own = [table.column(c)[0].as_py() for c in ("node", "digit")]
    return pa.table({"node": pa.array([own[0]] * len(rows), pa.int32()), "digit": pa.array([own[1]] * len(rows), pa.int32()), "digest": pa.array([r[2] for r in rows], pa.binary()), "first": pa.array([r[0] for r in rows], table.column("first").type), "copies": pa.array([r[1] for r in rows], pa.int64())})


def canonical_copies(rows: DataFrame, *, id_col: str, url: str, content: str, bucket_bytes: int = 32_000_000, most_splits: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(groups, members): groups has first (the smallest id), copies and digest of every group of at least two records that are
    the same but for formatting; members has first and id of every record of such a group but the first.

    Records are the same when url and content agree after leaving out letter case, white space, punctuation, symbols and
    format characters, and the order of the url's query parameters and of the fields of a content made of fields. Null ids
    and urls, and null or blank contents, are in no group. A row delivered twice counts as a copy but is never its own member
    row twice. Texts are compared whole. An empty table gives two empty results.
    """
    src = _canonical(rows, id_col, url, content)
    kind = src.schema["id"].dataType.simpleString()
    ids = f"ids array<{kind}>"
    pre = materialize(src.mapInArrow(_combine, f"key binary, digest binary, {ids}"), "canonical")
    total = pre.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    # buckets for all cores, of no more bytes than a task should hold; beyond that only as much as keeps the split points few
    limit = max(min(bucket_bytes, max(total // (8 * cores_hint(rows.sparkSession)), 1 << 16 if bucket_bytes >= 1 << 16 else 1)), total // most_splits)
    splits = rows.sparkSession.sparkContext.broadcast(find_splits(pre, limit))
    placed = pre.mapInArrow(_place(splits), f"key binary, digest binary, {ids}, node int, digit int, salt int")
    bucket = ["node", "digit", "salt"]
    ends = placed.select(*bucket, "key", "digest", F.get("ids", F.lit(0)).alias("first"), F.size("ids").alias("n")).groupBy(*bucket).applyInArrow(_count, f"node int, digit int, digest binary, first {kind}, copies bigint")
    if splits.value.salt:
        ends = ends.groupBy("node", "digit", "digest").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))
    groups = materialize(ends.where("copies > 1").select("digest", "first", "copies"), "groups")
    # a digest of 128 bits stands for the key from here on
    members = pre.select("digest", "ids").join(groups, "digest").select("first", F.explode("ids").alias("id")).where(F.col("id") != F.col("first")).distinct()
    return groups, members


def canonical_members(rows: DataFrame, **kw) -> DataFrame:
    """first, id: every record of a group but its first."""
    return canonical_copies(rows, **kw)[1]


def one_each(rows: DataFrame, *, id_col: str, url: str, content: str, **kw) -> DataFrame:
    """The rows without the later copies, with a column copies (1 where nothing is the same)."""
    groups, members = canonical_copies(rows, id_col=id_col, url=url, content=content, **kw)
    kept = rows.join(members.select(F.col("id").alias("__gone")), F.col(id_col) == F.col("__gone"), "left_anti")
    return kept.join(groups.select(F.col("first").alias("__first"), F.col("copies").alias("copies")), F.col(id_col) == F.col("__first"), "left").drop("__first").withColumn("copies", F.coalesce("copies", F.lit(1)))
