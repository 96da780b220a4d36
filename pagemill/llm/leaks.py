"""Evaluation texts that leak into training text (problem 9).

One Aho-Corasick automaton over all runs of ``n`` successive words of the held-out texts scans each document once. The
automaton's alphabet is words, not characters: each distinct held-out word has a number and every other word is 0, so a run
of 12 words costs 12 nodes and a document is scanned in one call. Hits are mapped back to character offsets of the original.

Cost: one pass over the documents, no shuffle but the final distinct. The held-out side is read to the driver in blocks of at
most ``block_words`` words (checked), each block is broadcast and is another pass; a few hundred items are one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_RUN = r"[\p{L}\p{M}\p{Nd}]+"
_runs = regex.compile(WORD_RUN)
OUT = "doc_id bigint, item_id bigint, field string, start int, stop int, words int"
_built: dict = {}


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, combining marks and digits."""
    return [w.lower() for w in _runs.findall(text)] if text else []


def build(rows: list[tuple[int, str, list[str]]], n: int):
    """The automaton over every run of n words of the rows (item, field, words), and the numbers of the words."""
    import ahocorasick

    number: dict[str, int] = {}
    owners: dict[tuple[int, ...], set] = {}
    for item, field, ws in rows:
        ids = [number.setdefault(w, len(number) + 1) for w in ws]
        for i in range(len(ids) - n + 1):
            owners.setdefault(tuple(ids[i : i + n]), set()).add((item, field))
    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for k, v in owners.items():
        a.add_word(k, tuple(sorted(v)))
    if owners:
        a.make_automaton()
    return (a if owners else None), number


def spans(text: str | None, automaton, number: dict[str, int], n: int) -> list[tuple[int, str, int, int, int]]:
    """(item, field, start, stop, words) of each maximal run of hits, as character offsets of the original text."""
    if not text or automaton is None:
        return []
    ws = words_of(text)
    if len(ws) < n:
        return []
    hits: dict[tuple, list[list[int]]] = {}
    for end, owned in automaton.iter(tuple(number.get(w, 0) for w in ws)):
        for o in owned:
            runs = hits.setdefault(o, [])
            if runs and runs[-1][1] >= end - n:  # goes on where the last one stands
                runs[-1][1] = end
            else:
                runs.append([end - n + 1, end])
    if not hits:
        return []
    at = [m.span() for m in _runs.finditer(text)]
    return [(o[0], o[1], at[a][0], at[b][1], b - a + 1) for o, runs in sorted(hits.items()) for a, b in runs]


def _blocks(items: DataFrame, item_id: str, fields: list[str], block_words: int) -> Iterator[list]:
    rows = items.select(F.col(item_id).cast("long").alias("i"), *[F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(fields)]).where("i is not null").distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        for k, c in enumerate(fields):
            ws = words_of(r[f"f{k}"])
            block.append((r["i"], c, ws))
            size += len(ws)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def leak_spans(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: tuple[str, ...] = ("text", "question"), n: int = 12, block_words: int = 2_000_000) -> DataFrame:
    """Every maximal run of at least ``n`` successive words that a document shares with a held-out text.

    Returns doc_id, item_id, field, start and stop (character offsets in the document's original text) and words.
    Null, empty and blank texts, texts of fewer than n words and null ids give no row. Repeated documents give the same spans
    once each row; repeated items count once. Overlapping runs of one item and field are merged. Columns other than those
    named are ignored. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t")).where("d is not null and t is not null")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("field", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32())])
    out = None
    for rows in _blocks(items, item_id, list(fields), block_words):
        shared, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def scan(batches, shared=shared, name=name):
            key = (name, n)  # one automaton a worker; names never come again
            if key not in _built:
                _built.clear()
                _built[key] = build(shared.value, n)
            automaton, number = _built[key]
            for b in batches:
                got = [(d, *s) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in spans(t, automaton, number, n)]
                if got:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)

        part = src.mapInArrow(scan, OUT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], OUT)


def leaked_items(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """doc_id, item_id: each document with each item whose text (not question) it holds in part; every pair once."""
    return leak_spans(docs, items, **kw).where("field = 'text'").select("doc_id", "item_id").distinct()
