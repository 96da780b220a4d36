"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

A first pass counts the pieces of all texts in the JVM; the most frequent ``lexicon_words`` of them are encoded once and
compiled into a minimal acyclic transducer (``lexicon.py``), which is written to the shared folder and memory-mapped by each
Python worker. The second pass cuts each text with the vocabulary's own pattern, looks every piece up in the transducer and
merges the unseen pieces exactly, by rank. Ids are those of the public encoder for every text; the lexicon only saves merges.

Cost: two scans. The counting shuffle is combined before it is written and grows with the vocabulary, not with the text; the
encoding pass has no shuffle. The driver holds at most ``lexicon_words`` pieces.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_path, shared_file
from .lexicon import Lexicon, compile_lexicon

#: The pattern that cuts a text before the merges (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = os.environ.get("PAGEMILL_TOKENIZERS", "/opt/tokenizers")
_workers: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def exact_encoder(path: str):
    """The exact merges of a vocabulary, for pieces that the lexicon lacks."""
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def frequent_pieces(docs: DataFrame, text: str, most: int) -> list[str]:
    """The most frequent pieces over all texts that occur at least twice; ties in code-point order. At most ``most`` rows reach the driver."""
    pieces = docs.select(F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(PATTERN), F.lit(0))).alias("w"))
    # the longest piece worth a place in the lexicon: longer ones hardly recur and would only widen the shuffle
    top = pieces.where("length(w) between 1 and 40").groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(most)
    return [r["w"] for r in top.select("w").collect()]


class Encoder:
    """Pieces by lexicon, the rest by exact merges; a bounded memo keeps the pieces just used."""

    MEMO = 200_000

    def __init__(self, lexicon: Lexicon, vocabulary: str):
        import regex

        self._cut, self._lexicon, self._exact, self._memo = regex.compile(PATTERN).findall, lexicon, exact_encoder(vocabulary), {}
        self.merged = 0

    def piece(self, w: str) -> list[int]:
        ids = self._lexicon.get(w.encode("utf-8", "replace"))
        if ids is None:
            self.merged += 1
            ids = self._exact.encode_ordinary(w)
        if len(self._memo) >= self.MEMO:
            self._memo.clear()
        self._memo[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; an empty list for None and for the empty text."""
        if not text:
            return []
        out: list[int] = []
        memo, piece = self._memo, self.piece
        for w in self._cut(text):
            out += memo.get(w) or piece(w)
        return out


def encode_corpus(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, lexicon_words: int = 65_536) -> DataFrame:
    """doc_id, ids: one row for every row of ``docs``, with the ids of its text without special tokens.

    Null and empty texts get an empty list; blank texts are encoded like any other. Texts of any length are encoded whole.
    A null doc_id is kept. Repeated rows are kept as they come. Columns other than the two named are ignored. The strings of
    special tokens inside a text are ordinary text. ``vocabulary`` is a .tiktoken file that every worker can read.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    exact = exact_encoder(vocabulary)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    data = compile_lexicon({w.encode(): exact.encode_ordinary(w) for w in frequent_pieces(src, "t", lexicon_words)})
    uri = shared_file(spark, "lexicon.bin", data)
    mapped = local_path(uri)
    spare = spark.sparkContext.broadcast(data)  # for workers that don't see the shared folder as a file system
    kind = src.schema["doc_id"].dataType

    def run(batches):
        key = (uri, vocabulary)
        if key not in _workers:
            _workers.clear()
            _workers[key] = Encoder(Lexicon(mapped if mapped and os.path.exists(mapped) else spare.value), vocabulary)
        encode = _workers[key].encode
        for b in batches:
            ids = pa.array([encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch([b.column(0), ids], names=["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>")
