import os
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagemill.llm import encode, leaks
from pagemill.llm.lexicon import Lexicon, compile_lexicon


@given(st.dictionaries(st.binary(min_size=1, max_size=8), st.lists(st.integers(0, 60_000), min_size=1, max_size=4), max_size=40), st.binary(max_size=8))
def test_lexicon_round_trip(entries, other):
    lexicon = Lexicon(compile_lexicon(entries))
    assert len(lexicon) == len(entries)
    assert all(lexicon.get(k) == v for k, v in entries.items())
    assert lexicon.get(other) == entries.get(other)


def test_lexicon_is_minimal(tmp_path):
    words = {f"{a}{b}".encode(): [1] for a in ("walk", "talk", "bak") for b in ("ing", "ed", "er", "s")}
    data = compile_lexicon(words)
    (tmp_path / "x").write_bytes(data)
    lexicon = Lexicon(str(tmp_path / "x"))
    assert lexicon.get(b"baking") == [1] and lexicon.get(b"bakin") is None
    assert lexicon.states < 20 < sum(map(len, words))


vocabulary = os.path.join(encode.TOKENIZERS, "byte_bpe_50k.tiktoken")
needs = pytest.mark.skipif(not os.path.exists(vocabulary), reason="no vocabulary here")
TEXTS = [None, "", " ", "\n\n \t x", "It's 10:30, isn't it?", "অসমৰ কথা", "हिन्दी पाठ।", "<|endoftext|> as text", "😀é‍x", "a" * 50_000, "the same", "the same", "�", "　 wide"]


@needs
def test_ids_are_those_of_the_public_encoder(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "a", [1]) for i, x in enumerate(TEXTS)], "doc_id bigint, text string, t string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df, lexicon_words=5).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert encode.encode_corpus(df.where("false")).collect() == []


DOCS, ITEMS = "doc_id bigint, text string, item_id string, d string", "item_id bigint, text string, question string, doc_id string"


def brute(docs, items, n):
    import regex

    ws = lambda t: regex.findall(r"[\p{L}\p{M}\p{Nd}]+", (t or "").lower())
    runs = lambda t: {tuple(w[i : i + n]) for w in [ws(t)] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, x in items if d is not None and i is not None and runs(t) & runs(x)}


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: r.choice(["Eins", "zwei", "কথা", "three", "4", "fünf"])
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)] + [(7, None), (8, "too short"), (None, "x " * 20)]
    docs = [(i, None if i == 3 else " ".join(word() for _ in range(8)) + ", " + items[i % 6][1][10 * (i % 4) : 10 * (i % 4) + 60 + i].upper() + "!") for i in range(40)] + [(None, items[0][1]), (99, "")]
    d = spark.createDataFrame([(a, t, "x", "y") for a, t in docs], DOCS)
    e = spark.createDataFrame([(a, t, None, "z") for a, t in items], ITEMS)
    for n in (12, 5):
        for block in (10**6, 40):
            got = {(x["doc_id"], x["item_id"]) for x in leaks.leaked_items(d.unionByName(d), e, n=n, block_words=block).collect()}
            assert got == brute(docs, items, n)
    assert leaks.leaked_items(d, e.where("false")).collect() == [] and leaks.leaked_items(d.where("false"), e).collect() == []


def test_offsets_point_into_the_original(spark):
    text = "Intro -- ONE two, three four (five) six. Outro"
    d = spark.createDataFrame([(1, text, "", "")], DOCS)
    e = spark.createDataFrame([(5, "one two three four five six seven", "four five six", "")], ITEMS)
    got = {(x["field"], text[x["start"] : x["stop"]], x["words"]) for x in leaks.leak_spans(d, e, n=3).collect()}
    assert got == {("text", "ONE two, three four (five) six", 6), ("question", "four (five) six", 3)}
