"""Every operator over texts that are long and awkward; none may fail or hang."""

import os
import time

import pytest

from pagemill.llm import boilerplate, broken_pairs, canonical, cutoff, encode, leaks, residue, scans, similar, site_lines

N = 40_000
BAD = ["." * N + "a", " " * N + "a", "x" + " " * N + "y", "a" * N, "- " * N, "a " * N, "\n" * N + "x", "a-" * N, "…" * N, "आ" * N, "{{" * N, "1" * N, '"' * N + ".", "[ " * N, "&" * N + "x", "#a" * N, "|  " * N, "", None]


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def test_operators_over_awkward_texts(spark):
    t = time.time()
    df = spark.createDataFrame([(i, "https://s.example/", f"https://s.example/{i}", x and x[:50], x) for i, x in enumerate(BAD)], "page_id bigint, seed_url string, url string, title string, content string").cache()
    noop(boilerplate.boilerplate_lines(df, page_id="page_id"))
    noop(canonical.canonical_members(df, id_col="page_id", url="seed_url", content="content"))
    noop(similar.similar_pairs(df, id_col="page_id", text="content"))
    noop(broken_pairs.broken_pairs(df, pair_id="page_id", question="title"))
    noop(cutoff.ends(df, doc_id="page_id", text="content", source="seed_url"))
    noop(leaks.leaked_items(df, df, doc_id="page_id", text="content", item_id="page_id", fields=("title",)))
    noop(residue.residue_pages(df))
    noop(site_lines.flagged_lines(df))
    up = spark.createDataFrame([(i, [(1, x, "e", False, "", ""), (2, x, "e", False, "", "")]) for i, x in enumerate(BAD)], "upload_id bigint, pages array<struct<n:int,text:string,engine:string,review:boolean,reason:string,image:string>>")
    noop(scans.noisy_lines(up))
    noop(scans.repaired(up))
    assert time.time() - t < 240


@pytest.mark.skipif(not os.path.exists(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no vocabulary here")
def test_encoding_awkward_texts(spark):
    df = spark.createDataFrame(list(enumerate(BAD)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df).collect()}
    exact = encode.exact_encoder(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.tiktoken"))
    assert got == {i: exact.encode_ordinary(x) if x else [] for i, x in enumerate(BAD)}
