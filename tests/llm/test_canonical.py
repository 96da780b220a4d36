import hashlib
import json
import random
import re

from hypothesis import given
from hypothesis import strategies as st

from pagemill.llm import canonical as C

SCHEMA = "rec_id bigint, url string, content string, id string, first string"
NAMES = {"id_col": "rec_id", "url": "url", "content": "content"}


def members(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in C.canonical_members(df, **NAMES, **kw).collect())


def test_forms_of_the_same_record(spark):
    fields = {"fare": "Rs. 20", "place": "Roli"}
    rows = [
        (7, "https://a.example/x?b=2&a=1", json.dumps(fields)),
        (3, "HTTPS://A.example/x?a=1&b=2", "place: ROLI\nfare : Rs 20"),
        (9, "https://a.example/x?a=1&b=2", "fare:Rs. 20\r\n\r\nplace:​Roli!"),
        (1, "https://a.example/x?a=1&b=2", "fare: Roli\nplace: Rs. 20"),  # values swapped: another record
        (4, "https://a.example/p", "One two. Three"),
        (5, "https://a.example/p", "one\xa0two—THREE"),
        (6, "https://a.example/p", "Three one two"),  # order of prose counts
    ]
    assert members(spark, rows) == [(3, 7), (3, 9), (4, 5)]


def test_nulls_blanks_and_repeats(spark):
    rows = [(1, None, "a b"), (2, None, "a b"), (3, "u", None), (4, "u", None), (5, "u", " ​\n"), (6, "u", ""), (None, "u", "x"), (8, "u", "x"), (8, "u", "x"), (9, "u", "x"), (9, "u", "X")]
    assert members(spark, rows) == [(8, 9)]
    assert members(spark, []) == []


def test_broken_json_and_duplicate_keys_do_not_fail(spark):
    rows = [(1, "u", '{"a": 1'), (2, "u", '{"a": 1}'), (3, "u", '{"a": "1", "a": "1"}'), (4, "u", "{}"), (5, "u", '{"a": null}'), (6, "u", '{"a": {"b": [1, 2]}}')]
    assert (1, 2) in members(spark, rows)


def test_hot_group_and_small_buckets_are_split(spark):
    rows = [(i, "https://h.example/", "same text") for i in range(3000)] + [(10_000 + i, "https://h.example/", f"text {i % 500} of many") for i in range(1500)]
    got = members(spark, rows, bucket_bytes=200)
    assert len(got) == 2999 + 1000
    assert all(a == 0 for a, b in got if b < 3000)


def test_one_each_counts(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "A."), (3, "u", "b")], "rec_id bigint, url string, content string")
    assert sorted((r["rec_id"], r["copies"]) for r in C.one_each(df, **NAMES).collect()) == [(1, 2), (3, 1)]


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=6), st.integers(0, 50)), max_size=60))
def test_trie_counts_like_a_dictionary(items):
    trie, want = C.Trie(), {}
    for k, i in items:
        trie.add(k, i, 1, k)
        a, n = want.get(k, (i, 0))
        want[k] = (min(a, i), n + 1)
    assert {d: (f, n) for f, n, d in trie.terminals()} == want


def test_against_brute_force(spark):
    r = random.Random(5)
    forms = [lambda s: s, str.upper, lambda s: s.replace(" ", "  "), lambda s: s + "!", lambda s: "​" + s]
    rows = [(i, r.choice(["https://x.example/a", "https://X.example/A/", "https://x.example/b"]), r.choice(forms)(r.choice(["one two", "two one", "ৰাতি পুৱা", "3 4"]))) for i in range(300)]
    bare = lambda s: re.sub(r"[^\w]|_", "", s.lower(), flags=re.U)
    groups: dict = {}
    import regex

    for i, u, c in rows:
        groups.setdefault((regex.sub(r"[^\p{L}\p{M}\p{N}]", "", u.lower()), regex.sub(r"[^\p{L}\p{M}\p{N}]", "", c.lower())), []).append(i)
    assert bare("A b") == "ab"
    assert members(spark, rows) == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


def test_splits_hold_the_limit(spark):
    r = random.Random(3)
    keys = [b"https" + bytes(r.choice(b"abc") for _ in range(r.randint(0, 6))) for _ in range(400)] + [b"https" * 30 + bytes([r.randrange(97, 100)]) for _ in range(100)] + [b"hot"] * 200
    keys += [b"z" * 30_000 + x for x in (b"1", b"1", b"2")]
    pre = spark.createDataFrame([(k, hashlib.md5(k).digest()) for k in keys], "key binary, digest binary")
    splits = C.find_splits(pre, 300)
    sizes: dict = {}
    for k in keys:
        n, last = splits.find(k)
        b = (n, (k[last] if last < len(k) else -1) if n in splits.to else None)
        sizes.setdefault(b, []).append(k)
    assert splits.salt
    for (n, _), ks in sizes.items():
        assert sum(map(len, ks)) <= 300 or (len(set(ks)) == 1 and splits.salt[n] >= 2)
