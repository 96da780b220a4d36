import random

from pagemill.llm import similar as S

SCHEMA = "item_id bigint, content string, rep string, bit string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)


def brute(rows, run, t, least):
    sets = {}
    for i, c in rows:
        w = (c or "").lower().split()
        if i is not None and len(w) >= least:
            sets[i] = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 6)):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 2)] = [r.choice(words)] * r.randint(0, 2)
        else:
            w = [r.choice(words) for _ in range(r.randint(20, 80))]
        rows.append((i, " ".join(w) if len(w) else "x"))
    return rows


def test_all_pairs_as_brute_force(spark):
    for seed, run, t in ((1, 3, 0.6), (2, 5, 0.8)):
        rows = corpus(seed, 250)
        got = {(r["id_a"], r["id_b"]) for r in S.similar_pairs(frame(spark, rows), id_col="item_id", text="content", run=run, likeness=t).collect()}
        assert got == brute(rows, run, t, 20)


def test_no_setting_loses_pairs(spark):
    rows = corpus(3, 200)
    want = brute(rows, 3, 0.6, 20)
    for kw in ({"hot": 2}, {"hot": 2, "broadcast_rows": 0}, {"hot": 1000}):
        got = {(r["id_a"], r["id_b"]) for r in S.similar_pairs(frame(spark, rows), id_col="item_id", text="content", run=3, likeness=0.6, **kw).collect()}
        assert got == want, kw


def test_an_id_delivered_with_different_texts(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (4, c), (4, c), (5, c)]
    got = {(r["id_a"], r["id_b"]) for r in S.similar_pairs(frame(spark, rows), id_col="item_id", text="content", run=3, likeness=0.6).collect()}
    assert got in ({(1, 2), (4, 5)}, {(1, 3), (4, 5)})


def test_nulls_short_equal_and_repeated(spark):
    a, b = " ".join(f"x{i}" for i in range(25)), " ".join(f"y{i}" for i in range(25))
    rows = [(1, a), (2, a.upper().replace(" ", "\n")), (2, a.upper().replace(" ", "\n")), (3, None), (4, ""), (5, "short text"), (None, a), (6, b), (7, "a " * 30), (8, "a " * 40)]
    got = {(r["id_a"], r["id_b"]) for r in S.similar_pairs(frame(spark, rows), id_col="item_id", text="content", run=3, likeness=0.6).collect()}
    assert got == {(1, 2), (7, 8)}
    assert S.similar_pairs(frame(spark, []), id_col="item_id", text="content").collect() == []


def test_groups_and_links(spark):
    base = [f"z{i}" for i in range(60)]
    rows = [(k, " ".join(base[k * 3 :] + [f"n{k}"] * 2)) for k in range(5)] + [(50, " ".join(f"q{i}" for i in range(30)))]
    got = {r["id"]: (r["group"], r["links"]) for r in S.similar_groups(frame(spark, rows), id_col="item_id", text="content", run=3, likeness=0.8).collect()}
    pairs = brute(rows, 3, 0.8, 20)
    assert got[50] == (50, 0)
    for i in range(5):
        assert got[i][1] == sum(i in p for p in pairs)
    assert len({got[i][0] for i in range(5)}) < 5


def test_very_long_text(spark):
    t = " ".join(f"w{i % 997}v{i}" for i in range(60_000))
    rows = [(1, t), (2, t + " end"), (3, "other " * 25)]
    got = {(r["id_a"], r["id_b"]) for r in S.similar_pairs(frame(spark, rows), id_col="item_id", text="content", run=3, likeness=0.6).collect()}
    assert got == {(1, 2)}
