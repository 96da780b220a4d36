import json

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions import url as U
from pagemill.operators import catalog, chunks, cleaning, export, intake, ops, vectors
from pagemill.sources import api, crawl, html

PAGES = "job_id string, page_id bigint, page_idx int, seed_url string, url string, title string, content string"


def value(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("v")).first()["v"]


def test_text_functions(spark):
    assert value(spark, T.norm(F.col("t")), t=" a　\xa0b\n c ") == "a b c"
    assert value(spark, T.word_count(F.col("t")), t="a b_c 12") == 3
    assert value(spark, T.word_count(F.col("t")), t=None) == 0
    assert value(spark, T.ws_words(F.col("t")), t=None) == []
    assert value(spark, T.strip(F.col("t")), t="\xa0 x \t") == "x"


def test_url_normalize(spark):
    cases = {
        "http://H/fr/825?page=2&ref=x": "http://h/fr/825?page=2",
        "https://h/en/25#top": "https://h/en/25",
        "https://h/en/853/": "https://h/en/853",
        "https://h/en/671?utm_source=feed": "https://h/en/671",
        "https://h": "https://h/",
        "//h/a?B=1&b": "https://h/a?B=1&b=",
    }
    for a, b in cases.items():
        assert value(spark, U.normalize(F.col("u")), u=a) == b
    assert value(spark, U.normalize(F.col("u")), u=None) is None
    assert value(spark, U.normalize(F.col("u"), F.lit("www.h")), u="https://h/a") == "https://www.h/a"


def test_domains(spark):
    assert value(spark, U.root_domain(F.col("u")), u="a.assam.gov.in") == "assam.gov.in"
    assert value(spark, U.root_domain(F.col("u")), u="news.site.com") == "site.com"
    assert value(spark, U.same_domain(F.col("u"), F.lit("https://www.site.com/"), True), u="https://x.site.com/a") is True
    assert value(spark, U.same_domain(F.col("u"), F.lit("https://www.site.com/"), False), u="https://x.site.com/a") is False
    assert value(spark, U.crawlable(F.col("u")), u="https://a/x.PDF") is True
    for x in ("BMP", "wav", "mkv", "flv", "7z"):
        assert value(spark, U.crawlable(F.col("u")), u=f"https://a/x.{x}") is False
    assert value(spark, U.crawlable(F.col("u")), u="ftp://a/x") is False


def site(n=14, menu=("Home of all", "About our team", "Read more")):
    rows = []
    for i in range(n):
        body = [*menu, f"Heading {i}", f"This page number {i} tells of a place that no other page tells of, word {i}."]
        rows.append(("j", i, i, "https://s.example/", f"https://s.example/p{i}", f"Heading {i}", "\n".join(body)))
    return rows


def test_cleaning_removes_menus_and_keeps_unique_lines(spark):
    rows = site()
    rows.append(("j", 90, 90, "https://s.example/", "https://s.example/copy", "x", rows[3][6]))
    rows.append(("j", 91, 91, "https://s.example/", "https://s.example/tags/a", "x", "tag page"))
    rows.append(("j", 92, 92, "https://s.example/", "https://s.example/b", "x", "Access denied by the site"))
    rows.append(("j", 93, 93, "https://s.example/", "https://s.example/n", None, None))
    pages, summary = cleaning.clean_pages(spark.createDataFrame(rows, PAGES), None)
    got = {r["id"]: r for r in pages.collect()}
    assert set(got) == {*range(14), 93}
    assert got[2]["content"] == "Heading 2\n\nThis page number 2 tells of a place that no other page tells of, word 2."
    s = summary.first()
    assert (s["mode"], s["pages_in"], s["pages_out"], s["boilerplate_lines"], s["refused"]) == ("auto", 18, 15, 3, None)


def test_cleaning_gates_and_switch(spark):
    prof = "domain string, enabled boolean, threshold double, junk_urls array<string>, keep_pages array<string>, terms array<string>, top_lines int"
    pages = spark.createDataFrame(site(), PAGES)
    for p, refused in ((("s.example", False, None, None, None, None, None), "switched off"), (("s.example", True, 0.3, [], [], ["Home of ALL"], 0), "must-keep phrases would be lost: Home of ALL")):
        out, s = cleaning.clean_pages(pages, spark.createDataFrame([p], prof))
        assert s.first()["refused"] == refused
        assert {r["content"] for r in out.collect()} == {r[6] for r in site()}
    short = [("j", i, i, "https://s.example/", f"https://s.example/{i}", "t", "menu one two\nmenu three four\nmenu five six\nown " + str(i)) for i in range(12)]
    assert cleaning.clean_pages(spark.createDataFrame(short, PAGES), None)[1].first()["refused"].startswith("would remove")


def test_hub_pages_and_empty_table(spark):
    prof = "domain string, enabled boolean, threshold double, junk_urls array<string>, keep_pages array<string>, terms array<string>, top_lines int"
    pages = spark.createDataFrame(site(), PAGES)
    out, _ = cleaning.clean_pages(pages, spark.createDataFrame([("s.example", True, 0.3, [], ["/p5$"], [], 0)], prof))
    assert "Home of all" in {r["id"]: r["content"] for r in out.collect()}[5]
    assert cleaning.clean_pages(spark.createDataFrame([], PAGES), None)[0].collect() == []


def test_ui_lines(spark):
    for line, want in (("Read more »", True), ("More than 50 tourists", False), ("Share on Facebook (Opens in new window)", True), ("© 2024 Us", True), ("12 comments", True), ("https://a.b/c", True), ("----", True), ("Copyrighted work of ours", False)):
        assert value(spark, cleaning.is_ui_line(F.col("l")), l=line) is want, line


def test_export(spark):
    rows = [("j", i, i, "s", f"https://s/{n.lower()}-page.html", t, c) for i, (n, t, c) in enumerate([("A", "Home | Site", "Home\nText one\nRead more"), ("B", "About | Site", "About\nText two"), ("C", "News | Site", "News of the day"), ("D", None, "y"), ("E", "Empty | Site", "Read more")])]
    got = [(r["page"], r["content"]) for r in export.content_export(spark.createDataFrame(rows, PAGES)).orderBy("idx").collect()]
    assert got == [("Home", "Text one"), ("About", "Text two"), ("News", "News of the day"), ("D Page", "y")]
    assert value(spark, export.page_name(F.col("t"), F.col("u")), t="", u="https://s/3d-x's_view.php") == "3D X'S View"
    assert value(spark, export.page_name(F.col("t"), F.col("u")), t=None, u="https://s/") == "Home"


def test_change_status(spark):
    old = spark.createDataFrame([("https://a/x", "h")], "url string, content_hash string").withColumn("content_hash", T.fingerprint(F.lit("same")))
    new = spark.createDataFrame([(1, "https://a/x/", "same"), (2, "https://a/x#y", " same "), (3, "https://a/x", "other"), (4, "https://a/z", "n"), (5, None, None)], "id int, url string, content string")
    assert {r["id"]: r["status"] for r in catalog.change_status(new, old).collect()} == {1: "skipped_unchanged", 2: "skipped_unchanged", 3: "updated", 4: "new", 5: "new"}
    assert {r["id"]: r["status"] for r in catalog.change_status(new, old, force=True).collect()}[1] == "new"


def test_chunks():
    assert chunks.pack_chunks(None) == [] and chunks.pack_chunks("  ") == [] and chunks.pack_chunks("a" * 600) == ["a" * 600]
    long = "\n".join(["Sentence one is here. " * 20, "short", "x" * 700])
    got = chunks.pack_chunks(long, 100, 10)
    assert all(got) and "x" * 700 in got
    two = chunks.pack_chunks("a" * 60 + "\n" + "b" * 60, 100, 10)
    assert two == ["a" * 60, "a" * 10 + " " + "b" * 60]
    assert chunks.pack_chunks("ক।\n" * 200, 100, 0)


def test_passages():
    p = lambda n, w="w": " ".join([w] * n)
    assert chunks.pack_passages(None) == []
    assert [len(x.split()) for x in chunks.pack_passages("\n\n".join([p(100), p(100), p(20)]))] == [220]
    assert [len(x.split()) for x in chunks.pack_passages("\n\n".join([p(150), p(150), p(45)]))] == [150, 195]
    assert chunks.pack_passages(p(5)) == []


def test_budget_fold(spark):
    df = spark.createDataFrame([("j", i, n) for i, n in enumerate([3, 9, 4, 3, 0, 1])], "job string, idx int, n int")
    got = {r["idx"]: r["fits"] for r in chunks.within_budget(df, "job", "idx", "n", 10).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False}


def test_vectors(spark):
    import numpy as np

    r = np.random.default_rng(1)
    v = r.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)] + [(999, None)], "vec_id bigint, embedding array<float>").repartition(5)
    got = vectors.top_k_many(df, df.where("vec_id % 50 = 0"), 3, block=2).collect()
    f = v.astype(np.float32).astype(float)
    for q in range(0, 300, 50):
        d = ((f - f[q]) ** 2).sum(1)
        d[q] = np.inf
        assert [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == list(np.argsort(d)[:3])
    assert [x["vec_id"] for x in vectors.top_k(df, list(f[7]), 1).collect()] == [7]
    h = vectors.feature_hash(spark.createDataFrame([("a b",), ("a b",), (None,)], "t string"), "t").collect()
    assert h[0]["embedding"] == h[1]["embedding"] and h[2]["embedding"] is None


def test_intake(spark):
    assert value(spark, intake.layer_quality(F.col("t")), t=None) == "empty"
    assert value(spark, intake.layer_quality(F.col("t")), t="অসমৰ কথা " * 10) == "good"
    assert value(spark, intake.layer_quality(F.col("t")), t="ø¬ıÚ±˜”˘œ˚˛±" * 8) == "garbled"
    assert value(spark, intake.layer_quality(F.col("t")), t="ab c\n" * 20) == "garbled"
    assert value(spark, intake.agreement(F.col("a"), F.col("b")), a="one two three", b="Two THREE") == 1.0
    assert value(spark, intake.agreement(F.col("a"), F.col("b")), a=None, b="x") == 0.0
    pages = spark.createDataFrame([("d", i, f"Running Head\nbody of page {i}\n{i}") for i in range(8)], "upload_id string, at int, text string")
    got = intake.strip_repeated_lines(pages).orderBy("at").collect()
    assert got[3]["text"] == "body of page 3" and got[3]["removed"] == 2
    assert value(spark, intake.clean_text(F.col("t")), t="a\x07<br/>b \t c\r\n\r\n\r\n\r\nd") == "a\nb c\n\nd"


def test_ops(spark):
    e = spark.createDataFrame([("u", i, k) for i, k in enumerate("feeeffeeee")], "u string, at int, k string")
    assert sorted(tuple(r) for r in ops.streaks(e, "u", ["at"], F.col("k") == "e", 3).collect()) == [("u", 1, 3, 3), ("u", 6, 9, 4)]
    a = spark.createDataFrame([("u", f"2024-01-0{d} 0{h}:00:00", ok) for d, h, ok in ((1, 1, False), (1, 2, False), (1, 3, False), (1, 4, False), (2, 4, True), (2, 5, False), (2, 6, False), (2, 7, False))], "u string, t string, ok boolean").withColumn("t", F.to_timestamp("t"))
    assert [str(r["locked_at"]) for r in ops.lockouts(a, key="u", at="t", ok="ok").orderBy("locked_at").collect()] == ["2024-01-01 03:00:00", "2024-01-02 07:00:00"]
    b = spark.createDataFrame([("k", i) for i in range(20)] + [("single", 35)], "kind string, age int").withColumn("name", F.col("age")).withColumn("size", F.lit(1))
    plan = {(r["kind"], r["age"]): r["delete"] for r in ops.retention_plan(b, kind="kind", age_days="age", size="size", name="name", days=5).collect()}
    assert plan[("k", 0)] is False and plan[("k", 6)] is True and plan[("k", 5)] is False and plan[("single", 35)] is True


def test_resolved_links(spark):
    x = spark.createDataFrame([("https://s.example/dir/", "b"), ("https://s.example/a", "/x?y=1"), (None, "b"), ("https://s", None), ("https://s", "http://[x")], "url string, href string")
    assert [r["target"] for r in html.resolved(x).collect()] == ["https://s.example/dir/b", "https://s.example/x?y=1", "b", None, None]


def test_html():
    doc = "<html><head><title> T </title><meta name=Description content='d'><link rel=canonical href='/c'></head><body><nav>menu</nav><article><h1>H</h1><p>One <b>two</b> three and a good deal more of text to read here.<p>Second paragraph &amp; more</article><footer>foot</footer><a href='/x.pdf'>doc</a><a href='#a'>no</a><a href='b'>yes</a><script>var x = '</p>';</script></body>"
    p = html.parse(doc, "https://s.example/dir/")
    assert (p["title"], p["description"], p["canonical"]) == ("T", "d", "/c")
    assert p["content"].startswith("H\n\nOne\n\ntwo\n\nthree") and "menu" not in p["content"] and "foot" not in p["content"]
    assert p["links"] == [("b", "yes")] and p["documents"] == [("/x.pdf", "doc")]
    assert html.parse("<title> </title><meta property='og:title' content='og'>", "u")["title"] == "u"
    assert html.parse("<meta property='og:title' content='og'><h1>h</h1>", "u")["title"] == "og"
    assert html.parse("<template><p>unseen</p></template><p>seen", "u")["content"] == "seen"
    assert [h for h, _ in html.parse("<a href=a.rar></a><a href=b.7z>z</a><a href=c.txt>t</a><a href=d.odt?x=1></a>", "u")["documents"]] == ["a.rar", "b.7z", "d.odt?x=1"]
    assert html.parse("<a href=a.rar></a>", "u")["documents"] == [("a.rar", "Download Document")]
    lines = ["The name of the ferry is a long sentence by itself", "and the second line of it is long enough as well"]
    raw = {"props": {"pageProps": {"name": "\n".join([*lines, "short"]), "alt": "An alternative text that is long enough to be kept", "x": {"color": f"<p>{lines[0]} again</p>"}}}}
    assert html.data_text(json.dumps(raw)).split("\n\n") == [*lines, lines[0] + " again"]
    assert html.parse(None, "u")["title"] == "u"
    text = " ".join(["A long enough sentence of the page number %d for the reader." % i for i in range(8)])
    data = '<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"body": "%s", "slug": "a-slug-that-is-long-enough-to-count"}}}</script>' % text
    assert html.parse(data, "u")["content"] == text
    assert html.parse('<script id="__NEXT_DATA__">{broken</script>x', "u")["content"] == "x"


def test_sources(spark, tmp_path):
    (tmp_path / "a_s.json").write_text(json.dumps({"job_id": "a", "seed_url": "https://s/", "pages": [{"url": "https://s/1", "content": "x"}, {"url": "https://s/2"}]}))
    (tmp_path / "schedules.json").write_text("{}")
    (tmp_path / "bad.json").write_text("{")
    jobs = crawl.read_jobs(spark, str(tmp_path))
    assert [(r["job_id"], r["page_idx"], r["url"]) for r in crawl.job_pages(jobs).orderBy("page_idx").collect()] == [("a", 0, "https://s/1"), ("a", 1, "https://s/2")]
    spark.createDataFrame([("https://s/1", "<p>a"), ("https://s/2", "<p>b")], "url string, html string").write.parquet(str(tmp_path / "t"))
    spark.dataSource.register(crawl.PageSource)
    assert spark.read.format("pages").option("path", str(tmp_path / "t")).load().count() == 2
    links = spark.createDataFrame([("https://s/", 0, "https://s/a/"), ("https://s/", 1, "https://s/b?utm_x=1"), ("https://s/a", 0, "https://s/c"), ("https://s/c", 0, "https://s/d"), ("https://s/", 2, "https://other/x"), ("https://s/", 3, "https://s/f.zip")], "source string, pos int, href string")
    got = [(r["url"], r["depth"]) for r in crawl.frontier(links, "https://s/", max_depth=2).collect()]
    assert got == [("https://s/", 0), ("https://s/a", 1), ("https://s/b", 1), ("https://s/c", 2)]
    maps = spark.createDataFrame([("m", "<sitemapindex><loc>n</loc></sitemapindex>"), ("n", "<urlset><loc> https://s/1 </loc><loc>https://s/2</loc></urlset>")], "url string, text string")
    assert [r["loc"] for r in crawl.sitemap_urls(maps, ["m"]).collect()] == ["https://s/1", "https://s/2"]


def test_push(spark):
    pages = spark.createDataFrame([(f"u{i}", None, f"text {i}" if i < 5 else " \n") for i in range(7)], "url string, title string, content string").coalesce(1)
    sent = crawl.push(pages, lambda part: (200, {"created": len(part), "updated": 1, "embedded": None}) if len(part) < 3 else (500, {}), size=3, waits=(0, 0))
    assert [(r["rows"], r["tries"], r["status"], r["created"]) for r in sent.collect()] == [(3, 3, 500, 0), (2, 1, 200, 2)]
    assert crawl.push_totals(sent).first().asDict() == {"pages": 5, "batches": 2, "failed_batches": 1, "created": 2, "updated": 1, "embedded": 0, "aborted": False}

    def fails(part):
        raise TimeoutError

    assert [(r["tries"], r["status"], r["error"]) for r in crawl.push(pages, fails, size=5, waits=(0,)).collect()] == [(3, 0, "TimeoutError: ")]
    stopped = crawl.push(pages, lambda part: (403, {}), size=2).collect()
    assert [(r["rows"], r["tries"]) for r in stopped] == [(2, 1)] and crawl.push_totals(crawl.push(pages.limit(0), fails)).first()["pages"] == 0


def test_push_with_passages(spark):
    text = "\n\n".join(" ".join(f"w{k}{i}" for i in range(100)) for k in "abc")
    pages = spark.createDataFrame([("j", 1, 0, "https://s/", "https://s/1", "One", text, "new"), ("j", 2, 1, "https://s/", "https://s/2", "Two", "short", "new"), ("j", 3, 2, "https://s/", "https://s/3", "Three", text, "skipped_unchanged")], PAGES + ", change_status string")
    existing = spark.createDataFrame([(1, "https://s/1#c1"), (2, "https://s/3#c1"), (3, "https://s/9#c1")], "id bigint, url string")
    saved = []
    got = chunks.push_with_passages(pages, existing, lambda part: (200, {"created": len(part)}), save_backup=lambda b: saved.extend(r["id"] for r in b.collect()))
    assert (got["mode"], got["totals"]["pages"], saved) == ("passages", 3, [1]) and sorted(r["id"] for r in got["rest"].collect()) == [2, 3]
    assert chunks.push_with_passages(pages, existing, lambda part: (401, {}))["mode"] == "pages_after_failure"
    assert chunks.push_with_passages(pages, existing.drop("url"), lambda part: (200, {}))["mode"] == "pages_after_error"


def test_answers_cascade(spark):
    m = spark.createDataFrame([(1, 1, 0.1, "t", "u", "T", "q"), (2, 1, 0.2, "long " * 50, "u", "T", "q")], "query_id bigint, rank int, d double, text string, url string, title string, question string")
    asked = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "query_id bigint, question string")

    def broken(p):
        raise OSError

    got = {r["query_id"]: (r["provider"], r["answer"]) for r in vectors.answers(asked, m, [("a", broken), ("b", lambda p: "Yes. " if len(p) < 200 else "")]).collect()}
    assert got[1] == ("b", "Yes.") and got[2][0] == "local_synthesizer" and got[2][1].startswith("Based on") and got[3] == ("local_synthesizer", vectors.NOTHING_FOUND)


def test_json_list_and_exports(spark, tmp_path):
    x = spark.createDataFrame([("j", 1, "B", 'say "x"'), ("j", 0, "A", "a")], "job string, idx int, page string, content string")
    assert json.loads(crawl.json_list(x).first()["json"]) == [{"page": "A", "content": "a"}, {"page": "B", "content": 'say "x"'}]
    crawl.write_csv(x.coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert text.startswith(b'"\xef\xbb\xbfPage","Content"') and b'""x""' in text


def test_shared_folder_is_left_clean(spark):
    from pagemill import session

    with session.intermediate():
        path = session.materialize(spark.range(3)).inputFiles()[0]
        assert path
    import os

    assert not os.path.exists(path.removeprefix("file://").replace("file:", "").rsplit("/", 1)[0])


def test_save_pages_keeps_the_first_archive(spark, tmp_path):
    df = lambda t: spark.createDataFrame([("a", "u", t)], "job_id string, url string, content string")
    crawl.save_pages(df("c1"), df("r1"), str(tmp_path))
    crawl.save_pages(df("c2"), df("r2"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/raw").first()["content"] == "r1"
    assert [r["content"] for r in spark.read.parquet(f"{tmp_path}/pages").collect()] == ["c2"]


def test_api_items(spark):
    assert value(spark, api.content_type(F.col("s")), s="elementor_library") is False
    assert value(spark, api.content_type(F.col("s")), s="tour") is True
    assert value(spark, api.plain(F.col("s")), s="<b>A</b> &amp; B&#8217;s") == "A & B’s"
    assert value(spark, api.article_text(F.col("t"), F.col("x")), t="T", x="T and on") == "T and on"


def test_files_and_pictures(spark, tmp_path):
    from pagemill.sources import files

    (tmp_path / "db-20240101-0300").mkdir()
    (tmp_path / "db-20240101-0300" / "a").write_bytes(b"12345")
    (tmp_path / "db-20240101-0300" / "b").write_bytes(b"123")
    (tmp_path / "notes.txt").write_bytes(b"1")
    got = {r["entry"]: r["size"] for r in files.by_entry(files.entries(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert got == {"db-20240101-0300": 8, "notes.txt": 1}
    assert value(spark, files.backup_kind(F.col("n")), n="db-20240101-0300") == "db"
    p = spark.createDataFrame([("d", 1, "image", 500, 300), ("d", 1, "smask", 500, 300), ("d", 2, None, 10, 10)], "doc string, page int, kind string, width int, height int")
    assert {r["page"]: (r["pixels"], r["heavy"]) for r in intake.picture_pixels(p).collect()} == {1: (150_000, True), 2: (100, False)}


def test_pieces_and_schedule(spark):
    c = spark.createDataFrame([("s", 0, 2, b"ab"), ("s", 1, 2, b"c"), ("s", 1, 2, b"c"), ("t", 0, 2, b"x")], "sid string, i int, total int, data binary")
    assert {r["sid"]: (r["complete"], r["bytes"] and bytes(r["bytes"])) for r in ops.pieces(c, session="sid", index="i", total="total", data="data").collect()} == {"s": (True, b"abc"), "t": (False, None)}
    j = spark.createDataFrame([("https://S/", "2024-01-01 00:00:00"), ("https://s", "2024-01-05 00:00:00"), ("https://t", None)], "seed_url string, t string").select("seed_url", F.to_timestamp("t").alias("completed_at"))
    got = {r["seed"]: (r["days_remaining"], r["due"]) for r in ops.schedule(j, F.lit("2024-01-10").cast("timestamp")).collect()}
    assert got == {"https://s": (5, False), "https://t": (None, False)}
