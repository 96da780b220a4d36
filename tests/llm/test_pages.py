import random

import pytest

from pagemill.llm import boilerplate, residue, scans, site_lines

RAW = "raw_id bigint, seed_url string, title string, content string, host string, k string"
CRAWL = "page_id bigint, seed_url string, url string, title string, content string, s string, id string"


def raw(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], RAW)


def site(k, n, rng):
    names = [f"Zor{rng.choice('abcdefgh')}{rng.choice('klmn')}i" for _ in range(40)]
    rows = []
    for i in range(n):
        title = f"A {rng.choice(['rare', 'green', 'small', 'wide'])} day in {rng.choice(names)}"
        links = [f"A {rng.choice(['old', 'new', 'late'])} day in {rng.choice(names)}" for _ in range(3)]
        para = f"Nobody in {rng.choice(names)} remembers who opened the {rng.choice(['mill', 'school', 'bridge'])} number {i} of site {k}."
        rows.append((title, ["Home | News | Contact", f"Home › News › {title}", title, para, "", "Most read", *links, para.replace("Nobody", "Somebody"), f"© 2025 Site{k} Times", "Back to top"]))
    return rows


def test_boilerplate_of_small_sites(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for k in range(8):
        for title, lines in site(k, 8, rng):
            i = len(rows)
            rows.append((i, f"https://S{k}.example/", title if i % 9 else None, "\n".join(lines)))
            want |= {(i, j) for j in (1, 2, 6, 7, 8, 9, 11, 12)}
    rows += [(900, None, None, None), (901, "https://s1.example", "t", " \n"), (None, "https://s1.example", "t", "x"), rows[0]]
    got = {tuple(r) for r in boilerplate.boilerplate_lines(raw(spark, rows)).collect()}
    assert got == want
    assert boilerplate.boilerplate_lines(raw(spark, [])).collect() == []
    body = {r["raw_id"]: r["content"] for r in boilerplate.main_content(raw(spark, rows[:1])).collect()}
    assert set(body) == {0}


def test_boilerplate_is_decided_per_host(spark):
    letters = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(3))
    rows = []
    body = lambda i: f"Title {letters(i)}\n{letters(i)}ora {letters(i)}ina {letters(i)}upa."
    # on all pages of small hosts and on one page of a hot one
    for i in range(300):
        hot = i >= 60
        rows.append((i, "https://hot.example" if hot else f"https://h{i // 12}.example", f"Title {letters(i)}", body(i) + ("" if 60 < i else "\nSearch this site")))
    got = {tuple(r) for r in boilerplate.boilerplate_lines(raw(spark, rows)).collect()}
    assert got == {(i, 3) for i in range(60)}
    # on a part of the pages of a hot host under 40 %, as much as hides it in a pooled count
    rows = [(i, "https://hot.example" if i >= 60 else f"https://h{i // 12}.example", f"Title {letters(i)}", body(i) + ("\nSearch this site" if i < 60 or i % 6 == 0 else "")) for i in range(600)]
    assert {tuple(r) for r in boilerplate.boilerplate_lines(raw(spark, rows)).collect()} == {(i, 3) for i in range(60)}


def crawl(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], CRAWL)


def test_site_lines_by_definition(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        s = rng.choice(["https://A.example/", "https://a.example", "https://b.example/"])
        lines = [x for x, p in (("Share this page!", 0.5), ("share THIS page …", 0.2), ("All rights reserved", 0.15), ("12 34", 0.9), ("", 0.5)) if rng.random() < p] + [f"own line {chr(97 + i % 26)}{chr(97 + i // 26)}"]
        rng.shuffle(lines)
        rows.append((i, s, f"https://u/{i // 2}", "t", "\n".join(lines)))
    rows += [rows[5], (500, None, "u", "t", "Share this page"), (501, "https://b.example", None, "t", "Share this page"), (502, "https://b.example", "u9", "t", None), (503, "https://small.example", "u", "t", "Share this page")]
    key = lambda x: "".join(c for c in x.lower() if c.isalpha())
    norm = lambda s: s.lower().removesuffix("/")
    urls, have = {}, {}
    for i, s, u, _, c in rows:
        if s and u:
            urls.setdefault(norm(s), set()).add(u)
            for x in (c or "").split("\n"):
                have.setdefault((norm(s), key(x)), set()).add(u)
    want = set()
    for i, s, u, _, c in rows:
        if s and c:
            for n, x in enumerate(c.split("\n"), 1):
                m, t = len(have.get((norm(s), key(x)), ())), len(urls.get(norm(s), ()))
                if key(x) and t >= 10 and m >= 5 and m >= 0.2 * t:
                    want.add((i, n))
    df = crawl(spark, rows)
    for limit in (0, 10**6):
        got = site_lines.flagged_lines(df, broadcast_rows=limit).collect()
        assert {(r["page_id"], r["line_no"]) for r in got} == want and want
    assert all(r["llr"] is not None and r["llr"] >= 0 for r in got)
    clean = {r["page_id"]: r["content"] for r in site_lines.without_lines(df.where("page_id < 120").dropDuplicates(["page_id"])).collect()}
    assert len(clean) == 120 and not any("share" in (c or "").lower() for i, c in clean.items())
    assert site_lines.flagged_lines(crawl(spark, [])).collect() == []


@pytest.mark.parametrize(("text", "kind"), [("We're sorry but this app doesn't work properly without JavaScript enabled.", "script"), ("This page isn't working", "error"), ("This site can’t be reached right now.", "error"), ("The mill doesn't work without water.", None)])
def test_common_notices(text, kind):
    assert residue.line_kind(text) == kind
    assert kind is None or residue.Gate()(None, "Some page\n" + text)


def test_title_case_placeholders_and_slots():
    assert residue.slot_left("Dear [First Name],", residue.Slots([], []))
    assert not residue.slot_left("The ferry [Photo] leaves.", residue.Slots([], []))
    slots = residue.Slots([("Dear", ",", "^$"), ("Welcome to the town of", "and its mills", "")], ["first name", "town name"])
    for x in ("Hello\nDear first_name,\nmore", "Dear ,", "  Dear [first name] ,", "So: Welcome to the town of town-name and its mills."):
        assert slots.left(x), x
    for x in ("Dear Anita,", "Oh Dear first_name, yes", "Welcome to the town of Roli and its mills."):
        assert not slots.left(x), x


def test_line_test_over_all_lines(spark):
    import math

    rows, n = [], 0
    for site, own, common in (("https://a.example", 30, 6), ("https://b.example", 0, 6), ("https://c.example", 0, 6)):
        for i in range(30):
            lines = [f"body {site[8]} " + chr(97 + i % 26) + chr(97 + i // 26)] + (["Only here"] if i < own else []) + (["Everywhere the same"] if i < common else [])
            rows.append((n := n + 1, site, f"{site}/{i}", "t", "\n".join(lines)))
    df = crawl(spark, rows)
    got = {(r["s"][8], r["urls"]): r for r in site_lines.tested_lines(df).where("urls > 1").collect()}
    a = got["a", 30]
    assert (a["site_urls"], a["other_urls"], a["significant"]) == (30, 0, True)
    want = 2 * (30 * math.log(1) - 30 * math.log(1 / 3) - 60 * math.log(2 / 3))
    assert abs(a["llr"] - want) < 1e-9
    for k in "abc":  # on a fifth of the urls of every site: in excess by its share alone
        assert (got[k, 6]["other_urls"], got[k, 6]["significant"]) == (12, False) and got[k, 6]["share"] == 0.2
    assert site_lines.flagged_lines(df).count() == 30 + 18
    assert site_lines.flagged_lines(df, require_significance=True).count() == 30


def test_residue_kinds(spark):
    foot = "All fares include tax.\nScan the code at the gate"
    real = "The mill opens at seven and closes at nine. " * 4
    bodies = {
        "template": ["Dear {{ first_name }},\n" + real, "Fare: TODO: write price\n" + real, real + " [Your Name]", real + " %CITY%", real + " <%= date %>"],
        "error": ["404 Not Found\nThe requested address /a/b was not found on this server.", "Gateway time-out\nError 524. The origin took too long to respond.", "Our systems noticed unusual traffic from your network. Solve the puzzle to go on.", "ত্ৰুটি\nচাৰ্ভাৰত সমস্যা হৈছে। পাছত আকৌ চেষ্টা কৰক।"],
        "filler": ["Lorem ipsum dolor sit amet\nConsectetur adipiscing elit sed do eiusmod.", "Your heading goes here\nEdit this block to tell your story.", "asdf asdf asdf asdf asdf asdf asdf asdf", "यह एक नमूना पाठ है। यहाँ अपना विवरण लिखें।"],
        "script": ["Please enable JavaScript in your browser to see this page.", "Loading...\nIf nothing appears, check that scripts are allowed for this address.", "इस पृष्ठ को देखने के लिए जावास्क्रिप्ट चालू करें।"],
        None: [real, real + "The course teaches JavaScript for 6 weeks; no browser needs to be enabled for it.", real + "The page about it was not found in the archive [1] (20% less) {1, 2, 3}.", "Notice\nThe office stays closed on Monday for the fair. Urgent matters go to room 3.", real + "Pupils compared real sentences with the lorem ipsum of a printer's sample and found 3 differences."],
    }
    rows, want = [], {}
    for kind, xs in bodies.items():
        for x in xs:
            i = len(rows)
            rows.append((i, "https://a.example/", f"https://a.example/{i}", f"Title {i}", f"Title {i}\n{x}\n{foot}"))
            if kind:
                want[i] = kind
    rows += [(800, "https://a.example", "https://a.example/800", "Welcome to ${city}", None), (801, None, None, None, None), (None, "s", "u", "{{x}}", "y"), (802, "https://a.example", "u", "t", " \n"), rows[0]]
    want[800] = "template"
    df = crawl(spark, rows)
    for limit in (0, 10**6):
        assert {r["page_id"]: r["defect"] for r in residue.residue_pages(df, broadcast_rows=limit).collect()} == want
    assert residue.without_residue(df).where("page_id is not null").count() == len(rows) - len(want) - 2
    assert residue.residue_pages(crawl(spark, [])).collect() == []


def test_residue_without_placeholder_or_word(spark):
    real = "The mill opens at seven and closes at nine. " * 4
    greet = "We thank our guest {{ first_name }} for the visit on {{ day }}"
    rows = [(i, f"https://s{i}.example", f"https://s{i}.example/", f"Title {i}", f"{x}\n{real}{chr(97 + i)}") for i, x in enumerate(["Dear {{ first_name }},"] * 3 + [greet] * 3)]
    want = dict.fromkeys(range(6), "template")
    for i, x in enumerate(["Dear first_name,", "Dear ,", "We thank our guest firstName for the visit on Monday", "Dear Rina,", "We thank our guest Rina for the visit on Monday"], 20):
        rows.append((i, "https://t.example", f"https://t.example/{i}", f"Title {i}", f"{x}\n{real}{i}"))
        if i < 23:
            want[i] = "template"
    # one body on four sites, without any suspicious word, and real ones that recur
    for i in range(4):
        rows.append((40 + i, f"https://e{i}.example", f"https://e{i}.example/x", f"Page {i}", "One more step\nRay 8\nThis page of the gate stays open for a short while and then sends you on to the place that you came from."))
        rows.append((50 + i, f"https://e{i}.example", f"https://e{i}.example/y", f"Page {i}", "One more story\nThe mill opens at seven and closes at nine."))
        want[40 + i] = "error"
    for limit in (0, 10**6):
        assert {r["page_id"]: r["defect"] for r in residue.residue_pages(crawl(spark, rows), broadcast_rows=limit).collect()} == want


def test_residue_repeated_on_its_site(spark):
    foot = "All fares include tax\nScan the code at the gate"
    notices = {"error": "404 Not Found\nThe requested address was not found on this server.", "script": "Please enable JavaScript in your browser to see this page.", "filler": "Lorem ipsum dolor sit amet"}
    rows, want = [], {}
    for k, (kind, x) in enumerate(notices.items()):
        for i in range(30):
            own = x if i < 3 else f"The mill of {chr(97 + i)}ora opens at seven and closes at nine, and nobody there remembers who built the small bridge next to it."
            rows.append((100 * k + i, f"https://n{k}.example", f"https://n{k}.example/{i}", f"Page {chr(97 + i)}", f"{own}\n{foot}"))
            if i < 3:
                want[100 * k + i] = kind
    # a notice in the footer of a site of real pages is no case
    rows += [(900 + i, "https://r.example", f"https://r.example/{i}", f"Page {chr(97 + i)}", f"{rows[10 + i][4]}\nPlease enable JavaScript in your browser to see this page.") for i in range(10)]
    assert {r["page_id"]: r["defect"] for r in residue.residue_pages(crawl(spark, rows)).collect()} == want


PAGES = "upload_id bigint, pages array<struct<n:int,text:string,engine:string,review:boolean,reason:string,image:string>>, id string, kind string"


def uploads(spark, rows):
    return spark.createDataFrame([(i, None if ps is None else [(n, t, "e", False, "", "") for n, t in ps], "x", "y") for i, ps in rows], PAGES)


def test_scan_noise_and_repair(spark):
    words = "the ferry leaves every morning from eastern pier and comes back with two people before night".split()
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(words) for _ in range(8))
    rows, want = [], set()
    for u in range(12):
        pages = []
        for n in range(1, 5):
            body = [line() for _ in range(10)]
            lines = [f"A rare day in Roli {n + 6}", *body, "", f"- {n + 6} -"]
            want |= {(u, n, 1, "header"), (u, n, 13, "page_number")}
            if u == 0:
                lines[3], lines[4] = "it was a mor-", "ning of the two-"
                lines[5] = "and three-day passes " + lines[5]
                lines[6], lines[7] = "they went bef­", "ore noon"
                want |= {(u, n, 4, "hyphen"), (u, n, 7, "hyphen")}
            if u == 1 and n == 2:
                lines[5] = "cornes back with rnorning people"
                want.add((u, n, 6, "misread"))
            if u in (2, 3, 4) and n == 1:
                lines[6] = ["frorn the pier", "rnorning came", "the ea5tern pier"][u - 2]
                if u < 4:
                    want.add((u, n, 7, "misread"))
            pages.append((n, "\n".join(lines)))
        rng.shuffle(pages)
        rows.append((u, pages))
    rows += [(50, None), (51, []), (52, [(1, None), (None, "x")]), (None, [(1, "x")]), rows[3]]
    got = {(r["upload_id"], r["page_n"], r["line_no"], r["noise"]) for r in scans.noisy_lines(uploads(spark, rows)).collect()}
    assert got == {(r["upload_id"], r["page_n"], r["line_no"], r["noise"]) for r in scans.noisy_lines(uploads(spark, rows), broadcast_rows=0).collect()}
    assert {x for x in got if x[3] != "misread"} == {x for x in want if x[3] != "misread"}
    text = {r["upload_id"]: r["text"] for r in scans.repaired(uploads(spark, rows[:2])).where("para_no = 1").collect()}
    assert "a morning of the two- and three-day passes" in text[0] and "went before noon" in text[0]
    assert "Roli" not in text[0] and "- 8 -" not in text[1]
    assert scans.noisy_lines(uploads(spark, [])).collect() == []


def test_confusions_and_anagram_join(spark):
    base = [(w, "", 200) for w in ("corner", "summer", "hammer", "common", "memory", "modern", "simple", "camera")]
    rare = [(w.replace("m", "rn", 1), "", 1) for w, _, _ in base if "m" in w]
    vocabulary = spark.createDataFrame(base + rare + [("zebra", "", 1)], "w string, g string, n bigint")
    pairs = scans.confusions(vocabulary)
    assert ("m", "rn") in {(r["right"], r["wrong"]) for r in pairs.collect()}
    got = {r["w"]: r["better"] for r in scans.misread_words(vocabulary, pairs).collect()}
    assert got == {w.replace("m", "rn", 1): w for w, _, _ in base if "m" in w}


def test_structure_of_pages():
    kinds = lambda pages: [k for _, _, k in scans.structure(pages)]
    assert kinds([(1, "Head\n\nbody one of it\n\n1"), (2, "Head\n\nbody two of it\n\n2")]) == [{0: "header", 4: "page_number"}, {0: "header", 4: "page_number"}]
    assert kinds([(1, "xi\nbody one two"), (2, "xii\nbody three four")]) == [{0: "page_number"}, {0: "page_number"}]
    assert kinds([(1, "it costs only\n353"), (2, "and then\n17"), (3, "more of it\n3"), (4, "more of that\n4")])[0] == {}
    assert kinds([(1, "")]) == [{}]
