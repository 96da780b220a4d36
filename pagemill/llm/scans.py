"""Noise in text from scanned pages (problem 5): running headers, page numbers, broken and misread words, and their repair.

Lines. The pages of a document are read in the order of their numbers. A line at the edge of a page is a running header when
its letters come back at the edges of other pages (one wrong letter allowed), or when it is framed by the page's number; it is
a page number when it holds nothing else and the numbers of the document's pages agree in how far they are from the page's
place. Documents of one page borrow the shapes of the headers of all others.

Words. All words of body lines are counted. A rare word is joined with a frequent one by anagram hashes, in SQL: the hash of a
word is the sum of a value for each of its letters, so that a confusion of letters (``rn`` for ``m``) changes it by the same
difference in every word. The confusions come from the corpus: a replacement of one short span that turns many different rare
words into frequent ones. Rare hash minus a difference is an equi-join key with the frequent hashes; the letters are compared
after that. Corrections are ranked by how often the better word occurs.

Hyphens. A word broken by a soft hyphen or its likes at the end of a line is broken; with a real hyphen the corpus decides:
the joined word must be more frequent than the hyphenated one, or neither piece be a word of its own.

Cost: the documents are read twice, once for the shapes of headers and once for the structured lines with their words, which are
written; all else runs on these in the JVM. Words are counted with partial aggregation; what is joined is the vocabulary. The table of
misread words goes to the tasks below ``broadcast_rows`` rows; beyond, all words meet it in a shuffled join.

Definitions: a running header has at most 160 characters, a line with a page number at most 200, and both stand among the first or
last two lines of a page. Words of over 60 letters are counted, but only judged by the signs in them.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .boilerplate import TITLE_WORD, title_shape

# What a page number may stand in, and roman numerals.
_NUM = r"(?:[0-9]{1,4}|[০-৯]{1,4}|[०-९]{1,4}|(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})|(?=[IVXLC])(?:C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))"
PAGE_NUMBER = re.compile(rf"^[\[({{<\-–—_.•·~|*=\s]*(?:(?:p|pg|page|pp|folio|no|पृष्ठ|पृ|পৃষ্ঠা|পৃ)[.:]?\s*)?({_NUM})(?:\s*(?:of|/|out of|में से|ৰ)\s*({_NUM}))?[\])}}>\-–—_.•·~|*=\s]*$", re.I)
_DECORATED = re.compile(r"[\[({<\-–—_•·~|*=]|^\s*(?:p|pg|page|pp|पृष्ठ|पृ|পৃষ্ঠা|পৃ)\b|\b(?:of|/)\b", re.I)
FRAMED = re.compile(rf"^(?:({_NUM})\s*(?:\s{{2,}}|[|·•–—-]|\.{{2,}})\s*(\S.*?)|(\S.*?)\s*(?:\s{{2,}}|\s[|·•–—-]\s|\s*\.{{2,}}\s*|\s)({_NUM}))$")
# Letters joined by print, which no text has of its own.
LIGATURE = r"[\x{fb00}-\x{fb06}]"
_not_letters = regex.compile(r"[^\p{L}\p{M}]+").sub
_SOFT = "¬­‐‑"
BROKEN = re.compile(r"([^\s।,.;:!?\"'“”‘’()|\[\]]+?)([-¬­‐‑])\s*$")
_MARKS = frozenset("-" + _SOFT)
_TRIM = "।॥,.;:!?\"'“”‘’()[]{}<>…–—-¬\u00ad‐‑*_=/\\"
# signs inside a word stay, as they may be misread letters
_PARTING = "।॥…–—"
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def number_of(text: str) -> int:
    x = text.lower()
    if x[0] in _ROMAN:
        v = [_ROMAN[c] for c in x]
        return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0]))
    return int(x)


def _key(line: str) -> str:
    return _not_letters("", line.lower())


def _near(a: str, b: str) -> bool:
    """Equal but for a few misread letters."""
    if a == b:
        return True
    if min(len(a), len(b)) < 6 or abs(len(a) - len(b)) > 3:
        return False
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.86


def edges(lines: list[str], depth: int = 2) -> list[int]:
    at = [i for i, x in enumerate(lines) if x.strip()]
    return sorted({*at[:depth], *at[-depth:]})


def structure(pages: list[tuple[int, str]], shapes: frozenset = frozenset(), known: frozenset = frozenset()) -> list[tuple[int, list[str], dict[int, str]]]:
    """(n, lines, {line index: header or page_number}) of each page, in order."""
    docs = [(n, (t or "").split("\n")) for n, t in pages]
    numbers: list[tuple[int, int, int, str, bool]] = []
    for k, (n, lines) in enumerate(docs):
        at = edges(lines)
        for i in at:
            m = PAGE_NUMBER.match(lines[i].strip()) if len(lines[i]) <= 200 else None
            if m and m.group(1):
                numbers.append((k, i, number_of(m.group(1)) - n, "roman" if m.group(1)[0].isalpha() else "arabic", bool(_DECORATED.search(lines[i]))))
    offsets = Counter((o, s) for _, _, o, s, _ in numbers)
    best = offsets.most_common(1)[0] if offsets else None
    kinds: list[dict[int, str]] = [{} for _ in docs]
    for k, i, o, s, decorated in numbers:
        at = edges(docs[k][1])
        if decorated or offsets[(o, s)] > 1 or ((o, s) == best[0] and i in (at[0], at[-1])):
            kinds[k][i] = "page_number"
    keys: Counter = Counter()
    for k, (n, lines) in enumerate(docs):
        keys.update({_key(lines[i]) for i in edges(lines) if i not in kinds[k] and len(_key(lines[i])) >= 3 and len(lines[i]) <= 160})
    headers = [x for x, c in keys.most_common() if c >= 2]
    framed: list[tuple[int, int, int]] = []
    for k, (n, lines) in enumerate(docs):
        at = edges(lines)
        for i in at:
            if i in kinds[k]:
                continue
            x = _key(lines[i])
            if len(x) < 3:
                continue
            if x in headers or any(_near(x, h) for h in headers):
                kinds[k][i] = "header"
            elif i in (at[0], at[-1]) and len(lines[i]) <= 200:
                m = FRAMED.match(lines[i].strip())
                plain = lines[i].strip()
                if m and (m.group(1) or m.group(4)):
                    plain = (m.group(2) or m.group(3)).strip(" .|·•–—-")
                    if title_shape(plain, known) in shapes:
                        framed.append((k, i, number_of(m.group(1) or m.group(4)) - n))
                elif len(docs) == 1 and title_shape(plain, known) in shapes and plain[-1] not in ".।!?,;-¬­‐" and len(plain) < 80:
                    body = [len(v) for v in lines if v.strip()]
                    if len(body) > 3 and (i == at[-1] or not lines[i + 1].strip() or lines[i + 1].lstrip()[:1].isupper()) and title_words(plain, shapes, known):
                        kinds[k][i] = "header"
    for k, i, o in framed:
        kinds[k][i] = "header"
    return [(n, lines, kinds[k]) for k, (n, lines) in enumerate(docs)]


def title_words(line: str, shapes: frozenset, known: frozenset) -> bool:
    """Whether a line has a frequent title word, or three to six words of an Indic script."""
    ws = line.lower().split()
    return any(w in known for w in ws) or (3 <= len(ws) <= 6 and line[:1] > "ɐ")


def broken(line: str):
    """The match of a hyphen at the end of a line; a word has at most 200 letters here."""
    x = line.rstrip()
    return BROKEN.search(x[-200:]) if x[-1:] in _MARKS else None


def tokens(line: str) -> list[str]:
    return [w for x in _parted(line.lower()) if (w := x.strip(_TRIM)) and w != "|"]


def _parted(line: str) -> list[str]:
    for c in _PARTING:
        if c in line:
            line = line.replace(c, " ")
    return line.split()


def group_of(text: str) -> str:
    """as or bn for a text in their script, else nothing: both spell some words alike but for one letter."""
    a, b = text.count("ৰ") + text.count("ৱ"), text.count("র")
    return "" if not a and not b else "as" if a >= b else "bn"


def body(doc: list[tuple[int, list[str], dict[int, str]]]):
    """(page, line index, text) of the body lines in reading order."""
    for n, lines, kinds in doc:
        for i, x in enumerate(lines):
            if x.strip() and i not in kinds:
                yield n, i, x


def breaks(doc) -> list[tuple[int, int, str, str, str, str, str]]:
    """(page, line index, mark, joined, hyphenated, first piece, next piece) of the lines that end in a hyphen and go on."""
    rows, out = list(body(doc)), []
    for (n, i, x), (_, _, y) in zip(rows, rows[1:]):
        m = broken(x)
        if m and m.group(1)[-1].isalpha() | (m.group(1)[-1] > "ऀ"):
            nxt = _parted(y)[0].strip(_TRIM) if y.strip()[0] not in _PARTING else ""
            if nxt and (nxt[0].isalpha() or nxt[0] > "ऀ"):
                a, b = m.group(1).strip(_TRIM).lower(), nxt.lower()
                out.append((n, i, m.group(2), a + b, f"{a}-{b}", a, b))
    return out


def _documents(uploads: DataFrame, upload_id: str, pages: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """id and its pages as (n, text), in order, of each document once; pages without a number are left out. Only documents that were
    delivered more than once are shuffled."""
    p = F.filter(F.col(pages), lambda x: x["n"].isNotNull())
    p = F.array_sort(F.transform(p, lambda x: F.struct(x["n"].cast("int").alias("n"), F.coalesce(x["text"].cast("string"), F.lit("")).alias("text"))))
    x = uploads.select(F.col(upload_id).alias("id"), p.alias("pages")).where("id is not null and size(pages) > 0")
    again = materialize(uploads.groupBy(F.col(upload_id).alias("id")).count().where("count > 1 and id is not null").select("id"), "delivered-again")
    again = F.broadcast(again) if again.count() <= broadcast_rows else again
    return x.join(again, "id", "left_anti").unionByName(x.join(again, "id", "left_semi").dropDuplicates(["id"]))


def _headers(src: DataFrame) -> DataFrame:
    """id, a: the header lines that are found by repetition in a document alone."""
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, texts = [], []
            for i, ps in zip(b.column(0), b.column(1).to_pylist()):
                got = [lines[k] for _, lines, kinds in structure([(p["n"], p["text"]) for p in ps]) for k, v in kinds.items() if v == "header"]
                ids += [i.as_py()] * len(got)
                texts += got
            yield pa.record_batch([pa.array(ids, b.column(0).type), pa.array(texts, pa.string())], names=["id", "a"])

    return src.mapInArrow(run, f"id {kind}, a string")


_COLUMNS = ["page_n", "line_no", "kind", "g", "words", "a", "b", "c", "d"]


def _structured(src: DataFrame, shared) -> DataFrame:
    """One row for each line that is not blank: its kind (header, page_number, body), the group and the different words of a body line
    without the pieces of broken words; where its last word is broken, the mark (soft or break), joined, hyphenated and both pieces."""
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        shapes, known = shared.value
        for b in batches:
            out: list[tuple] = []
            for i, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc = structure([(p["n"], p["text"]) for p in ps], shapes, known)
                g = group_of("".join(p["text"] for p in ps))
                out += [(i, n, k + 1, v, g, None, None, None, None, None) for n, _, kinds in doc for k, v in kinds.items()]
                cuts = {(n, k): ("soft" if mark in _SOFT else "break", j, h, f, nx) for n, k, mark, j, h, f, nx in breaks(doc)}
                for n, k, ws in _words(doc):
                    mark, *pieces = cuts.get((n, k - 1), ("body", None, None, None, None))
                    out.append((i, n, k, mark, g, ws, *pieces))
            cols = list(zip(*out)) if out else [[]] * 10
            types = [b.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["id", *_COLUMNS])

    return src.mapInArrow(run, f"id {kind}, page_n int, line_no int, kind string, g string, words array<string>, a string, b string, c string, d string")


def _words(doc):
    """(page, line number, different words) of the body lines of a document, without the pieces of words broken at line ends."""
    rows, tail = list(body(doc)), False
    for at, (n, k, x) in enumerate(rows):
        cut = at + 1 < len(rows) and broken(x) is not None
        ws = tokens(x)
        ws = ws[1:] if tail else ws
        ws = ws[:-1] if cut else ws
        tail = cut
        yield n, k + 1, [w for w in dict.fromkeys(ws) if len(w) >= 2 and not w.isdigit()]


def _shapes(src: DataFrame) -> tuple[frozenset, frozenset]:
    """Shapes of the headers found by repetition, and the frequent words in them. A shape needs 1 in 500 headers, so there are at most
    500; a word 1 in 50, so there are at most 50 times a header's words."""
    heads = _headers(src.where("size(pages) > 1"))
    text = F.trim(F.regexp_replace("a", r"[\p{Nd}|·•–—\[\]]+|\.{2,}|^[ivxlc]+\s{2,}|\s[ivxlc]+$", " "))
    heads = materialize(heads.select("id", F.lower(text).alias("t")).distinct(), "headers")
    ws = F.regexp_extract_all("t", F.lit(TITLE_WORD), F.lit(0))
    n = heads.count()
    known = frozenset(r["w"] for r in heads.select(F.explode(F.array_distinct(ws)).alias("w")).groupBy("w").count().where(F.col("count") >= max(3, 0.02 * n)).collect())
    kept = F.array(*[F.lit(w) for w in sorted(known)]) if known else F.array().cast("array<string>")
    shape = F.array_join(F.transform(ws, lambda w: F.when(F.array_contains(kept, w), w).when(w < "ɐ", "L").otherwise("I")), " ")
    counts = heads.select(shape.alias("s")).where("s <> ''").groupBy("s").count()
    return frozenset(r["s"] for r in counts.where(F.col("count") >= max(2, 0.002 * n)).collect()), known


def anagram_hash(word):
    """Sum over the letters of 53 random bits each: equal for all orders of the same letters, and additive."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda s, ch: s + F.when(ch == "", F.lit(0)).otherwise(F.shiftright(F.abs(F.shiftright(F.xxhash64(ch), 1)), 9)))


def confusions(vocabulary: DataFrame, *, ratio: float = 10.0, least_words: int = 4, share: float = 0.0002) -> DataFrame:
    """right, wrong: replacements of one span of at most three letters that turn at least ``least_words`` different rare words, and
    ``share`` of all such turns, into words ``ratio`` times as frequent; by the share there are at most 5000."""
    v = vocabulary.where("length(w) between 3 and 60")
    spans = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.transform(F.sequence(F.lit(0), F.greatest(F.length("w") - k, F.lit(0))), lambda i: F.struct(i.alias("at"), k.alias("k")))))
    e = v.select("w", "g", "n", F.explode(spans).alias("p")).select("w", "g", "n", F.expr("substring(w, p.at + 1, p.k)").alias("span"), F.expr("concat(substring(w, 1, p.at), '\\u0000', substring(w, p.at + p.k + 1))").alias("frame"), F.length("w").alias("len"))
    e = e.where("length(frame) > 2")
    common = e.groupBy("frame", "g").agg(F.max(F.struct("n", "span", "w")).alias("best"))
    x = e.join(common, ["frame", "g"]).where((F.col("best.w") != F.col("w")) & (F.col("best.n") >= ratio * F.col("n")))
    x = x.select("w", F.col("best.span").alias("right"), F.col("span").alias("wrong")).where("right <> wrong")
    # spans without what they have in common at their ends, or a letter that got signs which no letter has of its own
    grown = F.startswith("wrong", "right") & F.expr("substring(wrong, length(right) + 1)").rlike(r"^[\p{M}]*[\x{09bc}\x{093c}]$|^[^\p{L}\p{M}\p{N}]+$")
    bare = (F.left("right", F.lit(1)) != F.left("wrong", F.lit(1))) & (F.substring("right", -1, 1) != F.substring("wrong", -1, 1))
    x = x.where(bare | ((F.length("right") == 1) & grown))
    x = materialize(x.distinct().groupBy("right", "wrong").agg(F.count("*").alias("words")), "turns")
    total = x.agg(F.sum("words")).first()[0] or 0
    x = x.where(F.col("words") >= max(least_words, share * total))
    x = x.where(~F.col("right").rlike(r"^\p{Nd}+$") & ~(F.col("right").rlike(r"\p{Nd}") & F.col("wrong").rlike(r"\p{Nd}")))
    return x


def misread_words(vocabulary: DataFrame, pairs: DataFrame, *, ratio: float = 10.0, least: int = 5) -> DataFrame:
    """w, g, better: each rare word with the most frequent word that it is with one confusion undone.

    The spans of a word meet the confusions, and the join is on anagram hashes: h(w) - h(wrong) + h(right) = h(better). ``pairs`` is
    small (see ``confusions``).
    """
    v = vocabulary.where("length(w) between 2 and 60").withColumn("h", anagram_hash(F.col("w")))
    d = pairs.select("right", "wrong", (anagram_hash(F.col("right")) - anagram_hash(F.col("wrong"))).alias("d"))
    n = F.length("w")
    spans = F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring("w", i, k))).otherwise(F.array().cast("array<string>")))))
    rare = v.select("w", "g", "n", "h", F.explode(spans).alias("wrong")).join(F.broadcast(d), "wrong")  # at most 5000 confusions
    rare = rare.where((F.length("w") > 2) | F.col("wrong").rlike(r"^[^\p{L}\p{M}]+$")).select("w", "g", "n", "right", "wrong", (F.col("h") + F.col("d")).alias("h"))
    good = v.select(F.col("w").alias("better"), "g", F.col("n").alias("m"), "h")
    x = rare.join(good, ["h", "g"]).where((F.col("m") >= least) & (F.col("m") >= ratio * F.col("n")))
    undone = F.exists(F.sequence(F.lit(1), F.length("w")), lambda i: F.col("w").substr(i, F.length("wrong")).eqNullSafe(F.col("wrong")) & (F.concat(F.col("w").substr(F.lit(1), i - 1), F.col("right"), F.col("w").substr(i + F.length("wrong"), F.length("w"))) == F.col("better")))
    x = x.where(undone | (F.replace("w", "wrong", "right") == F.col("better")))
    return x.groupBy("w", "g").agg(F.max(F.struct("m", "better")).alias("b")).select("w", "g", F.col("b.better").alias("better"))


def noise(uploads: DataFrame, *, upload_id: str = "upload_id", pages: str = "pages", broadcast_rows: int = 500_000) -> DataFrame:
    """upload_id, page_n, line_no, noise, wrong, better: every noisy line with its kind; misread lines once for each wrong word.

    noise is header, page_number, hyphen or misread; page_n is the page's number, line_no counts from 1 at each line feed.
    Null ids, null or empty ``pages``, pages without a number and null or blank texts give no row; pages may come in any order;
    a document delivered twice counts once. Pages are taken whole. Other columns are ignored.
    """
    src = _documents(uploads, upload_id, pages)
    spark = uploads.sparkSession
    shared = spark.sparkContext.broadcast(_shapes(src))
    lines = materialize(_structured(src, shared), "scan-lines")
    words = lines.select("id", "page_n", "line_no", "g", F.explode("words").alias("wrong"))
    vocabulary = materialize(words.groupBy(F.col("wrong").alias("w"), "g").agg(F.count("*").alias("n")), "vocabulary")
    pairs = materialize(confusions(vocabulary), "confusions")
    wrong = materialize(misread_words(vocabulary, pairs), "misread")
    # a word with a sign that only misreading puts into words has no need of a frequent neighbour
    signs = [r["wrong"] for r in pairs.where(r"wrong rlike '^[^\\p{L}\\p{M}]$'").select("wrong").distinct().collect()]
    fresh = vocabulary.join(wrong, ["w", "g"], "left_anti")
    odd = F.col("w").rlike(LIGATURE)
    if signs:
        cls = "[" + "".join("\\" + s if not s.isalnum() else s for s in sorted(signs)) + "]"
        odd |= F.col("w").rlike(r"\p{L}{2}") & F.col("w").rlike(rf"\p{{L}}{cls}|{cls}\p{{L}}") & ~F.col("w").rlike(r"^\p{Nd}+\p{L}{1,3}$") & ~F.col("w").rlike(rf"[^\p{{L}}\p{{M}}\p{{Nd}}'{cls[1:-1]}-]")
    wrong = materialize(wrong.unionByName(fresh.where(odd).select("w", "g", F.lit(None).cast("string").alias("better"))), "misread-all").withColumnRenamed("w", "wrong")
    misread = words.join(F.broadcast(wrong) if wrong.count() <= broadcast_rows else wrong, ["wrong", "g"]).select("id", "page_n", "line_no", F.lit("misread").alias("noise"), "wrong", "better")
    cases = lines.where("kind in ('break', 'soft')").select("id", "page_n", "line_no", "kind", "g", "a", "b", "c", "d")
    roles = cases.where("kind = 'break'").select("id", "page_n", "line_no", "g", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), F.array("a", "b", "c", "d"))).alias("role", "w"))
    seen = roles.join(vocabulary, ["w", "g"], "left").groupBy("id", "page_n", "line_no").agg(*[F.max(F.when(F.col("role") == r, F.coalesce("n", F.lit(0)))).alias(f"n{r}") for r in "abcd"])
    real = (F.col("na") > F.col("nb")) | ((F.col("na") == 0) & (F.col("nb") == 0) & ~((F.col("nc") > 0) & (F.col("nd") > 0)))
    # where neither form is known, a piece that is a word of its own hangs on to a hyphen of its own
    broken = cases.join(seen, ["id", "page_n", "line_no"], "left").where((F.col("kind") == "soft") | real)
    out = lines.where("kind in ('header', 'page_number')").select("id", "page_n", "line_no", F.col("kind").alias("noise"), F.lit(None).cast("string").alias("wrong"), F.lit(None).cast("string").alias("better"))
    out = out.unionByName(broken.select("id", "page_n", "line_no", F.lit("hyphen").alias("noise"), F.lit(None).cast("string").alias("wrong"), F.col("a").alias("better"))).unionByName(misread)
    return out.withColumnRenamed("id", upload_id)


def noisy_lines(uploads: DataFrame, **kw) -> DataFrame:
    """upload_id, page_n, line_no, noise: each once."""
    return noise(uploads, **kw).select(kw.get("upload_id", "upload_id"), "page_n", "line_no", "noise").distinct()


def repaired(uploads: DataFrame, *, upload_id: str = "upload_id", pages: str = "pages") -> DataFrame:
    """upload_id, para_no, text: the continuous paragraphs of each document, without headers and page numbers, with broken words
    joined and misread words replaced by their best correction (in the letter case of the original).

    A paragraph ends at a blank line, or at the end of a page whose last sentence is complete. Documents without text have no row.
    """
    src = _documents(uploads, upload_id, pages)
    found = noise(uploads, upload_id=upload_id, pages=pages).groupBy(F.col(upload_id).alias("id")).agg(F.collect_list(F.struct("page_n", "line_no", "noise", "wrong", "better")).alias("found"))  # the lines of one document
    joined = src.join(found, "id", "left")
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, nos, texts = [], [], []
            for i, ps, found in zip(b.column("id").to_pylist(), b.column("pages").to_pylist(), b.column("found").to_pylist()):
                for k, t in enumerate(assemble([(p["n"], p["text"]) for p in ps], found or []), 1):
                    ids.append(i)
                    nos.append(k)
                    texts.append(t)
            yield pa.record_batch([pa.array(ids, b.column("id").type), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=["id", "para_no", "text"])

    return joined.select("id", "pages", "found").mapInArrow(run, f"id {kind}, para_no int, text string").withColumnRenamed("id", upload_id)


def assemble(pages: list[tuple[int, str]], found: list[dict]) -> list[str]:
    gone = {(f["page_n"], f["line_no"]) for f in found if f["noise"] in ("header", "page_number")}
    hyphen = {(f["page_n"], f["line_no"]) for f in found if f["noise"] == "hyphen"}
    better: dict[tuple[int, int], dict[str, str]] = {}
    for f in found:
        if f["noise"] == "misread" and f["better"]:
            better.setdefault((f["page_n"], f["line_no"]), {})[f["wrong"]] = f["better"]
    out, now, glue = [], "", False
    for n, text in pages:
        for k, line in enumerate(text.split("\n"), 1):
            if (n, k) in gone:
                continue
            x = re.sub(r"\s+", " ", line).strip()
            if not x:
                if now and not glue and now[-1] in ".।!?\"”’)":
                    out.append(now)
                    now = ""
                continue
            for wrong, right in better.get((n, k), {}).items():
                x = re.sub(re.escape(wrong), lambda m: right.capitalize() if m.group()[:1].isupper() else right, x, flags=re.I)
            if (n, k) in hyphen:
                x = x[:-200] + BROKEN.sub(r"\1", x[-200:])
            now = now + x if glue or not now else now + " " + x
            glue = (n, k) in hyphen
    if now:
        out.append(now)
    return out
