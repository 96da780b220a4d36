"""Documents that were uploaded and read page by page: tidying, quality of a text layer, agreement of two readings, running lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_WORDS, AGREE_MIN, LAYER_MIN, WEIRD_MAX, PICTURE_PIXELS = 5, 0.6, 40, 0.10, 150_000
# Characters beyond ASCII that a good text layer has.
GOOD = r"\x{a0}\x{a9}\x{ae}\x{b0}\x{b7}\x{2013}\x{2014}\x{2018}\x{2019}\x{201c}\x{201d}\x{2022}\x{2026}\x{20ac}\x{20b9}\x{2122}\x{0900}-\x{0dff}\x{0400}-\x{04ff}\x{0600}-\x{06ff}\x{200b}-\x{200f}\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}"
PAGE_NO = r"(?i)^[^\p{L}\p{N}]*(\p{Nd}{1,4}|[ivxlcdm]{1,7})[^\p{L}\p{N}]*$"
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}\x{200b}\x{feff}]"


def clean_text(c: Column) -> Column:
    """Control characters out, br tags and all line ends as line feeds, blanks collapsed, at most one blank line in a row."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), CONTROL, "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"), r"\r\n?", "\n")
    ls = F.transform(F.split(x, "\n"), lambda v: T.strip(F.regexp_replace(v, r"[ \t]+", " ")))
    return T.strip(F.regexp_replace(F.array_join(ls, "\n"), r"\n{3,}", "\n\n"))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(T.WORD), F.lit(0)))


def agreement(a: Column, b: Column) -> Column:
    """Share of the smaller word set that the other has too; 0 where one is empty."""
    x, y = word_set(a), word_set(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))


def layer_quality(c: Column) -> Column:
    """good, garbled or empty: under 40 characters is empty; over a tenth of strange characters, or 8 lines and more of which the
    upper median is at most 5 long, is garbled."""
    t = T.strip(F.coalesce(c, F.lit("")))
    solid = F.regexp_replace(t, T.WS, "")
    weird = F.length(F.regexp_replace(solid, rf"[\x{{00}}-\x{{7f}}{GOOD}]", ""))
    lens = F.array_sort(F.transform(T.lines(t), F.length))
    broken = (F.size(lens) >= 8) & (F.get(lens, F.floor(F.size(lens) / 2).cast("int")) <= 5)
    return F.when(F.length(t) < LAYER_MIN, "empty").when(weird > WEIRD_MAX * F.length(solid), "garbled").when(broken, "garbled").otherwise("good")


def judge(text: Column, engine: Column, cross: Column | None = None) -> Column:
    """struct(review, reason): whether someone should look at a page, and why."""
    n = F.size(word_set(text))
    no, out = lambda why: F.struct(F.lit(True).alias("review"), F.lit(why).alias("reason")), F.struct(F.lit(False).alias("review"), F.lit("").alias("reason"))
    x = F.when((n < MIN_WORDS) & engine.isin("gemini", "openai") & (T.strip(F.coalesce(text, F.lit(""))) == ""), out).when(n < MIN_WORDS, no("very little text"))
    x = x.when(engine == "tesseract", no("read by Tesseract only"))
    if cross is not None:
        x = x.when((F.size(word_set(cross)) >= MIN_WORDS) & (agreement(text, cross) < AGREE_MIN), no("the two readers disagree"))
    return x.otherwise(out)


def upload_pages(uploads: DataFrame) -> DataFrame:
    """upload_id, at (place in the document), n, text, engine, review of every page."""
    x = uploads.select("upload_id", F.posexplode("pages").alias("at", "p")).dropDuplicates(["upload_id", "at"])
    return x.select("upload_id", "at", "p.n", F.coalesce("p.text", F.lit("")).alias("text"), "p.engine", "p.review", "p.image")


def strip_repeated_lines(pages: DataFrame, *, doc: str = "upload_id", order: str = "at", text: str = "text", min_pages: int = 6) -> DataFrame:
    """doc, order, text, removed: pages without the lines (at most 120 characters, whatever their case) that stand on 40 % and at
    least 5 of a document's pages, and without a bare page number at their top or bottom; then tidied. Documents of fewer than
    ``min_pages`` pages with text are left as they are."""
    x = pages.select(F.col(doc).alias("doc"), F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    key = lambda v: F.lower(T.norm(v))
    short = F.array_distinct(F.transform(F.filter(F.split("t", "\n"), lambda v: (T.strip(v) != "") & (F.length(T.strip(v)) <= 120)), key))
    n = x.groupBy("doc").agg(F.count_if(T.strip(F.col("t")) != "").alias("full"))
    c = x.select("doc", F.explode(short).alias("k")).groupBy("doc", "k").agg(F.count("*").alias("c")).join(n, "doc").where((F.col("full") >= min_pages) & (F.col("c") >= F.greatest(F.lit(5), F.floor(0.4 * F.col("full")))))
    x = x.join(n, "doc").join(c.groupBy("doc").agg(F.collect_set("k").alias("gone")), "doc", "left")  # at most lines / 0.4 a document
    ls, gone = F.split("t", "\n"), F.coalesce("gone", F.array().cast("array<string>"))
    x = x.withColumn("keep", F.filter(ls, lambda v: (T.strip(v) == "") | ~F.array_contains(gone, key(v))))
    full = F.filter(F.transform("keep", lambda v, i: F.when(T.strip(v) != "", i)), lambda i: i.isNotNull())
    x = x.withColumn("a", F.get(full, F.lit(0))).withColumn("z", F.get(full, F.size(full) - 1))
    number = lambda v, i: ((i == F.col("a")) | (i == F.col("z"))) & (F.length(T.strip(v)) <= 12) & T.strip(v).rlike(PAGE_NO)
    x = x.withColumn("blanked", F.transform("keep", lambda v, i: F.when(number(v, i), "").otherwise(v)))
    removed = F.size(ls) - F.size("keep") + F.size(F.filter(F.transform("keep", number), lambda v: v))
    active = F.col("full") >= min_pages
    return x.select(F.col("doc").alias(doc), F.col("o").alias(order), F.when(active, clean_text(F.array_join("blanked", "\n"))).otherwise(F.col("t")).alias("text"), F.when(active, removed).otherwise(0).alias("removed"))


def upload_list(uploads: DataFrame) -> DataFrame:
    """One row an upload: pages, pages to review and the engines that read them."""
    p = F.coalesce("pages", F.array().cast(uploads.schema["pages"].dataType))
    engines = F.array_sort(F.array_distinct(F.filter(F.transform(p, lambda v: v["engine"]), lambda e: e.isNotNull() & (e != ""))))
    return uploads.dropDuplicates(["upload_id"]).select("upload_id", "file_name", "doc_kind", F.lower("status").alias("status"), "created_at", F.size(p).alias("pages"), F.size(F.filter(p, lambda v: F.coalesce(v["review"], F.lit(False)))).alias("review_pages"), F.array_join(engines, ",").alias("engines"))


def as_crawl_pages(pages: DataFrame, names: DataFrame, host: str = "uploads.invalid") -> DataFrame:
    """upload_id, url (host/id#pN), title (with the page's number where there is more than one), content, word_count; blank pages are left out."""
    n = pages.groupBy("upload_id").agg(F.count("*").alias("many"))
    x = pages.join(n, "upload_id").join(names.select("upload_id", "file_name").dropDuplicates(["upload_id"]), "upload_id").where(T.strip(F.col("text")) != "")
    title = F.concat(F.coalesce("file_name", F.lit("")), F.when(F.col("many") > 1, F.concat(F.lit(" - page "), F.col("n"))).otherwise(""))
    return x.select("upload_id", F.concat(F.lit(f"https://{host}/"), "upload_id", F.lit("#p"), F.col("n")).alias("url"), title.alias("title"), F.col("text").alias("content"), F.size(T.ws_words(F.col("text"))).alias("word_count"))


def kind_of_bytes(data: Column) -> Column:
    """pdf, png, jpeg, webp, heic, tiff or null by the first bytes."""
    h = F.hex(F.substring(data, 1, 16))
    return F.when(F.startswith(h, F.lit("25504446")), "pdf").when(F.startswith(h, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(h, F.lit("FFD8FF")), "jpeg").when(F.startswith(h, F.lit("52494646")) & (F.substring(h, 17, 8) == "57454250"), "webp").when(F.substring(h, 9, 8) == "66747970", "heic").when(F.startswith(h, F.lit("49492A00")) | F.startswith(h, F.lit("4D4D002A")), "tiff")


def picture_pixels(pictures: DataFrame) -> DataFrame:
    """doc, page, pixels, heavy: what the pictures of each page add up to, masks left out. ``pictures`` has doc, page, kind, width, height."""
    x = pictures.where("kind is null or kind <> 'smask'").groupBy("doc", "page").agg(F.sum(F.col("width").cast("bigint") * F.col("height")).alias("pixels"))
    return x.withColumn("heavy", F.col("pixels") >= PICTURE_PIXELS)


def valid_id(c: Column) -> Column:
    """Whether an upload's id is one; null is none."""
    return F.coalesce(c.rlike("^[a-f0-9]{12}$"), F.lit(False))


def valid_session(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-f0-9]{16}$"), F.lit(False))


def has_picture(pages: Column, name: Column) -> Column:
    """Whether one of the pages was read from the picture; null pages and names give false."""
    return F.coalesce(F.exists(pages, lambda p: p["image"] == name), F.lit(False))


def read_path(text: Column, engine: Column) -> Column:
    """How a page came to its text: blank, text_layer, garbled_layer (read from the picture as its layer was no text) or pictures."""
    layer = engine == "pdf-text"
    return F.when(T.strip(F.coalesce(text, F.lit(""))) == "", "blank").when(layer & (layer_quality(text) == "garbled"), "garbled_layer").when(layer, "text_layer").otherwise("pictures")
