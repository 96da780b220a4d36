"""Queries of the training-data operators that this subpackage holds, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import boilerplate, broken_pairs, canonical, cutoff, encode, leaks, residue, scans, similar, site_lines


def p1_found(spark, d):
    return broken_pairs.broken_pairs(table(spark, d, "qa_pairs"))


def p2_found(spark, d):
    x = similar.similar_pairs(table(spark, d, "source_items"), id_col="item_id", text="content", run=3, likeness=0.6, min_words=20)
    return x.select(F.col("id_a").alias("item_id_a"), F.col("id_b").alias("item_id_b")).distinct()


def p2_groups(spark, d):
    return similar.similar_groups(table(spark, d, "source_items"), id_col="item_id", text="content", run=3, likeness=0.6, min_words=20).select(F.col("id").alias("item_id"), F.col("group").alias("group_id"), "links")


def p3_pages(spark, d):
    return boilerplate.main_content(table(spark, d, "raw_pages")).select("raw_id", F.md5("content").alias("content_md5"))


def p4_found(spark, d):
    x = canonical.canonical_members(table(spark, d, "import_records"), id_col="rec_id", url="url", content="content")
    return x.select(F.col("first").alias("first_rec_id"), F.col("id").alias("rec_id"))


def p4_records(spark, d):
    return canonical.one_each(table(spark, d, "import_records"), id_col="rec_id", url="url", content="content").select("rec_id", "copies")


def p3_found(spark, d):
    return boilerplate.boilerplate_lines(table(spark, d, "raw_pages"))


def p5_found(spark, d):
    return scans.noisy_lines(table(spark, d, "uploads"))


def p5_paragraphs(spark, d):
    return scans.repaired(table(spark, d, "uploads"))


def p6_found(spark, d):
    return residue.residue_pages(table(spark, d, "crawl_pages"))


def p10_found(spark, d):
    return cutoff.cut_documents(table(spark, d, "documents"))


def p10_sources(spark, d):
    return cutoff.cut_by_source(table(spark, d, "documents"))


def p6_kept(spark, d):
    return residue.without_residue(table(spark, d, "crawl_pages")).select("page_id").distinct()


def p7_found(spark, d):
    return site_lines.flagged_lines(table(spark, d, "crawl_pages")).select("page_id", "line_no")


def p7_pages(spark, d):
    return site_lines.without_lines(table(spark, d, "crawl_pages")).select("page_id", F.md5("content").alias("content_md5")).distinct()


def p8_ids(spark, d):
    return encode.encode_corpus(table(spark, d, "documents"))


def p9_found(spark, d):
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_spans(spark, d):
    return leaks.leak_spans(table(spark, d, "documents"), table(spark, d, "eval_items")).distinct()


QUERIES = {f.__name__: f for f in [p1_found, p2_found, p2_groups, p3_found, p3_pages, p4_found, p4_records, p5_found, p5_paragraphs, p6_found, p6_kept, p7_found, p7_pages, p8_ids, p9_found, p9_spans, p10_found, p10_sources]}

SQL = {
    "p2_found": r"""
WITH w AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(content), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda x: x <> '') w FROM source_items WHERE content IS NOT NULL),
s AS (SELECT DISTINCT item_id, concat_ws(chr(31), w[i], w[i + 1], w[i + 2]) g FROM w, unnest(range(1, len(w) - 1)) u(i) WHERE len(w) >= 20),
n AS (SELECT item_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.item_id a, b.item_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT a AS item_id_a, b AS item_id_b FROM p JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE k * 10 >= 6 * (x.n + y.n - k)""",
    "p4_found": r"""
WITH r AS (SELECT DISTINCT rec_id, url, content c, regexp_replace(content, '^[\s\p{Z}\p{Cf}]+', '') b FROM import_records
           WHERE rec_id IS NOT NULL AND url IS NOT NULL AND content IS NOT NULL AND regexp_replace(content, '[\s\p{Z}\p{Cf}\p{Cc}]+', '', 'g') <> ''),
j AS (SELECT rec_id, list_transform(json_keys(b), lambda k: regexp_replace(lower(k || coalesce(json_extract_string(b, '$."' || k || '"'), '')), '[^\p{L}\p{M}\p{N}]+', '', 'g')) f
      FROM r WHERE b LIKE '{%' AND json_valid(b)),
l AS (SELECT rec_id, list_filter(string_split_regex(c, '[\r\n\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}]+', '', 'g') <> '') f FROM r),
k AS (SELECT rec_id, regexp_replace(lower(split_part(url, '?', 1)), '[^\p{L}\p{M}\p{N}]+', '', 'g') || '?' ||
        CASE WHEN instr(url, '?') > 0 THEN array_to_string(list_sort(list_filter(list_transform(string_split(substr(url, instr(url, '?') + 1), '&'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}]+', '', 'g')), lambda x: x <> '')), '&') ELSE '' END u,
        CASE WHEN len(j.f) > 0 THEN array_to_string(list_sort(j.f), chr(30))
             WHEN len(l.f) > 1 AND len(list_filter(l.f, lambda x: NOT regexp_matches(x, '^[^:\n]{1,60}:'))) = 0
             THEN array_to_string(list_sort(list_transform(l.f, lambda x: regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}]+', '', 'g'))), chr(30))
             ELSE regexp_replace(lower(c), '[^\p{L}\p{M}\p{N}]+', '', 'g') END c
      FROM r JOIN l USING (rec_id) LEFT JOIN j USING (rec_id)),
f AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY u, c) first_rec_id FROM k)
SELECT first_rec_id, rec_id FROM f WHERE rec_id <> first_rec_id""",
    "p7_found": r"""
WITH p AS (SELECT DISTINCT page_id, regexp_replace(lower(seed_url), '/$', '') s, url, content FROM crawl_pages
           WHERE seed_url IS NOT NULL AND url IS NOT NULL AND content IS NOT NULL),
t AS (SELECT regexp_replace(lower(seed_url), '/$', '') s, count(DISTINCT url) n FROM crawl_pages WHERE seed_url IS NOT NULL AND url IS NOT NULL GROUP BY 1),
l AS (SELECT page_id, s, url, CAST(i AS INTEGER) line_no, regexp_replace(lower(string_split(content, chr(10))[i]), '[^\p{L}\p{M}]+', '', 'g') k
      FROM p, unnest(range(1, len(string_split(content, chr(10))) + 1)) u(i)),
c AS (SELECT s, k, count(DISTINCT url) m FROM l WHERE regexp_matches(k, '\p{L}') GROUP BY 1, 2)
SELECT DISTINCT page_id, line_no FROM l JOIN c USING (s, k) JOIN t USING (s) WHERE n >= 10 AND m >= 5 AND m * 5 >= n""",
    "p9_found": r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') r FROM d, unnest(range(1, greatest(len(w) - 10, 1))) u(i)),
er AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') r FROM e, unnest(range(1, greatest(len(w) - 10, 1))) u(i))
SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (r)""",
}
SQL["p4_records"] = SQL["p4_found"].replace("SELECT first_rec_id, rec_id FROM f WHERE rec_id <> first_rec_id", "SELECT i.rec_id, coalesce(n, 1) copies FROM import_records i LEFT JOIN (SELECT first_rec_id, count(*) n FROM f GROUP BY 1) g ON g.first_rec_id = i.rec_id WHERE i.rec_id NOT IN (SELECT rec_id FROM f WHERE rec_id <> first_rec_id)")
_SIM = SQL["p2_found"]
SQL["p2_groups"] = (
    "WITH RECURSIVE "
    + _SIM[_SIM.index("w AS (") : _SIM.index("s AS (")]
    + """k AS (SELECT item_id, w, min(item_id) OVER (PARTITION BY array_to_string(w, ' ')) rep FROM w WHERE len(w) >= 20),
s AS (SELECT DISTINCT item_id, concat_ws(chr(31), w[i], w[i + 1], w[i + 2]) g FROM k, unnest(range(1, len(w) - 1)) u(i) WHERE item_id = rep),
n AS (SELECT item_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.item_id a, b.item_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.item_id <> b.item_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE k * 10 >= 6 * (x.n + y.n - k)),
r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x, min(y) g FROM r GROUP BY 1), l AS (SELECT a, count(*) links FROM e GROUP BY 1)
SELECT item_id, coalesce(g, rep) group_id, coalesce(links, 0) links FROM (SELECT DISTINCT item_id, rep FROM k) k LEFT JOIN c ON c.x = rep LEFT JOIN l ON l.a = rep"""
)

_SITE_LINES = SQL["p7_found"]
SQL["p7_pages"] = (
    _SITE_LINES[: _SITE_LINES.rindex("SELECT DISTINCT page_id, line_no")].rstrip()
    + """,
g AS (SELECT DISTINCT page_id, line_no FROM l JOIN c USING (s, k) JOIN t USING (s) WHERE n >= 10 AND m >= 5 AND m * 5 >= n),
a AS (SELECT DISTINCT page_id, content FROM crawl_pages),
v AS (SELECT page_id, CAST(i AS INTEGER) line_no, string_split(content, chr(10))[i] x FROM a, unnest(range(1, len(string_split(content, chr(10))) + 1)) u(i))
SELECT page_id, md5(CASE WHEN content IS NULL THEN NULL ELSE coalesce((SELECT string_agg(x, chr(10) ORDER BY v.line_no) FROM v WHERE v.page_id = a.page_id AND NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = v.page_id AND g.line_no = v.line_no)), '') END) content_md5 FROM a"""
)
