"""Fragments of the SQL that checks the queries; only text, no engine code."""

from __future__ import annotations

from ..functions import text as T
from ..operators import cleaning as C


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def wc(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(T.WORD)}))"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(T.WS)}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + T.WS + '|' + T.WS + '$')}, '', 'g')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda zz: {norm('zz')}), lambda zz: zz <> '')"


def ui(x: str) -> str:
    pats = " OR ".join(f"regexp_matches(trim({x}), {q(p)})" for p in C.UI_PATTERNS)
    return f"(list_contains([{', '.join(q(v) for v in C.UI_LINES)}], trim(trim(lower({x})), {q(C.UI_TRIM)})) OR {pats})"


def block(x: str) -> str:
    head = f"lower(left(coalesce({x}, ''), {C.BLOCK_WINDOW}))"
    n = f"coalesce({wc(x)}, 0)"
    any_of = lambda ms: "(" + " OR ".join(f"contains({head}, {q(m)})" for m in ms) + ")"
    return f"(({n} < {C.SEARCH_WORDS} AND {any_of(C.SEARCH_BLOCK)}) OR ({n} < {C.OTHER_WORDS} AND {any_of(C.OTHER_BLOCK)}))"


def alternation(xs: str) -> str:
    return f"CASE WHEN len(list_filter({xs}, lambda v: v IS NOT NULL AND v <> '')) > 0 THEN array_to_string(list_transform(list_filter({xs}, lambda v: v IS NOT NULL AND v <> ''), lambda v: '(?:' || v || ')'), '|') ELSE '[^\\s\\S]' END"


PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(u: str, i: int) -> str:
    return f"regexp_extract(trim({u}), {q(PARTS)}, {i})"


def clean_host(u: str) -> str:
    return f"replace(lower({part(u, 2)}), 'www.', '')"


JUDGED = f"""
pg AS (SELECT DISTINCT ON (page_id) job_id job, page_id id, page_idx idx, seed_url, coalesce(url, '') url, title, content FROM crawl_pages ORDER BY page_id),
pr AS (SELECT domain, coalesce(enabled, false) e, coalesce(threshold, {C.THRESHOLD}) t, coalesce(top_lines, {C.TOP_LINES}) n, coalesce(junk_urls, []) j, coalesce(keep_pages, []) k,
        list_filter(coalesce(terms, []), lambda v: v IS NOT NULL AND v <> '') m FROM site_profiles),
pp AS (SELECT pg.*, pr.domain IS NOT NULL own, coalesce(e, true) p_on, coalesce(t, {C.THRESHOLD}) p_threshold, coalesce(n, 0) p_top,
        {alternation(f"CASE WHEN domain IS NULL THEN [{', '.join(q(v) for v in C.DEFAULT_JUNK)}] ELSE j END")} junk_re,
        {alternation(f"CASE WHEN domain IS NULL THEN [{', '.join(q(v) for v in C.DEFAULT_KEEP)}] ELSE k END")} keep_re, coalesce(m, []) p_terms,
        {lines('content')} AS ls FROM pg LEFT JOIN pr ON pr.domain = {clean_host('seed_url')}),
pj AS (SELECT *, regexp_matches(url, junk_re) junk, {block('content')} blk, md5(array_to_string(ls, ' ')) h FROM pp),
pf AS (SELECT *, first_value(CASE WHEN NOT junk AND NOT blk THEN id END IGNORE NULLS) OVER w fid, first_value(CASE WHEN NOT junk AND NOT blk THEN url END IGNORE NULLS) OVER w furl,
        count(*) OVER (PARTITION BY job, url) > 1 twice FROM pj WINDOW w AS (PARTITION BY job, h ORDER BY idx, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
jd AS (SELECT *, CASE WHEN junk THEN 'junk URL' WHEN blk THEN 'block page (not the real page)' WHEN len(ls) > 0 AND fid <> id THEN 'exact copy of ' || furl
        WHEN twice AND len(ls) > 0 THEN 'exact copy of ' || url END reason FROM pf)"""

BOILER = """
kp AS (SELECT job, count(*) kept, max(p_threshold) t FROM jd WHERE reason IS NULL GROUP BY 1),
ld AS (SELECT job, line, count(*) pages FROM (SELECT DISTINCT job, id, unnest(ls) line FROM jd WHERE reason IS NULL) GROUP BY 1, 2),
bl AS (SELECT job, line, pages, kept FROM ld JOIN kp USING (job) WHERE kept >= 10 AND pages >= greatest(3, ceil(t * kept)))"""

CLEANED = f"""
ex AS (SELECT jd.*, i AS pos, ls[i] AS line FROM jd, unnest(range(1, len(ls) + 1)) u(i) WHERE reason IS NULL),
fl AS (SELECT ex.job, ex.id, ex.idx, pos, ex.line, regexp_matches(url, keep_re) hub, bl.line IS NOT NULL OR {ui('ex.line')} bad,
        ex.line = {norm("coalesce(title, '')")} OR {wc('ex.line')} >= 40 OR regexp_matches(ex.line, {q(C.PROTECT)}) OR regexp_matches(ex.line, {q(C.DAY_LABEL)})
        OR (p_top > 0 AND {wc('ex.line')} >= 3 AND list_contains(ls[1:greatest(p_top, 1)], ex.line)) prot, {wc('ex.line')} n FROM ex LEFT JOIN bl ON bl.job = ex.job AND bl.line = ex.line),
rm AS (SELECT *, NOT hub AND bad AND NOT prot gone FROM fl),
kl AS (SELECT *, row_number() OVER (PARTITION BY id, line ORDER BY pos) r FROM rm WHERE NOT gone),
kk AS (SELECT * FROM kl WHERE hub OR n < 4 OR r = 1),
cl AS (SELECT jd.*, coalesce((SELECT string_agg(line, chr(10) || chr(10) ORDER BY pos) FROM kk WHERE kk.id = jd.id), '') AS clean FROM jd WHERE reason IS NULL),
tr AS (SELECT jd.job, ti, jd.p_terms[ti] term, bool_or(contains(lower(array_to_string(ls, chr(10))), lower(jd.p_terms[ti]))) b, bool_or(coalesce(contains(lower(clean), lower(jd.p_terms[ti])), false)) a
        FROM jd LEFT JOIN (SELECT id, clean FROM cl) c USING (id), unnest(range(1, len(jd.p_terms) + 1)) u(ti) GROUP BY 1, 2, 3),
lt AS (SELECT job, list(term ORDER BY ti) lost FROM tr WHERE b AND NOT a GROUP BY 1),
sm AS (SELECT jd.job, bool_and(p_on) p_on, bool_or(own) own, count(*) pages_in, count(*) FILTER (reason IS NULL) pages_out, sum({wc("array_to_string(ls, ' ')")}) wb,
        coalesce(sum({wc("array_to_string(ls, ' ')")}) FILTER (reason IS NULL), 0) wk, coalesce(sum({wc('clean')}), 0) wa FROM jd LEFT JOIN (SELECT id, clean FROM cl) c USING (id) GROUP BY 1),
su AS (SELECT sm.*, CASE WHEN NOT p_on THEN 'switched off' WHEN lost IS NOT NULL THEN 'must-keep phrases would be lost: ' || array_to_string(lost[1:10], ', ')
        WHEN wk > 0 AND wa < 0.40 * wk THEN 'would remove more than 60% of the words' END refused FROM sm LEFT JOIN lt USING (job))"""


def title_case(x: str) -> str:
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr({x}, i - 1, 1), '[\\p{{L}}\\p{{M}}]') THEN upper(substr({x}, i, 1)) ELSE substr({x}, i, 1) END), '')"


SEPS = [" | ", " - ", " – ", " — ", " :: ", " « ", " » "]
NAMED = f"""
n0 AS (SELECT DISTINCT ON (page_id) job_id job, page_id id, page_idx idx, url, trim(coalesce(title, '')) t, trim(coalesce(url, '')) u, content FROM crawl_pages ORDER BY page_id),
n1 AS (SELECT *, trim(url_decode({part('u', 3)}), '/') pa FROM n0),
n2 AS (SELECT *, lower(trim(regexp_replace(regexp_replace(string_split(pa, '/')[-1], '(?i)\\.(html?|php|aspx?)$', ''), '[-_]+', ' ', 'g'))) wd FROM n1),
n3 AS (SELECT *, CASE WHEN t <> '' AND t <> u AND NOT regexp_matches(t, '(?i)^https?://') THEN t WHEN pa = '' THEN 'Home' WHEN wd = '' THEN 'Untitled' ELSE {title_case('wd')} END AS name FROM n2),
s1 AS (SELECT job, idx, k, sep || trim(string_split(name, sep)[-1]) AS tail FROM n3, (VALUES {', '.join(f"({i}, {q(v)})" for i, v in enumerate(SEPS))}) v(k, sep) WHERE contains(name, sep)),
s2 AS (SELECT job, tail, count(*) c, min((idx, k)) f FROM s1 GROUP BY 1, 2), s3 AS (SELECT job, tail, c, row_number() OVER (PARTITION BY job ORDER BY c DESC, f) r FROM s2),
s4 AS (SELECT job, tail AS suffix FROM s3 JOIN (SELECT job, count(*) m FROM n3 GROUP BY 1) USING (job) WHERE r = 1 AND m >= 3 AND c >= 3 AND c >= 0.6 * m AND length(tail) > 3),
n4 AS (SELECT n3.*, suffix, CASE WHEN suffix IS NOT NULL AND ends_with(name, suffix) AND length(name) > length(suffix) THEN trim(left(name, length(name) - length(suffix))) ELSE name END short FROM n3 LEFT JOIN s4 USING (job)),
n5 AS (SELECT *, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda v: {strip('v')}), lambda v: v <> '' AND NOT {ui('v')}) l FROM n4),
n6 AS (SELECT *, coalesce(list_position(list_transform(l, lambda v: v <> name AND v <> short), true), len(l) + 1) AS st FROM n5),
nm AS (SELECT *, array_to_string(l[st:], chr(10) || chr(10)) AS text FROM n6)"""
