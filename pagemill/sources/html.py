"""Content of HTML pages by the standard library's parser, over Arrow batches: title, description, canonical, links, text.

A broken page never fails a batch: what could be read before the error counts.
"""

from __future__ import annotations

import json
import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and classes without content, containers of it, extensions of documents, keys of data that hold no text.
JUNK_TAGS = ("script", "style", "noscript", "svg", "header", "footer", "nav", "aside", "form", "iframe")
JUNK_CLASSES = frozenset("sidebar widget comments blog-pager feed-links popular-posts".split())
CONTAINERS = (("class", "post-body"), ("class", "entry-content"), ("tag", "article"), ("tag", "main"), ("role", "main"), ("id", "main"), ("id", "content"))
DOCUMENTS = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".zip", ".rar", ".7z", ".csv", ".odt", ".ods", ".rtf")
DATA_KEYS = (
    "url", "href", "src", "slug", "id", "uid", "uuid", "image", "img", "icon", "className", "class", "locale", "locales", "buildId",
    "path", "pathname", "query", "alt", "type", "key", "ref", "canonical", "sitemap", "favicon",
)
DOCUMENT_TEXT = "Download Document"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text no reader sees.
UNSEEN = ("template",)
MIN_CONTAINER, THIN_WORDS, DATA_WORDS = 60, 60, 40
_WORD = re.compile(r"\w+")


class Page(HTMLParser):
    """One pass that collects texts with the junk and containers they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.has_title, self.h1, self.description, self.og_title, self.og_description, self.canonical = "", False, "", "", "", "", ""
        self.links: list[list[str]] = []
        self.texts: list[tuple[str, frozenset, bool]] = []
        self.data = ""
        self._open: list[tuple[str, bool, frozenset]] = []
        self._in, self._link = "", None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name, content = (a.get("name") or a.get("property") or "").lower(), a.get("content", "").strip()
            if name == "description":
                self.description = self.description or content
            elif name == "og:title":
                self.og_title = self.og_title or content
            elif name == "og:description":
                self.og_description = self.og_description or content
        if tag == "link" and a.get("rel", "").lower() == "canonical":
            self.canonical = self.canonical or a.get("href", "").strip()
        if tag == "a":
            self._link = [a.get("href", ""), ""]
            self.links.append(self._link)
        if tag in VOID:
            return
        self.has_title = self.has_title or tag == "title"
        classes = set(a.get("class", "").split())
        here = {i for i, (kind, v) in enumerate(CONTAINERS) if (kind == "tag" and tag == v) or (kind == "class" and v in classes) or a.get(kind) == v}
        junk = tag in JUNK_TAGS or tag in UNSEEN or bool(classes & JUNK_CLASSES) or "sidebar" in a.get("id", "")
        up = self._open[-1] if self._open else ("", False, frozenset())
        self._open.append((tag, up[1] or junk, up[2] | here))
        self._in = "data" if tag == "script" and a.get("id") == "__NEXT_DATA__" else tag

    def handle_endtag(self, tag):
        if tag == "a":
            self._link = None
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                del self._open[k:]
                break
        self._in = self._open[-1][0] if self._open else ""

    def handle_data(self, data):
        if self._in == "data":
            self.data += data
            return
        t = data.strip()
        if not t:
            return
        if self._in == "title":
            self.title = self.title or t
            return
        if self._in == "h1":
            self.h1 += t
        if self._link is not None:
            self._link[1] = (self._link[1] + " " + t).strip()
        _, junk, containers = self._open[-1] if self._open else ("", False, frozenset())
        if not junk and self._in not in ("script", "style"):
            self.texts.append((t, containers, junk))

    def text(self) -> str:
        """The first container with more than 60 characters, else the whole page; every text node is a paragraph."""
        lines = lambda keep: "\n\n".join(x for t, c, _ in self.texts if keep(c) for x in (y.strip() for y in t.splitlines()) if x)
        for i in range(len(CONTAINERS)):
            body = lines(lambda c, i=i: i in c)
            if len(body) > MIN_CONTAINER:
                return body
        return lines(lambda c: True)


def data_text(raw: str) -> str:
    """Strings of a client-rendered page's data that read like text, in order, each once."""
    try:
        root = json.loads(raw).get("props", {}).get("pageProps", {})
    except (ValueError, AttributeError):
        return ""
    out: dict[str, None] = {}
    stack = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(v for k, v in reversed(x.items()) if k not in DATA_KEYS)
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, str):
            for t in map(str.strip, (unescape(re.sub(r"<[^>]*>", "\n", x)) if "<" in x else x).split("\n")):
                if len(t) >= 25 and sum(map(str.isalpha, t)) >= 0.5 * len(t) and not t.startswith(("http://", "https://", "/")):
                    out.setdefault(t)
    return "\n\n".join(out)


def parse(html: str | None, url: str | None) -> dict:
    """The parts of a page. Null and empty pages have empty parts; a title of blanks gives way to the url. Links are as they stand in the page (see ``resolved``)."""
    p = Page()
    try:
        p.feed(html or "")
        p.close()
    except Exception:  # what was read counts
        pass
    text = p.text()
    n = len(_WORD.findall(text))
    if n < THIN_WORDS and p.data:
        rendered = data_text(p.data)
        if len(_WORD.findall(rendered)) >= DATA_WORDS and len(rendered) > 1.5 * len(text):
            text, n = rendered, len(_WORD.findall(rendered))
    links = [(h.strip(), t) for h, t in p.links if h.strip() and not h.strip().startswith(("#", "javascript:", "mailto:", "tel:"))]
    is_doc = lambda h: h.lower().split("?")[0].endswith(DOCUMENTS)
    title = p.title if p.has_title else p.og_title or p.h1
    return {"title": title or (url or ""), "description": p.description or p.og_description, "canonical": p.canonical, "content": text, "word_count": n, "links": [x for x in links if not is_doc(x[0])], "documents": [(h, t or DOCUMENT_TEXT) for h, t in links if is_doc(h)]}


_LINK = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))
SCHEMA = "url string, title string, description string, canonical string, content string, word_count int, links array<struct<href:string,text:string>>, documents array<struct<href:string,text:string>>"


def resolved(links: DataFrame, base: str = "url", href: str = "href") -> DataFrame:
    """base, href and target: each link against the url of its page; null and unreadable links have a null target."""

    def one(b, h):
        try:
            return urljoin(b or "", h) if h is not None else None
        except ValueError:
            return None

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([one(x, h) for x, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())], names=["base", "href", "target"])

    return links.select(F.col(base).cast("string").alias("base"), F.col(href).cast("string").alias("href")).mapInArrow(run, "base string, href string, target string")


def parsed_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row a page with its title, description, canonical url, content, word count, links and document links, and how many there are."""

    def run(batches):
        for b in batches:
            rows = [parse(h, u) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            pairs = lambda k: pa.array([[{"href": h, "text": t} for h, t in r[k]] for r in rows], _LINK)
            yield pa.record_batch([b.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in ("title", "description", "canonical", "content")), pa.array([r["word_count"] for r in rows], pa.int32()), pairs("links"), pairs("documents")], names=["url", "title", "description", "canonical", "content", "word_count", "links", "documents"])

    x = pages.select(F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(run, SCHEMA)
    return x.withColumns({"link_count": F.size("links"), "document_count": F.size("documents")})
