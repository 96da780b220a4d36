"""Template residue, filler text, error pages and script notices (problem 6).

* Slots. Lines with a placeholder (``PLACEHOLDER``: the delimiters of template languages and form letters) are aligned: what
  stands before and behind each placeholder is the frame of a template's slot, and the names in the placeholders are the
  template's variables. Frames and variables are counted over all pages first; then all pages are judged against them, also
  those without any placeholder. A frame whose slot holds a bare variable, a default or nothing is residue as well. One
  unfilled slot in title or content is enough.
* Whole pages. The lines that the page's site repeats (``site_lines.excessive_lines``, at a lower threshold) and its own
  heading are taken off. What is left is compared with the notices of servers, programs, firewalls, checks and missing pages,
  with stand-in texts and with script notices, and with the lines that keep company with them on such pages all over the
  corpus (``companions``). A page is one of them when no content of its own is left.
  Levelled whole bodies are counted over urls and sites: those that recur are looked at too, whatever their words, and a short
  one that opens with a notice is a notice as a whole.

Cost: one scan that keeps the few pages with a suspicious word, one scan for the repeated lines of the sites (see
``site_lines``), one that hashes the whole bodies (four numbers a page are written), one for the learnt frames, and narrow joins
of what is left. Frames, variables and companions sent to the workers are at most 9000
strings, as each has a share of all.
"""

from __future__ import annotations

import re
from operator import eq
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import letters_key
from ..session import materialize
from .site_lines import excessive_lines, site_of

# The delimiters of placeholders.
PLACEHOLDER = "|".join(
    [
        r"\{\{\{?\s*[^{}\n]{1,40}\}\}\}?",
        r"\{%[^{}%\n]{1,40}%\}",
        r"\[%[^\[\]%\n]{1,40}%\]",
        r"[$#]\{[^{}\n]{1,40}\}",
        r"\{[$#@][A-Za-z][\w.]{1,30}\}",
        r"<[%?]=?[^<>%?\n]{1,40}[%?]>",
        r"\[\[[^\[\]\n\d][^\[\]\n]{0,40}\]\]",
        r"%[A-Z][A-Z_]{1,30}%",
        r"%\([a-z][a-z_.]{1,30}\)[sd]",
        r"__[A-Z][A-Z_]{1,30}__",
        r"@@[A-Z][A-Z_]{1,30}@@",
        r"\$[A-Z][A-Z_]{2,30}\$",
        r"\[[A-Z]{2,}(?:[_ ][A-Z]{2,}){0,4}\]",
        r"\{[A-Za-z]{3,}(?:[_.][A-Za-z]+){0,4}\}",
        r"<<\s*[A-Za-z][A-Za-z _.]{1,30}>>",
        r"<[a-z]{2,20}_[a-z_]{2,20}>",
        r"&lt;[a-z][a-z_. ]{1,30}&gt;",
        r"\[(?:[Yy]our|[Ii]nsert|[Ee]nter|[Aa]dd|[Tt]ype|[Pp]ut)\s[^\[\]\n]{1,40}\]",
        r"\[(?:First|Last|Full|Given|Family|Your|Company|Customer|Client|Recipient|Sender|User|Guest|Product|Event|Contact|Street|Phone|Email|Order|Account) (?:Name|Names|Address|Email|Number|Title|City|Date|Phone|Company|ID|Here)\]",
        r"\((?:enter|insert|your|type|add) [a-z ]{2,30}\)",
        r"\b(?:TODO|FIXME)\b\s*:?\s*(?:write|add|insert|fill)\b[ \t]?[a-z ]{0,20}",
        r"\[[^\[\]\n]{1,30}(?:लिखें|भरें|डालें|লিখক|লিখুন|ভৰাওক|দিয়ক)\]",
    ]
)
# What any placeholder has, a cheap look before the full pattern.
MARKS = list("{}[]<>%@$&_") + ["(enter ", "(insert ", "(your ", "(type ", "(add ", "todo", "fixme"]
# Beginnings of words, and whole words, that any error page, stand-in text or script notice has; they only choose the
# pages to look at.
BEGINNINGS = (
    ["javascript", "java script", "scripting", "noscript", "lorem", "dolor", "ipsum", "your heading", "goes here", "body text", "sample page", "sample text", "placeholder", "dummy", "short blurb", "caption text"]
    + ["coming soon", "added later", "this block", "about yourself", "description of your", "asdf", "qwerty", "xxxx", "under construction", "text to follow"]
    + ["not found", "forbidden", "bad gateway", "gateway time", "timeout", "time-out", "timed out", "expired", "unavailable", "denied", "refused", "too many requests", "suspended", "maintenance", "unusual traffic", "captcha", "traceback"]
    + ["exception", "failed to open", "does not exist", "could not find", "valid answer", "too long to respond", "invalid request", "undefined", "object object", "object moved", "been moved", "sign in again", "unexpected condition", "permission to"]
    + ["isn't working", "isn’t working", "is not working", "went wrong", "can't be reached", "can’t be reached", "cannot be reached", "be displayed"]
    + ["জাভাস্ক্ৰিপ্ট", "জাভাস্ক্রিপ্ট", "जावास्क्रिप्ट", "स्क्रिप्ट", "স্ক্ৰিপ্ট", "ত্ৰুটি", "ত্রুটি", "त्रुटि", "सर्वर", "চাৰ্ভাৰ", "সার্ভার", "পৃষ্ঠাখন", "পৃষ্ঠাটি", "माँगा गया", "पृष्ठ नहीं", "উপলব্ধ", "उपलब्ध", "আৰ্হি পাঠ", "नमूना पाठ", "নমুনা পাঠ", "निर्माणाधीन", "নিৰ্মাণাধীন", "নির্মাণাধীন"]
)
WHOLE_WORDS = ["script", "scripts", "js", "error", "errors", "human", "null"]
_AGAIN = re.compile(r"(?<![^\W\d_])([a-z]{2,12})(?: \1){4}")


class Gate:
    """Which pages to look at: one automaton finds the words of all lists in a text at once."""

    def __init__(self):
        import ahocorasick

        self.marks, self.words = ahocorasick.Automaton(), ahocorasick.Automaton()
        for m in MARKS:
            self.marks.add_word(m, 1)
        for w in BEGINNINGS:
            self.words.add_word(w, (len(w), False))
        for w in WHOLE_WORDS:
            self.words.add_word(w, (len(w), True))
        self.marks.make_automaton()
        self.words.make_automaton()

    def __call__(self, title: str | None, text: str | None) -> bool:
        both = f"{title or ''}\n{text or ''}"
        low = both.lower()
        if next(self.marks.iter(low), None) and _PLACEHOLDER.search(both):
            return True
        if not text:
            return False
        low = low[len(low) - len(text.lower()) :] if title else low[1:]
        for end, (n, whole) in self.words.iter(low):
            at = end - n + 1
            if (not at or not _letter(low[at - 1])) and (not whole or end + 1 == len(low) or not _letter(low[end + 1])):
                return True
        ws = low.split()
        return any(map(eq, ws, ws[1:])) and bool(_AGAIN.search(low))


def _letter(c: str) -> bool:
    return c.isalpha() or category(c)[0] == "M"


_SCRIPT_WORD = r"(?:java\s?script|\bjs\b|scripts?|scripting)"
# Whole lines that are script notices.
SCRIPT = re.compile(
    rf"^\W*(?:(?:please|you (?:need|have) to|allow it|to (?:see|view|use) .{{0,60}})?\s*,?\s*(?:please )?(?:enable|activate|turn on|switch on|allow) {_SCRIPT_WORD}.{{0,80}}"
    rf"|.{{0,60}}\b(?:needs?|requires?|relies on|depends on|works? (?:only )?with|necessary to enable|need to enable|have to enable|must enable|must allow) {_SCRIPT_WORD}.{{0,80}}"
    rf"|(?:we.{{0,25}}(?:detected|noticed) that )?{_SCRIPT_WORD} (?:is|are|must|needs? to|has|have|seems?)\b.{{0,30}}(?:disabled|turned off|switched off|off|blocked|run|required|enabled|necessary|needed)\b.{{0,100}}"
    rf"|.{{0,80}}\b(?:doesn.t|does not|won.t|will not|can.t|cannot) (?:work|run|load|function|display|be (?:shown|displayed)).{{0,40}}\b(?:without|unless)\b.{{0,30}}{_SCRIPT_WORD}.{{0,60}}"
    rf"|.{{0,40}}browser (?:does not|doesn.t|has) (?:support|run|block\w*|disabled?)\s*{_SCRIPT_WORD}.{{0,80}}"
    rf"|noscript\b.{{0,100}}|how to (?:allow|enable|turn on) {_SCRIPT_WORD}.{{0,40}}|if nothing appears.{{0,60}}{_SCRIPT_WORD}.{{0,60}}|turn {_SCRIPT_WORD} on.{{0,60}}"
    r"|.{0,60}(?:জাভাস্ক্ৰিপ্ট|জাভাস্ক্রিপ্ট|जावास्क्रिप्ट|স্ক্ৰিপ্ট|स्क्रिप्ट).{0,60}(?:সক্ৰিয়|সক্রিয়|চালু|অন|অনুমতি|चालू|सक्षम|सक्रिय|अनुमति|ज़रूरी).{0,30})\W*$",
    re.I,
)
_STATUS = r"(?:not found|forbidden|unauthori[sz]ed|bad request|bad gateway|internal server error|service unavailable|gateway time-?out|request time-?out|too many requests|method not allowed|gone|access denied|page not found|file not found|server error|fatal error|database error|application error|runtime error|session expired|account suspended|invalid request|permission denied|site (?:not found|unavailable)|under maintenance)"
# Whole lines that are messages of servers, programs, firewalls, checks and missing pages.
ERROR = re.compile(
    rf"^\W*(?:(?:http |error |status )?(?:error )?(?:\d{{3}}\b)?\W*{_STATUS}\W*(?:\d{{3}})?|sorry|oops\W*|error|warning|(?:http )?error:? ?\d{{3}}|undefined|null|nan|\[?object object\]?|reference:? [\w.#-]+|ray id:? [\w.-]+"
    r"|(?:http )?error:? ?\d{3}\b.{0,80}|\d{3}\W+(?:you have )?\w+.{0,20}(?:requests|error).{0,60}|.{0,30}took too long to respond.{0,20}|upstream .{0,60}|.{0,40}sent too many requests.{0,60}"
    r"|(?:oops\W*)?(?:we|sorry,? we)? ?(?:could|can)(?:n.t| ?not) (?:find|be found).{0,60}|the (?:page|link|file|address|url|resource).{0,40}(?:may|might|does|could|cannot|is|was)\b.{0,20}(?:moved|old|exist|removed|found|available|changed|deleted|broken)\.?(?: or .{0,60})?"
    r"|(?:this|the) (?:page|site|website|app|address) (?:isn.t|is not|can.t be|cannot be|could not be) (?:working|available|reached|displayed|found|loaded)\b.{0,80}"
    r"|the requested (?:address|url|page|file|resource|document)\b.{0,160}|.{0,20}server (?:met|encountered|ran into|has)\b.{0,120}|(?:object|document|page|resource) moved\b.{0,60}|(?:request|incident|event|trace) id\W.{0,40}|ray\b\W?[\w-]{1,24}|reference\W{0,3}[\w.#-]{1,40}"
    r"|.{0,40}unusual traffic.{0,80}|.{0,40}(?:solve the puzzle|complete the (?:captcha|puzzle)|captcha).{0,60}|(?:checking|verifying|verify|please confirm|confirm).{0,40}(?:human|browser|connection|robot).{0,60}|(?:attention required|just a moment|one more step)\W*.{0,40}"
    r"|traceback .{0,60}|file \"[^\"]+\", line \d+.{0,40}|\w*(?:error|exception): .{0,100}|(?:warning|notice|fatal error|parse error|deprecated): .{0,20}(?:\w+\(|syntax|undefined|uncaught|call to|failed|cannot).{0,120}|at [\w.$]+\([\w.]+:\d+\)"
    r"|\{\W*(?:code|error|status|message|detail)\W.{0,120}\}|(?:error establishing|could not connect|unable to connect|cannot connect|failed to connect).{0,60}"
    r"|.{0,30}session (?:has )?(?:timed out|expired|ended).{0,60}|.{0,40}(?:account|site|domain) has been (?:suspended|disabled|blocked).{0,60}|.{0,20}contact your (?:provider|administrator|host).{0,40}"
    r"|your (?:request|access|ip|connection).{0,30}(?:refused|denied|blocked|rejected).{0,60}|.{0,20}(?:down|closed|offline|unavailable) for (?:planned |scheduled )?maintenance.{0,60}|.{0,20}(?:planned|scheduled) maintenance.{0,60}|.{0,40}(?:temporarily|currently) (?:unavailable|down|offline).{0,40}|something went wrong.{0,60}|(?:please )?(?:try|come) (?:again|back) .{0,30}|you (?:do not|don.t) have permission.{0,160}"
    r"|त्रुटि|.{0,30}सर्वर (?:में|की|से).{0,60}|.{0,30}(?:माँगा|मांगा) गया पृष्ठ.{0,40}|पृष्ठ (?:नहीं मिला|उपलब्ध नहीं|मौजूद नहीं).{0,30}|ত্ৰুটি|ত্রুটি|.{0,20}(?:চাৰ্ভাৰত|চাৰ্ভাৰৰ|সার্ভারে|সার্ভারের).{0,60}|.{0,40}(?:পৃষ্ঠাখন|পৃষ্ঠাটি|পেজটি).{0,20}(?:পোৱা নগ.?ল|উপলব্ধ নহয়|পাওয়া যায়নি|উপলব্ধ নয়|নাই|নেই).{0,20})\W*$",
    re.I,
)
# Whole lines that stand in for content.
FILLER = re.compile(
    r"^\W*(?:lorem ipsum.{0,80}|(?:your |page |section )?(?:heading|title|headline|subtitle|text|content|name|image|logo|caption) (?:goes |text )?here\W*|.{0,40}\bgoes here\b.{0,80}|heading (?:one|two|three|four|\d)|(?:more )?body text\W.{0,200}|more body text.{0,200}|product (?:one|two|three|\d)|short blurb|caption text|(?:image|photo) caption"
    r"|(?:this is )?(?:a |an |just )?(?:sample|example|dummy|test|placeholder) (?:page|text|paragraph|post|content|title|heading)\b.{0,120}|placeholder (?:for|text).{0,60}|dummy (?:text|paragraph).{0,80}"
    r"|(?:content|text|details|description|information|page) (?:will be|to be|is being|are being) (?:added|updated|written|announced|uploaded).{0,40}|coming soon\W*.{0,20}|(?:page |site )?under construction\W*.{0,40}|text to follow.{0,20}|to be (?:added|announced|written|updated)\W*"
    r"|(?:edit|click|double-click|use) (?:this|here|on this).{0,30}(?:block|text|paragraph|section|edit|story).{0,60}|add (?:a|your|some) .{0,60}(?:here|block|text|description|story|service|content).{0,40}|write (?:something|a few|your|about) .{0,80}|describe your .{0,60}|replace (?:it|this) with your .{0,40}|(?:title|untitled|new page|hello world)\W*"
    r"|.{0,30}(?:আৰ্হি পাঠ|नमूना पाठ|নমুনা পাঠ|নমুনা লেখা).{0,400}|.{0,20}(?:ইয়াত নিজৰ|यहाँ अपना|এখানে নিজের|এখানে আপনার).{0,60}|(?:সোনকালে|শীঘ্ৰে|শীঘ্রই|जल्द).{0,40}|.{0,20}(?:निर्माणाधीन|নিৰ্মাণাধীন|নির্মাণাধীন).{0,30})\W*$",
    re.I,
)
# The words of the printers' stand-in text.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
# Defaults that a slot may hold.
DEFAULTS = frozenset(["", "-", "todo", "tbd", "tba", "xxx", "n/a", "null", "none", "undefined", "your name", "name here", "text here"])
_PLACEHOLDER = re.compile(PLACEHOLDER)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def slots_of(line: str) -> list[tuple[str, str, str]]:
    """(head, tail, edges) of each placeholder of a line: the text back to the placeholder before and on to the next one. ``edges`` tells whether these reach the line's start (^) and end ($)."""
    ms = list(_PLACEHOLDER.finditer(line))
    ends = [0, *(m.end() for m in ms)]
    starts = [*(m.start() for m in ms[1:]), len(line)]
    out = [(line[a : m.start()].strip(), line[m.end() : b].strip(), "^" * (i == 0) + "$" * (i == len(ms) - 1)) for i, (m, a, b) in enumerate(zip(ms, ends, starts))]
    # a part of a line is only a frame if it has some words
    return [x for x in out if x[0] and (x[2] == "^$" or len(_WORD.findall(f"{x[0]} {x[1]}")) >= 3)]


def variable_of(placeholder: str) -> str:
    return " ".join(w.lower() for w in re.findall(r"[^\W\d_]+", placeholder))


_GAP = r"[ \t\r\u00a0]*"


def _trie(texts) -> str:
    """A pattern of any of the texts, common beginnings once."""
    root: dict = {}
    for t in texts:
        at = root
        for c in t:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(at: dict) -> str:
        run = ""
        while len(at) == 1 and "" not in at:  # no branch: one literal
            c, at = next(iter(at.items()))
            run += re.escape(c)
        rest = [re.escape(c) + write(x) for c, x in sorted(at.items()) if c]
        return run + (f"(?:{'|'.join(rest)}){'?' if '' in at else ''}" if rest else "")

    return write(root)


class Slots:
    """The learnt frames around a bare variable, a default or nothing. Nothing only counts where a sign parts head and tail, as "Dear ,".

    One automaton finds the heads of all frames in a text; the line around a head decides.
    """

    def __init__(self, frames, variables):
        values = {x for v in variables for x in (v, v.replace(" ", ""), v.replace(" ", "_"), v.replace(" ", "-"), v.replace(" ", "."))} | DEFAULTS - {""}
        self.frames, self._value = sorted(frames), _trie(values)
        self._heads = None

    @staticmethod
    def _blank(head: str, tail: str) -> bool:
        return bool(tail) and not (head[-1].isalnum() and tail[0].isalnum())

    def __getstate__(self):
        return {"frames": self.frames, "_value": self._value, "_heads": None}

    def _pattern(self, head: str, tail: str, edges: str) -> re.Pattern:
        start = rf"^{_GAP}" if "^" in edges else r"(?<!\w)"
        end = rf"{_GAP}$" if "$" in edges else r"(?!\w)" if tail[-1:].isalnum() else ""
        value = rf"(?<!\w)[\[({{<]?(?iu:{self._value})[\])}}>]?(?!\w)"
        return re.compile(f"{start}{re.escape(head)}{_GAP}(?:{value}{_GAP}){'?' if self._blank(head, tail) else ''}{re.escape(tail)}{end}")

    def left(self, text: str) -> bool:
        if not self.frames:
            return False
        if self._heads is None:
            import ahocorasick

            of: dict[str, list] = {}
            for head, tail, edges in self.frames:
                of.setdefault(head, []).append((self._pattern(head, tail, edges), "^" in edges))
            self._heads = ahocorasick.Automaton()
            for head, patterns in of.items():
                self._heads.add_word(head, (len(head), [p for p, _ in patterns], all(at_start for _, at_start in patterns)))
            self._heads.make_automaton()
        for end, (n, patterns, at_start) in self._heads.iter(text):
            first = text.rfind("\n", 0, end - n + 1) + 1
            if at_start and text[first : end - n + 1].strip(" \t\r\u00a0"):
                continue
            last = text.find("\n", end)
            line = text[first : last if last >= 0 else len(text)]
            if any(p.search(line) for p in patterns):
                return True
        return False


def slot_left(text: str, slots: Slots) -> bool:
    """Whether a text has an unfilled slot: a placeholder, or a known frame around a bare variable, a default or nothing."""
    return bool(_PLACEHOLDER.search(text)) or slots.left(text)


def _lorem(line: str) -> bool:
    ws = [w.lower() for w in _WORD.findall(line)]
    return bool(ws) and sum(w in LOREM for w in ws) >= max(1, 0.8 * len(ws)) and not (len(ws) < 3 and not set(ws) & {"lorem", "ipsum", "dolor", "amet", "elit", "magna", "aliqua", "labore", "consectetur", "adipiscing", "eiusmod", "tempor", "incididunt", "dolore"})


def _repeats(line: str) -> bool:
    ws = [w.lower() for w in _WORD.findall(line)]
    return len(ws) >= 6 and len(set(ws)) <= max(1, len(ws) // 4)


def line_kind(line: str) -> str | None:
    """script, error or filler of one line, or None."""
    x = line.strip()
    if len(x) > 700:  # no notice's shape is longer; stand-in text may be
        return "filler" if _lorem(x) or _repeats(x) else None
    if SCRIPT.match(x):
        return "script"
    if FILLER.match(x) or _lorem(x) or _repeats(x):
        return "filler"
    if ERROR.match(x):
        return "error"
    return None


def level(line: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", line)).strip().lower()


def own_lines(title: str | None, lines: list[str], repeated: list[bool]) -> list[str]:
    """The page's lines without those of its site and without its heading. A notice stays: a site that answers with one page on many urls repeats it."""
    names = set()
    if title:
        t = re.sub(r"\W+", "", title.lower())
        names = {t} | {re.sub(r"\W+", "", p.lower()) for p in re.split(r"\s+[-|–—]\s+", title)}
    out = []
    for x, r in zip(lines, repeated):
        if not x.strip():
            continue
        if (r or re.sub(r"\W+", "", x.lower()) in names) and line_kind(x) is None:
            continue
        out.append(x.strip())
    return out


def page_kind(lines: list[str], companions: frozenset = frozenset(), again: bool = False) -> str | None:
    """script, error or filler where the lines hold no content of the page's own, else None. ``again``: the whole body recurs on other urls; one that opens with a notice and is short is a template as a whole."""
    if not lines:
        return None
    if again and line_kind(lines[0]) and sum(len(x.split()) for x in lines) <= 100:
        return line_kind(lines[0])
    words: dict[str, int] = {}
    other, marked, unmarked = 0, 0, 0
    for x in lines:
        n = max(1, len(x.split()))
        k = line_kind(x)
        if k:
            words[k] = words.get(k, 0) + n
            marked += 1
        elif level(x) not in companions and not x.lower().rstrip(". …").endswith("loading"):
            other += n
            unmarked += 1
    if not words or other > 15 or (other >= 2 * sum(words.values()) and marked < 2 * unmarked):
        return None
    return "script" if "script" in words and words["script"] >= words.get("filler", 0) else max(words, key=lambda k: (words[k], k))


def _source(pages: DataFrame, page_id: str, site: str, title: str, content: str, url: str) -> DataFrame:
    return pages.select(F.col(page_id).alias("id"), F.coalesce(site_of(F.col(site).cast("string")), F.lit("")).alias("s"), F.col(title).cast("string").alias("title"), F.col(content).cast("string").alias("t"), F.col(url).cast("string").alias("u")).where("id is not null and (title is not null or t is not null)")


def _gated(batches):
    gate = Gate()
    for b in batches:
        yield b.filter(pa.array([gate(ti, t) for ti, t in zip(b.column("title").to_pylist(), b.column("t").to_pylist())], pa.bool_()))


def _learnt_slots(marked: DataFrame) -> tuple[list, list]:
    """The frames and the variables of the placeholders of all pages that have any."""

    def learn(batches):
        for b in batches:
            kinds, values = [], []
            for ti, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both = (ti or "") + "\n" + (t or "")
                for line in both.split("\n"):
                    fs = ["\t".join(f) for f in slots_of(line.replace("\t", " "))]
                    kinds += ["frame"] * len(fs)
                    values += fs
                vs = [variable_of(m) for m in _PLACEHOLDER.findall(both)]
                kinds += ["variable"] * len(vs)
                values += vs
            yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    counts = marked.select("title", "t").mapInArrow(learn, "kind string, value string").groupBy("kind", "value").agg(F.count("*").alias("n"))
    counts = materialize(counts.where("n >= 3 and value <> ''"), "learnt-slots")
    # of all placeholders 1 in 2000, so that there can't be more than 2000 of either
    total = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    top = lambda kind: [r["value"] for r in counts.where((F.col("kind") == kind) & (F.col("n") >= 0.0005 * total.get(kind, 0))).orderBy("value").collect()]
    return [tuple(v.split("\t")) for v in top("frame")], top("variable")


def _bodies_again(src: DataFrame, of_site: DataFrame, small: bool) -> DataFrame:
    """ids of the pages whose levelled body, title and blank lines aside, stands on at least 3 urls: whole on urls of its site, or without the sites' repeated lines on urls of 2 sites."""
    x = src.where("t is not null and u is not null").withColumn("sh", F.xxhash64("s")).join(F.broadcast(of_site) if small else of_site, "sh", "left")
    name = letters_key(F.coalesce("title", F.lit("")))
    x = x.select("id", "sh", F.xxhash64("u").alias("h"), "keys", F.filter(F.transform(F.split("t", "\n"), letters_key), lambda v: (v != "") & (v != name)).alias("ls"))
    x = x.select("id", "sh", "h", "keys", F.transform("ls", lambda v: F.xxhash64(v)).alias("ls"))
    # the lines without those of the site; a body of nothing else is compared within its site only
    known = F.coalesce("keys", F.array().cast("array<bigint>"))
    x = x.select("id", "sh", "h", "ls", F.filter("ls", lambda v: ~F.array_contains(known, v)).alias("own"))
    x = materialize(x.where(F.size("ls") > 0).select("id", "sh", "h", F.xxhash64("sh", "ls").alias("whole"), F.when(F.size("own") > 0, F.xxhash64("own")).alias("own")), "bodies")
    # on (body, url) first, so that no frequent body ends in one task
    whole = x.select("whole", "h").distinct().groupBy("whole").agg(F.count("*").alias("n")).where("n >= 3").select("whole")
    own = x.where("own is not null").groupBy("own", "h").agg(F.min("sh").alias("least"), F.max("sh").alias("most")).groupBy("own").agg(F.count("*").alias("n"), (F.min("least") < F.max("most")).alias("sites")).where("n >= 3 and sites").select("own")
    return materialize(x.join(whole, "whole", "left_semi").select("id").union(x.join(own, "own", "left_semi").select("id")).distinct(), "bodies-again")


def residue_pages(pages: DataFrame, *, page_id: str = "page_id", site: str = "seed_url", url: str = "url", title: str = "title", content: str = "content", broadcast_rows: int = 1_000_000) -> DataFrame:
    """page_id, defect: every page with ``template``, ``filler``, ``error`` or ``script`` instead of content, once.

    Null and blank content is no case unless the title holds a placeholder; null ids give no row; a page delivered twice gives
    one row. Real pages that speak of such things are kept, as content of their own is left. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    src = _source(pages, page_id, site, title, content, url)
    gated = materialize(src.mapInArrow(_gated, src.schema).dropDuplicates(["id"]), "suspicious")
    frames, variables = _learnt_slots(gated)
    slots = Slots(frames, variables)
    hits = materialize(excessive_lines(pages, page_id=page_id, site=site, url=url, content=content, min_urls=3, min_share=0.1, min_site_urls=3).select("sh", "k"), "repeated-lines")
    of_site = materialize(hits.groupBy("sh").agg(F.collect_list("k").alias("keys")), "repeated")
    small = hits.count() <= broadcast_rows
    again = _bodies_again(src, of_site, small)
    again = again.withColumn("again", F.lit(True))
    few = again.count() <= broadcast_rows
    again = F.broadcast(again) if few else again
    # what the fixed words leave out: pages with a learnt frame or with a body that recurs
    known_slots = spark.sparkContext.broadcast(slots)

    def framed(batches):
        slots = known_slots.value
        for b in batches:
            keep = [bool(a) or (ti is not None and slots.left(ti)) or (t is not None and slots.left(t)) for ti, t, a in zip(*(b.column(c).to_pylist() for c in ("title", "t", "again")))]
            yield b.filter(pa.array(keep, pa.bool_())).select(names)

    names = src.columns
    rest = src.join(again, "id", "left").select(*names, "again").mapInArrow(framed, src.schema)
    cand = gated.unionByName(rest).dropDuplicates(["id"]).join(again, "id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    x = cand.withColumn("sh", F.xxhash64("s")).join(F.broadcast(of_site) if small else of_site, "sh", "left")
    lines = F.split(F.coalesce("t", F.lit("")), "\n")
    known = F.coalesce("keys", F.array().cast("array<bigint>"))
    x = x.select("id", "s", "title", "t", "again", lines.alias("lines"), F.transform(lines, lambda v: F.array_contains(known, F.xxhash64(letters_key(v)))).alias("repeated"))
    x = materialize(x, "candidates")

    def learn(batches):
        for b in batches:
            kinds, values, sites = [], [], []
            for s, ti, ls, rep in zip(*(b.column(c).to_pylist() for c in ("s", "title", "lines", "repeated"))):
                own = own_lines(ti, ls, rep)
                notices = [v for v in own if line_kind(v)]
                for v in own:
                    if not line_kind(v):
                        kinds.append("with" if notices and sum(map(len, notices)) > len(v) and sum(map(len, own)) < 800 else "without")
                        values.append(level(v))
                        sites.append(s)
            yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(sites, pa.string())], names=["kind", "value", "site"])

    seen = x.select("s", "title", "lines", "repeated").mapInArrow(learn, "kind string, value string, site string")
    counts = seen.groupBy("kind", "value").agg(F.count("*").alias("n"), F.approx_count_distinct("site").alias("sites"))
    counts = materialize(counts.where("n >= 3 and value <> ''"), "learnt")
    alone = counts.where("kind = 'without'").select("value", F.col("n").alias("m"))
    # of all lines beside notices 1 in 5000, so that there can't be more than 5000
    beside = counts.where("kind = 'with'").agg(F.sum("n")).first()[0] or 0
    company = counts.where("kind = 'with' and sites >= 2").join(alone, "value", "left").where((F.col("n") >= 9 * F.coalesce("m", F.lit(0))) & (F.col("n") >= 0.0002 * beside))
    shared = spark.sparkContext.broadcast((slots, frozenset(r["value"] for r in company.collect())))

    def judge(batches):
        slots, companions = shared.value
        for b in batches:
            out = []
            for ti, t, ls, rep, again in zip(*(b.column(c).to_pylist() for c in ("title", "t", "lines", "repeated", "again"))):
                kind = None
                if slot_left(ti or "", slots) or (t and slot_left(t, slots)):
                    kind = "template"
                elif t and t.strip():
                    kind = page_kind(own_lines(ti, ls, rep), companions, again)
                out.append(kind)
            yield pa.record_batch([b.column("id"), pa.array(out, pa.string())], names=["id", "defect"])

    kind = cand.schema["id"].dataType.simpleString()
    out = x.select("id", "title", "t", "again", "lines", "repeated").mapInArrow(judge, f"id {kind}, defect string").where("defect is not null")
    return out.groupBy("id").agg(F.min("defect").alias("defect")).withColumnRenamed("id", page_id)


def without_residue(pages: DataFrame, *, page_id: str = "page_id", **kw) -> DataFrame:
    """The pages without those of ``residue_pages``."""
    bad = residue_pages(pages, page_id=page_id, **kw).select(F.col(page_id).alias("__bad"))
    return pages.join(bad, F.col(page_id) == F.col("__bad"), "left_anti")
