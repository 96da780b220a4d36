"""Broken prompt and response pairs (problem 1).

Each pair is judged on its own, in one pass without a shuffle, in this order: ``empty``, ``copies_question``, ``refusal``,
``other_language``, ``truncated``. Copies are found by compressing the response with its prompt as a zstandard dictionary, and the
prompt with the response as its dictionary: what one adds to the other is the size of the frame beyond that of a frame of the
dictionary itself. Where both add next to nothing, few words may differ. Languages are told by script and dictionaries of function words, refusals by dictionaries of phrases, cut answers by
the terminal context (``endings.py``) as learnt from all answers.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import endings

# Words that stand for nothing, by their letters and digits.
NOTHING = set("na nil null none nan tbd tba todo empty blank undefined unknown missing void nothing noanswer noanswergiven noanswerfound notavailable notapplicable nodata noresponse nocontent pending comingsoon xxx नहीं नास्ति कुछनहीं उपलब्धनहीं रिक्त शून्य नल নাই একোনাই উত্তৰনাই উপলব্ধনহয় শূন্য নেই কিছুনেই উত্তরনেই".split())
# Labels in front of a repeated question.
LABEL = re.compile(r"^\W*(?:q|que|ques|question|you asked|your question|asked|query|prompt|user|answer|a|ans|re|प्रश्न|सवाल|आपने पूछा|উত্তৰ|প্ৰশ্ন|আপুনি সুধিছে|প্রশ্ন|আপনি জিজ্ঞাসা করেছেন)\s*(?:\d+\s*)?[:.\-–—=>)]+\s*", re.I)
# Function words of the languages in Latin letters.
FUNCTION_WORDS = {
    "en": "the and of a an in to for is are was were has have had with that this it its by at from about every on when between under only can you how what where who which why does do than then there they their not but or as be been will would if all some any after before while during into".split(),
    "fr": "le la les un une des du de et est sont dans pour avec que qui on dit pendant entre après avant depuis sur sous chez pas ne se ce cette son ses aux au plus par où mais ou il elle nous vous".split(),
    "es": "el la los las un una unos y es son en para con que se dice durante entre después antes desde sobre de del al por más pero o su sus lo le no muchos muchas donde cuando a".split(),
    "pt": "o os as um uma e é são em para com que se durante entre depois antes desde sobre do da dos das ao por mais mas ou seu sua não muitos onde quando".split(),
    "it": "il lo gli un una e è sono in per con che si durante tra dopo prima da su del della dei delle al più ma o suo sua non molti dove quando".split(),
    "de": "der die das ein eine und ist sind in für mit dass sich während zwischen nach vor seit auf von zu zum zur am im mehr aber oder sein ihr nicht viele wo wenn".split(),
    "hi": "hai hain ka ki ke ko mein se aur par ho to tha thi the har agar lekin nahi nahin ek yah yeh is us karta karti karte karega pehle baad tak ne bhi liye samay jo kya kab kyon kahan".split(),
    "as": "aru hoi kori korise korile ase asil nai moi apuni tumi eta xokolu pora loi logot pisot agote jodi tente kintu kenekoi kiyo ketiya".split(),
    "bn": "ebong hoy kore korche korbe ache chilo nei ami apni tumi ekta theke sathe pore age jodi tobe kintu keno kokhon kothay".split(),
}
FUNCTION_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
WORD_LANGUAGES = {w: tuple(k for k in FUNCTION_WORDS if w in FUNCTION_SETS[k]) for ws in FUNCTION_WORDS.values() for w in ws}
_BENGALI, _DEVANAGARI, _LATIN = re.compile("[ঀ-৿]"), re.compile("[ऀ-ॣ०-ॿ]"), re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏḀ-ỿ]")
_ELSE = re.compile("[\\x00-ɏḀ-ỿऀ-৿]+")
# Words that tell Assamese from Bengali where the letters don't.
AS_WORDS = frozenset("আৰু কিমান কিয় কেতিয়া কি চাব পাৰি আছে বুলি সকলোৱে হয় তেন্তে যদি কিন্তু মই মোৰ নাই এই".split())
BN_WORDS = frozenset("এবং কেন কখন কত কোথায় কী বলে সবাই তবে আছে আমি আমার নেই করে এই".split())
_DIFFERENT_AS, _DIFFERENT_BN = AS_WORDS - BN_WORDS, BN_WORDS - AS_WORDS

# Phrases of refusals. A refusing sentence speaks of the speaker and of answering.
_SELF = r"(?:\bI\b|\bI['’](?:m|d|ll|ve)\b|\bme\b|\bmy\b|\bwe\b|\bour\b|\bthis (?:assistant|bot|model|system)\b)"
_ANSWER = r"(?:answer\w*|help\w*|assist\w*|discuss\w*|provid\w*|shar\w*|say\w*|respond\w*|repl\w*|comment\w*|tell\w*|talk\w*|disclos\w*|compl(?:y|ete)\w*|fulfil\w*|address\w*|offer\w* (?:advice|information)|give\w*|speak\w*|request\w*|information|details|question\w*)"
_NOT = r"(?:can(?:no|['’])t|can not|could(?:n['’]t| not)|won['’]t|will not|would(?:n['’]t| not)|unable|not able|not (?:be )?(?:allowed|permitted|possible|comfortable|in a position|going)|isn['’]t possible|(?:do|does)(?:n['’]t| not) (?:feel|have|allow|permit|know)|must (?:decline|refuse)|(?:have|need) to (?:decline|refuse)|decline|refuse|rather not|no permission|not have permission|against (?:my|our))"
_SELF_RE, _NOT_RE, _ANSWER_RE = (re.compile(x, re.I) for x in (_SELF, _NOT, _ANSWER))
_PLAIN_REFUSAL = re.compile(r"against (?:my|our) (?:guidelines|rules|polic)|something I must decline", re.I)
# Parts of refusals in other languages, that follow each other in a sentence; searched one after the other, as sentences can be long.
REFUSAL_OTHER = [
    tuple(re.compile(x, re.I) for x in xs)
    for xs in [
        (r"उत्तर|जवाब|सहायता|मदद|जानकारी|बता|अनुमति|टिप्पणी", r"नहीं|असमर्थ|अक्षम|इनकार|मना"),
        (r"असमर्थ|अनुमति नहीं",),
        (r"উত্তৰ|সহায়|ক['’]বলৈ|কবলৈ|তথ্য|মন্তব্য|জনাব", r"নোৱাৰ|অক্ষম|অপাৰগ|অনুমতি নাই|অস্বীকাৰ"),
        (r"উত্তর|সাহায্য|সহায়তা|তথ্য|বলার|বলতে|মন্তব্য|জানাতে", r"পারব না|পারছি না|পারি না|অক্ষম|অপারগ|অনুমতি নেই|অস্বীকার"),
        (r"je ne (?:peux|puis|suis)", r"répondre|aider|réponse|information|autoris"),
        (r"no (?:puedo|me es posible|estoy autorizad)", r"responder|ayudar|información|contestar"),
        (r"\b(?:ich|wir)\b", r"\b(?:nicht|keine?n?)\b", r"beantworten|antworten|helfen|auskunft|antwort\b|information|äußern"),
        (r"não (?:posso|podemos|consigo|estou autorizad|me é possível|tenho permissão)", r"responder|ajudar|informaç|resposta|comentar"),
        (r"non (?:posso|possiamo|sono (?:in grado|autorizzat)|mi è (?:possibile|permesso|consentito))", r"rispond|aiutar|informazion|risposta|comment"),
        (r"uttor|xohai|tothyo|kobo", r"nuwar"),
        (r"uttor|sahajyo|tothyo|bolte", r"parbo na|parchi na|pari na"),
        (r"jawab|uttar|madad|sahayata|jaankari|jankari", r"nahi|nahin|asamarth"),
    ]
]
COURTESY = re.compile(
    r"^\W*(?:(?:i['’]?m |i am |we are )?(?:very |so )?sorry\b[^.]{0,20}|unfortunately|regrettably|i apologi[sz]e|apologies|thank(?:s| you)\b.{0,40}|please\b.{0,80}|is there (?:any|some)thing else\b.{0,60}|(?:you|one) (?:may|might|could|can)\b.{0,80}|(?:try|ask|contact|feel free)\b.{0,80}|let me know\b.{0,60}|topic\b.*"
    r"|(?:es tut mir|tut mir) leid|entschuldigung|leider|desculpe|lamento|mi dispiace|purtroppo|lo siento|(?:je suis )?désolée?"
    r"|क्षमा.{0,20}|माफ़?.{0,20}|कृपया.{0,80}|कार्यालय.{0,60}|धन्यवाद.{0,40}|অনুগ্ৰহ.{0,80}|ক্ষমা.{0,20}|দুঃখিত.{0,20}|ধন্যবাদ.{0,40}|কাৰ্যালয়.{0,60}|অনুগ্রহ.{0,80}|দয়া করে.{0,80}|মাফ.{0,20}|কার্যালয়.{0,60}|অফিচ.{0,60})\W*$",
    re.I | re.S,
)
_QUOTED = re.compile(r"[\"“”«»][^\"“”«»]{0,200}[\"“”«»]")
_SENTENCES = re.compile(r"(?<=[.!?।॥])\s+|\n+")
_other = regex.compile(r"[^\p{L}\p{M}\p{N}]+").sub
_INDIC_WORD = re.compile(r"[ঀ-৿]+")
_LATIN_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def level(text: str) -> str:
    """Letters, marks and digits of the lower-cased text, as the copy check compares them."""
    return _other(" ", text.lower()).strip()


def body_of(content: str) -> str:
    """The answer without the page's name above it: the first paragraph, where it is short, no sentence, and a blank line follows."""
    head, gap, rest = content.lstrip().partition("\n\n")
    if gap and len(head.split()) <= 20 and "\n" not in head.strip() and (not head.strip() or head.strip()[-1] not in endings.STOPS):
        return rest
    return content


def is_empty(content: str | None) -> bool:
    """Null, blank, only marks, or a word that stands for nothing; the page's name aside."""
    if content is None or not level(content):
        return True
    x = level(body_of(content))
    return not x or x.replace(" ", "") in NOTHING


def frame(dictionary: str, text: str) -> int:
    """Bytes of the zstandard frame of a text with another one as its dictionary."""
    import zstandard as z

    d = z.ZstdCompressionDict(dictionary.encode("utf-8", "surrogatepass"), dict_type=z.DICT_TYPE_RAWCONTENT)
    c = z.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(c.compress(text.encode("utf-8", "surrogatepass")))


def added(dictionary: str, text: str) -> int:
    """Bytes that a text adds to its dictionary: its frame beyond that of the dictionary itself."""
    return frame(dictionary, text) - frame(dictionary, dictionary)


def copies_question(question: str | None, body: str, most_added: int = 24) -> bool:
    """Whether the body is only the question again, labels and form aside. What the frames add decides; of eight words one may then
    be another, as a turned-round question ("is it open" - "it is open") adds no more than that."""
    if not question:
        return False
    q = level(LABEL.sub("", question) or question)
    if not q or len(body) > 4 * len(question) + 80:
        return False
    forms, x = {level(body)}, body
    for _ in range(3):
        shorter = LABEL.sub("", x)
        if shorter == x:
            break
        x = shorter
        forms.add(level(x))
    for known in {q, level(question)}:
        for a in forms:
            while len(a) > len(known) and a.startswith(known + " " + known[: len(a) - len(known) - 1]):
                a = a[len(known) + 1 :]  # the question over and over
            if not a or abs(len(a) - len(known)) > most_added + len(known) // 8 or added(known, a) > most_added or added(a, known) > most_added:
                continue
            p, w = known.split(), a.split()
            if p == w or SequenceMatcher(None, p, w, autojunk=False).ratio() * (len(p) + len(w)) / 2 >= max(len(p), len(w)) - min(len(p), len(w)) // 8:
                return True
    return False


def language(text: str) -> tuple[str | None, dict[str, int]]:
    """The language of most of a text, or None where it can't be told, and the letters of each script."""
    n = {"beng": len(_BENGALI.findall(text)), "hi": len(_DEVANAGARI.findall(text)), "latn": len(_LATIN.findall(text))}
    n["other"] = sum(map(str.isalpha, _ELSE.sub("", text)))
    top = max(n, key=n.get)
    if sum(n.values()) < 8:
        return None, n
    if top == "beng":
        ws = _INDIC_WORD.findall(text)
        a = text.count("ৰ") + text.count("ৱ") + 2 * sum(w in _DIFFERENT_AS for w in ws)
        b = text.count("র") + 2 * sum(w in _DIFFERENT_BN for w in ws)
        return ("as" if a > b else "bn" if b > a else None), n
    if top == "latn":
        ws = _LATIN_WORD.findall(text.lower())
        if len(ws) < 4:
            return None, n
        score = dict.fromkeys(FUNCTION_SETS, 0)
        for w in ws:
            for k in WORD_LANGUAGES.get(w, ()):
                score[k] += 1
        score = {k: v / len(ws) for k, v in score.items()}
        best = max(score, key=score.get)
        if score[best] >= 0.12 and score[best] > score["en"] + 0.04:
            return best, n
        if score["en"] >= 0.08 or len(ws) < 8:
            return ("en" if score["en"] >= 0.08 else None), n
        return ("unknown" if score["en"] < 0.04 and len(ws) >= 12 else None), n
    return top, n


def other_language(question: str | None, body: str) -> bool:
    """Whether the answer's language is told and another than the question's. A question without a language is never answered in another."""
    if not question:
        return False
    q, a = language(question)[0], language(body)[0]
    if q is None and question:
        ws = [w.lower() for w in _LATIN_WORD.findall(question)]
        q = "en" if any(w in FUNCTION_SETS["en"] for w in ws) else None
    if q is None or a is None or q == a:
        return False
    # a question made of a page's name and the first words of the answer has both languages
    n = level(body)[:40]
    return not (len(n) >= 20 and n in level(question))


def _in_order(parts: tuple[re.Pattern, ...], text: str) -> bool:
    at = 0
    for p in parts:
        m = p.search(text, at)
        if not m:
            return False
        at = m.end()
    return True


def declines(sentence: str) -> bool:
    """Whether a sentence speaks of the speaker, of not being able or willing, and of answering; or declines in another language."""
    if _NOT_RE.search(sentence) and _SELF_RE.search(sentence) and _ANSWER_RE.search(sentence):
        return True
    return bool(_PLAIN_REFUSAL.search(sentence) or any(_in_order(x, sentence) for x in REFUSAL_OTHER))


def refuses(body: str) -> bool:
    """Whether every sentence of the answer declines or is a courtesy around it, and one declines."""
    x = re.sub(r"\(\s*(?:topic|re|subject|question|विषय|বিষয়)\s*[:：].*?\)?\s*$", " ", body.strip(), flags=re.I | re.S)
    x = _QUOTED.sub(" ", x)
    found = False
    for s in _SENTENCES.split(x):
        if not level(s):
            continue
        if declines(s):
            found = True
        elif not COURTESY.match(s.strip()):
            return False
    return found


def defect(question: str | None, content: str | None, learnt: endings.Terminal = endings.NOTHING_LEARNT) -> str | None:
    """The one defect of a pair, or None."""
    if is_empty(content):
        return "empty"
    body = body_of(content)
    if copies_question(question, body) or (body is not content and copies_question(question, content)):
        return "copies_question"
    if refuses(body):
        return "refusal"
    if other_language(question, body):
        return "other_language"
    if endings.cut(content, learnt):
        return "truncated"
    return None


def broken_pairs(pairs: DataFrame, *, pair_id: str = "qa_id", question: str = "question", content: str = "content") -> DataFrame:
    """pair_id, defect: one row for every pair with a defect, with its one type; whole pairs give no row.

    A null or blank content is ``empty``. A null question alone is no defect, and its answer is neither a copy nor in another
    language. Null ids give no row, a pair delivered twice gives one row. Texts are taken whole. Other columns are ignored.
    """
    src = pairs.select(F.col(pair_id).alias("id"), F.col(question).cast("string").alias("q"), F.col(content).cast("string").alias("c")).where("id is not null")
    learnt = src.sparkSession.sparkContext.broadcast(endings.learn(src, "c"))  # bounded, see there
    kind = src.schema["id"].dataType.simpleString()

    def judge(batches):
        for b in batches:
            d = pa.array([defect(q, c, learnt.value) for q, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.string())
            yield pa.record_batch([b.column(0), d], names=["id", "defect"])

    found = src.mapInArrow(judge, f"id {kind}, defect string").where("defect is not null")
    return found.groupBy("id").agg(F.min("defect").alias("defect")).withColumnRenamed("id", pair_id)
