import pytest

from pagemill.llm import broken_pairs as B
from pagemill.llm import cutoff, endings

SCHEMA = "qa_id bigint, question string, content string, id string, defect string"


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        (None, False), ("", False), (" \n", False), ("A whole sentence.", False), ("A whole sentence", True), ("এটা বাক্য।", False), ("এটা বা", True),
        ("One. And then ...", True), ("One. And th…", True), ("One. And th [...]", True), ("One. Two. “Come again!”", False), ("One. (see the map.)", False), ("One. (see the", True),
        ("It ends.\nTags: river, ferry", False), ("It ends.\n#one #two", False), ("It ends.\n— The desk", False), ("It ends.\nhttps://a.b/c", False), ("It ends.\n- boats\n- oars", False), ("It ends.\nPrice: Rs. 5/-", False),
        ("A narrow causeway costs Rs.", True), ("The end of it�", True), ("Seven o'clock!", False), ("x" * 100_000, True),
    ],
)
def test_cut(text, cut):
    assert endings.cut(text) is cut


@pytest.mark.parametrize(
    ("question", "content", "defect"),
    [
        ("Where is it?", None, "empty"), ("Where is it?", "​ \n", "empty"), ("Where is it?", "N/A", "empty"), ("Where is it?", "The old mill guide\n\n—", "empty"), (None, "It stands at the end of the road.", None),
        ("How much does a boat cost in Roli?", "Q: HOW MUCH DOES A BOAT COST IN ROLI", "copies_question"), ("How much does a boat cost in Roli?", "How much does a boat cost in Roli? It costs Rs. 20 a day at the pier.", None),
        ("Where is it?", "I'm sorry, but I can't help with that.", "refusal"), ("Where is it?", "मैं इसमें सहायता करने में असमर्थ हूँ। कृपया कुछ और पूछें।", "refusal"), ("Where is it?", "Sorry, I cannot discuss this topic. Please ask something else.", "refusal"),
        ("Where is it?", 'The guide said "I can\'t help with that" and then carried every bag. It is near the river.', None), ("Where is it?", "Visitors are not able to enter the core zone; the outer trail is open.", None),
        ("Where is the old mill of Roli?", "यह नदी के किनारे बना हुआ है और हर रविवार को खुला रहता है।", "other_language"), ("Where is the old mill of Roli?", "Le vieux moulin est dans la vallée et il attire les familles après la récolte.", "other_language"), ("Where is the mill?", "Har ravivar ko nadi ka ghaat khula hota hai aur mela lagta hai.", "other_language"),
        ("Where is the old mill of Roli?", "Tosugaon, written केर locally, is the name that is used here for the mill.", None), ("Where is the old mill of Roli?", "It stands at the end of the long road to the", "truncated"),
    ],
)
def test_defect(question, content, defect):
    assert B.defect(question, content) == defect


def test_broken_pairs_table(spark):
    rows = [(1, None, None, "a", "b"), (1, None, None, "a", "b"), (2, "Where?", "At the old bridge.", "a", "b"), (None, "q", "", "a", "b"), (3, "What is it", "", "a", "b"), (4, "q?", "word " * 40_000, None, None)]
    got = sorted(tuple(r) for r in B.broken_pairs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, "empty"), (3, "empty"), (4, "truncated")]
    assert B.broken_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_zstandard_tells_copies_from_answers():
    q = "how much does a boat cost in roli on the first day of the year"
    assert B.added(q, q) < 20 < B.added(q, "a boat costs twenty rupees and leaves at seven from the eastern pier by the mill")


DOCS = "doc_id bigint, text string, source string, cut string, k string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOCS)


def test_prefixes_of_longer_copies(spark):
    long = "The ferry leaves at seven and comes back at nine. Then it rests for the night."
    rows = [(1, long, "a"), (2, long[:30] + ".", "a"), (3, long[:49], "a"), (4, "Another text.", "b"), (5, None, None), (6, " ", "b"), (7, long[:30] + ".", "b")]
    got = {r["doc_id"]: r["reason"] for r in cutoff.ends(docs(spark, rows).repartition(3)).collect()}
    assert got == {1: None, 2: "copy", 3: None, 4: None, 5: None, 6: None, 7: "copy"}
    share = {r["source"]: (r["documents"], r["cut"]) for r in cutoff.cut_by_source(docs(spark, rows)).collect()}
    assert share == {"a": (3, 1), "b": (3, 1), None: (1, 0)}
    assert cutoff.cut_documents(docs(spark, [])).collect() == []


def test_prefixes_against_brute_force(spark):
    import random

    r = random.Random(4)
    texts = ["".join(r.choice("ab ") for _ in range(r.randint(1, 12))).strip() or "a" for _ in range(400)]
    keys = sorted(set(texts))
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "h bigint, k string").repartition(7)
    got = {keys[x["h"]] for x in cutoff.continued(df).collect()}
    assert got == {k for k in keys if any(v != k and v.startswith(k) and v[len(k) :].strip() for v in keys)}


def test_pairs_long_refusals_short_questions_and_languages():
    assert B.defect("Where is it?", "I'm sorry, but I cannot help with that request. " * 20) == "refusal"
    assert B.defect("Where is it?", "I'm sorry, but I cannot help with that request. " * 20 + "The mill stands at the pier.") is None
    assert B.defect("Fees?", "Fees?") == "copies_question" and B.defect("Fees?", "Q: FEES") == "copies_question"
    assert B.defect("Fees?", "Fees are due.") is None
    for x in ("Es tut mir leid. Ich kann diese Frage leider nicht beantworten.", "Desculpe. Não posso responder a essa pergunta.", "Mi dispiace. Non posso rispondere a questa domanda."):
        assert B.defect("How much does the boat to the pier cost?", x) == "refusal", x


def test_copies_with_small_changes_are_found_by_what_the_frame_adds():
    q = "How much does a boat to the eastern pier cost on the first day of the year?"
    assert B.copies_question(q, "Well, how much does a boat to the eastern pier cost on the first day of the year?")
    assert B.copies_question(q, q.replace("eastern", "western")) and B.copies_question(q, "Q: " + q + "\n" + q)
    assert not B.copies_question(q, "A boat to the eastern pier costs Rs. 20 on the first day of the year.")
    assert not B.copies_question("Is the ferry running today?", "The ferry is running today.")
    assert not B.copies_question("", "x") and not B.copies_question("Who?", "Nobody.") and B.copies_question("Who?", "Who?")


@pytest.mark.parametrize(("text", "cut"), [("Dear all,\nPlease come.\nRegards\nAnita", False), ("Please come.\nWith best wishes,\nR. Bora\nSecretary", False), ("Please come.\nRegards from the\nmayor of the", True), ("It ends." + "." * 2000, False), ("It goes on and" + "…" * 2000, True)])
def test_signatures_and_many_marks(text, cut):
    assert endings.cut(text) is cut


def test_words_that_go_on_are_learnt(spark):
    rows = [(i, f"the boat number {i} leaves from the pier. it comes back to the mill\nthe end", "a") for i in range(300)]
    learnt = endings.Terminal(endings.closing_lines(docs(spark, rows), "text"), endings.going_on(docs(spark, rows), "text", least=200))
    assert {"the", "from", "to"} <= learnt.goes_on and not {"pier", "mill", "end"} & learnt.goes_on
    assert "the end" in learnt.closing
    assert endings.cut("It leaves from the.", learnt) and not endings.cut("It leaves from the pier.", learnt) and not endings.cut("It leaves from the.")
    assert endings.learn(docs(spark, []), "text") == endings.NOTHING_LEARNT


def test_prefixes_with_heads_in_common(spark):
    long = "The ferry leaves at seven and comes back at nine, but on the first day of the year it rests for the whole night at the eastern pier."
    rows = [(1, long, "a"), (2, long[:80] + ".", "a"), (3, long[:48] + ".", "a"), (4, long[:20] + ".", "a"), (5, "x", "a"), (6, long + " And so on.", "a")]
    for limit in (1_000_000, 0):
        got = {r["doc_id"]: r["reason"] for r in cutoff.ends(docs(spark, rows).repartition(3), broadcast_rows=limit).collect()}
        assert got == {1: None, 2: "copy", 3: "copy", 4: "copy", 5: "context", 6: None}, limit
