import pytest
from pyspark.sql import functions as F

from corpusmill.llm import pairs
from corpusmill.session import table

ENGLISH = "The queue keeps its own index, so the reader never has to wait. It helps to draw the graph first."


@pytest.fixture(scope="module")
def judge(spark, data):
    rows = pairs._shaped(table(spark, data.replace("sf0.001", "sf0.01"), "sft_pairs")).select("pair_id", "question", "answer", "label").collect()
    return pairs.make_judge(*pairs.fit([tuple(r) for r in rows]))


def test_empty(judge):
    for answer in (None, "", " \n", "\u200b", "\xa0", "N/A", "n/a.", "-", "—", "...", "TODO", "(no answer)", "```python\n```", "<answer></answer>", "<think>\n</think>"):
        assert judge("What is a queue?", None, answer, "en") == "empty", answer
    for answer in ("None", "[]", "0", "False", "42", "{}"):
        assert judge("What is printed? Reply with the value only.", None, answer, "en") is None, answer


def test_copy(judge):
    q = "Why would someone choose a sorted queue over a list?"
    for answer in (q, q.lower(), q[:-1], f"**{q}**", f'"{q}"', f"Q: {q}", f"{q}\n{q}", f"The task is the following. {q}", "  Why  would someone choose a sorted queue over a list?\n", f"> {q}"):
        assert judge(q, None, answer, "en") == "copy", answer
    assert judge(q, "Some input text of a row.", f"{q}\n\nSome input text of a row.", "en") == "copy"
    assert judge("Repeat the following line exactly: The queue is sorted by the reader.", None, "The queue is sorted by the reader.", "en") is None
    assert judge("Fix the spelling: Teh queue is sorted.", None, "The queue is sorted.", "en") is None
    assert judge(q, None, f"{q} {ENGLISH}", "en") is None


def test_refusal(judge):
    for answer in ("I can't help with that request.", "I'm sorry, but I am unable to comply.", "As a text model, this is something I won't write code for.", "Thanks for asking. I won't be answering that.", "Unfortunately, that topic is off limits for me.", "My guidelines don't permit me to discuss the queue."):
        assert judge("What is a queue and when is it sorted?", None, answer, "en") == "refusal", answer
    assert judge("Wie groß sollte ein Block sein?", None, "Diese Anfrage darf ich leider nicht beantworten.", "de") == "refusal"
    assert judge("¿Qué ocurre cuando el búfer está vacío?", None, "Lo siento, no puedo ayudar con esa petición.", "es") == "refusal"
    assert judge("Que se passe-t-il après 3 étapes ?", None, "Je suis désolé, je ne peux pas répondre à cette demande.", "fr") == "refusal"
    assert judge("Can I reuse a queue after it was closed?", None, "Unfortunately not. Once closed, the queue rejects every call, so create a new one.", "en") is None
    assert judge("Write a polite note declining an invitation.", None, "I'm sorry, but I can't attend the meeting this week.", "en") is None


UNSEEN_REFUSALS = (
    "That isn't something I'm going to answer.", "Not able to assist with that.", "Apologies, but that request goes against my programming.", "I'd prefer to steer clear of this topic.", "This falls outside the scope of what I may do.",
    "Regrettably I have no answer to give you here.", "My instructions forbid talking about it.", "I'm going to have to sit this one out.", "We're not permitted to share that.",
    "You asked how chaining works in a hash table. That is a fair question. I'm not in a position to answer it.",
)
UNSEEN_ANSWERS = (
    "I can't help but admire chaining: each bucket keeps a list, and lookups walk it until the key is found.", "I will not discuss probing at length; chaining stores entries with equal hashes in one list per bucket.",
    "The parser cannot handle this because the grammar is ambiguous.", "A hash table does not keep order; use a tree if you need it.", "If the request fails, the client does not retry; it returns the error.", "You can't answer this without the size of the table, which is 16 here.",
)


def test_unseen_wordings(judge):
    q = "How does chaining in a hash table work?"
    assert [x for x in UNSEEN_REFUSALS if judge(q, None, x, "en") != "refusal"] == []
    assert [x for x in UNSEEN_ANSWERS if judge(q, None, x, "en") == "refusal"] == []
    declines = pairs.make_refusal()
    for x in ("Ich lehne diese Bitte ab.", "Darauf gebe ich keine Antwort.", "Je m'abstiens de répondre à cette question.", "No me es posible atender eso."):
        assert declines(q, x), x


def test_other_languages(judge):
    q = "What is a queue and when is it sorted?"
    for x in ("La coda conserva gli elementi nell'ordine in cui arrivano e li restituisce quando il programma li chiede.", "Varje plats i tabellen har en lista med element som har samma nyckel och den söks igenom."):
        assert judge(q, None, x, "en") == "language", x
    assert judge("What is a queue? Please answer in Italian.", None, "La coda conserva gli elementi nell'ordine in cui arrivano e li restituisce quando il programma li chiede.", "en") is None


def test_very_long_answers_take_linear_time(judge):
    import time

    q = "What is a queue and when is it sorted?"
    for answer in ("Yes." + " " * 300_000 + "No.", "." * 300_000 + "a", "for x " + "in y " * 60_000, "word " * 60_000, "`" * 100_001, "<a" * 100_000, "(" * 200_000 + "a queue", "\u200b" * 200_000, "I can't " * 20_000):
        began = time.perf_counter()
        judge(q, None, answer, "en")
        assert time.perf_counter() - began < 15, answer[:20]


def test_long_lead_before_a_copy(judge):
    q = "Explain in a few sentences how a queue of packets keeps its order when two writers push to it."
    assert judge(q, None, f"Here is what you would like to know about, as you asked me before: {q}", "en") == "copy"


def test_language(judge):
    german = "Die Lernrate fällt nach einigen Schritten, während der Fehler ungefähr gleich bleibt."
    assert judge("What is a queue and when is it sorted?", None, german, "en") == "language"
    assert judge("What is a queue and when is it sorted?", None, "Если список пуст, функция возвращает код и сообщение об ошибке.", "en") == "language"
    assert judge("Warum fällt der Fehler nach 3 Schritten?", None, ENGLISH, "de") == "language"
    assert judge("Warum fällt der Fehler nach 3 Schritten?", None, german, "de") is None
    assert judge("What is a queue? Please answer in German.", None, german, "en") is None
    assert judge("What is a queue? Please answer in German.", None, "Chaque élève résout des problèmes avant d'étudier la méthode générale.", "en") == "language"


def test_truncated(judge):
    q = "Explain in a few sentences how a queue works."
    for answer in (ENGLISH[:-20], ENGLISH + " Most readers start with the", ENGLISH + " It is because", "```python\ndef f(x):\n    return x + ", "def f(x):\n    return (x\n", "1. scan the linear queue\n2. merge the cold row\n3.", "1. scan the linear queue\n2. merge the cold row\n3. pack the", "This version sorts the input once:"):
        assert judge(q, None, answer, "en") == "truncated", answer
    for answer in (ENGLISH, "- scan the linear queue\n- merge the cold token\n- pack the dense tensor", "def f(x):\n    return x\n", "```python\ndef f(x):\n    return x\n```"):
        assert judge(q, None, answer, "en") is None, answer


def test_table(spark, data):
    df = table(spark, data, "sft_pairs")
    extra = df.withColumn("question", F.lit("clash")).withColumn("label", F.lit(1)).unionByName(df.limit(20).withColumn("question", F.lit("clash")).withColumn("label", F.lit(1)))
    out = pairs.pair_defects(extra)
    assert out.count() == extra.count()
    assert set(r["defect"] for r in out.select("defect").distinct().collect()) <= {None, "empty", "copy", "refusal", "language", "truncated"}
    assert pairs.found_pairs(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None, None, None)], "pair_id long, prompt string, response string, instruction string, input string, output string, lang string")
    assert [tuple(r) for r in pairs.found_pairs(blank).collect()] == [(1, "empty")]
