"""Problem 3: prompt and response pairs whose answer does not serve its question.

Method: the language of question and answer is the one with the highest posterior under naive Bayes over character
n-grams; an answer in another language than the question's (or than one the question asks for) is a defect. So is one of whose words
hardly any belong to the question's language, whatever language they are in. Truncation
is judged by the likelihood that a text ends where the answer ends, given its last words: n-grams of ends and of all
places are counted over complete lines and answers. Emptiness and copies are found by rules before that. A refusal is a sentence
that says of the speaker (or of the request) that an answer is not given: it is scored by what kinds of words it has, not by phrases,
and the score must outweigh what the rest of the answer adds to the question. Each pair has at most one defect, the first of:
empty, copy, refusal, language, truncated.

The language model is fitted on at most ``sample`` rows drawn by the hash of their id; the counts of ends are over all rows, and all rows
are judged. Null texts are empty; a pair without a question can only be empty or truncated. Repeated rows are judged alike; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.syntax import make_checker
from corpusmill.llm.tokens import uniform_language
from corpusmill.session import ship_by_value, spread

#: Answers that only hold a place, compared without case, blanks and surrounding punctuation.
PLACEHOLDERS = frozenset("n/a|na|n.a|tbd|tba|todo|to do|to be done|fixme|xxx|no answer|no response|no output|empty|blank|placeholder|null|nil|undefined|missing|not available|not applicable|answer|response|output|your answer here|insert answer here|lorem ipsum|keine antwort|pas de réponse|sin respuesta".split("|"))
#: Kinds of words of a refusing sentence, by language, with their weights: what is not done (without it nothing is refused), who does not do it,
#: what service is meant, words for the request, for what forbids it, and apologies. Compared in lower case with plain apostrophes.
REFUSAL_CUES = {
    "en": {
        "not": (3.0, r"can't|cannot|can not|couldn't|could not|won't|will not|wouldn't|would not|shouldn't|must not|unable|isn't (?:something|anything|possible)|(?:am|'m|is|are|be|was|were|'re)? ?not (?:be )?(?:able|going|allowed|permitted|comfortable|willing|something|anything|possible|appropriate|right|available|in a position|prepared|here to|meant to|supposed to)|(?:do not|don't) (?:feel|think i|answer|discuss|help|provide|do|give|have permission|offer|take|write|support|permit|allow)|declin\w*|refus\w*|rather not|prefer not|(?:must|have to|need to|going to|will have to|'ll have to|'ll) (?:pass|skip)|off[- ]limits|prohibit\w*|forb[ia]d\w*|(?:go|goes|is|are|be) against|outside (?:of )?(?:what|my|the scope)|beyond (?:what|my|the scope)|no way for|no (?:answer|help|response|explanation|solution)\b|to others|unanswered|sit this one out|prevents? me|steer clear"),
        "self": (1.0, r"i|i'm|i'd|i'll|me|my|myself|we|us|our|(?:this|an?|the) (?:ai|assistant|model|bot|chatbot|language model|text model)"),
        "service": (1.5, r"help\w*|assist|assisting|assistance|answer\w*|respond\w*|response|reply|replies|compl(?:y|ying)|provid\w+|discuss\w*|explain\w*|writ(?:e|ing)|solv(?:e|ing)|giv(?:e|en|ing)|offer\w*|shar(?:e|ing)|support|engag\w+|fulfil\w*|do that|do this|doing (?:this|that)|go(?:ing)? into|handl(?:e|ing)|address|produc(?:e|ing)|generat(?:e|ing)|work on|accommodat\w+|talk(?:ing)? about|get into|take on|continue"),
        "request": (1.0, r"(?:this|that|your|such|the|these|those|that kind of|this kind of|of this|of that) (?:request|question|topic|task|query|one|subject|matter|kind|sort|thing|conversation)s?"),
        "bound": (1.5, r"guidelines?|polic(?:y|ies)|rules|scope|instructions|programming|programmed|restrictions?|permit\w*|allow\w*|authori[sz]\w+|comfortable|appropriate|position|off[- ]limits"),
        "sorry": (1.0, r"sorry|apolog\w+|afraid|unfortunately|regret\w*|forgive|i appreciate|thanks for|thank you for|as an? (?:\w+ )?(?:ai|model|assistant|bot)"),
    },
    "de": {
        "not": (3.0, r"nicht|ablehn\w*|lehne|passen|verweiger\w*|absagen|unmöglich|außerstande|keine (?:antwort|auskunft|hilfe)|verzichte\w*"),
        "self": (1.0, r"ich|mir|mich|meine?\w*|wir|uns"),
        "service": (1.5, r"helfen|hilfe|weiterhelfen|behilflich|\w*antwort\w*|äußern|unterstütz\w*|erklär\w*|nachkomm\w*|schreiben|bearbeit\w*|auskunft|besprechen|eingehen|diskutier\w*|dienen|ablehnen|passen|leisten|erfüllen"),
        "request": (1.0, r"diese\w* (?:anfrage|frage|bitte|thema|aufgabe|anliegen|wunsch)|ihr\w* (?:anfrage|frage|bitte|anliegen)|dazu|dabei|damit|darauf|hierzu|hier|das|daran"),
        "bound": (1.5, r"darf|dürfen|erlaubt|gestattet|richtlinien|regeln|vorgaben|befugt|berechtigt|möglich"),
        "sorry": (1.0, r"leid|leider|bedauer\w*|entschuldig\w*|verzeih\w*"),
    },
    "fr": {
        "not": (3.0, r"(?:ne|n')(?: \w+){1,3} pas|ne pas|ne (?:saurais|puis|peux)|impossible|refus\w*|déclin\w*|dépasse|sort de|sors de|hors de|non autorisé\w*|pas (?:autorisé|en mesure|possible)|m'abst\w+|regrette"),
        "self": (1.0, r"je|j'\w+|me|m'\w+|mon|ma|mes|moi|nous|cet assistant"),
        "service": (1.5, r"répon\w+|aid\w+|fourni\w*|traiter|expli\w+|écrire|donner|discuter|satisfaire|assister|faire|aborder|parler|accéder|résoudre"),
        "request": (1.0, r"(?:cette|votre|ta|la) (?:demande|question|requête|tâche)|(?:ce|votre) (?:sujet|thème|point)|cela|ça"),
        "bound": (1.5, r"autoris\w+|permis\w*|permet\w*|règles|consignes|directives|mesure|impossible"),
        "sorry": (1.0, r"désolée?|regrett\w+|malheureusement|pardon\w*|excus\w+|navrée?|préf\w+"),
    },
    "es": {
        "not": (3.0, r"no|imposible|rehús\w+|declin\w+|me niego|fuera de|rechaz\w+|abstener\w*"),
        "self": (1.0, r"yo|me|mi|mis|puedo|podré|podría|debo|quiero|voy|prefiero|preferiría|temo|siento|lamento|estoy|soy|tengo|nos|mí"),
        "service": (1.5, r"ayud\w+|contest\w+|respond\w+|respuesta|hacer\w*|explic\w+|atend\w+|dar\w*|ofrec\w+|proporcion\w+|tratar\w*|escrib\w+|coment\w+|habl\w+|resolv\w+|cumpl\w+"),
        "request": (1.0, r"(?:esa|esta|ese|este|su|tu) (?:petición|cuestión|pregunta|solicitud|tema|tarea|asunto)|eso|esto|ello"),
        "bound": (1.5, r"permit\w+|autoriz\w+|normas|reglas|directrices|condiciones|capacitad\w+|posible"),
        "sorry": (1.0, r"siento|lament\w+|temo|perd[oó]n\w*|disculp\w+|desgraciadamente|lamentablemente"),
    },
}
#: What looks like a refusal and is none: idioms, and answers that only set a limit to themselves.
NO_REFUSAL = r"(?:can't|cannot|can not|couldn't|could not) (?:help|resist) (?:but|\w+ing)\b|\b(?:at length|in (?:full )?(?:detail|depth)|exhaustively|ausführlich|im einzelnen|en détail|longuement|en detalle|a fondo)\b|\b(?:if|when|wenn|si|lorsque|cuando)\b[^.;]*\b(?:i|ich|je|yo)\b"
#: A sentence of this score refuses; each word that the rest of the answer adds beyond ``FREE_WORDS`` takes ``PER_WORD`` off.
REFUSES, FREE_WORDS, PER_WORD = 5.0, 14, 0.25
#: Questions for which a refusal, a repetition or another language is what was asked for.
ASKS_REFUSAL = r"refus|declin|reject|turn(?:ing)? down|apolog|cannot|can't|unable|error message|the message|ablehn|absage|verweiger|refus|déclin|rechaz|declin|negativa"
ASKS_REPEAT = r"\b(?:repeat|echo|copy|quote|say back|write out|reproduce|wiederhole|kopiere|zitiere|gib .{0,20}wieder|répète|répétez|recopie|copie|repite|repita|copia|fix the|correct|proofread|rewrite|rephrase|edit|korrigiere|berichtige|corrige|corrigez|reformule|corrija)\b"
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|anglais|inglés", "de": r"german|deutsch\w*|allemand|alemán", "fr": r"french|französisch\w*|français|francés", "es": r"spanish|spanisch\w*|espagnol|español",
    "cyrillic": r"russian|russisch\w*|russe|ruso|ukrainian|bulgarian", "han": r"chinese|chinesisch\w*|chinois|chino|mandarin", "kana": r"japanese|japanisch\w*|japonais|japonés", "hangul": r"korean|koreanisch\w*|coréen|coreano", "arabic": r"arabic|arabisch\w*|arabe|árabe", "greek": r"greek|griechisch\w*|grec|griego",
}
ASKS_TRANSLATION = r"\b(?:translat\w+|übersetz\w+|tradui\w+|traduc\w+|traduzca)\b"
#: Scripts that stand for a language of their own, with the ranges of their letters.
SCRIPT_RANGES = {"cyrillic": ((0x400, 0x52F),), "greek": ((0x370, 0x3FF),), "arabic": ((0x600, 0x6FF),), "hebrew": ((0x590, 0x5FF),), "devanagari": ((0x900, 0x97F),), "thai": ((0xE00, 0xE7F),), "kana": ((0x3040, 0x30FF),), "hangul": ((0xAC00, 0xD7AF),), "han": ((0x3400, 0x9FFF),)}

FENCE = re.compile(r"```[^\n`]*\n?.*?(?:```|\Z)", re.S)
CODE_LINE = re.compile(r"^\s*(?:def |async def |class \w+[:(]|@\w|import \w|from \w+ import |return\b.*[(\[+=]|for \w+(?:(?! in ).)* in .*:$|while .*:$|if .*:$|elif .*:$|else:$|try:$|except\b.*:$|with .*:$|raise \w|assert |print\(|[\w.\[\]]+ ?[+*/-]?= ?\S|(?:public|private|static|func|function|const|let|var|package|#include)\b)")
ITEM = re.compile(r"^\s*(?:\d+[.)]|[-*•+])(?:\s+(.*)|)$")
WORDS = re.compile(r"\w+(?:\.\w+)*|[^\w\s]")


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").casefold())


def condensed(text: str | None) -> str:
    """The letters and digits of a text alone, without case."""
    return "".join(plain_words(text))


def prose_of(text: str) -> str:
    """The text without code: fenced blocks, code spans, lines of code."""
    text = re.sub(r"`[^`\n]*`", " ", FENCE.sub("\n", text))
    return "\n".join(line for line in text.split("\n") if not CODE_LINE.match(line))


def is_bare_code(text: str) -> bool:
    lines = [line for line in text.split("\n") if line.strip()]
    return bool(lines) and "```" not in text and bool(CODE_LINE.match(lines[0])) and sum(bool(CODE_LINE.match(x)) or x[:1] in " \t)]}#" for x in lines) >= 0.6 * len(lines)


def without_end(text: str, kind: re.Pattern) -> str:
    """The text without the characters of a kind at its end. (A search for them from the front takes quadratic time on long runs.)"""
    at = len(text)
    while at and kind.match(text, at - 1):
        at -= 1
    return text[:at]


class LanguageModel:
    """Naive Bayes over character 1- to 3-grams of words. Scripts unlike Latin are languages with a flat letter model."""

    def __init__(self, texts: list[tuple[str, str]], order: int = 3, smooth: float = 0.5):
        self.order = order
        counts: dict[str, Counter] = defaultdict(Counter)
        for label, text in texts:
            grams = counts[label]
            for word in self.words(text):
                grams.update(self.grams(word))
        seen: dict[str, Counter] = defaultdict(Counter)
        for label, text in texts:
            seen[label].update(set(self.words(text)))
        #: Words of each language that more than one text has: most words of any text in the language are among its commonest.
        self.common = {label: frozenset(w for w, n in words.items() if n > 1 and len(w) > 1) for label, words in seen.items()}
        self.labels = sorted(counts)
        vocabulary = len(set().union(*counts.values())) + 1 if counts else 1
        totals = {x: sum(counts[x].values()) + smooth * vocabulary for x in self.labels}
        self.unseen = [math.log(smooth / totals[x]) for x in self.labels]
        self.logs = {g: [math.log((counts[x][g] + smooth) / totals[x]) for x in self.labels] for g in set().union(*counts.values())} if counts else {}
        self.known: dict[str, list[float]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    @staticmethod
    def words(text: str) -> list[str]:
        return re.findall(r"[^\W\d_]+", text.lower())

    def grams(self, word: str) -> list[str]:
        padded = f" {word} "
        return [padded[i : i + n] for n in range(1, self.order + 1) for i in range(len(padded) - n + 1)]

    def share(self, words: list[str], label: str) -> float:
        """The share of the words that are common in a language."""
        known = self.common.get(label, frozenset())
        return sum(w in known for w in words) / max(1, len(words))

    def script(self, text: str) -> str | None:
        """The script that most letters have, if it is not Latin."""
        if text.isascii():
            return None
        letters = [ord(ch) for ch in text if ch.isalpha()]
        if not letters:
            return None
        hits = Counter(name for code in letters if code > 0x36F for name, ranges in SCRIPT_RANGES.items() if any(a <= code <= b for a, b in ranges))
        if hits.get("kana"):
            hits["kana"] += hits.pop("han", 0)
        name, n = hits.most_common(1)[0] if hits else (None, 0)
        # A letter of these scripts says as much as two or three Latin ones.
        return name if 2.5 * n > len(letters) - n else None

    def posterior(self, text: str, prior: str | None = None, weight: float = 3.0) -> tuple[str | None, float]:
        """The most probable language and its log-odds against the next one."""
        name = self.script(text)
        if name:
            return name, 99.0
        words = self.words(text)
        if not words or not self.labels:
            return None, 0.0
        total = [weight if x == prior else 0.0 for x in self.labels]
        for word in words:
            hit = self.known.get(word)
            if hit is None:
                if len(self.known) > 200_000:
                    self.known.clear()
                rows = [self.logs.get(g, self.unseen) for g in self.grams(word)]
                hit = self.known[word] = [sum(column) for column in zip(*rows)]
            for k, value in enumerate(hit):
                total[k] += value
        ranked = sorted(zip(total, self.labels), reverse=True)
        return ranked[0][1], (ranked[0][0] - ranked[1][0] if len(ranked) > 1 else 99.0)


class EndModel:
    """How often a text ends after given last words. Digits are one class, names in the middle of a sentence another."""

    #: Its counts, by name; each is of token tuples but the vocabulary, of words, and bare, of texts of code alone.
    COUNTS = ("all", "ends", "item_all", "item_ends", "vocabulary", "bare")

    def __init__(self, answers: list[str]):
        self.start()
        self.add(answers)
        self.settle()

    @classmethod
    def of_rows(cls, rows: DataFrame, column: str) -> EndModel:
        """The model of all texts of a column: counted in the workers, and of the sums only those that reach the thresholds come to the driver."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                part = cls.__new__(cls)
                part.start()
                part.add([t for t in batch[column] if t and t.strip()])
                found = [(name, json.dumps(key), n) for name in cls.COUNTS for key, n in getattr(part, name).items()]
                yield pd.DataFrame(found, columns=["name", "key", "n"])

        sums = rows.select(column).mapInPandas(count, "name string, key string, n long").groupBy("name", "key").agg(F.sum("n").alias("n"))
        model = cls.__new__(cls)
        model.start()
        for r in sums.where((F.col("n") >= 2) | (F.col("name") == "bare")).toLocalIterator():
            key = json.loads(r["key"])
            getattr(model, r["name"])[tuple(key) if isinstance(key, list) else key] = r["n"]
        model.settle()
        return model

    def start(self) -> None:
        for name in self.COUNTS:
            setattr(self, name, Counter())

    def add(self, answers: list[str]) -> None:
        for text in answers:
            if is_bare_code(text):
                self.bare["all"] += 1
                self.bare["ended"] += text.endswith("\n")
            prose = prose_of(text)
            lines = [line for line in prose.split("\n") if line.strip()]
            for k, line in enumerate(lines):
                item = ITEM.match(line)
                tokens = self.tokens(item.group(1) or "" if item else line)
                self.vocabulary.update(t for t in tokens if t.isalpha())
                if item and k + 1 == len(lines):
                    continue  # it may be cut, and would speak against its own words
                whole, ends = (self.item_all, self.item_ends) if item else (self.all, self.ends)
                for i in range(len(tokens)):
                    for n in (1, 2, 3):
                        if i + 1 >= n:
                            whole[tuple(tokens[i + 1 - n : i + 1])] += 1
                    if i >= 2:
                        whole[tokens[i - 2], None, tokens[i]] += 1
                if not item and len(lines) == 1:
                    for n in range(2, min(len(tokens), 12) + 1):
                        self.all[self.opening(tokens[:n])] += 1
                    if len(tokens) <= 12:
                        self.ends[self.opening(tokens)] += 1
                if item or k + 1 == len(lines):
                    for n in (1, 2, 3):
                        if len(tokens) >= n:
                            ends[tuple(tokens[-n:])] += 1
                    if len(tokens) >= 3:
                        ends[tokens[-3], None, tokens[-1]] += 1

    def settle(self) -> None:
        self.code_ends_line = self.bare["all"] >= 20 and self.bare["ended"] > 0.9 * self.bare["all"]
        words = sorted(w for w, n in self.vocabulary.items() if n >= 3)
        self.longer = {w[:k] for w in words for k in range(1, len(w))}
        self.vocabulary = Counter({w: n for w, n in self.vocabulary.items() if n >= 2})
        for counter in (self.all, self.ends, self.item_all, self.item_ends):
            for key in [k for k, n in counter.items() if n < 2]:
                del counter[key]

    @staticmethod
    def tokens(line: str) -> list[str]:
        out: list[str] = []
        for token in WORDS.findall(line):
            if token[0].isdigit():
                token = re.sub(r"\d+", "0", token)
            elif token[0].isupper() and out and out[-1] not in ".!?:\"'":
                token = "Name"
            else:
                token = token.lower()
            out.append(token)
        return out

    @staticmethod
    def opening(tokens: list[str]) -> tuple:
        """The key of a short text: its length, its first word and its last one."""
        return len(tokens), tokens[0], tokens[-1], "^"

    def probability(self, tokens: list[str], item: bool, least: int = 3) -> float | None:
        """Share of the places after these last words at which a text (or list item) ends; None for words never met."""
        whole, ends = (self.item_all, self.item_ends) if item else (self.all, self.ends)
        key = self.opening(tokens)
        if whole[key] >= least:
            return ends[key] / whole[key]
        skip = [(tokens[-3], None, tokens[-1])] if len(tokens) >= 3 else []
        for key in (tuple(tokens[-3:]), tuple(tokens[-2:]), *skip, tuple(tokens[-1:])):
            if whole[key] >= least:
                return ends[key] / whole[key]
        return None

    def cut_word(self, word: str) -> bool:
        """A word hardly ever met that is the beginning of longer, known ones."""
        return self.vocabulary[word] < 2 and word in self.longer


def fit_languages(rows: list[tuple[int, str | None, str | None, str | None]]) -> LanguageModel:
    """The language model from labelled rows (id, question, answer, language)."""
    asks = re.compile(ASKS_TRANSLATION + "|" + "|".join(LANGUAGE_NAMES.values()), re.I)
    texts = []
    for _, question, answer, language in rows:
        if language in LANGUAGE_NAMES and question:
            texts.append((language, prose_of(question)))
            if answer and not asks.search(question):
                texts.append((language, prose_of(answer)))
    return LanguageModel(texts)


def fit(rows: list[tuple[int, str | None, str | None, str | None]]) -> tuple[LanguageModel, EndModel]:
    """Both models from labelled rows (id, question, answer, language)."""
    return fit_languages(rows), EndModel([answer for _, _, answer, _ in rows if answer and answer.strip()])


class _Visible(dict):
    """Translation table of the characters beyond ASCII, filled on demand: kinds of space become a blank, characters without ink go."""

    def __missing__(self, code: int):
        kind = unicodedata.category(chr(code))
        hit = self[code] = " " if kind in ("Zs", "Zl", "Zp", "Cc") else None if kind in ("Cf", "Mn") or chr(code) in "ㅤᅟᅠ⠀" else code
        return hit


def make_refusal():
    """A function (question, prose of the answer) -> whether the answer declines, by the kinds of words of its sentences."""
    cues = {lang: {kind: (weight, re.compile(rf"(?<![\w'])(?:{p})(?![\w])")) for kind, (weight, p) in kinds.items()} for lang, kinds in REFUSAL_CUES.items()}
    some = re.compile("|".join(rf"(?<![\w'])(?:{kinds['not'][1]})(?!\w)" for kinds in REFUSAL_CUES.values()))
    every = {lang: re.compile(rf"(?<![\w'])(?:{'|'.join(p for _, p in kinds.values())})(?!\w)") for lang, kinds in REFUSAL_CUES.items()}
    no_refusal = re.compile(NO_REFUSAL)
    sentences = re.compile(r"(?<=[.!?;:])\s+|\n+")
    words = re.compile(r"[^\W\d_]{4,}")

    def score(sentence: str) -> tuple[float, str]:
        best, of = 0.0, ""
        for lang, kinds in cues.items():
            weight, pattern = kinds["not"]
            hit = pattern.search(sentence)
            if not hit:
                continue
            found = {kind for kind, (_, p) in kinds.items() if kind != "not" and p.search(sentence)}
            # The speaker, the request or a sentence that begins with the refusal: else something else is what cannot be done.
            if not found & {"self", "sorry", "request"} and hit.start() > 2:
                continue
            total = weight + sum(kinds[kind][0] for kind in found) + (1.0 if hit.start() <= 2 else 0.0)
            if total > best:
                best, of = total, lang
        return best, of

    def refuses(question: str, prose: str) -> bool:
        text = prose.lower().replace("’", "'")
        if not some.search(text):
            return False
        told, rest, lang = 0.0, [], ""
        for sentence in sentences.split(text):
            value, of = (0.0, "") if no_refusal.search(sentence) else score(sentence)
            if value >= REFUSES:
                told, lang = told + value, of
            else:
                rest.append(sentence)
        if told < REFUSES:
            return False
        asked = set(words.findall(question.lower()))
        added = {w for sentence in rest for w in words.findall(every[lang].sub(" ", sentence))} - asked
        return told - PER_WORD * max(0, len(added) - FREE_WORDS) >= REFUSES

    return refuses


def make_judge(languages: LanguageModel, ends: EndModel):
    """A function (question, input, answer, language label) -> defect or None."""
    check = make_checker()
    declines = make_refusal()
    asks_refusal, asks_repeat, asks_translation = (re.compile(p, re.I) for p in (ASKS_REFUSAL, ASKS_REPEAT, ASKS_TRANSLATION))
    language_names = {name: re.compile(rf"\b(?:{p})\b", re.I) for name, p in LANGUAGE_NAMES.items()}
    tags = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
    table = _Visible()
    controls = re.compile(r"[\x00-\x1f\x7f]")
    letter, not_letter, closing = re.compile(r"[^\W_]"), re.compile(r"[\W_]"), re.compile(r"[\s\"'”’»)\]*_]")

    def empty(answer: str | None) -> bool:
        if answer is None:
            return True
        visible = controls.sub(" ", answer) if answer.isascii() else answer.translate(table)
        inner = re.sub(r"```[\w+-]*", " ", tags.sub(" ", visible) if "<" in visible else visible)
        if not inner.strip():
            return True
        first = letter.search(inner)
        if first:
            core = inner[first.start() : len(without_end(inner, not_letter))]
            return " ".join(core.casefold().split()) in PLACEHOLDERS
        return not re.search(r"[\[\]{}()0-9]|\"\"|''", inner) and not re.fullmatch(r"\s*(?:[=<>!]=?|[+*/%^&|~])\s*", inner)

    def copied(question: str, extra: str | None, answer: str) -> bool:
        # A copy ends with what its question or the input ends with; only then are whole texts compared.
        last = condensed(answer[-200:])[-6:]
        if len(last) == 6 and not any(t and condensed(t[-200:]).endswith(last) for t in (question, extra)):
            return False
        given, main, whole, added = (condensed(x) for x in (answer, question, f"{question} {extra or ''}", extra))
        if not given:
            return False
        if given in (main, whole):
            return True
        if len(added) >= 20 and given == added:
            return not asks_repeat.search(question)
        for source in {whole, main}:
            at = given.find(source) if len(source) >= 12 else -1
            # What stands before announces the question and is not longer than it; after it only the question again.
            if at < 0 or at > max(48, len(source)):
                continue
            rest = given[at:]
            while rest.startswith(source):
                rest = rest[len(source) :]
            if rest in ("", added):
                return True
        return False

    def foreign(question: str, prose: str, label: str | None) -> bool:
        name = languages.script(prose)
        words = languages.words(prose)
        letters = sum(map(len, words))
        if letters < (4 if name else 15) or (not name and len(words) < 4):
            return False
        spoken, odds = (name, 99.0) if name else languages.posterior(prose)
        asked, _ = languages.posterior(prose_of(question), label)
        if spoken is None or asked is None:
            return False
        if not name and len(words) >= 8:
            # Words of the topic are the same in all languages; of a language's own text far more are common.
            own = languages.share([w for w in words if len(w) > 1], asked)
            if own < 0.15 and max(languages.share(words, x) for x in languages.labels) < 0.3 and languages.share(languages.words(question), asked) > 0.3:
                spoken, odds = "other", 99.0
        if spoken == asked or odds < 5.0:
            return False
        wanted = {x for x, p in language_names.items() if p.search(question)}
        if spoken in wanted or spoken == "other" and asks_other.search(question):
            return False
        return bool(wanted) or not asks_translation.search(question)

    asks_other = re.compile(r"\b(?:in|into|auf|ins|en|al|au)\s+(?:[A-ZÄÖÜ]\w+(?:ish|ian|ese|isch|ch|o)|italien|portugais|néerlandais|italiano|portugués|neerlandés)\b")

    def truncated(answer: str) -> bool:
        if answer.count("```") % 2:
            return True
        for block in re.findall(r"```(?:python|py)[ \t]*\n(.*?)```", answer, re.S):
            if check("python", block) in ("premature_end", "literal"):
                return True
        if is_bare_code(answer):
            return check("python", answer) in ("premature_end", "literal") or (ends.code_ends_line and not answer.endswith("\n"))
        text = answer.rstrip()
        if text.endswith("```"):
            return False
        tail = re.split(r"```", text)[-1]
        lines = [line for line in tail.split("\n") if line.strip()]
        last = lines[-1]
        item = ITEM.match(last)
        if item:
            body = (item.group(1) or "").strip()
            if not body:
                return True
            siblings = [ITEM.match(x) for x in lines[:-1]]
            if body[-1] in ".!?)\"'`":
                return False
            if any(m and (m.group(1) or "").strip()[-1:] in ".!?" for m in siblings):
                return True
            tokens = ends.tokens(body)
            if ends.cut_word(tokens[-1]):
                return True
            share = ends.probability(tokens, True)
            return share is not None and share < 0.25 if siblings else False
        core = without_end(last, closing)
        if not core or core[-1] in "!?。！？…":
            return False
        if core[-1] == ".":
            return _cut_decimal(core)
        if core[-1] in ",;:-–—(/=+&<":
            return True
        if re.search(r"[.!?。！？][\"'”’»)\]*_]*(?:\s|$)", tail[: len(tail) - len(last)] + re.sub(r"\b\d+\.", "", last)) and re.search(r"[^\W\d_]", core):
            return True
        if re.search(r"[⺀-鿿]$", core):
            return True
        tokens = ends.tokens(last)
        if len(plain_words(last)) <= 1 or not re.search(r"[^\W\d_]{2}", last):
            return False
        if ends.cut_word(tokens[-1]):
            return True
        share = ends.probability(tokens, False)
        if share is None:
            return last.lstrip()[:1].isupper() and len(plain_words(last)) >= 5
        return share < 0.3

    def _cut_decimal(core: str) -> bool:
        """Whether a text ends within a decimal number: where the same words are otherwise followed by one."""
        tokens = ends.tokens(core)
        if len(tokens) < 3 or tokens[-2] != "0":
            return False
        broken, whole = ends.all[tuple(tokens[-3:])], ends.all[(tokens[-3], "0.0")]
        return whole >= 5 and broken * 10 < whole

    def judge(question: str | None, extra: str | None, answer: str | None, label: str | None) -> str | None:
        if empty(answer):
            return "empty"
        if question and question.strip():
            if copied(question, extra, answer):
                return "copy"
            prose = prose_of(answer)
            if declines(question, prose) and not asks_refusal.search(question):
                return "refusal"
            if foreign(question, prose, label):
                return "language"
        return "truncated" if truncated(answer) else None

    return judge


def _shaped(pairs: DataFrame) -> DataFrame:
    """pair_id, question, extra (the input), answer, label."""
    first = F.col("prompt").isNotNull() | F.col("response").isNotNull()
    return pairs.select(
        "pair_id", F.when(first, F.col("prompt")).otherwise(F.col("instruction")).alias("question"), F.when(~first, F.col("input")).alias("extra"),
        F.when(first, F.col("response")).otherwise(F.col("output")).alias("answer"), uniform_language(F.col("lang")).alias("label"),
    )


def drawn_rows(rows: DataFrame, sample: int) -> list:
    """At most ``sample`` rows, those with the smallest hash of their id.

    Only rows whose hash lies below a bound that about ``2 * sample`` rows keep are ordered, so no task and not the driver meets more.
    """
    n = rows.count()
    hashed = F.xxhash64(F.lit("sample"), F.col("pair_id").cast("string"))
    share = min(1.0, 2.0 * sample / max(1, n))
    near = rows.where(F.pmod(hashed, F.lit(1 << 40)) < int(share * (1 << 40)))
    return near.orderBy(F.pmod(hashed, F.lit(1 << 40)), "pair_id").limit(sample).select("pair_id", "question", "answer", "label").collect()


def pair_defects(pairs: DataFrame, sample: int = 5_000) -> DataFrame:
    """pair_id and defect (null if the answer serves) of every row.

    The language model is fitted on ``sample`` labelled rows; the counts of ends are over all rows.
    """
    ship_by_value()
    rows = _shaped(pairs)
    models = fit_languages([tuple(r) for r in drawn_rows(rows, sample)]), EndModel.of_rows(spread(rows), "answer")
    # Pickled by value: workers need no copy of the package.
    shared = pairs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))

    def judged(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        judge = make_judge(*cloudpickle.loads(shared.value))
        for batch in batches:
            yield pd.Series([judge(*row) for row in zip(*batch)], dtype=object)

    judge = F.pandas_udf(judged, "string")
    columns: list[Column] = [F.col(c) for c in ("question", "extra", "answer", "label")]
    return spread(rows).select("pair_id", judge(*columns).alias("defect"))


def found_pairs(pairs: DataFrame, sample: int = 5_000) -> DataFrame:
    """(pair_id, defect) of the defective pairs."""
    return pair_defects(pairs, sample).where(F.col("defect").isNotNull())
