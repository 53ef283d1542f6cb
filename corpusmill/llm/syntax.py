"""Problem 5: source files that their language does not accept.

Method: one lexer per language takes out strings and comments and notes literals that never end; a pushdown stack of
delimiters reduces the rest until only unmatched ones are left; the reduced text shows the top level of the
file, whose statements must be ones the language has there. At every depth, operators without a right side, operands side by
side and jumps without an end are looked for. Merge-conflict markers, neighbouring operands without an operator, broken block structure (a stack of indentations in Python) and premature ends are found in what the
lexer left. A Python text that the lexer rejects is then put before Python's own compiler (never run), which can only
acquit it.

The language is that of the path's extension; other extensions, null or blank paths and null or blank texts give
no verdict. Texts are read whole. Repeated rows get their own verdicts, other columns are ignored, an empty table gives none.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.splits import repository
from corpusmill.session import ship_by_value, spread

#: Extensions by language.
EXTENSIONS = {"py": "python", "pyi": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "go": "go", "c": "c", "h": "c"}

STRING, PAREN, BRACKET, BRACE, BAD = "\x02", "\x03", "\x05", "\x04", "\x06"
#: Literals by their opening character. Every alternative begins with one fixed character, so that scanning is fast;
#: a literal that never ends is matched without its closing mark.
DOUBLE, SINGLE = r'"(?:[^"\\\n]+|\\.)*+"?', r"'(?:[^'\\\n]+|\\.)*+'?"
TRIPLE_DOUBLE = r'"(?:""(?:[^"\\]+|\\.|"(?!""))*+(?:"""|\Z)|(?:[^"\\\n]+|\\.)*+"?)'
TRIPLE_SINGLE = TRIPLE_DOUBLE.replace('"', "'")
RAW = r"`[^`]*+`?"
TEMPLATE = r"`(?:[^`\\$]+|\\.|\$(?!\{)|\$\{(?:[^{}`]+|\{[^{}]*\}|`[^`]*`)*+\})*+`?"
COMMENTS = r"/(?:/[^\n]*+|\*(?:[^*]+|\*(?!/))*+(?:\*/|\Z))"
REGEX = r"/(?:/[^\n]*+|\*(?:[^*]+|\*(?!/))*+(?:\*/|\Z)|(?:[^/*\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]|\\.)*+\])*+/[a-z]*+)?"
LEXERS = {
    "python": "|".join((r"\#[^\n]*+", TRIPLE_DOUBLE, TRIPLE_SINGLE)),
    "javascript": "|".join((REGEX, DOUBLE, SINGLE, TEMPLATE)),
    "java": "|".join((COMMENTS, TRIPLE_DOUBLE, SINGLE)),
    "go": "|".join((COMMENTS, DOUBLE, SINGLE, RAW)),
    "c": "|".join((COMMENTS, r"\#(?:[^\n\\/]+|\\.|/\*(?:[^*]+|\*(?!/))*+\*/|/(?!\*))*+", DOUBLE, SINGLE)),
}
#: Reserved words, and those that may follow an operand.
PY_WORDS = frozenset("False None True and as assert async await break case class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try type while with yield _".split())
PY_OPENERS = frozenset("if elif else for while try except finally with def class async match case".split())
PY_HEADED = frozenset("if elif else for while try finally with def class async".split())
PY_NEVER_AFTER = frozenset("await lambda def class return pass del raise try while global nonlocal True False None break continue yield assert".split())
PY_DANGLING = frozenset("import from in not and or is if elif for while def class lambda as del assert global nonlocal with await async".split())
JS_WORDS = frozenset("async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new of return set static super switch this throw try typeof var void while with yield as null true false".split())
JS_AFTER = frozenset("in of instanceof extends as from".split())
JS_RESERVED = frozenset("import function class const var return if for while export switch throw try new typeof else case default do finally catch void delete this null true false".split())
#: Characters and operators that a language does not have outside literals and comments.
FORBIDDEN = {"javascript": ("@", "\\", ":=", "->"), "java": ("#", "`", "\\", "=>", "===", ":="), "go": ("#", "?", "@", "$", "\\", "===", "=>", "->"), "c": ("@", "`", "$", "=>", "===", ":=")}
MARKS = ("<<<<<<<", ">>>>>>>", "|||||||", "=======")
CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?:[ \t].*)?$|^={7}[ \t]*$", re.M)
JAVA_TOP = re.compile(r"\s+|;|package\s+[\w.]+\s*;|import\s+(?:static\s+)?[\w.]+(?:\.\*)?\s*;|(?:@[\w.]+\s*\x03?\s*)*(?:(?:public|protected|private|abstract|final|static|strictfp|sealed|non-sealed)\s+)*(?:class|interface|enum|record|@interface)\s+\w+[^;\x04\x02]*\x04|(?:open\s+)?module\s+[\w.]+\s*\x04")
GO_TOP = re.compile(r"\s+|;|package[ \t]+\w+|import[ \t]*(?:(?:[\w.]+[ \t]+)?\x02|\x03)|func[ \t]*(?:\x03[ \t]*)?\w+[ \t]*\x05?\x03[^\n\x04\x02]*(?:\x04(?=[ \t]*\w|[ \t]*\x03|[ \t]*\x04)[^\n\x04]*)?\x04|(?:var|const)[ \t]*(?:\x03|\w+[^\n]*[^\s=:+\-*/&|,.][ \t]*$)|type[ \t]*(?:\x03|\w+[ \t]*\x05?[ \t]*[^\n]*[^\s,.=][ \t]*$)", re.M)
C_BASE = "typedef|static|extern|const|volatile|inline|struct|union|enum|unsigned|signed|void|char|short|int|long|float|double|register|auto"
C_SEGMENT = re.compile(rf"\s*(?:(?:{C_BASE}|_\w+)\b|[A-Za-z_]\w*\s*\x03\s*$|[A-Za-z_]\w*(?:[\s*]+[A-Z_][A-Z0-9_]*)?[\s*]+[A-Za-z_]\w*\s*(?:[=,:\x03\x05]|$))")
C_MACROS = re.compile(r"(?:\s*[A-Z_][A-Z0-9_]*\b(?:\s*\x03)?)+\s*")
C_WORD = rf"(?!(?:{C_BASE}|return|else|do|goto|case|if|for|while|switch|sizeof|break|continue|default|_\w+|[A-Z_][A-Z0-9_]*)\b)[A-Za-z_]\w*"
THREE_NAMES = re.compile(rf"(?<![\w.]){C_WORD}\s+{C_WORD}\s+{C_WORD}")
DELIMITERS = re.compile(r"([()\[\]{}])")
CLOSING = {"(": ")", "[": "]", "{": "}"}
SYMBOL = {"(": PAREN, "[": BRACKET, "{": BRACE}


def top_level(bare: str) -> tuple[str | None, str | None]:
    """The pushdown stack: (text outside all delimiters with one symbol for each matched group, defect)."""
    parts = DELIMITERS.split(bare)
    out, stack = [parts[0]], []
    for k in range(1, len(parts), 2):
        ch = parts[k]
        if ch in CLOSING:
            if not stack:
                out.append(SYMBOL[ch])
            stack.append(CLOSING[ch])
        elif not stack or stack.pop() != ch:
            return None, "delimiter"
        if not stack:
            out.append(parts[k + 1])
    return ("".join(out), None) if not stack else (None, "premature_end")


def make_checker():
    """A function (language, text) -> name of the defect, or None."""
    lexers = {name: re.compile(p, re.S) for name, p in LEXERS.items()}
    before_regex = re.compile(r"(?:\A|[(,=:\[!&|?{};+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|do|else))\Z")

    def quoted(literal: str) -> str:
        mark = literal[0] * 3 if literal[:3] == literal[0] * 3 else literal[0]
        whole = len(literal) >= 2 * len(mark) and literal.endswith(mark)
        return STRING if whole or literal == mark[0] * 2 else BAD

    def taken(m: re.Match) -> str:
        found = m.group()
        if found[0] in "\"'`":
            return quoted(found)
        if found[0] == "#" or found[:2] == "//":
            return " "
        return (" " if "\n" not in found else "\n") if len(found) > 3 and found.endswith("*/") else BAD

    def taken_js(m: re.Match) -> str:
        found = m.group()
        if found[0] != "/" or found[1:2] in ("/", "*"):
            return taken(m)
        if len(found) == 1:
            return found
        at = m.start()
        while at and m.string[at - 1] in " \t":
            at -= 1
        # Twelve characters hold the longest word that may stand before a pattern.
        return STRING if before_regex.search(m.string[max(0, at - 12) : at]) else "/" + lexers["javascript"].sub(taken_js, found[1:])

    def taken_py(m: re.Match) -> str:
        found = m.group()
        return "" if found[0] == "#" else quoted(found)

    expressions = _expression_rules()
    take = {"python": taken_py, "javascript": taken_js}
    rules = {"python": _python_rules(), "javascript": _javascript_rules(), "c": _c_rules, "java": lambda _, top: _declarations("java", top), "go": lambda _, top: _declarations("go", top)}

    def check(language: str, text: str) -> str | None:
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        text = text.lstrip("﻿")
        if language == "javascript" and text.startswith("#!"):
            text = text.partition("\n")[2]
        own = language == "c" and "#" in text and C_OWN.search(text)
        if own and CONDITIONAL.search(text):
            text = one_branch(text)
        bare = lexers[language].sub(take.get(language, taken), text)
        if any(mark in bare for mark in MARKS) and CONFLICT.search(bare):
            return "conflict"
        if BAD in bare:
            return "literal"
        top, defect = top_level(bare)
        if defect:
            return defect
        if language != "python" and (bare.lstrip()[:1] == "<" or any(x in bare for x in FORBIDDEN[language])):
            return "foreign"
        if language != "python" and (no_right_side(bare) or any(rule.search(bare) for rule in expressions[language])):
            return "expression"
        defect = rules[language](bare, top)
        # With directives of its own a text is C, whatever names its macros give to things.
        return None if own and defect == "foreign" else defect

    return check


OPERATOR_END = re.compile(r"[=+\-%^&|]\s*+[;)\]}]")
#: What may stand before an operator that then is none without a right side: x++, --, channel arrows, pointers to pointers of a kind.
NO_OPERATOR = {"=": "+-*/%&|^?", "+": "+", "-": "-<", "%": "%", "^": "%"}


def before(text: str, at: int) -> str:
    """The last character before a place that is no white space."""
    while at and text[at - 1].isspace():
        at -= 1
    return text[at - 1] if at else ""


def no_right_side(bare: str) -> bool:
    """Whether an operator is followed by the end of its statement or group."""
    for m in OPERATOR_END.finditer(bare):
        sign, last = m.group()[0], bare[m.start() - 1 : m.start()]
        if sign in "&|":
            if last == sign:
                return True
        elif sign == "=" and last in "=!<>:" and last or before(bare, m.start()) not in NO_OPERATOR[sign]:
            return True
    return False


def _expression_rules() -> dict[str, list[re.Pattern]]:
    """What no expression or statement holds at any depth: an operator without its right side, operands side by side, a jump without its end."""
    number = r"(?<![\w.$\x02'])\d[\w.]*+[ \t]++"
    side_by_side = {"java": rf"{number}(?:\d|[A-Za-z_$\x02])", "go": rf"{number}(?:\d|[A-Za-z_\x02])", "c": rf"{number}(?:\d|[A-Za-z_\x02])", "javascript": rf"{number}(?:\d|(?!(?:in|of|instanceof|as|from)\b)[A-Za-z_$\x02])"}
    # Each stretch between separators is read once, and only if a brace closes it.
    no_end = r"(?:\A|[;{}:?])(?=[^;{}:?]*+\})[^;{}:?]*?\b(?:return|break|continue|throw|goto)\b"
    more = {"java": (no_end, r"[+\-*%=<>&|^(,]\s*[*%^](?!=)", r",\s*\)", r"[(=]\s*,"), "c": (no_end, r"=\s*,"), "go": (r"[(=]\s*,",), "javascript": (r"[(=]\s*,",)}
    return {name: [re.compile(p) for p in (side_by_side[name], *more[name])] for name in more}


def _declarations(language: str, top: str) -> str | None:
    """Java and Go: the top level is a sequence of declarations; Go's first one names the package."""
    at, rule = 0, JAVA_TOP if language == "java" else GO_TOP
    while at < len(top):
        m = rule.match(top, at)
        if not m or m.end() == at:
            return "statement" if top[:at].strip() else "foreign"
        at = m.end()
    if language == "go" and not top.lstrip().startswith("package"):
        return "premature_end" if not top.strip() else "foreign"
    return None


DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b((?:[^\n\\]|\\.)*+)", re.M | re.S)
CONDITIONAL = re.compile(r"^[ \t]*#[ \t]*(?:else|elif)\b|__cplusplus|^[ \t]*#[ \t]*if[ \t]+0\b", re.M)
C_OWN = re.compile(r"^[ \t]*#[ \t]*(?:include[ \t]*[<\"]|define[ \t]+\w|ifndef[ \t]+\w|ifdef[ \t]+\w|pragma[ \t]|endif\b)", re.M)


def one_branch(text: str) -> str:
    """C text with one branch of every conditional: the first one, but none that is for C++ or switched off."""
    out, at, stack = [], 0, []  # of each open conditional: is its present branch taken, was any
    for m in DIRECTIVE.finditer(text):
        word, rest = m.group(1), m.group(2)
        if all(active for active, _ in stack):
            out.append(text[at : m.start()])
        if word.startswith("if"):
            off = "__cplusplus" in rest and word != "ifndef" and "!" not in rest or word == "if" and rest.strip() == "0"
            stack.append((not off, not off))
        elif word == "endif":
            stack[-1:] = []
        elif stack:
            stack[-1] = (not stack[-1][1], True)
        at = m.end()
    if all(active for active, _ in stack):
        out.append(text[at:])
    return "\n".join(out)


def _c_rules(_: str, top: str) -> str | None:
    segments = re.split(r";|(?<![=\s])\s*\x04(?=\s*[^\s;,\w*]|\s*$|\s*\n)|\x04(?=\s*;)", top)
    # A file may end with macros, which are words of capitals or calls.
    if segments[-1].strip() and not C_MACROS.fullmatch(segments[-1]):
        return "premature_end" if C_SEGMENT.match(segments[-1]) else "foreign"
    if any(s.strip() and not C_SEGMENT.match(s) for s in segments) or THREE_NAMES.search(top):
        return "foreign"
    return None


def _python_rules():
    word_pairs = re.compile(r"\b(\w++)[ \t]++(?=([\w\x02]++))").findall
    after_close = re.compile(r"[)\]}\x02][ \t]*+(?=([A-Za-z_0-9]\w*+))").findall
    numbers = re.compile(r"[^\w.](?!0[oOxXbB])(?:\d[\da-fjxA-FJX_]*+[g-zG-Z]|0++[1-9]\d*+(?![\d.eEjJ_]))").search
    lone_operator = re.compile(r"[(\[{]\s*+[,=]|,\s*+,|[^=!<>:+\-*/%&|^@]=(?:\s*+[)\]},:]|\s++=)|:\s*+[)}]|[+\-%^&|~]\s*+[,)\]}:]|(?<!\.\.)\.\s*+[,)\]}:]").search
    slash_end = re.compile(r"//?+\s*+[,)\]}:]").finditer
    lone_inside = re.compile(r",\s*+=(?!=)").search
    over_lines = re.compile(r"(\w++|[\x02)\]}])[ \t]*+\n\s*+(?=([\w\x02]++))").findall
    a_string = re.compile(r"[rbfuRBFU]{0,2}\x02").match
    awaits = re.compile(r"\bawait\b").search
    values = frozenset(("None", "True", "False", "_", "match", "case", "type"))
    first_word = re.compile(r"[A-Za-z_]\w*").match
    starts = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_0123456789.@~+-*" + STRING + PAREN + BRACKET + BRACE)

    def rules(bare: str, top: str) -> str | None:
        for a, b in set(word_pairs(bare)):
            if a not in PY_WORDS and (b not in PY_WORDS or b in PY_NEVER_AFTER):
                return "neighbours"
            if a == "return" and b in ("if", "for", "while", "def", "class", "import"):
                return "neighbours"
        if any(w not in PY_WORDS for w in set(after_close(bare))) or numbers(bare) or any(x in bare for x in ("<>", "?", "$", "`")):
            return "neighbours"
        if "await" in bare and "async" not in bare and awaits(bare):
            return "statement"
        # A lone slash is a parameter list's mark only after a comma or an opening parenthesis.
        if lone_operator(bare) or "/" in bare and any(before(bare, m.start()) not in ",(" for m in slash_end(bare)):
            return "statement"
        stack, tries, open_block, body = [0], [], False, ""
        if "\\\n" in top:
            top = top.replace("\\\n", " ")
        for line in top.split("\n"):
            body = line.strip()
            if not body:
                continue
            indent = len(line) - len(line.lstrip(" \t"))
            if indent and "\t" in line[:indent]:
                indent = len(line[:indent].expandtabs(8))
            if open_block:
                if indent <= stack[-1]:
                    return "indent"
                stack.append(indent)
            elif indent != stack[-1]:
                while indent < stack[-1]:
                    stack.pop()
                if indent != stack[-1]:
                    return "indent"
            last = body[-1]
            head = first_word(body)
            head = head.group() if head else ""
            if tries and indent <= tries[-1]:
                if indent < tries[-1] or head not in ("except", "finally"):
                    return "statement"
                tries.pop()
            if head == "try":
                tries.append(indent)
            open_block = last == ":"
            if open_block:
                if head not in PY_OPENERS:
                    return "statement"
                if head == "except" and "," in body:
                    return "legacy"
            elif last in "=+-*/%@&|^<>~." and not body.endswith("...") and not (last == "." and body[-2:-1].isdigit()) and not (head == "from" and last == "*") or last.isalpha() and body.rsplit(None, 1)[-1] in PY_DANGLING:
                return "premature_end"
            elif head in PY_HEADED and ":" not in body:
                return "statement"
            elif head == "raise" and "," in body or indent == 0 and head in ("return", "yield", "await", "break", "continue"):
                return "legacy"
            if body[0] not in starts:
                return "statement"
        if open_block or tries or last_of(top)[:1] == "@":
            return "premature_end"
        # Within delimiters a line break is a blank: what stands on both sides must be joined by something.
        if bare.count("\n") != top.count("\n"):
            inner = [part for part, depth in depths(bare) if depth and "\n" in part]
            if any(lone_inside(part) for part in inner):
                return "statement"
            for a, b in {pair for part in inner for pair in over_lines(part)}:
                if b not in PY_WORDS and (a not in PY_WORDS or a in values) and not (a == STRING and a_string(b)):
                    return "neighbours"
        return None

    def last_of(top: str) -> str:
        return top.rstrip().rpartition("\n")[2].strip()

    def depths(bare: str):
        depth = 0
        for part in DELIMITERS.split(bare):
            if part in CLOSING:
                depth += 1
            elif part in (")", "]", "}"):
                depth -= 1
            else:
                yield part, depth

    return rules


def _javascript_rules():
    word_pairs = re.compile(r"\b([\w$]++)[ \t]++(?=([\w$\x02]++))").findall
    after_close = re.compile(r"[\x02\x05][ \t]*+(?=([A-Za-z_$\x02\d][\w$]*+))").findall
    numbers = re.compile(r"[^\w$.]\d[\d_.]*+(?![eExXoObBn])[a-zA-Z_$]").search
    imports = re.compile(r"import[ \t]+[\w$.]+[ \t]*(?:\n|\Z|;|,[ \t]*[\w$])").search
    dangling = re.compile(r"(?:[=*/%&|^<>?.,!~]|(?<!\+)\+|(?<!-)-|\b(?:const|let|var|function|class|new|async|import|export|extends|typeof|in|of|const[ \t]+\w+|(?:async[ \t]+)?function[ \t]*\w*[ \t]*\x03?|class[ \t]+\w+(?:[ \t]+extends[ \t]+\w+)?|(?:if|for|while|switch|catch)[ \t]*\x03?|else|do|try))\s*\Z").search
    missing = re.compile(r"[=(,][ \t]*;|[=,(][ \t]*=[ \t]*[)\]}]").search
    headless = re.compile(r"function[ \t]+\w++[ \t]*+(?!\x03)\S|:[ \t]*-[ \t]*\w+[ \t]*:").search
    private = re.compile(r"\#(?![A-Za-z_$])").search

    def rules(bare: str, top: str) -> str | None:
        for a, b in set(word_pairs(bare)):
            if a not in JS_WORDS and (b not in JS_WORDS or b in JS_RESERVED):
                return "neighbours"
        if any(w not in JS_AFTER for w in after_close(top)) or any(w not in JS_AFTER for w in set(after_close(bare))):
            return "neighbours"
        if numbers(bare) or ("import" in bare and imports(bare)) or ("#" in bare and private(bare)):
            return "neighbours"
        if dangling(top.rstrip()):
            return "premature_end"
        return "statement" if missing(bare) or headless(top) else None

    return rules


def python_accepts(text: str) -> bool:
    """Whether Python's compiler takes the text as a module. Nothing is run."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "text", "exec", dont_inherit=True)
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError, OverflowError):
        return False
    return True


def language_of_path(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    extension = F.lower(F.regexp_extract(F.regexp_replace(path, r"(?U)\s+$", ""), r"[^/\\]\.([A-Za-z]+)$", 1))
    return F.element_at(names, extension)


def defect_udf():
    """Vectorised UDF (language, text) -> defect, null for accepted texts and for those without language or content."""

    def checked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        check = make_checker()
        for languages, texts in batches:
            out = []
            for language, text in zip(languages, texts):
                defect = None
                if language is not None and text is not None and text.strip():
                    defect = check(language, text)
                    if defect and language == "python" and python_accepts(text):
                        defect = None
                out.append(defect)
            yield pd.Series(out, dtype=object)

    ship_by_value()
    return F.pandas_udf(checked, "string")


def code_defects(code: DataFrame) -> DataFrame:
    """All rows of code_files: file_id, repo, language, checked (has a language and content), defect."""
    language, text = language_of_path(F.col("max_stars_repo_path")), F.col("content")
    rows = code.select(
        "file_id", F.coalesce(repository(F.col("max_stars_repo_name")), repository(F.col("repo_name")), F.lit("unknown")).alias("repo"), language.alias("language"),
        (language.isNotNull() & text.isNotNull() & text.rlike(r"(?U)\S")).alias("checked"), "content",
    )
    return spread(rows).withColumn("defect", defect_udf()(F.col("language"), F.col("content"))).drop("content")


def exercise_defects(exercises: DataFrame) -> DataFrame:
    """Two rows per row of kodcode_v1: row_id, field_name, checked, defect. Both fields are Python."""
    fields = F.array(*[F.struct(F.lit(name).alias("field_name"), F.col(name).alias("text")) for name in ("solution", "test")])
    rows = spread(exercises.select("row_id", "solution", "test")).select("row_id", F.explode(fields).alias("f")).select("row_id", "f.field_name", "f.text")
    has = F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S")
    return rows.withColumn("checked", F.coalesce(has, F.lit(False))).withColumn("defect", defect_udf()(F.lit("python"), F.col("text"))).drop("text")


def found_defects(code: DataFrame, exercises: DataFrame) -> DataFrame:
    """(src_table, row_id, field_name) of every text that its language does not accept."""
    one = code_defects(code).where(F.col("defect").isNotNull()).select(F.lit("code_files").alias("src_table"), F.col("file_id").alias("row_id"), F.lit("content").alias("field_name"))
    two = exercise_defects(exercises).where(F.col("defect").isNotNull()).select(F.lit("kodcode_v1").alias("src_table"), "row_id", "field_name")
    return one.unionByName(two)


def defect_rates(code: DataFrame, exercises: DataFrame | None = None) -> DataFrame:
    """Per table, field, repository and language: texts checked, texts not accepted and their share. Exercises are Python and have no repository."""
    rows = code_defects(code).select(F.lit("code_files").alias("src_table"), F.lit("content").alias("field_name"), "repo", "language", "checked", "defect")
    if exercises is not None:
        fields = exercise_defects(exercises)
        rows = rows.unionByName(fields.select(F.lit("kodcode_v1").alias("src_table"), "field_name", F.lit("unknown").alias("repo"), F.lit("python").alias("language"), "checked", "defect"))
    sums = rows.where("checked").groupBy("src_table", "field_name", "repo", "language").agg(F.count("*").alias("n_checked"), F.count("defect").alias("n_broken"))
    return sums.withColumn("rate", F.round(F.col("n_broken") / F.col("n_checked"), 6))
