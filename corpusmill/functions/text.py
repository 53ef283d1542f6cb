"""String expressions. All stay in the JVM unless the docstring says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that Python's ``str.strip`` removes, as a class that Java and RE2 read alike.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A fenced block, a thinking block, a leading role label, phrases before code, a signature, the beginning of a line of code.
FENCE = r"(?is)```(?:python|py)?\s*(.*?)```"
THINK = r"(?is)<think>.*?</think>\s*"
ROLE_LABEL = r"^\s*(?:assistant|Assistant)\s*:\s*"
BAD_PREFIXES = ("write a complete python solution", "complete the following python function", "return only python code", "here is", "the solution", "we need")
SIGNATURE = r"(?m)^\s*def\s+[A-Za-z_]\w*\s*\([^\n)]*\)\s*(?:->\s*[^:]+\s*)?:"
CODE_START = r"^\s*(?:@|def\s+|async\s+def\s+|class\s+|from\s+\S+\s+import\s+|import\s+|if\s+__name__\s*==|[A-Za-z_]\w*\s*=)"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """``str.strip``; null stays null."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 is one space; no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def stable_hash(c: Column) -> Column:
    """SHA-1 of the normalised text, as hex digits."""
    return F.sha1(normalize_text(c))


def words(c: Column) -> Column:
    """``str.split()``: the non-empty pieces between white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def repetition_ratio(c: Column) -> Column:
    """One minus the share of distinct words; 0 for texts without words, null for null."""
    ratio = let(words(c), lambda parts: F.when(F.size(parts) > 0, 1 - F.size(F.array_distinct(parts)) / F.size(parts)).otherwise(F.lit(0.0)))
    return F.when(c.isNotNull(), ratio)


def safe_name(c: Column) -> Column:
    """A name for files: ``/`` becomes ``__``; other characters than letters, digits, ``_.-`` become ``_``."""
    return F.regexp_replace(F.regexp_replace(c, "/", "__"), r"[^\p{L}\p{N}_.\-]", "_")


def slug(c: Column) -> Column:
    """The other variant: runs of foreign characters become one ``_`` and none is left at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "/", "__"), r"[^A-Za-z0-9_.\-]+", "_"), r"^_+|_+$", "")


def fenced_code(c: Column) -> Column:
    """The first fenced block, or the whole text where there is none."""
    found = F.regexp_extract(c, FENCE, 1)
    return F.when(c.rlike(FENCE), found).otherwise(c)


def code_for_execution(c: Column) -> Column:
    """The fenced code without a role label and without line breaks at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(fenced_code(c), "^\n+|\n+$", ""), ROLE_LABEL, ""), "^\n+|\n+$", "")


def longest_fence(c: Column) -> Column:
    """The longest fenced block (the first of equally long ones); null where there is none."""
    numbered = F.transform(F.regexp_extract_all(c, F.lit(FENCE), 1), lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b")))
    return F.array_max(numbered)["b"]


def clean_solution(c: Column) -> Column:
    """A solution without thinking, with the longest fenced block if there is one, without role label and stray fences.

    Prose before the first line of code goes if it holds one of BAD_PREFIXES.
    """
    text = strip(F.regexp_replace(F.coalesce(c, F.lit("")), THINK, ""))
    text = let(text, lambda t: strip(F.coalesce(F.when(t.contains("```"), longest_fence(t)), t)))
    text = strip(F.regexp_replace(strip(F.regexp_replace(text, ROLE_LABEL, "")), "```", ""))
    return let(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), _without_preface)


def _without_preface(lines: Column) -> Column:
    none = F.lit(0)
    first = F.coalesce(F.array_position(F.transform(lines, lambda x: x.rlike(CODE_START)), True), F.lit(0)).cast("int") - 1

    def cut(at: Column) -> Column:
        prefix = F.lower(F.array_join(F.filter(F.transform(F.slice(lines, 1, at), strip), lambda x: x != ""), " "))
        bad = F.exists(F.array(*[F.lit(p) for p in BAD_PREFIXES]), lambda p: prefix.contains(p))
        return F.when(bad, F.slice(lines, at + 1, F.size(lines))).otherwise(lines)

    kept = F.when(first > 0, let(F.greatest(first, none), cut)).otherwise(lines)
    return strip(F.array_join(kept, "\n"))


def starts_badly(c: Column) -> Column:
    """Whether the first non-blank line begins with one of BAD_PREFIXES."""
    first = F.lower(strip(F.regexp_extract(c, r"^\s*([^\n]*)", 1)))
    return let(first, lambda line: F.exists(F.array(*[F.lit(p) for p in BAD_PREFIXES]), lambda p: line.startswith(p)))


def first_signature(c: Column) -> Column:
    """The first one-line function signature, or the empty string."""
    return strip(F.regexp_extract(F.coalesce(c, F.lit("")), SIGNATURE, 0))


def function_name(signature: Column) -> Column:
    return F.regexp_extract(signature, r"^def\s+([A-Za-z_]\w*)\s*\(", 1)


def defines_function(code: Column, name: Column) -> Column:
    """Whether some line of the code defines the function; the name is taken literally."""
    defined = F.regexp_extract_all(code, F.lit(r"(?m)^\s*def\s+([^\s(]+)\s*\("), 1)
    return F.array_contains(defined, name)


def until_marker(c: Column, markers: list[str]) -> Column:
    """The text before the earliest of the stop markers."""
    spots = [F.when(F.instr(c, m) > 0, F.instr(c, m)) for m in markers]
    first = F.least(*spots) if len(spots) > 1 else spots[0]
    return F.when(first.isNotNull(), F.substring(c, F.lit(1), first - 1)).otherwise(c)


def until_eos(ids: Column, eos: int) -> Column:
    """Token ids before the first end-of-sequence id."""
    at = F.array_position(ids, eos)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def plain_output(c: Column) -> Column:
    """2.9f: a program's output without blanks at the ends of its lines and of the whole."""
    lines = F.split(strip(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]")
    return strip(F.array_join(F.transform(lines, rstrip), "\n"))


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def byte_size(n: Column) -> Column:
    """2.9g: a number of bytes with the largest binary unit that leaves at least one; halves are rounded to even."""
    units = ("B", "KB", "MB", "GB", "TB")
    shown = lambda k: F.format_string(f"%.1f {units[k]}", F.bround(n / float(1024**k), 1))
    out = shown(4)
    for k in range(len(units) - 2, -1, -1):
        out = F.when(n < 1024.0 ** (k + 1), shown(k)).otherwise(out)
    return out


def duration(seconds: Column) -> Column:
    """2.9g: a time that is left as h:mm:ss; ``?`` for null and negative ones."""
    s = seconds.cast("long")
    return F.when(s >= 0, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise("?")


def utc_stamp(c: Column) -> Column:
    """2.9q: a timestamp as text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parses_as_python():
    """Vectorised UDF: whether the text is a Python module. The only test here that needs Python; nothing is run."""

    def parsed(texts: pd.Series) -> pd.Series:
        import ast
        import warnings

        def good(text) -> bool | None:
            if text is None:
                return None
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False
            return True

        return pd.Series([good(t) for t in texts], dtype=object)

    return F.pandas_udf(parsed, T.BooleanType())
