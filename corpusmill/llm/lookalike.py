"""Problem 8: one form for text that looks the same but is spelt with other characters.

Method: for every token the sets of scripts in which each of its letters could be written are intersected.
A token that mixes scripts, or that is written wholly in another script but could be written in a preferred
one, is respelt in the first script (Latin, Cyrillic, Greek, Armenian) that can write all of it. What has no
single script falls back to the letter's class. The remaining forms (widths, ligatures, accents, invisible
characters, kinds of space) are then normalised. The form depends only on how the token looks, so two texts
have the same form exactly if they look the same under these rules.

Null text has the form null, empty text the empty form. Repeated rows, ties and extra columns play no part in
the form: it is a function of one text. Very long texts are folded whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.relate import salted_join
from corpusmill.session import cut_lineage, ship_by_value, spread

#: Letters that look alike, by class. The key is the class; a value gives one letter of each script that
#: has one, in the order Latin, Cyrillic, Greek, Armenian ("." where the script has none).
CLASSES = """
A АΑ. B ВΒ. C СϹ. E ЕΕ. H НΗ. I ІΙ. J ЈͿ. K КΚ. M МΜ. N .Ν. O ОΟՕ P РΡ. S Ѕ.Տ T ТΤ. U ..Ս X ХΧ. Y УΥ. Z .Ζ. L ..Լ Q Ԛ.. W Ԝ..
a а.. c сϲ. d ԁ.. e е.. g ..ց h һ.հ i і.. j јϳ. n ..ո o оοօ p рρ. q ԛ.զ s ѕ.. u ..ս v ѵν. w ԝ.. x х.. y у.. l ӏ..
"""
SCRIPTS = ("latin", "cyrillic", "greek", "armenian")
#: More letters of the Latin block and of other scripts that look like a basic letter.
VARIANTS = {
    "ɑ": "a", "ɡ": "g", "Ү": "Y", "Ӏ": "I", "յ": "j",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭵ": "i", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "Ⲃ": "B", "Ⲥ": "C", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲧ": "T", "Ⲭ": "X", "ⲥ": "c", "ⲟ": "o", "ⲣ": "p",
}
#: Letters that pass for a Latin one only within a word of Latin letters; by themselves (a formula's alpha) they are what they are.
WITHIN_WORDS = {"α": "a", "γ": "y", "ι": "i", "κ": "k", "σ": "o", "υ": "u", "ω": "w"}
#: Ranges of ligatures and digraphs that are written as several letters, and a sign that is a Greek letter.
LIGATURE_RANGES = ((0xFB00, 0xFB17), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0xB5, 0xB5), (0x2160, 0x217F))
#: Ranges of letters and digits in other founts of the same alphabet (mathematical and letter-like signs).
FOUNT_RANGES = ((0x2102, 0x214F), (0x1D400, 0x1D7FF))
WIDTH_RANGES = ((0xFF01, 0xFFEE), (0x3000, 0x3000))
#: Characters without ink that Unicode does not put into category Cf.
NO_INK = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _alphabet() -> tuple[dict[str, dict[str, str]], dict[str, str]]:
    """The members of each class by script, and the class of each member."""
    members: dict[str, dict[str, str]] = {}
    entries = re.findall(r"(\S) (\S)(\S)(\S)", CLASSES)
    for latin, *others in entries:
        members[latin] = {"latin": latin} | {s: ch for s, ch in zip(SCRIPTS[1:], others) if ch != "."}
    class_of = {ch: key for key, row in members.items() for ch in row.values()}
    class_of.update({ch: key for ch, key in VARIANTS.items() if key != ch})
    return members, class_of


MEMBERS, CLASS_OF = _alphabet()


def _script(ch: str) -> str:
    code = ord(ch)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    if 0x530 <= code < 0x590:
        return "armenian"
    return unicodedata.name(ch, "unknown").split(" ")[0].lower()


def _fold_table() -> dict[int, str | None]:
    """Code point to replacement for what does not depend on the token: widths, ligatures, no-ink characters, spaces."""
    out: dict[int, str | None] = {code: None for code in NO_INK}
    for low, high in WIDTH_RANGES:
        for code in range(low, high + 1):
            if unicodedata.decomposition(chr(code)).startswith(("<wide>", "<narrow>")):
                out[code] = unicodedata.normalize("NFKC", chr(code))
    for low, high in LIGATURE_RANGES:
        for code in range(low, high + 1):
            if unicodedata.decomposition(chr(code)):
                out[code] = unicodedata.normalize("NFKC", chr(code))
    for low, high in FOUNT_RANGES:
        for code in range(low, high + 1):
            if unicodedata.decomposition(chr(code)).startswith("<font>"):
                out[code] = unicodedata.normalize("NFKC", chr(code))
    for code in [*range(0x80, 0x3100), *range(0xFE00, 0x10000), *range(0x110BD, 0x110CE), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0080)]:
        kind = unicodedata.category(chr(code))
        if kind == "Cf" and code not in out:
            out[code] = None
        elif kind == "Zs":
            out[code] = " "
    out[0xAD] = None
    return out


def _class_of_codes(codes) -> str:
    """A regular expression of one character out of these code points, as ranges."""
    ordered, parts, k = sorted(codes), [], 0
    while k < len(ordered):
        end = k
        while end + 1 < len(ordered) and ordered[end + 1] == ordered[end] + 1:
            end += 1
        parts.append(f"\\U{ordered[k]:08x}-\\U{ordered[end]:08x}")
        k = end + 1
    return "[" + "".join(parts) + "]"


def make_folder():
    """A function text -> (form, number of mixed-script tokens, number of whole-script confusable tokens)."""
    table = _fold_table()
    # Most characters of most texts are in no table: a search for those that are is far quicker than translating every character.
    folded = re.compile(_class_of_codes(code for code, new in table.items() if new != chr(code)))
    new_of = {chr(code): new or "" for code, new in table.items()}
    members, class_of = MEMBERS, CLASS_OF
    token_re = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
    # Tokens with a letter of another script, or with one that looks like a basic letter, are resolved; all others are their own form.
    outside = re.compile("[ɐ-ʯͰ-֏" + "".join(sorted(re.escape(ch) for ch in class_of if ord(ch) > 0x58F)) + "]")
    known: dict[str, tuple[str, int, int]] = {}

    def resolve(token: str) -> tuple[str, int, int]:
        """The consistent spelling of a decomposed token, whether it mixes scripts, whether it is whole-script confusable."""
        letters = [ch for ch in token if not "̀" <= ch <= "ͯ"]
        written = {_script(ch) for ch in letters}
        possible = None
        for ch in letters:
            key = class_of.get(ch)
            scripts = set(members[key]) if key else {_script(ch)}
            possible = scripts if possible is None else possible & scripts
        target = next((s for s in SCRIPTS if s in (possible or ())), None)
        if target is None and possible:
            return token, 0, 0
        spelt = []
        latin = target is None and "latin" in written
        for ch in token:
            key = class_of.get(ch) or (WITHIN_WORDS.get(ch) if latin else None)
            spelt.append(ch if key is None else members[key].get(target, key) if target else key)
        mixed = int(len(written) > 1)
        whole = int(not mixed and target is not None and target not in written)
        return "".join(spelt), mixed, whole

    def fold(text: str) -> tuple[str, int, int]:
        if text.isascii():
            return text, 0, 0
        text = unicodedata.normalize("NFC", folded.sub(lambda m: new_of[m.group()], text))
        mixed = whole = 0
        if outside.search(text):
            parts, at = [], 0
            text = unicodedata.normalize("NFD", text)
            for m in token_re.finditer(text):
                token = m.group()
                if token.isascii() or not outside.search(token):
                    continue
                hit = known.get(token)
                if hit is None:
                    if len(known) > 200_000:
                        known.clear()
                    hit = known[token] = resolve(token)
                mixed += hit[1]
                whole += hit[2]
                parts += (text[at : m.start()], hit[0])
                at = m.end()
            text = unicodedata.normalize("NFC", "".join(parts) + text[at:])
        return text, mixed, whole

    return fold


def _batches_of_forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    fold = make_folder()
    for texts in batches:
        rows = [(None, 0, 0) if t is None else fold(t) for t in texts]
        yield pd.DataFrame(rows, columns=["form", "n_mixed", "n_whole"])


def _batches_of_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    fold = make_folder()
    for texts in batches:
        yield pd.Series([None if t is None else hashlib.md5(fold(t)[0].encode("utf-8", "surrogatepass")).hexdigest() for t in texts], dtype=object)


def _non_ascii(text):
    """The text where it has a character beyond ASCII, else null: ASCII text is its own form and stays in the JVM."""
    return F.when(F.octet_length(text) > F.length(text), text)


def with_form(df: DataFrame, text_col: str = "text", form_col: str = "form") -> DataFrame:
    """``df`` with the consistent form and, per row, the numbers of mixed-script and whole-script confusable tokens.

    Adds ``form_col``, ``{form_col}_mixed`` and ``{form_col}_whole``; columns of those names are replaced.
    """
    ship_by_value()
    folded = F.pandas_udf(_batches_of_forms, "form string, n_mixed int, n_whole int")
    text = F.col(f"`{text_col}`")
    out = df.withColumn("__folded", folded(_non_ascii(text)))
    return (
        out.withColumn(form_col, F.coalesce(F.col("__folded.form"), text))
        .withColumn(f"{form_col}_mixed", F.coalesce(F.col("__folded.n_mixed"), F.lit(0)))
        .withColumn(f"{form_col}_whole", F.coalesce(F.col("__folded.n_whole"), F.lit(0)))
        .drop("__folded")
    )


def form_key(text):
    """Column: hex digest of the form of a text column. Only text beyond ASCII visits Python."""
    ship_by_value()
    keyed = F.pandas_udf(_batches_of_keys, "string")
    return F.coalesce(keyed(_non_ascii(text)), F.md5(text))


def form_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-empty text: (id, form_key, stored_key). Null and empty texts have no class."""
    text = F.col(text_col)
    df = spread(df.select(id_col, text_col))
    return df.where(text.isNotNull() & (text != "")).select(F.col(id_col).alias("id"), form_key(text).alias("form_key"), F.md5(text).alias("stored_key"))


def look_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-empty text: (id, class_id, n_copies, n_links): texts equal as stored, and those that only look the same.

    Classes are summed from totals per stored text; rows meet their class's numbers through a key that is salted where a class is large.
    """
    rows = cut_lineage(form_classes(df, id_col, text_col))
    stored = cut_lineage(rows.groupBy("form_key", "stored_key").agg(F.count("*").alias("n")))
    whole = stored.groupBy("form_key").agg(F.sum("n").alias("all"))
    sums = stored.join(whole, "form_key").select("form_key", "stored_key", (F.col("n") - 1).alias("n_copies"), (F.col("all") - F.col("n")).alias("n_links"))
    met = salted_join(rows, sums, ["form_key", "stored_key"], "id", stored)
    return met.select("id", F.col("form_key").alias("class_id"), "n_copies", "n_links")


def same_look_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (id_a < id_b) of rows whose texts look the same and differ as stored.

    Classes in which only one stored text occurs (the exact copies) are left out before anything is paired.
    Pairs are made between the stored variants of a class first and then given to the members of both.
    """
    rows = cut_lineage(form_classes(df, id_col, text_col))
    variants = rows.groupBy("form_key").agg(F.min("stored_key").alias("low"), F.max("stored_key").alias("high")).where("low <> high").select("form_key")
    members = rows.join(variants, "form_key", "left_semi")
    stored = members.select("form_key", "stored_key").distinct()
    a, b = stored.alias("a"), stored.alias("b")
    differing = a.join(b, (F.col("a.form_key") == F.col("b.form_key")) & (F.col("a.stored_key") < F.col("b.stored_key"))).select(F.col("a.form_key").alias("form_key"), F.col("a.stored_key").alias("one"), F.col("b.stored_key").alias("other"))
    left = members.select("form_key", F.col("stored_key").alias("one"), F.col("id").alias("x"))
    right = members.select("form_key", F.col("stored_key").alias("other"), F.col("id").alias("y"))
    pairs = differing.join(left, ["form_key", "one"]).join(right, ["form_key", "other"])
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
