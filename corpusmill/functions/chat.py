"""Conversations: normal turns, rendering, label masks, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import strip

KINDS = ("chatml_lowfreq_alias", "plain_eot", "plain_lower")
TURN = "struct<role:string,content:string>"
#: Names of roles, and what they are called in plain text.
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
TITLES = {"system": "System", "user": "User", "assistant": "Assistant"}


def turn(role: Column, content: Column) -> Column:
    """A turn with a lower-case role, its aliases made one; a missing role is the user's."""
    low = F.lower(F.coalesce(role, F.lit("user")))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.struct(F.coalesce(F.element_at(names, low), low).alias("role"), F.coalesce(content, F.lit("")).alias("content"))


def turns_of_pair(prompt: Column, response: Column, instruction: Column, extra: Column, output: Column) -> Column:
    """Prompt and response, else instruction (with input on a new line) and output; null where neither pair is whole."""
    user = F.concat_ws("\n", strip(instruction), F.nullif(strip(extra), F.lit("")))
    one = F.array(turn(F.lit("user"), strip(prompt)), turn(F.lit("assistant"), strip(response)))
    two = F.array(turn(F.lit("user"), user), turn(F.lit("assistant"), strip(output)))
    return F.when(prompt.isNotNull() & response.isNotNull(), one).when(instruction.isNotNull() & output.isNotNull(), two)


def join_turns(turns: Column) -> Column:
    """``role: content`` lines of the turns that have content; without role where it is blank."""
    filled = F.filter(turns, lambda t: strip(t["content"]) != "")
    lines = F.transform(filled, lambda t: F.when(strip(F.coalesce(t["role"], F.lit(""))) != "", F.concat(t["role"], F.lit(": "), strip(t["content"]))).otherwise(strip(t["content"])))
    return F.array_join(lines, "\n")


def text_of_row(candidates: list[Column], turns: Column | None, instruction: Column, extra: Column, output: Column) -> Column:
    """The first candidate that is not blank, else the joined turns, else instruction, input and output on lines."""
    blank = lambda c: F.nullif(strip(c), F.lit(""))
    pair = F.when(instruction.isNotNull() & output.isNotNull(), F.concat_ws("\n", strip(instruction), blank(extra), strip(output)))
    options = [blank(c) for c in candidates]
    if turns is not None:
        options.append(F.nullif(join_turns(turns), F.lit("")))
    return F.coalesce(*options, pair)


def _parts(t: Column, kind: str) -> tuple[Column, Column, Column]:
    role, content = F.lower(strip(t["role"])), strip(t["content"])
    if kind == "chatml_lowfreq_alias":
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n")), content, F.lit("<|im_end|>\n")
    if kind == "plain_eot":
        names = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
        return F.concat(F.coalesce(F.element_at(names, role), F.initcap(role)), F.lit(":\n")), content, F.lit("\n")
    if kind == "plain_lower":
        return F.concat(role, F.lit(":\n")), content, F.lit("\n")
    raise ValueError(f"unknown chat template {kind!r}")


def render(turns: Column, kind: str = "chatml_lowfreq_alias", prompt: bool = False) -> Column:
    """The text of a conversation; with ``prompt`` it ends where the assistant is to answer."""
    text = F.array_join(F.transform(turns, lambda t: F.concat(*_parts(t, kind))), "")
    if not prompt:
        return text
    return F.concat(text, F.lit("<|im_start|>assistant\n" if kind == "chatml_lowfreq_alias" else "Assistant:\n"))


def rendered_parts(turns: Column, kind: str = "chatml_lowfreq_alias") -> Column:
    """array<struct<text, supervised>>: what to encode, and whether it is the assistant's own words."""
    def parts(t: Column) -> Column:
        prefix, content, suffix = _parts(t, kind)
        own = F.lower(strip(t["role"])) == "assistant"
        return F.array(F.struct(prefix.alias("text"), F.lit(False).alias("supervised")), F.struct(content.alias("text"), own.alias("supervised")), F.struct(suffix.alias("text"), own.alias("supervised")))

    return F.flatten(F.transform(turns, parts))


def shifted_labels(ids: Column, supervised: Column, most: int, side: str = "left") -> Column:
    """input_ids, labels (the next id, or -1 where it is not supervised) and attention_mask, cut to ``most`` inputs."""
    if side not in ("left", "right"):
        raise ValueError("side must be left or right")
    cut = (lambda a: F.slice(a, F.greatest(F.lit(1), F.size(a) - most), F.lit(most + 1))) if side == "left" else (lambda a: F.slice(a, F.lit(1), F.lit(most + 1)))
    kept, marks = cut(ids), cut(supervised)
    n = F.greatest(F.size(kept) - 1, F.lit(0))
    labels = F.zip_with(F.slice(kept, F.lit(2), n), F.slice(marks, F.lit(2), n), lambda i, s: F.when(s, i).otherwise(F.lit(-1)))
    return F.struct(F.slice(kept, F.lit(1), n).alias("input_ids"), labels.alias("labels"), F.array_repeat(F.lit(1), n).alias("attention_mask"))


def pad_right(values: Column, length: Column, fill: int) -> Column:
    """An array filled up to a length."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(length - F.size(values), F.lit(0))))


def keep_last(ids: Column, most: int) -> Column:
    """The last ``most`` ids."""
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - most + 1), F.lit(most))


def alias_plan(required: list[str], vocab: dict[str, int], patterns: list[str], protected: tuple[str, ...] = ("<|endoftext|>", "<|pad|>"), vocab_size: int | None = None, max_id: int | None = 65_535) -> tuple[dict[str, int], str]:
    """X11: ids for required tokens: their own, else the lowest ids of reserved-looking tokens; ({}, reason) if that cannot be."""
    size = max(vocab.values(), default=-1) + 1
    if vocab_size is not None and size != vocab_size:
        return {}, f"the vocabulary has {size} ids, not {vocab_size}"
    if max_id is not None and size - 1 > max_id:
        return {}, f"a token id exceeds {max_id}"
    plan = {t: vocab[t] for t in required if t in vocab}
    taken = {*required, *protected}
    free = iter(sorted(i for t, i in vocab.items() if t not in taken and any(p in t for p in patterns)))
    for token in required:
        if token not in plan:
            spot = next(free, None)
            if spot is None:
                return {}, f"no reserved token is left for {token}"
            plan[token] = spot
    return plan, ""
