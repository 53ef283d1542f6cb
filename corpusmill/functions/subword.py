"""Subword tokenizers (X3-X8): distributed counts, exact merges on the driver, vectorised encoding.

Training needs only the table of distinct words with counts. It is made by a partial aggregation over the corpus; the driver
gets at most ``max_words`` rows of it and an error says so if there are more (raise ``min_count`` then).
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush, heapreplace
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage, spread

#: Pre-tokens of the BPE kinds and of WordPiece; special tokens by kind.
PRETOKEN = r"""(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\w+| ?[^\s\w]+|\s+(?!\S)|\s+"""
WORD = r"(?U)\w+|[^\w\s]+"
SPECIALS = {"bpe": ("<|endoftext|>", "<|unk|>"), "byte_bpe": ("<|endoftext|>",), "wordpiece": ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"), "unigram": ("<unk>", "<s>", "</s>")}
UNKNOWN = {"bpe": "<|unk|>", "wordpiece": "[UNK]", "unigram": "<unk>"}
END_OF_TEXT = {"bpe": "<|endoftext|>", "byte_bpe": "<|endoftext|>", "wordpiece": "[SEP]", "unigram": "</s>"}
#: Marks of a word's end (bpe), of a piece inside a word (wordpiece) and of a blank (unigram).
END, INNER, BLANK = "</w>", "##", "\u2581"
#: Fixed value: the log-probability of special tokens and of characters that no path used.
RARE = math.log(1e-9)


def word_counts(df: DataFrame, text: str, order: str, pattern: str = PRETOKEN, lower: bool = False, min_count: int = 1) -> DataFrame:
    """Word, n and first (order and position of its first occurrence, the tie key of the merges)."""
    source = F.lower(text) if lower else F.col(text)
    pieces = df.select(F.col(order).alias("o"), F.posexplode(F.regexp_extract_all(source, F.lit(pattern), 0)).alias("p", "word")).where("word <> ''")
    counts = pieces.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("o", "p")).alias("first"))
    return counts.where(F.col("n") >= min_count)


def pair_counts(words: DataFrame) -> DataFrame:
    """Neighbouring characters weighted by the words' counts: a, b, n."""
    chars = words.select("n", F.split("word", "").alias("c")).where(F.size("c") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("a"), F.element_at("c", i + 1).alias("b")))
    return chars.select("n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def substring_counts(df: DataFrame, text: str, longest: int = 16) -> DataFrame:
    """All substrings of 2 to ``longest`` characters of each line, with counts."""
    lines = spread(df.select(text)).select(F.explode(F.split(text, "\n")).alias("line")).where(F.length("line") > 1)
    starts = lines.select("line", F.explode(F.sequence(F.lit(1), F.length("line") - 1)).alias("i"))
    sizes = starts.select("line", "i", F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), F.length("line") - F.col("i") + 1))).alias("k"))
    return sizes.select(F.expr("substring(line, i, k)").alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def commonest_substrings(df: DataFrame, text: str, top: int, longest: int = 16) -> DataFrame:
    """The ``top`` commonest of ``substring_counts``, counts descending, ties by the substring."""
    source = spread(df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")))
    rows = [(piece, n) for piece, n, *_ in _commonest(source, top, longest)[1]]
    return df.sparkSession.createDataFrame(rows, "piece string, n long").coalesce(1)


#: Characters that are worked on at once, and the entries up to which a table is kept in full.
SLICE, FULL = 1 << 21, 1 << 22
#: Fixed value: characters of which guesses are made.
HINT = 1 << 20


def _joined(texts: list[str], turns: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Some texts at a time (about ``SLICE`` characters, one text at least) in the order of ``turns``: their characters as numbers, each text followed by a line break; where they start; their indexes."""
    group, chars = [], 0

    def together():
        codes = np.frombuffer("\n".join([*(texts[k] for k in group), ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        return codes, np.cumsum([0, *(len(texts[k]) + 1 for k in group)])[:-1], group

    for k in turns:
        if group and chars + len(texts[k]) >= SLICE:
            yield together()
            group, chars = [], 0
        group.append(k)
        chars += len(texts[k]) + 1
    if group:
        yield together()


def _ordered(batches: Iterator[pa.RecordBatch], placed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_joined`` texts of each batch by their order, which comes third."""
    for batch in batches:
        texts = batch.column("t").to_pylist()
        ranks = batch.column("o").to_numpy(zero_copy_only=False) if placed else np.arange(len(texts))
        for codes, starts, mine in _joined(texts, np.argsort(ranks, kind="stable").tolist()):
            yield codes, starts, ranks[mine]


def _slices(batches: Iterator[pa.RecordBatch], placed: bool, reach: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Characters of ``_joined`` texts; how many of them are starts (up to ``reach`` follow, which the next slice starts with);
    where the texts start, and their places (order, and position of the first character)."""
    for codes, starts, ranks in _ordered(batches, placed):
        for low in range(0, len(codes), SLICE):
            here = max(0, int(np.searchsorted(starts, low, "right")) - 1)
            until = max(here + 1, int(np.searchsorted(starts, low + SLICE)))
            first = np.stack([ranks[here:until], np.maximum(low - starts[here:until], 0)])
            yield codes[low : low + SLICE + reach], min(SLICE, len(codes) - low), np.maximum(starts[here:until] - low, 0), first


def _tally(keys: np.ndarray, size: int, placed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The keys that occur (of numbers under ``size``), how often, and the index where each is first."""
    if size <= max(FULL, 2 * len(keys)):
        n = np.bincount(keys, minlength=size)
        there = np.flatnonzero(n)
        if not placed:
            return there, n[there], None
        first = np.empty(size, np.int64)
        first[keys[::-1]] = np.arange(len(keys) - 1, -1, -1)  # of several values the last stays
        return there, n[there], first[there]
    if not placed:
        return *np.unique(keys, return_counts=True), None
    there, first, n = np.unique(keys, return_index=True, return_counts=True)
    return there, n, first


class _Steps:
    """From the number of a piece and the class of the next character to the number of the longer piece, -1 if there is none."""

    def __init__(self, keys: np.ndarray, size: int):
        self.keys = keys if size > FULL else None
        self.order = np.argsort(keys) if size > FULL else None
        self.full = None if size > FULL else np.full(size, -1, np.int32)
        if self.full is not None:
            self.full[keys] = np.arange(len(keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if self.full is not None:
            return self.full[keys]
        at = self.order[np.minimum(np.searchsorted(self.keys, keys, sorter=self.order), len(self.keys) - 1)]
        return np.where(self.keys[at] == keys, at, -1)


def _classes(letters: list[int]) -> np.ndarray:
    """Characters to classes: 1, 2 and so on for ``letters``, 0 for all others."""
    classes = np.zeros(0x110000, np.int32)
    classes[letters] = np.arange(1, len(letters) + 1)
    return classes


def _counter(levels: list[list[str]] | None, letters: list[int], placed: bool, wanted: frozenset[str] | None = None):
    """Counts the pieces that are one of ``letters`` longer than those of the last of ``levels``, or than ``wanted`` ones of all levels (of 2, 3 and so
    on characters; each piece without its last character is in the level before): s (number of the shorter piece, in the last level or with ``wanted``
    through all levels), c (last character), n and the first place. Without levels it counts characters (s is -1) and pairs (s is the first)."""

    def found(s, c, n, at, starts, first) -> pa.RecordBatch:
        columns = [pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(n, pa.int64())]
        if placed:
            text = np.searchsorted(starts, at, "right") - 1
            columns += [pa.array(first[0][text], pa.int64()), pa.array(first[1][text] + at - starts[text], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["s", "c", "n", "o", "p"][: len(columns)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, size, starts, first in _slices(batches, placed, 1):
            there = np.flatnonzero(np.bincount(codes))
            local = np.zeros(there[-1] + 1, np.int64)
            local[there] = np.arange(len(there))
            ids, is_end = local[codes], codes == 10
            one = np.flatnonzero(~is_end[:size])
            k, n, at = _tally(ids[one], len(there), placed)
            yield found(np.full(len(k), -1), there[k], n, one[at] if placed else None, starts, first)
            two = one[~is_end[one + 1]]  # the last of all is a line break
            k, n, at = _tally(ids[two] * len(there) + ids[two + 1], len(there) ** 2, placed)
            yield found(there[k // len(there)], there[k % len(there)], n, two[at] if placed else None, starts, first)

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, width, depth = _classes(letters), len(letters) + 1, len(levels) + 1
        codes_of = np.array([0, *letters])
        steps, before, ahead = [], {chr(c): k for k, c in enumerate(letters, 1)}, 0
        for k, level in enumerate(levels):
            keys = np.array([before[p[:-1]] * width + int(classes[ord(p[-1])]) for p in level], np.int64)
            here = np.array([k == len(levels) - 1 if wanted is None else p in wanted for p in level])
            steps.append((_Steps(keys, width * width if k == 0 else len(levels[k - 1]) * width), len(level), ahead, here))
            before = {p: j for j, p in enumerate(level)}
            ahead += 0 if wanted is None else len(level)
        for codes, size, starts, first in _slices(batches, placed, depth):
            c = np.append(classes[codes], np.zeros(depth, np.int32))
            at = np.flatnonzero(c[:size])
            s, follow = c[at].astype(np.int64), c[at + 1]
            for k, (step, many, ahead, here) in enumerate(steps):
                s = step(s * width + follow)
                on = np.flatnonzero(s >= 0)
                at, s = at[on], s[on].astype(np.int64)
                follow = c[at + k + 2]
                if here.any():
                    on = np.flatnonzero(follow if here.all() else (follow > 0) & here[s])
                    n_at = at[on]
                    j, n, f = _tally(s[on] * width + follow[on], many * width, placed)
                    if len(j):
                        yield found(ahead + j // width, codes_of[j % width], n, n_at[f] if placed else None, starts, first)

    return pairs if levels is None else longer


def _commonest(source: DataFrame, top: int, longest: int, max_chars: int | None = None) -> tuple[list[tuple], list[tuple]]:
    """All characters by their first places (if the source has an order ``o`` and ``max_chars`` is given) and the ``top`` commonest pieces of 2 to ``longest``
    characters of the lines of ``t``, each with count and, if there is an order, first place; ties by first place and length, else by the piece.

    A piece without its last character is as common and comes before it in either order, so that only pieces one character longer than those
    among the ``top`` so far can be among them: they are counted until there are no others. That is one pass for each length; with places, what
    ``_guesses`` holds for common is counted ahead, which saves passes and leaves nothing uncounted. The driver sees ``top`` rows of each pass.
    """
    placed = "o" in source.columns
    schema = "s int, c int, n long" + ", o long, p long" * placed
    ties = ["p.o", "p.p"] if placed else ["s", "c"]
    rank = (lambda r: (-r[1], r[2], len(r[0]))) if placed else (lambda r: (-r[1], r[0].encode("utf-8", "surrogatepass")))

    def counted(*what) -> DataFrame:
        parts = source.mapInArrow(_counter(*what), schema).groupBy("s", "c")
        return parts.agg(F.sum("n").alias("n"), *([F.min(F.struct("o", "p")).alias("p")] if placed else []))

    both = cut_lineage(counted(None, [], placed))
    row = lambda piece, r: (piece, r["n"], *([tuple(r["p"])] if placed else []))
    chars = [row(chr(r["c"]), r) for r in both.where("s = -1").orderBy(*(["p"] if placed else ["c"])).limit(max_chars + 1).collect()] if max_chars else []
    best = [row(chr(r["s"]) + chr(r["c"]), r) for r in both.where("s >= 0").orderBy(F.desc("n"), *ties).limit(top).collect()] if longest > 1 else []
    guessed = _guesses(source, sum(n for _, n, *_ in chars), 2 * top, longest) if placed and longest > 3 else []
    done: set[str] = set()
    while True:
        best = sorted(best, key=rank)[:top]
        due = {r[0] for r in best if len(r[0]) < longest and r[0] not in done}
        if not due:
            return chars, best
        least = best[-1][1] if len(best) == top else 1
        letters = sorted(r["c"] for r in both.where((F.col("s") == -1) & (F.col("n") >= least)).select("c").collect())
        known = frozenset(map(chr, letters))
        due |= {p for p in guessed if len(p) < longest and p not in done and known.issuperset(p)}
        guessed = []
        done |= due
        trie = {p[:j] for p in due for j in range(2, len(p) + 1)}
        levels = [sorted((p for p in trie if len(p) == k), key=lambda p: p.encode("utf-8", "surrogatepass")) for k in range(2, max(map(len, trie)) + 1)]
        nodes = [p for level in levels for p in level]
        rows = counted(levels, letters, placed, frozenset(due)).where(F.col("n") >= least).orderBy(F.desc("n"), *ties).limit(top).collect()
        best += [row(nodes[r["s"]] + chr(r["c"]), r) for r in rows]


def _guesses(source: DataFrame, chars: int, top: int, longest: int) -> list[str]:
    """Pieces that may be among the commonest: those of the beginnings of some texts (about ``HINT`` characters). They only tell what to count first."""
    if chars < 4 * HINT:
        return []
    some = source.where(F.pmod(F.xxhash64("o"), F.lit(chars // HINT)) == 0).select(F.substring("t", 1, 10_000).alias("t")).toArrow()
    batch = pa.RecordBatch.from_arrays([pa.array(some.column("t").to_pylist(), pa.string())], names=["t"])
    least, levels, pieces, letters = 1, None, {}, []
    for _ in range(2, longest + 1):
        parts = [*_counter(levels, letters, False)(iter([batch]))]
        if not parts:
            break
        n = pa.Table.from_batches(parts).group_by(["s", "c"]).aggregate([("n", "sum")])
        s, c, n = (n.column(k).to_numpy() for k in ("s", "c", "n_sum"))
        if levels is None:
            one, singles = s < 0, dict(zip(c[s < 0].tolist(), n[s < 0].tolist()))
            s, c, n = s[~one], c[~one], n[~one]
        on = np.flatnonzero(n >= least)
        pieces |= {(chr(a) if levels is None else levels[-1][a]) + chr(b): k for a, b, k in zip(s[on].tolist(), c[on].tolist(), n[on].tolist())}
        pieces = dict(sorted(pieces.items(), key=lambda x: -x[1])[:top])
        least = max(2, min(pieces.values(), default=0))
        letters = sorted(ch for ch, k in singles.items() if k >= least)
        size, known = len(levels or []) + 2, frozenset(map(chr, letters))
        last = [p for p, k in pieces.items() if len(p) == size and known.issuperset(p)]
        if not last:
            break
        trie = {p[:j] for p in last for j in range(2, size + 1)}
        levels = [sorted(p for p in trie if len(p) == k) for k in range(2, size + 1)]
    return [*pieces]


def gather_words(counts: DataFrame, max_words: int = 2_000_000) -> list[tuple[str, int]]:
    """The words in the order in which they were first seen."""
    rows = counts.orderBy("first").limit(max_words + 1).collect()
    if len(rows) > max_words:
        raise ValueError(f"more than {max_words} distinct words: raise min_count")
    return [(r["word"], r["n"]) for r in rows]


def _byte_chars() -> dict[int, str]:
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


def byte_chars() -> dict[int, str]:
    """Bytes as printable characters: those that print stand for themselves, the others follow from U+0100."""
    return BYTE_CHARS


class _Pairs:
    """Neighbouring symbols over weighted words, kept up to date while pairs are merged, with the best pair at hand.

    A pair's value is its count or, if ``relative``, its count over the product of its symbols' counts. Of equal values the pair that
    stands first counts. The queue holds a pair under its value and a place that is not behind its true one; entries whose value has
    changed are dropped when they come up, and those whose place has moved are put back, so a merge costs what it changes.
    """

    def __init__(self, words: list[tuple[list[str], int]], relative: bool = False):
        self.words, self.relative = words, relative
        self.counts, self.singles = Counter(), Counter()
        self.seen_in: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.with_symbol: dict[str, set[tuple[str, str]]] = defaultdict(set)
        self.queue: list = []
        for k in range(len(words)):
            self._count(k, 1)
        for pair in self.counts:
            self._offer(pair)

    def _count(self, k: int, sign: int) -> set[tuple[str, str]]:
        symbols, n = self.words[k]
        for symbol in symbols:
            self.singles[symbol] += sign * n
        pairs = list(zip(symbols, symbols[1:]))
        for pair in pairs:
            self.counts[pair] += sign * n
        if sign > 0:
            for pair in set(pairs):
                heappush(self.seen_in[pair], k)
                self.with_symbol[pair[0]].add(pair)
                self.with_symbol[pair[1]].add(pair)
        return set(pairs)

    def value(self, pair: tuple[str, str]) -> float:
        n = self.counts.get(pair, 0)
        return n / (self.singles[pair[0]] * self.singles[pair[1]]) if self.relative and n else n

    def _offer(self, pair: tuple[str, str]) -> None:
        value = self.value(pair)
        if value:
            heappush(self.queue, (-value, self.seen_in[pair][0], -1, pair))

    def place(self, pair: tuple[str, str]) -> tuple[int, int]:
        """The first word that has the pair, and where."""
        heap = self.seen_in[pair]
        while True:
            symbols = self.words[heap[0]][0]
            for i in range(len(symbols) - 1):
                if symbols[i] == pair[0] and symbols[i + 1] == pair[1]:
                    return heap[0], i
            heappop(heap)

    def best(self) -> tuple[tuple[str, str], float] | None:
        while self.queue:
            negative, k, i, pair = self.queue[0]
            if -negative != self.value(pair):
                heappop(self.queue)
                continue
            place = self.place(pair)
            if place == (k, i):
                return pair, -negative
            heapreplace(self.queue, (negative, *place, pair))
        return None

    def merge(self, pair: tuple[str, str], joined: str) -> None:
        changed: set[tuple[str, str]] = set()
        for k in sorted(set(self.seen_in.pop(pair))):
            symbols, n = self.words[k]
            if pair not in zip(symbols, symbols[1:]):
                continue
            changed |= self._count(k, -1)
            self.words[k] = (merge_pair(symbols, pair, joined), n)
            changed |= self._count(k, 1)
        if self.relative:
            for symbol in (*pair, joined):
                changed |= self.with_symbol[symbol]
        for other in changed:
            if self.counts[other] > 0:
                self._offer(other)
            else:
                del self.counts[other]
                self.with_symbol[other[0]].discard(other)
                self.with_symbol[other[1]].discard(other)


def merge_pair(symbols: list[str], pair: tuple[str, str], joined: str) -> list[str]:
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(joined)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


@dataclass
class Subword:
    """A trained tokenizer of one of the four kinds."""

    kind: str
    token_to_id: dict[str, int]
    merges: list[tuple[str, str]] = field(default_factory=list)
    log_probs: dict[str, float] = field(default_factory=dict)

    @property
    def vocab_size(self) -> int:
        return len(self.token_to_id)

    @property
    def eos_token_id(self) -> int:
        return self.token_to_id[END_OF_TEXT[self.kind]]

    def save(self, path: str) -> None:
        """One JSON file with the kind and its tables."""
        content = {"kind": self.kind, "token_to_id": self.token_to_id}
        if self.merges:
            content["merges"] = [list(m) for m in self.merges]
        if self.log_probs:
            content["log_probs"] = self.log_probs
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(content, ensure_ascii=False), encoding="utf-8")

    @staticmethod
    def load(path: str) -> Subword:
        """From a file, or from the tokenizer.json in a folder (Q13); the kind is bpe where none is named."""
        target = Path(path)
        content = json.loads((target / "tokenizer.json" if target.is_dir() else target).read_text(encoding="utf-8"))
        return Subword(content.get("kind", "bpe"), content["token_to_id"], [tuple(m) for m in content.get("merges", [])], content.get("log_probs", {}))

    def check_dtype(self, dtype_max: int) -> None:
        if self.vocab_size - 1 > dtype_max:
            raise ValueError("the vocabulary does not fit the type")

    def encode(self, text: str, add_eos: bool = False) -> list[int]:
        ids: list[int] = []
        unknown = self.token_to_id[UNKNOWN[self.kind]] if self.kind in UNKNOWN else None
        for piece in self.pieces(text):
            if unknown is None and piece not in self.token_to_id:
                ids += [self.token_to_id[ch] for ch in piece]  # a merge whose product the vocabulary lacks: its bytes
            else:
                ids.append(self.token_to_id.get(piece, unknown))
        return [*ids, self.eos_token_id] if add_eos else ids

    def encode_batch(self, texts: Iterable[str], add_eos: bool = False) -> list[list[int]]:
        """The ids of several texts."""
        return [self.encode(t, add_eos) for t in texts]

    def encode_many(self, texts: list[str | None], add_eos: bool = False) -> list[np.ndarray | None]:
        """The ids of several texts (None stays None), by unigram: all lines at once."""
        paths = self.__dict__["_paths"] = self.__dict__.get("_paths") or _Paths(self.log_probs)
        unknown = self.token_to_id[UNKNOWN["unigram"]]
        ids = np.array([*(self.token_to_id.get(p, unknown) for p in self.log_probs), unknown], np.int32)  # the last is for -1
        end = [self.eos_token_id] if add_eos else []
        out: list[np.ndarray | None] = [None] * len(texts)
        marked = [None if t is None else BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        for codes, starts, mine in _joined(marked, (k for k, t in enumerate(marked) if t is not None)):
            flat = np.full(len(codes), -1, np.int32)
            ends, numbers = paths(codes)
            flat[ends] = ids[numbers]
            inner = codes == 10
            inner[starts[1:] - 1] = inner[-1] = False
            flat[inner] = self.token_to_id.get("\n", unknown)
            there = np.flatnonzero(flat >= 0)
            for k, own in zip(mine, np.split(flat[there], np.searchsorted(there, starts[1:]))):
                out[k] = np.append(own, end).astype(np.int32) if end else own
        return out

    def pieces(self, text: str) -> list[str]:
        if self.kind == "unigram":
            marked = BLANK + text.replace(" ", BLANK) if text else ""
            known = self.__dict__.setdefault("_known", beginnings(self.log_probs))
            lines = [best_path(line, self.log_probs, None, known)[0] for line in marked.split("\n")]
            # No piece but the line break itself holds one, so lines are independent.
            return [p for k, line in enumerate(lines) for p in ([*line] if k == 0 else ["\n", *line])]
        cache = self.__dict__.setdefault("_cache", {})
        split = self._longest if self.kind == "wordpiece" else self._splitter()
        found: list[str] = []
        for word in re.findall(WORD[4:], text.lower()) if self.kind == "wordpiece" else re.findall(PRETOKEN[4:], text):
            hit = cache.get(word)
            if hit is None:
                if len(cache) > 200_000:
                    cache.clear()
                hit = cache[word] = split(word)
            found += hit
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _splitter(self):
        """word -> pieces by the merges: native where the library is there and knows all characters of the word, else in Python."""
        if "_split" in self.__dict__:
            return self.__dict__["_split"]
        ranks = {tuple(m): k for k, m in reversed(list(enumerate(self.merges)))}
        plain = lambda word: self._merged(self._symbols(word), ranks)
        try:
            from tokenizers import models
        except ImportError:
            models = None
        split = plain
        if models is not None and self.merges:
            # The mark of a word's end is one symbol of several characters; for the library it is one private character.
            short, mark = (lambda t: t.replace(END, "\uf8ff")) if self.kind == "bpe" else (lambda t: t), "\uf8ff"
            names = dict.fromkeys([*byte_chars().values()] if self.kind == "byte_bpe" else [short(t) for t in self.token_to_id if t not in SPECIALS["bpe"]])
            pairs = [(short(a), short(b)) for a, b in dict.fromkeys(map(tuple, self.merges))]
            names.update(dict.fromkeys(t for a, b in pairs for t in (a, b, a + b)))
            model = models.BPE(vocab={t: k for k, t in enumerate(names)}, merges=pairs)
            letters = frozenset(t for t in names if len(t) == 1)

            def split(word: str) -> list[str]:
                symbols = "".join(short(s) for s in self._symbols(word))
                if mark in word or self.kind == "bpe" and END[0] in word or not letters.issuperset(symbols):
                    return plain(word)
                return [t.value.replace(mark, END) if self.kind == "bpe" else t.value for t in model.tokenize(symbols)]

        self.__dict__["_split"] = split
        return split

    def _symbols(self, word: str) -> list[str]:
        if self.kind == "byte_bpe":
            chars = byte_chars()
            return [chars[b] for b in word.encode("utf-8", "surrogatepass")]
        return [*word, END]

    @staticmethod
    def _merged(symbols: list[str], ranks: dict) -> list[str]:
        while len(symbols) > 1:
            pair = min(zip(symbols, symbols[1:]), key=lambda p: ranks.get(p, len(ranks)))
            if pair not in ranks:
                break
            symbols = merge_pair(symbols, pair, pair[0] + pair[1])
        return symbols

    def _longest(self, word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in self.token_to_id), None)
            if end is None:
                return [UNKNOWN["wordpiece"]]
            out.append(("##" if at else "") + word[at:end])
            at = end
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; unknown ids are left out, special tokens too but by bpe, which spells them."""
        names = self.__dict__.setdefault("_names", {i: t for t, i in self.token_to_id.items()})
        skip = set() if self.kind == "bpe" else set(SPECIALS[self.kind])
        tokens = [t for t in (names.get(int(i), "") for i in ids) if t not in skip]
        if self.kind == "byte_bpe":
            codes = {ch: b for b, ch in byte_chars().items()}
            return bytes(codes.get(ch, ord("?")) for t in tokens for ch in t).decode("utf-8", errors="replace")
        if self.kind == "bpe":
            return "".join(tokens).replace(END, "")
        if self.kind == "wordpiece":
            return "".join(t[2:] if t.startswith(INNER) else " " + t for t in tokens).strip()
        return "".join(tokens).replace(BLANK, " ").lstrip(" ")


def train_bpe(words: list[tuple[str, int]], vocab_size: int, kind: str = "bpe") -> Subword:
    """Merges the commonest pair until the size is reached or it occurs once. Ties: the pair first seen (Q8)."""
    model = Subword(kind, {t: k for k, t in enumerate(SPECIALS[kind])})
    state = _Pairs([(model._symbols(w), n) for w, n in words])
    start = byte_chars().values() if kind == "byte_bpe" else sorted({s for symbols, _ in state.words for s in symbols})
    for symbol in start:
        model.token_to_id.setdefault(symbol, len(model.token_to_id))
    while len(model.token_to_id) < vocab_size:
        found = state.best()
        if found is None or found[1] < 2:
            break
        pair = found[0]
        joined = pair[0] + pair[1]
        model.merges.append(pair)
        model.token_to_id.setdefault(joined, len(model.token_to_id))
        state.merge(pair, joined)
    return model


def train_wordpiece(words: list[tuple[str, int]], vocab_size: int) -> Subword:
    """Merges the pair with the highest count over the product of its parts' counts; stops when a token exists already (Q10).

    The vocabulary starts with the special tokens, the first characters of words in order, and the inner ones in order.
    """
    model = Subword("wordpiece", {t: k for k, t in enumerate(SPECIALS["wordpiece"])})
    words = [(w, n) for w, n in words if w]
    for symbol in [*sorted({w[0] for w, _ in words}), *(INNER + ch for ch in sorted({ch for w, _ in words for ch in w[1:]}))]:
        model.token_to_id.setdefault(symbol, len(model.token_to_id))
    state = _Pairs([([w[0], *(INNER + ch for ch in w[1:])], n) for w, n in words], relative=True)
    while len(model.token_to_id) < vocab_size:
        found = state.best()
        if found is None:
            break
        pair = found[0]
        joined = pair[0] + pair[1].removeprefix(INNER)
        if joined in model.token_to_id:
            break
        model.token_to_id[joined] = len(model.token_to_id)
        state.merge(pair, joined)
    return model


def beginnings(pieces: Iterable[str]) -> frozenset[str]:
    """Every beginning of every piece: what ``best_path`` stops at."""
    return frozenset(p[:k] for p in pieces for k in range(1, len(p) + 1))


def best_path(line: str, log_probs: dict[str, float], unknown: float | None = None, known: frozenset[str] | None = None) -> tuple[list[str], float]:
    """Viterbi: the most probable pieces of a line; a character without a piece costs ``unknown``, else what ``<unk>`` does.

    Of equally probable paths the one with the longer last piece wins. ``known`` are the ``beginnings`` of the pieces, if they are at hand.
    """
    known = beginnings(log_probs) if known is None else known
    missing = unknown if unknown is not None else log_probs.get("<unk>", math.log(1e-6))
    size = len(line)
    best, back = [0.0] + [-math.inf] * size, [0] * (size + 1)
    for start in range(size):
        reached = best[start]
        if line[start] not in log_probs and reached + missing > best[start + 1]:
            best[start + 1], back[start + 1] = reached + missing, start
        for end in range(start + 1, size + 1):
            piece = line[start:end]
            if piece not in known:
                break
            value = log_probs.get(piece)
            if value is not None and reached + value > best[end]:
                best[end], back[end] = reached + value, start
    out, at = [], size
    while at > 0:
        out.append(line[back[at] : at])
        at = back[at]
    return out[::-1], best[-1]


class _Paths:
    """``best_path`` for many lines at once, with the same sums in the same order and so the same paths.

    The lines go side by side, character by character. An automaton tells which pieces end at a character, and for each of its states there is a
    row of their values, longest first: of equal sums the first is taken. The few longest lines, and all if the automaton would be too large, go one by one.
    """

    #: Entries of the automaton at most; what a step and what a character alone take, in the same unit.
    MOST, STEP, ALONE = 1 << 24, 20, 1

    def __init__(self, log_probs: dict[str, float]):
        self.log_probs = log_probs
        self.number = {p: k for k, p in enumerate(log_probs)}
        self.missing = log_probs.get("<unk>", math.log(1e-6))
        long = [p for p in log_probs if len(p) > 1]
        inner = dict.fromkeys(ch for p in long for ch in p)
        self.letters = [*inner, *(p for p in log_probs if len(p) == 1 and p not in inner)]
        self.width, self.columns = max([2, *map(len, long)]), len(inner) + 1
        self.singles = np.array([self.missing, *(log_probs.get(ch, self.missing) for ch in self.letters)])
        self.single_numbers = np.array([-1, *(self.number.get(ch, -1) for ch in self.letters)], np.int32)
        nodes = [{}]
        ends: dict[int, str] = {}
        for p in long:
            at = 0
            for ch in p:
                if ch not in nodes[at]:
                    nodes[at][ch] = len(nodes)
                    nodes.append({})
                at = nodes[at][ch]
            ends[at] = p
        self.fits = len(nodes) * self.columns <= self.MOST
        if not self.fits:
            return
        place = {ch: k for k, ch in enumerate(inner, 1)}
        self.goto = np.zeros((len(nodes), self.columns), np.int32)
        self.values = np.full((len(nodes), self.width), -math.inf)
        self.numbers = np.full((len(nodes), self.width), -1, np.int32)
        turn, back = [0], {0: 0}
        for at in turn:  # grows meanwhile
            if at:
                self.goto[at], self.values[at], self.numbers[at] = self.goto[back[at]], self.values[back[at]], self.numbers[back[at]]
            if at in ends:
                self.values[at, -len(ends[at])], self.numbers[at, -len(ends[at])] = log_probs[ends[at]], self.number[ends[at]]
            for ch, to in nodes[at].items():
                back[to] = int(self.goto[at, place[ch]])
                self.goto[at, place[ch]] = to
                turn.append(to)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of the best paths of the lines end (the last number is a line break), and the numbers of the pieces, -1 for a character without a piece."""
        stops = np.flatnonzero(codes == 10)
        starts = np.concatenate([[0], stops[:-1] + 1])
        sizes = stops - starts
        order = np.argsort(-sizes, kind="stable")
        order = order[: int(np.count_nonzero(sizes))]
        length, number = np.zeros(len(codes), np.int32), np.full(len(codes), -1, np.int32)
        keep = np.zeros(len(codes), bool)
        ranked = sizes[order]
        alone = int(np.argmin(np.append(ranked, 0) * self.STEP + np.concatenate([[0], np.cumsum(ranked)]) * self.ALONE)) if self.fits else len(order)
        if alone:
            known = beginnings(self.log_probs)
            for k in order[:alone]:
                at = starts[k]
                for piece in best_path(codes[starts[k] : stops[k]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), self.log_probs, None, known)[0]:
                    at += len(piece)
                    keep[at - 1], number[at - 1] = True, self.number.get(piece, -1)
        if alone < len(order):
            self._together(codes, starts[order[alone:]], ranked[alone:], length, number, keep)
        ends = np.flatnonzero(keep)
        return ends, number[ends]

    def _together(self, codes, starts, sizes, length, number, keep) -> None:
        tall, width = int(sizes[0]), self.width
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, tall + 1))  # lines that have a t-th character
        ahead = np.concatenate([[0], np.cumsum(active)])
        line = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        t = np.arange(len(line), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        where = t + np.repeat(starts.astype(np.int32), sizes)
        to = ahead[t] + line
        chars = np.empty(len(line), np.int32)
        chars[to] = self._lookup()[codes[where]]
        steps = np.where(chars < self.columns, chars, 0)
        singles = self.singles[chars]
        states, chosen = np.empty(len(line), np.int32), np.empty(len(line), np.int8 if width < 128 else np.int32)
        goto, room = self.goto.ravel(), 48
        best = np.full((len(sizes), width + room), -math.inf)
        best[:, width - 1] = 0.0
        rows = np.arange(len(sizes)) * width
        state, column = np.zeros(len(sizes), np.int32), 0
        for k in range(tall):
            n, low, high = int(active[k]), int(ahead[k]), int(ahead[k + 1])
            state = goto.take(state[:n] * self.columns + steps[low:high])
            values = self.values.take(state, axis=0)
            values[:, -1] = singles[low:high]
            values += best[:n, column : column + width]
            top = values.argmax(axis=1)
            best[:n, column + width] = values.ravel().take(rows[:n] + top)
            states[low:high], chosen[low:high] = state, top
            column += 1
            if column == room:
                best[:n, :width] = best[:n, room : room + width]
                column = 0
        length[where] = width - chosen[to].astype(np.int32)
        found = self.numbers.ravel().take(states.astype(np.int64) * width + chosen)
        found = np.where(chosen == width - 1, self.single_numbers[chars], found)
        number[where] = found[to]
        at, first = starts + sizes, starts
        while len(at):
            keep[at - 1] = True
            at = at - length[at - 1]
            on = at > first
            at, first = at[on], first[on]

    def _lookup(self) -> np.ndarray:
        if "_classes" not in self.__dict__:
            self._classes = _classes([ord(ch) for ch in self.letters])
        return self._classes


def train_unigram(df: DataFrame, text: str, order: str, vocab_size: int, rounds: int = 4, seeds: int = 10_000, longest: int = 16, prune: float = 0.2, max_chars: int = 200_000) -> Subword:
    """All characters and the commonest substrings of lines as seeds; in each of ``rounds`` the pieces of the best paths are counted
    over the corpus and the least used longer ones go, a share ``prune`` of them at most, until the size is reached.

    The texts count in the order of the integer column ``order``, which ties go by: the piece first seen or first used is first. Every
    round is one distributed pass; the driver sees pieces and counts, at most ``seeds`` and the alphabet (more than ``max_chars`` characters are an error).
    """
    docs = spread(df.where(F.col(text).isNotNull()).select(F.coalesce(F.col(order).cast("long"), F.lit(2**63 - 1)).alias("o"), F.col(text).alias("t")))
    head = docs.agg(
        F.min("o").alias("first"), F.count("*").alias("n"), F.sum(F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))).alias("breaks"), F.min_by(F.length(F.substring_index("t", "\n", 1)), "o").alias("line")
    ).first()
    special = SPECIALS["unigram"]
    if not head["n"]:
        return Subword("unigram", {t: k for k, t in enumerate(special)}, [], {t: RARE for t in special})
    marked = F.replace("t", F.lit(" "), F.lit(BLANK))
    lines = docs.select("o", F.when(F.col("o") == head["first"], F.concat(F.lit(BLANK), marked)).otherwise(marked).alias("t"))
    chars, top = _commonest(lines, seeds, longest, max_chars)
    if len(chars) > max_chars:
        raise ValueError(f"more than {max_chars} characters: this is no alphabet")
    # The texts stand one below the other: the first line break ends the first line of the first text.
    breaks, after = int(head["breaks"] or 0) + head["n"] - 1, (head["first"], head["line"] + 1)
    letters = {p: n for p, n, first in chars if first < after} | ({"\n": breaks} if breaks else {}) | {p: n for p, n, first in chars if first >= after}
    start = letters | {p: n for p, n, _ in top if p not in letters}
    total = sum(start.values())
    log_probs = {p: math.log(n / total) for p, n in start.items()}
    goal = vocab_size - len(special)
    for _ in range(rounds):
        if len(log_probs) <= goal:
            break
        used = {r["piece"]: r["n"] for r in _expected(lines, log_probs | {t: log_probs.get(t, RARE) for t in special}).orderBy("first").collect()}
        scale = sum(used.values()) + len(used)
        log_probs = {p: math.log((n + 1) / scale) for p, n in used.items() if p not in special}
        for ch in letters:
            log_probs.setdefault(ch, RARE)
        over = len(log_probs) - goal
        if over > 0:
            longer = sorted((p for p in log_probs if len(p) > 1), key=lambda p: used.get(p, 0))
            for p in longer[: min(int(prune * len(longer)) + 1, over)]:
                del log_probs[p]
    tokens = dict.fromkeys([*special, *log_probs])
    return Subword("unigram", {t: k for k, t in enumerate(tokens)}, [], log_probs | {t: log_probs.get(t, RARE) for t in special})


def _expected(lines: DataFrame, log_probs: dict[str, float]) -> DataFrame:
    """piece, n and first (the place of its first use) over the best paths of all lines."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = _Paths(log_probs)
        names = np.array([*log_probs], dtype=object)
        for codes, starts, ranks in _ordered(batches, True):
            ends, numbers = paths(codes)
            k, n, at = _tally(numbers, len(names), True)
            text = np.searchsorted(starts, ends[at], "right") - 1
            columns = [pa.array(names[k], pa.string()), pa.array(n, pa.int64()), pa.array(ranks[text], pa.int64()), pa.array(ends[at] - starts[text], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "n", "o", "p"])

    found = lines.mapInArrow(count, "piece string, n long, o long, p long")
    return found.groupBy("piece").agg(F.sum("n").alias("n"), F.min(F.struct("o", "p")).alias("first"))


def encode_column(c: Column, model: Subword, add_eos: bool = False) -> Column:
    """Token ids of a text column; the model travels once per task."""

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model.kind == "unigram":
                yield pd.Series(model.encode_many(texts.tolist(), add_eos), dtype=object)
                continue
            yield pd.Series([None if t is None else model.encode(t, add_eos) for t in texts], dtype=object)

    return F.pandas_udf(encoded, "array<int>")(c)


def train_native(texts: list[str], vocab_size: int = 65_536, min_frequency: int = 2, specials: tuple[str, ...] = ("<|endoftext|>", "<|pad|>")):
    """The industrial byte BPE of the tokenizers library over a bounded sample of texts (two_level_budget makes one)."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    model = Tokenizer(models.BPE())
    model.pre_tokenizer, model.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    model.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=vocab_size, min_frequency=min_frequency, special_tokens=list(specials), initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    return model
