"""Problem 7: evaluation texts that appear, wholly or in part, in a training corpus.

Method: every document is brought to the form of problem 8 and cut into words. One pass over the corpus finds
the word n-grams that occur in any test item and keeps only the passages around them. Over those passages
every item that shares an n-gram with a passage is aligned to it, however frequent the n-gram is: a Smith-Waterman
alignment of words scores each pair, so that edited copies are scored too. ``longest_run`` is the exact number of
consecutive words in common. Where only runs count, document frequencies are taken over the hits, and for every window
of ``min_run`` words of an item only the rarest of its n-grams is a seed that joins passages to items.

A window of ``min_run`` >= n words contains a seed whatever the frequencies are, hence no passage of that length
is missed. Null, empty and wordless texts and items match nothing; repeated rows each get their own result;
further columns are ignored. Documents are read whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.lookalike import make_folder
from corpusmill.session import cut_lineage, ship_by_value, spread

MATCH, MISMATCH, GAP = 2, -1, -1


def make_words():
    """A function text -> lower-case runs of ASCII letters and digits of its form, without markup tags."""
    fold = make_folder()
    tag = re.compile(r"</?[A-Za-z][^<>\n]*>")
    word = re.compile(r"[a-z0-9]+")

    def words(text: str) -> list[str]:
        text = fold(text)[0]
        if "<" in text:
            text = tag.sub(" ", text)
        return word.findall(text.lower())

    return words


def grams_of(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def pivots_of(known: frozenset) -> dict[str, tuple[int, ...]]:
    """The rarest word of each n-gram, with the places at which it stands in one: only there need n-grams be looked up."""
    frequency = Counter(word for gram in known for word in gram)
    places: dict[str, set[int]] = {}
    for gram in known:
        at = min(range(len(gram)), key=lambda k: (frequency[gram[k]], k))
        places.setdefault(gram[at], set()).add(at)
    return {word: tuple(sorted(spots)) for word, spots in places.items()}


def _passages(known: frozenset, n: int, margin: int):
    """mapInPandas function: (doc_id, text) -> (doc_id, passage, words, grams) for the places with known n-grams."""
    pivots = pivots_of(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = make_words()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                spots = [i for i, word in enumerate(words) if word in pivots]
                starts = {i - at for i in spots for at in pivots[words[i]]}
                hits = sorted(i for i in starts if i >= 0 and tuple(words[i : i + n]) in known)
                start = 0
                while start < len(hits):
                    end = start
                    while end + 1 < len(hits) and hits[end + 1] - hits[end] <= margin:
                        end += 1
                    low, high = max(0, hits[start] - margin), hits[end] + n + margin
                    grams = sorted({" ".join(words[i : i + n]) for i in hits[start : end + 1]})
                    rows.append((doc, low, " ".join(words[low:high]), grams))
                    start = end + 1
            yield pd.DataFrame(rows, columns=["doc_id", "passage", "words", "grams"])

    return run


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word-id sequences (linear gaps), and their longest common run."""
    width = len(b)
    score = np.zeros(width + 1, dtype=np.int32)
    run = np.zeros(width + 1, dtype=np.int32)
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    best = longest = 0
    for x in a:
        same = b == x
        fresh = np.zeros(width + 1, dtype=np.int32)
        fresh[1:] = np.maximum(score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] + GAP)
        np.maximum(fresh, 0, out=fresh)
        score = np.maximum.accumulate(fresh + ramp) - ramp
        moved = np.zeros(width + 1, dtype=np.int32)
        moved[1:] = np.where(same, run[:-1] + 1, 0)
        run = moved
        best = max(best, int(score.max()))
        longest = max(longest, int(run.max()))
    return best, longest


def align_many(pairs: list[tuple[np.ndarray, np.ndarray]], together: int = 256) -> list[tuple[int, int]]:
    """``align`` of many pairs, those of like length side by side in one array. Padding equals nothing, so it adds no score."""
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    by_length = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]))
    for at in range(0, len(by_length), together):
        group = by_length[at : at + together]
        width = max(len(pairs[k][1]) for k in group)
        height = max(len(pairs[k][0]) for k in group)
        # One pair a column, so that every step runs along whole rows; short numbers where no score can exceed them.
        kind = np.int16 if MATCH * min(height, width) + width < 2**15 else np.int32
        a = np.full((height, len(group)), -2, dtype=np.int32)
        b = np.full((width, len(group)), -3, dtype=np.int32)
        for column, k in enumerate(group):
            a[: len(pairs[k][0]), column], b[: len(pairs[k][1]), column] = pairs[k]
        score, run, best, longest = (np.zeros((width + 1, len(group)), dtype=kind) for _ in range(4))
        ramp = (np.arange(width + 1) * -GAP).astype(kind)[:, None]
        match, mismatch, gap = kind(MATCH), kind(MISMATCH), kind(GAP)
        for x in a:
            same = b == x
            fresh = np.zeros_like(score)
            fresh[1:] = np.maximum(score[:-1] + np.where(same, match, mismatch), score[1:] + gap)
            np.maximum(fresh, 0, out=fresh)
            fresh += ramp
            score = np.maximum.accumulate(fresh, axis=0) - ramp
            moved = np.zeros_like(run)
            moved[1:] = (run[:-1] + kind(1)) * same
            run = moved
            np.maximum(best, score, out=best)
            np.maximum(longest, run, out=longest)
        for k, most, run_of in zip(group, best.max(axis=0), longest.max(axis=0)):
            out[k] = int(most), int(run_of)
    return out


def _aligned(prompts: dict[int, list[str]]):
    """mapInPandas function: (item_id, words of a passage) -> scores of the pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = []
            for item, text in zip(batch["item_id"], batch["words"]):
                ids = {w: k for k, w in enumerate(dict.fromkeys(prompts[item]))}
                pairs.append((np.array([ids.get(w, -1) for w in text.split(" ")], dtype=np.int32), np.array([ids[w] for w in prompts[item]], dtype=np.int32)))
            scores = align_many(pairs)
            rows = [(item, text, *s, len(p[1])) for item, text, s, p in zip(batch["item_id"], batch["words"], scores, pairs)]
            yield pd.DataFrame(rows, columns=["item_id", "words", "score", "longest_run", "item_words"])

    return run


def score_bounds(held: np.ndarray) -> np.ndarray:
    """No alignment of a row's words scores more: every word the other side has may match, every other one costs. One row per pair.

    It holds for either side of a pair, so the smaller of both counts.
    """
    sums = np.cumsum(np.where(held, MATCH, max(MISMATCH, GAP)), axis=1)
    low = np.minimum.accumulate(np.concatenate([np.zeros((len(sums), 1), dtype=sums.dtype), sums[:, :-1]], axis=1), axis=1)
    return (sums - low).max(axis=1, initial=0)


def _scored(prompts: dict[int, list[str]], n: int, min_score: int, together: int = 4096):
    """mapInPandas function: words of a passage -> scores of all items that share an n-gram with it, of frequent n-grams too.

    Pairs that cannot reach ``min_score`` by ``score_bounds`` are not aligned.
    """
    ids = {w: k for k, w in enumerate(dict.fromkeys(w for words in prompts.values() for w in words))}
    sides = {item: np.array([ids[w] for w in words], dtype=np.int32) for item, words in prompts.items()}
    holders: dict[tuple, list[int]] = {}
    row_of = {item: k for k, item in enumerate(prompts)}
    held = np.zeros((len(prompts), len(ids) + 1), dtype=bool)  # the last column stands for words of no item
    longest = max(map(len, sides.values()), default=0)
    padded = np.full((len(prompts), longest), len(ids), dtype=np.int32)
    for item, side in sides.items():
        held[row_of[item], side] = True
        padded[row_of[item], : len(side)] = side
    for item, words in prompts.items():
        for gram in {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}:
            holders.setdefault(gram, []).append(item)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs, items = [], []

            def flush():
                # One row per passage: its words, the longest part of a row, are written once for all its items.
                scores, at, rows = align_many(pairs), 0, []
                for text, near in items:
                    own = scores[at : at + len(near)]
                    rows.append((text, [{"item_id": i, "score": s, "longest_run": r, "item_words": len(sides[i])} for i, (s, r) in zip(near, own)]))
                    at += len(near)
                pairs.clear(), items.clear()
                return pd.DataFrame(rows, columns=["words", "found"])

            for text in batch["words"]:
                words = text.split(" ")
                near = sorted({item for i in range(len(words) - n + 1) for item in holders.get(tuple(words[i : i + n]), ())})
                side = np.array([ids.get(w, -1) for w in words], dtype=np.int32)
                if near and min_score > 0:
                    rows = np.array([row_of[i] for i in near])
                    spoken = np.zeros(len(ids) + 1, dtype=bool)
                    spoken[side[side >= 0]] = True
                    bounds = np.minimum(score_bounds(held[rows][:, side]), score_bounds(spoken[padded[rows]]))
                    near = [i for i, bound in zip(near, bounds) if bound >= min_score]
                pairs += [(side, sides[i]) for i in near]
                items.append((text, near))
                if len(pairs) >= together:
                    yield flush()
            if items:
                yield flush()

    return run


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 5, min_run: int = 12, margin: int = 24, block_items: int = 5000, runs_only: bool = False, min_score: int = 0) -> DataFrame:
    """Scores of all (item, document) pairs that share n words in a row: item_id, doc_id, score, longest_run, item_words.

    ``min_score``: passages whose words show that they score less against an item are not aligned to it and count in neither number.
    ``runs_only``: of the pairs without ``min_run`` words in a row some are left out, which is quicker; all others come out.
    ``docs`` has doc_id and text, ``items`` item_id and prompt. Items are taken in blocks of about
    ``block_items``: what a block sends to the workers is bounded by it.
    """
    if n > min_run:
        raise ValueError("n must not exceed min_run, else passages could be missed")
    spark = docs.sparkSession
    ship_by_value()
    docs = spread(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "prompt").where(F.col("item_id").isNotNull() & F.col("prompt").isNotNull())
    blocks = max(1, math.ceil(items.count() / block_items))
    parts = [_leaks_of_block(spark, docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), n, min_run, margin, runs_only, min_score) for k in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _leaks_of_block(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int, min_run: int, margin: int, runs_only: bool, min_score: int) -> DataFrame:
    words_of = make_words()
    prompts = {r["item_id"]: words_of(r["prompt"]) for r in items.collect()}
    known = frozenset(tuple(w[i : i + n]) for w in prompts.values() for i in range(len(w) - n + 1))
    passages = cut_lineage(docs.mapInPandas(_passages(known, n, margin), "doc_id long, passage int, words string, grams array<string>"))
    best = [F.max(c).alias(c) for c in ("score", "longest_run", "item_words")]
    if not runs_only:
        kind = "words string, found array<struct<item_id: long, score: int, longest_run: int, item_words: int>>"
        # Copies of a passage are aligned once; the items travel in one row, so that no frequent n-gram gathers rows.
        distinct = passages.select("words").distinct().repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        scores = distinct.mapInPandas(_scored(prompts, n, min_score), kind)
        return passages.select("doc_id", "words").join(scores, "words").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*").groupBy("item_id", "doc_id").agg(*best)
    hits = passages.select("doc_id", "passage", F.explode("grams").alias("gram"))
    frequency = hits.select("doc_id", "gram").distinct().groupBy("gram").agg(F.count("*").alias("df"))
    grams = pd.DataFrame([(item, pos, gram) for item, words in prompts.items() for pos, gram in enumerate(grams_of(words, n))], columns=["item_id", "pos", "gram"])
    table = spark.createDataFrame(grams, "item_id long, pos int, gram string").join(frequency, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # The rarest n-gram of every window. One without a hit occurs in no document: then no document holds the window.
    ahead = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, min_run - n)
    rarest = table.withColumn("seed", F.min(F.struct("df", "gram")).over(ahead)).select("item_id", F.col("seed.gram").alias("gram"))
    seeds = rarest.distinct()
    pairs = hits.join(seeds, "gram").select("item_id", "doc_id", "passage").distinct()
    texts = pairs.join(passages.select("doc_id", "passage", "words"), ["doc_id", "passage"])
    # Copies of a passage are aligned once.
    distinct = texts.select("item_id", "words").distinct().mapInPandas(_aligned(prompts), "item_id long, words string, score int, longest_run int, item_words int")
    scored = texts.select("item_id", "doc_id", "words").join(distinct, ["item_id", "words"])
    return scored.groupBy("item_id", "doc_id").agg(*best)
