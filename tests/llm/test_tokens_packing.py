import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import packing, tokens


@pytest.fixture(scope="module")
def bpe(spark, data):
    return tokens.ByteBpe.load(spark, data)


def plain_count(bpe, text):
    import re

    encode = tokens.make_encoder(bpe)
    return sum(len(encode(p.encode())) for p in re.findall(tokens.PRETOKEN, text))


TEXTS = ["", " ", "It's  Größe 42!\n x", "def f(x):\n\treturn x's", "漢字かな" * 40, "a" * 500, "x'''s" * 20, "''s 've 'll", "\u200b\xa0", "0" * 300 + "=" * 200]


def test_counts_match_plain_merging(bpe):
    count = tokens.make_counter(bpe)
    for text in TEXTS:
        assert count(text) == plain_count(bpe, text)


def test_cuts_are_independent(bpe):
    rng = random.Random(1)
    count = tokens.make_counter(bpe)
    alphabet = "ab'stve ré\n\t.,()漢0_"
    for size in (3, 10, 40):
        cut = tokens.make_cutter(bpe, size)
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200)))
            parts = cut(text)
            assert "".join(parts) == text
            assert sum(map(count, parts)) == count(text)


def test_oversized_texts_and_labels(spark, data, bpe):
    long = "lorem ipsum dolor " * 400
    rows = [(1, long, " EN-us ", "S"), (1, long, "English", "s "), (2, None, None, None), (3, "", "py", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    small = tokens.with_token_counts(df, "text", bpe, ["doc_id"], oversize=100, chunk=50)
    count = tokens.make_counter(bpe)
    assert sorted(r["n_tokens"] for r in small.collect()) == sorted([count(long)] * 2 + [0, 0])
    labels = df.select(tokens.uniform_language(F.col("lang")).alias("l"), tokens.uniform(F.col("source")).alias("s")).collect()
    assert [tuple(r) for r in labels] == [("en", "s"), ("en", "s"), ("unknown", "unknown"), ("python", "unknown")]


def test_chunked_counts_equal_whole_ones(spark, data, bpe):
    """Every document cut at any size: the same numbers, row by row, as without a cut."""
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("n_tokens", F.lit("clash"))
    whole = {r["doc_id"]: r["n_tokens"] for r in tokens.with_token_counts(docs, "text", bpe, ["doc_id"], oversize=10**9).collect()}
    for oversize, chunk in ((200, 100), (8_000, 4_000)):
        cut = {r["doc_id"]: r["n_tokens"] for r in tokens.with_token_counts(docs, "text", bpe, ["doc_id"], oversize=oversize, chunk=chunk).collect()}
        assert cut == whole


def greedy_blocks(sizes, capacity):
    """Best-two-fit one document at a time, as the plan on the histogram must make it."""
    left = sorted(sizes)
    out = []
    while left:
        block, gap = [], capacity
        for k in range(len(left) - 1, -1, -1):
            if left[k] <= gap:
                gap -= left[k]
                block.append(left.pop(k))
        if gap:
            s = min(block)
            best = max(((a + b, max(a, b), min(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if s < a + b <= gap + s), default=None)
            if best:
                block.remove(s)
                for v in best[1:]:
                    block.append(v)
                    left.remove(v)
                left = sorted([*left, s])
        out.append(sorted(block))
    return sorted(out)


def test_plan_is_best_two_fit():
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.choice([7, 12, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 60))]
        plan = packing.plan_blocks({s: sizes.count(s) for s in set(sizes)}, capacity)
        blocks = sorted(sorted(s for s, k in used.items() for _ in range(k)) for times, used in plan for _ in range(times))
        assert blocks == greedy_blocks(sizes, capacity)
    assert packing.plan_blocks({}, 5) == []


def test_every_piece_is_placed_once(spark):
    rng = random.Random(5)
    counts = [(i, rng.choice([0, 3, 5, 5, 5, 9, 16, 17, 40])) for i in range(500)]
    df = spark.createDataFrame(counts, "doc_id long, n_tokens int")
    blocks = spark.createDataFrame([("a", 16), ("b", 7), ("c", None), ("d", 0)], "config string, block_size int")
    for chunk in (50, 10_000):
        rows = packing.pack(df, blocks, rows_per_chunk=chunk).collect()
        for config, size in (("a", 16), ("b", 7)):
            mine = [r for r in rows if r["config"] == config]
            used = {}
            for r in mine:
                used[r["block_id"]] = used.get(r["block_id"], 0) + r["n_tokens"]
            assert max(used.values()) <= size and sum(used.values()) == sum(n for _, n in counts)
            assert len({(r["doc_id"], r["piece"]) for r in mine}) == len(mine)
            assert all(sum(r["doc_id"] == i for r in mine) == -(-n // size) for i, n in counts[:60])
            assert sorted(used) == list(range(len(used)))
    assert {r["config"] for r in rows} == {"a", "b"}


def test_empty(spark, bpe):
    docs = spark.createDataFrame([(1, " "), (2, None)], "doc_id long, text string")
    blocks = spark.createDataFrame([("a", 16)], "config string, block_size int")
    assert packing.pack_documents(docs, blocks, bpe).count() == 0
    assert packing.pack_documents(docs, blocks.limit(0), bpe).count() == 0
    assert packing.pack_documents(docs.limit(0), blocks, bpe).count() == 0
