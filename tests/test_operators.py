import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evalmetrics, order, relate, stats


def test_running_matches_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, 1, 5])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = {r["i"]: (r["rank"], r["before"]) for r in order.with_running(df, ["i"], ["g"], F.col("v")).collect()}
    seen = {}
    for g, i, v in rows:
        n, s = seen.get(g, (0, 0))
        assert got[i] == (n, s)
        seen[g] = (n + 1, s + (v or 0))
    assert order.with_running(df.limit(0), ["i"]).count() == 0


def test_budgets(spark):
    def kept(lengths, **limits):
        df = spark.createDataFrame(list(enumerate(lengths)), "i int, n int")
        return order.budget_cut(df, ["i"], F.col("n"), **limits).count()

    assert kept([5, 5, 5, 5], max_chars=10) == 2
    assert kept([5, 5, 5, 5], max_chars=11) == 3
    assert kept([5, 5], max_rows=0) == 1
    assert kept([5, 5, 5], max_rows=2) == 2
    df = spark.createDataFrame([("a", 1, "x" * 6), ("a", 2, "y" * 6), ("b", 3, "z" * 6), ("b", 4, "w" * 6)], "g string, i int, t string")
    got = [r["t"] for r in order.two_level_budget(df, "g", ["i"], "t", 8, 11).orderBy("i").collect()]
    assert got == ["xxxxxx", "yy", "zzz"]


def test_even_sample(spark):
    for (n, m), want in {(10, 4): [0, 3, 6, 9], (6, 3): [0, 2, 5], (8, 5): [0, 2, 4, 5, 7], (3, 5): [0, 1, 2], (5, 1): [0], (4, 0): [0, 1, 2, 3]}.items():
        df = spark.createDataFrame([("g", i) for i in range(n)], "g string, i int")
        assert sorted(r["i"] for r in order.even_sample(df, "g", ["i"], m).collect()) == want


def test_packing_matches_slices(spark):
    rng = random.Random(3)
    docs = [(k, [rng.randrange(100) for _ in range(rng.choice([0, 1, 3, 9]))]) for k in range(40)]
    stream = list(itertools.chain(*[ids for _, ids in docs]))
    df = spark.createDataFrame(docs, "i int, ids array<int>").repartition(4)
    for length in (4, 7):
        got = {r["block_id"]: (r["x"], r["y"]) for r in order.pack_stream(df, ["i"], "ids", length).collect()}
        want = {b: (stream[b * length : (b + 1) * length], stream[b * length + 1 : (b + 1) * length + 1]) for b in range((len(stream) - 1) // length)}
        assert got == want


def test_samples(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "i int, g int")
    one, two = ({r["i"] for r in order.reservoir_sample(df, "i", 10, s).collect()} for s in (1, 2))
    assert len(one) == len(two) == 10 and one != two
    assert order.limit_per_group(df, "g", ["i"], 2).count() == 6
    assert [r["split"] for r in order.periodic_split(df, ["i"], 0.4).orderBy("i").limit(3).collect()] == ["val", "train", "val"]


def test_anti_joins_and_sets(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    ref = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r["k"] for r in relate.drop_keys(df, ref, "k", "k").collect()] == [2, None]
    assert [r["key"] for r in relate.shared_keys(df.where("k is not null"), ref, "k", "k").collect()] == [1]
    assert sorted(r["key"] for r in relate.union_keys((df, "k"), (ref, "k")).collect()) == [1, 2]


def test_near_leaks(spark):
    text = " ".join(f"word{k:03d}" for k in range(25))
    bench = spark.createDataFrame([(1, "humaneval", "7", text), (2, "humaneval", "8", "x" * 119), (3, "humaneval", "9", text)], "item_id long, dataset string, task_id string, prompt string")
    index = relate.bench_index(bench)
    assert index.where("ord = 1").first()["label"] == "humaneval:9"
    n = len(text)
    least = math.ceil(0.85 * n)
    texts = [(1, text), (2, text[:least].strip()), (3, text[: int(0.85 * n) - 8]), (4, "x" * 119), (5, ""), (6, "zz " + text)]
    df = spark.createDataFrame([(i, "question", 0, t) for i, t in texts], "id long, field string, pos int, norm string")
    near = {r["id"] for r in relate.near_leaks(df, index).collect()}
    brute = {i for i, t in texts for b in [r["norm"] for r in index.collect()] if min(len(t), len(b)) >= 120 and min(len(t), len(b)) / max(len(t), len(b)) >= 0.85 and (t in b or b in t)}
    assert near == brute >= {1, 6}
    first = {r["id"]: r["reason"] for r in relate.first_leak(df, index).collect()}
    assert first[1] == "leak:question:humaneval:9" and first[6].startswith("near_leak:question:")


def test_pass_at_k(spark):
    def plain(n, c, k):
        if n <= 0 or k <= 0 or c <= 0:
            return 0.0
        if n - c < k:
            return 1.0
        return 1 - math.prod(1 - k / v for v in range(n - c + 1, n + 1))

    for n, c, k in [(10, 0, 1), (10, 3, 1), (10, 3, 5), (10, 10, 1), (5, 4, 2), (0, 0, 1), (8, 1, 8)]:
        got = spark.createDataFrame([(n, c)], "n int, c int").select(evalmetrics.pass_at_k(F.col("n"), F.col("c"), k).alias("p")).first()["p"]
        assert got == pytest.approx(plain(n, c, k))


def test_advantages_and_groups(spark):
    rows = [("p", 1, 1.0), ("p", 2, 0.0), ("p", 3, 0.0), ("p", 4, 1.0), ("q", 5, 1.0), ("q", 6, 1.0), ("r", 7, 0.95), ("r", 8, -0.05), ("r", 9, 0.45), ("s", 10, 0.0)]
    df = spark.createDataFrame(rows, "prompt string, i int, reward double")
    got = {r["i"]: round(r["advantage"], 6) for r in evalmetrics.group_advantages(df, "prompt", "reward").collect()}
    assert [got[k] for k in range(1, 10)] == [1, -1, -1, 1, 0, 0, 1.224745, -1.224745, 0]
    assert {r["prompt"] for r in evalmetrics.mixed_groups(df, "prompt", "reward").collect()} == {"p", "r"}
    stats_row = evalmetrics.rollout_stats(df, "prompt", "reward").first()
    assert (stats_row["all_positive"], stats_row["mixed"], stats_row["none_positive"]) == (1, 2, 1) and stats_row["keep_fraction"] == 0.7


def test_best_macro_and_loss(spark):
    history = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.7), (4, 0.6)], "step int, metric double").withColumn("run", F.lit("x"))
    rows = evalmetrics.best_so_far(history, "step", "metric", ["run"]).orderBy("step").collect()
    assert [r["is_best"] for r in rows] == [True, False, True, False] and rows[-1]["best"] == 0.7
    empty = spark.createDataFrame([], "a double")
    assert evalmetrics.macro_average(empty, ["a"]).first()["a"] == 0.0 and evalmetrics.macro_average(empty, ["a"], None).first()["a"] is None
    assert evalmetrics.completions_needed(2, [1, 5]) == 5 and evalmetrics.completions_needed(0, []) == 1
    df = spark.createDataFrame([([0.0, 1.0], [0.0, 0.0], [1.0, 1.0], 2.0), ([0.0, 0.0], [0.0, 9.0], [1.0, 0.0], -1.0)], "new_logprobs array<double>, old_logprobs array<double>, mask array<double>, advantage double")
    row = evalmetrics.policy_loss(df).first()
    assert row["loss"] == pytest.approx((-2.0 - 1.28 * 2 + 1.0) / 3) and row["clip_fraction"] == pytest.approx(1 / 3)


def test_counters(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "x string, y int")
    assert {(r["column_name"], r["value"]): r["n_rows"] for r in stats.category_counters(df, ["x", "y"]).collect()} == {("x", "a"): 2, ("x", None): 1, ("y", "1"): 2, ("y", None): 1}
    values = [None, -1.0, 0.0, 0.1, 0.25, 0.75, 1.0, math.nan]
    got = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(stats.pass_bucket(F.col("v")).alias("b")).collect()]
    assert got == ["none", "0", "0", "(0,.25)", "[.25,.75)", "[.75,1)", "1", "1"]
    rows = spark.createDataFrame([("main", "train", "d", 3), ("main", "val", "d", 0)], "stage string, split string, dataset string, n int")
    assert {r["split"]: (r["pct_in_stage"], r["pct_overall"]) for r in stats.mixture(rows, "n").collect()} == {"train": ("100.00%", "100.00%"), "val": ("0.00%", "0.00%")}
    assert stats.size_errors(spark.createDataFrame([(4, 8), (4, 9)], "n_tokens int, n_bytes int"), 2).count() == 1


def test_shuffled_blocks_and_crops(spark):
    blocks = spark.range(23).withColumnRenamed("id", "block_id")
    one = order.shuffled_blocks(blocks, 1, 0, 2, 3).orderBy("position").collect()
    assert len(one) == 18 and len({r["block_id"] for r in one}) == 18
    assert [r["worker"] for r in one[:9]] == [0, 0, 0, 1, 1, 1, 0, 0, 0]
    other = order.shuffled_blocks(blocks, 1, 1, 2, 3).orderBy("position").collect()
    assert [r["block_id"] for r in one] != [r["block_id"] for r in other]
    starts = [r["start"] for r in order.crop_starts(spark, 200, 10, 20, 1).collect()]
    assert min(starts) >= 0 and max(starts) <= 9 and len(set(starts)) > 5
    with pytest.raises(ValueError):
        order.crop_starts(spark, 1, 10, 10, 1)


def test_tasks(spark, tmp_path):
    from corpusmill.operators import tasks

    spark.createDataFrame([(k, k % 5 if k % 7 else None) for k in range(60)], "i int, int_score int").repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    plan = {"name": "x/y", "category": "code", "rules": [{"stage": "anneal", "column": "int_score", "op": "ge", "value": 4}, {"stage": "main", "column": "int_score", "op": "lt", "value": 4, "include_null": True}]}
    rows = tasks.encode_tasks(df, plan).collect()
    assert sum(r["matched_rows"] for r in rows) == 60 and {r["stage"] for r in rows} == {"main", "anneal"}
    assert [r["size"] for r in rows] == sorted((r["size"] for r in rows), reverse=True)
    assert tasks.file_rows(df).agg(F.sum("n_rows")).first()[0] == 60
    for bad in ({}, {"name": "a", "stage": "x"}, {"name": "a", "category": "x"}):
        with pytest.raises(ValueError):
            tasks.described(bad)


def test_salted_join_equals_a_plain_one(spark):
    rng = random.Random(12)
    rows = [(k, rng.choice(["hot", "hot", "hot", "a", "b", None, "none"]), rng.randrange(3), "x") for k in range(400)]
    left = spark.createDataFrame(rows, "id long, a string, b int, __salts string")
    right = spark.createDataFrame([("hot", 0, "r0"), ("hot", 0, "again"), ("hot", 1, "r1"), ("a", 2, "r2"), (None, 0, "no")], "a string, b int, v string")
    counts = left.groupBy("a", "b").agg(F.count("*").alias("n")).where("a is not null")
    for how in ("inner", "left"):
        plain = sorted(map(repr, left.drop("__salts").join(right, ["a", "b"], how).collect()))
        for least in (100_000, 5):
            got = relate.salted_join(left.drop("__salts"), right, ["a", "b"], "id", counts, how=how, least=least)
            assert sorted(map(repr, got.collect())) == plain
    assert relate.hot_keys(counts, ["a", "b"], "n", least=5).where("a = 'hot'").count() == 3
    many = spark.createDataFrame([(str(k), 10) for k in range(50)], "a string, n long")
    assert relate.hot_keys(many, ["a"], "n", most=3, least=1).count() <= 3


def test_anti_join_with_many_nulls(spark):
    df = spark.createDataFrame([(k, None if k % 3 else k % 7, {"m": k}) for k in range(60)], "id long, k int, m map<string,int>")
    keys = spark.createDataFrame([(0,), (3,), (None,)], "o int")
    got = {r["id"] for r in relate.drop_keys(df, keys, "k", "o").collect()}
    assert got == {k for k in range(60) if k % 3 or k % 7 not in (0, 3)}
