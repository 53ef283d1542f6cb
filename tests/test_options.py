"""Options, file listings and the smaller operators of this kind."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import rewards, text
from corpusmill.operators import evalmetrics, order, relate
from corpusmill.session import deep_merge, dotlist, load_options
from corpusmill.sources import readers, writers


def test_options_of_files_and_lists(spark, tmp_path):
    (tmp_path / "model.yaml").write_text("size: small\nlayers: 2\n")
    (tmp_path / "main.yaml").write_text("defaults:\n  model: model.yaml\nmodel:\n  layers: 3\ntrain:\n  steps: 10\n")
    got = load_options(spark, str(tmp_path / "main.yaml"), ["train.steps=20", "train.name=a b", "new.flag=true", "x=null"])
    assert got == {"model": {"size": "small", "layers": 3}, "train": {"steps": 20, "name": "a b"}, "new": {"flag": True}, "x": None}
    assert dotlist(["a.b=1", "a.c=[1, 2]"]) == {"a": {"b": 1, "c": [1, 2]}} and deep_merge({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}}


def test_listing_is_the_same_with_and_without_scheme(spark, tmp_path):
    for name in ("a/x.parquet", "a/.hidden/y.parquet", "_temporary/z.jsonl", "b.jsonl", "manifest.json", "c.json", "d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    plain, address = readers.discover(str(tmp_path)), readers.discover(f"file://{tmp_path}")
    names = lambda found: {k: [p.rpartition("/")[2] for p in v] for k, v in found.items()}
    assert names(plain) == names(address) == {"parquet": ["x.parquet"], "jsonl": ["b.jsonl"], "json": ["c.json"]}
    assert readers.discover(f"file://{tmp_path}/none") == {"parquet": [], "jsonl": [], "json": []}
    with pytest.raises(FileNotFoundError):
        readers.data_root(f"file://{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        readers.first_pattern(str(tmp_path), ["q/*.json"])
    assert readers.first_pattern(str(tmp_path), ["q/*.json", "a/*.parquet"]) == [f"{tmp_path}/a/x.parquet"]


def test_bench_lines_count_blank_ones(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"prompt": "p0"}\n\n{"prompt": "p2", "task_id": "own"}\n  \n{"prompt": "p4"}\n')
    rows = readers.read_bench(spark, [str(tmp_path / "b.jsonl")]).collect()
    assert sorted((r["task_id"], r["prompt"]) for r in rows) == [("own", "p2"), ("sample/0", "p0"), ("sample/4", "p4")]
    assert readers.read_bench(spark, [str(tmp_path / "b.jsonl")], limit=1).collect()[0]["prompt"] == "p0"


def test_token_files_of_any_size(spark, tmp_path):
    rng = random.Random(3)
    docs = [(k, [rng.randrange(60000) for _ in range(rng.randrange(9))]) for k in range(200)]
    df = spark.createDataFrame(docs, "i long, tokens array<int>").repartition(5)
    files = writers.write_token_files(df, str(tmp_path / "t"), ["i"], eos=7).collect()
    stream = [x for _, ids in docs for x in [*ids, 7]]
    assert sum(r["n_tokens"] for r in files) == len(stream) and all(r["n_bytes"] == 2 * r["n_tokens"] for r in files)
    read = readers.read_token_file(spark, f"{tmp_path}/t/*.bin", length=50).collect()
    assert max(len(r["tokens"]) for r in read) == 50
    assert [x for r in sorted(read, key=lambda r: (r["file"], r["first"])) for x in r["tokens"]] == stream
    with pytest.raises(Exception, match="outside"):
        writers.write_token_files(spark.createDataFrame([(1, [70000])], "i long, tokens array<int>"), str(tmp_path / "u"), ["i"]).collect()
    assert writers.encode_corpus(df.limit(0).selectExpr("i", "tokens", "'d' AS dataset", "'main' AS stage", "'val' AS split"), str(tmp_path / "v"), ["i"], 7).count() == 0


def test_near_leaks_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "be", "gamma7", "d", "x" * rng.randrange(1, 40)])
    bench = [" ".join(word() for _ in range(rng.choice([3, 6, 9, 11, 30]))) for _ in range(60)]
    texts = []
    for b in bench:
        cut = rng.randrange(0, max(1, len(b) // 6))
        texts += [b, b[cut:], b[: len(b) - cut], "q " + b + " tail", b.replace("be", "bee", 1), b[3:-3]]
    texts = [" ".join(t.split()) for t in texts]
    index = spark.createDataFrame([(b, f"label{k}", k) for k, b in enumerate(bench)], "norm string, label string, ord int")
    df = spark.createDataFrame([(k, "f", 0, t) for k, t in enumerate(texts) if t], "id int, field string, pos int, norm string")
    for least in (20, 120):
        want = {}
        for k, t in enumerate(texts):
            for j, b in enumerate(bench):
                if t and min(len(t), len(b)) >= least and min(len(t), len(b)) / max(len(t), len(b)) >= 0.85 and (t in b or b in t):
                    want.setdefault(k, f"label{j}")
        got = {r["id"]: r["label"] for r in relate.near_leaks(df, index, least).collect()}
        assert got == want and len(want) > 20


def test_budgets_pick_whole_rows(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", None]), "x" * rng.randrange(0, 12), "extra") for k in range(120)]
    df = spark.createDataFrame(rows, "i int, g string, t string, before string").repartition(4)
    got = {r["i"]: r["t"] for r in order.two_level_budget(df, "g", ["i"], "t", 60, 100).collect()}
    want, left = {}, 100
    for g in (None, "a", "b"):
        mine = 60
        for i, h, t, _ in rows:
            if h == g and t:
                piece = t[: min(mine, len(t))]
                mine -= len(piece)
                piece = piece[: max(0, left)]
                left -= len(piece)
                if piece:
                    want[i] = piece
    assert got == want
    assert {r["i"] for r in order.budget_cut(df, ["i"], F.length("t"), None, 30).collect()} == {i for i, *_ in rows if i == 0 or sum(len(r[2]) for r in rows[:i]) < 30}


def test_losses_per_sequence_and_without_tokens(spark):
    rows = [([-1.0, -2.0], [-1.5, -2.0], [1.0, 1.0], 1.0), ([-1.0], [-3.0], [1.0], -1.0), ([-1.0], [-1.0], [0.0], 5.0)]
    df = spark.createDataFrame(rows, "new_logprobs array<double>, old_logprobs array<double>, mask array<double>, advantage double")
    import math

    one = [-min(math.exp(0.5), 1.28), -1.0]
    two = [max(math.exp(2.0), 1.28)]
    flat = evalmetrics.policy_loss(df).first()
    assert flat["loss"] == pytest.approx((sum(one) + sum(two)) / 3) and flat["clip_fraction"] == pytest.approx(2 / 3) and flat["approx_kl"] == 0
    assert evalmetrics.policy_loss(df, per_sequence=True).first()["loss"] == pytest.approx((sum(one) / 2 + two[0]) / 2)
    assert evalmetrics.policy_loss(df.limit(0)).first()["loss"] == 0 and evalmetrics.policy_loss(df.where("advantage = 5")).first()["loss"] == 0


def test_small_texts(spark):
    df = spark.createDataFrame([("  a \nb\t\r\n\n c  \n",), (None,), ("",)], "t string")
    assert [r["o"] for r in df.select(text.plain_output(F.col("t")).alias("o")).collect()] == ["a\nb\n\n c", None, ""]
    sizes = spark.createDataFrame([(0.0,), (1023.0,), (1536.0,), (1024.0**4 * 2000,)], "n double").select(text.byte_size(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in sizes] == ["0.0 B", "1023.0 B", "1.5 KB", "2000.0 TB"]
    times = spark.createDataFrame([(0.0,), (3725.9,), (-1.0,), (None,)], "s double").select(text.duration(F.col("s")).alias("d")).collect()
    assert [r["d"] for r in times] == ["0:00:00", "1:02:05", "?", "?"]
    flags = spark.createDataFrame([("A\nb",)], "t string").select(rewards.single_reward(F.col("t"), "regex", pattern="a.b", flags="is").alias("x"), rewards.single_reward(F.col("t"), "regex", pattern="a.b").alias("y")).first()
    assert (flags["x"], flags["y"]) == (1.0, 0.0)
    with pytest.raises(ValueError):
        rewards.single_reward(F.col("t"), "regex", pattern="a", flags="q")


def test_best_runs_without_groups(spark):
    rng = random.Random(6)
    values = [rng.choice([None, rng.random()]) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(values)), "step int, metric double").repartition(4)
    best = None
    for r, v in zip(sorted(order.running_best(df, ["step"], [], "metric").collect()), values):
        assert r["best_before"] == best
        best = v if best is None else best if v is None else max(best, v)
