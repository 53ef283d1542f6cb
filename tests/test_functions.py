import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import chat, keys, records, rewards, rules, schedules, subword, text
from corpusmill.session import merge_options, require_columns


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


def test_normalize_and_hash(spark):
    cases = {"  Write a Function: add(a, b)!  ": "write a function add a b", "Größe_1": "gr e 1", "---": "", "": ""}
    for raw, want in cases.items():
        assert one(spark, raw, text.normalize_text) == want
        assert one(spark, raw, text.stable_hash) == hashlib.sha1(want.encode()).hexdigest()
    assert one(spark, None, text.normalize_text) is None


def test_strip_is_pythons(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    rows = [b + "x" + b + "y" + b for b in blanks] + ["", " ", "x", None]
    got = [r["r"] for r in spark.createDataFrame([(r,) for r in rows], "v string").select(text.strip(F.col("v")).alias("r")).collect()]
    assert got == [None if r is None else r.strip() for r in rows]


def test_repetition(spark):
    for raw, want in (("a b c", 0.0), ("a a a b", 0.5), ("", 0.0), ("  ", 0.0), (None, None)):
        assert one(spark, raw, text.repetition_ratio) == want


def test_code_extraction(spark):
    assert one(spark, "x\n```python\na = 1\n```\n```\nb\n```", text.fenced_code) == "a = 1\n"
    assert one(spark, "no fence", text.fenced_code) == "no fence"
    assert one(spark, "```py\nassistant: x = 1\n```", text.code_for_execution) == "x = 1"
    raw = "<think>long\nthought</think>\nHere is the code:\n```python\nx = 1\n```\nand\n```python\ndef f(x):\n    return x\n```"
    assert one(spark, raw, text.clean_solution) == "def f(x):\n    return x"
    assert one(spark, "Here is it:\n\nimport os\nx = 1", text.clean_solution) == "import os\nx = 1"
    assert one(spark, "Some remark\nimport os", text.clean_solution) == "Some remark\nimport os"
    assert one(spark, None, text.clean_solution) == ""
    assert one(spark, "We need this", text.starts_badly) and not one(spark, "\n\nx", text.starts_badly)
    assert one(spark, "import a\n\ndef f(a, b) -> int:\n  pass", text.first_signature) == "def f(a, b) -> int:"
    assert one(spark, "def f(a):", text.function_name) == "f"
    assert one(spark, "a STOP b END", lambda c: text.until_marker(c, ["END", "STOP"])) == "a "
    assert one(spark, "abc", lambda c: text.until_marker(c, ["END"])) == "abc"
    assert one(spark, "a/b c.d-é", text.safe_name) == "a__b_c.d-é"
    assert one(spark, "/a b//", text.slug) == "a_b"
    assert one(spark, [5, 6, 0, 7], lambda c: text.until_eos(c, 0), "array<int>") == [5, 6]
    assert one(spark, 0.12345, text.percent, "double") == "12.35%"


def test_parses_as_python(spark):
    rows = [("x = 1",), ("x = ",), (None,), ("",), ("\0",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(text.parses_as_python()(F.col("v"))).collect()]
    assert got == [True, False, None, True, False]


NULLS = [(3.0,), (None,), (5.0,), (math.nan,)]


def kept(spark, rule, rows=NULLS):
    return [r["v"] for r in spark.createDataFrame(rows, "v double").where(rule(F.col("v"))).collect()]


def test_null_policies(spark):
    assert kept(spark, lambda c: rules.drop_rule(c, drop_le=3.0)) == [None, 5.0]
    assert [str(x) for x in kept(spark, lambda c: rules.drop_rule(c, drop_eq=3.0))] == ["None", "5.0", "nan"]
    assert kept(spark, lambda c: rules.at_least(c, 4)) == [5.0]
    assert kept(spark, lambda c: rules.row_rule(c, "lt", 4.0, True)) == [3.0, None]
    assert kept(spark, lambda c: rules.nonzero_or_null(c), [(0.0,), (None,), (1.0,)]) == [None, 1.0]
    assert kept(spark, lambda c: rules.within(c)) [:3] == [3.0, None, 5.0]
    assert kept(spark, lambda c: rules.within(c, low=3, high=4)) == [3.0]
    for bad in ({"drop_eq": 1, "drop_le": 2}, {}):
        with pytest.raises(ValueError):
            rules.drop_rule(F.col("v"), **bad)
    with pytest.raises(ValueError):
        rules.row_rule(F.col("v"), "gt", 1)
    with pytest.raises(ValueError):
        rules.stage_by_rules(["v"], [{"stage": "other"}])


def test_first_reason_keeps_order(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    reason = rules.first_reason((F.col("v") >= 2, "a"), (F.col("v") >= 3, F.concat(F.lit("b"), F.col("v").cast("string"))))
    assert [r["r"] for r in df.select(reason.alias("r")).collect()] == ["kept", "a", "a"]
    assert one(spark, True, rules.is_true, "boolean") and one(spark, " True ", rules.is_true) and not one(spark, None, rules.is_true)


def test_document_key_and_buckets(spark):
    schema = "repo_name string, path string, url string"
    rows = [("r", "", "u"), ("r", None, None), (None, None, None), ("r", "p", "u")]
    df = spark.createDataFrame(rows, schema)
    got = [r["k"] for r in df.select(keys.document_key(df.columns, F.lit("f"), F.lit(3)).alias("k")).collect()]
    assert got == ["url=u", "repo_name=r", "src=f|row=3", "repo_name=r|path=p"]
    names = ["id=0", "id=1", "repo_name=a/b|path=x.py", "src=f.parquet|row=3"]
    df = spark.createDataFrame([(n,) for n in names], "k string")
    for r in df.select("k", keys.blake_bucket("s")(F.col("k")).alias("b"), keys.sha_bucket(F.col("k"), "s").alias("s")).collect():
        payload = f"s\n{r['k']}".encode()
        assert r["b"] == int.from_bytes(hashlib.blake2b(payload, digest_size=8).digest(), "big") / 2**64
        assert r["s"] == int(hashlib.sha256(payload).hexdigest()[:8], 16) / 2**32
    with pytest.raises(ValueError):
        keys.split_of(F.lit(0.5), 1.0)


def test_contiguous_shards(spark):
    for n, k in ((10, 3), (7, 7), (5, 8)):
        got = [r["s"] for r in spark.range(n).select(keys.contiguous_shard(F.col("id"), F.lit(n), k).alias("s")).collect()]
        want = [next(i for i in range(k) if i * n // k <= x < (i + 1) * n // k) for x in range(n)]
        assert got == want


def test_schedules(spark):
    df = spark.range(0, 101)
    for shape in ("sqrt", "linear", "cosine"):
        for r in df.select("id", schedules.warmup_stable_decay(F.col("id"), 100, 10, 0.8, 1.0, 0.1, shape).alias("x")).collect():
            s = r["id"]
            p = min(max((s - 80) / 20, 0), 1)
            f = {"sqrt": math.sqrt(1 - p), "linear": 1 - p, "cosine": 0.5 * (1 + math.cos(math.pi * p))}[shape] if s < 100 else 0
            assert r["x"] == pytest.approx(s / 10 if s < 10 else 1.0 if s < 80 else 0.1 + 0.9 * f)
    assert one(spark, 900, lambda c: schedules.next_stop(c, 128, 1000), "int") == 1000
    assert one(spark, 950, lambda c: schedules.evaluates_at(c, 100, 1000), "int") is False


TURNS = [("User", " hi "), ("gpt", "yo"), ("system", "")]


def test_chat(spark):
    df = spark.createDataFrame([(TURNS,)], f"t array<{chat.TURN}>")
    turns = F.transform("t", lambda t: chat.turn(t["role"], t["content"]))
    row = df.select(chat.join_turns(turns).alias("j"), chat.render(turns).alias("c"), chat.render(turns, "plain_eot").alias("p"), chat.render(turns, "plain_lower", True).alias("l")).first()
    assert row["j"] == "user: hi\nassistant: yo"
    assert row["c"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>system\n<|im_end|>\n"
    assert row["p"] == "User:\nhi\nAssistant:\nyo\nSystem:\n\n"
    assert row["l"] == "user:\nhi\nassistant:\nyo\nsystem:\n\nAssistant:\n"
    with pytest.raises(ValueError):
        chat.render(turns, "other")


def test_labels_and_padding(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [False, False, True, True, False])], "i array<int>, s array<boolean>")
    row = df.select(chat.shifted_labels(F.col("i"), F.col("s"), 9).alias("a"), chat.shifted_labels(F.col("i"), F.col("s"), 2).alias("l"), chat.shifted_labels(F.col("i"), F.col("s"), 2, "right").alias("r")).first()
    assert row["a"]["input_ids"] == [1, 2, 3, 4] and row["a"]["labels"] == [-1, 3, 4, -1] and row["a"]["attention_mask"] == [1] * 4
    assert row["l"]["input_ids"] == [3, 4] and row["l"]["labels"] == [4, -1]
    assert row["r"]["input_ids"] == [1, 2] and row["r"]["labels"] == [-1, 3]
    short = spark.createDataFrame([([1], [True])], "i array<int>, s array<boolean>").select(chat.shifted_labels(F.col("i"), F.col("s"), 9).alias("a")).first()["a"]
    assert short["input_ids"] == [] and short["labels"] == []
    assert one(spark, [1, 2], lambda c: chat.pad_right(c, F.lit(4), 0), "array<int>") == [1, 2, 0, 0]
    assert one(spark, [1, 2, 3], lambda c: chat.keep_last(c, 2), "array<int>") == [2, 3]
    assert chat.alias_plan(["<a>", "<b>"], {"<b>": 5, "<unused9>": 9, "<unused1>": 3}, ["unused"]) == ({"<b>": 5, "<a>": 3}, "")
    assert chat.alias_plan(["<a>"], {"x": 1}, ["unused"])[0] == {} and "exceeds" in chat.alias_plan([], {"x": 99_999}, [])[1]


def test_text_choice(spark):
    df = spark.createDataFrame([("i", None, "o"), ("i", None, " "), ("i", " x ", ""), (None, None, None)], "instruction string, input string, output string")
    got = [r["r"] for r in df.select(chat.text_of_row([F.col("output")], None, F.col("instruction"), F.col("input"), F.col("output")).alias("r")).collect()]
    assert got == ["o", "i\n", "i\nx\n", None]


def test_rewards(spark):
    df = spark.createDataFrame([("```python\nx\n``` a a", None, "FAIL PASS", None), ("b", True, None, None), ("c", None, "PASS", None), (None, False, "PASS", None)], "r string, passed boolean, stdout string, stderr string")
    plan = [{"name": "code_block", "kwargs": {"language": "python"}, "weight": 2.0}, {"name": "length", "kwargs": {"min_chars": 2}, "clip_min": 0.25}, {"name": "code_execution", "kwargs": {"outputs": ("stdout", "stderr")}}]
    score, parts = rewards.composite(F.col("r"), plan)
    rows = df.select(score.alias("s"), parts.alias("p")).collect()
    assert [r["s"] for r in rows] == [3.0, 1.25, 1.25, None]
    assert rows[0]["p"] == {"code_block": 1.0, "length": 1.0, "code_execution": 0.0}
    with pytest.raises(KeyError):
        rewards.single_reward(F.col("r"), "other")


def test_polymorphic_tests(spark):
    shapes = {
        '[{"input": "1 2\\n", "output": "3\\n"}]': ("stdin", "", 1), '{"inputs": ["1 2\\n"], "outputs": ["3\\n", "4"]}': ("stdin", "", 1), '{"fn_name": "add", "inputs": [[1, 2]], "outputs": [[3]]}': ("function", "add", 1),
        '[{"testtype": "functional", "input": "[1, 2]\\n3", "output": "6"}]': ("function", "f", 1), '[{"type": "function_call", "fn_name": "g", "input": [1, 2], "output": [3]}]': ("function", "f", 1),
    }
    rows = [(k, raw, "p " * 20, "f", "lcbv5") for k, raw in enumerate(shapes)] + [(10, '"no shape"', "p", "f", "s"), (11, "{bad json", "p", "f", "s"), (12, None, "p", None, "s"), (13, "[]", None, None, "s")]
    df = spark.createDataFrame(rows, "problem_id int, tests string, problem string, func_name string, source string")
    got = {r["problem_id"]: r for r in records.problem_decisions(df).collect()}
    for k, want in enumerate(shapes.values()):
        assert (got[k]["task_type"], got[k]["entry_point"], len(got[k]["cases"])) == want and got[k]["reason"] == "kept"
    assert [got[k]["reason"] for k in (10, 11, 12, 13)] == ["unsupported_tests", "tests_json_error", "tests_json_error", "missing_problem"]
    assert got[3]["uses_class"] and got[3]["cases"][0]["input"] == "[[1, 2], 3]"


def test_test_programs_and_metadata(spark):
    df = spark.createDataFrame([("humaneval", "def f(x):\n", "    return x\n", "f", "def check(c): pass", []), ("mbpp", "p", "```python\ndef g(): pass\n```", "g", "", ["assert g() is None"])], "kind string, prompt string, completion string, entry string, test string, tests array<string>")
    got = [r["p"] for r in df.select(records.test_program(F.col("kind"), F.col("prompt"), F.col("completion"), F.col("entry"), F.col("test"), F.col("tests")).alias("p")).collect()]
    assert got[0] == "def f(x):\n    return x\n\ndef check(c): pass\n\ncheck(f)\nprint('ALL TESTS PASSED')\n"
    assert got[1] == "def g(): pass\n\nassert g() is None\n\nprint('ALL TESTS PASSED')\n"
    assert records.set_name(" MBPP-plus ") == "mbppplus" and records.set_name("humaneval") == "openai_humaneval"
    with pytest.raises(ValueError):
        records.set_name("other")
    rollouts = spark.createDataFrame([(0, {"a": "1"}), (1, None)], "prompt_index int, metadata map<string,string>")
    prompts = spark.createDataFrame([(0, {"a": "0", "b": "2"})], "prompt_index int, metadata map<string,string>")
    assert {r["prompt_index"]: r["metadata"] for r in records.reward_inputs(rollouts, prompts).collect()} == {0: {"a": "1", "b": "2"}, 1: {}}
    payload = spark.createDataFrame([('{"status":"success","output":{"stdout":"x"}}',), ('{"output":"boom"}',), ("broken",)], "p string").select(records.sandbox_result(F.col("p")).alias("r")).collect()
    assert [(r["r"]["status"], r["r"]["stdout"], r["r"]["stderr"]) for r in payload] == [("success", "x", ""), ("error", "", "boom"), ("error", "", "")]


def test_subword(spark, tmp_path):
    df = spark.createDataFrame([(1, "low lower newest"), (2, "It's  Größe 42!\n x")], "i int, t string")
    words = subword.word_counts(df, "t", "i")
    assert {r["word"] for r in words.where("first.o = 2").collect()} == {"It", "'s", " ", " Größe", " 42", "!", "\n", " x"}
    first = subword.gather_words(subword.word_counts(df.where("i = 1"), "t", "i"))
    assert subword.train_bpe(first, 100).merges == [("l", "o"), ("lo", "w")]
    with pytest.raises(ValueError):
        subword.gather_words(words, 3)
    texts = ["low lower newest, newest lowest", "ünï côde 漢字", "a  b\tc", ""]
    corpus = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string")
    for kind in ("bpe", "byte_bpe"):
        model = subword.train_bpe(subword.gather_words(subword.word_counts(corpus, "t", "i")), 400, kind)
        model.save(str(tmp_path / kind / "tokenizer.json"))
        again = subword.Subword.load(str(tmp_path / kind))
        for t in texts:
            assert again.decode(again.encode(t)) == t
    piece = subword.train_wordpiece(subword.gather_words(subword.word_counts(corpus, "t", "i", subword.WORD, lower=True)), 60)
    assert piece.decode(piece.encode("Lower newest")) == "lower newest"
    assert piece.encode("zzz") == [piece.token_to_id["[UNK]"]]
    uni = subword.train_unigram(corpus, "t", "i", 60)
    assert all(uni.decode(uni.encode(t)) == t for t in texts[:3])
    ids = corpus.select("t", subword.encode_column(F.col("t"), uni).alias("x")).collect()
    assert all(r["x"] == uni.encode(r["t"]) for r in ids)
    with pytest.raises(ValueError):
        uni.check_dtype(10)


def test_viterbi_against_all_paths():
    rng = random.Random(2)
    for _ in range(30):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))): -rng.random() * 5 for _ in range(5)} | {"a": -3.0, "b": -3.0}
        line = "".join(rng.choice("ab") for _ in range(6))

        def paths(rest):
            return [0.0] if not rest else [pieces[rest[:k]] + x for k in range(1, len(rest) + 1) if rest[:k] in pieces for x in paths(rest[k:])]

        found, value = subword.best_path(line, pieces)
        assert "".join(found) == line and value == pytest.approx(max(paths(line)))


def test_options(spark):
    assert merge_options({"a": 1, "b": 2}, None, {"a": None, "b": 3}) == {"a": 1, "b": 3}
    with pytest.raises(ValueError):
        require_columns(spark.range(1), ["id", "x"])
    assert re.fullmatch(r"[\w.]+", "a.b")
