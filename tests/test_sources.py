import json

import pytest
from pyspark.sql import functions as F

from corpusmill.session import table
from corpusmill.sources import readers, writers
from corpusmill.streaming import clean


@pytest.fixture
def corpus(tmp_path, spark):
    root = tmp_path / "c"
    (root / "hf_snapshot" / ".cache").mkdir(parents=True)
    snap = root / "hf_snapshot"
    (snap / "a-train.jsonl").write_text('{"text": " one "}\n\n{"content": "two"}\n')
    (snap / "b-test.jsonl").write_text('{"markdown": "three"}\n')
    (snap / ".cache" / "x.jsonl").write_text('{"text": "hidden"}\n')
    (snap / "list.json").write_text('[{"text": "four"}, {"text": ""}]')
    (snap / "manifest.json").write_text("{}")
    (snap / "dataset_infos.json").write_text("{}")
    (root / "data_meta.json").write_text(json.dumps({"split": "test"}))
    spark.createDataFrame([("five", 1)], "text string, n int").coalesce(1).write.parquet(str(snap / "p.parquet"))
    return root


def test_discovery_and_reading(spark, corpus):
    assert readers.data_root(str(corpus)).endswith("hf_snapshot")
    files = readers.discover(readers.data_root(str(corpus)))
    assert [len(files[f]) for f in ("parquet", "jsonl", "json")] == [1, 2, 1]
    assert {r["__text"] for r in readers.read_corpus(spark, str(corpus), split="train").collect()} == {"one", "two", "four", "five", None}
    assert {r["__text"] for r in readers.read_corpus(spark, str(corpus)).collect()} == {"three", "four", "five", None}
    with pytest.raises(FileNotFoundError):
        readers.data_root(str(corpus / "none"))
    assert readers.text_field_of(["a", "content"]) == "content"
    with pytest.raises(ValueError):
        readers.text_field_of(["a"])
    assert readers.first_shards(["b", "a", "c"], 2) == ["a", "b"]


def test_json_shapes(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"data": [{"x": 1}, {"x": 2}]}')
    assert readers.read_json(spark, [str(tmp_path / "d.json")]).count() == 2
    (tmp_path / "l.jsonl").write_text('"bare"\n{"output": "o"}\n{broken\n\n')
    rows = readers.read_lines(spark, [str(tmp_path / "l.jsonl")]).collect()
    assert {r["text"] for r in rows} == {"bare", "o", None} and sum(r["value"] is None for r in rows) == 1
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, [str(tmp_path / "bad.jsonl")]).collect()


def test_sft_and_prompts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"messages": [{"role": "human", "content": "hi"}, {"role": "gpt", "content": "yo"}]}\n')
    (tmp_path / "manifest.json").write_text("{}")
    df = readers.read_sft(spark, [str(tmp_path)])
    assert [(t["role"], t["content"]) for t in df.select(readers.normal_turns(df).alias("t")).first()["t"]] == [("user", "hi"), ("assistant", "yo")]
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(ValueError):
        readers.read_sft(spark, [str(tmp_path / "x.txt")])
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "q.jsonl").write_text('{"prompt": "P", "task_id": "t", "num_tests": 3}\n{"prompt": "", "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}\n')
    rows = readers.read_prompts(spark, [str(tmp_path / "p" / "q.jsonl")]).collect()
    assert rows[0]["prompt"] == "P" and rows[0]["metadata"] == {"task_id": "t", "num_tests": "3"}
    assert rows[1]["prompt"] == "user:\nu\nAssistant:\n"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(k, [k, k + 1], "main", "val" if k == 3 else "train") for k in range(7)], "i int, tokens array<int>, stage string, split string")
    writers.write_jsonl(df.select("i").coalesce(1), str(tmp_path / "j"), rows_per_file=3)
    assert len(list((tmp_path / "j").glob("*.jsonl"))) == 3
    writers.write_split_tokens(df, str(tmp_path / "t"), eos=9)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.where("split = 'val'").first()["tokens"] == [3, 4, 9]
    files = writers.write_token_files(df, str(tmp_path / "bin"), ["i"])
    assert files.agg(F.sum("n_tokens"), F.sum("n_bytes")).first()[:] == (14, 28)
    tokens = [t for r in readers.read_token_file(spark, str(tmp_path / "bin" / "*.bin")).orderBy("file").collect() for t in r["tokens"]]
    assert sorted(tokens) == sorted(t for k in range(7) for t in (k, k + 1))
    target = str(tmp_path / "tab")
    df.write.parquet(target)
    assert not writers.replace_table(spark.read.parquet(target), target, before=7)
    assert writers.replace_table(spark.read.parquet(target).where("i > 2"), target, before=7)
    assert spark.read.parquet(target).count() == 4
    writers.write_manifest(str(tmp_path / "m" / "manifest.json"), {"kept": 4}, seed=1)
    assert json.loads((tmp_path / "m" / "manifest.json").read_text()) == {"seed": 1, "counts": {"kept": 4}}
    decided = spark.createDataFrame([("leak:question:a:1", "x"), ("kept", "y"), ("near_leak:q:b", "z")], "reason string, question_id string")
    assert writers.rejects(decided).count() == 2


def test_counts_and_fakes(spark, data):
    docs = table(spark, data, "documents")
    row = readers.row_counts(docs).first()
    assert (row["format"], row["n_files"], row["n_rows"]) == ("parquet", 1, docs.count())
    assert readers.preview(docs.select("text"), "text").count() == 3
    prompts = spark.createDataFrame([(0, "p"), (1, "q")], "prompt_index int, prompt string")
    assert readers.fake_rollouts(prompts, 3).count() == 6


def test_stream_equals_batch(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    stream = clean.read_stream(spark, f"{data}/documents.parquet*", docs.schema)
    for _ in range(2):  # the second run finds nothing new
        clean.run_available(clean.clean(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, clean.clean(docs).collect())) and got
