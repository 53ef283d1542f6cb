"""Problems' operators that do the whole job, against brute force on small fixtures."""

import random

import numpy as np

from corpusmill.llm import leakage, pairs, provenance
from corpusmill.llm import queries as llm
from corpusmill.session import table


def test_rates_cover_the_exercises(spark, tmp_path):
    code = [(1, "a/b", None, "x.py", "def f(:\n"), (2, "a/b", None, "y.py", "x = 1\n"), (3, None, None, "z.py", "x = 1\n")]
    spark.createDataFrame(code, "file_id long, max_stars_repo_name string, repo_name string, max_stars_repo_path string, content string").write.parquet(f"{tmp_path}/code_files.parquet")
    spark.createDataFrame([(1, "x = 1", "def t(:"), (2, None, ""), (3, "y = (", "z = 2"), (4, "y = 3", " \n")], "row_id long, solution string, test string").write.parquet(f"{tmp_path}/kodcode_v1.parquet")
    got = {(r["src_table"], r["field_name"], r["repo"], r["language"]): (r["n_checked"], r["n_broken"], r["rate"]) for r in llm.queries()["p5_rates"](spark, str(tmp_path)).collect()}
    assert got == {
        ("code_files", "content", "a/b", "python"): (2, 1, 0.5), ("code_files", "content", "unknown", "python"): (1, 0, 0.0),
        ("kodcode_v1", "solution", "unknown", "python"): (3, 1, 0.333333), ("kodcode_v1", "test", "unknown", "python"): (2, 1, 0.5),
    }


def test_every_shared_passage_is_scored(spark):
    # Old seeds: the rarest n-gram of a window, and those of one item; here both items share the n-grams that are left whole.
    rng = random.Random(3)
    shared = [f"common{k}" for k in range(8)]
    items = {i: [f"i{i}a{k}" for k in range(6)] + shared + [f"i{i}b{k}" for k in range(20)] for i in (1, 2)}
    docs = {}
    for d in range(60):
        words = [f"x{rng.randrange(400)}" for _ in range(20)]
        for i, p in items.items():
            # Every third word of the item is another; only the n-gram that both items have is left whole.
            words += [w if w in shared or k % 3 and k not in (5, 14) else "other" for k, w in enumerate(p)] if d % (2 * i) == 0 else []
        docs[d] = words + [f"y{rng.randrange(400)}" for _ in range(20)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, prompt string")
    want = {}
    for d, words in docs.items():
        for i, p in items.items():
            ids = {w: k for k, w in enumerate(p)}
            grams = set(leakage.grams_of(words, 5)) & set(leakage.grams_of(p, 5))
            score = leakage.align(np.array([ids.get(w, -1) for w in words]), np.arange(len(p)))
            if grams and score[0] >= 24:
                want[i, d] = score
    got = {(r["item_id"], r["doc_id"]): (r["score"], r["longest_run"]) for r in leakage.find_leaks(df, bench).where("score >= 24").collect()}
    assert got == want and len(want) >= 30
    rare = leakage.find_leaks(df, bench, runs_only=True)
    assert rare.where("longest_run >= 12").count() == sum(r >= 12 for _, r in want.values())


def test_ends_are_counted_over_all_rows(spark, data, monkeypatch):
    rows = pairs._shaped(table(spark, data, "sft_pairs"))
    whole = pairs.EndModel([r["answer"] for r in rows.collect() if r["answer"] and r["answer"].strip()])
    counted = pairs.EndModel.of_rows(rows.repartition(3), "answer")
    assert vars(counted) == vars(whole) and whole.all
    used = []
    monkeypatch.setattr(pairs.EndModel, "settle", lambda self, settle=pairs.EndModel.settle: (settle(self), used.append(self))[0])
    pairs.pair_defects(table(spark, data, "sft_pairs"), sample=5)
    assert [m.all for m in used] == [whole.all]


def test_leading_comment_is_searched_whole(spark):
    licence = "".join(f"# Line {k} of the terms under which this text may be passed on to others.\n" for k in range(90))
    body = "import os\n\n\ndef load(path):\n    return sorted(os.listdir(path))\n"
    rows = [(1, "o/r", None, "src/a.py", licence + "# Code generated by tool v1. DO NOT EDIT.\n" + body), (2, "o/r", None, "src/b.py", licence + body)]
    df = spark.createDataFrame(rows, "file_id long, max_stars_repo_name string, repo_name string, max_stars_repo_path string, content string")
    assert len(licence) > 4000
    assert {r["file_id"]: r["label"] for r in provenance.file_labels(df).collect()} == {1: "generated", 2: "handwritten"}


def test_refusal_is_found_anywhere_in_a_long_answer():
    judge = pairs.make_judge(pairs.LanguageModel([]), pairs.EndModel([]))
    talk = "The queue keeps its own index, so the reader never has to wait. " * 12
    assert judge("What is a queue?", None, talk + "I can't help with that request.", "en") == "refusal"
    assert len(talk) > 700 and judge("What is a queue?", None, talk.strip(), "en") is None
