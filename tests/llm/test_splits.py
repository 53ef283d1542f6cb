import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusmill.llm import splits

SCHEMA = "file_id long, max_stars_repo_name string, repo_name string, max_stars_repo_path string, owner string, component string, salt int"


def code(spark, rows):
    return spark.createDataFrame([(i, *row, "x", "y", 3) for i, row in enumerate(rows)], SCHEMA)


def test_names_are_one_however_written(spark):
    forms = ["Owner/Repo", " owner/repo ", "owner/repo.git", "https://host.example/owner/repo", "http://www.host.example/owner/repo/", "git@host.example:owner/repo.git", "ssh://git@host.example:22/owner/repo.git", "host.example/owner/repo", "https://host.example/owner/repo/tree/main/src"]
    df = spark.createDataFrame([(f,) for f in forms], "n string").select(splits.repository(F.col("n")).alias("r"))
    assert {r["r"] for r in df.collect()} == {"owner/repo"}
    odd = spark.createDataFrame([(None,), ("",), (" \u200b",), ("bare",)], "n string").select(splits.repository(F.col("n")).alias("r"))
    assert [r["r"] for r in odd.collect()] == [None, None, None, "bare"]


def test_groups_by_chain_of_owners_and_path(spark):
    df = code(spark, [("a/x", "b/x", "src/f.py"), ("B/y", None, "f.py"), (None, "c/x", None), (None, " ", "a/x/src/f.py"), ("", None, "zz/yy/f.py"), (None, None, None), ("d/one", "d/one.git", "p.py"), ("D/two", None, "p.py")])
    found = {(r["group_name"], r["file_id"]) for r in splits.found_groups(df).collect()}
    assert found == {("B/y", 0), ("B/y", 1), ("B/y", 3), ("D/two", 6), ("D/two", 7)}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(70)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(parent):
        groups[find(x)].add(x)
    want = {x: min(g) for g in groups.values() for x in g}
    df = spark.createDataFrame(pairs + [(None, "q"), ("q", None)], "a string, b string")
    for hot in (100_000, 1):
        assert {r["node"]: r["component"] for r in splits.hash_to_min(df, hot=hot).collect()} == want


def test_splits_keep_groups_and_shares(spark):
    rows = [(f"o{k % 400}/r{k}", f"o{(k + 1) % 400 if k % 50 == 0 else k % 400}/r", None) for k in range(2000)] + [(None, None, None)] * 3
    df = code(spark, rows)
    out = {r["file_id"]: r["split"] for r in splits.assign_splits(df, {"train": 0.5, "test": 0.5, "none": 0.0}).collect()}
    assert len(out) == 2003 and set(out.values()) == {"train", "test"}
    by_owner = defaultdict(set)
    for i, row in enumerate(rows[:2000]):
        by_owner[row[0].split("/")[0]].add(out[i])
    assert all(len(s) == 1 for s in by_owner.values())
    assert 0.35 < sum(s == {"train"} for s in by_owner.values()) / 400 < 0.65


def test_empty(spark):
    df = code(spark, [("a/b", None, None)]).limit(0)
    assert splits.found_groups(df).count() == 0
    assert splits.assign_splits(df).count() == 0
