"""The registered queries of the problems on the smallest tables: against their SQL or against a plain restatement in memory."""

import itertools
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import leakage, lookalike, pairs, provenance, queries, syntax, tokens
from corpusmill.session import table


@pytest.fixture(scope="module")
def run(spark, data):
    kept = {}

    def one(name):
        if name not in kept:
            kept[name] = [r.asDict() for r in queries.queries()[name](spark, data).collect()]
        return kept[name]

    return one


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, data, run):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    relation = con.sql(queries.oracle_sql()[name])
    want = Counter(tuple(sorted(zip(relation.columns, row), key=str)) for row in relation.fetchall())
    assert Counter(tuple(sorted(r.items(), key=str)) for r in run(name)) == want and want


def test_columns_of_the_found_queries(spark, data):
    columns = {n: [(f.name, f.dataType.simpleString()) for f in queries.queries()[n](spark, data).schema] for n in queries.queries() if n.endswith("_found")}
    assert columns == {
        "p1_found": [("group_name", "string"), ("file_id", "bigint")], "p3_found": [("pair_id", "bigint"), ("defect", "string")], "p4_found": [("file_id", "bigint")],
        "p5_found": [("src_table", "string"), ("row_id", "bigint"), ("field_name", "string")], "p7_found": [("item_id", "bigint"), ("doc_id", "bigint")], "p8_found": [("doc_id_a", "bigint"), ("doc_id_b", "bigint")],
    }


def test_splits_keep_found_groups_together(run):
    split = {r["file_id"]: r["split"] for r in run("p1_splits")}
    groups = defaultdict(set)
    for r in run("p1_found"):
        groups[r["group_name"]].add(split[r["file_id"]])
    assert groups and all(len(s) == 1 for s in groups.values())


def test_token_budget_counts_every_text(spark, data, run):
    bpe = tokens.ByteBpe.load(spark, data)
    count = tokens.make_counter(bpe)
    want = {"documents": [r["text"] for r in table(spark, data, "documents").collect()], "code_files": [r["content"] for r in table(spark, data, "code_files").collect()]}
    for name, texts in want.items():
        rows = [r for r in run("p2_token_budget") if r["src_table"] == name]
        assert sum(r["n_rows"] for r in rows) == len(texts) and sum(r["n_tokens"] for r in rows) == sum(count(t or "") for t in texts)
        assert len({(r["source"], r["lang"], r["category"]) for r in rows}) == len(rows)


def test_pairs_equal_the_judge(spark, data, run):
    rows = [tuple(r) for r in pairs._shaped(table(spark, data, "sft_pairs")).collect()]
    models = pairs.fit([(i, q, a, label) for i, q, _, a, label in rows])
    judge = pairs.make_judge(*models)
    want = {i: judge(q, x, a, label) for i, q, x, a, label in rows}
    assert {r["pair_id"]: r["defect"] for r in run("p3_found")} == {i: d for i, d in want.items() if d} and any(want.values())


def test_labels_of_files(spark, data, run):
    by_level = {r["file_id"]: r["label"] for r in provenance.file_labels(table(spark, data, "code_files"), max_dirs=0).collect()}
    assert {r["file_id"] for r in run("p4_found")} == {i for i, label in by_level.items() if label not in (None, "handwritten")}
    assert {r["label"]: r["n_files"] for r in run("p4_labels")} == Counter(label or "no content" for label in by_level.values())


def test_broken_texts_equal_the_checker(spark, data, run):
    check = syntax.make_checker()
    bad = lambda language, t: bool(t and t.strip() and language and check(language, t) and not (language == "python" and syntax.python_accepts(t)))
    code = table(spark, data, "code_files").select("file_id", syntax.language_of_path(F.col("max_stars_repo_path")).alias("l"), "content").collect()
    want = {("code_files", r["file_id"], "content") for r in code if bad(r["l"], r["content"])}
    exercises = table(spark, data, "kodcode_v1").select("row_id", "solution", "test").collect()
    want |= {("kodcode_v1", r["row_id"], f) for r in exercises for f in ("solution", "test") if bad("python", r[f])}
    assert {(r["src_table"], r["row_id"], r["field_name"]) for r in run("p5_found")} == want and want
    assert sum(r["n_broken"] for r in run("p5_rates")) == len(want)
    # For Python, the compiler has the last word on what is valid.
    assert {k for k in want if k[0] == "kodcode_v1"} == {("kodcode_v1", r["row_id"], f) for r in exercises for f in ("solution", "test") if r[f] and r[f].strip() and not syntax.python_accepts(r[f])}


def test_blocks_hold_every_document_once(spark, data, run):
    bpe = tokens.ByteBpe.load(spark, data)
    count = tokens.make_counter(bpe)
    sizes = {r["doc_id"]: count(r["text"]) for r in table(spark, data, "documents").collect() if r["text"] and r["text"].strip()}
    capacity = {r["config"]: r["block_size"] for r in table(spark, data, "block_sizes").collect()}
    fill = {r["config"]: r for r in run("p6_fill")}
    for config, room in capacity.items():
        rows = [r for r in run("p6_pack") if r["config"] == config]
        blocks, docs = Counter(), defaultdict(list)
        for r in rows:
            blocks[r["block_id"]] += r["n_tokens"]
            docs[r["doc_id"]].append((r["piece"], r["first_token"], r["n_tokens"]))
        assert max(blocks.values()) <= room and set(docs) == {d for d, n in sizes.items() if n}
        for d, pieces in docs.items():
            pieces.sort()
            assert [p[1] for p in pieces] == list(range(0, sizes[d], room)) and sum(p[2] for p in pieces) == sizes[d]
        assert fill[config]["n_blocks"] == len(blocks) and fill[config]["fill"] == pytest.approx(sum(blocks.values()) / len(blocks) / room, abs=1e-6)


def test_leaks_equal_a_search_of_all_runs(spark, data, run):
    words = leakage.make_words()
    docs = {r["doc_id"]: words(r["text"]) for r in table(spark, data, "documents").collect() if r["text"]}
    items = {r["item_id"]: words(r["prompt"]) for r in table(spark, data, "bench_items").collect()}
    runs = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    held = {d: runs(w) for d, w in docs.items()}
    want = {(i, d) for i, w in items.items() for d, h in held.items() if runs(w) & h}
    assert {(r["item_id"], r["doc_id"]) for r in run("p7_found")} == want and want
    assert want <= {(r["item_id"], r["doc_id"]) for r in run("p7_leaks")} and all(r["score"] >= 24 for r in run("p7_leaks"))


def test_same_look_equals_comparing_forms(spark, data, run):
    fold = lookalike.make_folder()
    docs = [(r["doc_id"], r["text"], fold(r["text"])[0]) for r in table(spark, data, "documents").collect() if r["text"]]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(docs, 2) if a[2] == b[2] and a[1] != b[1]}
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in run("p8_found")} == want and want
    links = Counter(d for pair in want for d in pair)
    assert {r["doc_id"]: r["n_links"] for r in run("p8_classes")} == {d: links[d] for d, _, _ in docs}
    assert sum(r["n_changed"] for r in run("p8_forms")) == sum(f != t for _, t, f in docs)
