"""Registered queries of readers, writers, streams and record helpers. What is written goes to the shared folder for checkpoints and is read again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import chat, keys, records, rewards, rules, subword, text
from corpusmill.operators import evalmetrics, order, relate, stats, tasks
from corpusmill.plans import catalog
from corpusmill.plans.catalog import BUCKET, INDEX, NEAR, SALT, STYLES, WORDS_SQL, norm_sql, query, strip_sql
from corpusmill.session import checkpoint_dir, ship_by_value, spread, table
from corpusmill.sources import readers, writers
from corpusmill.streaming import clean as streaming


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5("text").alias("digest"), F.col("int_score").cast("long").alias("int_score"))


DOCS_SQL = "SELECT doc_id, md5(text) AS digest, int_score::BIGINT AS int_score FROM documents"


# ---- readers


@query("SELECT * FROM (VALUES ('parquet', 3), ('jsonl', 2), ('json', 0)) t(format, n_files)")
def file_discovery(spark, directory):
    """Files by format; hidden folders, folders of writers and metadata files do not count."""
    base = scratch(spark, "discovery")
    docs = table(spark, directory, "documents").select("doc_id", "text")
    docs.repartition(3, "doc_id").write.parquet(f"{base}/hf_snapshot/data")
    writers.write_jsonl(docs.repartition(2, "doc_id"), f"{base}/hf_snapshot/more", rows_per_file=10**9)
    for name in ("more", "data/.hidden", "_draft"):
        writers.write_manifest(f"{base}/hf_snapshot/{name}/manifest.json", {})
    found = readers.discover(readers.data_root(base))
    return spark.createDataFrame([(name, len(paths)) for name, paths in found.items()], "format string, n_files int")


@query(DOCS_SQL)
def read_parquet_files(spark, directory):
    """S3, S11."""
    base = scratch(spark, "parquet")
    table(spark, directory, "documents").write.partitionBy("dataset").parquet(base)
    return _shown(readers.read_parquet(spark, [base], merge=True))


@query(DOCS_SQL)
def read_jsonl_files(spark, directory):
    """S4, K4, K5."""
    base = scratch(spark, "jsonl")
    docs = table(spark, directory, "documents").select("doc_id", "text", "int_score")
    writers.write_jsonl(docs, base, rows_per_file=400)
    return _shown(readers.read_jsonl(spark, [base], docs.schema))


@query("SELECT item_id, md5(prompt) AS digest FROM bench_items")
def read_json_files(spark, directory):
    """A third of the rows in files with a list, in files with a list under data, in files of one object."""
    base = scratch(spark, "json")
    bench = table(spark, directory, "bench_items").select("item_id", "prompt")
    one = bench.select(F.floor(F.col("item_id") % 9 / 3).alias("kind"), F.pmod("item_id", F.lit(6)).alias("g"), F.to_json(F.struct("item_id", "prompt")).alias("j"), "item_id")
    listed = one.where("kind < 2").groupBy("kind", "g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    listed = listed.select(F.when(F.col("kind") == 1, F.concat(F.lit('{"data": '), "value", F.lit("}"))).otherwise(F.col("value")).alias("value"))
    files = listed.unionByName(one.where("kind = 2").select(F.col("j").alias("value")))
    files.repartition(200).write.option("maxRecordsPerFile", 1).text(base)
    return readers.read_json(spark, [base]).select("item_id", F.md5("prompt").alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, {strip_sql('text')} AS t FROM documents WHERE {strip_sql('text')} <> ''),
r AS (SELECT doc_id, t, row_number() OVER w AS rn, coalesce(sum(length(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WINDOW w AS (ORDER BY doc_id))
SELECT md5(t) AS digest FROM r WHERE rn = 1 OR (rn - 1 < 700 AND before < 300000)""")
def bounded_texts(spark, directory):
    """Texts in the order of files and rows up to a budget; the text field comes from the corpus' settings."""
    base = scratch(spark, "bounded")
    docs = table(spark, directory, "documents").select("doc_id", F.col("text").alias("body"), F.lit("clash").alias("output"))
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{base}/rows")
    writers.write_manifest(f"{base}/data_meta.json", {}, text_field="body", max_chars=300_000)
    return readers.bounded_texts(spark, base, max_samples=700).select(F.md5("text").alias("digest"))


@query(catalog.ORACLES["message_join"])
def read_sft_files(spark, directory):
    """Training rows of a folder with two formats."""
    base = scratch(spark, "sft")
    pairs = table(spark, directory, "sft_pairs").select("pair_id", "prompt", "response", "instruction", "input", "output")
    shaped = F.col("prompt").isNotNull()
    writers.write_jsonl(pairs.where(shaped), f"{base}/lines")
    pairs.where(~shaped).write.parquet(f"{base}/table")
    rows = readers.read_sft(spark, [base])
    return rows.select("pair_id", F.md5(chat.join_turns(readers.normal_turns(rows))).alias("digest")).where("digest is not null")


@query(f"SELECT md5({strip_sql('text')}) AS digest, count(*) AS n FROM documents WHERE {strip_sql('text')} <> '' GROUP BY 1")
def read_text_lines(spark, directory):
    """S12, 2.9j, 2.9k: lines that are objects or bare strings."""
    base = scratch(spark, "lines")
    docs = table(spark, directory, "documents").where("text is not null")
    line = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(records_literal(F.col("text")))
    docs.select(line.alias("value")).write.text(base)
    return readers.read_lines(spark, [base]).where("text <> ''").groupBy(F.md5(text.strip(F.col("text"))).alias("digest")).agg(F.count("*").alias("n"))


def records_literal(c):
    from corpusmill.functions.harness import python_literal

    return python_literal(c)


@query("SELECT 'sample/' || (row_number() OVER (ORDER BY item_id) - 1) AS task_id, md5(prompt) AS digest, entry_point FROM bench_items")
def read_bench_lines(spark, directory):
    """Rows without an id are numbered by their line."""
    base = scratch(spark, "bench")
    bench = table(spark, directory, "bench_items").select("item_id", F.col("prompt").alias("question"), "entry_point")
    bench.coalesce(1).sortWithinPartitions("item_id").drop("item_id").write.json(base)
    return readers.read_bench(spark, [base], {"prompt": "question"}).select("task_id", F.md5("prompt").alias("digest"), "entry_point")


@query("SELECT task_id, md5(prompt) AS digest, dataset FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS r FROM bench_items WHERE dataset = 'mbpp_like') WHERE r <= 20".replace("dataset FROM", "'mbpp' AS dataset FROM"))
def read_bench_set(spark, directory):
    """A set by an alias of its name, from the first place that has its files, the first 20 rows."""
    base = scratch(spark, "sets")
    bench = table(spark, directory, "bench_items").where("dataset = 'mbpp_like'").select("item_id", "task_id", "prompt")
    bench.coalesce(1).sortWithinPartitions("item_id").drop("item_id").write.parquet(f"{base}/mbpp/sanitized/raw")
    spark.read.parquet(f"{base}/mbpp/sanitized/raw").coalesce(1).write.parquet(f"{base}/draft")
    source = readers.list_files(f"{base}/draft")
    move(spark, next(p for p in source if p.endswith(".parquet")), f"{base}/mbpp/sanitized/test-00000.parquet")
    return readers.read_bench_set(spark, "MBPP", base, limit=20).select("task_id", F.md5("prompt").alias("digest"), "dataset")


def move(spark: SparkSession, source: str, target: str) -> None:
    make = spark._jvm.org.apache.hadoop.fs.Path
    make(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(make(source), make(target))


@query(f"SELECT md5(coalesce(nullif(question, ''), 'user:' || chr(10) || {strip_sql('style')} || chr(10) || 'Assistant:' || chr(10))) AS digest, question_id AS task_id, CASE WHEN test IS NULL THEN 0 ELSE 1 END AS n_keys FROM kodcode_v1 WHERE question_id IS NOT NULL AND style IS NOT NULL")
def read_prompt_lines(spark, directory):
    """The prompt, or the turns before the assistant's; what is known of the task as metadata."""
    base = scratch(spark, "prompts")
    rows = table(spark, directory, "kodcode_v1").where("question_id is not null and style is not null")
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("style").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("x").alias("content")))
    writers.write_jsonl(rows.select(F.col("question").alias("prompt"), turns.alias("messages"), F.col("question_id").alias("task_id"), F.col("test").alias("tests")), base)
    prompts = readers.read_prompts(spark, [base])
    return prompts.select(F.md5("prompt").alias("digest"), F.col("metadata")["task_id"].alias("task_id"), (F.size("metadata") - 1).alias("n_keys"))


@query(f"SELECT 'set_' || dataset AS run, * FROM ({catalog.ORACLES['dataset_summary']})")
def read_summary_files(spark, directory):
    """One summary per folder."""
    base = scratch(spark, "summaries")
    summary = catalog.queries()["dataset_summary"](spark, directory)
    summary.withColumn("run", F.concat(F.lit("set_"), "dataset")).write.partitionBy("run").json(base)
    found = readers.read_summaries(spark, f"{base}/*/*.json")
    return found.select(F.regexp_replace("run", "^run=", "").alias("run"), *summary.columns)


@query("SELECT 'parquet' AS format, count(*) AS n_rows, 3 AS n_files FROM code_files UNION ALL SELECT 'json', count(*), 2 FROM code_files")
def counts_by_format(spark, directory):
    """S20, S21."""
    base = scratch(spark, "counts")
    code = table(spark, directory, "code_files").select("file_id")
    code.repartition(3, "file_id").write.parquet(f"{base}/a")
    code.repartition(2, "file_id").write.json(f"{base}/b")
    both = [readers.row_counts(df) for df in (readers.read_parquet(spark, [f"{base}/a"]), readers.read_jsonl(spark, [f"{base}/b"]))]
    return both[0].unionByName(both[1]).select("format", "n_rows", F.col("n_files").cast("int").alias("n_files"))


@query("SELECT item_id AS prompt_index, g::INT AS generation_index, 'ok' AS response FROM bench_items, range(0, 3) t(g)")
def fake_rollouts(spark, directory):
    """S27."""
    prompts = table(spark, directory, "bench_items").select(F.col("item_id").alias("prompt_index"), "prompt")
    return readers.fake_rollouts(prompts, 3).drop("prompt")


# ---- token files


def _tokens(spark, directory) -> DataFrame:
    """The lengths of its words as tokens of a document, with stage and split."""
    docs = table(spark, directory, "documents")
    bucket = keys.sha_bucket(F.concat(F.lit("id="), F.col("doc_id").cast("string")), SALT)
    lengths = F.transform(text.words(F.coalesce("text", F.lit(""))), lambda w: F.length(w))
    return docs.select("doc_id", "dataset", F.when(rules.row_rule(F.col("int_score"), "ge", 4), "anneal").otherwise("main").alias("stage"), keys.split_of(bucket, 0.05).alias("split"), lengths.alias("tokens"))


BUCKET_ID = BUCKET.format("'id=' || doc_id")
SPLIT_SQL = f"CASE WHEN int_score >= 4 THEN 'anneal' ELSE 'main' END AS stage, CASE WHEN {BUCKET_ID} < 0.05 THEN 'val' ELSE 'train' END AS split"


@query(f"SELECT dataset, stage, split, count(*) AS n_docs, sum({WORDS_SQL} + 1)::BIGINT AS n_tokens, sum({WORDS_SQL} + 1)::BIGINT * 4 AS n_bytes FROM (SELECT *, {SPLIT_SQL} FROM documents) GROUP BY 1, 2, 3")
def encode_manifest(spark, directory):
    """Documents as token files per dataset, stage and split with an end token each, and their manifest."""
    ship_by_value()
    manifest = writers.encode_corpus(_tokens(spark, directory), scratch(spark, "encoded"), ["doc_id"], eos=0, dtype="uint32")
    return manifest.groupBy("dataset", "stage", "split").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_bytes")])


@query(f"""WITH w AS (SELECT doc_id, list_append([length(w) FOR w IN list_filter(regexp_split_to_array(coalesce(text, ''), '{catalog.WS}+'), lambda w: w <> '')], 0) AS l FROM documents),
t AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS v FROM w), p AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS place, v FROM t)
SELECT place // 10000 AS block, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (place % 10000))::BIGINT AS weighted FROM p GROUP BY 1""")
def token_stream(spark, directory):
    """The files one after the other are the ordered stream; it is read back in pieces of 1,000 tokens."""
    ship_by_value()
    base = scratch(spark, "stream")
    files = writers.write_token_files(_tokens(spark, directory).select("doc_id", "tokens"), base, ["doc_id"], dtype="uint32", eos=0).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "n_tokens")
    places = order.with_running(files, ["name"], value=F.col("n_tokens")).select("name", "before")
    pieces = readers.read_token_file(spark, f"{base}/*.bin", "uint32", 1_000).withColumn("name", F.regexp_extract("file", r"([^/]+)$", 1))
    placed = pieces.join(places, "name").select((F.col("before") + F.col("first")).alias("start"), F.posexplode("tokens").alias("i", "v"))
    at = F.col("start") + F.col("i")
    return placed.select(F.floor(at / 10_000).alias("block"), F.pmod(at, F.lit(10_000)).alias("r"), "v").groupBy("block").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("r")).alias("weighted"))


# ---- writers


@query("SELECT count(*) AS n_rows, 1 AS n_too_long FROM documents".replace("1 AS", "0 AS"))
def jsonl_shards(spark, directory):
    """K4: no shard has more rows than it may."""
    base = scratch(spark, "shards")
    writers.write_jsonl(table(spark, directory, "documents").select("doc_id", "text"), base, rows_per_file=300)
    sizes = spark.read.text(base).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 300).cast("int").alias("n_too_long"))


@query("SELECT dataset, count(*) AS n, 7 AS seed FROM documents GROUP BY 1")
def manifest_file(spark, directory):
    """K6: counts by dataset and settings as one JSON file."""
    path = f"{scratch(spark, 'manifest')}/manifest.json"
    counts = {r["dataset"]: r["n"] for r in table(spark, directory, "documents").groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    writers.write_manifest(path, counts, seed=7)
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "counts map<string,long>, seed int").alias("m"))
    return parsed.select(F.explode("m.counts").alias("dataset", "n"), F.col("m.seed").alias("seed"))


@query("SELECT doc_id FROM documents WHERE int_score <> 2 OR int_score IS NULL")
def replaced_table(spark, directory):
    """K7, F1: a table rewritten in place without some rows; a second run changes nothing."""
    base = scratch(spark, "replaced")
    table(spark, directory, "documents").select("doc_id", "int_score").write.parquet(base)
    for _ in range(2):
        rows = spark.read.parquet(base)
        writers.replace_table(rows.where(rules.drop_rule(F.col("int_score"), drop_eq=2)), base, before=rows.count())
    return spark.read.parquet(base).select("doc_id")


@query("SELECT event_type AS run, count(*) AS n_rows, round(max(value), 6) AS best FROM events GROUP BY 1")
def history_file(spark, directory):
    """K10, T-7: rows are appended to a history; a table that is there already is not written again."""
    base = scratch(spark, "history")
    events = table(spark, directory, "events").select(F.col("event_type").alias("run"), "value")
    for name in sorted(r["run"] for r in events.select("run").distinct().collect()):
        writers.append_history(events.where(F.col("run") == name), f"{base}/rows")
    for _ in range(2):
        writers.skip_if_there(spark.read.json(f"{base}/rows"), f"{base}/table")
    return spark.read.parquet(f"{base}/table").groupBy("run").agg(F.count("*").alias("n_rows"), F.round(F.max("value"), 6).alias("best"))


@query(catalog.ORACLES["dataset_summary"])
def written_results(spark, directory):
    """K9."""
    base = scratch(spark, "results")
    summary = catalog.queries()["dataset_summary"](spark, directory)
    writers.write_results(table(spark, directory, "events").select(F.col("event_type").alias("dataset"), "event_id"), summary, base)
    back = spark.read.json(f"{base}/summary")
    return back.select(*summary.columns)


# ---- leaks in texts that do leak: every prompt as it is, with something after it, and without its end


VARIANTS = f"""(SELECT item_id AS id, 'whole' AS field, 0 AS pos, {norm_sql('upper(prompt)')} AS norm FROM bench_items
UNION ALL SELECT item_id, 'longer', 1, {norm_sql("'Task. ' || prompt || ' Thanks'")} FROM bench_items UNION ALL SELECT item_id, 'shorter', 2, {norm_sql("left(prompt, (length(prompt) * 0.93)::INT)")} FROM bench_items
UNION ALL SELECT doc_id, 'document', 3, {norm_sql('text')} FROM documents)"""


def _variants(spark, directory) -> DataFrame:
    bench = table(spark, directory, "bench_items")
    shapes = (("whole", F.upper("prompt")), ("longer", F.concat(F.lit("Task. "), "prompt", F.lit(" Thanks"))), ("shorter", F.substring(F.col("prompt"), F.lit(1), F.round(F.length("prompt") * F.lit(0.93)).cast("int"))))
    parts = [bench.select(F.col("item_id").alias("id"), F.lit(name).alias("field"), F.lit(k).alias("pos"), text.normalize_text(c).alias("norm")) for k, (name, c) in enumerate(shapes)]
    parts.append(table(spark, directory, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("field"), F.lit(3).alias("pos"), text.normalize_text(F.col("text")).alias("norm")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("norm <> ''")


@query(f"WITH b AS ({INDEX}), t AS (SELECT * FROM {VARIANTS} WHERE norm <> '') SELECT t.id, t.field, t.pos, b.label FROM t JOIN b USING (norm)")
def leak_exact_variants(spark, directory):
    """J4."""
    return relate.exact_leaks(_variants(spark, directory), relate.bench_index(table(spark, directory, "bench_items")))


@query(f"WITH b AS ({INDEX}), t AS (SELECT * FROM {VARIANTS} WHERE norm <> '') SELECT t.id, t.field, t.pos, arg_min(b.label, b.ord) AS label FROM t JOIN b ON {NEAR} GROUP BY 1, 2, 3")
def leak_near_variants(spark, directory):
    """J5."""
    return relate.near_leaks(_variants(spark, directory), relate.bench_index(table(spark, directory, "bench_items")))


@query(f"WITH b AS ({INDEX}), t AS (SELECT * FROM {VARIANTS} WHERE norm <> '') {catalog.LEAKS}")
def leak_scan_variants(spark, directory):
    """J6."""
    return relate.first_leak(_variants(spark, directory), relate.bench_index(table(spark, directory, "bench_items")))


@query(f"WITH b AS ({INDEX}), t AS (SELECT * FROM {VARIANTS} WHERE norm <> ''), l AS ({catalog.LEAKS}) SELECT reason, id AS key FROM l")
def leak_rejects(spark, directory):
    """K8: the side output of what leaks."""
    found = relate.first_leak(_variants(spark, directory), relate.bench_index(table(spark, directory, "bench_items"))).withColumnRenamed("id", "key")
    kept = table(spark, directory, "documents").select(F.col("doc_id").alias("key"), F.lit("kept").alias("reason"))
    return writers.rejects(found.unionByName(kept), "key")


# ---- records and texts


@query(f"""WITH b AS ({INDEX}), t AS ({catalog.TEXTS}), l AS ({catalog.LEAKS}),
d AS (SELECT *, {catalog.QUESTION_SQL} AS q, {catalog.TEST_SQL} AS t, ({catalog.ORACLES["rl_decision_reasons"].split("SELECT row_id, ")[-1].split(" AS reason")[0].replace("WHEN NOT coalesce(gpt_pass_percentage >= 0.1, false) THEN 'gpt_pass_percentage_too_low' ", "")}) AS decision FROM kodcode_v1 LEFT JOIN l ON l.id = row_id),
k AS (SELECT * FROM d WHERE decision = 'kept')
SELECT 'exercises/' || coalesce(nullif(question_id, ''), sha1({norm_sql('question')})) AS task_id, lower({strip_sql('style')}) AS style, CASE WHEN lower({strip_sql('style')}) = 'complete' THEN 'humaneval' ELSE 'mbpp' END AS prompt_kind,
md5('user:' || chr(10) || CASE WHEN lower({strip_sql('style')}) = 'complete' THEN '{records.COMPLETE_INSTRUCTION}' ELSE '{records.WRITE_INSTRUCTION}' END || chr(10) || chr(10) || q || chr(10) || 'assistant:' || chr(10)) AS prompt_hash,
len(regexp_extract_all(t, '{catalog.TESTS}'))::INT AS num_tests, length(q)::INT AS question_chars, length(t)::INT AS test_chars, gpt_pass_percentage FROM k""")
def rl_record_fields(spark, directory):
    """The fields of the records beside the test program (tests/test_harness.py runs that)."""
    out = catalog.queries()["rl_records"](spark, directory)
    return out.select("task_id", "style", "prompt_kind", F.md5("prompt").alias("prompt_hash"), "num_tests", "question_chars", "test_chars", "gpt_pass_percentage")


@query(f"""SELECT coalesce(nullif(question_id, ''), sha1({norm_sql('question')})) AS source_id, lower({strip_sql('style')}) AS style, sha1({norm_sql('question')}) AS question_hash, length({strip_sql('solution')})::INT AS solution_chars,
md5(CASE WHEN lower({strip_sql('style')}) = 'complete' THEN '{records.COMPLETE_INSTRUCTION}' ELSE '{records.WRITE_INSTRUCTION}' END || chr(10) || chr(10) || {strip_sql('question')}) AS user_hash
FROM kodcode_v1 JOIN ({catalog.ORACLES["sft_decision_reasons"]}) r USING (row_id) WHERE r.reason = 'kept'""")
def sft_record_fields(spark, directory):
    """The records of the rows that pass all but the syntax test."""
    exercises, leaks = catalog._leaks(spark, directory)
    out = records.sft_records(records.sft_decisions(exercises, leaks, STYLES, syntax=False))
    return out.select("source_id", "style", "question_hash", "solution_chars", F.md5(F.col("messages")[0]["content"]).alias("user_hash"))


PROBLEM_KINDS = "row_id % 6"


@query(f"""SELECT row_id, CASE WHEN coalesce({strip_sql('question')}, '') = '' THEN 'missing_problem' WHEN length({strip_sql('question')}) > 400 THEN 'problem_too_long' WHEN {PROBLEM_KINDS} = 4 THEN 'tests_json_error' WHEN {PROBLEM_KINDS} = 5 THEN 'unsupported_tests'
WHEN {PROBLEM_KINDS} = 3 THEN 'skip_functional' WHEN {PROBLEM_KINDS} = 2 THEN 'too_few_tests' ELSE 'kept' END AS reason FROM kodcode_v1""")
def problem_reasons(spark, directory):
    """The four shapes of tests, broken ones and unknown ones."""
    ship_by_value()
    return records.problem_decisions(_problems(spark, directory), max_chars=400, min_cases=2, skip_functional=True).select("row_id", "reason")


def _problems(spark, directory) -> DataFrame:
    rows = table(spark, directory, "kodcode_v1")
    kind = F.pmod("row_id", F.lit(6))
    tests = (
        F.when(kind == 0, '[{"input": "1\\n", "output": "2"}, {"input": "3", "output": "4"}]').when(kind == 1, '{"inputs": ["1", "2"], "outputs": ["3", "4"]}').when(kind == 2, '[{"input": "1", "output": "2"}]')
        .when(kind == 3, '{"fn_name": "f", "inputs": [[1], [2]], "outputs": [[1], [2]]}').when(kind == 4, "{broken").otherwise('"text"')
    )
    return rows.select("row_id", F.col("question").alias("problem"), tests.alias("tests"), F.lit("x = 1\n").alias("starter_code"), F.lit(None).cast("string").alias("func_name"), F.lit("made").alias("source"))


@query(f"""SELECT row_id, 'problems/made/' || left(sha1({norm_sql(strip_sql('question'))}), 16) AS task_id, CASE WHEN {PROBLEM_KINDS} = 3 THEN 'function' ELSE 'stdin' END AS task_type, CASE WHEN {PROBLEM_KINDS} = 2 THEN 1 ELSE 2 END AS num_tests,
md5('user:' || chr(10) || CASE WHEN {PROBLEM_KINDS} = 3 THEN '{records.WRITE_INSTRUCTION} Define the required function `f` exactly.' ELSE '{records.STDIN_INSTRUCTION}' END || chr(10) || chr(10) || {strip_sql('question')} || chr(10) || chr(10) || 'Starter code:' || chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || 'assistant:' || chr(10)) AS prompt_hash
FROM kodcode_v1 WHERE {PROBLEM_KINDS} < 4 AND coalesce({strip_sql('question')}, '') <> '' AND length({strip_sql('question')}) <= 20000""")
def problem_records(spark, directory):
    """P11, P24."""
    ship_by_value()
    decided = records.problem_decisions(_problems(spark, directory))
    prompt = records.problem_prompt(F.col("problem"), F.col("task_type"), F.col("entry_point"), F.col("starter_code"), F.col("uses_class"))
    return decided.where("reason = 'kept'").select("row_id", "task_id", "task_type", F.size("cases").alias("num_tests"), F.md5(prompt).alias("prompt_hash"))


@query("SELECT doc_id FROM documents WHERE text <> ''")
def has_text(spark, directory):
    """F12."""
    return table(spark, directory, "documents").where(rules.has_text(F.col("text"))).select("doc_id")


@query("SELECT pair_id, " + " OR ".join(f"starts_with(line, '{p}')" for p in text.BAD_PREFIXES) + " AS bad FROM (SELECT pair_id, lower(" + strip_sql("regexp_extract(coalesce(response, output), '^\\s*([^\\n]*)', 1)") + ") AS line FROM sft_pairs WHERE coalesce(response, output) IS NOT NULL)")
def bad_prefixes(spark, directory):
    """F21."""
    pairs = table(spark, directory, "sft_pairs").select("pair_id", F.coalesce("response", "output").alias("a")).where("a is not null")
    return pairs.select("pair_id", text.starts_badly(F.col("a")).alias("bad"))


@query("""WITH a AS (SELECT pair_id, coalesce(response, output) AS a FROM sft_pairs), b AS (SELECT pair_id, unnest(regexp_extract_all(a, '(?is)```(?:python|py)?\\s*(.*?)```', 1)) AS b, unnest(range(1, 1 + len(regexp_extract_all(a, '(?is)```(?:python|py)?\\s*(.*?)```', 1)))) AS i FROM a)
SELECT pair_id, md5(b) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY length(b) DESC, i) AS r FROM b) WHERE r = 1""")
def longest_fences(spark, directory):
    """O8."""
    pairs = table(spark, directory, "sft_pairs").select("pair_id", F.coalesce("response", "output").alias("a"))
    return pairs.select("pair_id", F.md5(text.longest_fence(F.col("a"))).alias("digest")).where("digest is not null")


@query("SELECT pair_id, md5(CASE WHEN greatest(instr(a, 'the'), instr(a, chr(10))) = 0 THEN a ELSE left(a, least(CASE WHEN instr(a, 'the') > 0 THEN instr(a, 'the') ELSE 1000000000 END, CASE WHEN instr(a, chr(10)) > 0 THEN instr(a, chr(10)) ELSE 1000000000 END) - 1) END) AS digest FROM (SELECT pair_id, coalesce(response, output) AS a FROM sft_pairs) WHERE a IS NOT NULL")
def stop_trim(spark, directory):
    """P26."""
    pairs = table(spark, directory, "sft_pairs").select("pair_id", F.coalesce("response", "output").alias("a")).where("a is not null")
    return pairs.select("pair_id", F.md5(text.until_marker(F.col("a"), ["the", "\n"])).alias("digest"))


LENGTHS = f"[length(w) FOR w IN list_filter(regexp_split_to_array(coalesce(text, ''), '{catalog.WS}+'), lambda w: w <> '')]"


@query(f"""WITH w AS (SELECT doc_id, {LENGTHS} AS l FROM documents)
SELECT doc_id, CASE WHEN list_position(l, 3) IS NULL OR list_position(l, 3) = 0 THEN len(l) ELSE list_position(l, 3) - 1 END::INT AS n_before, list_sum(l[greatest(1, len(l) - 9):])::BIGINT AS last_ten, greatest(len(l), 30)::INT AS n_padded, (coalesce(list_sum(l), 0) - greatest(30 - len(l), 0))::BIGINT AS padded FROM w WHERE len(l) > 0""")
def array_shapes(spark, directory):
    """P26, X12, X13, 2.9l: ids before the end token, the last ones, padded ones."""
    docs = _tokens(spark, directory).where(F.size("tokens") > 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    padded = chat.pad_right(F.col("tokens"), F.lit(30), -1)
    return docs.select("doc_id", F.size(text.until_eos(F.col("tokens"), 3)).alias("n_before"), total(chat.keep_last(F.col("tokens"), 10)).alias("last_ten"), F.size(padded).alias("n_padded"), total(padded).alias("padded"))


@query(f"SELECT doc_id, md5({strip_sql('text')}) AS digest FROM documents WHERE NOT regexp_matches(text, '[ \\t]\\n') AND NOT regexp_matches(text, '[\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}\\r]') AND NOT regexp_matches(text, '{catalog.WS}(\\n|$)')".replace("{{", "{").replace("}}", "}"))
def plain_outputs(spark, directory):
    """2.9f on the texts whose lines end without blanks (tests have the others)."""
    odd = F.col("text").rlike(r"[ \t]\n") | F.col("text").rlike(r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}\r]") | F.col("text").rlike(catalog.WS + r"(\n|$)")
    return table(spark, directory, "documents").where("text is not null").where(~odd).select("doc_id", F.md5(text.plain_output(F.col("text"))).alias("digest"))


@query("""SELECT event_id, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) ELSE printf('%.1f GB', b / 1073741824.0) END AS size,
printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) AS remaining, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM (SELECT event_id, ts, (event_id * event_id * 37)::DOUBLE AS b, event_id * 7 AS s FROM events)""")
def shown_numbers(spark, directory):
    """2.9g, 2.9q: sizes, times that are left, stamps in UTC."""
    events = table(spark, directory, "events")
    size = (F.col("event_id") * F.col("event_id") * 37).cast("double")
    return events.select("event_id", text.byte_size(size).alias("size"), text.duration(F.col("event_id") * 7).alias("remaining"), text.utc_stamp(F.col("ts")).alias("stamp"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'error' ELSE 'success' END AS status, CASE WHEN event_id % 4 = 0 THEN round(value, 6) ELSE 0 END AS execution_time, CASE WHEN event_id % 4 < 2 THEN event_type ELSE '' END AS stdout, CASE WHEN event_id % 4 = 3 THEN event_type ELSE '' END AS stderr FROM events")
def sandbox_results(spark, directory):
    """P25: whole results, ones without time, without output, and a plain text as output."""
    events = table(spark, directory, "events")
    kind = F.pmod("event_id", F.lit(4))
    output = F.struct(F.col("event_type").alias("stdout"))
    whole = F.to_json(F.struct(F.lit("success").alias("status"), F.col("value").alias("execution_time"), output.alias("output")))
    no_time = F.to_json(F.struct(F.lit("success").alias("status"), output.alias("output")))
    payload = F.when(kind == 0, whole).when(kind == 1, no_time).when(kind == 2, '{"status":"success"}').otherwise(F.to_json(F.struct(F.col("event_type").alias("output"))))
    shown = events.select("event_id", records.sandbox_result(payload).alias("r"))
    return shown.select("event_id", "r.status", F.round("r.execution_time", 6).alias("execution_time"), "r.stdout", "r.stderr")


@query("SELECT event_id, event_type AS a, CASE WHEN user_id % 2 = 0 THEN 'own' ELSE 'prompt' END AS b FROM events")
def reward_metadata(spark, directory):
    """P27, J8, 2.9n: a rollout's metadata over that of its prompt."""
    events = table(spark, directory, "events").select("event_id", F.col("user_id").alias("prompt_index"), F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("a"), "event_type", F.lit("b"), F.lit("own"))).otherwise(F.create_map(F.lit("a"), F.col("event_type"))).alias("metadata"))
    prompts = events.select("prompt_index").distinct().withColumn("metadata", F.create_map(F.lit("a"), F.lit("lost"), F.lit("b"), F.lit("prompt")))
    return records.reward_inputs(events, prompts).select("event_id", F.col("metadata")["a"].alias("a"), F.col("metadata")["b"].alias("b"))


@query("SELECT (r // 4)::BIGINT AS prompt_index, string_agg(event_type, ',' ORDER BY r) AS completions FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) GROUP BY 1")
def regrouped_texts(spark, directory):
    """Generated texts in order as lists of four per prompt."""
    placed = order.with_running(table(spark, directory, "events").select("event_id", F.col("event_type").alias("text")), ["event_id"], rank="pos")
    return records.regrouped(placed, 4).select("prompt_index", F.array_join("completions", ",").alias("completions"))


@query("SELECT dataset, task_id, completion_id::INT AS completion_id, CASE WHEN task_id % 5 = 0 THEN NULL ELSE 'x = ' || task_id || '/' || completion_id END AS extracted_code, task_id % 5 = 0 AS missing FROM (SELECT 's' AS dataset, item_id AS task_id, unnest(CASE WHEN item_id % 5 = 0 THEN [NULL] ELSE range(0, 3) END) AS completion_id FROM bench_items)")
def zipped_completions(spark, directory):
    """Samples with their completions; one without any is a row that says so."""
    samples = table(spark, directory, "bench_items").select(F.lit("s").alias("dataset"), F.col("item_id").alias("task_id"), F.lit("mbpp").alias("kind"), "prompt", "entry_point", "test", "test_list")
    texts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("```python\nx = "), F.col("task_id").cast("string"), F.lit("/"), k.cast("string"), F.lit("\n```")))
    completions = samples.where("task_id % 5 <> 0").select("dataset", "task_id", texts.alias("completions"))
    return records.candidates(samples, completions).select("dataset", "task_id", "completion_id", "extracted_code", "missing")


@query("SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 WHEN event_type IN ('error') THEN 0 WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END)::DOUBLE AS score FROM events")
def execution_scores(spark, directory):
    """X2."""
    passed = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    score = rewards.execution_score(passed, F.col("event_type"), pass_markers=["click", "view"], fail_markers=["error"])
    return table(spark, directory, "events").select("event_id", score.alias("score"))


RATIO = "exp(n - o)"


@query(f"""WITH e AS (SELECT -value / 200 AS n, -value / 190 AS o, -value / 210 AS r, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE 1.0 END AS m, (event_id % 7) - 3.0 AS a FROM events)
SELECT round(sum((-least({RATIO} * a, least(greatest({RATIO}, 0.8), 1.28) * a) + 0.02 * (exp(r - n) - (r - n) - 1)) * m) / greatest(sum(m), 1), 9) AS loss,
round(sum(CASE WHEN abs({RATIO} - least(greatest({RATIO}, 0.8), 1.28)) > 1e-8 THEN m ELSE 0 END) / greatest(sum(m), 1), 9) AS clip_fraction, round(sum((exp(r - n) - (r - n) - 1) * m) / greatest(sum(m), 1), 9) AS approx_kl FROM e""")
def policy_losses(spark, directory):
    """The clipped loss with its KL term."""
    v = F.col("value")
    one = lambda c: F.array(c)
    rows = table(spark, directory, "events").select(
        one(-v / 200).alias("new_logprobs"), one(-v / 190).alias("old_logprobs"), one(-v / 210).alias("ref_logprobs"), one(F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(1.0)).alias("mask"), (F.col("event_id") % 7 - 3.0).alias("advantage")
    )
    out = evalmetrics.policy_loss(rows, kl_coef=0.02)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rank, doc_id FROM documents")
def row_index(spark, directory):
    """W6."""
    return order.with_running(table(spark, directory, "documents").select("doc_id"), ["doc_id"])


@query("""WITH b AS (SELECT doc_id AS block_id, row_number() OVER (ORDER BY sha256('3:1:' || doc_id)) - 1 AS position FROM documents)
SELECT block_id, position, ((position // 4) % 3)::INT AS worker FROM b WHERE position < (SELECT count(*) - count(*) % 12 FROM documents)""")
def shuffled_blocks(spark, directory):
    """Blocks in the order of an epoch, whole batches of all workers."""
    return order.shuffled_blocks(table(spark, directory, "documents").select(F.col("doc_id").alias("block_id")), 3, 1, 3, 4).select("block_id", "position", "worker")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 100 AND i % 4 = 1")
def rows_after_restart(spark, directory):
    """T-2, T-3: what a worker reads after a restart at index 100."""
    placed = order.with_running(table(spark, directory, "events").select("event_id", "event_type"), ["event_id"], rank="index")
    return streaming.rows_from(placed, 100, 1, 4).select("event_id", "event_type")


@query("SELECT CASE WHEN i >= 9 THEN e + 1 ELSE e END AS epoch, CASE WHEN i >= 9 THEN 0 ELSE i END AS index FROM (SELECT event_id // 10 AS e, event_id % 10 AS i FROM events ORDER BY e DESC, i DESC LIMIT 1)")
def resume_position(spark, directory):
    """T-2: where to go on by the newest entry of a log; an epoch has nine rows here."""
    log = table(spark, directory, "events").select(F.floor(F.col("event_id") / 10).alias("epoch"), (F.col("event_id") % 10).alias("index"), F.lit(9).cast("long").alias("rows"))
    return streaming.resume_position(log)


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 3")
def newest_snapshots(spark, directory):
    """K12."""
    return evalmetrics.newest_snapshots(table(spark, directory, "events").select("event_id", "value"), "event_id", 3)


@query("SELECT event_id FROM events WHERE event_type <> 'error' ORDER BY event_id DESC LIMIT 1")
def resume_snapshot(spark, directory):
    """K12, T-2: the newest snapshot that is whole."""
    rows = table(spark, directory, "events").select("event_id", (F.col("event_type") != "error").alias("whole"))
    return evalmetrics.resume_from(rows, "event_id", "whole").select("event_id")


# ---- plans of work


RULES = ({"stage": "anneal", "column": "int_score", "op": "ge", "value": 3}, {"stage": "main", "column": "int_score", "op": "lt", "value": 3, "include_null": True})


@query("SELECT 'anneal' AS stage, 'int_score ge 3' AS row_filter, count(*) AS matched_rows FROM code_files WHERE int_score >= 3 UNION ALL SELECT 'main', 'int_score lt 3', count(*) FROM code_files WHERE int_score < 3 OR int_score IS NULL")
def encode_task_rows(spark, directory):
    """Files times rules in one scan."""
    base = scratch(spark, "tasks")
    table(spark, directory, "code_files").select("file_id", "int_score").repartition(4, "file_id").write.parquet(base)
    plan = tasks.encode_tasks(readers.read_parquet(spark, [base]), {"name": "code", "category": "code", "rules": list(RULES)})
    return plan.groupBy("stage", "row_filter").agg(F.sum("matched_rows").alias("matched_rows"))


@query("SELECT dataset, n_tokens, n_bytes FROM (SELECT dataset, sum(length(coalesce(text, '')))::BIGINT AS n_tokens, sum(strlen(coalesce(text, '')))::BIGINT AS n_bytes FROM documents GROUP BY 1) WHERE n_bytes <> n_tokens")
def size_errors(spark, directory):
    """Datasets whose bytes are not their characters."""
    t = F.coalesce("text", F.lit(""))
    sums = table(spark, directory, "documents").groupBy("dataset").agg(F.sum(F.length(t)).alias("n_tokens"), F.sum(F.octet_length(t)).alias("n_bytes"))
    return stats.size_errors(sums, 1)


# ---- tokenizers


@query(catalog.ORACLES["pair_counts"].replace("bench_items", "documents").replace("prompt", "text").replace("SELECT a, b, sum(n)::BIGINT AS n FROM", "SELECT max(n) AS n FROM (SELECT a, b, sum(n)::BIGINT AS n FROM") + ")")
def top_pair(spark, directory):
    """The count of the pair that is merged first."""
    words = subword.gather_words(subword.word_counts(table(spark, directory, "documents"), "text", "doc_id", r"[\p{L}\p{N}_]+"))
    return spark.createDataFrame([(int(subword._Pairs([(list(w), n) for w, n in words]).best()[1]),)], "n long")


@query()
def train_native(spark, directory):
    """A byte BPE of the tokenizers library, trained on a budget of characters per dataset; its tokens per document."""
    ship_by_value()
    docs = table(spark, directory, "documents").where("text <> ''").select("dataset", "doc_id", "text")
    # The budget bounds what comes to the driver.
    sample = [r["text"] for r in order.two_level_budget(docs, "dataset", ["doc_id"], "text", 500_000, 2_000_000).orderBy("dataset", "doc_id").select("text").toLocalIterator()]
    model = subword.train_native(sample, 2_000).to_str()

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model)
        for texts in batches:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(list(texts))], dtype="int64")

    return spread(docs.select("doc_id", "text")).select("doc_id", F.pandas_udf(counted, "long")("text").alias("n_tokens"))


# ---- streams


@query(f"SELECT doc_id, length(text) AS n_chars, sha1({norm_sql('text')}) AS text_hash, CASE WHEN {BUCKET.format(chr(39) + 'id=' + chr(39) + ' || doc_id')} < 0.01 THEN 'val' ELSE 'train' END AS split FROM documents WHERE text <> '' AND lower({strip_sql('lang')}) = 'en'")
def stream_clean(spark, directory):
    """T-1, T-2: the cleaning of documents as a stream of files, processed until none is left; a restart finds nothing to do."""
    base = scratch(spark, "stream")
    for _ in range(2):
        rows = streaming.read_stream(spark, f"{directory}/documents.parquet*", table(spark, directory, "documents").schema)
        streaming.run_available(streaming.clean(rows), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("SELECT event_id AS step, round(value, 6) AS metric, round(max(value) OVER w, 6) AS best, coalesce(value > max(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM events WINDOW w AS (ORDER BY event_id)")
def stream_best(spark, directory):
    """T-6: the best so far over a stream of metrics."""
    base = scratch(spark, "best")
    events = table(spark, directory, "events").select(F.col("event_id").alias("step"), F.col("value").alias("metric"))
    events.write.parquet(f"{base}/in")
    rows = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    streaming.track_best(rows, f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/state").select("step", F.round("metric", 6).alias("metric"), F.round("best", 6).alias("best"), "is_best")
