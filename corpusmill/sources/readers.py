"""Readers of corpus files (S1-S24): discovery, formats, text columns, benchmark sets, summaries."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.chat import turns_of_pair
from corpusmill.functions.text import strip
from corpusmill.operators.order import budget_cut, with_running
from corpusmill.session import merge_options

TEXT_FIELDS = ("text", "content", "markdown", "completion", "output")
SKIPPED = {"dataset_infos.json", "data_meta.json", "manifest.json"}
SNAPSHOT = "hf_snapshot"
FORMATS = ("parquet", "jsonl", "json")


def list_files(directory: str) -> list[str]:
    """All files below a directory, sorted. Addresses with a scheme (hdfs, s3a, gs, file) are listed through the session's file systems."""
    if "://" not in directory and not directory.startswith("file:"):
        root = Path(directory)
        return sorted(str(p) for p in root.rglob("*") if p.is_file()) if root.is_dir() else []
    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found, files = [], system.listFiles(path, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return sorted(found)


def data_root(directory: str) -> str:
    """The snapshot folder if it holds data files, else the directory itself."""
    for candidate in (f"{directory.rstrip('/')}/{SNAPSHOT}", directory):
        if any(discover(candidate).values()):
            return candidate
    raise FileNotFoundError(f"no data files in {directory}")


def discover(directory: str) -> dict[str, list[str]]:
    """Data files by format, sorted; hidden parts, metadata files and what a writer left unfinished are left out."""
    out: dict[str, list[str]] = {f: [] for f in FORMATS}
    root = re.sub(r"^file:/+", "/", directory).rstrip("/")
    for path in list_files(directory):
        inner = re.sub(r"^file:/+", "/", path).removeprefix(root).strip("/").split("/")
        suffix = inner[-1].rpartition(".")[2]
        if suffix in out and inner[-1] not in SKIPPED and not any(p.startswith((".", "_")) for p in inner):
            out[suffix].append(path)
    return out


def of_split(paths: list[str], split: str | None, root: str = "") -> list[str]:
    """The paths that hold the split's name below the root; all of them if none does."""
    if not split:
        return paths
    name = re.sub(r"[\[\]:]", "_", split)
    return [p for p in paths if name in p.removeprefix(root)] or paths


def first_shards(paths: list[str], n: int | None) -> list[str]:
    """The first n of the sorted shards."""
    return sorted(paths)[:n] if n else sorted(paths)


def read_parquet(spark: SparkSession, paths: list[str], merge: bool = False) -> DataFrame:
    """S3: one scan of files. With ``merge`` their columns may differ, for which every footer is read first."""
    return spark.read.option("mergeSchema", merge).parquet(*paths)


def read_jsonl(spark: SparkSession, paths: list[str], schema: T.StructType | None = None, strict: bool = True) -> DataFrame:
    """One object per non-blank line. Broken lines are an error, or null rows with _corrupt_record unless ``strict``."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(paths)


def read_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A list of objects, an object with a list under ``data``, or one object per file; files of all three kinds may be mixed.

    Items that are no objects are left out.
    """
    df = spark.read.option("multiLine", True).json(paths)
    kind = dict(df.dtypes).get("data", "")
    if not kind.startswith("array<struct"):
        return df.drop("_corrupt_record") if "_corrupt_record" in df.columns and len(df.columns) > 1 else df
    listed = df.where("data is not null").select(F.explode("data").alias("row")).where("row is not null").select("row.*")
    plain = df.where("data is null").drop("data", "_corrupt_record")
    return listed.unionByName(plain, allowMissingColumns=True) if plain.columns else listed


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines as objects or bare strings: value (variant, null if broken) and text (of a bare string or of a text field)."""
    lines = spark.read.text(paths).where(strip(F.col("value")) != "")
    parsed = lines.select(F.col("value").alias("line"), F.expr("try_parse_json(value)").alias("value"))
    bare = F.expr("try_variant_get(value, '$', 'string')")
    fields = [F.nullif(strip(F.get_json_object("line", f"$.{name}")), F.lit("")) for name in TEXT_FIELDS]
    return parsed.select("value", F.coalesce(F.when(F.col("line").startswith('"'), bare), *fields).alias("text"))


def read_corpus(spark: SparkSession, directory: str, split: str | None = None, text_field: str | None = None, options: dict | None = None) -> DataFrame:
    """All rows of a corpus directory, of all formats that have files; adds __text and __file."""
    root = data_root(directory)
    settings = corpus_settings(spark, directory, options, split=split, text_field=text_field)
    files = discover(root)
    parts = []
    for name, reader in (("parquet", read_parquet), ("jsonl", read_jsonl), ("json", read_json)):
        if paths := of_split(files[name], settings.get("split"), root):
            df = reader(spark, paths)
            parts.append(df.withColumn("__text", text_column(df, settings.get("text_field"))).withColumn("__file", F.input_file_name()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def corpus_settings(spark: SparkSession, directory: str, options: dict | None = None, **given) -> dict:
    """Settings of a corpus: given ones, else options, else those of its data_meta.json."""
    path = f"{directory.rstrip('/')}/data_meta.json"
    there = [p for p in list_files(directory) if p.endswith("/data_meta.json") and p.count("/") == min(q.count("/") for q in list_files(directory))]
    meta = json.loads(spark.read.text(there[0] if there else path, wholetext=True).first()["value"]) if there else {}
    return merge_options(dict.fromkeys(given), meta, options, given)


def bounded_texts(spark: SparkSession, directory: str, split: str | None = None, text_field: str | None = None, max_samples: int | None = None, max_chars: int | None = None) -> DataFrame:
    """The non-empty texts of a corpus in the order of files and rows until a budget is used up: file, row, text.

    The text that crosses the budget is kept. Budgets that are not given come from the corpus' settings.
    """
    settings = corpus_settings(spark, directory, None, split=split, text_field=text_field, max_samples=max_samples, max_chars=max_chars)
    rows = read_corpus(spark, directory, settings.get("split"), settings.get("text_field"))
    texts = rows.select(F.col("__file").alias("file"), F.monotonically_increasing_id().alias("row"), F.col("__text").alias("text")).where("text <> ''")
    if settings.get("max_samples") is None and settings.get("max_chars") is None:
        return texts
    from corpusmill.session import cut_lineage

    return budget_cut(cut_lineage(texts), ["file", "row"], F.length("text"), settings.get("max_samples"), settings.get("max_chars"))


def text_field_of(columns: list[str], field: str | None = None) -> str:
    """The given field, else the first candidate in the schema."""
    if field is not None:
        return field
    for name in TEXT_FIELDS:
        if name in columns:
            return name
    raise ValueError("no text field among " + ", ".join(columns))


def text_column(df: DataFrame, field: str | None = None) -> Column:
    """The text of a row: the given field stripped, else the first candidate that is not blank, else turns or a pair.

    Note that ``output`` is a candidate, so a pair is only joined where its output is blank (Q1).
    """
    kinds = dict(df.dtypes)
    if field is not None:
        if kinds.get(field) != "string":
            raise ValueError(f"{field!r} is no text column")
        return strip(F.col(field))
    from corpusmill.functions.chat import text_of_row

    blank = F.lit(None).cast("string")
    column = lambda name: F.col(name) if kinds.get(name) == "string" else blank
    turns = next((F.transform(F.col(c), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))) for c in ("messages", "conversations", "conversation") if kinds.get(c, "").startswith("array<struct") and "content" in kinds[c]), None)
    return text_of_row([F.col(c) for c in TEXT_FIELDS if kinds.get(c) == "string"] or [blank], turns, column("instruction"), column("input"), column("output"))


def _turns_of(messages: Column, roles: list[str], contents: list[str]) -> Column:
    from corpusmill.functions.chat import turn

    blank = F.lit(None).cast("string")
    return F.transform(messages, lambda t: turn(F.coalesce(*[t[n] for n in roles], blank), F.coalesce(*[t[n] for n in contents], blank)))


def normal_turns(df: DataFrame) -> Column:
    """The turns of a row: messages or conversations if there are any, else a pair."""
    kinds = dict(df.dtypes)
    blank = F.lit(None).cast("string")
    column = lambda *names: F.coalesce(*[F.col(n) for n in names if kinds.get(n) == "string"], blank)
    options = []
    for name in ("messages", "conversations", "conversation"):
        if kinds.get(name, "").startswith("array<struct"):
            fields = {f.name for f in df.schema[name].dataType.elementType.fields}
            roles, contents = ([n for n in names if n in fields] for names in (("role", "from", "speaker"), ("content", "value", "text")))
            options.append(_turns_of(F.col(name), roles, contents))
    return F.coalesce(*options, turns_of_pair(column("prompt"), column("response", "completion"), column("instruction"), column("input"), column("output")))


def read_sft(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Training rows of files and directories, without manifest.json; other suffixes are an error."""
    files: dict[str, list[str]] = {f: [] for f in FORMATS}
    for path in paths:
        suffix = path.rpartition("/")[2].rpartition(".")[2]
        for name, found in ({suffix: [path]} if suffix in files else discover(path)).items():
            files[name] += found
        if suffix not in files and list_files(path) in ([], [path]):
            raise ValueError(f"unsupported file {path}")
    parts = [reader(spark, files[name]) for name, reader in (("jsonl", read_jsonl), ("json", read_json), ("parquet", read_parquet)) if files[name]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


#: Where the files of the benchmark sets lie, by preference.
BENCH_PATTERNS = {
    "humanevalplus": ("humanevalplus/test.jsonl", "humanevalplus/data/test-*.parquet"), "openai_humaneval": ("openai_humaneval/openai_humaneval/test-*.parquet",),
    "mbpp": ("mbpp/sanitized/test-*.parquet",), "mbppplus": ("mbppplus/data/test-*.parquet",),
}


def first_pattern(root: str, patterns: list[str] | tuple[str, ...]) -> list[str]:
    """The files of the first pattern that matches any."""
    base, files = root.rstrip("/"), list_files(root)
    for pattern in patterns:
        wanted = re.compile(re.escape(base) + "/" + re.escape(pattern).replace(r"\*", "[^/]*"))
        if found := [p for p in files if wanted.fullmatch(p)]:
            return found
    raise FileNotFoundError(f"none of {patterns} in {root}")


def numbered(df: DataFrame, column: str = "__row") -> DataFrame:
    """Adds the number of each row in the order of the scan, from 0 on: parts of the scan are counted, not gathered."""
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    return with_running(placed, ["__at"], rank=column).drop("__at")


def read_bench(spark: SparkSession, paths: list[str], names: dict[str, str] | None = None, limit: int | None = None, prefix: str = "sample") -> DataFrame:
    """Benchmark rows with their fields renamed; rows without id are named ``prefix/i``, i the number of the row.

    In JSONL files i is the number of the line in its file, blank lines counted. ``limit``: only so many rows, the first ones.
    """
    if paths[0].endswith(".parquet"):
        df = numbered(read_parquet(spark, paths))
    else:
        lines = spark.read.text(paths).select("value", F.input_file_name().alias("__file"), F.monotonically_increasing_id().alias("__at"))
        placed = with_running(lines, ["__at"], ["__file"], rank="__row").where(strip(F.col("value")) != "")
        schema = spark.read.json(paths).schema
        df = placed.select("__row", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("__row", "r.*")
    for new, old in (names or {}).items():
        df = df.withColumnRenamed(old, new)
    if "task_id" not in df.columns:
        df = df.withColumn("task_id", F.lit(None).cast("string"))
    named = df.withColumn("task_id", F.coalesce(F.col("task_id").cast("string"), F.concat(F.lit(f"{prefix}/"), F.col("__row").cast("string"))))
    return (named.orderBy("__row").limit(max(0, limit)) if limit is not None else named).drop("__row")


def read_bench_set(spark: SparkSession, name: str, root: str, limit: int | None = None) -> DataFrame:
    """The rows of a benchmark set by its name (or an alias), from the first place that has files of it."""
    from corpusmill.functions.records import set_name

    known = set_name(name)
    return read_bench(spark, first_pattern(root, BENCH_PATTERNS[known]), limit=limit, prefix=known).withColumn("dataset", F.lit(known))


def read_prompts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Prompts with metadata: the prompt, or the turns before the assistant's rendered."""
    from corpusmill.functions.chat import render

    df = read_jsonl(spark, paths)
    kept = [c for c in ("tests", "test_program_template", "entry_point", "task_id", "source", "task_type", "num_tests") if c in df.columns]
    turns = F.filter(normal_turns(df), lambda t: t["role"] != "assistant")
    prompt = F.coalesce(F.nullif(F.col("prompt"), F.lit("")), render(turns, "plain_lower", True)) if "prompt" in df.columns else render(turns, "plain_lower", True)
    meta = F.create_map(*[x for c in kept for x in (F.lit(c), F.col(c).cast("string"))]) if kept else F.create_map().cast("map<string,string>")
    return df.select(prompt.alias("prompt"), F.map_filter(meta, lambda _, v: v.isNotNull()).alias("metadata"))


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Summary files with their folder's name."""
    df = spark.read.option("multiLine", True).json(pattern)
    return df.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def row_counts(df: DataFrame) -> DataFrame:
    """Rows and files by format."""
    name = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(name, r"\.([a-z]+)$", 1).alias("format"), name.alias("f")).groupBy("format").agg(F.count("*").alias("n_rows"), F.countDistinct("f").alias("n_files"))


def preview(df: DataFrame, text: str, rows: int = 3, chars: int = 200) -> DataFrame:
    """The head of a table with its text cut."""
    return df.limit(rows).withColumn(text, F.substring(text, 1, chars))


def read_token_file(spark: SparkSession, path: str, dtype: str = "uint16", length: int = 1_000_000) -> DataFrame:
    """Token files of little-endian unsigned integers in pieces of ``length`` tokens: file, first (position of the piece), tokens.

    Pieces are planned from the files' sizes and read where they are needed, so a file may have any size.
    """
    import numpy as np
    import pandas as pd

    size = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    pieces = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("bytes") / size - 1) / length).cast("long")))).alias("k")).where("bytes > 0")
    spread = pieces.repartition("file", "k")

    def tokens(batches):
        from pyarrow import fs

        for batch in batches:
            rows = []
            for file, total, k in zip(batch["file"], batch["bytes"], batch["k"]):
                system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                with system.open_input_file(place) as handle:
                    handle.seek(k * length * size)
                    data = handle.read(min(length * size, total - k * length * size))
                rows.append((file, k * length, np.frombuffer(data, dtype=np.dtype(dtype).newbyteorder("<")).astype("int64")))
            yield pd.DataFrame(rows, columns=["file", "first", "tokens"])

    return spread.mapInPandas(tokens, "file string, first long, tokens array<long>")


def fake_rollouts(prompts: DataFrame, n: int, response: str = "ok") -> DataFrame:
    """N rollouts of each prompt with a fixed response, as a stand-in for a model."""
    return prompts.select("prompt_index", "prompt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("generation_index"), F.lit(response).alias("response"))
