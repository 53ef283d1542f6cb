"""Planning of encoding work: one row per file and rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.rules import rule_of
from corpusmill.functions.text import safe_name

STAGES, CATEGORIES = ("main", "anneal"), ("text", "math", "code")
DEFAULTS = {"stage": "main", "category": "text", "text_field": None, "quality_hint": None, "max_files": None, "rules": ()}


def described(dataset: dict) -> dict:
    """A dataset's description with defaults; unknown stages and categories are an error."""
    full = DEFAULTS | {k: v for k, v in dataset.items() if v is not None}
    if not full.get("name"):
        raise ValueError("a dataset needs a name")
    if full["stage"] not in STAGES or full["category"] not in CATEGORIES:
        raise ValueError(f"{full['name']}: stage must be one of {STAGES}, category one of {CATEGORIES}")
    return full


def file_rows(df: DataFrame) -> DataFrame:
    """Files of a scan with size and rows; nothing but metadata is read."""
    files = df.select(F.col("_metadata.file_path").alias("src_path"), F.col("_metadata.file_size").alias("size"))
    return files.groupBy("src_path", "size").agg(F.count("*").alias("n_rows"))


def encode_tasks(df: DataFrame, dataset: dict) -> DataFrame:
    """One row per file and rule of a dataset: stage, rule, matched rows and shard names, the largest first.

    All rules are counted in one scan that reads only their columns. Rules without matches give no task.
    """
    full = described(dataset)
    rules = list(full["rules"]) or [{"stage": full["stage"]}]
    for rule in rules:
        if rule.get("stage", full["stage"]) not in STAGES:
            raise ValueError(f"unknown stage {rule['stage']!r}")
    counts = [F.count_if(rule_of(df.columns, rule if "column" in rule else None)).alias(f"r{k}") for k, rule in enumerate(rules)]
    files = df.groupBy(F.col("_metadata.file_path").alias("src_path"), F.col("_metadata.file_size").alias("size")).agg(*counts)
    text = [f"{r['column']} {r['op']} {r['value']}" if "column" in r else "all" for r in rules]
    plan = F.array(*[F.struct(F.lit(k).alias("rule_no"), F.lit(r.get("stage", full["stage"])).alias("stage"), F.lit(text[k]).alias("row_filter"), F.col(f"r{k}").alias("matched_rows")) for k, r in enumerate(rules)])
    rows = files.select("src_path", "size", F.explode(plan).alias("p")).select("src_path", "size", "p.*").where("matched_rows > 0")
    stem = F.concat_ws("__", F.lit(full["name"]), F.col("stage"), safe_name(F.regexp_extract("src_path", r"([^/]+)\.[a-z]+$", 1)), F.col("rule_no").cast("string"))
    return rows.select(F.lit(full["name"]).alias("dataset"), "*", F.concat(stem, F.lit(".train.bin")).alias("train_shard"), F.concat(stem, F.lit(".val.bin")).alias("val_shard")).orderBy(F.desc("size"), F.desc("matched_rows"), "src_path", "rule_no")
