"""Counters, mixtures, estimates and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import percent


def reason_counts(decided: DataFrame, reason: str = "reason") -> DataFrame:
    """A1: rows per decision."""
    return decided.groupBy(reason).agg(F.count("*").alias("n_rows"))


def category_counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """A2: counters of several columns in one scan: column, value, n_rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("n_rows"))


def pass_bucket(c: Column) -> Column:
    """A3: none, 0, (0,.25), [.25,.75), [.75,1), 1. NaN falls through to the last."""
    x = c.cast("double")
    return F.when(x.isNull(), "none").when(F.isnan(x), "1").when(x <= 0, "0").when(x < 0.25, "(0,.25)").when(x < 0.75, "[.25,.75)").when(x < 1, "[.75,1)").otherwise("1")


def mixture(df: DataFrame, tokens: str, keys: tuple[str, str, str] = ("stage", "split", "dataset")) -> DataFrame:
    """Tokens and documents per key with the share in (stage, split) and over all, as text. Empty sums divide by one."""
    sums = df.groupBy(*keys).agg(F.sum(tokens).cast("long").alias("n_tokens"), F.count("*").alias("n_docs"))
    inside = F.sum("n_tokens").over(Window.partitionBy(*keys[:2]))
    overall = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))
    return sums.select("*", percent(F.col("n_tokens") / F.greatest(inside, F.lit(1))).alias("pct_in_stage"), percent(F.col("n_tokens") / F.greatest(overall, F.lit(1))).alias("pct_overall"))


def stage_totals(df: DataFrame, tokens: str) -> DataFrame:
    """A5: one row per stage with tokens and documents of both splits."""
    val = F.col("split") == "val"
    return df.groupBy("stage").agg(
        F.sum(F.when(~val, F.col(tokens)).otherwise(0)).alias("train_n_tokens"), F.sum(F.when(~val, 1).otherwise(0)).alias("train_n_docs"),
        F.sum(F.when(val, F.col(tokens)).otherwise(0)).alias("val_n_tokens"), F.sum(F.when(val, 1).otherwise(0)).alias("val_n_docs"),
    )


def shard_manifest(results: DataFrame) -> DataFrame:
    """One row per result and split that has tokens or documents, train before val."""
    halves = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(k).alias("half"), F.col(f"{s}_n_tokens").alias("n_tokens"), F.col(f"{s}_n_docs").alias("n_docs")) for k, s in enumerate(("train", "val"))])
    rows = results.select("stage", "dataset", F.explode(halves).alias("h")).select("stage", "dataset", "h.*")
    return rows.where((F.col("n_tokens") > 0) | (F.col("n_docs") > 0)).orderBy("stage", "dataset", "half").drop("half")


def size_errors(results: DataFrame, item_bytes: int) -> DataFrame:
    """Outputs whose bytes are not tokens times item size."""
    return results.where(F.col("n_bytes") != F.col("n_tokens") * item_bytes)


def estimate(sample: DataFrame, counts: DataFrame, key: str, text: str) -> DataFrame:
    """Characters, bytes and tokens (characters / 4) of all rows from the averages of a sample."""
    means = sample.groupBy(key).agg(F.avg(F.length(text)).alias("avg_chars"), F.avg(F.octet_length(text)).alias("avg_bytes"))
    joined = counts.join(means, key)
    return joined.select(key, "n_rows", F.round("avg_chars", 6).alias("avg_chars"), F.round("avg_bytes", 6).alias("avg_bytes"), F.round(F.col("n_rows") * F.col("avg_chars") / 4, 6).alias("est_tokens"))


def rollup_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """A10: sums by key with the share of the whole."""
    sums = df.groupBy(key).agg(F.sum(value).cast("long").alias("total"), F.count("*").alias("n_rows"))
    return sums.withColumn("share", F.round(F.col("total") / F.greatest(F.sum("total").over(Window.partitionBy(F.lit(0))), F.lit(1)), 6))


def rule_counts(df: DataFrame, keep: Column, key: str) -> DataFrame:
    """rows before and after a rule, per key; nothing is written."""
    return df.groupBy(key).agg(F.count("*").alias("n_before"), F.count_if(keep).alias("n_after"))
