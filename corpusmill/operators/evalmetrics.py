"""Scores of completions: pass@k, averages, best so far, group-relative advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.order import running_best


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased estimate from c passes among n completions."""
    wrong = n - c
    terms = F.transform(F.sequence(wrong + 1, n), lambda v: 1 - F.lit(float(k)) / v)
    product = F.aggregate(terms, F.lit(1.0), lambda a, x: a * x)
    return F.when((n <= 0) | (F.lit(k) <= 0) | (c <= 0), F.lit(0.0)).when(wrong < k, F.lit(1.0)).otherwise(1 - product)


def pass_summary(results: DataFrame, ks: list[int], dataset: str = "dataset", task: str = "task_id", passed: str = "passed") -> DataFrame:
    """Per dataset the tasks, completions, errors and the mean pass@k over tasks."""
    per_task = results.groupBy(dataset, task).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("c"), F.count_if(F.col("status") != "success").alias("e"))
    scores = [F.avg(pass_at_k(F.col("n"), F.col("c"), k)).alias(f"pass_at_{k}") for k in ks]
    return per_task.groupBy(dataset).agg(F.count("*").alias("n_tasks"), F.sum("n").alias("n_completions"), F.sum("e").alias("n_errors"), (F.sum("e") / F.sum("n")).alias("error_rate"), *scores)


def macro_average(summary: DataFrame, metrics: list[str], empty: float | None = 0.0) -> DataFrame:
    """The unweighted mean over datasets that have the metric; ``empty`` where none has."""
    means = [F.coalesce(F.avg(m), F.lit(empty)).alias(m) if empty is not None else F.avg(m).alias(m) for m in metrics]
    return summary.agg(*means)


def completions_needed(n: int, ks: list[int]) -> int:
    """At least as many completions as the largest k."""
    return max(1, n, *(ks or [1]))


def best_so_far(history: DataFrame, order: str, metric: str, run: list[str]) -> DataFrame:
    """Adds the best metric up to each row of its run and whether the row is a new best (strictly greater)."""
    rows = running_best(history, [order], run, metric, "__best")
    return rows.withColumn("best", F.greatest("__best", metric)).withColumn("is_best", F.coalesce(F.col(metric) > F.col("__best"), F.lit(True))).drop("__best")


def group_advantages(rollouts: DataFrame, prompt: str, reward: str) -> DataFrame:
    """(reward - mean) / (population deviation + 1e-8) within the prompt; 0 where the deviation is at most 1e-8.

    The group's moments come from partial aggregates, so a prompt with most of the rows is no hot task.
    """
    moments = rollouts.groupBy(prompt).agg(F.avg(reward).alias("__mean"), F.stddev_pop(reward).alias("__std"))
    joined = rollouts.join(moments, prompt)
    advantage = F.when(F.col("__std") <= 1e-8, F.lit(0.0)).otherwise((F.col(reward) - F.col("__mean")) / (F.col("__std") + 1e-8))
    return joined.withColumn("advantage", advantage).drop("__mean", "__std")


def overlong_penalty(reward: Column, length: Column, most: int, penalty: float) -> Column:
    """A fixed penalty for completions of at least ``most`` tokens."""
    return reward if penalty <= 0 else reward - F.when(length >= most, F.lit(float(penalty))).otherwise(F.lit(0.0))


def mixed_groups(rollouts: DataFrame, prompt: str, reward: str) -> DataFrame:
    """The rows of prompts that have both positive and other rewards."""
    groups = rollouts.groupBy(prompt).agg(F.bool_or(F.col(reward) > 0).alias("__any"), F.bool_or(F.col(reward) <= 0).alias("__none")).where("__any and __none").select(prompt)
    return rollouts.join(groups, prompt, "left_semi")


def rollout_stats(rollouts: DataFrame, prompt: str, reward: str) -> DataFrame:
    """Mean reward, share of rows kept by mixed_groups, and groups by kind."""
    groups = rollouts.groupBy(prompt).agg(F.sum(reward).alias("s"), F.count("*").alias("n"), F.count_if(F.col(reward) > 0).alias("p"))
    mixed = (F.col("p") > 0) & (F.col("p") < F.col("n"))
    return groups.agg(
        (F.sum("s") / F.sum("n")).alias("reward_mean"), (F.sum(F.when(mixed, F.col("n")).otherwise(0)) / F.sum("n")).alias("keep_fraction"),
        F.count_if(F.col("p") == F.col("n")).alias("all_positive"), F.count_if(mixed).alias("mixed"), F.count_if(F.col("p") == 0).alias("none_positive"),
    )


def newest_snapshots(snapshots: DataFrame, step: str, keep: int) -> DataFrame:
    """The newest ``keep`` snapshots of a run."""
    return snapshots.orderBy(F.desc(step)).limit(keep)


def resume_from(snapshots: DataFrame, step: str, whole: str) -> DataFrame:
    """T-2: the snapshot to go on from: the newest one that is whole; no row if there is none."""
    return snapshots.where(F.col(whole)).orderBy(F.desc(step)).limit(1)


def policy_loss(df: DataFrame, clip_low: float = 0.2, clip_high: float = 0.28, kl_coef: float = 0.0, per_sequence: bool = False) -> DataFrame:
    """Forward values of the clipped policy loss on arrays new_logprobs, old_logprobs, mask (and ref_logprobs for the KL term) and a number
    advantage: loss, clip_fraction, approx_kl.

    Means are over the unmasked tokens of all rows, or with ``per_sequence`` over rows of their means; sums are aggregated partially.
    The KL term of a token is exp(r) - r - 1 with r = reference - new, and counts ``kl_coef`` times. No unmasked token at all gives 0.
    """
    reference = F.col("ref_logprobs") if "ref_logprobs" in df.columns else F.col("new_logprobs")
    tokens = F.arrays_zip(F.transform("new_logprobs", lambda x: x), F.transform("old_logprobs", lambda x: x), F.transform(reference, lambda x: x), F.transform("mask", lambda x: x))
    ratio = lambda t: F.exp(t["0"] - t["1"])
    fields = F.transform(tokens, lambda t: F.struct(ratio(t).alias("x"), F.least(F.greatest(ratio(t), F.lit(1 - clip_low)), F.lit(1 + clip_high)).alias("c"), (F.exp(t["2"] - t["0"]) - (t["2"] - t["0"]) - 1).alias("k"), t["3"].cast("double").alias("m")))
    total = lambda value: F.aggregate(F.transform("__t", value), F.lit(0.0).cast("double"), lambda a, x: a + x)
    rows = df.withColumn("__t", fields)
    gain = lambda t: -F.least(t["x"] * F.col("advantage"), t["c"] * F.col("advantage"))
    sums = rows.select(
        total(lambda t: (gain(t) + F.lit(float(kl_coef)) * t["k"]) * t["m"]).alias("l"), total(lambda t: F.when(F.abs(t["x"] - t["c"]) > 1e-8, t["m"]).otherwise(F.lit(0.0))).alias("c"),
        total(lambda t: t["k"] * t["m"]).alias("k"), total(lambda t: t["m"]).alias("w"),
    )
    if per_sequence:
        own = F.greatest("w", F.lit(1.0))
        sums = sums.where("w > 0").select((F.col("l") / own).alias("l"), (F.col("c") / own).alias("c"), (F.col("k") / own).alias("k"), F.lit(1.0).alias("w"))
    added = sums.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in "lckw"])
    weight = F.greatest("w", F.lit(1.0))
    return added.select((F.col("l") / weight).alias("loss"), (F.col("c") / weight).alias("clip_fraction"), (F.col("k") / weight).alias("approx_kl"))
