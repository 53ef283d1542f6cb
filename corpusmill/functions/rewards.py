"""Rewards of responses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import repetition_ratio

NAMES = ("contains", "regex", "length", "code_block", "repeat_penalty", "code_execution")


def execution_score(passed: Column, *outputs: Column, pass_markers: list[str], fail_markers: list[str]) -> Column:
    """1 or 0 as ``passed`` says; without it 0 if the outputs hold a fail marker, 1 if they hold a pass marker, else 0."""
    joined = F.concat_ws("\n", *outputs)
    some = lambda markers: F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: joined.contains(m))
    return F.when(passed, 1.0).when(~passed, 0.0).when(some(fail_markers), 0.0).when(some(pass_markers), 1.0).otherwise(0.0)


def single_reward(response: Column, name: str, **kwargs) -> Column:
    """One reward by name; null responses give null."""
    one = lambda c: F.when(c, 1.0).when(~c, 0.0)
    if name == "contains":
        return one(response.contains(kwargs["pattern"]))
    if name == "regex":
        flags = "".join(kwargs.get("flags", ""))
        if not set(flags) <= set("imsx"):
            raise ValueError("flags are some of i, m, s and x")
        return one(response.rlike(f"(?{flags}){kwargs['pattern']}" if flags else kwargs["pattern"]))
    if name == "length":
        return one(F.length(response).between(kwargs.get("min_chars", 0), kwargs.get("max_chars", 10**12)))
    if name == "code_block":
        needle = "```" + kwargs.get("language", "")
        fences = (F.length(response) - F.length(F.replace(response, F.lit("```"), F.lit("")))) / 3
        return one(response.contains(needle) & (fences >= 2))
    if name == "repeat_penalty":
        return 1 - F.least(F.lit(1.0), repetition_ratio(response) / max(kwargs.get("max_repetition_ratio", 0.3), 1e-8))
    if name == "code_execution":
        outputs = [F.col(c) for c in kwargs.get("outputs", ("stdout", "stderr", "result", "status"))]
        return execution_score(F.col(kwargs.get("passed", "passed")), *outputs, pass_markers=kwargs.get("pass_markers", ["PASS", "passed"]), fail_markers=kwargs.get("fail_markers", ["FAIL", "FAILED", "Traceback"]))
    raise KeyError(f"unknown reward {name!r}")


def composite(response: Column, configs: list[dict]) -> tuple[Column, Column]:
    """(score, components): the weighted sum of clipped rewards, and a map of the clipped ones; a repeated name keeps the last."""
    if not configs:
        return F.lit(0.0), F.expr("cast(map() as map<string,double>)")
    score, parts = F.lit(0.0), {}
    for config in configs:
        value = single_reward(response, config["name"], **config.get("kwargs", {}))
        if config.get("clip_min") is not None:
            value = F.greatest(value, F.lit(float(config["clip_min"])))
        if config.get("clip_max") is not None:
            value = F.least(value, F.lit(float(config["clip_max"])))
        parts[config["name"]] = value
        score = score + float(config.get("weight", 1.0)) * value
    return score, F.create_map(*[x for name, value in parts.items() for x in (F.lit(name), value)])
