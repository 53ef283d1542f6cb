"""Learning rates and stages as functions of the step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def stage_of_step(step: Column, total: int, ratio: float) -> Column:
    return F.when(step >= int(total * ratio), "anneal").otherwise("main")


def next_stop(step: Column, segment: int, total: int) -> Column:
    """Where the next segment ends."""
    return F.least(F.lit(total), step + segment)


def evaluates_at(step: Column, interval: int, total: int) -> Column:
    return (step % interval == 0) | (step >= total)


def warmup_stable_decay(step: Column, total: int, warmup: int, ratio: float, peak: float, final: float, shape: str = "sqrt") -> Column:
    """Linear warm-up, a plateau, then a decay of the given shape (sqrt, linear, cosine) from the anneal step on."""
    start = int(total * ratio)
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - start) / float(max(1, total - start))))
    shapes = {"sqrt": F.sqrt(1 - progress), "linear": 1 - progress, "cosine": 0.5 * (1 + F.cos(math.pi * progress))}
    if shape not in shapes:
        raise ValueError(f"unknown shape {shape!r}")
    factor = F.when(step >= total, 0.0).otherwise(shapes[shape])
    return F.when(step < warmup, peak * (step / float(max(1, warmup)))).when(step < start, F.lit(peak)).otherwise(final + (peak - final) * factor)


def warmup_decay(step: Column, total: int, warmup: int, peak: float, final: float, shape: str = "cosine") -> Column:
    """Linear warm-up, then constant, linear or cosine decay to the end."""
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / float(max(1, total - warmup))))
    factor = 1 - progress if shape == "linear" else 0.5 * (1 + F.cos(math.pi * progress))
    after = F.lit(peak) if shape == "constant" else final + (peak - final) * factor
    return F.when(step < warmup, peak * step / float(max(1, warmup))).otherwise(after)


def warmup_cosine(step: Column, total: int, warmup: int, peak: float, least: float) -> Column:
    """The small trainer's schedule: warm-up counts from one, and the end has the least rate."""
    progress = (step - warmup) / float(max(1, total - warmup))
    cosine = least + 0.5 * (1 + F.cos(math.pi * progress)) * (peak - least)
    return F.when(step < warmup, peak * (step + 1) / float(max(1, warmup))).when(step >= total, F.lit(least)).otherwise(cosine)
