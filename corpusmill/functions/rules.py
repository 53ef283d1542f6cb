"""Row rules with an explicit policy for null and NaN. A rule is a boolean column that is never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import strip

OPERATORS = ("ge", "lt", "eq", "ne")


def try_number(c: Column) -> Column:
    """2.9p: a value as a double; null where it is none."""
    return c.try_cast("double")


def _compared(c: Column, op: str, value) -> Column:
    """Comparison as in Python: with NaN only ``ne`` holds. A text that is no number is null against a number."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    c = try_number(c) if isinstance(value, float) else c
    nan = F.coalesce(F.isnan(try_number(c)), F.lit(False)) if number else F.lit(False)
    if op == "ge":
        return (c >= value) & ~nan
    if op == "lt":
        return (c < value) & ~nan
    if op == "eq":
        return (c == value) & ~nan
    if op == "ne":
        return (c != value) | nan
    raise ValueError(f"unknown operator {op!r}, expected one of {', '.join(OPERATORS)}")


def row_rule(c: Column, op: str, value, include_null: bool = False) -> Column:
    """``c op value``; a null row counts as ``include_null``."""
    return F.coalesce(_compared(c, op, value), F.lit(include_null))


def drop_equal(c: Column, value) -> Column:
    """everything but ``value``; null stays."""
    return F.coalesce(_compared(c, "ne", value), F.lit(True))


def drop_at_most(c: Column, value) -> Column:
    """what is greater than ``value``; null stays, NaN goes."""
    return F.coalesce((try_number(c) > value) & ~F.isnan(try_number(c)), F.lit(True))


def drop_rule(c: Column, drop_eq=None, drop_le=None) -> Column:
    """F1 or F2: exactly one of the two must be given."""
    if (drop_eq is None) == (drop_le is None):
        raise ValueError("give exactly one of drop_eq and drop_le")
    return drop_equal(c, drop_eq) if drop_le is None else drop_at_most(c, drop_le)


def at_least(c: Column, value: float) -> Column:
    """``c >= value`` as doubles; null and NaN go."""
    return row_rule(try_number(c), "ge", float(value))


def nonzero_or_null(c: Column) -> Column:
    """F8: rows whose count is not zero; null stays."""
    return F.coalesce(c != 0, F.lit(True))


def label_is(c: Column, value: str) -> Column:
    """the label without case and blanks around it."""
    return F.coalesce(F.lower(strip(c)) == value.lower(), F.lit(False))


def label_in(c: Column, values: list[str]) -> Column:
    return F.coalesce(F.lower(strip(c)).isin([v.lower() for v in values]), F.lit(False))


def has_text(c: Column, trust: bool = False) -> Column:
    """a text that is not empty; with ``trust`` an empty one is kept."""
    return c.isNotNull() if trust else F.coalesce(c != "", F.lit(False))


def is_true(c: Column) -> Column:
    """true, or the word true in any case."""
    return F.coalesce(F.lower(strip(c.cast("string"))) == "true", F.lit(False))


def within(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """within the bounds that are given; null fails as soon as one is."""
    out = F.lit(True)
    value = F.lit(None).cast("double") if c is None else try_number(c)
    if low is not None:
        out = out & F.coalesce(value >= low, F.lit(False))
    if high is not None:
        out = out & F.coalesce(value <= high, F.lit(False))
    return out


def rule_of(columns: list[str], rule: dict | None) -> Column:
    """A rule dictionary (column, op, value, include_null) as a column; null means every row."""
    if rule is None:
        return F.lit(True)
    if rule["column"] not in columns:
        raise ValueError(f"rule needs the column {rule['column']!r}")
    return row_rule(F.col(rule["column"]), rule["op"], rule["value"], bool(rule.get("include_null", False)))


def stage_by_rules(columns: list[str], rules: list[dict], default: str = "main") -> Column:
    """The stage of the first rule that a row meets, else the default stage. Stages are main or anneal."""
    out = None
    for rule in rules:
        if rule["stage"] not in ("main", "anneal"):
            raise ValueError(f"unknown stage {rule['stage']!r}")
        met = rule_of(columns, rule if "column" in rule else None)
        out = F.when(met, rule["stage"]) if out is None else out.when(met, rule["stage"])
    return F.lit(default) if out is None else out.otherwise(default)


def first_reason(*checks: tuple[Column, Column | str]) -> Column:
    """the reason of the first check that fails, in order; ``kept`` if none does. A check is (failed, reason)."""
    out = None
    for failed, reason in checks:
        value = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(failed, value) if out is None else out.when(failed, value)
    return F.lit("kept") if out is None else out.otherwise("kept")
