"""Semi, anti and set operators over keys, duplicates, and leaks of benchmark texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import normalize_text, stable_hash


def hot_keys(counts: DataFrame, keys: list[str], n: str, most: int = 10_000, least: int = 100_000, total: int | None = None) -> DataFrame:
    """Keys with so many rows that they are split, and into how many parts (``__salts``): at most ``most`` keys, whatever the table's size.

    A key is hot above ``least`` rows, and above total / ``most`` of them in tables so large that otherwise more keys could be hot.
    ``total`` is the number of rows if it is known; else it is summed here.
    """
    total = total if total is not None else counts.agg(F.sum(n)).first()[0] or 0
    limit = max(least, math.ceil(total / most))
    return counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("__salts"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: str, counts: DataFrame, n: str = "n", how: str = "inner", total: int | None = None, least: int = 100_000) -> DataFrame:
    """``left`` joined to ``right``, a table with few rows per key, where a key may hold most of ``left``.

    ``counts`` has the rows of ``left`` per key in ``n`` (checkpointed, as it is read twice). Rows of hot keys are split by a hash of
    ``spread_by`` and meet a copy each of the key's rows on the right. Null keys match nothing and are spread too. ``how``: inner or left.
    """
    hot = F.broadcast(hot_keys(counts, keys, n, least=least, total=total))
    lost = F.col(keys[0]).isNull()
    for key in keys[1:]:
        lost = lost | F.col(key).isNull()
    hashed = F.xxhash64(spread_by)
    rows = left.join(hot, keys, "left").withColumn("__salt", F.when(lost, F.pmod(hashed, F.lit(1024))).otherwise(F.coalesce(F.pmod(hashed, F.col("__salts")), F.lit(0))).cast("int"))
    sides = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    return rows.drop("__salts").join(sides.drop("__salts"), [*keys, "__salt"], how).drop("__salt")


def shared_keys(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """The distinct keys that occur on both sides."""
    return a.select(F.col(key_a).alias("key")).intersect(b.select(F.col(key_b).alias("key")))


def drop_keys(df: DataFrame, keys: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose key is not among ``keys``. A null key stays: it matches nothing.

    Null keys are spread by the whole row's hash, so that they do not meet in one task; other hot keys are split by Spark at run time.
    """
    lone = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not dict(df.dtypes)[c].startswith(("map", "variant"))]), F.lit(1024))).otherwise(F.lit(0))
    wanted = keys.select(F.col(other).alias("__key")).where("__key is not null").distinct()
    return df.join(wanted, (F.col(key) == F.col("__key")) & (lone == F.lit(0)), "left_anti")


def union_keys(*sides: tuple[DataFrame, str]) -> DataFrame:
    """The distinct keys of several tables, nulls removed."""
    out = None
    for df, key in sides:
        part = df.select(F.col(key).alias("key")).where("key is not null")
        out = part if out is None else out.union(part)
    return out.distinct()


def first_of_duplicates(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key: the one with the smallest ``order``. Partial aggregation keeps hot keys small."""
    kept = df.where(key.isNotNull()).groupBy(key.alias("__key")).agg(F.min(order).alias("__first"))
    return df.join(kept.select("__first"), F.col(order) == F.col("__first"), "left_semi")


def duplicate_hashes(df: DataFrame, text: str, order: str) -> DataFrame:
    """Per normalised text: hash, number of rows and the first one."""
    hashed = df.where(F.col(text).isNotNull()).select(stable_hash(F.col(text)).alias("text_hash"), F.col(order).alias("__o"))
    return hashed.groupBy("text_hash").agg(F.count("*").alias("n_rows"), F.min("__o").alias("first_id"))


def bench_index(bench: DataFrame, text: str = "prompt") -> DataFrame:
    """norm, label, ord of each benchmark text; of equal texts the last label counts."""
    rows = bench.select(normalize_text(F.col(text)).alias("norm"), F.concat_ws(":", "dataset", "task_id").alias("label"), F.col("item_id").alias("ord")).where("norm <> ''")
    return rows.groupBy("norm").agg(F.max_by("label", "ord").alias("label"), F.min("ord").alias("ord"))


def exact_leaks(texts: DataFrame, index: DataFrame) -> DataFrame:
    """``texts`` (id, field, pos, norm) whose normalised text is a benchmark text; adds label."""
    return texts.join(index.select("norm", "label"), "norm").select("id", "field", "pos", "label")


def near_leaks(texts: DataFrame, index: DataFrame, least: int = 120, ratio: float = 0.85, n: int = 8) -> DataFrame:
    """Pairs of texts of at least ``least`` characters of which one contains the other, with lengths at least ``ratio`` apart.

    If the longer one contains the shorter one, it has the shorter one's words 2 to n + 1 in a row, and, as the lengths are alike, begins
    them within its first 1 - ratio. So the shorter text gives one n-gram of words, the longer one those of its beginning, and both meet by it;
    then containment is tested. Texts with too few words for that meet by their length. Of several matches the first in index order is kept.
    """
    size = F.length("norm")
    words = F.split("norm", " ")
    few = F.size(words) < n + 2
    left = texts.where(size >= least).select("id", "field", "pos", "norm", words.alias("w"), few.alias("few"))
    right = index.where(size >= least).select("norm", "label", "ord", words.alias("w"), few.alias("few"))
    gram = lambda at: F.xxhash64(F.array_join(F.slice("w", at, F.lit(n)), " "))
    own = F.array(gram(F.lit(2)))
    # A text of m characters holds the shorter one from its first (1 - ratio) * m characters on; the n-gram begins one word later.
    words_ahead = F.size(F.split(F.substring("norm", F.lit(1), (F.length("norm") * (1 - ratio) + 1).cast("int")), " "))
    spots = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(words_ahead + 1, F.size("w") - n + 1)))
    begun = F.transform(spots, gram)

    def keyed(rows: DataFrame, kind: Column, keys: Column) -> DataFrame:
        return rows.where(~F.col("few")).select("*", kind.alias("kind"), F.explode(keys).alias("key"))

    def both(rows: DataFrame, shorter: int, longer: int) -> DataFrame:
        bucket = F.floor(F.log(F.length("norm")) / -math.log(ratio)).cast("long")
        around = F.array(bucket - 1, bucket, bucket + 1) if longer == 0 else F.array(bucket)
        # The texts with few words meet every text of like length; on either side they may be the shorter one.
        lone = rows.where("few").select("*", F.lit(2).alias("kind"), F.explode(around).alias("key"))
        plain = rows.where(~F.col("few")).select("*", F.lit(3 + longer).alias("kind"), F.explode(around).alias("key"))
        facing = rows.where("few").select("*", F.lit(4 - longer).alias("kind"), F.explode(around).alias("key"))
        return keyed(rows, F.lit(shorter), own).unionByName(keyed(rows, F.lit(longer), begun)).unionByName(lone).unionByName(plain).unionByName(facing).drop("w", "few")

    a = both(left, 0, 1).withColumnRenamed("norm", "t")
    b = both(right, 1, 0).withColumnRenamed("norm", "b")
    alike = F.least(F.length("t"), F.length("b")) / F.greatest(F.length("t"), F.length("b")) >= ratio
    hits = a.join(b, ["kind", "key"]).where(alike & (F.col("t").contains(F.col("b")) | F.col("b").contains(F.col("t"))))
    return hits.groupBy("id", "field", "pos").agg(F.min_by("label", "ord").alias("label"))


def leak_candidates(rows: DataFrame) -> DataFrame:
    """The texts of an exercise that may leak, in order: question, original instruction, docstrings and declarations."""
    per_test = F.transform(
        F.coalesce("test_info", F.array().cast("array<struct<docstring:string,function_declaration:string,function_name:string>>")),
        lambda t, i: F.array(
            F.struct(F.concat(F.lit("test_info."), i.cast("string"), F.lit(".docstring")).alias("field"), t["docstring"].alias("text")),
            F.struct(F.concat(F.lit("test_info."), i.cast("string"), F.lit(".function_declaration")).alias("field"), t["function_declaration"].alias("text")),
        ),
    )
    fixed = F.array(F.struct(F.lit("question").alias("field"), F.col("question").alias("text")), F.struct(F.lit("metadata.original_instruction").alias("field"), F.col("metadata.original_instruction").alias("text")))
    exploded = rows.select(F.col("row_id").alias("id"), F.posexplode(F.concat(fixed, F.flatten(per_test))).alias("pos", "c"))
    return exploded.select("id", F.col("c.field").alias("field"), "pos", normalize_text(F.col("c.text")).alias("norm")).where("norm <> ''")


def first_leak(texts: DataFrame, index: DataFrame) -> DataFrame:
    """id and reason of the first leak: by position of the field, an exact match before a near one."""
    exact = exact_leaks(texts, index).select("id", "pos", F.lit(0).alias("near"), F.concat_ws(":", F.lit("leak"), "field", "label").alias("reason"))
    near = near_leaks(texts, index).select("id", "pos", F.lit(1).alias("near"), F.concat_ws(":", F.lit("near_leak"), "field", "label").alias("reason"))
    return exact.union(near).groupBy("id").agg(F.min_by("reason", F.struct("pos", "near")).alias("reason"))
