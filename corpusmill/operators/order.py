"""Order-dependent operators without a single-partition sort.

Rows are range-partitioned by (group, order). Ranks and running sums are taken within each partition, and
each partition adds what the partitions before it hold. Only one row per group and partition is gathered for that,
so neither a global order nor a group with most of the rows meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage


def with_running(df: DataFrame, order: list[str], group: list[str] | None = None, value: Column | None = None, rank: str = "rank", before: str = "before") -> DataFrame:
    """Adds ``rank`` (0-based position in the group) and, with ``value``, ``before`` (sum of the values ahead; null counts 0).

    ``order`` must order the rows totally, else equal rows are ranked in any order. Empty input gives no rows.
    """
    group = group or []
    ranged = df.withColumn("__value", F.coalesce(value, F.lit(0)).cast("long") if value is not None else F.lit(0).cast("long"))
    ranged = cut_lineage(ranged.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    keys = [*group, "__part"]
    within = Window.partitionBy(*keys).orderBy(*order)
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn(rank, F.row_number().over(within) - 1).withColumn(before, F.coalesce(F.sum("__value").over(ahead), F.lit(0)))
    totals = ranged.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__ranks"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__sums"))
    same = [local[k].eqNullSafe(offsets[k]) for k in keys]
    joined = local.join(offsets, same[0] if len(same) == 1 else _all_of(same))
    columns = [local[c] for c in df.columns if c not in (rank, before)]
    out = joined.select(*columns, (local[rank] + offsets["__ranks"]).cast("long").alias(rank), (local[before] + offsets["__sums"]).cast("long").alias(before))
    return out if value is not None else out.drop(before)


def _all_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def running_best(df: DataFrame, order: list[str], group: list[str], value: str, best: str = "best_before") -> DataFrame:
    """Adds the largest ``value`` among the rows ahead in the group; null at its first row.

    As in ``with_running``, parts of the range are scanned apart and one number per group and part is gathered.
    """
    ranged = cut_lineage(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    keys = [*group, "__part"]
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn(best, F.max(value).over(ahead))
    parts = ranged.groupBy(*keys).agg(F.max(value).alias("__most"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, F.max("__most").over(earlier).alias("__earlier"))
    joined = local.join(offsets, _all_of([local[k].eqNullSafe(offsets[k]) for k in keys]))
    return joined.select(*[local[c] for c in df.columns], F.greatest(local[best], offsets["__earlier"]).alias(best))


def budget_cut(df: DataFrame, order: list[str], length: Column, max_rows: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Rows in order until a budget is used up. The row that crosses it is kept, and so is the first row always.

    Only the order and the lengths are ranked; the rows themselves are then picked by their order, which must be unique and not null.
    """
    lean = with_running(df.select(*order, length.cast("long").alias("__length")), order, value=F.col("__length"))
    keep = F.lit(True)
    if max_rows is not None:
        keep = keep & (F.col("rank") < max_rows)
    if max_chars is not None:
        keep = keep & (F.col("before") < max_chars)
    return df.join(lean.where((F.col("rank") == 0) | keep).select(*order), order, "left_semi")


def two_level_budget(df: DataFrame, group: str, order: list[str], text: str, per_group: int, total: int) -> DataFrame:
    """A budget of characters per group and one over all groups, in the order of groups; the last text is cut.

    Lengths alone are ranked; the texts that get a share are then picked by group and order, which must be unique, the order not null.
    """
    lean = df.select(group, *order, F.length(text).cast("long").alias("__length")).where("__length > 0")
    left = lambda rows, budget: F.greatest(F.lit(0).cast("long"), F.least(F.col("__length"), F.lit(budget) - rows["before"]))
    first = with_running(lean, order, [group], F.col("__length"))
    taken = first.withColumn("__length", left(first, per_group)).where("__length > 0").drop("rank", "before")
    second = with_running(taken, [group, *order], value=F.col("__length"))
    shares = second.withColumn("__length", left(second, total)).where("__length > 0").select(F.col(group).alias("__g"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], "__length")
    same = _all_of([F.col(group).eqNullSafe(F.col("__g")), *[F.col(c) == F.col(f"__o{k}") for k, c in enumerate(order)]])
    cut = df.join(shares, same).withColumn(text, F.substring(F.col(text), F.lit(1), F.col("__length").cast("int")))
    return cut.select(*df.columns)


def periodic_split(df: DataFrame, order: list[str], ratio: float) -> DataFrame:
    """Every round(1/ratio)-th row goes to val, the first one too. Halves are rounded to even."""
    period = max(1, round(1 / max(ratio, 1e-6)))
    return with_running(df, order).withColumn("split", F.when(F.col("rank") % period == 0, "val").otherwise("train")).drop("rank")


def even_positions(count: Column, most: int) -> Column:
    """At most ``most`` positions spread evenly over ``count`` items. Halves are rounded to even."""
    if most <= 0:
        return F.sequence(F.lit(0).cast("long"), count - 1)
    if most == 1:
        return F.array(F.lit(0).cast("long"))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (count - 1) / F.lit(most - 1), 0).cast("long")))
    return F.when(count <= most, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(spread)


def even_sample(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, spread evenly over its order."""
    ranked = with_running(df, order, [group])
    counts = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n")).select("__g", F.explode(even_positions(F.col("__n"), most)).alias("__at"))
    return ranked.join(counts, ranked[group].eqNullSafe(counts["__g"]) & (ranked["rank"] == counts["__at"])).drop("__g", "__at")


def seeded_order(df: DataFrame, key: str, seed: int) -> Column:
    """A reproducible random order: a hash of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def reservoir_sample(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``size`` rows: the smallest hashes. Only the best rows of each task travel."""
    return df.orderBy(seeded_order(df, key, seed), key).limit(max(0, size))


def limit_per_group(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """The first rows of each group. Spark prunes to ``size`` rows per group before the exchange."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("__rank") <= size).drop("__rank")


def pack_stream(df: DataFrame, order: list[str], tokens: str, length: int) -> DataFrame:
    """The tokens in order as one stream, cut into blocks: block_id, x (inputs), y (x shifted by one).

    ``tokens`` is an array of ids or a binary column, whose bytes are the ids. There are floor((n - 1) / length) blocks; the rest of the stream is
    dropped. Only the lengths are ranked; the tokens are moved to their block alone. The order must be unique and not null.
    """
    binary = dict(df.dtypes)[tokens] == "binary"
    measure = F.octet_length if binary else F.size
    rows = df.where(measure(tokens) > 0)
    lean = with_running(rows.select(*order, measure(tokens).cast("long").alias("__n")), order, value=F.col("__n"))
    lean = cut_lineage(lean.select(*order, "before", (F.col("before") + F.col("__n")).alias("end")))
    total = lean.agg(F.max("end")).first()[0] or 0
    # Each row is cut at the blocks' bounds. A block needs the first token of the next one for its last target: that token is sent to both.
    first = F.greatest(F.lit(0), F.ceil(F.col("before") / length) - 1).cast("long")
    sized = rows.select(*order, F.col(tokens).alias("__t")).join(lean, order)
    cut = sized.select("before", "end", F.col("__t").alias("t"), F.explode(F.sequence(first, F.floor((F.col("end") - 1) / length).cast("long"))).alias("block_id"))
    start = F.greatest(F.col("block_id") * length, F.col("before"))
    stop = F.least((F.col("block_id") + 1) * length + 1, F.col("end"))
    part = (F.substring if binary else F.slice)("t", (start - F.col("before") + 1).cast("int"), (stop - start).cast("int"))
    sent = cut.where(F.col("block_id") < (total - 1) // length).select("block_id", start.alias("p"), part.alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("p", "t")))
    whole = F.aggregate(parts, F.lit(b""), lambda a, s: F.concat(a, s["t"])) if binary else F.flatten(F.transform(parts, lambda s: s["t"]))
    blocks = sent.groupBy("block_id").agg(whole.alias("all"))
    piece = F.substring if binary else F.slice
    return blocks.select("block_id", piece("all", F.lit(1), F.lit(length)).alias("x"), piece("all", F.lit(2), F.lit(length)).alias("y"))


def shuffled_blocks(blocks: DataFrame, seed: int, epoch: int, world: int, batch: int) -> DataFrame:
    """Blocks in a reproducible order per epoch, cut to whole global batches, with position and worker.

    The order is that of a hash of seed, epoch and block; blocks beyond the last whole batch of all workers are left out.
    """
    keyed = blocks.withColumn("__key", F.sha2(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col("block_id").cast("string")), 256))
    placed = with_running(keyed, ["__key"]).drop("__key")
    whole = F.broadcast(blocks.agg(F.count("*").alias("__n")))
    kept = placed.join(whole, F.col("rank") < F.col("__n") - F.col("__n") % (world * batch)).drop("__n")
    return kept.withColumnRenamed("rank", "position").withColumn("worker", F.pmod(F.floor(F.col("position") / batch), F.lit(world)).cast("int"))


def crop_starts(spark, n: int, length: int, stream: int, seed: int) -> DataFrame:
    """``n`` uniform starts, with replacement, of crops of ``length`` tokens and one more in a stream."""
    if stream <= length:
        raise ValueError("the stream must be longer than a crop")
    return spark.range(n).select(F.col("id").alias("crop"), F.floor(F.rand(seed) * (stream - length)).cast("long").alias("start"))
