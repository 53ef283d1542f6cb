"""Problem 6: documents of varying length into blocks of fixed capacity with as little unused room as possible.

Method: best-two-fit. A block is filled greedily with the largest documents that still fit; then its smallest
document is replaced by the two unpacked ones that fill the widened gap best, if they fill it better.

What a packer decides depends on sizes alone, so the plan is made on the histogram of sizes: at most ``capacity``
distinct numbers, whatever the size of the corpus. A block's choice of sizes is repeated, with a multiplicity, for
as long as the remaining counts allow the very same choice; the plan is the one a document-at-a-time packer would
make. Documents are then matched to the plan by their rank among documents of equal size. Ranks come from
ranks within hashed chunks plus the chunks' running totals: no task ranks all documents of one size.

A document longer than the capacity is cut into full blocks and one remainder, which is packed like any other.
Null and blank texts and those without tokens are left out; repeated rows are documents of their own and need
distinct ids to be told apart. Ties between equal sizes go by id. An empty table gives no blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokens import ByteBpe, with_token_counts
from corpusmill.session import ship_by_value


def plan_blocks(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-two-fit over a histogram size -> count: a list of (number of equal blocks, size -> documents per block)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, count in histogram.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} does not fit a block of {capacity}")
        left[size] = count
    plan = []
    sizes = np.flatnonzero(left)
    while len(sizes):
        gap, used = capacity, {}
        while gap > 0:
            at = int(np.searchsorted(sizes, gap, side="right")) - 1
            while at >= 0 and left[sizes[at]] <= used.get(int(sizes[at]), 0):
                at -= 1
            if at < 0:
                break
            size = int(sizes[at])
            take = int(min(left[size] - used.get(size, 0), gap // size))
            used[size] = used.get(size, 0) + take
            gap -= take * size
        if gap:
            smallest = min(used)
            pair = _best_two(left, sizes, used, gap + smallest, smallest)
            if pair:
                used[smallest] -= 1
                for size in pair:
                    used[size] = used.get(size, 0) + 1
                used = {size: k for size, k in used.items() if k}
        times = min(int(left[size]) // k for size, k in used.items())
        for size, k in used.items():
            left[size] -= times * k
        plan.append((times, used))
        sizes = sizes[left[sizes] > 0]
    return plan


def _best_two(left: np.ndarray, sizes: np.ndarray, used: dict[int, int], room: int, least: int) -> tuple[int, int] | None:
    """The two unpacked sizes with the largest sum in (least, room]; the larger first one on ties."""
    free = left.copy()
    for size, k in used.items():
        free[size] -= k
    open_sizes = sizes[(sizes < room) & (free[sizes] > 0)]
    if not len(open_sizes):
        return None
    second = np.searchsorted(open_sizes, room - open_sizes, side="right") - 1
    lone = (second >= 0) & (open_sizes[second] == open_sizes) & (free[open_sizes] < 2)
    second = np.where(lone, second - 1, second)
    sums = np.where(second >= 0, open_sizes + open_sizes[second], 0)
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    if sums[best] <= least:
        return None
    return int(open_sizes[best]), int(open_sizes[second[best]])


def _slots(plans: dict[str, list[tuple[int, dict[int, int]]]]) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(config, size) -> first ranks, documents per block and first block numbers of the plan's entries for that size."""
    rows: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for config, plan in plans.items():
        filled: dict[int, int] = {}
        block = 0
        for times, used in plan:
            for size, k in used.items():
                rows.setdefault((config, size), []).append((filled.get(size, 0), k, block))
                filled[size] = filled.get(size, 0) + times * k
            block += times
    return {key: tuple(np.array(x, dtype=np.int64) for x in zip(*entries)) for key, entries in rows.items()}


def pack(counts: DataFrame, blocks: DataFrame, max_capacity: int = 100_000, max_configs: int = 20, rows_per_chunk: int = 200_000) -> DataFrame:
    """Blocks of documents: config, block_id, doc_id, piece, first_token, n_tokens.

    ``counts`` has doc_id and n_tokens, ``blocks`` config and block_size (null or non-positive sizes are ignored).
    The driver gets one count per config and size: at most ``max_configs * max_capacity`` numbers, however large the corpus.
    """
    ship_by_value()
    wanted = {r["config"]: int(r["block_size"]) for r in blocks.where(F.col("block_size") > 0).limit(max_configs + 1).collect()}
    if len(wanted) > max_configs or max(wanted.values(), default=0) > max_capacity:
        raise ValueError("too many or too large block sizes")
    if not wanted:
        return counts.select(F.lit("").alias("config"), F.lit(0).cast("long").alias("block_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), F.lit(0).alias("n_tokens")).limit(0)
    configs = F.array(*[F.struct(F.lit(name).alias("config"), F.lit(size).alias("capacity")) for name, size in sorted(wanted.items())])
    docs = counts.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens", F.explode(configs).alias("c"))
    capacity = F.col("c.capacity")
    pieces = docs.select(
        F.col("c.config").alias("config"), "doc_id", "n_tokens", capacity.alias("capacity"),
        F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece"),
    )
    first = F.col("piece").cast("long") * F.col("capacity")
    items = pieces.select("config", "doc_id", "piece", first.alias("first_token"), F.least(F.col("capacity").cast("long"), F.col("n_tokens") - first).cast("int").alias("n_tokens"))

    histogram = items.groupBy("config", "n_tokens").count().collect()
    by_config: dict[str, dict[int, int]] = {name: {} for name in wanted}
    for r in histogram:
        by_config[r["config"]][r["n_tokens"]] = r["count"]
    plans = {name: plan_blocks(sizes, wanted[name]) for name, sizes in by_config.items()}
    slots = _slots(plans)
    chunks = max(1, math.ceil(sum(r["count"] for r in histogram) / rows_per_chunk))

    keyed = items.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int"))
    totals = keyed.groupBy("config", "n_tokens", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("config", "n_tokens").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("config", "n_tokens", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("config", "n_tokens", "chunk").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, ["config", "n_tokens", "chunk"]).withColumn("rank", F.col("rank") + F.col("offset"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block = np.zeros(len(batch), dtype=np.int64)
            for key, rows in batch.groupby(["config", "n_tokens"], sort=False).indices.items():
                starts, per_block, first_block = slots[key]
                rank = batch["rank"].to_numpy()[rows]
                at = np.searchsorted(starts, rank, side="right") - 1
                block[rows] = first_block[at] + (rank - starts[at]) // per_block[at]
            yield pd.DataFrame({"config": batch["config"], "block_id": block, "doc_id": batch["doc_id"], "piece": batch["piece"], "first_token": batch["first_token"], "n_tokens": batch["n_tokens"]})

    columns = ranked.select("config", "doc_id", "piece", "first_token", "n_tokens", F.col("rank").cast("long").alias("rank"))
    return columns.mapInPandas(placed, "config string, block_id long, doc_id long, piece int, first_token long, n_tokens int")


def pack_documents(documents: DataFrame, blocks: DataFrame, bpe: ByteBpe) -> DataFrame:
    """Token counts of the non-blank documents, then ``pack``."""
    text = F.col("text")
    rows = documents.where(F.col("doc_id").isNotNull() & text.isNotNull() & text.rlike(r"(?U)\S"))
    return pack(with_token_counts(rows, "text", bpe, ["doc_id"]), blocks)


def block_fill(packed: DataFrame, blocks: DataFrame) -> DataFrame:
    """By config: blocks, tokens and the share of the room that is used."""
    used = packed.groupBy("config").agg(F.countDistinct("block_id").alias("n_blocks"), F.sum("n_tokens").alias("n_tokens"))
    room = F.col("n_blocks") * F.col("block_size")
    return used.join(blocks.select("config", "block_size"), "config").select("config", F.col("block_size").cast("long").alias("block_size"), "n_blocks", "n_tokens", F.round(F.col("n_tokens") / room, 6).alias("fill"))
