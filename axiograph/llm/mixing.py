"""Mixing sources to target weights over fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiograph.llm.common import mixed, running_sum, settle

#: Words of a block: LEAST_BLOCK, or so many that all words make BLOCKS blocks.
LEAST_BLOCK = 64
BLOCKS = 1 << 28
SHARD_BLOCKS = 4096
MOST_REPEATS = 3
SEED = 20
_ROUNDS = 24
#: One whole turn of a document, in the fixed point of sums.
_ONE = 1 << 20


def targets(sizes: list[int], weights: list[float], most: int = MOST_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; a share stops at most * size and what it leaves goes to the others by weight,
    until none is above: every share is min(most * size, level * weight) for one level."""
    if not sizes:
        return []
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, weight = sum(sizes), sum(weights)
    for i in order:
        if left / weight * weights[i] <= most * sizes[i]:
            break
        left, weight = left - most * sizes[i], weight - weights[i]
    level = left / weight if weight > 0 else 0.0
    return [float(min(most * s, level * w)) for s, w in zip(sizes, weights, strict=True)]


def shuffled(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1, one for each key, takes x: swap-or-not rounds on whole arrays."""
    x = x.astype(np.uint64)
    n = n.astype(np.uint64)
    for r in range(_ROUNDS):
        partner = (mixed(key + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))) % n + n - x) % n
        swap = mixed(np.maximum(x, partner) ^ mixed(key + np.uint64(r))) & np.uint64(1)
        x = np.where(swap.astype(bool), partner, x)
    return x.astype(np.int64)


def mix(docs: DataFrame, block_words: int | None = None, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs.

    docs: doc_id, text, source and any other columns, which are left out. size: words between white space (null text:
    0). Sources by code point, null last, weigh 1, 2, 3, 1, ...; targets() gives each its words. A source's words, in
    doc_id order (nulls first; ties by text hash), are packed into blocks. Every output shard of shard_blocks slots draws its source
    counts from the multinomial of the targets; draws beyond a source's total of slots are left out and a last shard
    makes up what is missing, so a source's words meet its target to half a block, and to what its last, shorter block
    lacks. block_words None: LEAST_BLOCK words, or a BLOCKS-th of all words where that is more, so the number of blocks is
    bounded (10 ** 13 words: blocks of 37,253). Slot i of a source reads block permutation(i mod blocks)
    of epoch i div blocks, so no block is read more than 3 times nor twice in an epoch. taken: words of the row in
    the blocks read. An empty source takes nothing. The result depends on the rows and the seed only.

    One row for each source goes to the driver as a mixture needs all weights at once.
    """
    spark = docs.sparkSession
    rows = settle(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h")).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted((s for s in found if s is not None), key=lambda s: s.encode()) + [None] * (None in found)
    sizes = [found[s] for s in names]
    block_words = block_words or max(LEAST_BLOCK, -(-sum(sizes) // BLOCKS))
    wanted = targets(sizes, [i % 3 + 1 for i in range(len(names))])
    blocks = np.array([-(-s // block_words) for s in sizes], np.int64)
    slots = np.array([round(t * b / s) if s else 0 for t, b, s in zip(wanted, blocks, sizes, strict=True)], np.int64)

    schema = "source string, k int, source_size long, target double"
    table = spark.createDataFrame([(s, k, n, t) for k, (s, n, t) in enumerate(zip(names, sizes, wanted, strict=True))], schema)
    known = rows.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    total = int(slots.sum())
    if not total:
        return known.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))

    shards = -(-total // shard_blocks)
    chance = slots / total

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                n = np.random.Generator(np.random.PCG64([seed, int(shard)])).multinomial(min(shard_blocks, total - int(shard) * shard_blocks), chance)
                yield pd.DataFrame({"shard": shard, "k": np.arange(len(n), dtype=np.int32), "n": n})

    drawn = settle(spark.range(shards).mapInPandas(draw, "shard long, k int, n long"), "draws")
    plan = spark.createDataFrame([(k, int(n)) for k, n in enumerate(slots)], "k int, slots long")
    begun = running_sum(drawn, ["k"], ["shard"], "n", "lo").join(plan, "k").select("k", "shard", "lo", F.least(F.col("lo") + F.col("n"), "slots").alias("hi"))
    missing = drawn.groupBy("k").agg(F.sum("n").alias("lo")).join(plan, "k").where("lo < slots")
    pieces = missing.select("k", F.explode(F.expr(f"sequence(lo, slots - 1, {shard_blocks}L)")).alias("lo"), "slots").select("k", F.lit(shards).cast("long").alias("shard"), "lo", F.least(F.col("lo") + shard_blocks, "slots").alias("hi"))
    ranges = begun.where("lo < hi").unionByName(pieces)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            k, slot = part["k"].to_numpy(), part["slot"].to_numpy()
            n = blocks[k]
            key = mixed(np.uint64(seed) + mixed(k.astype(np.uint64) * np.uint64(1 << 32) + (slot // n).astype(np.uint64)))
            yield pd.DataFrame({"k": k, "block": shuffled(slot % n, n, key)})

    read = ranges.select("k", F.explode(F.expr("sequence(lo, hi - 1)")).alias("slot")).mapInPandas(place, "k int, block long").groupBy("k", "block").agg(F.count("*").alias("times"))

    placed = running_sum(known.select("row", "k", "doc_id", "h", "size"), ["k"], ["doc_id", "h"], "size", "begin")
    spans = placed.where("size > 0").select("row", "k", "begin", (F.col("begin") + F.col("size")).alias("end"), F.explode(F.expr(f"sequence(begin div {block_words}, (begin + size - 1) div {block_words})")).alias("block"))
    overlap = F.least("end", (F.col("block") + 1) * block_words) - F.greatest("begin", F.col("block") * block_words)
    taken = spans.join(read, ["k", "block"]).groupBy("row").agg(F.sum(overlap * F.col("times")).alias("taken"))
    return known.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options: int) -> DataFrame:
    """docs as the mix takes them: each row taken / size times, rounded down or up to whole turns, so 0 to 3 times. What is
    rounded off is carried along a source's rows in the order of their sizes, from a seeded start, so that the words of
    a source are those it is to give, to within two of its longest rows. Rows that share doc_id, source and text are equal to
    the mix and share the mean of their turns; rows without words stay once."""
    counts = mix(docs.select("doc_id", "source", "text"), **options)
    rows = counts.groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken"), F.count("*").alias("copies"))
    rows = rows.select("*", (F.col("size") * F.col("copies")).alias("words"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("group"), F.when(F.col("size") == 0, _ONE).otherwise(F.round(F.col("taken") / F.col("size") * _ONE)).cast("long").alias("share"))
    placed = running_sum(rows, ["group"], ["words", "size", "doc_id"], "share", "before")
    start = F.pmod(F.xxhash64(F.lit(options.get("seed", SEED)), "group"), F.lit(_ONE)) + F.col("before")
    turn = F.when(F.col("size") == 0, 1).otherwise(F.floor((start + F.col("share")) / _ONE) - F.floor(start / _ONE)).cast("int")
    turns = placed.select("doc_id", "source", "size", turn.alias("turns"))
    # columns of docs travel in one struct, so no name of theirs can clash
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), F.col("source").alias("s"), size.alias("n"))
    joined = packed.join(turns, F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size")))
    return joined.where("turns > 0").select("row", F.explode(F.expr("sequence(1, turns)"))).select("row.*")
