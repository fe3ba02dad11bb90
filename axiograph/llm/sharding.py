"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiograph.llm.common import attached, running_sum, settle

SHARDS = 8
#: A group with more than 1/(shards * FINE) of all bytes, tokens or rows is placed first; one that a whole shard can't hold is split.
FINE = 256
#: Groups that one task packs.
PACKED = 50_000
_DIMENSIONS = ["bytes", "tokens", "rows"]


def _pack(items: np.ndarray, residual: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Place each item (a row of sizes) where its dot product with the residual capacity is highest; residual changes."""
    sizes, left = items / scale, residual / scale
    shard = np.empty(len(items), np.int32)
    for i, x in enumerate(sizes):
        s = int((left @ x).argmax())
        shard[i] = s
        left[s] -= x
    residual[:] = left * scale
    return shard


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) for every row of docs.

    docs: doc_id, text and any other columns, which are left out. size: UTF-8 bytes of the text and 1 (null text: 1,
    crc32 0). Rows with equal texts are a group (null texts are one, empty texts another) and go to one shard, except that a group with more than
    1 / n_shards of all bytes, tokens or rows, which no shard could hold evenly, is split by doc_id into as few pieces as a shard can
    hold. Groups are placed largest first: those above 1 / (n_shards * 256), of which there is a
    bounded number, on the driver; the rest in tasks of some PACKED groups, each with its share of what capacity is
    left. slot counts a shard's rows in doc_id order (nulls first, ties in a fixed order) from 0. No rows: no rows.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = settle(docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("key")), "rows")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = settle(rows.groupBy("key").agg(*sums), "groups")
    total = groups.agg(*[F.sum(d).alias(d) for d in _DIMENSIONS], F.count("*").alias("groups")).first()
    scale = np.array([max(1, total[d] or 0) for d in _DIMENSIONS], float) / n_shards  # one shard's capacity

    share = F.greatest(*[F.col(d) / F.lit(float(s)) for d, s in zip(_DIMENSIONS, scale, strict=True)])
    split = groups.select("key", F.ceil(share).cast("int").alias("pieces")).where("pieces > 1")  # at most 3 * n_shards
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("pieces"))).otherwise(0).cast("int")
    pieced = rows.join(F.broadcast(split), "key", "left").withColumn("piece", piece).drop("pieces")
    items = settle(pieced.groupBy("key", "piece").agg(*sums).withColumn("share", share), "items")

    large = items.where(F.col("share") > 1 / FINE).orderBy(F.desc("share"), "key", "piece").toPandas()  # at most 3 * n_shards * FINE
    residual = np.tile(scale, (n_shards, 1))
    large["shard"] = _pack(large[_DIMENSIONS].to_numpy(float), residual, scale)
    small_total = np.maximum(scale * n_shards - large[_DIMENSIONS].to_numpy(float).sum(0), 1)
    tasks = max(1, -(-int(total["groups"] or 0) // PACKED))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["share", "key", "piece"], ascending=[False, True, True])
        sizes = part[_DIMENSIONS].to_numpy(float)
        own = sizes.sum(0)
        part["shard"] = _pack(sizes, residual * (own / small_total), np.maximum(own / n_shards, 1e-9))
        return part[["key", "piece", "shard"]]

    small = items.where(F.col("share") <= 1 / FINE).withColumn("task", F.pmod(F.xxhash64("key", "piece"), F.lit(tasks)))
    placed = small.groupBy("task").applyInPandas(place, "key binary, piece int, shard int")
    if len(large):
        placed = placed.unionByName(spark.createDataFrame([(bytes(k), int(p), int(s)) for k, p, s in large[["key", "piece", "shard"]].itertuples(index=False)], "key binary, piece int, shard int"))
    placed = placed.join(items.select("key", "piece", "rows"), ["key", "piece"]).select(F.struct("key", "piece").alias("item"), "shard", "rows")
    dealt = attached(pieced.withColumn("item", F.struct("key", "piece")), settle(placed, "placed"), "item", "rows").select("doc_id", "size", "text_crc32", "shard", F.lit(1).alias("one"))
    slots = running_sum(dealt, ["shard"], ["doc_id", "text_crc32"], "one", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
