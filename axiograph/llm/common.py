"""What the operators share: written tables in the cluster's shared folder, running sums over ordered rows, and
hashing of byte spans over whole Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiograph.sources.shared import new_path, settle  # noqa: F401

#: Bytes of text that one vectorised step looks at; a longer document is a step of its own.
CHUNK_BYTES = 500_000


def released(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """step for mapInArrow, after whose last batch the worker gives free memory back: workers serve all stages in turn, and keep what the largest took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return run


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """rows with out: the sum of value over the rows of the same group that come before in the given order.

    Rows are dealt by ranges of (group, order), so a large group spreads over many tasks; only one total for each
    range and group is summed across ranges. Nulls sort first; group columns must not be null. Ties in order keep an
    arbitrary but fixed sequence, as the dealt rows are written first.
    """
    keys = [*group, *order]
    placed = settle(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("part_", F.spark_partition_id()).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("at_", F.monotonically_increasing_id()), "ranges")
    within = Window.partitionBy(*group, "part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*group, "part_").agg(F.sum(value).alias("total_")).withColumn("base_", F.coalesce(F.sum("total_").over(across), F.lit(0)))
    joined = placed.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0))).join(totals.drop("total_"), [*group, "part_"])
    return joined.withColumn(out, F.col(out) + F.col("base_")).drop("base_", "part_", "at_")


def attached(rows: DataFrame, table: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """rows (all with a key) joined with table, which has one row for each key and in `weight` the key's number of rows.

    Keys with over 1 / share of all rows, of which there are fewer than `share`, are broadcast, so a hot key's rows stay
    where they are; the rest meet by a shuffle. weight is left out of the result.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * share > total
    hot = table.where(is_hot).drop(weight)
    many = rows.join(F.broadcast(hot), key)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~is_hot).drop(weight), key)
    return many.unionByName(few)


#: Keys that without() sends to all tasks, at most: 8 MB of longs.
BROADCAST_KEYS = 1_000_000


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is in gone (a written table of distinct keys); rows with a null key stay. Up to BROADCAST_KEYS keys go to
    the rows, so these are not shuffled; more meet them by a shuffle."""
    few = gone.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of the links a-b: root is the smallest node that can be reached.

    Alternates large-star and small-star steps on written edge tables until the edges no longer change, which takes
    a number of rounds that is logarithmic in practice; every step is a minimum by node and a join, so no
    component is ever in one task. Nulls take no part.
    """
    edges = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = settle(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# Byte spans ----------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            full = np.full(max(n, CHUNK_BYTES + 2), base, np.uint64)
            full[0] = 1
            _powers[name] = np.cumprod(full)
    return _powers["up"], _powers["down"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of each values[start:end] (polynomial over prefix sums, then mixed); equal spans are equal."""
    n = len(values)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column laid end to end, and where each row starts (one more at the end); null: empty."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("" if text else b"")
    column = column.cast(pa.large_string() if text else pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, row after the last, bytes, row starts: whole rows, about CHUNK_BYTES at a time."""
    data, at = column_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words_of(data: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and row of each maximal run of bytes with wanted[byte], never across rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = wanted[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[at] = True  # rows without bytes mark the same place
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | fresh[1:-1]
    end[:-1] &= ~inside[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (words_of), and the first word of each row (one more at the end)."""
    starts, ends, rows = words_of(data, at, wanted)
    return span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64), np.searchsorted(rows, np.arange(len(at)))


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words from each word on, and whether these lie in one row."""
    k = max(0, len(words) - n + 1)
    row = np.searchsorted(first, np.arange(len(words)), "right")
    whole = row[:k] == row[n - 1 : n - 1 + k] if k else np.zeros(0, bool)
    at = np.arange(k)
    return (span_hashes(words, at, at + n) ^ np.uint64(n) if k else np.zeros(0, np.uint64)), whole


def winnowed(words: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the smallest (of equals the last) of every `window` consecutive hashes of `gram` words in
    a row. Rows that share gram + window - 1 consecutive words keep one of the same hashes inside of them."""
    hashes, _ = grams(words, first, gram)
    k = len(hashes) - window + 1
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.searchsorted(first, np.arange(len(words)), "right")
    inside = row[:k] == row[gram + window - 2 : gram + window - 2 + k]
    least, place = hashes[window - 1 :].copy(), np.arange(window - 1, window - 1 + k)
    for back in range(1, window):
        other = hashes[window - 1 - back : window - 1 - back + k]
        less = np.flatnonzero(other < least)
        least[less], place[less] = other[less], less + window - 1 - back
    chosen = np.unique(place[inside])
    return chosen, hashes[chosen]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: The bytes \x20 and \x09-\x0D divide words.
_SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[_SPACES] = False
#: A-Z in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
