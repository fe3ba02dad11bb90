"""Prefix tries of conversations: level-order tries of bounded shards, with the heavy upper levels merged apart."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiograph.llm.common import running_sum, settle

#: Turns below a node, at most, that one shard holds; nodes above more are merged apart.
SHARD = 4096
#: Turns that a task builds tries of at a time.
STEP = 50_000
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_SHARDED = "shard string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Fixed value: what divides words.
_SPACES = r"[^\x20\x09-\x0D]+"


class Louds:
    """Tries in level order: a bit vector (for every node a 1 for each child, then a 0; the tries are the children of a node before all) and the
    label and the level of each node."""

    def __init__(self, degrees: np.ndarray, labels: np.ndarray, levels: np.ndarray):
        ones = np.ones(degrees.sum() + len(degrees), np.uint8)
        ones[np.cumsum(degrees + 1) - 1] = 0
        self.bits, self.size, self.labels, self.levels = np.packbits(ones), len(ones), labels, levels

    def parents(self) -> np.ndarray:
        """Of each node; -1 for the tries' roots. The n-th 1 is node n, and the 0s before it count the nodes before its parent."""
        ones = np.unpackbits(self.bits, count=self.size)
        return np.cumsum(ones == 0)[ones == 1].astype(np.int64) - 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=self.size) == 0)
        return (np.diff(np.concatenate([[-1], zeros])) - 1)[1:]

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """values summed over every node's subtree, from the last level to the first."""
        out, parents = values.copy(), self.parents()
        bounds = np.searchsorted(self.levels, np.arange(self.levels[-1] + 2)) if len(values) else [0]
        for lo, hi in reversed(list(zip(bounds[1:-1], bounds[2:], strict=True))):
            np.add.at(out, parents[lo:hi], out[lo:hi])
        return out


def built(shard: np.ndarray, path: np.ndarray, level: np.ndarray, labels: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The tries of paths, and the node of each row. A row is the label of a path at a level (from 0, gapless); all rows of level 0 of a shard are one root."""
    node, current, degrees, kept, levels, n = np.zeros(len(path), np.int64), np.zeros(path.max(initial=-1) + 1, np.int64), [], [], [], 0
    for k in range(int(level.max(initial=-1)) + 1):
        rows = np.flatnonzero(level == k)
        above = shard[rows] if k == 0 else current[path[rows]]
        key = labels[rows] if k else np.zeros_like(labels[rows])
        order = np.lexsort((*key.T, above))
        fresh = np.append(True, (above[order][1:] != above[order][:-1]) | (key[order][1:] != key[order][:-1]).any(axis=1))
        node[rows[order]] = current[path[rows[order]]] = n + np.cumsum(fresh) - 1
        first = rows[order[fresh]]
        degrees.append((above[order[fresh]], len(first)))
        kept.append(first)
        levels.append(np.full(len(first), k))
        n += len(first)
    counts = np.zeros(n + 1, np.int64)  # the node before all comes first
    for k, (above, size) in enumerate(degrees):
        if k == 0:
            counts[0] = size
        else:
            np.add.at(counts, above + 1, 1)
    where = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return Louds(counts, labels[where], np.concatenate(levels) if levels else np.zeros(0, np.int64)), node


def _joined(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shard, root_depth, conv_id, depth, length, l1, l2, words, by shard, conv_id and depth: the nodes of whole shards, some STEP rows at a time."""

    def nodes(t: pa.Table) -> pa.RecordBatch:
        names = t.column("shard").combine_chunks().dictionary_encode()
        shard = names.indices.to_numpy().astype(np.int64)
        root, conv, depth, length, l1, l2, words = (t.column(c).to_numpy() for c in ("root_depth", "conv_id", "depth", "length", "l1", "l2", "words"))
        path = np.cumsum(np.append(True, (shard[1:] != shard[:-1]) | (conv[1:] != conv[:-1]))) - 1
        trie, node = built(shard, path, depth - root, np.stack([l1, l2], axis=1))
        n = len(trie.labels)
        parent, convs, owner, at = trie.parents(), np.bincount(node, minlength=n), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        np.minimum.at(owner, node, conv)
        at[node] = np.arange(len(node))
        degrees = trie.degrees()
        leaves = trie.rolled_up((degrees == 0).astype(np.int64))
        saved = trie.rolled_up((convs - 1) * words[at])
        last = np.flatnonzero(depth == length)
        order = last[np.lexsort((conv[last], node[last]))]
        cut = np.searchsorted(node[order], np.arange(n + 1))
        ids = conv[order].tolist()
        ends = [_joined(ids[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        above = pa.array(np.where(parent < 0, 0, owner[parent]), mask=parent < 0)
        columns = [names.dictionary.take(pa.array(shard[at])), owner, depth[at], above, convs, degrees, leaves, saved, ends]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [x.split()[0] for x in _SHARDED.split(", ")])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= STEP:
            t = pa.Table.from_batches(held).combine_chunks()
            names = t.column("shard").combine_chunks()
            whole = t.num_rows - 1  # the last shard may go on in the next batch
            while whole and names[whole - 1] == names[t.num_rows - 1]:
                whole -= 1
            if whole:
                yield nodes(t.slice(0, whole))
            held = t.slice(whole).to_batches()
    if held and sum(b.num_rows for b in held):
        yield nodes(pa.Table.from_batches(held).combine_chunks())


def _flagged(rows: DataFrame, heavy: DataFrame, share: int = 1000) -> DataFrame:
    """rows with `heavy` (true or null). Nodes with over 1 / share of all rows, fewer than share for each depth, meet their rows by a broadcast, others by a shuffle."""
    total = rows.where("depth = 0").count()
    keys = heavy.select("depth", "prefix", "n_convs", F.lit(True).alias("heavy"))
    hot, rest = keys.where(F.col("n_convs") * share > total).limit(100 * share).drop("n_convs"), None
    hot = settle(hot, "hot")
    rest = keys.drop("n_convs").join(hot.select("depth", "prefix"), ["depth", "prefix"], "left_anti")
    met = rows.join(F.broadcast(hot), ["depth", "prefix"], "left")
    few = met.where("heavy IS NULL").drop("heavy").join(rest, ["depth", "prefix"], "left")
    return met.where("heavy").unionByName(few)


def trie_nodes(convs: DataFrame, turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of all conversations: NODE, where conv_id is the node's smallest member.

    convs: conv_id, each once. turns: conv_id, place (from 0, gapless in a conversation), role, text, none of them null. Turns are the same if
    two 64-bit hashes of role and text are. A node's key is its depth and the sum of a hash of place and turn over its turns, so keys are running
    sums. Nodes above more than `shard` turns are heavy: they are counted by aggregation over rows of conversation and depth. What lies below
    them falls into shards of at most `shard` rows, whose tries are built in level order and rolled up from the last level. Subtotals of shards
    belong to the smallest conversation of the shard, as a heavy node's own values do, so a heavy node's sum over its subtree is the sum over its
    members of what is theirs at its depth or below. No conversations: no nodes.
    """
    label = [F.xxhash64("role", "text"), F.xxhash64("text", F.lit(7), "role")]
    words = F.when(F.col("text") == "", 0).otherwise(F.size(F.regexp_extract_all("text", F.lit(_SPACES), F.lit(0)))).cast("long")
    flat = turns.select("conv_id", (F.col("place") + 1).alias("depth"), label[0].alias("l1"), label[1].alias("l2"), words.alias("words"))
    step = F.xxhash64("depth", "l1", "l2").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.pmod(F.xxhash64("l2", "depth", "l1"), F.lit(1 << 31)).cast("decimal(38,0)")
    flat = running_sum(flat.withColumn("step", step.cast("decimal(38,0)")), ["conv_id"], ["depth"], "step", "above").withColumn("above", F.col("above").cast("decimal(38,0)"))
    lengths = convs.join(flat.groupBy("conv_id").agg(F.max("depth").alias("length")), "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0).cast("long")).alias("length"))
    lengths = settle(lengths, "lengths")
    rows = flat.select("conv_id", "depth", "l1", "l2", "words", "above", (F.col("above") + F.col("step")).cast("decimal(38,0)").alias("prefix"))
    none = F.lit(0).cast("long")
    rows = rows.unionByName(convs.select("conv_id", none.alias("depth"), none.alias("l1"), none.alias("l2"), none.alias("words"), F.lit(None).cast("decimal(38,0)").alias("above"), F.lit(0).cast("decimal(38,0)").alias("prefix")))
    rows = settle(rows.join(lengths, "conv_id"), "rows")

    nodes = rows.groupBy("depth", "prefix").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"), F.first("above").alias("above"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"), F.sum((F.col("length") == F.col("depth")).cast("long")).alias("n_ends"))
    nodes = settle(nodes, "nodes")
    heavy = nodes.where((F.col("below") > shard) | (F.col("depth") == 0))
    marked = settle(_flagged(rows, heavy), "marked")
    upper, light = marked.where("heavy"), marked.where("heavy IS NULL")

    roots = light.groupBy("conv_id").agg(F.min(F.struct("depth", "prefix", "above")).alias("root"))
    named = roots.select("conv_id", F.col("root.depth").alias("root_depth"), F.concat_ws(":", "root.depth", "root.prefix").alias("shard"))
    dealt = light.join(named, "conv_id").select("shard", "root_depth", "conv_id", "depth", "length", "l1", "l2", "words")
    below = settle(dealt.repartition("shard").sortWithinPartitions("shard", "conv_id", "depth").mapInArrow(_shard_nodes, _SHARDED), "below")

    # the heavy nodes: what belongs to a conversation at a depth, summed from there down, then over a node's members
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("prefix")).agg(F.count("*").alias("n_children"))
    top = heavy.join(children, ["depth", "prefix"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    top = settle(top, "top")
    values = top.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    subtotals = below.where("parent_conv_id IS NULL").select("conv_id", "depth", F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves"))
    own = settle(values.unionByName(subtotals), "own").withColumn("back", -F.col("depth"))
    sums = running_sum(own, ["conv_id"], ["back"], "saved", "saved_below")
    sums = running_sum(sums, ["conv_id"], ["back"], "leaves", "leaves_below").select("conv_id", F.col("depth").alias("own_depth"), (F.col("saved") + F.col("saved_below")).alias("saved"), (F.col("leaves") + F.col("leaves_below")).alias("leaves"))
    sums = settle(sums, "sums")
    # at the depths above the first that is a conversation's own, all that is its own counts; from there on, what is its own from each depth down
    first = sums.groupBy("conv_id").agg(F.min(F.struct("own_depth", "saved", "leaves")).alias("all"))
    passing = upper.select("conv_id", "depth", "prefix").join(first, "conv_id").where(F.col("depth") < F.col("all.own_depth")).select("depth", "prefix", F.col("all.saved").alias("saved"), F.col("all.leaves").alias("leaves"))
    owned = upper.select("conv_id", "depth", "prefix").join(sums.withColumnRenamed("own_depth", "depth"), ["conv_id", "depth"]).select("depth", "prefix", "saved", "leaves")
    totals = passing.unionByName(owned).groupBy("depth", "prefix").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = _ends(upper.where("depth = length").select("depth", "prefix", "conv_id"))
    parents = top.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    upper_nodes = top.join(parents, ["depth", "above"], "left").join(totals, ["depth", "prefix"]).join(ends, ["depth", "prefix"], "left")
    upper_nodes = upper_nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_joined([])))).select(NODE)
    above = nodes.select(F.concat_ws(":", "depth", "prefix").alias("shard"), "depth", "above").join(parents, ["depth", "above"]).select("shard", F.col("parent_conv_id").alias("up"))
    lower = below.where("parent_conv_id IS NOT NULL").select(NODE).unionByName(below.where("parent_conv_id IS NULL").join(above, "shard").withColumn("parent_conv_id", F.col("up")).select(NODE))
    return upper_nodes.unionByName(lower)


def _ends(members: DataFrame) -> DataFrame:
    """depth, prefix, ends_sha256: the digest of the members' ids in numeric order. Tasks join the ids of ranges, so a large node's digest reads a few long texts."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depth, conv = b.column(0).to_numpy(), b.column(2).to_numpy()
            prefix = b.column(1).dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.append(True, (depth[1:] != depth[:-1]) | (prefix[1:] != prefix[:-1]))) if b.num_rows else np.zeros(0, np.int64)
            ids = list(map(str, conv.tolist()))
            joined = [",".join(ids[lo:hi]) for lo, hi in zip(starts.tolist(), [*starts.tolist()[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(starts)), b.column(1).take(pa.array(starts)), b.column(2).take(pa.array(starts)), pa.array(joined, pa.string())], ["depth", "prefix", "conv_id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, rows = None, None, []
        for b in batches:
            for depth, prefix, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if at != (depth, prefix):
                    rows += [(*at, state.hexdigest())] if at else []
                    at, state = (depth, prefix), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        rows += [(*at, state.hexdigest())] if at else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.decimal128(38, 0), pa.string()), strict=True)], ["depth", "prefix", "ends_sha256"])

    ranges = members.repartitionByRange("depth", "prefix", "conv_id").sortWithinPartitions("depth", "prefix", "conv_id").mapInArrow(texts, "depth long, prefix decimal(38,0), conv_id long, ids string")
    return ranges.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "conv_id").mapInArrow(digest, "depth long, prefix decimal(38,0), ends_sha256 string")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id of all conversations, and conv_id, place, role, text of their rebuilt turns: the first crc32(id) % 4 turns of each are those of the conversation of the next lower id divisible by 20.

    conversations: conv_id, turn, role, text and any other columns, which are left out. Turns go by turn (null first), then role and
    text; equal rows are all kept. Null roles and texts are empty; rows without a conv_id take no part.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("one"))
    placed = settle(running_sum(turns, ["conv_id"], ["turn", "role", "text"], "one", "place").select("conv_id", "place", "role", "text"), "placed")
    convs = settle(placed.select("conv_id").distinct(), "convs")
    lent = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("lender"), (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h"))
    early = placed.where("place < 3").select(F.col("conv_id").alias("lender"), "place", "role", "text")
    taken = lent.join(early, "lender").where("place < h").select("conv_id", "place", "role", "text")
    early_n = early.groupBy("lender").agg(F.count("*").alias("n"))
    shift = lent.join(early_n, "lender", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0).cast("long"))).alias("k"))
    rest = placed.join(shift, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("k")).cast("long").alias("place"), "role", "text")
    return convs, taken.unionByName(rest)
