"""SimHash near-duplicates over an inverted index of positional bytes with count filtering.

A fingerprint is a row of bytes; the index posts it under sets of positions and the bytes it has there. Of two fingerprints that meet
the shared positional bytes are tallied; a pair below the guaranteed minimum goes, the others are verified by their
differing bits. At most 3 of 64 bits differ in at most 3 of 8 bytes, so the minimum is 5, and such a pair meets in 5 of the 70 sets
of 4 bytes. (Postings of single bytes would each hold 1/256 of all fingerprints, and reading those takes time in
the square of the input.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.llm import similar
from axiograph.llm.common import LOWER, NOT_SPACE, attached, chunks, column_bytes, components, grams, mixed, released, settle, signed, span_hashes, without, word_hashes

BITS = 3
SHINGLE = 3
SEED = 42
#: Bytes of a set, and fingerprints of a posting whose pairs are all tallied; those of larger postings are verified in place.
WIDTH = 4
DENSE = 32
#: Nodes of a posting that one task holds to narrow it, at most; larger ones are divided as they are.
WHOLE = 1 << 16
#: For documents similar at 0.8 or more: words of a shingle, bits of a fingerprint, bits that may differ (the angle of a cosine of
#: 0.889, which sets of shingles with a Jaccard similarity of 0.8 have, is 39 of 256 bits; 3 more allow for chance).
NEAR_SHINGLE = 5
NEAR_WORDS = 4
NEAR_BITS = 42
#: Distances between the three positions of the sets that index those, from each position on (two sets share one at most).
_STEPS = [(1, 4), (2, 7), (6, 15)]


def fingerprint(text: bytes) -> int:
    """64 bits of lower-cased UTF-8: a bit is 1 if it is set in over half of the shingles' XXH64 hashes."""
    words = text.split()  # of bytes: at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, total, left = xxhash.xxh64_digest, np.zeros(64, np.int64), zip(words, words[1:], words[2:], strict=False)
    n = len(words) - SHINGLE + 1
    hashes = np.frombuffer(b"".join([digest(b" ".join(s), SEED) for s in left]), np.uint8).reshape(n, 8)
    for lo in range(0, n, 1 << 14):  # whole texts, in steps of bounded memory
        total += np.unpackbits(hashes[lo : lo + (1 << 14)], axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for every row; null text: no words, fp 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column(1))
            raw = LOWER[data].tobytes()
            fps = np.fromiter((fingerprint(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.uint64, len(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(fps))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(hashed, "doc_id long, fp long")


def wide_fingerprints(docs: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """doc_id, f0 to f3: the 256 bits of every row's SimHash over shingles of 5 words, as signed longs; a text of fewer words is one shingle,
    one without words has 0."""
    salts = np.arange(1, NEAR_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def bits(hashes: np.ndarray) -> np.ndarray:
        return np.unpackbits(mixed(hashes[:, None] + salts[None]).view(np.uint8), axis=1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1)):
                words, first = word_hashes(LOWER[data], at, NOT_SPACE)
                hashes, _ = grams(words, first, shingle)
                out = np.zeros((hi - lo, 8 * NEAR_WORDS), np.uint8)
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b > a:
                        own = hashes[a : b - shingle + 1] if b - a >= shingle else span_hashes(words[a:b], np.zeros(1, np.int64), np.array([b - a]))
                        total = np.zeros(64 * NEAR_WORDS, np.int64)
                        for k in range(0, len(own), 255):  # sums of a byte, in steps of bounded memory
                            total += np.add.reduce(bits(own[k : k + 255]), axis=0, dtype=np.uint8)
                        out[i] = np.packbits(2 * total > len(own))
                longs = np.ascontiguousarray(out).view(">u8").astype(np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(signed(np.ascontiguousarray(c))) for c in longs.T)], ["doc_id", *_longs(NEAR_WORDS)])

    return docs.select("doc_id", "text").mapInArrow(released(hashed), "doc_id long, " + ", ".join(f"{c} long" for c in _longs(NEAR_WORDS)))


def _longs(words: int) -> list[str]:
    return [f"f{i}" for i in range(words)]


def _sets(words: int) -> list[tuple[int, ...]]:
    """The sets of positions that are posted: all of WIDTH of 8 bytes; of longer fingerprints, some of three."""
    if words == 1:
        return list(combinations(range(8), WIDTH))
    n = 8 * words
    return [(i, (i + a) % n, (i + b) % n) for a, b in _STEPS for i in range(n)]


def _further(s: tuple[int, ...], words: int) -> list[int]:
    """The positions by which a large posting is divided. Of 8 bytes these are all others, and one more is shared by every pair in
    reach; of longer ones 8, one of which pairs in reach share but for a few in a thousand."""
    return [p for p in range(8 * words) if p not in s] if words == 1 else [(s[0] + d) % (8 * words) for d in (3, 9, 12, 14, 19, 22, 25, 28) if (s[0] + d) % (8 * words) not in s]


def _bytes_of(columns: list[pa.Array]) -> np.ndarray:
    longs = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1)
    return np.ascontiguousarray(longs.astype(">i8")).view(np.uint8).reshape(len(longs), -1)


def _value(data: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(data), np.int64)
    for p in positions:
        out = out << 8 | data[:, p]
    return out


def _components_of(fps: np.ndarray, nodes: np.ndarray, bits: int, most: int | None = None, rest: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is within reach among some fingerprints: each is held against those that no link has reached yet, so a
    dense group costs little more than its size. After `most` comparisons for each of them it ends; rest gets the places of those that
    have not met all others yet, but for what links join already."""
    left, work = np.arange(len(nodes)), 0
    while len(left):
        front, left = [left[:1]], left[1:]
        while front and len(left):  # breadth first, one point at a time
            if most is not None and work > most * len(nodes):
                rest.append(np.sort(np.concatenate([left, *front])))
                return
            now = front[0][0]
            front = ([front[0][1:]] if len(front[0]) > 1 else []) + front[1:]
            work += len(left)
            close = np.bitwise_count(fps[left] ^ fps[now]).sum(1) <= bits
            if close.any():
                yield np.full(int(close.sum()), nodes[now]), nodes[left[close]]
                front.append(left[close])
                left = left[~close]


def _met(bits: int, words: int, minimum: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows k, node in that order, the postings of two nodes or more.

    Where a node is its fingerprint, all pairs of a posting of up to DENSE nodes are looked at: a pair's tally is the number of positional
    bytes it shares; pairs with `minimum` and at most `bits` different bits become links a, b, each in the first of its common
    sets only. Of other postings, and of the task's first and last, which may go on elsewhere, the nodes (a) come with their key k;
    large: over DENSE of them. None is held but one posting's.
    """
    sets = _sets(words)
    # for each pattern of shared bytes (the first byte has the highest bit) the first set that lies in it
    first_set = np.array([next((i for i, s in enumerate(sets) if all(m >> 7 - p & 1 for p in s)), -1) for m in range(256)]) if words == 1 else None

    def out(a: np.ndarray, b: np.ndarray | None, k: np.ndarray | None = None, large: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if k is None else pa.array(k), pa.nulls(len(a), pa.bool_()) if large is None else pa.array(large)], ["a", "b", "k", "large"])

    def pairs(k: np.ndarray, nodes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for step in range(1, int(sizes.max(initial=1))):  # all nodes with the one `step` places on in their posting
            n = np.maximum(sizes - step, 0)
            at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            apart = nodes[at] ^ nodes[at + step]
            same = np.packbits(apart.astype(">i8").view(np.uint8).reshape(-1, 8) == 0, axis=1).ravel()
            link = (np.bitwise_count(same) >= minimum) & (np.bitwise_count(apart.view(np.uint64)) <= bits) & (first_set[same] == k[at] >> 40)
            yield out(nodes[at[link]], nodes[at[link] + step])

    def whole(k: np.ndarray, nodes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        several = sizes > 1
        small = several & (sizes <= DENSE)
        if words == 1:
            yield from pairs(k, nodes, starts[small], sizes[small])
            several = sizes > DENSE
        rows = np.flatnonzero(np.repeat(several, sizes))
        if len(rows):
            at = rows + starts[0]
            yield out(nodes[at], None, k[at], np.repeat(sizes > DENSE, sizes)[rows])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, node, first, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), True, None
        for batch in batches:
            k, node = (np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip((k, node), batch.columns, strict=True))
            if not len(k):
                continue
            starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
            begin = 0
            if first or k[0] == open_:  # the task's first posting, or one that is large already
                n = int(starts[1])
                yield out(node[:n], None, k[:n], np.full(n, True))
                open_, begin = k[0], 1
                first = False
            last = len(starts) - 2
            if last >= begin:
                yield from whole(k, node, starts[begin:last], np.diff(starts[begin : last + 1]))
                k, node = k[starts[last] :], node[starts[last] :]
                if len(k) > DENSE:
                    yield out(node, None, k, np.full(len(k), True))
                    open_, k, node = k[0], k[:0], node[:0]
            else:
                k, node = k[:0], node[:0]
        if len(k):
            yield out(node, None, k, np.full(len(k), True))

    return met


def links(nodes: DataFrame, bits: int, words: int = 1, minimum: int = 1) -> DataFrame:
    """a, b: links between nodes (node, f0, ...: distinct fingerprints) at most `bits` apart, enough of them to join every component that
    the index finds; with one word and 3 bits that is every one.

    Postings are dealt by ranges of (key, node), so a hot one spreads over tasks. What a small one joins is found in it; the nodes of
    a large one meet again under its key and one more byte. Of longer fingerprints this is for the nodes of a large posting that some
    DENSE comparisons a node have not told from all others.
    """
    longs, sets = _longs(words), _sets(words)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _bytes_of(batch.columns[1:])
            for s, positions in enumerate(sets):
                yield pa.RecordBatch.from_arrays([pa.array(_value(data, positions) | s << 40), batch.column(0)], ["k", "node"])

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, data = batch.column(0).to_numpy(), _bytes_of(batch.columns[2:])
            for s in np.unique(k >> 40):
                own = np.flatnonzero(k >> 40 == s)
                rows = batch.take(pa.array(own))
                for p in _further(sets[s], words):
                    positions = tuple(sorted((*sets[s], p)))
                    # the set's own number: one bit for each position of 8, or (set, position) behind the numbers of the sets
                    name = sum(1 << x for x in positions) if words == 1 else int(s) + 1 << 8 | p
                    yield pa.RecordBatch.from_arrays([pa.array(_value(data[own], positions) | name << 40), *rows.columns[1:]], ["k", "node", *longs])

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of large postings, links that DENSE comparisons a node find, and the nodes that have not met all others by then. Postings of over WHOLE
        nodes pass as they are."""

        def of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.concatenate([[0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1, [rows.shape[1]]]) if rows.shape[1] else np.zeros(1, np.int64)
            found, left = [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if hi - lo > 1:
                    rest: list[np.ndarray] = []
                    found += _components_of(np.ascontiguousarray(rows[2:, lo:hi].T).view(np.uint64), rows[1, lo:hi], bits, DENSE, rest)
                    left += [lo + r for r in rest]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), pa.int64())] * (2 + words)], ["a", "b", "k", "node", *longs])
            if left:
                yield passed(rows[:, np.concatenate(left)])

        def passed(rows: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(rows.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *(pa.array(np.ascontiguousarray(c)) for c in rows)], ["a", "b", "k", "node", *longs])

        held, passing = np.zeros((2 + words, 0), np.int64), None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            on = int((rows[0] == passing).sum()) if passing is not None else 0
            if on:
                yield passed(rows[:, :on])
            rows = np.concatenate([held, rows[:, on:]], 1)
            if rows.shape[1]:
                last, passing = int(np.searchsorted(rows[0], rows[0, -1])), None
                yield from of(rows[:, :last])
                held = rows[:, last:]
                if held.shape[1] > WHOLE:
                    yield passed(held)
                    held, passing = held[:, :0], held[0, 0]
        yield from of(held)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(parts, 1)
            starts = np.concatenate([[0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1, [rows.shape[1]]])
            found = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if hi - lo > 1:
                    found += _components_of(np.ascontiguousarray(rows[2:, lo:hi].T).view(np.uint64), rows[1, lo:hi], bits)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            cut = np.flatnonzero(rows[0, 1:] != rows[0, :-1])
            fresh = bool(held) and rows.shape[1] > 0 and rows[0, 0] != held[-1][0, -1]
            at = int(cut[-1]) + 1 if len(cut) else 0
            if fresh:
                yield from linked(held)
                held = []
            if at:
                yield from linked([*held, rows[:, :at]])
                held = []
            if rows.shape[1] > at:
                held.append(rows[:, at:])
        if held:
            yield from linked(held)

    index = nodes.select("node", *longs).mapInArrow(post, "k long, node long")
    dealt = index.repartitionByRange("k", "node").sortWithinPartitions("k", "node")
    met = settle(dealt.mapInArrow(_met(bits, words, minimum), "a long, b long, k long, large boolean"), "met")
    again = met.where("k IS NOT NULL").select("k", F.col("a").alias("node"), "large")
    again = again.withColumn("f0", F.col("node")) if words == 1 else again.join(nodes.select("node", *longs), "node")
    again = again.select("k", "node", *longs, "large")
    fields = ", ".join(f"{c} long" for c in longs)
    kinds, large, direct = f"k long, node long, {fields}", again.where("large").drop("large"), met.where("k IS NULL").select("a", "b")
    if words > 1:  # near copies have many sets in common: most of their postings end here
        ahead = settle(large.repartition("k").sortWithinPartitions("k", "node").mapInArrow(narrowed, f"a long, b long, {kinds}"), "narrowed")
        direct, large = direct.unionByName(ahead.where("k IS NULL").select("a", "b")), ahead.where("k IS NOT NULL").select("k", "node", *longs)
    parted = large.mapInArrow(divide, kinds).distinct()
    groups = parted if words == 1 else parted.unionByName(again.where("NOT large").drop("large"))
    return direct.unionByName(groups.repartition("k").sortWithinPartitions("k", "node").mapInArrow(verify, "a long, b long"))


def _labelled(rows: DataFrame, distinct: DataFrame, linked: DataFrame, longs: list[str]) -> DataFrame:
    """rows (doc_id, longs) with component_id, the smallest doc_id of what links (a, b) join; distinct: longs, node, first (the smallest doc_id), n (rows)."""
    linked = settle(components(linked), "components")
    labels = distinct.join(linked.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select(*longs, "n", "first", F.coalesce("root", "node").alias("root"))
    labels = settle(labels, "labels")
    smallest = labels.groupBy("root").agg(F.min("first").alias("component_id"))
    named = settle(labels.join(smallest, "root").select(F.struct(*longs).alias("fp"), "component_id", "n"), "named")
    return attached(rows.withColumn("fp", F.struct(*longs)), named, "fp", "n").drop("fp")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach, for every row.

    docs: doc_id, text and any other columns, which are left out. Words lie between white space, A-Z in lower case;
    shingles of 3 words count with repeats; a text of one or two words is one shingle; null and empty texts have
    fingerprint 0 and link like any other. Repeated doc_ids are fingerprinted each for itself. A null doc_id takes no part in the minimum: its component
    is null only if no row of the component has a doc_id. Equal fingerprints are one node of the search, so copies
    cost a row each and no pair. bits: 3 at most, for which the index misses no pair.
    """
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be from 0 to {BITS}")
    rows = settle(fingerprints(docs).withColumnRenamed("fp", "f0"), "fingerprints")
    distinct = settle(rows.groupBy("f0").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).withColumn("node", F.col("f0")), "distinct")
    return _labelled(rows, distinct, links(distinct, bits, 1, 8 - bits), ["f0"]).select("doc_id", _hex("f0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id for every row of docs (doc_id, text): texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more are linked, all of them and no others, as the sets themselves are compared. Nulls, empty texts and repeats as in near_duplicates()."""
    rows = settle(similar.described(docs), "described")
    sets = settle(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("low").alias("low")), "sets")
    linked = similar.links(docs, sets)
    return _labelled(rows.select("doc_id", "node"), sets.select("node", "first", F.col("rows").alias("n")), linked, ["node"]).select("doc_id", "component_id")


def _hex(c: str) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near_copies(), all columns kept; rows without a doc_id go only
    if their component has one. Rows that repeat a kept doc_id stay together with it."""
    names = settle(near_copies(docs), "names")
    gone = settle(names.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    unnamed = names.where("doc_id is null and component_id is not null").limit(1)
    kept = without(docs, gone, "doc_id")
    return kept.where("doc_id is not null") if unnamed.count() else kept
