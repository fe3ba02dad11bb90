"""Removal of repeated byte strings by prefix-free parsing: phrases between rolling-hash triggers, ordered with what follows them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.llm.common import attached, chunks, mixed, settle, signed

#: Bytes of a string that counts as repeated.
LENGTH = 400
#: Bytes of a trigger, and the starts of one piece of a phrase at most.
TRIGGER, PIECE = 16, 128
#: Leading zero bits of a trigger's hash. Strings without a trigger of the first kind are anchored by those of the second.
TIERS = (7, 5)
#: Pieces of one core that a task compares at a time; the starts of larger groups are dealt by their fingerprints.
GROUP = 2048
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = [np.random.default_rng(s).integers(1, 1 << 63, 256, np.uint64) for s in (11, 12)]
_powers: list[tuple[np.ndarray, np.ndarray]] = []
_PIECES = "core long, full long, weight int, doc_id long, k long, at long, n int, state int"
_SORTED = f"{_PIECES}, edge int"


class Prints:
    """64-bit fingerprints of all byte spans of data, of two kinds, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if not _powers or len(_powers[0][0]) <= n:
            _powers[:] = [tuple(_geometric(b, max(n + 1, 1 << 19)) for b in (s, pow(s, -1, 1 << 64))) for s in _SEEDS]
        self.sums = [np.zeros(n + 1, np.uint64) for _ in _SEEDS]
        for i, (up, _) in enumerate(_powers):
            np.cumsum(_TABLES[i][data] * up[:n], out=self.sums[i][1:])

    def of(self, i: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[i][ends] - self.sums[i][starts]) * _powers[i][1][starts])

    def windows(self, i: int, lo: int, hi: int, size: int) -> np.ndarray:
        """The fingerprints of data[s : s + size] for s from lo to hi - 1."""
        return mixed((self.sums[i][lo + size : hi + size] - self.sums[i][lo:hi]) * _powers[i][1][lo:hi])


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the intervals lo to hi - 1."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def parsed(data: np.ndarray, at: np.ndarray, length: int, trigger: int, piece: int, tiers: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """core, full, weight, row, start, n, state of all pieces of the rows that lie in data from `at` on.

    A phrase goes from a trigger to the end of the next one. The strings of `length` bytes that start in it and hold the next trigger are
    cut, at fixed distances before that trigger, into pieces of at most `piece` starts. Where a string lies in its piece depends on its bytes
    alone, so equal strings are in pieces with the same core: what all strings of a piece have in common, the end of the phrase and what
    follows it. full: all bytes of the piece's strings. Strings without any trigger stand for themselves, once in a row
    (weight: how often; those of over 1 are state 2, repeated, in intervals of their own).
    """
    prints, n = Prints(data), len(data)
    out = [[] for _ in range(7)]

    def add(core, full, weight, row, start, size, state):
        for o, v in zip(out, (core, full, weight, row, start, size, state), strict=True):
            o.append(np.broadcast_to(v, start.shape))

    first, last = at[:-1], at[1:] - length  # of a row: its first and last start
    if n < length:
        return tuple(np.zeros(0, np.uint64) for _ in out)
    hashes, reach = prints.windows(0, 0, n - trigger + 1, trigger), length - trigger
    todo_lo, todo_hi = first[last >= first], last[last >= first] + 1
    for tier, bits in enumerate(tiers):
        t = np.flatnonzero(hashes < np.uint64(1 << (64 - bits)))
        before = np.concatenate([[0], t[:-1]]) if len(t) else t
        k = np.searchsorted(todo_hi, before, "right")  # the first interval that isn't over where a phrase begins
        k_end = np.searchsorted(todo_lo, t, "left")
        phrase, span = np.repeat(np.arange(len(t)), np.maximum(k_end - k, 0)), _spread(k, np.maximum(k_end, k))
        near = np.maximum(np.maximum(todo_lo[span], before[phrase]), t[phrase] - reach)
        far = np.minimum(todo_hi[span], t[phrase])
        for band in range(-(-reach // piece)):
            lo, hi = np.maximum(near, t[phrase] - piece * (band + 1)), np.minimum(far, t[phrase] - piece * band)
            some = np.flatnonzero(lo < hi)
            lo, hi, anchor = lo[some], hi[some], t[phrase[some]]
            core = prints.of(0, anchor - piece * band - 1, np.maximum(anchor - piece * (band + 1) + length, anchor - piece * band))
            add(core ^ np.uint64(1 + band + 64 * tier), prints.of(1, lo, hi - 1 + length), 1, np.searchsorted(at, lo, "right") - 1, lo, hi - lo, 0)
        # what has no trigger in reach: the parts of the intervals from a trigger on to `reach` before the next
        edges_lo, edges_hi = np.concatenate([[0], t]), np.concatenate([t - reach, [n]])
        wide = np.flatnonzero(edges_lo < edges_hi)
        k = np.searchsorted(todo_hi, edges_lo[wide], "right")
        k_end = np.maximum(np.searchsorted(todo_lo, edges_hi[wide], "left"), k)
        gap, span = np.repeat(wide, k_end - k), _spread(k, k_end)
        lo, hi = np.maximum(todo_lo[span], edges_lo[gap]), np.minimum(todo_hi[span], edges_hi[gap])
        todo_lo, todo_hi = lo[lo < hi], hi[lo < hi]
    starts = _spread(todo_lo, todo_hi)
    if len(starts):
        row = np.searchsorted(at, starts, "right") - 1
        one, two = prints.of(0, starts, starts + length), prints.of(1, starts, starts + length)
        order = np.lexsort((starts, two, one, row))
        fresh = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (row[order][1:] != row[order][:-1]))
        counts = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        kept = order[fresh]
        add(one[kept], two[kept], np.minimum(counts, 2), row[kept], starts[kept], 1, 0)
        again = np.zeros(len(starts), bool)
        again[order] = np.repeat(counts > 1, counts)
        s = starts[again]
        if len(s):
            begin = np.append(True, (s[1:] != s[:-1] + 1) | (row[again][1:] != row[again][:-1]))
            lo = s[begin]
            add(np.uint64(0), np.uint64(0), 2, row[again][begin], lo, np.diff(np.append(np.flatnonzero(begin), len(s))), 2)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k, text: k stands for the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("k"), text.alias("text"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ordered(pieces: DataFrame) -> DataFrame:
    """Pieces whose core another piece has (state 1) and those whose full string another has (state 2).

    The pieces are sorted by core and full string over all tasks, a large group over many of them, and each is compared with its neighbours. Only
    the first and the last of each task's pieces are also compared across tasks.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened = None, False
        for batch in batches:
            table = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
            core, full, weight = (table.column(c).to_numpy() for c in ("core", "full", "weight"))
            # a piece waits for its successor; the held one has met its predecessor, or has none
            same_core, same_full = core[1:] == core[:-1], (core[1:] == core[:-1]) & (full[1:] == full[:-1])
            state = table.column("state").to_numpy().copy()
            for same, value in ((same_core, 1), (same_full, 2)):
                state[1:][same] = np.maximum(state[1:][same], value)
                state[:-1][same] = np.maximum(state[:-1][same], value)
            state = np.where(weight > 1, 2, state).astype(np.int32)
            edge = np.zeros(len(state), np.int32)
            if not opened and len(state):
                edge[0], opened = 1, True
            elif held is not None:
                edge[0] = held.column("edge")[0].as_py()
            table = table.drop(["state"] + (["edge"] if "edge" in table.column_names else [])).append_column("state", pa.array(state)).append_column("edge", pa.array(edge))
            whole = table.to_batches()[0] if table.num_rows else None
            if whole is None:
                continue
            held = whole.slice(len(state) - 1)
            done = whole.slice(0, len(state) - 1)
            done = done.filter(pa.array((state[:-1] > 0) | (edge[:-1] > 0)))
            if done.num_rows:
                yield done
        if held is not None:
            yield held.set_column(held.schema.get_field_index("edge"), "edge", pa.array([held.column("edge")[0].as_py() | 2], pa.int32()))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SORTED.split(", ")]
        with_edge = (pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(b.num_rows, np.int32))], [*b.schema.names, "edge"]) for b in batches if b.num_rows)
        for b in neighbours(with_edge):
            yield b.select(names)

    known = pieces.where("state = 2").withColumn("edge", F.lit(0)).withColumn("part", F.lit(-1))
    dealt = pieces.where("state = 0").repartitionByRange("core", "full", "doc_id", "k", "at").sortWithinPartitions("core", "full")
    out = settle(dealt.mapInArrow(aligned, _SORTED).withColumn("part", F.spark_partition_id()).unionByName(known), "order")
    edges = out.where("edge > 0").select("core", "full", "part").distinct()  # two rows a task at most
    cores = edges.groupBy("core").agg(F.countDistinct("part").alias("n")).where("n > 1").select("core", F.lit(1).alias("core_again"))
    fulls = edges.groupBy("core", "full").agg(F.countDistinct("part").alias("n")).where("n > 1").select("core", "full", F.lit(2).alias("full_again"))
    met = out.join(F.broadcast(cores), "core", "left").join(F.broadcast(fulls), ["core", "full"], "left")
    return met.withColumn("state", F.greatest("state", F.coalesce("core_again", F.lit(0)), F.coalesce("full_again", F.lit(0)))).where("state > 0").drop("core_again", "full_again", "edge", "part")


def repeated_starts(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, piece: int = PIECE, tiers: tuple[int, ...] = TIERS, group: int = GROUP) -> DataFrame:
    """doc_id, k, at, n: intervals of places from which `length` bytes are found at another place, too. docs: as from _keyed()."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(2)):
                core, full, weight, row, start, n, state = parsed(data, at, length, trigger, piece, tiers)
                if len(row):
                    ids = [batch.column(c).slice(lo, hi - lo).take(pa.array(row)) for c in (0, 1)]
                    columns = [signed(np.ascontiguousarray(core)), signed(np.ascontiguousarray(full)), weight.astype(np.int32), *ids, start - at[row], n.astype(np.int32), state.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in _PIECES.split(", ")])

    states = settle(ordered(settle(docs.mapInArrow(cut, _PIECES), "pieces")), "states")
    sure = states.where("state = 2").select("doc_id", "k", "at", "n")
    open_ = states.where("state = 1")
    # a piece whose strings are known to be repeated stands once for all that are alike
    shown = states.where("state = 2 AND full <> 0").groupBy("core", "full").agg(F.min(F.struct("doc_id", "k", "at", "n")).alias("one"))
    shown = shown.join(open_.select("core").distinct(), "core", "left_semi").select("core", "one.*", F.lit(2).alias("weight"))
    wanted = open_.select("core", "doc_id", "k", "at", "n", "weight").unionByName(shown)
    lists = wanted.groupBy("doc_id", "k").agg(F.collect_set(F.struct("at", "n", "core", "weight")).alias("wanted"))
    texts = docs.withColumnsRenamed({"doc_id": "doc", "k": "key"}).join(lists.hint("shuffle_hash"), _same("doc", "doc_id") & (F.col("key") == F.col("k"))).select("doc_id", "k", "text", "wanted")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, k, text, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prints = Prints(np.frombuffer(text.encode(), np.uint8))
                rows += [(p["core"], doc, k, p["at"], p["weight"], signed(prints.windows(1, p["at"], p["at"] + p["n"], length)).tobytes()) for p in pieces]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["core", "doc_id", "k", "at", "weight", "prints"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> list[tuple]:
            sizes = np.array([len(r[5]) // 8 for r in held])
            values = np.frombuffer(b"".join(r[5] for r in held), np.int64)
            _, inverse = np.unique(values, return_inverse=True)
            hit = np.bincount(inverse, np.repeat([r[4] for r in held], sizes))[inverse] > 1
            out, ends = [], np.cumsum(sizes)
            for r, lo, hi in zip(held, ends - sizes, ends, strict=True):
                if r[4] == 1 and hit[lo:hi].any():
                    steps = np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]]))
                    out += [(r[1], r[2], r[3] + int(a), int(b - a)) for a, b in zip(np.flatnonzero(steps > 0), np.flatnonzero(steps < 0), strict=True)]
            return out

        for batch in batches:
            rows: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r[0] != held[0][0]:
                    rows += found()
                    held.clear()
                held.append(r)
            if rows:
                yield _spans(rows)
        if held and (rows := found()):
            yield _spans(rows)

    shown = settle(texts.mapInArrow(windows, "core long, doc_id long, k long, at long, weight int, prints binary"), "windows")
    sizes = shown.groupBy("core").agg(F.count("*").alias("size"))
    large = settle(sizes.where(F.col("size") > group).select("core", F.lit(True).alias("large")), "large")
    marked = shown.join(large, "core", "left") if not large.isEmpty() else shown.withColumn("large", F.lit(None).cast("boolean"))
    few = marked.where("large IS NULL").drop("large").repartition("core").sortWithinPartitions("core").mapInArrow(compared, "doc_id long, k long, at long, n int")
    out = sure.unionByName(few)
    if large.isEmpty():
        return out

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([len(x) // 8 for x in b.column(5).to_pylist()], np.int64)
            of = pa.array(np.repeat(np.arange(b.num_rows), n))
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cols = [b.column(i).take(of) for i in range(5)]
            cols[3] = pa.array(cols[3].to_numpy() + place)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.frombuffer(b"".join(b.column(5).to_pylist()), np.int64))], ["core", "doc_id", "k", "at", "weight", "print"])

    each = settle(marked.where("large").drop("large").mapInArrow(single, "core long, doc_id long, k long, at long, weight int, print long").withColumn("key", F.struct("core", "print")), "starts")
    again = settle(each.groupBy("key").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).where("n > 1").select("key", "rows"), "again")
    hits = attached(each.where("weight = 1"), again, "key", "rows")
    return out.unionByName(hits.select("doc_id", "k", "at", F.lit(1).alias("n")))


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "k", "at", "n"])


def without_repeats(docs: DataFrame, length: int = LENGTH, **parse) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 of every row of docs: its UTF-8 bytes without those that a repeated string of `length` bytes covers.

    docs: doc_id, text and any other columns, which are left out. A null text is empty; texts of fewer bytes than `length` stay whole; of
    texts that are alike (rows that repeat a doc_id, too) all copies go whole if they reach `length`. No rows give none.
    Strings are the same if two 64-bit fingerprints of them are.
    """
    keyed = _keyed(docs)
    spans = repeated_starts(keyed, length, **parse)
    lists = spans.groupBy(F.col("doc_id").alias("doc"), F.col("k").alias("key")).agg(F.collect_set(F.struct("at", "n")).alias("spans"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                steps = np.zeros(len(raw) + 1, np.int64)
                if spans:
                    np.add.at(steps, [s["at"] for s in spans], 1)
                    np.add.at(steps, [s["at"] + s["n"] - 1 + length for s in spans], -1)
                gone = np.cumsum(steps)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for o, v in zip(out, (len(raw), int(gone.sum()), n_spans, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    o.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, t) for o, t in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = keyed.join(lists.hint("shuffle_hash"), _same("doc_id", "doc") & (F.col("k") == F.col("key")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
