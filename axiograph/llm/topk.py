"""Exact top-k inner products with block-max pruning.

Vectors are quantised and laid out in ranges of ids: a segment is a run of blocks, a block keeps the largest and the
smallest value of every term (component) beside its forward index (the vectors). For a query, the sum over terms of
the larger of q * max and q * min bounds every score of a block. Blocks are scored in the order of their bounds until these
fall below the k-th best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiograph.llm.common import settle

K = 10
SCALE = 1024
BLOCK = 256
SEGMENT_BLOCKS = 16
QUERIES = 1024
_EXACT = float(1 << 53)
_FAR = 10**37
_MOST = np.finfo(np.float64).max
_LONG = (1 << 63) - 1
_LAYOUT = "part int, seq int, n int, width int, ids binary, vectors binary, high binary, low binary, top double"
#: Segments whose bounds one row carries, and segments of the highest bounds that a block of queries meets before its floors rise.
CHUNK = 64
WAVE = 8


def _quantised(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part, and their vectors of floor(1024 * x); rows with a null or non-finite component don't."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    values = column.values
    bad = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else np.zeros(len(values), bool)
    x = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    bad = bad | ~np.isfinite(x)
    with np.errstate(over="ignore"):  # a product beyond the range of doubles counts as the largest double
        q = np.clip(np.floor(x * SCALE), -_MOST, _MOST)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    good = (wrong[offsets[1:]] == wrong[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    return good, [q[a:b] for a, b in zip(offsets[:-1][good].tolist(), offsets[1:][good].tolist(), strict=True)]


def _laid_out(rows: DataFrame, size: int, block: int) -> DataFrame:
    """Segments of up to size vectors in vec_id order, padded with zeros to the longest of the segment; high, low: the
    largest and smallest value of every term in each block; top: the largest absolute value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def body() -> pa.RecordBatch:
            width = max(map(len, vectors))
            table = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                table[i, : len(v)] = v
            starts = range(0, len(table), block)
            high, low = (np.array([f(table[s : s + block], 0) for s in starts]) for f in (np.max, np.min))
            numbers = [pa.array([x], pa.int32()) for x in (part, seq, len(ids), width)]
            bodies = [pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int64), table, high, low)]
            return pa.RecordBatch.from_arrays([*numbers, *bodies, pa.array([np.abs(table).max(initial=0)])], [x.split()[0] for x in _LAYOUT.split(", ")])

        for batch in batches:
            good, found = _quantised(batch.column(1))
            for i, v in zip(np.asarray(batch.column(0))[good].tolist(), found, strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield body()
                    seq, ids, vectors = seq + 1, [], []
        if ids:
            yield body()

    dealt = rows.where("vec_id is not null").select("vec_id", "embedding").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    return dealt.mapInArrow(pack, _LAYOUT)


def _vectors(ids: bytes, vectors: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(n, width)


def _merged(k: int, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each who: highest score first, ties to smaller ids."""
    order = np.lexsort((ids, -score, who)) if score.dtype != object else np.array(sorted(range(len(who)), key=lambda i: (who[i], -score[i], ids[i])), np.int64)
    who, score, ids = who[order], score[order], ids[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    best = rank < k
    return who[best], score[best], ids[best]


def search_block(queries: tuple[np.ndarray, np.ndarray], segment: tuple[np.ndarray, np.ndarray], floor: np.ndarray, k: int, block: int) -> tuple[np.ndarray, ...]:
    """query number, score and id of each query's k best in the segment that reach its floor; queries and segment: ids, vectors.

    Blocks are visited by rank of bound: first every query's best block, then its second, and so on; a query whose next
    bound is below its k-th score is done.
    """
    (q_ids, q), (ids, v) = queries, segment
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
    if width * (np.abs(q).max(initial=0) * np.abs(v).max(initial=0)) >= _EXACT:  # doubles would round: whole numbers of any size
        q, v = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (q, v))
    starts = np.arange(0, len(ids), block)
    high = np.array([v[s : s + block].max(0) for s in starts]).reshape(len(starts), width)
    low = np.array([v[s : s + block].min(0) for s in starts]).reshape(len(starts), width)
    bound = q.clip(0) @ high.T + q.clip(None, 0) @ low.T if q.dtype != object else np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    floor = floor.copy()
    who, score, found = np.zeros(0, np.int64), np.zeros(0, q.dtype), np.zeros(0, np.int64)
    for rank in range(len(starts)):
        at = order[:, rank]
        active = np.flatnonzero(bound[np.arange(len(q)), at] >= floor)
        if not len(active):
            break
        parts = [(who, score, found)]
        for b in np.unique(at[active]):
            some = active[at[active] == b]
            own = slice(starts[b], starts[b] + block)
            s = q[some] @ v[own].T
            i, j = np.nonzero((s >= floor[some, None]) & (q_ids[some, None] != ids[own][None, :]))
            parts.append((some[i], s[i, j], ids[own][j]))
        who, score, found = _merged(k, *(np.concatenate(x) for x in zip(*parts, strict=True)))
        full = np.flatnonzero(np.bincount(who, minlength=len(q)) == k)
        last = np.searchsorted(who, full, "right") - 1
        floor[full] = np.maximum(floor[full], score[last] if q.dtype != object else [np.nextafter(float(max(-_FAR, min(_FAR, x))), -np.inf) for x in score[last]])
    return who, score, found


def _floors(found: DataFrame, k: int) -> DataFrame:
    """q, floors: the k-th best score so far of every query of a block that has k; no more than a block has queries."""
    order = Window.partitionBy("q", "who").orderBy(F.desc(F.expr(_SCORE)), "vec_id")
    least = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    return least.groupBy("q").agg(F.collect_list(F.struct("who", F.col("score").alias("least"))).alias("floors"))


def _floor(floors: list[dict] | None, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    for x in floors or ():
        least = int(x["least"])
        out[x["who"]] = least if abs(least) < _EXACT else np.nextafter(float(least), -np.inf)
    return out


_SCORE = "CAST(score AS decimal(38,0))"
_FOUND = "q int, who int, query_id long, vec_id long, score string"


def alive(asked: DataFrame, chunks: DataFrame, n_chunks: int, floors: DataFrame, block: int) -> DataFrame:
    """q, number, margin: the segments in which some query of a block has a block of vectors whose bound reaches its floor;
    margin: by how much at most. Only the bounds of segments are read here, not their vectors."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_no, n, width, top = (batch.column(c)[i].as_py() for c in ("q", "qn", "qw", "qtop"))
                q = np.frombuffer(batch.column("qv")[i].as_buffer()).reshape(n, width)
                floor, numbers, margins = _floor(batch.column("floors")[i].as_py(), n), [], []
                for s in batch.column("segments")[i]:
                    w = s["width"].as_py()
                    high, low = (np.frombuffer(s[c].as_buffer()).reshape(-1, w) for c in ("high", "low"))
                    common = min(w, width)
                    if max(w, width) * top * s["top"].as_py() >= _EXACT:
                        margin = np.inf  # doubles would round: no pair is dropped by its bound
                    else:
                        own = q[:, :common]
                        margin = ((own.clip(0) @ high[:, :common].T + own.clip(None, 0) @ low[:, :common].T).max(1) - floor).max()
                    if margin >= 0:
                        numbers.append(s["number"].as_py())
                        margins.append(margin)
                yield pa.RecordBatch.from_arrays([pa.array([q_no] * len(numbers), pa.int32()), pa.array(numbers, pa.int64()), pa.array(margins, pa.float64())], ["q", "number", "margin"])

    pairs = asked.join(floors, "q", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_chunks - 1)).cast("long")))).join(chunks, "chunk")
    return pairs.select("q", "qn", "qw", "qtop", "qv", "floors", "segments").mapInArrow(bound, "q int, number long, margin double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, segment_blocks: int = SEGMENT_BLOCKS, query_rows: int = QUERIES, wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of queries the k rows of vectors with the highest inner product.

    Both tables: vec_id, embedding; other columns are left out. Components count as floor(1024 * x). A query's own vec_id is no candidate; ties go
    to the smaller vec_id; with fewer than k candidates all are returned. Rows without a vec_id, with a null vector or
    a null or non-finite component take no part; finite ones always do (beyond 1.7e305 they count as the largest double). Vectors of different lengths are padded with zeros (an
    empty vector scores 0). Rows that repeat a vec_id are candidates each for itself; of the valid queries that repeat one, the
    smallest vector (component by component) is asked. Scores beyond a long are cut to its range after ranking (those beyond 10 ** 37 before).

    A block of queries first meets the segment at the same place of the id order, its home: the k-th scores there are
    floors. Then the bounds of all segments, a small table, are held against the floors, and only segments with a block
    whose bound reaches one are sent to the queries: first the `wave` with the highest bounds of all, which raise the floors, then what still
    reaches them. A task holds a few pairs of a query block and a segment at a time, by Arrow's limit of bytes for a batch.
    """
    held = settle(_laid_out(vectors, block * segment_blocks, block), "segments")
    valid = queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    once = valid.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = settle(_laid_out(once, query_rows, query_rows), "queries")

    def numbered(rows: DataFrame) -> DataFrame:  # one row for each task that wrote segments
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = rows.groupBy("part").agg(F.count("*").alias("n_")).select("part", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("base_"))
        return rows.join(F.broadcast(base), "part").withColumn("number", (F.col("base_") + F.col("seq")).cast("long"))

    segments, blocks = held.count(), max(1, asked.count())
    held = numbered(held)
    asked = numbered(asked).select(F.col("number").cast("int").alias("q"), F.col("n").alias("qn"), F.col("width").alias("qw"), F.col("top").alias("qtop"), F.col("ids").alias("qids"), F.col("vectors").alias("qv"))
    bodies = held.select("number", "n", "width", "ids", "vectors")
    bounds = held.select(F.floor(F.col("number") / CHUNK).alias("chunk"), F.struct("number", "width", "high", "low", "top").alias("segment"))
    chunks = bounds.groupBy("chunk").agg(F.collect_list("segment").alias("segments"))  # CHUNK at most
    n_chunks = -(-segments // CHUNK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_no, qn, qw, n, width = (batch.column(c)[i].as_py() for c in ("q", "qn", "qw", "n", "width"))
                body = lambda c: batch.column(c)[i].as_buffer()  # noqa: E731, B023
                q = _vectors(body("qids"), body("qv"), qn, qw)
                who, score, ids = search_block(q, _vectors(body("ids"), body("vectors"), n, width), _floor(batch.column("floors")[i].as_py(), qn), k, block)
                found = [pa.array(np.full(len(who), q_no, np.int32)), pa.array(who.astype(np.int32)), pa.array(q[0][who]), pa.array(ids.astype(np.int64)), pa.array([str(max(-_FAR, min(_FAR, int(s)))) for s in score], pa.string())]
                yield pa.RecordBatch.from_arrays(found, ["q", "who", "query_id", "vec_id", "score"])

    def searched(pairs: DataFrame, floors: DataFrame) -> DataFrame:
        met = pairs.select("q", "number").join(asked.join(floors, "q", "left"), "q").join(bodies, "number")
        return settle(met.select("q", "qn", "qw", "qids", "qv", "floors", "n", "width", "ids", "vectors").mapInArrow(search, _FOUND), "found")

    none = vectors.sparkSession.createDataFrame([], "q int, floors array<struct<who:int,least:string>>")
    home = asked.select("q", F.floor(F.col("q") * segments / blocks).cast("long").alias("number"))
    found = searched(home, none)
    floors = settle(_floors(found, k), "floors")
    order = Window.partitionBy("q").orderBy(F.desc("margin"), "number")
    first = settle(alive(asked, chunks, n_chunks, floors, block).join(home, ["q", "number"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wave), "pairs")
    found = found.unionByName(searched(first, floors))
    floors = settle(_floors(found, k), "floors")
    rest = alive(asked, chunks, n_chunks, floors, block).join(home.unionByName(first.select("q", "number")), ["q", "number"], "left_anti")
    found = found.unionByName(searched(settle(rest, "pairs"), floors))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.expr(_SCORE)), "vec_id"))).where(F.col("rank") <= k)
    score = F.greatest(F.least(F.expr(_SCORE), F.lit(_LONG).cast("decimal(38,0)")), F.lit(-_LONG - 1).cast("decimal(38,0)")).cast("long")
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
