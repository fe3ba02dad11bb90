"""Token-ID / binary output: segments of concatenated ids with Elias-Fano encoded document boundaries.

A segment is one binary body (layout in pack_segment). Bodies are rows of a Parquet table, so that any store Spark can
write to holds them and a lost or repeated task leaves no half-written file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiograph.llm.common import released
from axiograph.llm.encoding import default_vocabulary, encoder

#: A segment is closed at the first document that takes it to this many ids.
SEGMENT_IDS = 2_000_000
#: Every so many ones of the high bits have their place noted for select().
SAMPLE = 64
_MAGIC = b"IDS1"


class EliasFano:
    """A sorted sequence of n integers from 0 to u in about n * (2 + log2(u / n)) bits.

    The low bits of each value lie in a packed array; the high bits are a unary bit vector, value i being the one at
    place high + i. Places of every 64th one are kept, so select() unpacks a few bytes only.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel())
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits), ones[::SAMPLE].astype(np.uint32))

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        lo, hi = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[lo // 8 : -(-hi // 8)])[lo % 8 : lo % 8 + hi - lo]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value i, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, rank = int(self.samples[i // SAMPLE]), i // SAMPLE * SAMPLE
        byte = place // 8
        skip = place % 8
        while True:
            step = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64])[skip:]) + skip
            if rank + len(step) > i:
                return ((int(step[i - rank]) + byte * 8 - i) << self.low_bits) | int(self._lows(i, i + 1)[0])
            rank, byte, skip = rank + len(step), byte + 64, 0

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._lows(0, self.n)

    def dump(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return struct.pack("<QIQQQ", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def load(cls, raw: memoryview) -> tuple[EliasFano, memoryview]:
        head = struct.calcsize("<QIQQQ")
        n, low_bits, *sizes = struct.unpack("<QIQQQ", raw[:head])
        raw, parts = raw[head:], []
        for size in sizes:
            parts.append(raw[:size])
            raw = raw[size:]
        return cls(n, low_bits, np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u4")), raw


def pack_segment(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """Magic; id width in bytes, null doc_ids at the front, smallest doc_id, ids; Elias-Fano of doc_ids above the
    smallest; Elias-Fano of each document's end in the ids; the ids, little-endian."""
    known = np.asarray([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = struct.pack("<IQqQ", width, len(doc_ids) - len(known), least, len(ids))
    above = known.view(np.uint64) - np.int64(least).view(np.uint64) if len(known) else known.astype(np.uint64)
    return _MAGIC + head + EliasFano.of(above).dump() + EliasFano.of(ends).dump() + ids.astype(f"<u{width}").tobytes()


class Segment:
    """A segment read back: len(), doc_ids(), offsets() and the ids of document i through select()."""

    def __init__(self, body: bytes):
        raw = memoryview(body)
        if raw[:4] != _MAGIC:
            raise ValueError("not a segment of token ids")
        size = struct.calcsize("<IQqQ")
        width, self.nulls, self.least, total = struct.unpack("<IQqQ", raw[4 : 4 + size])
        self.above, raw = EliasFano.load(raw[4 + size :])
        self.ends, raw = EliasFano.load(raw)
        self.ids = np.frombuffer(raw, f"<u{width}", total)

    def __len__(self) -> int:
        return self.ends.n

    def span(self, i: int) -> tuple[int, int]:
        """Where document i's ids begin and end."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        begin, end = self.span(i)
        return self.ids[begin:end]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.above.values() + self.least).tolist()


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text, append end_id to each document and write segments in ascending doc_id order to path.

    docs: doc_id, text and any other columns, which are left out. A null or empty text is end_id alone. Null doc_ids come first; rows with the same
    doc_id lie side by side, ordered by text, and equal rows are all kept. A document longer than a segment is a
    segment of its own. No rows: no segments.
    """
    vocabulary = vocabulary or default_vocabulary()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, pieces, ends, held = [], [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, _, _, ids, at in encoder(vocabulary).steps(batch.column(1)):
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
                first = lo
                while first < hi:  # rows up to the one that fills the segment
                    room = at[first - lo] + segment_ids - held
                    last = min(hi, lo + max(first - lo + 1, int(np.searchsorted(at, room, "left"))))
                    doc_ids += names[first:last]
                    pieces.append(ids[at[first - lo] : at[last - lo]])
                    ends.append(at[first - lo + 1 : last - lo + 1] - at[first - lo] + held)
                    held += len(pieces[-1])
                    first = last
                    if held >= segment_ids:
                        yield body(part, seq, doc_ids, pieces, ends)
                        doc_ids, pieces, ends, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield body(part, seq, doc_ids, pieces, ends)

    def body(part: int, seq: int, doc_ids: list, pieces: list, ends: list) -> pa.RecordBatch:
        ids = np.concatenate(pieces)
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "body": pa.array([pack_segment(doc_ids, ids, np.concatenate(ends))], pa.binary())})

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(released(pack), "part int, seq int, n_docs long, n_ids long, body binary").write.option("compression", "zstd").parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """part, seq, base: the ids in all segments before. Totals of the parts are summed first, then those within."""
    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("inner", inner).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("base"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read from the segments,
    each document's place by select()."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = Segment(raw)
                spans = [s.span(i) for i in range(len(s))]
                at, ids = np.array(spans, np.int64).reshape(-1, 2), s.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in spans]
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(s), part, np.int32)), "seq": pa.array(np.full(len(s), seq, np.int32)), "doc_id": pa.array(s.doc_ids(), pa.int64()), "at": pa.array(at[:, 0]), "n_tokens": pa.array(at[:, 1] - at[:, 0]), "ids_crc32": pa.array(crc, pa.int64())})

    segments = spark.read.parquet(path)
    read = segments.select("part", "seq", "body").mapInArrow(unpack, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(segment_starts(segments), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids: every document's ids, each taken from its segment by select()."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                s = Segment(raw)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(s.doc_ids(), pa.int64()), "ids": pa.array([s.document(i).astype(np.int32) for i in range(len(s))], pa.list_(pa.int32()))})

    return spark.read.parquet(path).select("body").mapInArrow(unpack, "doc_id long, ids array<int>")
