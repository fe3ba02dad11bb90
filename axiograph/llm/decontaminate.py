"""Benchmark decontamination by winnowing.

Texts are words; of every WINDOW consecutive hashes of GRAM words the smallest (of equals the last) is kept as a
fingerprint. Two texts that share SPAN = GRAM + WINDOW - 1 consecutive words keep the same fingerprint inside of them, so
joining fingerprints finds every such span; each meeting is extended word by word to what is really shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiograph.llm.common import LOWER, chunks, grams, released, settle, signed, winnowed, without, word_hashes

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Bits of the filter that tasks look fingerprints up in before these are joined: a fixed size, whatever the benchmark's.
FILTER_BITS = 1 << 24

#: The bytes \x00-\x2F, \x3A-\x60 and \x7B-\x7F divide words; texts are lower-cased before.
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False


def _context(words: np.ndarray, first: np.ndarray, places: np.ndarray, n: int) -> tuple[list[bytes], np.ndarray]:
    """The hashes of the words that a span through the n words at each place can reach, and how many come before it."""
    row = np.searchsorted(first, places, "right")
    lo = np.maximum(first[row - 1], places - max(0, SPAN - n))
    hi = np.minimum(first[row], places + max(SPAN, n))
    return [words[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], places - lo


def _fingerprints(words: np.ndarray, first: np.ndarray, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length of the gram, places, hashes: winnowed ones of GRAM words, and all of each length of a short item."""
    yield GRAM, *winnowed(words, first, GRAM, WINDOW)
    for n in short:
        hashes, whole = grams(words, first, n)
        at = np.flatnonzero(whole)
        yield n + SPAN, at, hashes[at]


_ANCHOR = pa.struct([("n", pa.int32()), ("h", pa.int64()), ("pos", pa.int64()), ("lead", pa.int32()), ("words", pa.binary())])
_ANCHOR_SQL = "array<struct<n:int,h:long,pos:long,lead:int,words:binary>>"


def _in_filter(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (known[(hashes >> np.uint64(3)) % np.uint64(FILTER_BITS // 8)] >> (hashes & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _spanned(words: np.ndarray, first: np.ndarray, places: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether one of the windows of SPAN words around the GRAM words at each place is in the filter of items' windows."""
    hashes, whole = grams(words, first, SPAN)
    hit = np.zeros(len(words) + 1, np.int64)
    hit[1 : len(hashes) + 1] = np.cumsum(whole & _in_filter(known, hashes))
    hit[len(hashes) + 1 :] = hit[len(hashes)]
    return hit[places + 1] > hit[np.maximum(places - (SPAN - GRAM), 0)]


def _anchored(rows: DataFrame, name: str, short: list[int] | None, known: np.ndarray | None, windows: np.ndarray | None = None) -> DataFrame:
    """name, n_words, anchors for every row of (name, text).

    short None: the rows are items: one of fewer than SPAN words has its whole sequence as its only fingerprint.
    known: bits that fingerprints must have set to be kept; windows: bits of which a window of SPAN words around a
    fingerprint of GRAM words must have one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1)):
                words, first = word_hashes(LOWER[data], at, _WORD)
                sizes = np.diff(first)
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                lengths = sorted(set(sizes[(sizes > 0) & (sizes < SPAN)].tolist())) if short is None else short
                for n, places, hashes in _fingerprints(words, first, lengths):
                    rows_of = np.searchsorted(first, places, "right") - 1
                    if short is None and n > SPAN:  # only the item that is as long
                        own = sizes[rows_of] == n - SPAN
                        places, hashes, rows_of = places[own], hashes[own], rows_of[own]
                    hashes = hashes ^ np.uint64(n << 32)
                    if known is not None:
                        own = np.flatnonzero(_in_filter(known, hashes))
                        places, hashes, rows_of = places[own], hashes[own], rows_of[own]
                        if n == GRAM and len(places):
                            own = np.flatnonzero(_spanned(words, first, places, windows))
                            places, hashes, rows_of = places[own], hashes[own], rows_of[own]
                    context, lead = _context(words, first, places, n if n <= SPAN else n - SPAN)
                    for r, h, p, before, text in zip(rows_of.tolist(), signed(hashes).tolist(), (places - first[rows_of]).tolist(), lead.tolist(), context, strict=True):
                        found[r].append({"n": n, "h": h, "pos": p, "lead": before, "words": text})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(found, pa.list_(_ANCHOR))], [name, "n_words", "anchors"])

    kind = rows.schema[name].dataType.simpleString()
    return rows.select(name, "text").mapInArrow(released(scan), f"{name} {kind}, n_words long, anchors {_ANCHOR_SQL}")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The meeting, and where from its place the words that both contexts share begin and end, if an item's window lies in them."""
    for batch in batches:
        out = []
        for n, h, lead, words, item_lead, item_words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = np.frombuffer(words, np.uint64), np.frombuffer(item_words, np.uint64)
            size, need = (n, SPAN) if n <= SPAN else (n - SPAN, n - SPAN)
            back = min(lead, item_lead)
            x, y = a[lead - back :], b[item_lead - back :]
            m = min(len(x), len(y))
            bad = np.flatnonzero(x[:m] != y[:m])
            left = bad[bad < back].max() + 1 if (bad < back).any() else 0
            right = bad[bad >= back].min() if (bad >= back).any() else m
            if right - back >= size and right - left >= need:
                out.append((n, h, lead, words, item_lead, item_words, int(left) - back, int(right) - back))
        if out:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*_OURS, *_THEIRS, "from", "to"])


_OURS, _THEIRS = ["n", "h", "lead", "words"], ["item_lead", "item_words"]


def _filter_of(rows: DataFrame) -> np.ndarray:
    """Bits of the hashes h: a fixed size, FILTER_BITS, however many rows."""
    place = F.pmod(F.shiftrightunsigned("h", 3), F.lit(FILTER_BITS // 8))
    known = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.groupBy(place.alias("place")).agg(F.bit_or(F.expr("shiftleft(1, cast(h & 7L AS int))")).alias("bits")).toLocalIterator():
        known[r["place"]] = r["bits"]
    return known


def _windows(benchmark: DataFrame) -> DataFrame:
    """h: the hash of every window of SPAN words of the items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                hashes, whole = grams(*word_hashes(LOWER[data], at, _WORD), SPAN)
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[whole]))], ["h"])

    return benchmark.select("text").mapInArrow(scan, "h long")


def scan(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) for every row of docs, and (row, item, begin, end) for the word spans they share with
    items; item is the item_id as text.

    Fingerprints meet as distinct contexts of either side, so copies of a passage are compared once, and a document's
    fingerprint goes on only if a window around it may be an item's. What is really shared is then given to the rows and items.
    """
    items = settle(_anchored(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), "item", None, None).withColumn("at", F.explode("anchors")).select("item", "at.*"), "items")
    short = sorted(r["n"] - SPAN for r in items.select("n").where(F.col("n") > SPAN).distinct().collect())  # at most SPAN - 1
    known, windows = _filter_of(items), _filter_of(_windows(benchmark))
    rows = settle(_anchored(docs.select("doc_id", "text"), "doc_id", short, known, windows).withColumn("row", F.monotonically_increasing_id()), "anchored")
    ours = rows.select("row", F.explode("anchors").alias("at")).select("row", "at.*")
    theirs = items.select("item", "n", "h", F.col("lead").alias("item_lead"), F.col("words").alias("item_words"))
    met = ours.select(_OURS).distinct().join(theirs.drop("item").distinct(), ["n", "h"]).select(*_OURS, *_THEIRS)
    kinds = "n int, h long, lead int, words binary, item_lead int, item_words binary, `from` long, `to` long"
    shared = settle(met.mapInArrow(_shared, kinds), "shared")
    spans = ours.join(shared, _OURS).join(theirs.distinct(), ["n", "h", *_THEIRS])
    return rows.select("row", "doc_id", "n_words"), spans.select("row", "item", (F.col("pos") + F.col("from")).alias("begin"), (F.col("pos") + F.col("to")).alias("end")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    docs: doc_id, text; benchmark: item_id, text; other columns are left out. An item's windows are its runs of 13
    words, or all its words if it has fewer but some. A word of a document inside any occurrence of a window is hit;
    n_items: items with such windows; items_sha256: of their ids as text, sorted, joined by commas (no items: of the
    empty string). contaminated: some word is hit and 20 * n_hit >= n_words. Null and empty texts have no words. Rows
    that repeat a doc_id are judged each for itself; items that repeat an id count once. A null item_id's windows
    hit, but the item isn't counted.
    """
    rows, spans = scan(docs, benchmark)
    spans = settle(spans, "spans")
    before = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    distinct = spans.select("row", "begin", "end").distinct()
    hit = distinct.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", before))).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = spans.select("row", "item").distinct().groupBy("row").agg(F.count("item").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    found = hit.join(named, "row")
    none = F.sha2(F.lit("").cast("binary"), 256)
    out = rows.join(found, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that contamination() judges contaminated, all columns kept. Rows that repeat a doc_id go
    together if one of them is contaminated; rows without a doc_id stay."""
    bad = settle(contamination(docs, benchmark).where("contaminated and doc_id is not null").select("doc_id").distinct(), "bad")
    return without(docs, bad, "doc_id")
