"""Token counts of fields or sections: encode whole documents once and attribute tokens to sections by character spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiograph.llm.encoding import default_vocabulary, encoder

RULES = ("most", "first")


def token_counts(docs: DataFrame, sections: DataFrame | None = None, vocabulary: str | None = None, rule: str = "most") -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens, n_crossing: tokens of every section of every document.

    docs: doc_id, text. sections: doc_id, section (int), start_char, end_char (code points, end excluded); without it
    the sections are the text's lines, each with its line feed. Every document is encoded whole, once; a token's
    characters are those its bytes belong to. A token inside one section counts there. One that crosses a boundary
    counts once: rule "most" gives it to the section with most of its bytes (ties: the earlier), "first" to the one
    with its first byte. n_crossing tells how many of n_tokens crossed. Tokens in no section come as section null.

    Null and empty texts have one line of no tokens, or their given sections with none. Where sections overlap, the one
    that starts later (then the greater section number) owns the shared characters; spans are cut to the text. Rows
    with the same doc_id are counted each for itself; sections with a null doc_id or bound are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select("doc_id", "text")
    given = sections is not None
    if given:
        spans = sections.where("doc_id is not null and start_char is not null and end_char is not null").groupBy(F.col("doc_id").alias("sdoc")).agg(F.sort_array(F.collect_list(F.struct(F.col("start_char").cast("long").alias("a"), F.col("section").cast("int").alias("s"), F.col("end_char").cast("long").alias("b")))).alias("spans"))
        rows = rows.join(spans, F.col("doc_id") == F.col("sdoc"), "left").select("doc_id", "text", "spans")

    def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """row, number, first byte, byte after the last of each line; every row has one at least."""
        breaks = np.flatnonzero(data == 10) + 1
        starts = np.union1d(breaks[~np.isin(breaks, at)], at[:-1])
        starts = starts[starts < len(data)]
        rows_of = np.searchsorted(at, starts, "right") - 1
        empty = np.setdiff1d(np.arange(len(at) - 1), rows_of)
        row = np.sort(np.concatenate([rows_of, empty]), kind="stable")
        start = np.empty(len(row), np.int64)
        full = np.isin(row, empty, invert=True)
        start[full], start[~full] = starts[np.isin(rows_of, empty, invert=True)], at[empty]
        number = np.arange(len(row)) - np.searchsorted(row, row)
        end = np.append(start[1:], len(data))
        return row, number, start, end

    def listed(data: np.ndarray, at: np.ndarray, spans: list) -> tuple[np.ndarray, ...]:
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        row, number, start, end = [], [], [], []
        for i, own in enumerate(spans):
            lo, hi = np.searchsorted(chars, at[i : i + 2])
            place = np.append(chars[lo:hi], at[i + 1])
            for a, s, b in ((x["a"], x["s"], x["b"]) for x in own or ()):
                a, b = min(max(a, 0), hi - lo), min(max(b, 0), hi - lo)
                row, number = [*row, i], [*number, s]
                start, end = [*start, place[a]], [*end, place[max(a, b)]]
        return np.array(row, np.int64), np.array(number, object), np.array(start, np.int64), np.array(end, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            ids_of = batch.column(0)
            for lo, hi, data, at, ids, ids_at in e.steps(batch.column(1)):
                row, number, start, end = listed(data, at, batch.column(2).slice(lo, hi - lo).to_pylist()) if given else lines(data, at)
                n = len(row)
                owner = np.full(len(data) + 1, n, np.int64)  # n: no section
                if given:
                    for i in range(n):
                        owner[start[i] : end[i]] = i
                else:
                    owner[:-1] = np.repeat(np.arange(n), end - start)
                after = np.cumsum(e.byte_widths()[ids])
                before = after - e.byte_widths()[ids]
                mine, last = owner[before], owner[after - 1]
                crossing = mine != last
                if given:  # a section may also lie within a token
                    changes = np.concatenate([[0], np.cumsum(owner[1:-1] != owner[:-2]), [0]])
                    crossing |= changes[after - 1] != changes[before]
                hit = np.flatnonzero(crossing)
                if rule == "most":
                    for t in hit:
                        own, tally = np.unique(owner[before[t] : after[t]], return_counts=True)
                        real = own < n
                        mine[t] = own[real][np.argmax(tally[real])] if real.any() else n
                elif given:
                    for t in hit:
                        own = owner[before[t] : after[t]]
                        mine[t] = own[own < n][0] if (own < n).any() else n
                counted = np.bincount(mine, minlength=n + 1)[:n]
                crossed = np.bincount(mine[hit], minlength=n + 1)[:n]
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                out = [ids_of.take(pa.array(row + lo)), pa.array(number.tolist(), pa.int32()), pa.array(chars[start] - chars[at[row]]), pa.array(chars[end] - chars[at[row]]), pa.array(counted), pa.array(crossed)]
                if given and (outside := mine == n).any():
                    owner_row = np.searchsorted(ids_at, np.flatnonzero(outside), "right") - 1
                    some, tally = np.unique(owner_row, return_counts=True)
                    none = pa.nulls(len(some), pa.int64())
                    out = [pa.concat_arrays([a, b]) for a, b in zip(out, [ids_of.take(pa.array(some + lo)), none.cast(pa.int32()), none, none, pa.array(tally), pa.array(np.zeros(len(some), np.int64))], strict=True)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return rows.mapInArrow(count, "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long")
