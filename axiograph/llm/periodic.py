"""Periodic runs of words: Lyndon arrays over ordered alphabets, computed while matched extensions are used again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiograph.llm.common import NOT_SPACE, chunks, words_of

#: A run has at least so many words and so many periods.
LEAST, EXPONENT = 6, 4
_FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon(s: list[int]) -> tuple[list[int], list[int]]:
    """For each i the next smaller suffix after i (len(s): none; the longest Lyndon word from i ends there), and how far both agree.

    One pass from left to right. The suffixes that have no smaller one yet are a chain, smallest first; a new suffix is held against the
    chain's end and ends those that are larger. The match of two suffixes m and i that reaches furthest to the right is kept: within it every
    comparison has been made d = i - m places earlier, and what was decided inside of the match is taken over. Only comparisons
    that go beyond the match read words, from its end on, so each word is matched once: the pass is linear for any order.
    """
    n = len(s)
    after, agree, before, agree_before = [n] * n, [0] * n, [-1] * n, [0] * n
    place, d, reach = 0, 0, 0  # the match: s[place:reach] = s[place - d : reach - d]
    for i in range(1, n):
        j, known, inside = i - 1, 0, i < reach
        left, twin = reach - i, i - d
        while j >= 0:
            if inside:
                k = j - d if j >= place else j
                met = agree[k] if after[k] == twin else agree_before[twin]
                if met < left:
                    known = met
                    smaller = s[i + met] < s[j + met]
                else:
                    known, inside = left, False
            if not inside:
                while i + known < n and s[i + known] == s[j + known]:
                    known += 1
                if i + known > reach:
                    place, d, reach = i, i - j, i + known
                smaller = i + known == n or s[i + known] < s[j + known]
            if not smaller:
                break
            after[j], agree[j] = i, known
            if not inside:  # suffixes along the chain fall, so their own agreement decides most comparisons
                while before[j] >= 0 and agree_before[j] > known:
                    j = before[j]
                    after[j], agree[j] = i, known
                if before[j] >= 0 and agree_before[j] < known:
                    known = agree_before[j]
                    j = before[j]
                    break
            j = before[j]
        before[i], agree_before[i] = j, known if j >= 0 else 0
    return after, agree


def runs_of(s: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """start, length, period of every run in s, a list of numbers, of at least `least` items and `exponent` (2 or more) periods, by start and period.

    A run's smallest period is the length of a word that is a longest Lyndon word under an order of the items or under the reverse order.
    """
    found = set()
    for items in (s, [-x for x in s]):
        after, agree = (np.array(x, np.int64) for x in lyndon(items))
        at = np.arange(len(s))
        period = after - at
        # of a run's Lyndon words the first is taken: it begins less than a period after the run, so it reaches this far
        roots = np.flatnonzero((after < len(s)) & (agree + 2 * period - 1 >= np.maximum(exponent * period, least)))
        prior = roots - period[roots]
        roots = roots[~((prior >= 0) & (after[np.maximum(prior, 0)] == roots) & (agree[np.maximum(prior, 0)] >= period[roots]))]
        for i in roots.tolist():
            p, start = int(period[i]), i
            while start and i - start < p and s[start - 1] == s[start - 1 + p]:
                start -= 1
            end = i + p + int(agree[i])
            if i - start < p and end - start >= max(least, exponent * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def candidates(codes: np.ndarray, first: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """begin, end of the stretches that may hold runs. codes: the words of all rows, row r from first[r] on.

    In a run of period q every word has a like one q places away at most, so runs of periods up to 2 ** k lie in stretches of words whose
    nearest like word in the row is within 2 ** k; stretches too short for such a run are left out. A run is whole in its stretch.
    """
    n, row = len(codes), np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = row * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    gap = np.full(n, n)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    far = order[same + 1] - order[same]
    gap[order[same]] = far
    gap[order[same + 1]] = np.minimum(gap[order[same + 1]], far)
    inside, low, high, longest = np.zeros(n + 1, np.int8), 1, 1, int(np.diff(first).max())
    starts_row = np.zeros(n + 1, bool)
    starts_row[first] = True
    marks = np.zeros(n + 1, np.int64)
    while max(least, exponent * low) <= longest:
        near = gap <= high
        inside[:n] = near
        turns = np.flatnonzero((inside[1:] != inside[:-1]) | starts_row[1:]) + 1
        edges = np.concatenate([[0], turns])
        size = np.diff(np.append(edges, n)) if edges[-1] < n else np.diff(edges)
        edges = edges[: len(size)]
        kept = near[np.minimum(edges, n - 1)] & (size >= max(least, exponent * low))
        marks[edges[kept]] += 1
        marks[edges[kept] + size[kept]] -= 1
        low, high = high + 1, 2 * high
    depth = np.cumsum(marks)[:n] > 0
    begin = np.flatnonzero(depth & (np.append(True, ~depth[:-1]) | starts_row[:n]))
    end = np.flatnonzero(depth & (np.append(~depth[1:], True) | starts_row[1:])) + 1
    return begin, end


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period), collapsed (the words without those that any run
    contains after its first period, one space between).

    docs: doc_id, text and any other columns, which are left out. A null text has no words; rows that repeat are each judged for themselves; no
    rows give none. A document is one task's, as a run may be as long as its text.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1)):
                starts, ends, row = words_of(data, at, NOT_SPACE)
                first, size = np.searchsorted(row, np.arange(hi - lo + 1)), ends - starts
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[NOT_SPACE[data]]))])
                codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(size) else np.zeros(0, np.int64)
                runs, gone = [[] for _ in range(hi - lo)], np.zeros(len(codes) + 1, np.int64)
                for begin, end in zip(*(x.tolist() for x in candidates(codes, first, least, exponent)), strict=True):
                    r = int(row[begin])
                    for start, length, period in runs_of(codes[begin:end].tolist(), least, exponent):
                        runs[r].append((begin - int(first[r]) + start, length, period))
                        gone[begin + start + period] += 1
                        gone[begin + start + length] -= 1
                kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                took = size[kept] + 1
                to = np.concatenate([[0], np.cumsum(took)])
                out = np.full(int(to[-1]), 32, np.uint8)
                n = size[kept]
                shift = np.repeat(to[:-1], n) - np.repeat(np.cumsum(n) - n, n)
                out[np.arange(int(n.sum())) + shift] = data[np.repeat(starts[kept] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                cut = to[np.searchsorted(kept, first)]
                texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                listed = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), listed, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, _FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, where each tenth document by crc32 of its id repeats a part of itself from one word on to its end. Documents without an id and
    texts without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    a = F.col("g") % F.col("n")
    p = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))
    some = some.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("w", at(i).cast("int"))), " ")
    return some.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: the first, then the smaller period) with exponent_milli, and the digests of runs and collapsed text."""
    best = F.element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] > y["length"], -1).when(x["length"] < y["length"], 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
