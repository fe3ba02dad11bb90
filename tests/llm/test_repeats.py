"""Repeated byte strings against a count of all strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from axiograph.llm import repeats
from axiograph.llm.queries import op11_prefix_free_repeats


def plain(rows: list[tuple], length: int) -> list[tuple]:
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if counts[b[s : s + length]] > 1:
                gone[s : s + length] = True
        n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), n_spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows: list[tuple], **parse) -> list[tuple]:
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, core long")
    return sorted(map(tuple, repeats.without_repeats(docs, **parse).drop("kept").collect()), key=str)


def corpus(seed: int) -> list[tuple]:
    """Prose of few words, passages of many lengths set at many places, edited copies, runs of one byte and of short periods, nulls, repeated rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [prose(r.randint(3, 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        kind, text = r.random(), prose(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            lo = r.randint(0, len(p) // 2)
            text += p[lo : r.randint(lo, len(p))] + prose(r.randint(0, 9))
        if kind < 0.1 and rows and rows[-1][1]:
            text = rows[-1][1]
        elif kind < 0.2:
            text += "-" * r.randint(1, 300) + prose(5)
        elif kind < 0.3:
            text += "=+*" * r.randint(1, 90)
        rows.append((None if kind > 0.97 else i, None if kind > 0.95 else text))
    return rows + rows[3:6] + [(900, ""), (901, "x" * 39), (902, "x" * 40), (902, "x" * 40)]


@pytest.mark.parametrize("group", [2048, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_count_of_all_strings(spark, seed, group):
    rows = corpus(seed)
    expected = plain(rows, 40)
    assert sum(x[2] for x in expected) > 2000
    assert found(spark, rows, length=40, trigger=4, piece=13, tiers=(5, 2), group=group) == expected


def test_production_parameters(spark):
    r = random.Random(5)
    prose = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared = [prose(n) for n in (399, 400, 401, 520, 1500)]
    rows = [(i, prose(r.randint(0, 900)) + shared[i % 5] + prose(r.randint(0, 500))) for i in range(30)]
    rows += [(100, "z" * 2000), (101, "zy" * 450), (102, prose(90_000) + shared[3]), (103, None)]
    assert found(spark, rows) == plain(rows, 400)


def test_pieces_of_equal_strings_have_one_core():
    r = random.Random(3)
    text = "".join(r.choice("ab") for _ in range(5000))
    twice = np.frombuffer((text[:300] + text[1000:2500] + text[:77] + text[1000:2500]).encode(), np.uint8)
    core, full, weight, row, start, n, state = repeats.parsed(twice, np.array([0, len(twice)]), 100, 8, 32, (4, 2))
    covered = np.concatenate([np.arange(a, a + b) for a, b, s in zip(start, n, state, strict=True) if s == 0])
    assert sorted(covered) == list(range(len(twice) - 99))
    of = {int(x): int(c) for a, b, c in zip(start, n, core, strict=True) for x in range(a, a + b)}
    assert all(of[300 + i] == of[300 + 1577 + i] for i in range(1400))


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, k long, state string")
    assert repeats.without_repeats(docs).collect() == []
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_prefix_free_repeats(spark, str(tmp_path)).collect() == []
