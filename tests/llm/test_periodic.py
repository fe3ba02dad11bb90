"""Periodic runs against a search by every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from axiograph.llm import periodic
from axiograph.llm.queries import op13_lyndon_runs


def plain_after(s):
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) for i in range(len(s))]


def plain_runs(s, least=6, exponent=4):
    out = []
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            w = s[i : j + p]
            if j > i and len(w) >= max(least, exponent * p) and not any(w[q:] == w[:-q] for q in range(1, p)):
                out.append((i, len(w), p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def items(r: random.Random) -> list[int]:
    s = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 30))]
    if r.random() < 0.5 and s:
        s = (s[: r.randint(1, len(s))] * 9)[: r.randint(1, 50)]
        s[r.randrange(len(s))] = r.randrange(4)
    return s + [r.randrange(3) for _ in range(r.randint(0, 9))]


def test_lyndon_arrays_and_runs():
    r = random.Random(1)
    for _ in range(4000):
        s = items(r)
        after, agree = periodic.lyndon(s)
        assert after == plain_after(s)
        assert all(s[i : i + k] == s[j : j + k] and s[i + k : i + k + 1] != s[j + k : j + k + 1] for i, (j, k) in enumerate(zip(after, agree, strict=True)) if j < len(s))
        for least, exponent in ((6, 4), (2, 2), (5, 3)):
            assert periodic.runs_of(s, least, exponent) == plain_runs(s, least, exponent)


def test_words_are_read_once():
    class Word(int):
        reads = 0

        def __eq__(self, other):
            Word.reads += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    for s in ([0] * 3000, [0, 1] * 1500, [random.Random(2).randrange(2) for _ in range(3000)], [0, 0, 1, 0, 2] * 600):
        Word.reads = 0
        periodic.lyndon([Word(x) for x in s])
        assert Word.reads <= 4 * len(s)


def plain(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_every_period(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in items(r)) if i % 3 else "  \t ".join(r.choice(["a", "b c", "ü", "dd"]) for _ in range(r.randint(0, 200)))) for i in range(250)]
    rows += [(None, "a a a a a a a"), (None, None), (300, ""), (301, " \n"), (302, None), (303, "x " * 900), (303, "x " * 900), (304, " ".join(["a b c d e"] * 150) + " z")]
    spark.createDataFrame([(i, t, 7, "n") for i, t in rows], "doc_id long, text string, runs int, n string").write.parquet(f"{tmp_path}/documents.parquet")
    out = [tuple(x) for x in op13_lyndon_runs(spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted((plain(*x) for x in rows), key=str)
    assert sum(x[1] for x in out) > 60


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_lyndon_runs(spark, str(tmp_path)).collect() == []
