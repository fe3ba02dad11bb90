"""The exact join of shingle sets against brute force."""

import random

import numpy as np
import pyarrow as pa

from axiograph.llm import similar, simhash


def plain_sets(texts):
    out = {}
    for i, t in texts:
        w = (t or "").lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def roots_of(sets):
    names = sorted(sets)
    root = {i: i for i in names}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(names):
        for j in names[k + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in names}


def corpus():
    """Families around a similarity of 0.8, a line that many texts hold, and a large group of near copies."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    line, texts = rng.choices(words, k=30), []
    for _ in range(90):
        base = rng.choices(words, k=rng.choice([1, 3, 5, 8, 30, 60, 100, 200]))
        if rng.random() < 0.6:
            base[len(base) // 2 : len(base) // 2] = line
        texts.append(base)
        for _ in range(rng.choice([0, 1, 3])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(own[: len(own) - rng.choice([0, 0, 1, len(own) // 6, len(own) // 5])])
    for _ in range(60):
        own = list(texts[0] + line + texts[5])
        own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(own)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE  two"), (9004, rows[7][1].upper())]


def test_near_copies_are_those_of_brute_force(spark):
    rows = corpus()
    want = roots_of(plain_sets(rows))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want
    assert len(set(want.values())) < len(want) - 100


def test_links_of_postings_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "FREQUENT", 4)
    monkeypatch.setattr(similar, "TOLD", 50)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    nodes = simhash.settle(similar.described(docs).groupBy("node").agg(*[simhash.F.min("doc_id").alias("first"), *[simhash.F.first(c).alias(c) for c in ("n", "sketch", "low")]]), "nodes")
    first = {r["node"]: r["first"] for r in nodes.collect()}
    found = {tuple(sorted((first[r["a"]], first[r["b"]]))) for r in similar.links(docs, nodes, 3).collect()}
    sets = plain_sets([r for r in rows if r[0] in first.values()])
    assert all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in found)
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    assert root == roots_of(sets)


def test_counts_in_buckets_keep_similar_sets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 3000))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: int(n * rng.uniform(0.8, 1))], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.2)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        counts = [np.minimum(np.bincount((s & np.uint64(255)).astype(int), minlength=256), 255).astype(np.uint8) for s in (a, b)]
        alike = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        assert similar._near(counts[0], counts[1][None], np.array(len(a)), np.array([len(b)]))[0] or not alike


def test_sets_of_a_column():
    got = [s for _, _, sets in similar.shingle_sets(pa.array(["a b c d e f", "A b  C d e f", "a b", None, "", "x y x y x y x y x"])) for s in sets]
    assert [len(s) for s in got] == [2, 2, 1, 0, 0, 2] and (got[0] == got[1]).all()
