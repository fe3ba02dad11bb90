"""Top-k, language ID, sharding and mixing against brute force, held-out accuracy and their laws."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axiograph.llm import langid, mixing, sharding, topk


def brute_top(rows, queries, k):
    def vector(e):
        if e is None or any(x is None or not np.isfinite(x) for x in e):
            return None
        return [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in e]

    good = [(i, vector(e)) for i, e in rows if i is not None and vector(e) is not None]
    out = set()
    for q in queries:
        v = next((v for i, v in good if i == q), None)
        if v is not None:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize(("scale", "block", "segment", "queries"), [(0.2, 8, 2, 3), (0.2, 256, 16, 1024), (3e5, 4, 3, 2)])
def test_top_k(spark, scale, block, segment, queries):
    rng = random.Random(6)
    rows = [(i * 3, [float(np.float32(rng.gauss(0, scale))) for _ in range(8)]) for i in range(150)]
    rows += [(1000 + i, rows[5][1]) for i in range(12)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [0.5] * 3), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, e, 0, "n") for i, e in rows], "vec_id long, embedding array<float>, kind int, number string")
    asked = [0, 3, 15, 30, 300, 1000, 2000, 2004, 2005]
    got = {tuple(r) for r in topk.top_k(frame, frame.where(frame.vec_id.isin(asked)), 10, block, segment, queries).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, asked, 10)


def test_top_k_of_repeated_queries(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(100, None), (100, [1.0, 2.0]), (100, [1.0, float("nan")]), (100, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0])]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, schema)
        got = [tuple(r) for r in topk.top_k(frame, frame.where("vec_id = 100")).orderBy("rank").collect()]
        assert got == [(100, 1, 1, 3072 * 1024), (100, 2, 2, 3072 * 1024)]  # of (1, 1), the smallest valid vector


def test_few_segments_meet_the_queries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i // 20] * 3 + rng.normal(size=8) * 0.05]) for i in range(1200)]  # ids lie by cluster
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    met = []
    plain = topk.settle
    monkeypatch.setattr(topk, "settle", lambda df, what="step": (met.append(s.count()) if what == "pairs" else None, s)[1] if (s := plain(df, what)) is not None else None)
    asked = [i for i in range(0, 1200, 100)]
    got = {tuple(r) for r in topk.top_k(frame, frame.where("vec_id % 100 = 0"), 10, 4, 5, 1, 4).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, asked, 10)
    assert sum(met) < 12 * 60 / 4  # of 60 segments for each of 12 blocks of queries


def test_top_k_keeps_every_finite_vector(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [1e306]), (2, [-1.7e308]), (3, [float("inf")]), (100, [1e306]), (200, [2.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(frame, frame.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect()
    most = (1 << 63) - 1
    assert sorted(tuple(r) for r in got if r["query_id"] == 0) == [(0, 1, 1, most), (0, 2, 100, most), (0, 3, 200, 1024 * 2048), (0, 4, 2, -most - 1)]
    assert sorted(tuple(r) for r in got if r["query_id"] == 100)[-1] == (100, 4, 2, -most - 1)


def test_top_k_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(frame, frame.where("vec_id = 0")).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


WORDS = {"en": "the and of with thing house water from every people".split(), "de": "der und mit über häuser wasser jeder leute ein nicht".split(), "fr": "le être avec maison eau chaque les gens été où".split()}


def labelled(spark, n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 60))), lang, "s"))
    return rows, "doc_id long, text string, lang string, gram string"


def test_language_id(spark):
    rows, schema = labelled(spark)
    rows += [(900, None, "en", "s"), (901, "123 !?", "en", "s"), (902, "", "de", "s"), (903, rows[0][1], None, "s"), (None, rows[0][1], "fr", "s")]
    got = langid.identify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None and r["doc_id"] < 900:
            assert r["lang_pred"] == truth[r["doc_id"]]
    assert next(r for r in got if r["doc_id"] == 903)["lang_pred"] == rows[0][2]


def test_language_profiles_and_distance(spark, monkeypatch):
    rows, schema = labelled(spark, 60)
    docs = spark.createDataFrame(rows, schema)
    profiles = langid.train(docs.select("text", "lang"))
    counts = {}
    for _, text, lang, _ in rows:
        for word in text.split():
            w = f" {word} "
            for n in (1, 2, 3):
                for k in range(len(w) - n + 1):
                    g = w[k : k + n]
                    if g.strip():
                        counts.setdefault(lang, {}).setdefault(g, 0)
                        counts[lang][g] += 1
    code = {1: lambda g: ord(g), 2: lambda g: 1 << 63 | c(g[0]) << 42 | c(g[1]), 3: lambda g: c(g[0]) << 42 | c(g[1]) << 21 | c(g[2])}
    c = lambda x: 0 if x == " " else ord(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for lang, own in counts.items():
        merged = {}
        for g, n in own.items():
            merged[signed(code[len(g)](g))] = n
        want = {g for g, _ in sorted(merged.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]}
        got = {r["gram"] for r in profiles.where(profiles.lang == lang).collect()}
        assert got == want
    ranks = {}
    for r in langid.learned(docs).collect():
        ranks.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    texts = {i: t for i, t, _, _ in rows}
    for r in langid.identify(docs).collect():
        own = {}
        for word in texts[r["doc_id"]].split():
            w = f" {word} "
            for g in (w[k : k + n] for n in (1, 2, 3) for k in range(len(w) - n + 1)):
                if g.strip():
                    own[code[len(g)](g)] = own.get(code[len(g)](g), 0) + 1
        top = sorted(own, key=lambda g: (-own[g], g))[: langid.PROFILE]
        far = {x: sum(abs(i - rank[signed(g)]) if signed(g) in rank else langid.PROFILE for i, g in enumerate(top)) for x, rank in ranks.items()}
        best = min(sorted(far), key=far.get)
        assert (r["lang_pred"], round(r["score"], 12)) == (best, round(1 - far[best] / (langid.PROFILE * len(top)), 12))
    one = sorted(map(tuple, langid.identify(docs).collect()))
    monkeypatch.setattr(langid, "LANGUAGES", 2)  # two passes over the languages
    assert sorted(map(tuple, langid.identify(docs).collect())) == one
    empty = langid.identify(docs.limit(0))
    assert empty.count() == 0


def test_many_languages_take_little_memory():
    rng = np.random.default_rng(3)
    langs = [f"l{i:04}" for i in range(2000)]
    part = pd.DataFrame({"lang": np.repeat(langs, langid.PROFILE), "rank": np.tile(np.arange(langid.PROFILE), 2000), "gram": rng.integers(0, 1 << 40, 2000 * langid.PROFILE)})
    p = langid._Postings(part, langs)
    assert sum(x.nbytes for x in (p.grams, p.first, p.lang, p.rank)) < 32_000_000
    assert int(p.distances(part["gram"].to_numpy(np.uint64)[langid.PROFILE * 7 : langid.PROFILE * 8]).argmin()) == 7


def test_prediction_keeps_columns_of_any_name(spark):
    rows, schema = labelled(spark, 20)
    docs = spark.createDataFrame(rows, schema).withColumnRenamed("gram", "score").withColumn("lang_0", F.lit("x")).withColumn("lang_pred", F.lit("y"))
    got = langid.predict(docs, langid.learned(docs), ["doc_id", "score", "lang_0"])
    assert got.columns == ["doc_id", "score", "lang_0", "lang_pred", "score"] and got.count() == 20


def test_sharding(spark):
    rng = random.Random(4)
    texts = ["word " * int(rng.paretovariate(1.2) * 5) + str(i) for i in range(1500)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2000 + i, "the same text again " * 4) for i in range(700)] + [(3000 + i, "some copies of it " * 9) for i in range(150)] + [(5000, None), (5001, ""), (None, "x"), (7, "repeat"), (7, "repeat")]
    got = sharding.shards(spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, piece int")).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    total = sum(r["size"] for r in got)
    largest = max(r["size"] for r in got)
    assert sorted(by) == list(range(8))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= max(largest, 0.03 * total / 8)
        ordered = sorted(own, key=lambda r: r["slot"])
        ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in ordered]
        assert ids == sorted(ids)
    shard_of = {}
    for r in got:
        if r["doc_id"] is None or not (2000 <= r["doc_id"] < 3000 or r["doc_id"] == 5000):  # null and empty texts are two groups; only the 700 copies are more than a shard can hold
            shard_of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_targets_fill_by_weight():
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        sizes, weights = [rng.choice([0, rng.randint(1, 50), rng.randint(1, 5000)]) for _ in range(n)], [i % 3 + 1 for i in range(n)]
        got, total = mixing.targets(sizes, weights), sum(sizes)
        capped, want = set(), [0.0] * n
        while True:
            left, w = total - sum(3 * sizes[i] for i in capped), sum(weights[i] for i in range(n) if i not in capped)
            want = [3.0 * sizes[i] if i in capped else left / w * weights[i] for i in range(n)]
            over = {i for i in range(n) if i not in capped and want[i] > 3 * sizes[i] + 1e-9}
            if not over:
                break
            capped |= over
        assert np.allclose(got, want)


def test_permutations():
    for n in (1, 2, 7, 64, 1000):
        out = mixing.shuffled(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(out.tolist()) == list(range(n))
    assert mixing.shuffled(np.arange(1000), np.full(1000, 1000), np.full(1000, 5, np.uint64)).tolist() != list(range(1000))


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "b", "B", "é", None, "tiny"] + ["hot"] * 4), 1, "x") for i in range(600)]
    rows = [r if r[2] != "tiny" or r[0] < 40 else (*r[:2], "hot", 1, "x") for r in rows] + [(1, None, "void", 1, "x"), (None, "a b", "a", 1, "x"), (3, rows[3][1], rows[3][2], 1, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, k int, size string")
    got = mixing.mix(frame, block_words=16, shard_blocks=50)
    first = sorted(map(str, got.collect()))
    assert first == sorted(map(str, mixing.mix(frame.repartition(7), block_words=16, shard_blocks=50).collect()))
    got = got.collect()
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in names]
    want = dict(zip(names, mixing.targets(sizes, [i % 3 + 1 for i in range(len(names))])))
    for s, n in zip(names, sizes):
        own = [r for r in got if r["source"] == s]
        assert {r["target"] for r in own} == {want[s]} and {r["source_size"] for r in own} == {n}
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 16
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    assert mixing.mix(frame.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(frame.where("doc_id = 1 and text is null")).collect()} == {0}
    turned = mixing.mixed_documents(frame, block_words=16, shard_blocks=50)
    assert turned.columns == frame.columns and 0 < turned.count() <= 3 * len(rows)


def test_mixed_documents_meet_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([40, 300, 900, 2500]), "hot" if i % 3 == 0 else f"s{i % 19}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    want = {r["source"]: r["target"] for r in mixing.mix(frame).select("source", "target").distinct().collect()}
    got = dict.fromkeys(want, 0)
    for r in mixing.mixed_documents(frame).collect():
        got[r["source"]] += len(r["text"].split())
    assert want["hot"] < 0.3 * sum(len(t.split()) for _, t, s in rows if s == "hot")
    assert all(abs(got[s] - want[s]) <= 2 * 2500 + 64 for s in want), (got, want)
