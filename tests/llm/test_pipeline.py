"""The pipeline's stages on a small corpus, and registration of its queries."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from axiograph.llm import mixing
from axiograph.llm.encoding import default_vocabulary
from axiograph.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    at = tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    item = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(60)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[1][1].upper(), "en", "s1", 1), (102, item, "en", "s1", 1), (103, "12 34", "en", "s0", 1), (104, None, "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.cache()
        kept.append([r["doc_id"] for r in docs.collect()])
    base = list(range(60))
    assert sorted(kept[0]) == [*base, 100, 101, 102]
    assert sorted(kept[1]) == [*base, 102]
    assert sorted(kept[2]) == base
    assert max(kept[3].count(i) for i in base) <= 3
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(kept[3])
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, out))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_run_against_plain_python(spark, tmp_path):
    rng = random.Random(3)
    words = {x: ["".join(rng.choices(letters, k=5)) for _ in range(400)] for x, letters in (("en", "abcdefghij"), ("de", "klmnopqrst"))}
    some = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    items = [(i, some("en", 30)) for i in range(3)]
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de"])
        rows.append((i, some(lang, rng.randint(20, 400)), lang, rng.choice(["a", "a", "a", "b", None]), 1, 7.5))
    for i in range(0, 60, 2):  # one word of 220 or more is another: a similarity of 0.95
        base = rows[i][1].split()
        if len(base) > 220:
            base[len(base) // 2] = "zzzzz"
            rows.append((300 + i, " ".join(base), rows[i][2], "b", 1, 0.0))
    rows += [(500, rows[3][1].upper(), "en", "a", 1, 0.0), (501, rows[3][1], None, "b", 1, 0.0), (502, items[1][1] + " " + some("en", 20), "en", "a", 1, 0.0), (503, None, "en", "a", 1, 0.0), (504, "12", "en", None, 1, 0.0), (505, "", None, "b", 1, 0.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    root = {r[0]: r[0] for r in kept}
    sets = {r[0]: shingles(r[1]) for r in kept}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    kept = [r for r in kept if root[r[0]] == r[0]]
    windows = {tuple(w[i : i + 13]) for _, text in items for w in [text.split()] for i in range(len(w) - 12)}
    kept = [r for r in kept if not any(tuple(w[i : i + 13]) in windows for w in [r[1].lower().split()] for i in range(len(w) - 12))]
    assert len(rows) - len(kept) > 10
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)), name)
    assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, kept))
    mixed = corpus_pipeline.settle(corpus_pipeline.source_mixing(spark, docs, str(tmp_path)), "mixed")
    times = Counter(tuple(r) for r in mixed.collect())
    assert set(times) <= set(kept) and max(times.values()) <= 3
    sizes = {s: sum(len(r[1].split()) for r in kept if r[3] == s) for s in ("a", "b", None)}
    wanted = mixing.targets([sizes[s] for s in ("a", "b", None)], [1, 2, 3])
    for s, want in zip(("a", "b", None), wanted, strict=True):
        assert abs(sum(len(r[1].split()) * n for r, n in times.items() if r[3] == s) - want) <= 2 * 400 + 64
    from tokenizers import Tokenizer

    library, want, start = Tokenizer.from_file(default_vocabulary()), [], 0
    for i, text in sorted((r[0], r[1]) for r, n in times.items() for _ in range(n)):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()] == want


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size_ int, turn_ string, d_ int, score double, lang_pred string, body_ int, lang_0 string, words binary, row int"
    rows = [(i, f"some words of document number {i} " * 9, "en", "s", 1, 77, "t", 5, 0.5, "p", 6, "l", b"w", 3) for i in range(9)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for docs in (full, full.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == full.columns
            assert {tuple(r)[5:] for r in out.collect()} <= {tuple(r[5:]) for r in rows}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names and len(QUERIES) == 10
    assert len(corpus_pipeline.STAGES) == 5
