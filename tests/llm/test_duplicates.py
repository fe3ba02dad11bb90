"""SimHash near-duplicates, repeated passages and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from axiograph.llm import decontaminate, passages, simhash
from axiograph.llm.common import components

DOCS = "doc_id long, text string, source string, fp string, row int, h string"  # extra columns clash with inner names


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "s", "x", 1, "y") for i, t in pairs], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(60)]
    out = [" ".join(b) for b in base]
    for b in base[:25]:
        for _ in range(3):
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    out += [out[0], out[0].upper(), "", None, " \t\n ", "one", "one two", "a b c", "Ünï cödé ÄÖ " * 3, "x " * 40_000]
    return list(enumerate(out))


def brute_fingerprint(text):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            least = min(root[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 3)
            if least < root[i]:
                root[i], changed = least, True
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}


def test_links_of_a_dense_group(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(63)
    fps = {centre}
    for _ in range(400):
        f = centre
        for b in rng.sample(range(63), rng.randint(0, 6)):
            f ^= 1 << b
        fps.add(f)
    frame = spark.createDataFrame([(f, f) for f in fps], "node long, f0 long")
    links = simhash.links(frame, 3, 1, 5).cache()
    assert links.count() < 20 * len(fps)  # not all pairs of a posting, for each posting
    found = {r["node"]: r["root"] for r in components(links).collect()}
    arr = np.array(sorted(fps), np.int64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3
    label = arr.copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(arr))])
        if (new == label).all():
            break
        label = new
    assert {int(a): found.get(int(a), int(a)) for a in arr} == {int(a): int(b) for a, b in zip(arr, label)}


def test_near_copies(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(4000)]
    texts, families = [], []
    for family in range(120):
        base = rng.choices(words, k=rng.randint(60, 300))
        members = [len(texts)]
        texts.append(base)
        for _ in range(rng.choice([0, 1, 1, 3])):
            own = list(base)
            for at in rng.sample(range(len(own)), max(1, int(len(own) * rng.choice([0.005, 0.01, 0.015, 0.2])))):
                own[at] = rng.choice(words)
            members.append(len(texts))
            texts.append(own)
        families.append(members)
    for _ in range(150):  # a dense group
        own = list(texts[0])
        own[rng.randrange(len(own))] = rng.choice(words)
        families[0].append(len(texts))
        texts.append(own)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE  two")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs_of(spark, rows)).collect()}
    assert (got[9001], got[9002], got[9003]) == (9000, 9002, 9002) and len(got) == len(rows)
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    near = kept = 0
    family_of = {i: m[0] for m in families for i in m}
    for i, c in got.items():
        if i < 9000:
            assert family_of[c] == family_of[i]  # unrelated texts stay apart
    for members in families:
        for i in members:
            for j in members:
                a, b = shingles(texts[i]), shingles(texts[j])
                if i < j and len(a & b) / len(a | b) >= 0.8:
                    near, kept = near + 1, kept + (got[i] == got[j])
    assert kept >= 0.9 * near and near > 300


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_near_duplicates_odd_rows(spark):
    assert rows_of(simhash.near_duplicates(docs_of(spark, []))) == []
    got = sorted(rows_of(simhash.near_duplicates(docs_of(spark, [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "zz yy xx ww vv")]))), key=str)
    assert [g[2] for g in got if g[0] == 7] == [7, 7]
    assert sorted((g[2] for g in got if g[0] is None), key=str) == [7, None]
    kept = simhash.keep_first(docs_of(spark, [(5, "a b c d"), (7, "A B C d"), (9, "something else is said here")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 9] and kept.columns == ["doc_id", "text", "source", "fp", "row", "h"]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, body in items:
            b = words_of(body)
            n = min(13, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(item)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(50)] + ["é", "10"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(rng.choice([13, 14, 30, 60]))) for i in range(12)] + [(20, some(12)), (21, some(1) + ["zz"]), (22, some(5)), (23, []), (24, ["only"])]
    docs = []
    for i in range(80):
        body = some(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            _, b = rng.choice(items)
            if b:
                a = rng.randrange(len(b))
                at = rng.randrange(len(body) + 1)
                body[at:at] = b[a : a + rng.randint(1, 40)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body).title()))
    docs += [(900, None), (901, ""), (902, " ".join(items[0][1]) * 2), (903, "only " * 30), (904, " ".join(items[1][1][:13])), (904, "nothing")]
    items = [(i, " ".join(b)) for i, b in items] + [(30, None), (0, " ".join(items[0][1])), (None, " ".join(items[2][1]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    got = sorted(rows_of(decontaminate.contamination(docs_of(spark, docs), bench)))
    assert got == sorted(brute_contamination(docs, items))
    assert rows_of(decontaminate.contamination(docs_of(spark, []), bench)) == []
    assert {r["contaminated"] for r in decontaminate.contamination(docs_of(spark, docs), bench.limit(0)).collect()} == {False}


def test_every_shared_window_has_a_common_fingerprint():
    from axiograph.llm.common import winnowed

    rng = np.random.default_rng(2)
    for _ in range(200):
        span = rng.integers(0, 50, 13).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(100, 200, rng.integers(0, 30)).astype(np.uint64), span, rng.integers(100, 200, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2))
        kept = [set(winnowed(x, np.array([0, len(x)]), 5, 9)[1].tolist()) for x in (a, b)]
        assert kept[0] & kept[1]


def brute_chain(x, y, size, cost=passages.GAP_COST):
    order = sorted(range(len(x)), key=lambda i: (y[i], x[i]))
    best = {}
    for i in order:
        best[i] = float(size[i])
        for j in order:
            if j in best and j != i and x[j] + size[j] <= x[i] and y[j] + size[j] <= y[i]:
                gx, gy = x[i] - x[j] - size[j], y[i] - y[j] - size[j]
                best[i] = max(best[i], best[j] + size[i] - cost * (gx + gy))
    return max(best.values())


def test_chaining_is_optimal(monkeypatch):
    monkeypatch.setattr(passages, "GAP", 10**9)
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randint(1, 14)
        x, y, size = (np.array([rng.randint(lo, hi) for _ in range(n)]) for lo, hi in ((0, 80), (0, 80), (5, 15)))
        chains = passages.chained(x, y, size)
        assert sorted(i for c in chains for i in c) == list(range(n))
        c = chains[0]
        value = sum(size[c]) - passages.GAP_COST * sum(x[b] - x[a] - size[a] + y[b] - y[a] - size[a] for a, b in zip(c, c[1:]))
        assert abs(value - brute_chain(x, y, size)) < 1e-9


def test_repeated_passages(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    some = lambda n: [word() for _ in range(n)]
    passage, fuzzy = some(60), some(120)
    docs = [(i, some(150)) for i in range(30)]
    for i in (3, 8, 21):
        docs[i][1][40:40] = passage
    edited = list(fuzzy)
    for k in (20, 55, 90):
        edited[k] = word()
    edited[70:70] = some(2)
    docs[5][1][10:10] = fuzzy
    docs[17][1][80:80] = edited
    docs[25][1][0:0] = some(10) + passage[:30]  # too short a part
    docs += [(100, docs[12][1]), (101, []), (102, some(2))]
    frame = docs_of(spark, [(i, " ".join(w)) for i, w in docs] + [(200, None), (None, " ".join(passage))])
    got = {(r["doc_id"], r["begin_word"], r["end_word"]) for r in passages.repeated_passages(frame).collect()}
    assert got == {(3, 40, 100), (8, 40, 100), (21, 40, 100), (5, 10, 130), (17, 80, 202), (12, 0, 150), (100, 0, 150)}
    assert rows_of(passages.repeated_passages(docs_of(spark, []))) == []


@pytest.mark.parametrize(("small", "held"), [(6, 4096), (0, 4096), (6, 20)])
def test_matches_of_a_frequent_seed(spark, small, held):
    rng = random.Random(2)
    rows = [(d, 8, p) for d in range(300) for p in range(rng.randint(1, 3))] + [(d, rng.randrange(100) & ~1, 100) for d in range(200)] + [(5, 200, 1), (5, 200, 2), (6, 202, 1)] + [(d, 301, d) for d in range(40)] + [(1, 303, 0), (1, 303, 1)]
    frame = spark.createDataFrame(rows, "doc long, h long, pos int").repartition(5)
    plain, passages.HELD = passages.HELD, held
    try:
        got = [tuple(r) for r in passages.matches(frame, small).collect()]
    finally:
        passages.HELD = plain
    assert {(d, p) for d, o, p, _ in got if o is None} == {(d, d) for d in range(40)}
    got = [g for g in got if g[1] is not None]
    assert len(got) == len(set(got)) and all(a > b for a, b, *_ in got)
    for h in {r[1] for r in rows if not r[1] & 1}:
        own = sorted({(d, p) for d, x, p in rows if x == h})
        pairs = {(a, b, p, q) for a, p in own for b, q in own if a > b}
        if len({d for d, _ in own}) > 1:
            found = [g for g in got if g in pairs]
            assert {x for a, b, p, q in found for x in ((a, p), (b, q))} >= set(own)  # every place has a partner
            roots = {d: d for d, _ in own}
            for _ in own:
                for a, b, *_ in found:
                    roots[a] = roots[b] = min(roots[a], roots[b])
            assert len(set(roots.values())) == 1 or h != 8  # one path


def test_recall_of_inexact_passages(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    some = lambda n: [word() for _ in range(n)]
    docs, planted = [], []
    for case in range(150):
        base = some(rng.randint(70, 150))
        edited = list(base)
        share = rng.choice([0.02, 0.05, 0.1])
        for k in rng.sample(range(3, len(base) - 3), int(len(base) * share)):
            edited[k] = word()
        for body in (base, edited):
            before = rng.randint(0, 60)
            planted.append((len(docs), before, before + len(base)))
            docs.append(some(before) + body + some(rng.randint(0, 60)))
        for at in range(0, len(base) - 20, 20):  # others hold parts of it
            docs.append(some(10) + base[at : at + rng.randint(6, 25)] + some(30))
    order = list(range(len(docs)))
    rng.shuffle(order)
    frame = docs_of(spark, [(order[i], " ".join(w)) for i, w in enumerate(docs)])
    got = {}
    for r in passages.repeated_passages(frame).collect():
        got.setdefault(r["doc_id"], []).append((r["begin_word"], r["end_word"]))
    caught = sum(any(min(b, e) - max(a, s) >= 0.8 * (b - a) for s, e in got.get(order[d], [])) for d, a, b in planted)
    assert caught >= 0.9 * len(planted), caught / len(planted)
    holders = {order[d] for d, *_ in planted}
    assert not [d for d in got if d not in holders]  # parts alone are no passages


@pytest.mark.parametrize(("left", "gap", "other_gap", "right"), [(51, 28, 28, 51), (60, 32, 30, 60), (60, 28, 28, 20), (55, 26, 39, 70)])
def test_passages_around_an_unrelated_gap(left, gap, other_gap, right):
    rng = np.random.default_rng(left + gap)
    for _ in range(20):
        one, two, mine, theirs = (rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (left, right, gap, other_gap))
        a, b = np.concatenate([one, mine, two]), np.concatenate([one, theirs, two])
        cut = int(rng.integers(0, 9))  # winnowed seeds begin and end inside of what is shared
        runs = np.array([cut, left + gap + 8 - cut]), np.array([cut, left + other_gap + 8 - cut]), np.array([left - 8, right - 8])
        got = passages.aligned(a, b, *runs)
        assert all(10 * e >= 8 * c for *_, e, c in got)
        for lo, hi in ((0, left), (left + gap, left + gap + right)):
            assert any(x <= lo and hi <= y for x, y, *_ in got), got


def test_exact_passages_among_stock_phrases(spark):
    rng = random.Random(4)
    some = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    passage, twice = some(60), some(55)
    docs = [(1, some(30) + passage + some(20)), (1000, some(7) + passage)]
    docs += [(2 + k, some(20) + passage[k : k + 5] + some(15)) for k in range(56)]  # each seed once in between
    docs += [(200 + k, some(20) + passage[k : k + 26] + some(15)) for k in range(0, 34, 3)]
    docs += [(2000, some(10) + twice + some(60) + twice + some(45) + twice), (2001, some(5) + twice + some(5))]
    frame = docs_of(spark, [(i, " ".join(w)) for i, w in docs])
    got = {(r["doc_id"], r["begin_word"], r["end_word"]) for r in passages.repeated_passages(frame).collect()}
    assert got == {(1, 30, 90), (1000, 7, 67), (2000, 10, 65), (2000, 125, 180), (2000, 225, 280), (2001, 5, 60)}


def test_near_copies_are_not_divided_once_they_are_linked(spark):
    rng, n = np.random.default_rng(5), 400
    base = rng.integers(0, 256, 32, np.uint8)
    rows = np.repeat(base[None], n, 0)
    for i in range(n):  # a group within reach, whose nodes share most bytes
        for bit in rng.choice(256, 6, replace=False):
            rows[i, bit // 8] ^= 1 << bit % 8
    rows = np.concatenate([rows, rng.integers(0, 256, (50, 32), np.uint8)])
    longs = rows.view(">i8").astype(np.int64)
    nodes = simhash.settle(spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(longs)], "node long, f0 long, f1 long, f2 long, f3 long"), "nodes")
    sc = spark.sparkContext

    def records():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = records()
    found = {(r["a"], r["b"]) for r in simhash.links(nodes, simhash.NEAR_BITS, simhash.NEAR_WORDS).collect()}
    assert records() - before < 4 * 96 * len(rows)
    group, reached = list(range(n)), {0}
    while more := {b for a, b in found | {(b, a) for a, b in found} if a in reached} - reached:
        reached |= more
    assert sorted(reached) == group and all(a < n and b < n for a, b in found)


def test_what_a_search_leaves_over_has_met_all_that_it_leaves_out():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 2, (300, 1), np.uint64) << np.uint64(60) | rng.integers(0, 1 << 12, (300, 1)).astype(np.uint64)
    nodes = np.arange(300)

    def joined(pairs):
        of = list(range(300))
        for a, b in pairs:
            x, y = of[a], of[b]
            of = [min(x, y) if v in (x, y) else v for v in of]
        return of

    near = [(a, b) for a in range(300) for b in range(a) if int(fps[a, 0] ^ fps[b, 0]).bit_count() <= 1]
    for most in (0, 3, 20):
        rest: list = []
        first = [(a, b) for x, y in simhash._components_of(fps, nodes, 1, most, rest) for a, b in zip(x, y, strict=True)]
        assert rest or most == 20
        left = set(rest[0].tolist()) if rest else set()
        assert joined(first + [(a, b) for a, b in near if a in left and b in left]) == joined(near)


def test_inexact_passages_whose_seeds_are_all_frequent(spark):
    rng = random.Random(17)
    some = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    base = some(100)
    other = list(base)
    for k in range(12, 100, 18):  # no anchor of 25 words is left
        other[k] = some(1)[0]
    docs = [(0, some(30) + base + some(20)), (5000, some(12) + other + some(9))]
    docs += [(1 + n, some(15) + base[k : k + 14] + some(15)) for n, k in enumerate([k for k in range(0, 87, 3) for _ in range(8)])]  # each seed in 8 documents in between and more
    docs += [(6000 + n, some(20) + base[40:60] + some(20)) for n in range(30)]
    got = {(r["doc_id"], r["begin_word"], r["end_word"], r["nearest_doc"]) for r in passages.repeated_passages(docs_of(spark, [(i, " ".join(w)) for i, w in docs])).collect()}
    assert got == {(0, 30, 130, 5000), (5000, 12, 112, 0)}


def test_bags_of_words_never_tell_too_little():
    rng = np.random.default_rng(3)
    for _ in range(50):
        size = rng.integers(1, 126, 2)
        words = rng.integers(0, 60, (2, 125)).astype(np.uint32)
        bags = passages._bags(words, size)
        assert bags[0] @ bags[1] >= passages._shared(words[0, : size[0]], words[1, : size[1]])
        assert (bags.sum(1) == size).all()


@pytest.mark.parametrize("block", [2048, 3])
def test_pairs_of_a_posting_in_tables(spark, block):
    rng = random.Random(5)
    some = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    base = some(60)
    docs = [(i, some(10) + (base if i in (2, 9) else base[30:45]) + some(10)) for i in range(12)]
    often = spark.createDataFrame([(8, i, 45 if i in (2, 9) else 15) for i, _ in docs], "h long, doc long, pos int")
    none = spark.createDataFrame([], "doc long, begin long, end long, other long, obegin long, oend long")
    frame = docs_of(spark, [(i, " ".join(w)) for i, w in docs])
    assert {tuple(r)[:6] for r in passages.around(often, none, frame, 50, block).collect()} == {(2, 10, 70, 9, 10, 70), (9, 10, 70, 2, 10, 70)}
    covered = spark.createDataFrame([(i, 0, 200, i, 0, 200) for i, _ in docs], none.schema)
    assert passages.around(often, covered, frame, 50, block).count() == 0
