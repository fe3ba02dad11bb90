"""Prefix tries against nodes counted one by one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from axiograph.llm import tries
from axiograph.llm.queries import op12_prefix_trie


def plain(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
        ends[seqs[c]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items()), key=str)


def conversations(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    says = ["", "a b", "c\td  e", "hello", None, "ü x", "yes"]
    rows = []
    for c in range(n):
        if r.random() < 0.9:
            start = r.choice([0, 0, 0, 1])
            turns = [(t if r.random() < 0.98 else None, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", says[(start + t) % 7] if r.random() < 0.8 else r.choice(says)) for t in range(r.randint(0, 7))]
            rows += [(c, *t) for t in turns] + ([(c, *turns[0])] if turns and r.random() < 0.1 else [])
    long = [(t, "user", f"word {t % 5}") for t in range(60)]
    rows += [(c, *t) for c in range(500, 540, 3) for t in long[: r.randint(40, 60)]]
    rows += [(c, 0, "user", "same") for c in range(1000, 1200)]
    rows += [(None, 0, "user", "x"), (None, None, None, None), (2000, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [tries.SHARD, 30])
def test_against_nodes_one_by_one(spark, shard):
    rows = conversations(shard, 300)
    turns = spark.createDataFrame([(*x, 1, "y") for x in rows], "conv_id long, turn int, role string, text string, depth int, shard string")
    out = tries.trie_nodes(*tries.rebuilt(turns), shard=shard)
    assert out.columns == tries.NODE
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows)


def test_level_order_bits():
    paths = ["", "a", "ab", "abc", "b", "bd", "be", "be"]
    rows = [(p, k, ord(("." + w)[k])) for p, w in enumerate(paths) for k in range(len(w) + 1)]
    path, level, label = (np.array(x) for x in zip(*rows, strict=True))
    trie, node = tries.built(np.zeros(len(rows), np.int64), path, level, np.stack([label, label], axis=1))
    assert "".join(map(str, np.unpackbits(trie.bits, count=trie.size))) == "10" + "110" + "10" + "110" + "10" + "0" + "0" + "0"
    assert trie.parents().tolist() == [-1, 0, 0, 1, 2, 2, 3] and trie.degrees().tolist() == [2, 1, 2, 1, 0, 0, 0]
    assert trie.rolled_up(np.ones(7, np.int64)).tolist() == [7, 3, 3, 2, 1, 1, 1]
    assert [chr(x) for x in trie.labels[:, 0][node[path == 6]][1:]] == ["b", "e"]


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert op12_prefix_trie(spark, str(tmp_path)).collect() == []
