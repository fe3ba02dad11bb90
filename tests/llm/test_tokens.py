"""Token files, token counts, chat windows, against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from axiograph.llm import chat, encoding, token_counts, token_files
from axiograph.llm.queries import CONTROL


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.default_vocabulary())


TEXTS = ["Hello world, it's here.\n\nTwo  spaces\tand 12,345 <|endoftext|>", "", None, "a", " ", "\n", "日本 語 テキスト 😀 é", "word " * 30_000, "don't 'quote' ''s", "x" * 500, "Hello world, it's here.\n\nTwo  spaces\tand 12,345 <|endoftext|>", "  nbsp  em \r\n crlf"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id long, text string, part string, seq int")


def test_pieces_give_the_library_ids(library):
    rng = random.Random(1)
    alphabet = ["a", "B", "'s", "'", "t", " ", "  ", "\n", "\n\n", "\t", "1", ".", ",", "é", "»", " ", "　", "日", "😀", "<|endoftext|>", "'ll", "\r\n", "-", " ", " ", "\x85"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(5000)]
    e = encoding.PieceEncoder(encoding.default_vocabulary())
    for _, _, _, _, ids, at in e.steps(pa.array(texts)):
        want = library.encode_batch_fast(texts, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [x.ids for x in want]


def test_pieces_of_one_hash_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(encoding, "span_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    e = encoding.PieceEncoder(encoding.default_vocabulary())
    for text in ("one two three one", "three four", "end <|endoftext|> here<|endoftext|>"):
        (_, _, _, _, ids, _), = e.steps(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert library.encode("end <|endoftext|> here", add_special_tokens=False).ids == [437, 220, 50256, 994]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (5, 3), (1000, 10**6), (1000, 10), (300, 2**40)):
        v = np.sort(rng.integers(0, top, n))
        e, rest = token_files.EliasFano.load(memoryview(token_files.EliasFano.of(v).dump()))
        assert not len(rest) and e.values().tolist() == v.tolist() and [e.select(i) for i in range(n)] == v.tolist()
    v = np.cumsum(rng.integers(100, 1000, 100_000))
    assert len(token_files.EliasFano.of(v).dump()) < 100_000 * (2 + np.log2(v[-1] / 100_000) + 1) / 8


@pytest.mark.parametrize("segment", [10, 2_000_000])
def test_token_files(spark, library, tmp_path, segment):
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)] + [(4, "same id"), (None, "no id")]
    path = f"file://{tmp_path}/t{segment}"
    token_files.write_token_files(frame(spark, rows), path, segment_ids=segment)
    got = [tuple(r) for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t in ordered:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    ids = {(r["doc_id"], tuple(r["ids"])) for r in token_files.token_ids(spark, path).collect()}
    assert ids == {(i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows}


def test_no_documents(spark, tmp_path):
    token_files.write_token_files(frame(spark, []), f"file://{tmp_path}/none")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def brute_counts(library, text, sections, rule):
    text = text or ""
    out = {k: [0, 0] for k in range(len(sections))}
    raw, at = text.encode(), 0
    starts = np.cumsum([0] + [len(c.encode()) for c in text])
    bounds = [(int(starts[a]), int(starts[b])) for a, b in sections]
    inverse = {i: len(t) for t, i in library.get_vocab().items()}
    for token in library.encode(text, add_special_tokens=False).ids:
        lo, hi = at, at + inverse[token]
        at = hi
        share = [max(0, min(hi, b) - max(lo, a)) for a, b in bounds]
        own = [k for k, s in enumerate(share) if s]
        k = max(own, key=lambda k: (share[k], -k)) if rule == "most" else own[0]
        out[k][0] += 1
        out[k][1] += len(own) > 1
    assert at == len(raw)
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_line_counts(spark, library, rule):
    texts = [*TEXTS, "\n\n\na\n\n", "a\nb\n"]
    got = {}
    for r in token_counts.token_counts(frame(spark, list(enumerate(texts))), rule=rule).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start_char"], r["end_char"], r["n_tokens"], r["n_crossing"]))
    for i, t in enumerate(texts):
        lines, a = [], 0
        for line in (t or "").split("\n"):
            b = min(len(t or ""), a + len(line) + 1)
            if b > a or not lines:
                lines.append((a, b))
            a = b
        want = brute_counts(library, t, lines, rule)
        assert sorted(got[i]) == [(k, *lines[k], *want[k]) for k in range(len(lines))], t


def test_given_sections(spark, library):
    text = "Héllo wörld again"
    sections = spark.createDataFrame([(1, 0, 0, 7, "z"), (1, 1, 7, 11, "z"), (2, 5, 0, 99, "z"), (3, 0, 0, 1, "z"), (None, 0, 0, 1, "z")], "doc_id long, section int, start_char int, end_char int, text string")
    got = {(r["doc_id"], r["section"]): (r["start_char"], r["end_char"], r["n_tokens"]) for r in token_counts.token_counts(frame(spark, [(1, text), (2, "all of it"), (4, "none given"), (3, None)]), sections).collect()}
    n = len(library.encode(text, add_special_tokens=False).ids)
    assert sum(v[2] for k, v in got.items() if k[0] == 1) == n and got[1, None][2] >= 1
    assert got[2, 5] == (0, 9, 3) and got[3, 0] == (0, 0, 0) and got[4, None][2] == 2


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, tokens int")


def brute_digest(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def brute_windows(sizes, system, budget, history):
    """(repeated turns, new turns) of every window, turn by turn."""
    out, at = [], 0
    while at < len(sizes):
        fixed = [0] if system and at else []
        past = []
        for j in range(at - 1, 0 if system else -1, -1):
            if sum(sizes[k] for k in past) + sizes[j] > history:
                break
            past.insert(0, j)
        while past and sum(sizes[k] for k in fixed + past) + sizes[at] > budget:
            past.pop(0)
        new = [at]
        while new[-1] + 1 < len(sizes) and sum(sizes[k] for k in fixed + past + new) + sizes[new[-1] + 1] <= budget:
            new.append(new[-1] + 1)
        out.append((fixed + past, new))
        at = new[-1] + 1
    return out


@pytest.mark.parametrize(("budget", "history", "segment"), [(60, 25, 1 << 19), (1024, 256, 1 << 19), (1, 0, 1 << 19), (60, 25, 150), (200, 60, 90)])
def test_chat_round_trip(spark, library, budget, history, segment):
    rng = random.Random(2)
    odd = ["<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|x|>", "<|", "", None, "plain words here", "é😀\n\\n", "<<|>", "long " * 60]
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "a\nb<|im_start|>\\"]) if t else rng.choice(["system", "user"]), rng.choice(odd)) for c in range(25) for t in range(rng.randint(1, 20))]
    rows += [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL), (None, 0, "assistant", "lost"), (50, None, "user", "a"), (50, 0, "assistant", "b"), (50, 0, "assistant", "b")]
    windows = chat.chat_windows(conversations(spark, rows), budget, history, segment=segment).cache()
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(windows).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want[c] = brute_digest([(r[2], r[3]) for r in own])
    assert got == want
    ordered = {c: sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")) for c in {r[0] for r in rows}}
    found = {}
    for w in windows.orderBy("conv_id", "window").collect():
        turns = chat.parsed(w["formatted"])
        assert len(turns) == w["n_turns"] and w["n_turns"] > w["n_repeated"]
        assert w["n_tokens"] == len(library.encode(w["formatted"], add_special_tokens=False).ids)  # the output's own tokens
        system = bool(ordered[w["conv_id"]][0][2] == "system")
        assert w["n_tokens"] <= budget or w["n_repeated"] <= system and w["n_turns"] - w["n_repeated"] == 1
        found.setdefault(w["conv_id"], []).append((w["first_turn"], w["n_repeated"], turns))
    for c, own in ordered.items():
        texts = [(r[2] or "", r[3] or "") for r in own]
        assert [t for _, n, turns in found[c] for t in turns[n:]] == texts
        sizes = [len(library.encode(chat.formatted_turn(*t)[0], add_special_tokens=False).ids) for t in texts]
        if sum(sizes) <= segment:
            want = brute_windows(sizes, texts[0][0] == "system", budget, history)
            assert found[c] == [(new[0], len(old), [texts[k] for k in old + new]) for old, new in want]


def test_no_conversations(spark):
    assert chat.digests(chat.chat_windows(conversations(spark, []))).count() == 0
