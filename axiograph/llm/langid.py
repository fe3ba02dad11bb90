"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiograph.llm.common import released, settle

#: n-grams in a profile.
PROFILE = 300
#: Languages that one pass compares; more take more passes.
LANGUAGES = 2_000
#: Distinct n-grams that a training task holds before it passes its counts on.
HELD = 400_000
#: Characters that one vectorised step looks at; a longer document is a step of its own.
STEP = 250_000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_map() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """uint64 codes of the n-grams of n = 1, 2 and 3, where each stands, and where each text starts.

    Words are runs of letters, in lower case, with a blank (0) at either side; blanks alone and n-grams across
    words don't count. Codes: 1: c; 2: a << 42 | c with the top bit set; 3: a << 42 | b << 21 | c.
    """
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])  # a blank stands before each text
    chars = np.frombuffer("\n".join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letter_map()[chars].astype(np.uint64)
    c = np.concatenate([np.zeros(1, np.uint64), c, np.zeros(1, np.uint64)])
    a, b, d = c[:-2], c[1:-1], c[2:]
    one, two, three = np.flatnonzero(b), np.flatnonzero(b | d), np.flatnonzero(b)
    codes = [b[one], np.uint64(1 << 63) | b[two] << np.uint64(42) | d[two], a[three] << np.uint64(42) | b[three] << np.uint64(21) | d[three]]
    return codes, (one, two, three), at


def _profile(codes: np.ndarray) -> np.ndarray:
    """The most frequent codes, most frequent first; ties by code."""
    distinct, n = np.unique(codes, return_counts=True)
    return distinct[np.lexsort((distinct, -n))[:PROFILE]]


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    texts = column.fill_null("").to_pylist()
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= STEP):
            held += len(texts[hi])
            hi += 1
        yield lo, texts[lo:hi]
        lo = hi


def train(labelled: DataFrame) -> DataFrame:
    """lang, rank, gram: the PROFILE most frequent n-grams of each language over all rows of text, lang.

    Rows with a null text or lang add nothing, nor does a language without letters. Tasks count by batch; counts meet by
    (lang, gram).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(back, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

        def passed() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in [(k, merged(v)) for k, v in held.items()]:
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes.view(np.int64)), "n": pa.array(n)})
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                for _, texts in _batches(batch.column(0).filter(pa.array(langs == lang))):
                    codes, n = np.unique(np.concatenate(_grams(texts)[0]), return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((codes, n))
                    if len(parts) > 8:
                        held[lang] = [merged(parts)]
            if sum(len(c) for v in held.values() for c, _ in v) > HELD:
                yield from passed()
        yield from passed()

    counts = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(released(count), "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE).select("lang", "rank", "gram")


def predict(docs: DataFrame, profiles: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep, lang_pred and score for every row of docs, from the column text alone.

    Distance to a language: over the text's PROFILE most frequent n-grams, how far each is from its rank in the
    language's profile, PROFILE where it isn't there. The nearest language wins, ties to the first by code point;
    score = 1 - distance / the largest possible. Null texts, texts without a letter, and all texts where nothing was
    learned: "und" and 0. Profiles are read LANGUAGES at a time, PROFILE entries of each, so what the driver and a task hold is bounded.
    """
    langs = [r["lang"] for r in profiles.select("lang").distinct().orderBy("lang").collect()]
    passes = [langs[i : i + LANGUAGES] for i in range(0, max(1, len(langs)), LANGUAGES)]
    # own names for all columns meanwhile, so that none can clash
    own = [f"k{i}" for i in range(len(keep))]
    columns, scored = list(own), docs.select(F.col("text").alias("t"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)])
    for i, some in enumerate(passes):
        part = profiles.where(F.col("lang").isin(some)).toPandas() if some else pd.DataFrame({"lang": [], "rank": [], "gram": []})
        scored = _scored(scored, part, some, columns, "t", f"lang_{i}", f"score_{i}", last=i == len(passes) - 1)
        columns += [f"lang_{i}", f"score_{i}"]
    score = F.greatest(*[F.col(f"score_{i}") for i in range(len(passes))]) if len(passes) > 1 else F.col("score_0")
    lang = F.coalesce(*[F.when(F.col(f"score_{i}") == score, F.col(f"lang_{i}")) for i in range(len(passes))])
    return scored.select(*[F.col(k).alias(c) for c, k in zip(keep, own, strict=True)], lang.alias("lang_pred"), score.alias("score"))


class _Postings:
    """n-gram -> (language, rank) of every profile that has it: as many entries as the profiles have, however many languages."""

    def __init__(self, part: pd.DataFrame, langs: list[str]):
        place = {x: i for i, x in enumerate(langs)}
        grams = part["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams)).astype(np.int64)
        self.lang = part["lang"].map(place).to_numpy(np.int64)[order]
        self.rank = part["rank"].to_numpy(np.int64)[order]
        self.n_langs = len(langs)

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a text's most frequent n-grams to every language: PROFILE for each, less what is gained
        where a profile has it."""
        place = np.searchsorted(self.grams, top)
        known = np.flatnonzero(place < len(self.grams))
        known = known[self.grams[place[known]] == top[known]]
        begin, size = self.first[place[known]], self.first[place[known] + 1] - self.first[place[known]]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        gain = PROFILE - np.abs(self.rank[at] - np.repeat(known, size))
        return PROFILE * len(top) - np.bincount(self.lang[at], gain, self.n_langs)


def _scored(docs: DataFrame, part: pd.DataFrame, langs: list[str], keep: list[str], text: str, lang: str, score_: str, last: bool) -> DataFrame:
    postings = _Postings(part, langs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, texts in _batches(batch.column(0)):
                codes, places, at = _grams(texts)
                cut = [np.searchsorted(p, at) for p in places]
                for i in range(len(texts)):
                    if cut[0][i] == cut[0][i + 1] or not langs:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    top = _profile(np.concatenate([c[k[i] : k[i + 1]] for c, k in zip(codes, cut, strict=True)]))
                    far = postings.distances(top)
                    k = int(far.argmin())
                    names.append(langs[k])
                    scores.append(1 - float(far[k]) / (PROFILE * len(top)))
            held = batch.columns[last:]  # the text goes along while another pass follows
            yield pa.RecordBatch.from_arrays([*held, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, lang, score_])

    kept = keep if last else [text, *keep]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in kept]).schema)
    return docs.select(*[F.col(f"`{c}`") for c in [text, *keep]]).mapInArrow(released(score), f"{fields}, {lang} string, {score_} double")


def held_out() -> Column:
    """True for a quarter of the documents: crc32 of the doc_id's text has remainder 2 by 4. A null doc_id: false."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> DataFrame:
    """Profiles from the documents that are not held out, written once; rows without a doc_id are left out."""
    return settle(train(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang")), "profiles")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang; others are left out)."""
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), learned(docs), ["doc_id", "held_out"])
