"""The registered queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiograph.llm import chat, decontaminate, langid, mixing, passages, periodic, repeats, sharding, simhash, token_counts, token_files, topk, tries
from axiograph.llm.common import new_path

#: What conversation -1 says in both of its turns.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors of highest inner product for every vec_id divisible by 100, over all embeddings. Nulls, repeats and empty tables as in topk.top_k()."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that documents repeat. Null, empty and repeated rows as in passages.repeated_passages()."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark in every document. Null, empty and repeated rows as in decontaminate.contamination()."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out. Null texts and texts without a letter: und; repeats are judged each for itself."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes. A null text has size 1; repeats and ties as in sharding.shards()."""
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every line of every document. A null or empty text has one line of none; repeats are counted each for itself."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have fingerprint 0 and link; repeats as in simhash.near_duplicates()."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and of conversation -1. Null roles and texts are empty; ties in turn as in chat.chat_windows()."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    return chat.digests(chat.chat_windows(turns.unionByName(control)))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the token files. Null and empty texts are the end id alone; repeats lie side by side."""
    path = new_path(spark, "tokens")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document. Null texts have size 0, a null source is the last; repeats and ties as in mixing.mix()."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", F.col("source_size"), "target", "taken")


def op11_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that are found again. Null and short texts stay whole; repeated rows as in repeats.without_repeats()."""
    return repeats.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations. Null roles and texts are empty, rows without a conv_id take no part; ties and repeats as in tries.rebuilt()."""
    return tries.trie_nodes(*tries.rebuilt(_table(spark, sf_dir, "conversations")))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, some of them planted by the rule of with_planted_runs(), and the text without repeats. A null text has no words; a null doc_id plants nothing."""
    return periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(_table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_topk, op2_substring_dedup, op3_decontamination, op4_language_id, op5_vector_sharding, op6_token_counts, op7_simhash_dedup, op8_chat_windows, op9_token_files, op10_source_mixing, op11_prefix_free_repeats, op12_prefix_trie, op13_lyndon_runs)
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
    """,
    "op3_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
        ), lengths AS (SELECT DISTINCT n FROM bw),
        dw AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
        ), m AS (
            SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, CAST((list_reduce(list_transform(range(0, length(CAST(conv_id AS VARCHAR)) + 1),
                                    lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INTEGER), 1)) END),
                                lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) & 3) AS BIGINT) AS low
            FROM (SELECT DISTINCT conv_id FROM t)
        ), h AS (SELECT conv_id, 3 - low AS h FROM c),
        early AS (SELECT conv_id AS lender, place, role, text FROM t WHERE place < 3),
        k AS (SELECT h.conv_id, h, least(h, count(e.place)) AS k FROM h LEFT JOIN early e ON e.lender = h.conv_id - h.conv_id % 20 GROUP BY h.conv_id, h),
        b AS (
            SELECT h.conv_id, place, role, text FROM h JOIN early e ON e.lender = h.conv_id - h.conv_id % 20 AND place < h
            UNION ALL
            SELECT t.conv_id, place - h + k, role, text FROM t JOIN k ON t.conv_id = k.conv_id AND place >= h
        ), s AS (
            SELECT h.conv_id, coalesce(q, []) AS q FROM h LEFT JOIN (SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS q FROM b GROUP BY conv_id) USING (conv_id)
        ), m AS (
            SELECT conv_id AS member, d, q[1 : d] AS p, len(q) = d AS is_end FROM (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS d FROM s)
        ), n AS (
            SELECT d, p, min(member) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN is_end THEN CAST(member AS VARCHAR) END, ',' ORDER BY member), '')) AS ends_sha256,
                   CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS words
            FROM m GROUP BY d, p
        ), f AS (
            SELECT n.*, up.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children
            FROM n LEFT JOIN n up ON up.d = n.d - 1 AND up.p = n.p[1 : n.d - 1]
            LEFT JOIN (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL) ch ON ch.d = n.d AND ch.p = n.p
        ), r AS (
            SELECT a AS d, p[1 : a] AS p, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
            FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL
        )
        SELECT f.conv_id, f.d AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
        FROM f JOIN r ON f.d = r.d AND f.p = r.p
    """,
}
