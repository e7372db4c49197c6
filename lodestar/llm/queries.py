"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[job.__name__] = job
    return job


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.packing import pack_documents

    return pack_documents(
        table(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"), added_path=vocabulary("byte_bpe_50k.json")
    )


@query
def op4_suffix_repetition(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.repetition import repetition

    return repetition(table(spark, folder, "documents"))


@query
def op5_diagonal_voting(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.licenses import license_summary

    return license_summary(table(spark, folder, "documents"))


@query
def op6_ftrl_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.toxicity import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_factorisation_quality(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.factorisation import quality

    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_pruned_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.graph_search import nearest

    return nearest(table(spark, folder, "embeddings"))


@query
def op3_hamming_join(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query
def op7_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its cleaned text, how many sentences went, and the documents that have them first."""
    from lodestar.llm.spans import without_repeats

    return without_repeats(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "text", "repeats.*")


@query
def op1_bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.pii import personal_data_summary

    return personal_data_summary(table(spark, folder, "documents"))


@query
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.pieces import encode

    return encode(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, folder, "conversations"))


# crc32 of the decimal id by its table of 256 words; turns are keyed by a length-prefixed encoding, so that a node's key
# begins with every ancestor's.
ORACLES["op11_prefix_trie"] = """
WITH RECURSIVE
crc_table(n, k, v) AS (
    SELECT i, 0, i FROM range(256) r(i)
    UNION ALL
    SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_table WHERE k < 8),
tbl AS (SELECT n, v FROM crc_table WHERE k = 8),
ids0 AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, i, v) AS (
    SELECT c, CAST(c AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM ids0
    UNION ALL
    SELECT crc.c, crc.s, crc.i + 1, xor(tbl.v, crc.v >> 8)
    FROM crc JOIN tbl ON tbl.n = xor(crc.v, ord(substr(crc.s, crc.i + 1, 1))) & 255
    WHERE crc.i < length(crc.s)),
ids AS (SELECT c, c - c % 100 AS b, CAST(xor(v, 4294967295) % 6 AS INTEGER) AS h FROM crc WHERE i = length(s)),
t AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
lent AS (SELECT ids.c, t.p AS e, t.role, t.text FROM ids JOIN t ON t.c = ids.b AND t.p <= ids.h),
m AS (SELECT c, count(*) AS m FROM lent GROUP BY c),
after AS (
    SELECT t.c, coalesce(m.m, 0) + t.p - ids.h AS e, t.role, t.text
    FROM t JOIN ids ON ids.c = t.c LEFT JOIN m ON m.c = t.c WHERE t.p > ids.h),
r AS (SELECT * FROM lent UNION ALL SELECT * FROM after),
lens AS (SELECT ids.c, coalesce(max(r.e), 0) AS n FROM ids LEFT JOIN r ON r.c = ids.c GROUP BY ids.c),
enc AS (
    SELECT c, e AS d, length(text) AS size,
           string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
               OVER (PARTITION BY c ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
    FROM r),
paths AS (
    SELECT c, n, 0 AS d, '' AS k, 0 AS size FROM lens
    UNION ALL
    SELECT enc.c, lens.n, enc.d, enc.k, enc.size FROM enc JOIN lens ON lens.c = enc.c),
nodes AS (
    SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size, bool_and(n = d) AS leaf,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
    FROM paths GROUP BY d, k)
SELECT
    CAST(x.conv_id AS BIGINT) AS conv_id,
    CAST(x.d AS BIGINT) AS depth,
    CAST((SELECT p.conv_id FROM nodes p WHERE p.d = x.d - 1 AND starts_with(x.k, p.k)) AS BIGINT) AS parent_conv_id,
    CAST(x.n_convs AS BIGINT) AS n_convs,
    CAST((SELECT count(*) FROM nodes y WHERE y.d = x.d + 1 AND starts_with(y.k, x.k)) AS BIGINT) AS n_children,
    CAST((SELECT count(*) FROM nodes y WHERE y.d >= x.d AND y.leaf AND starts_with(y.k, x.k)) AS BIGINT) AS n_leaves,
    CAST((SELECT sum((y.n_convs - 1) * y.size) FROM nodes y WHERE y.d >= x.d AND starts_with(y.k, x.k)) AS BIGINT)
        AS saved_tokens,
    x.ends_sha256
FROM nodes x
"""


@query
def op12_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every whole document; the digests are taken from them in Spark."""
    from pyspark.sql import functions as F

    from lodestar.llm.word_bpe import round_trip

    ids = round_trip(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from lodestar.llm.manifest import manifest

    return manifest(table(spark, folder, "documents"))
