"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridroll.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridroll.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("copies", "source")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridroll.llm.quality import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridroll.llm.html import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridroll.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridroll.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridroll.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 8, "bytes").withColumn("grown_shard", F.lit(None).cast("int"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridroll.llm.vectordup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridroll.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridroll.llm.ngram_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridroll.llm.ann import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.where("vec_id % 20 = 0"), vectors, 20)


OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, source_size * 3.0::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, (SELECT sum(source_size)::DOUBLE FROM s) AS total,
         coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM r),
t AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * greatest((SELECT max((total - capped) / rest) FROM l), 0)) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM p),
v AS (
  SELECT d.source, d.h, sum(d.size) AS words FROM d WHERE size > 0 GROUP BY ALL),
c AS (
  SELECT v.source, v.h, b.budget, sum(words) OVER (PARTITION BY v.source ORDER BY v.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM v JOIN b ON v.source IS NOT DISTINCT FROM b.source),
m AS (SELECT source, abs(upto - budget) AS miss, h + 1 AS cut FROM c UNION ALL SELECT source, budget, 0 FROM b),
best AS (SELECT source, arg_min(cut, struct_pack(a := miss, b := cut)) AS cut FROM m GROUP BY source)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.whole + CASE WHEN d.h < best.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN best ON d.source IS NOT DISTINCT FROM best.source
"""



def _crc_step() -> str:
    """SQL of one step of the CRC-32: ``a`` so far, ``y`` the next byte. The remainder of a byte is the sum modulo 2 of those of its bits."""
    terms = []
    for bit in range(8):
        v = 1 << bit
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        terms.append(f"(xor(a, y) >> {bit} & 1) * {v}::UBIGINT")
    out = "a >> 8"
    for t in terms:
        out = f"xor({out}, {t})"
    return out


#: (doc_id, size, text_crc32) of all documents.
SUMMED_SQL = f"""
digits AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, size, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::UBIGINT) AS b FROM digits),
summed AS (
  SELECT doc_id, size::BIGINT AS size, xor(list_reduce(b, lambda a, y: {_crc_step()}, 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM bytes)"""

OP6_SQL = f"""
WITH {SUMMED_SQL},
placed AS (
  SELECT *, sum(size) OVER w - size AS before, row_number() OVER w - 1 AS place, sum(size) OVER () AS total
  FROM summed WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
dealt AS (SELECT *, least(((2 * before + size) * 8) // (2 * total), 7)::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM dealt
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_quality": op2_quality,
        "op3_html": op3_html,
        "op4_line_dedup": op4_line_dedup,
        "op5_packing": op5_packing,
        "op6_sharding": op6_sharding,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_ngram_join": op9_ngram_join,
        "op10_ann": op10_ann,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op6_sharding": OP6_SQL}
