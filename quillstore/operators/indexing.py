"""From markdown to chunks with fingerprints and vectors, and SimHash pairs."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstore.functions.text import fake_embedding, fingerprint, sections, simhash64, uuid_of


def chunk_markdown(pages: DataFrame, slug: str, body: str) -> DataFrame:
    """slug, ord, body: the sections of each markdown text, numbered from 0; blank and null texts have none."""
    return pages.select(F.col(slug).alias("slug"), F.posexplode(sections(F.col(body))).alias("ord", "body"))


def index_markdown(pages: DataFrame, slug: str, body: str, embed: Callable[[Column], Column] = fake_embedding) -> DataFrame:
    """The chunks of pages, as rows of the chunk table: page_id from the slug's fingerprint, body, content_fp, simhash, embedding.

    Pass only the pages that a skip gate lets through: the embedder is by far the most expensive step.
    """
    chunks = chunk_markdown(pages, slug, body)
    return chunks.select(
        F.concat_ws("#", "slug", "ord").alias("id"),
        uuid_of(fingerprint(F.col("slug"))).alias("page_id"),
        "ord",
        "body",
        fingerprint(F.col("body")).alias("content_fp"),
        simhash64(F.col("body")).alias("simhash"),
        embed(F.col("body")).alias("embedding"),
    )


def simhash_pairs(df: DataFrame, simhash: str, distance: int = 3) -> DataFrame:
    """hash_a < hash_b, bits: the pairs of distinct SimHash values that differ in at most `distance` bits.

    The 64 bits are cut into twice as many blocks as bits may differ; a pair agrees in at least half of them, so it meets under
    one of the choices of that many blocks, which are joined as one key. Equal values are one; their rows
    are found by joining on the value. The join is told to sort and merge: Spark takes the keys of all choices to be no larger
    than the values, and would broadcast them through the driver.
    """
    blocks = 2 * distance
    edges = [64 * i // blocks for i in range(blocks + 1)]
    values = df.where(F.col(simhash).isNotNull()).select(F.col(simhash).alias("h")).distinct()

    def masked(choice: tuple[int, ...]) -> Column:
        bits = sum(1 << b for i in choice for b in range(edges[i], edges[i + 1]))
        return F.col("h").bitwiseAND(F.lit(bits - (1 << 64) if bits >= 1 << 63 else bits).cast("bigint"))

    keys = F.array(*(F.struct(F.lit(n).alias("choice"), masked(c).alias("key")) for n, c in enumerate(combinations(range(blocks), blocks - distance))))
    keyed = values.select("h", F.inline(keys))
    a, b = keyed.withColumnRenamed("h", "hash_a"), keyed.withColumnRenamed("h", "hash_b")
    bits = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    return a.join(b.hint("merge"), ["choice", "key"]).where("hash_a < hash_b").select("hash_a", "hash_b", bits.alias("bits")).where(F.col("bits") <= distance).distinct()
