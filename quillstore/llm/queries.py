"""Queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstore.llm.bpe import encode_corpus
from quillstore.llm.leakage import leaked_documents, leaked_items
from quillstore.llm.near_duplicates import expand_pairs, linked_members, named_pairs, near_duplicates
from quillstore.llm.reading_level import level_profile, reading_levels
from quillstore.llm.similar_vectors import neighbour_pairs, similar_vectors
from quillstore.llm.splitting import pieces_laid_out, split_oversized
from quillstore.sources.tables import read_table

#: Where the public vocabulary lies; a parameter of p6_ids.
VOCABULARY = os.environ.get("QUILLSTORE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _p2(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(read_table(spark, base, "chunks"), "id", "body", words=3, threshold=0.6, least=10)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return expand_pairs(*_p2(spark, base)).select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


def p2_classes(spark: SparkSession, base: str) -> DataFrame:
    """Each chunk with its class of equal sets and with how many others it is similar to: one row per chunk."""
    return linked_members(*_p2(spark, base)).withColumnRenamed("id", "chunk_id")


def p2_class_pairs(spark: SparkSession, base: str) -> DataFrame:
    """The similar pairs of classes; with p2_classes, all pairs of chunks without a row for each."""
    return named_pairs(*_p2(spark, base)).withColumn("similarity", F.round("similarity", 9))


def p2_simhash(spark: SparkSession, base: str) -> DataFrame:
    """How far the stored SimHashes of near-duplicate chunks are apart: pairs by differing bits, null where one has none."""
    stored = read_table(spark, base, "chunks").where("id is not null").groupBy("id").agg(F.max("simhash").alias("simhash"))
    of = lambda x: stored.select(F.col("id").alias(f"chunk_{x}"), F.col("simhash").alias(f"simhash_{x}"))
    pairs = p2_found(spark, base).join(of("a"), "chunk_a").join(of("b"), "chunk_b")
    return pairs.groupBy(F.bit_count(F.col("simhash_a").bitwiseXOR(F.col("simhash_b"))).cast("int").alias("bits")).agg(F.count(F.lit(1)).alias("n_pairs"))


def p2_documents(spark: SparkSession, base: str) -> DataFrame:
    """Class and number of similar other documents of each one, at five words and 0.8; a document of fewer words is a class of its own."""
    documents = read_table(spark, base, "documents")
    links = linked_members(*near_duplicates(documents, "doc_id", "text")).select(F.col("id").cast("bigint").alias("doc_id"), F.col("class_id").cast("bigint").alias("class_id"), "n_links")
    every = documents.where("doc_id is not null").select("doc_id").distinct().join(links, "doc_id", "left")
    return every.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p4_pieces(spark: SparkSession, base: str) -> DataFrame:
    def of(table: str, text: str, limit: int) -> DataFrame:
        return split_oversized(read_table(spark, base, table), "id", text, limit, 200).withColumn("src_table", F.lit(table)).withColumn("limit", F.lit(limit))

    return of("pages", "compiled_truth", 5000).unionByName(of("chunks", "body", 2000))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Forced is an item of which a piece begins inside a run that no piece could hold."""
    items = p4_pieces(spark, base).where("item_id is not null").groupBy("src_table", "item_id").agg(F.max(F.col("run") > F.col("limit")).alias("forced"))
    return items.select("src_table", "item_id", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut"))


def p4_laid_out(spark: SparkSession, base: str) -> DataFrame:
    """The pieces laid end to end are the texts, none is too long, and each begins with the 200 characters before it."""
    laid = pieces_laid_out(p4_pieces(spark, base).where("item_id is not null"), ["src_table", "item_id"], "limit")
    return laid.select("src_table", "item_id", "digest", "n_chars", "fits", "overlaps")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    of = lambda table: neighbour_pairs(similar_vectors(read_table(spark, base, table), "id", "embedding")).withColumn("src_table", F.lit(table))
    return of("vectors").unionByName(of("chunks")).select("src_table", "id_a", "id_b")


def p6_ids(spark: SparkSession, base: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return encode_corpus(read_table(spark, base, "documents"), "doc_id", "text", vocabulary)


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return leaked_items(read_table(spark, base, "documents"), read_table(spark, base, "eval_items")).select("item_id", "doc_id").distinct()


def p7_documents(spark: SparkSession, base: str) -> DataFrame:
    found = leaked_documents(leaked_items(read_table(spark, base, "documents"), read_table(spark, base, "eval_items")))
    return found.select("doc_id", F.array_join(found["items"].cast("array<string>"), ",").alias("items"), "n_items")


def p8_levels(spark: SparkSession, base: str) -> DataFrame:
    return reading_levels(read_table(spark, base, "documents"), read_table(spark, base, "reading_labels"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return p8_levels(spark, base).select("doc_id", "level")


def p8_profile(spark: SparkSession, base: str) -> DataFrame:
    return level_profile(p8_levels(spark, base))


P2_SQL = """
WITH w AS (SELECT id, regexp_extract_all(lower(any_value(body)), '[a-z0-9]+') AS w FROM chunks WHERE id IS NOT NULL GROUP BY id),
s AS (SELECT id, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS s FROM w WHERE len(w) >= 3),
e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s WHERE len(s) >= 10),
p AS (SELECT a.id AS chunk_a, b.id AS chunk_b, a.n + b.n AS n, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT chunk_a, chunk_b FROM p WHERE o / (n - o) >= 0.6
"""

_P2_SETS = """
WITH w AS (SELECT id, regexp_extract_all(lower(any_value(body)), '[a-z0-9]+') AS w FROM chunks WHERE id IS NOT NULL GROUP BY id),
s AS (SELECT id, list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS s FROM w WHERE len(w) >= 3),
c AS (SELECT s, min(id) AS class_id, count(*) AS copies FROM s WHERE len(s) >= 10 GROUP BY s),
e AS (SELECT class_id, copies, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT a.class_id AS class_a, b.class_id AS class_b, a.copies AS copies_a, b.copies AS copies_b, a.n + b.n AS n, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.class_id < b.class_id GROUP BY ALL),
q AS (SELECT * FROM p WHERE o / (n - o) >= 0.6)
"""

P2_CLASSES_SQL = f"""{_P2_SETS},
l AS (SELECT class_a AS class_id, copies_b AS n FROM q UNION ALL SELECT class_b, copies_a FROM q),
m AS (SELECT class_id, sum(n) AS n FROM l GROUP BY class_id)
SELECT s.id AS chunk_id, c.class_id, CAST(c.copies - 1 + coalesce(m.n, 0) AS BIGINT) AS n_links FROM s JOIN c ON s.s = c.s LEFT JOIN m ON m.class_id = c.class_id
"""

P2_SIMHASH_SQL = f"""
WITH h AS (SELECT id, max(simhash) AS h FROM chunks WHERE id IS NOT NULL GROUP BY id)
SELECT CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS bits, count(*) AS n_pairs FROM ({P2_SQL}) p JOIN h a ON a.id = chunk_a JOIN h b ON b.id = chunk_b GROUP BY 1
"""

P2_DOCUMENTS_SQL = """
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(any_value(text)), '[a-z0-9]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id),
s AS (SELECT id, list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])) AS s FROM w WHERE len(w) >= 5),
c AS (SELECT s, min(CAST(id AS VARCHAR)) AS class_id FROM s GROUP BY s),
e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS n, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
l AS (SELECT a, count(*) AS n FROM p WHERE o / (n - o) >= 0.8 GROUP BY a)
SELECT d.doc_id, coalesce(CAST(c.class_id AS BIGINT), d.doc_id) AS class_id, coalesce(l.n, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN s ON s.id = d.doc_id LEFT JOIN c ON c.s = s.s LEFT JOIN l ON l.a = d.doc_id
"""

P4_SQL = r"""
WITH t AS (SELECT DISTINCT 'pages' AS src_table, id AS item_id, compiled_truth AS x, 5000 AS n FROM pages UNION SELECT 'chunks', id, body, 2000 FROM chunks)
SELECT DISTINCT src_table, item_id, CASE WHEN list_max(list_transform(regexp_split_to_array(x, '[ \t\r\n]+'), lambda y: length(y))) > n THEN 'forced' ELSE 'natural' END AS cut
FROM t WHERE length(x) > n AND item_id IS NOT NULL
"""

P5_SQL = """
WITH r AS (SELECT DISTINCT 'vectors' AS src_table, id, CAST(embedding AS DOUBLE[]) AS e FROM vectors UNION SELECT 'chunks', id, CAST(embedding AS DOUBLE[]) FROM chunks),
u AS (SELECT src_table, id, CAST(e AS DOUBLE[64]) AS e FROM r
      WHERE id IS NOT NULL AND len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
c AS (SELECT a.src_table, a.id AS id, b.id AS other, round(array_cosine_similarity(a.e, b.e), 9) AS s FROM u a JOIN u b ON a.src_table = b.src_table AND a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY src_table, id ORDER BY s DESC, other) AS k FROM c WHERE s >= 0.85)
SELECT DISTINCT src_table, least(id, other) AS id_a, greatest(id, other) AS id_b FROM n WHERE k <= 5
"""

P7_SQL = """
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
ip AS (SELECT DISTINCT item_id, least(12, len(w)) AS n, array_to_string(w[i : i + least(12, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
dp AS (SELECT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM ip) WHERE len(w) >= n))
SELECT DISTINCT item_id, doc_id FROM ip JOIN dp USING (n, g)
"""

QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_class_pairs": p2_class_pairs, "p2_simhash": p2_simhash, "p2_documents": p2_documents, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_laid_out": p4_laid_out, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p7_documents": p7_documents, "p8_found": p8_found, "p8_profile": p8_profile}
SQL = {
    "p2_found": P2_SQL,
    "p2_classes": P2_CLASSES_SQL,
    "p2_class_pairs": f"{_P2_SETS} SELECT class_a, class_b, o AS shared, round(o / (n - o), 9) AS similarity FROM q",
    "p2_simhash": P2_SIMHASH_SQL,
    "p2_documents": P2_DOCUMENTS_SQL,
    "p4_found": P4_SQL,
    "p4_laid_out": """SELECT DISTINCT src_table, item_id, md5(x) AS digest, CAST(length(x) AS INTEGER) AS n_chars, true AS fits, true AS overlaps
FROM (SELECT 'pages' AS src_table, id AS item_id, compiled_truth AS x, 5000 AS n FROM pages UNION ALL SELECT 'chunks', id, body, 2000 FROM chunks) WHERE length(x) > n AND item_id IS NOT NULL""",
    "p5_found": P5_SQL,
    "p7_found": P7_SQL,
    "p7_documents": f"SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, count(*) AS n_items FROM ({P7_SQL}) GROUP BY doc_id",
}
