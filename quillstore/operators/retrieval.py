"""Ranked retrieval: exact vector search, BM25, reciprocal-rank fusion and the hybrid of keyword and vector search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstore.functions.text import SNIPPET, snippet
from quillstore.operators.store import current_pages, keyword_search, last_vectors
from quillstore.sources.tables import materialize

#: Query vectors that are searched for in one pass over the table; more queries take more passes.
BLOCK = 4096
#: Rows whose similarity to a block of queries is computed at once.
ROWS = 2048


def _nearest(queries, dim: int, k: int):
    """(query_id, id, similarity): a task's k best rows for each query; of each batch only what reaches a query's k-th best so far is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = queries.value
        least = np.full(len(names), -np.inf)
        query, similarity, ids = np.empty(0, np.int64), np.empty(0), np.empty(0, "U1")
        for batch in batches:
            every = np.array(batch.column(0).to_pylist(), "U")
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            for at in range(0, len(x), ROWS):
                s = np.round(q @ x[at : at + ROWS].T, 9)
                i, j = np.nonzero(s >= least[:, None])
                query, similarity, ids = np.append(query, i), np.append(similarity, s[i, j]), np.append(ids, every[at + j])
                order = np.lexsort((ids, -similarity, query))
                query = query[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                order, query, full = order[place < k], query[place < k], query[place == k - 1]
                similarity, ids = similarity[order], ids[order]
                least[full] = similarity[np.searchsorted(query, full, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in query], pa.string()), pa.array(ids.tolist(), pa.string()), pa.array(similarity)], ["query_id", "id", "similarity"])

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str = "id", embedding_col: str = "embedding") -> DataFrame:
    """query_id, id, similarity, rank: the k rows of `vectors` nearest to each of the `queries` by cosine, exactly.

    Similarity is 1 - distance, rounded to 9 decimals; it is 0 if either vector is zero. Ties go to the smaller id (as
    text). `queries` has query_id and embedding and is a stated query set: it is sent to the tasks in blocks, against which all rows are
    compared; each task keeps k rows per query. A vector of another dimension is an error; null vectors don't take part.
    """
    context = vectors.sparkSession.sparkContext
    checked = vectors.where(F.col(embedding_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.when(F.size(embedding_col) == dim, F.col(embedding_col).cast("array<float>")).otherwise(F.raise_error(F.lit("a vector has another dimension"))).alias("embedding"))
    found, names, rows = None, [], []

    def search() -> DataFrame:
        q = np.array(rows, np.float64).reshape(-1, dim)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
        return checked.mapInArrow(_nearest(context.broadcast((list(names), q)), dim, k), "query_id string, id string, similarity double")

    for row in queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding").orderBy("query_id").toLocalIterator():
        if row.embedding is None or len(row.embedding) != dim:
            raise ValueError("a query has another dimension")
        names.append(row.query_id)
        rows.append(row.embedding)
        if len(names) == BLOCK:
            part = search()
            found = part if found is None else found.unionByName(part)
            names, rows = [], []
    if names or found is None:
        part = search()
        found = part if found is None else found.unionByName(part)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, slug, score, rank from ranked lists (query_id, list, slug, rank from 1): the sum of 1 / (k + rank) over all places of a slug; ties by slug."""
    scores = lists.groupBy("query_id", "slug").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 12).alias("score"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "slug")))


#: A sub-search: of a query (a text, or a vector) and a limit, it gives slug and rank.
Backend = Callable[..., DataFrame]


@dataclass(frozen=True)
class FullText:
    """Keyword search, newest first."""


@dataclass(frozen=True)
class Vector:
    """Cosine search; gives nothing without a query vector."""


@dataclass(frozen=True)
class Hybrid:
    """Both, fused; the last one's constant counts."""

    rrf_k: int = 60


@dataclass(frozen=True)
class TagIntersection:
    """Accepted, contributes nothing."""


@dataclass(frozen=True)
class BacklinkHop:
    """Accepted, contributes nothing to the fusion."""

    max_depth: int = 2


def search(pages: DataFrame, vectors: DataFrame, query: str, embedding: list[float] | None = None, limit: int = 10, strategies: tuple = (Hybrid(),), dim: int = 64, tombstones: DataFrame | None = None, backends: dict[str, Backend] | None = None, strict: bool = False) -> DataFrame:
    """slug, snippet, score, rank: the fused result of the strategies' sub-searches, each limited before the fusion; blank queries and limit 0 give none.

    pages is the log of puts. Of several vectors of an id, the last one counts; a vector of another dimension is an error.
    With `strict`, so is a hit whose page isn't current; without, vectors of such pages take no part. `backends` replaces the
    sub-searches `text` (query, limit) and `vector` (embedding, limit), which give slug and rank from 1. Only the
    texts of the hits are looked up, of at most `limit` slugs.
    """
    spark = pages.sparkSession
    alive = current_pages(pages.select("id", "slug", "created_at"), tombstones).select("slug")

    def by_vector(asked: list[float], most: int) -> DataFrame:
        last = last_vectors(vectors)
        known = last if strict else last.join(alive.select(F.col("slug").alias("id")), "id", "left_semi")
        one = spark.createDataFrame([("q", [float(x) for x in asked])], "query_id string, embedding array<float>")
        return vector_topk(known, one, most, dim).select(F.col("id").alias("slug"), "rank")

    by = {"text": lambda asked, most: keyword_search(pages, asked, most, tombstones), "vector": by_vector} | (backends or {})
    lists, fused_k, number = spark.createDataFrame([], "query_id string, list int, slug string, rank int"), 60, 0

    def add(found: DataFrame) -> None:
        nonlocal lists, number
        number += 1
        lists = lists.unionByName(found.select(F.lit("q").alias("query_id"), F.lit(number).alias("list"), "slug", "rank"))

    if query.strip() and limit > 0:
        for strategy in strategies:
            if isinstance(strategy, Hybrid):
                fused_k = strategy.rrf_k
            if isinstance(strategy, FullText | Hybrid):
                add(by["text"](query, limit))
            if isinstance(strategy, Vector | Hybrid) and embedding:
                add(by["vector"](embedding, limit))
    fused = reciprocal_rank_fusion(lists, fused_k).where(F.col("rank") <= limit).select("slug", "score", "rank")
    hits = F.broadcast(fused.select("slug"))  # at most `limit` rows
    texts = current_pages(pages.select("id", "slug", "created_at", F.substring("compiled_truth", 1, SNIPPET).alias("head")).join(hits, "slug", "left_semi"), tombstones)
    shown = fused.join(texts.select("slug", snippet(F.col("head")).alias("snippet"), F.lit(True).alias("there")), "slug", "left")
    if strict:
        shown = shown.withColumn("there", F.when(F.col("there"), True).otherwise(F.raise_error(F.concat(F.lit("no such page: "), "slug")).cast("boolean")))
    return shown.where("there").select("slug", "snippet", "score", "rank")


def tokens_of(text: Column) -> Column:
    """The lower-cased runs of ASCII letters and digits of at most 40 characters; other characters separate."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) <= 40)


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """field, doc_id, length, term, tf: how often each term stands in each field of a document."""
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), tokens_of(F.col(f)).alias("tokens")) for f in fields)))
    tokens = docs.select(F.col(id_col).alias("doc_id"), each).where("size(tokens) > 0")
    terms = tokens.select("field", "doc_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return terms.groupBy("field", "doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_search(docs: DataFrame, id_col: str, fields: list[str], queries: list[tuple[str, str]], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank of the k documents that fit each query (id, text) best, by BM25 summed over the fields.

    The queries are a stated set; any of its terms may match. Score is rounded to 9 decimals, ties go to the smaller
    id. Only the documents' terms that stand in a query leave the scan.
    """
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(n, q) for n, q in queries], "query_id string, query string")
    wanted = wanted.select("query_id", F.explode(F.array_distinct(tokens_of(F.col("query")))).alias("term"))
    terms = sorted({t for _, q in queries for t in _ascii_tokens(q)})
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), tokens_of(F.col(f)).alias("tokens")) for f in fields)))
    tokens = docs.select(F.col(id_col).alias("doc_id"), each).where("size(tokens) > 0")
    # The texts are read and cut into words once; what is kept of each is its length and the words asked for.
    kept = materialize(tokens.select("field", "doc_id", F.size("tokens").alias("length"), F.filter("tokens", lambda t: t.isin(*terms) if terms else F.lit(False)).alias("terms")), "terms")
    sizes = kept.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    tf = kept.select("field", "doc_id", "length", F.explode("terms").alias("term")).groupBy("field", "doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(sizes), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scores = weighted.withColumn("weight", weight).join(F.broadcast(wanted), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 9).alias("score"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def _ascii_tokens(text: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) <= 40]
