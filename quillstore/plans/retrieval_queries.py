"""Queries of ranked retrieval and of the columns it uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstore.functions import text, vectors
from quillstore.operators import retrieval, store
from quillstore.plans.store_queries import _CUR, _LOW, _TRIM, _current
from quillstore.sources.tables import read_table

QUERY = "the paper"
BM25 = [("a", "the tokenisation of the garden"), ("b", "irreversible permutation"), ("c", "die Karte und das Fenster"), ("d", "Home inbox"), ("e", "!!!")]
BM25_PAGES = [("a", "the paper inbox"), ("b", "home"), ("c", "todo garden"), ("d", "!!!")]


def _embeddings(spark, base):
    return read_table(spark, base, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


def _usable_vectors(spark, base):
    return read_table(spark, base, "vectors").where(F.size("embedding") == 64).where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))).dropDuplicates(["id"])


def _queries(spark, base):
    return read_table(spark, base, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


def vector_topk_batch(spark, base):
    """Every row whose id is divisible by 100 is a query, against all rows."""
    return retrieval.vector_topk(_embeddings(spark, base), _queries(spark, base), 10, 64).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def vector_topk_after_delete(spark, base):
    left = _embeddings(spark, base)
    gone = left.where("label = 3").select("id")
    return retrieval.vector_topk(left.join(gone, "id", "left_anti"), _queries(spark, base), 10, 64).select("query_id", "id", "rank")


def cosine_neighbours(spark, base):
    """The distance of each vector of the store to the next one by id, zero vectors included."""
    rows = read_table(spark, base, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("next")), 6).alias("distance"))


def _searchable(spark, base, table):
    """id, embedding of the usable vectors of the store, each id once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = read_table(spark, base, table).where("id is not null").where((F.size("embedding") == 64) & finite & F.exists("embedding", lambda x: x != 0))
    return store.last_vectors(rows.select("id", "embedding"))


def _store_topk(table):
    def run(spark, base):
        """Every id whose MD5 is divisible by 100 is a query, against all rows."""
        known = _searchable(spark, base, table)
        asked = known.where(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 100 == 0).withColumnRenamed("id", "query_id")
        return retrieval.vector_topk(known, asked, 10, 64).select("query_id", "id", "rank")

    return run


def vector_last_wins(spark, base):
    """The vector of each page after its chunks' vectors were put one after the other: the last one, and which it came from."""
    puts = read_table(spark, base, "chunks").where("page_id is not null and embedding is not null")
    puts = puts.select(F.col("page_id").alias("id"), "embedding", F.col("indexed_at").alias("updated_at"), F.col("id").alias("chunk_id"))
    last = store.last_vectors(puts, ("updated_at", "chunk_id"))
    return last.select("id", "chunk_id", F.size("embedding").alias("dim"))


def vector_blobs(spark, base):
    """Vectors to blobs of floats and back."""
    rows = _searchable(spark, base, "vectors").select("id", vectors.encode_embedding(F.col("embedding")).alias("blob"))
    return rows.select("id", F.octet_length("blob").alias("bytes"), F.posexplode(vectors.decode_embedding(F.col("blob"), 64)).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def page_embeddings(spark, base):
    """The vector of each page's first chunk, of length 1, followed by the half of it: pages whose first chunk has one usable vector."""
    chunks = read_table(spark, base, "chunks").where("page_id is not null and ord = 0").select("id", "page_id", "ord")
    first = chunks.join(_searchable(spark, base, "chunks"), "id").distinct()
    once = first.join(first.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1"), "page_id")
    dense = vectors.dense_embedding(once, "page_id", "ord")
    both = dense.select("page_id", F.posexplode(vectors.concatenated(F.col("embedding"), vectors.scale(F.col("embedding"), 0.5))).alias("pos", "value"))
    return both.withColumn("value", F.round("value", 6))


def _ranked_lists(spark, base):
    """Two ranked lists per tag: its pages by time of their last change, and by title."""
    pages = _current(spark, base).select("id", "slug", "title", "updated_at").join(read_table(spark, base, "tags").where("tag is not null").select(F.col("page_id").alias("id"), F.col("tag").alias("query_id")).distinct(), "id")
    parts = []
    for n, order in enumerate((F.desc("updated_at"), F.asc_nulls_last("title"))):
        place = F.row_number().over(retrieval.Window.partitionBy("query_id").orderBy(order, "slug"))
        parts.append(pages.select("query_id", F.lit(n).alias("list"), "slug", place.alias("rank")))
    return parts[0].unionByName(parts[1])


def rrf_fusion(spark, base):
    return retrieval.reciprocal_rank_fusion(_ranked_lists(spark, base), 60).select("query_id", "slug", F.round("score", 9).alias("score"), "rank")


def _search(*strategies, with_vector=True):
    def run(spark, base):
        known = _usable_vectors(spark, base)
        row = known.orderBy("id").select("embedding").first()
        found = retrieval.search(read_table(spark, base, "pages"), known, QUERY, row.embedding if with_vector and row else None, 10, strategies or (retrieval.Hybrid(60),), tombstones=read_table(spark, base, "page_tombstones"))
        return found.select("slug", "snippet", F.round("score", 9).alias("score"), "rank")

    return run


def bm25_pages(spark, base):
    """Current pages by title, text and tags, with the first 200 characters of each hit."""
    tags = read_table(spark, base, "tags").where("page_id is not null and tag is not null").groupBy(F.col("page_id").alias("id")).agg(F.array_join(F.collect_set("tag"), " ").alias("tags"))
    pages = _current(spark, base).join(tags, "id", "left").select("slug", "title", F.col("compiled_truth").alias("body"), "tags")
    found = retrieval.bm25_search(pages, "slug", ["title", "body", "tags"], BM25_PAGES, 10)
    shown = pages.join(F.broadcast(found.withColumnRenamed("doc_id", "slug")), "slug")  # at most 10 rows a query
    return shown.select("query_id", "slug", F.round("score", 6).alias("score"), "rank", F.substring("body", 1, 200).alias("snippet"))


def bm25_search(spark, base):
    docs = read_table(spark, base, "documents").select("doc_id", "title", "text")
    found = retrieval.bm25_search(docs, "doc_id", ["title", "text"], BM25, 10)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def postings(spark, base):
    docs = read_table(spark, base, "documents").select("doc_id", "title", "text")
    return retrieval.postings(docs, "doc_id", ["title", "text"]).select("field", "doc_id", "length", "term", "tf")


def sanitize_query(spark, base):
    rows = read_table(spark, base, "documents").where("text is not null").select("doc_id", F.col("text").alias("q"))
    return rows.select("doc_id", text.sanitize(F.col("q")).alias("clean"))


def intent_classify(spark, base):
    return read_table(spark, base, "documents").where("title is not null").select("doc_id", text.intent(F.concat_ws(" ", "title", "text")).alias("intent"))


def page_snippets(spark, base):
    return _current(spark, base).select("slug", text.snippet(F.col("compiled_truth")).alias("snippet"))


_VEC = "CAST(embedding AS DOUBLE[])"
_TOP = """
WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[64]) AS e, label FROM embeddings),
c AS (SELECT q.id AS query_id, v.id, round(array_cosine_similarity(q.e, v.e), 9) AS s FROM v JOIN v q ON CAST(q.id AS BIGINT) % 100 = 0 {where})
SELECT query_id, id, {sim} CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM c QUALIFY rank <= 10"""
_HIT = f"coalesce({_LOW.format('compiled_truth')} LIKE '%{QUERY}%', false) OR coalesce({_LOW.format('title')} LIKE '%{QUERY}%', false)"
_KW = f"kw AS (SELECT slug, row_number() OVER (ORDER BY updated_at DESC, slug) AS rank FROM live WHERE {_HIT} QUALIFY rank <= 10)"
_NEAR = """u AS (SELECT DISTINCT id, CAST(CAST(embedding AS DOUBLE[]) AS DOUBLE[64]) AS e FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
one AS (SELECT e FROM u ORDER BY id LIMIT 1),
sim AS (SELECT u.id AS slug, round(coalesce(CASE WHEN isnan(array_cosine_similarity(u.e, one.e)) THEN 0 ELSE array_cosine_similarity(u.e, one.e) END, 0), 9) AS s FROM u, one WHERE u.id IN (SELECT slug FROM live)),
ve AS (SELECT slug, row_number() OVER (ORDER BY s DESC, slug) AS rank FROM sim QUALIFY rank <= 10)"""


def _fused(parts: str) -> str:
    return f"""WITH {_CUR}, {_KW}, {_NEAR}, f AS (SELECT slug, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM ({parts}) GROUP BY slug)
SELECT slug, {_TRIM.format('substring(compiled_truth, 1, 200)')} AS snippet, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, slug) AS INTEGER) AS rank FROM f JOIN live USING (slug) QUALIFY rank <= 10"""


def _bm25_sql(asked, source, key, fields) -> str:
    queries = " UNION ALL ".join(f"SELECT '{n}' AS query_id, '{q}' AS q" for n, q in asked)
    words = " UNION ALL ".join(f"SELECT '{f}' AS field, {key} AS doc_id, list_filter(regexp_extract_all(lower({f}), '[a-z0-9]+'), lambda t: length(t) <= 40) AS t FROM {source}" for f in fields)
    return f"""q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS term FROM ({queries})),
d AS ({words}),
f AS (SELECT * FROM d WHERE len(t) > 0), z AS (SELECT field, count(*) AS n, avg(len(t)) AS mean FROM f GROUP BY field),
tf AS (SELECT field, doc_id, len, term, count(*) AS tf FROM (SELECT field, doc_id, len(t) AS len, unnest(t) AS term FROM f) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS score
  FROM tf JOIN df USING (field, term) JOIN z USING (field) JOIN q USING (term) GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10)"""


_PAGES_TAGGED = f"""{_CUR}, g AS (SELECT page_id, string_agg(DISTINCT tag, ' ') AS tags FROM tags WHERE page_id IS NOT NULL AND tag IS NOT NULL GROUP BY page_id),
p AS (SELECT slug, title, compiled_truth AS body, tags FROM live LEFT JOIN g ON page_id = id)"""
_USABLE = """SELECT id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM {0}
  WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id"""
_TOP_STORED = """WITH u AS (SELECT id, CAST(any_value(CAST(embedding AS DOUBLE[])) AS DOUBLE[64]) AS e FROM {0}
  WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
c AS (SELECT q.id AS query_id, u.id, round(array_cosine_similarity(q.e, u.e), 9) AS s FROM u JOIN u q ON CAST('0x' || substr(md5(q.id), 1, 8) AS BIGINT) % 100 = 0)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM c QUALIFY rank <= 10"""


def _postings_sql(field: str) -> str:
    tokens = f"list_filter(regexp_extract_all(lower({field}), '[a-z0-9]+'), lambda t: length(t) <= 40)"
    return f"SELECT '{field}' AS field, doc_id, len AS length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM (SELECT doc_id, {tokens} AS t FROM documents)) GROUP BY ALL"


def _intent_sql() -> str:
    q = _LOW.format("concat_ws(' ', title, text)")
    has = lambda *w: " OR ".join(f"contains({q}, '{x}')" for x in w)
    return f"""SELECT doc_id, CASE WHEN {has('tag:')} OR starts_with({q}, '#') THEN 'tag' WHEN {has('backlink', 'links to')} THEN 'backlink'
WHEN {has('today', 'yesterday', 'timeline')} THEN 'temporal' WHEN {has('related', 'depends on', 'connects')} THEN 'relational' ELSE 'semantic' END AS intent FROM documents WHERE title IS NOT NULL"""


QUERIES = {
    "vector_topk_batch": vector_topk_batch, "vector_topk_after_delete": vector_topk_after_delete, "cosine_neighbours": cosine_neighbours,
    "rrf_fusion": rrf_fusion, "hybrid_search": _search(), "strategy_fulltext_only": _search(retrieval.FullText()), "strategy_vector_only": _search(retrieval.Vector()),
    "search_without_embedder": _search(with_vector=False), "bm25_search": bm25_search, "bm25_pages": bm25_pages,
    "vector_topk_vectors": _store_topk("vectors"), "vector_topk_chunks": _store_topk("chunks"), "vector_last_wins": vector_last_wins, "vector_blobs": vector_blobs, "page_embeddings": page_embeddings, "postings": postings,
    "sanitize_query": sanitize_query, "intent_classify": intent_classify, "page_snippets": page_snippets,
}
SQL = {
    "vector_topk_batch": _TOP.format(where="", sim="round(s, 6) AS similarity,"),
    "vector_topk_after_delete": _TOP.format(where="AND v.label IS DISTINCT FROM 3", sim=""),
    "cosine_neighbours": f"SELECT a.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "rrf_fusion": f"""WITH {_CUR}, p AS (SELECT DISTINCT t.tag AS query_id, l.slug, l.updated_at, l.title FROM live l JOIN tags t ON t.page_id = l.id WHERE t.tag IS NOT NULL),
r AS (SELECT query_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, slug) AS rank FROM p
  UNION ALL SELECT query_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY title ASC NULLS LAST, slug) AS rank FROM p),
s AS (SELECT query_id, slug, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM r GROUP BY ALL)
SELECT query_id, slug, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS INTEGER) AS rank FROM s""",
    "hybrid_search": _fused("SELECT * FROM kw UNION ALL SELECT * FROM ve"),
    "strategy_fulltext_only": _fused("SELECT * FROM kw"),
    "strategy_vector_only": _fused("SELECT * FROM ve"),
    "search_without_embedder": _fused("SELECT * FROM kw"),
    "bm25_search": f"WITH {_bm25_sql(BM25, 'documents', 'doc_id', ('title', 'text'))} SELECT * FROM r",
    "bm25_pages": f"WITH {_PAGES_TAGGED}, {_bm25_sql(BM25_PAGES, 'p', 'slug', ('title', 'body', 'tags'))} SELECT query_id, slug, score, rank, substring(body, 1, 200) AS snippet FROM r JOIN p ON slug = doc_id",
    "vector_topk_vectors": _TOP_STORED.format("vectors"),
    "vector_topk_chunks": _TOP_STORED.format("chunks"),
    "vector_blobs": f"WITH u AS ({_USABLE.format('vectors')}) SELECT id, 4 * len(e) AS bytes, CAST(i AS INTEGER) AS pos, e[i + 1] AS value FROM (SELECT id, e, unnest(range(64)) AS i FROM u)",
    "page_embeddings": f"""WITH u AS ({_USABLE.format('chunks')}), f AS (SELECT DISTINCT c.page_id, u.id, u.e FROM chunks c JOIN u USING (id) WHERE c.ord = 0 AND c.page_id IS NOT NULL),
o AS (SELECT page_id, any_value(e) AS e FROM f GROUP BY page_id HAVING count(*) = 1), n AS (SELECT page_id, e, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS n FROM o)
SELECT page_id, CAST(i AS INTEGER) AS pos, round(CASE WHEN i < 64 THEN e[i + 1] ELSE e[i - 63] / 2 END / n, 6) AS value FROM (SELECT *, unnest(range(128)) AS i FROM n)""",
    "vector_last_wins": """SELECT page_id AS id, id AS chunk_id, CAST(len(embedding) AS INTEGER) AS dim FROM chunks WHERE page_id IS NOT NULL AND embedding IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY indexed_at DESC NULLS LAST, id DESC NULLS LAST) = 1""",
    "postings": " UNION ALL ".join(_postings_sql(f) for f in ("title", "text")),
    "sanitize_query": "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_''\\- ]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS clean FROM documents WHERE text IS NOT NULL",
    "intent_classify": _intent_sql(),
    "page_snippets": f"WITH {_CUR} SELECT slug, {_TRIM.format('substring(compiled_truth, 1, 200)')} AS snippet FROM live",
}
