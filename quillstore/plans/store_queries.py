"""Queries over the page store, its links and triples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstore.functions.text import fingerprint, trimmed, uuid_of, valid_slug
from quillstore.operators import graph, store
from quillstore.sources.tables import read_table, shared_folder

HOME, TAG, INSTANT, RULES_FROM = "index/home", "inbox", "2024-06-01 00:00:00", "2024-09-01 00:00:00"


def _current(spark: SparkSession, base: str) -> DataFrame:
    return store.current_pages(read_table(spark, base, "pages"), read_table(spark, base, "page_tombstones"))


def _links(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "links")


def current_pages(spark, base):
    return _current(spark, base).select("slug", "id", "scope", "title", F.unix_micros("updated_at").alias("updated_us"))


def list_pages(spark, base):
    return store.list_pages(_current(spark, base))


def list_pages_by_tag(spark, base):
    return store.list_pages(_current(spark, base), 20, read_table(spark, base, "tags"), TAG)


def get_page(spark, base):
    found = store.get_page(_current(spark, base), HOME)
    return found.select("slug", "scope", "title", "compiled_truth", F.array_join("timeline", "|").alias("timeline"), "frontmatter")


def put_documents(spark, base):
    """The documents as puts of a log of their own, and the pages that are current in it."""
    puts = read_table(spark, base, "documents").where("doc_id is not null")
    puts = puts.select(F.concat(F.lit("docs/"), F.col("doc_id")).alias("slug"), F.col("text").alias("body"), "title", F.lit(None).cast("string").alias("scope"), F.lit("null").alias("frontmatter"), "added_at")
    folder = f"{shared_folder(spark)}/quillstore-puts-{uuid.uuid4().hex}"
    store.append(store.put_pages(puts, F.col("added_at")), folder, "pages")
    pages = store.current_pages(read_table(spark, folder, "pages"))
    return pages.select("slug", "scope", "title", F.length("compiled_truth").alias("n_chars"), F.size("timeline").alias("n_timeline"), "frontmatter")


def page_scopes(spark, base):
    rows = read_table(spark, base, "pages").select("id", "scope").distinct()
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n_pages"), F.first(F.coalesce(F.col("scope").isin(*store.SCOPES), F.lit(False))).alias("known"))


def slug_validation(spark, base):
    slugs = read_table(spark, base, "pages").select("slug").union(_links(spark, base).select("to_slug")).distinct()
    return slugs.where("slug is not null").select("slug", valid_slug(F.col("slug")).alias("valid"))


def tag_counts(spark, base):
    tags = read_table(spark, base, "tags").select("page_id", F.lower(trimmed(F.col("tag"))).alias("tag")).distinct()
    return tags.where("tag is not null").groupBy("tag").agg(F.count(F.lit(1)).alias("n_pages"))


def frontmatter_owner(spark, base):
    value = F.try_variant_get(F.try_parse_json(F.col("frontmatter")), "$.owner", "string")
    return _current(spark, base).where("frontmatter is not null").select("slug", value.alias("owner"))


def keyword(query: str):
    def run(spark: SparkSession, base: str) -> DataFrame:
        return store.keyword_search(read_table(spark, base, "pages"), query, 10, read_table(spark, base, "page_tombstones"))

    return run


def keyword_matches(spark, base):
    """Every current page that holds the pattern, as the search finds it before its limit."""
    found = _current(spark, base).where(store.ascii_lower(F.col("compiled_truth")).like("%the paper%") | store.ascii_lower(F.col("title")).like("%the paper%"))
    return found.select("slug")


def put_intervals(spark, base):
    puts = read_table(spark, base, "pages").select("id", "slug", "created_at").distinct()
    return graph.validity(puts, "slug", "created_at", ["created_at", "id"]).select("id", "slug", F.unix_micros("valid_at").alias("valid_us"), F.unix_micros("invalid_at").alias("invalid_us"))


def links_as_of(spark, base):
    found = graph.as_of(_links(spark, base), F.lit(INSTANT).cast("timestamp"))
    return found.select("id", "from_slug", "to_slug", "edge_type").distinct()


def links_as_of_months(spark, base):
    instants = spark.sql("SELECT explode(sequence(timestamp'2024-01-01', timestamp'2024-12-01', interval 1 month)) AS instant")
    found = graph.as_of_each(_links(spark, base).select("id", "edge_type", "valid_at", "invalid_at").distinct(), instants)
    return found.groupBy(F.unix_micros("instant").alias("instant_us"), "edge_type").agg(F.count(F.lit(1)).alias("n_links"))


def backlinks_current(spark, base):
    return graph.backlinks(_links(spark, base), HOME).select("id", "from_slug", "edge_type")


def backlinks_all(spark, base):
    return graph.backlinks(_links(spark, base), HOME, only_current=False)


def extract_links(spark, base):
    docs = read_table(spark, base, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id")).alias("slug"), "text")
    return graph.extract_links(docs, "slug", "text")


def page_links(spark, base):
    return graph.extract_links(_current(spark, base), "slug", "compiled_truth")


def bfs_backlinks(spark, base):
    return graph.bfs_backlinks(_links(spark, base), HOME, 3)


def backlink_hop_limit(spark, base):
    return graph.bfs_backlinks(_links(spark, base), HOME, 2).orderBy("distance", "slug").limit(50)


def graph_rerank(spark, base):
    hits = store.keyword_search(read_table(spark, base, "pages"), "the", 50, read_table(spark, base, "page_tombstones")).select("slug", (1.0 / (60 + F.col("rank"))).alias("score"), "rank")
    ranked = graph.rerank_by_distance(hits, graph.bfs_backlinks(_links(spark, base), HOME, 3), 0.5, 50)
    return ranked.select("slug", F.round("score", 9).alias("score"), "rank")


def _confidence():
    """Null where it is not a number."""
    return F.when(~F.isnan("confidence"), F.round(F.col("confidence").cast("double"), 6)).alias("confidence")


def _most_named(triples: DataFrame, column: str) -> str:
    return triples.where(F.col(column).isNotNull()).groupBy(column).agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), column).first()[0]


def triples_by_subject(spark, base):
    triples = read_table(spark, base, "triples")
    return graph.find_triples(triples, subject=_most_named(triples, "subject")).select("id", "subject", "predicate", "object", _confidence(), "is_current")


def triples_by_object(spark, base):
    triples = read_table(spark, base, "triples")
    return graph.find_triples(triples, object=_most_named(triples, "object"), only_current=False).select("id", "subject", "predicate", "object", _confidence(), "is_current")


def triples_current(spark, base):
    return read_table(spark, base, "triples").where("valid_to is null").select("id", "subject", "predicate", "object").distinct()


def triples_closed(spark, base):
    triples = read_table(spark, base, "triples").select("id", "subject", "predicate", "object", "valid_from", "valid_to", "extracted_at").distinct()
    closes = triples.where("object is not null").select((F.col("id") - 1).alias("id"), F.col("extracted_at").alias("closed_at"))
    return graph.close_triples(triples, closes).select("id", F.unix_micros("valid_to").alias("valid_to_us"))


def triple_nodes(spark, base):
    return graph.triple_nodes(read_table(spark, base, "triples"))


def skip_gate(spark, base):
    pages = read_table(spark, base, "pages").where("slug is not null and content_fp is not null")
    current = store.last_per_key(pages, ["slug"], ["created_at", "id"])
    earlier = pages.join(current.select("id"), "id", "left_anti")
    return store.changed_sources(current, earlier, ["slug", "content_fp"]).select("slug", F.hex("content_fp").alias("fp"))


def skip_gate_logic(spark, base):
    """Sources to be indexed again: since the put before, their time, content or the indexing rules (others from RULES_FROM on) have changed."""
    rules = fingerprint(F.when(F.col("created_at") < F.lit(RULES_FROM).cast("timestamp"), "rules-1").otherwise("rules-2"))
    puts = read_table(spark, base, "pages").where("slug is not null and content_fp is not null")
    puts = puts.select("slug", F.unix_micros("updated_at").alias("mtime_us"), "content_fp", rules.alias("logic_fp"), "created_at", "id").distinct()
    current = store.last_per_key(puts, ["slug"], ["created_at", "id"])
    stored = store.last_per_key(puts.join(current.select("id"), "id", "left_anti"), ["slug"], ["created_at", "id"])
    return store.changed_sources(current, stored, ["slug", "mtime_us", "content_fp", "logic_fp"]).select("slug", "mtime_us", F.hex("content_fp").alias("fp"))


def memo_last_wins(spark, base):
    puts = read_table(spark, base, "pages").where("content_fp is not null").select("content_fp", F.col("id").alias("payload"), "created_at")
    return store.last_per_key(puts, ["content_fp"], ["created_at", "payload"]).select(F.hex("content_fp").alias("fp"), "payload")


def source_versions(spark, base):
    """The last version of each source: its time of change and its fingerprint."""
    puts = read_table(spark, base, "pages").where("slug is not null").select("slug", "updated_at", "content_fp", "created_at", "id")
    return store.last_per_key(puts, ["slug"], ["created_at", "id"]).select("slug", F.unix_micros("updated_at").alias("mtime_us"), F.hex("content_fp").alias("fp"))


def stale_fingerprints(spark, base):
    pages = read_table(spark, base, "pages").dropDuplicates(["id"]).select("id", "content_fp", "compiled_truth")
    return pages.withColumn("fp", fingerprint(F.col("compiled_truth"))).where(~F.col("content_fp").eqNullSafe(F.col("fp"))).select("id", F.hex("fp").alias("fp"), uuid_of(F.col("fp")).alias("uuid"))


_CUR = """cur AS (SELECT * FROM (SELECT DISTINCT ON (id) * FROM pages) p WHERE slug IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY slug ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
live AS (SELECT * FROM cur WHERE id NOT IN (SELECT page_id FROM page_tombstones WHERE deleted_at IS NOT NULL AND page_id IS NOT NULL))"""
_TRIM = "regexp_replace({}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_VALID = "regexp_full_match({0}, '[A-Za-z0-9_./-]+') AND NOT starts_with({0}, '/') AND NOT ends_with({0}, '/')"
_BFS = f"""e AS (SELECT DISTINCT from_slug, to_slug FROM links WHERE invalid_at IS NULL AND from_slug IS NOT NULL AND {_VALID.format('from_slug')}),
w AS (SELECT '{HOME}' AS slug, 0 AS distance UNION SELECT e.from_slug, w.distance + 1 FROM w JOIN e ON e.to_slug = w.slug WHERE w.distance < %d),
d AS (SELECT slug, min(distance) AS distance FROM w GROUP BY slug HAVING min(distance) > 0)"""


def _keyword_sql(pattern: str, limit: int = 10) -> str:
    hit = f"coalesce({_LOW.format('compiled_truth')} LIKE '%{pattern}%', false) OR coalesce({_LOW.format('title')} LIKE '%{pattern}%', false)"
    return f"WITH {_CUR} SELECT slug, {_TRIM.format('substring(compiled_truth, 1, 200)')} AS snippet, CAST(row_number() OVER (ORDER BY updated_at DESC, slug) AS INTEGER) AS rank FROM live WHERE {hit} ORDER BY updated_at DESC, slug LIMIT {limit}"


def _links_sql(source: str, body: str, table: str) -> str:
    return f"""
WITH {_CUR}, p AS (SELECT DISTINCT {source} AS slug, {body} AS body FROM {table}),
x AS (SELECT slug, unnest(regexp_extract_all(body, '\\[\\[([A-Za-z0-9_/.\\-]+)\\]\\]', 1)) AS t, false AS inl FROM p
  UNION ALL SELECT slug, unnest(regexp_extract_all(body, '\\[[^\\]]*\\]\\(\\.?/?([A-Za-z0-9_/\\-]+?)(?:\\.md)?\\)', 1)), true FROM p)
SELECT DISTINCT slug AS from_slug, t AS to_slug FROM x WHERE t <> slug AND NOT (inl AND starts_with(t, 'http')) AND {_VALID.format('t')}"""


QUERIES = {
    "current_pages": current_pages, "list_pages": list_pages, "list_pages_by_tag": list_pages_by_tag, "get_page": get_page,
    "put_documents": put_documents, "page_scopes": page_scopes, "slug_validation": slug_validation, "tag_counts": tag_counts, "frontmatter_owner": frontmatter_owner,
    "keyword_search": keyword("The paper"), "keyword_search_wildcard": keyword("the _aper"), "keyword_empty_query": keyword("!!!"), "keyword_matches": keyword_matches,
    "put_intervals": put_intervals, "links_as_of": links_as_of, "links_as_of_months": links_as_of_months,
    "backlinks_current": backlinks_current, "backlinks_all": backlinks_all, "extract_links": extract_links, "page_links": page_links,
    "bfs_backlinks": bfs_backlinks, "backlink_hop_limit": backlink_hop_limit, "graph_rerank": graph_rerank,
    "triples_by_subject": triples_by_subject, "triples_by_object": triples_by_object, "triples_current": triples_current, "triples_closed": triples_closed,
    "triple_nodes": triple_nodes, "skip_gate": skip_gate, "skip_gate_logic": skip_gate_logic, "memo_last_wins": memo_last_wins, "source_versions": source_versions, "stale_fingerprints": stale_fingerprints,
}

_MOST = "SELECT {0} FROM triples WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(DISTINCT id) DESC, {0} LIMIT 1"
_TRIPLE = "id, subject, predicate, object, CASE WHEN NOT isnan(confidence) THEN round(CAST(confidence AS DOUBLE), 6) END AS confidence, valid_to IS NULL AS is_current"
SQL = {
    "current_pages": f"WITH {_CUR} SELECT slug, id, scope, title, epoch_us(updated_at) AS updated_us FROM live",
    "list_pages": f"WITH {_CUR} SELECT slug, scope, title FROM live ORDER BY updated_at DESC, slug LIMIT 20",
    "list_pages_by_tag": f"WITH {_CUR} SELECT slug, scope, title FROM live WHERE id IN (SELECT page_id FROM tags WHERE tag = '{TAG}') ORDER BY updated_at DESC, slug LIMIT 20",
    "get_page": f"WITH {_CUR} SELECT slug, scope, title, compiled_truth, array_to_string(timeline, '|') AS timeline, frontmatter FROM live WHERE slug = '{HOME}'",
    "put_documents": "SELECT DISTINCT 'docs/' || doc_id AS slug, 'concept' AS scope, title, CAST(length(text) AS INTEGER) AS n_chars, 0 AS n_timeline, CAST(NULL AS VARCHAR) AS frontmatter FROM documents WHERE doc_id IS NOT NULL",
    "page_scopes": "SELECT scope, count(*) AS n_pages, coalesce(scope IN ('project', 'concept', 'reference', 'person', 'plan'), false) AS known FROM (SELECT DISTINCT id, scope FROM pages) GROUP BY scope",
    "slug_validation": f"SELECT slug, {_VALID.format('slug')} AS valid FROM (SELECT slug FROM pages UNION SELECT to_slug FROM links) WHERE slug IS NOT NULL",
    "tag_counts": f"SELECT tag, count(*) AS n_pages FROM (SELECT DISTINCT page_id, lower({_TRIM.format('tag')}) AS tag FROM tags) WHERE tag IS NOT NULL GROUP BY tag",
    "frontmatter_owner": f"WITH {_CUR} SELECT slug, CASE WHEN json_valid(frontmatter) THEN json_extract_string(frontmatter, '$.owner') END AS owner FROM live WHERE frontmatter IS NOT NULL",
    "keyword_search": _keyword_sql("the paper"),
    "keyword_search_wildcard": _keyword_sql("the _aper"),
    "keyword_empty_query": _keyword_sql(""),
    "keyword_matches": f"WITH {_CUR} SELECT slug FROM live WHERE {_LOW.format('compiled_truth')} LIKE '%the paper%' OR {_LOW.format('title')} LIKE '%the paper%'",
    "put_intervals": "SELECT id, slug, epoch_us(created_at) AS valid_us, lead(epoch_us(created_at)) OVER (PARTITION BY slug ORDER BY created_at, id) AS invalid_us FROM (SELECT DISTINCT id, slug, created_at FROM pages)",
    "links_as_of": f"SELECT DISTINCT id, from_slug, to_slug, edge_type FROM links WHERE valid_at <= TIMESTAMPTZ '{INSTANT}+00' AND (invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '{INSTANT}+00')",
    "links_as_of_months": """SELECT epoch_us(t) AS instant_us, edge_type, count(*) AS n_links
FROM (SELECT DISTINCT id, edge_type, epoch_us(valid_at) AS a, epoch_us(invalid_at) AS z FROM links),
  (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-02', INTERVAL 1 MONTH)) AS t)
WHERE a <= epoch_us(t) AND (z IS NULL OR z > epoch_us(t)) GROUP BY ALL""",
    "backlinks_current": f"SELECT DISTINCT id, from_slug, edge_type FROM links WHERE to_slug = '{HOME}' AND invalid_at IS NULL",
    "backlinks_all": f"SELECT DISTINCT id, from_slug, edge_type FROM links WHERE to_slug = '{HOME}'",
    "extract_links": _links_sql("'docs/' || doc_id", "text", "documents"),
    "page_links": _links_sql("slug", "compiled_truth", "live"),
    "bfs_backlinks": f"WITH RECURSIVE {_BFS % 3} SELECT slug, distance FROM d",
    "backlink_hop_limit": f"WITH RECURSIVE {_BFS % 2} SELECT slug, distance FROM d ORDER BY distance, slug LIMIT 50",
    "graph_rerank": f"""WITH RECURSIVE {_BFS % 3}, k AS ({_keyword_sql('the', 50)}),
s AS (SELECT k.slug, (1.0::DOUBLE / (60 + rank)) * CASE WHEN distance IS NULL THEN 1.0::DOUBLE ELSE 1 + 0.5::DOUBLE / (distance + 1) END AS score, rank FROM k LEFT JOIN d USING (slug))
SELECT slug, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, rank) AS INTEGER) AS rank FROM s""",
    "triples_by_subject": f"SELECT DISTINCT {_TRIPLE} FROM triples WHERE valid_to IS NULL AND subject = ({_MOST.format('subject')})",
    "triples_by_object": f"SELECT DISTINCT {_TRIPLE} FROM triples WHERE object = ({_MOST.format('object')})",
    "triples_current": "SELECT DISTINCT id, subject, predicate, object FROM triples WHERE valid_to IS NULL",
    "triples_closed": """WITH t AS (SELECT DISTINCT id, object, valid_to, extracted_at FROM triples),
c AS (SELECT id - 1 AS id, min(extracted_at) AS at FROM t WHERE object IS NOT NULL GROUP BY ALL)
SELECT DISTINCT t.id, epoch_us(coalesce(t.valid_to, c.at)) AS valid_to_us FROM t LEFT JOIN c USING (id)""",
    "triple_nodes": """WITH t AS (SELECT DISTINCT id, subject, object FROM triples), n AS (SELECT subject AS node, 1 AS s, 0 AS o FROM t UNION ALL SELECT object, 0, 1 FROM t)
SELECT node, CASE WHEN max(s) + max(o) = 2 THEN 'both' WHEN max(s) = 1 THEN 'subject' ELSE 'object' END AS kind, count(*) AS degree FROM n WHERE node IS NOT NULL GROUP BY node""",
    "skip_gate": """WITH p AS (SELECT DISTINCT id, slug, hex(content_fp) AS fp, created_at FROM pages WHERE slug IS NOT NULL AND content_fp IS NOT NULL),
c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY slug ORDER BY created_at DESC NULLS LAST, id DESC) = 1)
SELECT slug, fp FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.slug = c.slug AND p.fp = c.fp AND p.id <> c.id)""",
    "skip_gate_logic": f"""WITH p AS (SELECT DISTINCT id, slug, epoch_us(updated_at) AS mtime_us, hex(content_fp) AS fp, created_at, coalesce(created_at < TIMESTAMPTZ '{RULES_FROM}+00', false) AS logic FROM pages WHERE slug IS NOT NULL AND content_fp IS NOT NULL),
c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY slug ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
v AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM c) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY created_at DESC NULLS LAST, id DESC) = 1)
SELECT slug, mtime_us, fp FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.slug = c.slug AND v.mtime_us = c.mtime_us AND v.fp = c.fp AND v.logic = c.logic)""",
    "source_versions": f"WITH {_CUR} SELECT slug, epoch_us(updated_at) AS mtime_us, hex(content_fp) AS fp FROM cur",
    "memo_last_wins": "SELECT fp, payload FROM (SELECT DISTINCT hex(content_fp) AS fp, id AS payload, created_at FROM pages WHERE content_fp IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY fp ORDER BY created_at DESC NULLS LAST, payload DESC) = 1",
}
