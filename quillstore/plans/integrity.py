"""Queries p1 and p3: orphan references, and periods and gaps of validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstore.operators.intervals import interval_islands, periods_and_gaps
from quillstore.operators.orphans import orphan_references, orphan_report
from quillstore.sources.tables import read_table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    links, chunks = read_table(spark, base, "links"), read_table(spark, base, "chunks")
    pages, tombstones = read_table(spark, base, "pages"), read_table(spark, base, "page_tombstones")
    at = lambda c: F.unix_micros(c).alias("t_us")
    fields = F.inline(F.array(*(F.struct(F.lit(f).alias("ref_field"), F.lit("slug").alias("ns"), F.col(f).alias("key")) for f in ("from_slug", "to_slug"))))
    references = (
        links.select(F.lit("links").alias("src_table"), F.col("id").cast("string").alias("row_id"), at("valid_at"), fields)
        .unionByName(chunks.select(F.lit("chunks").alias("src_table"), F.col("id").alias("row_id"), at("indexed_at"), F.lit("page_id").alias("ref_field"), F.lit("id").alias("ns"), F.col("page_id").alias("key")))
    )
    gone = tombstones.groupBy(F.col("page_id").alias("id")).agg(F.min(F.unix_micros("deleted_at")).alias("to_us"))
    names = F.inline(F.array(*(F.struct(F.lit(n).alias("ns"), F.col(n).alias("key")) for n in ("slug", "id"))))
    records = pages.select("id", "slug", F.unix_micros("created_at").alias("from_us")).join(gone, "id", "left").select("from_us", "to_us", names)
    return orphan_references(references, records)


def p1_report(spark: SparkSession, base: str) -> DataFrame:
    return orphan_report(p1_found(spark, base))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    def of(table: str, keys: list[str], start: str, end: str) -> DataFrame:
        islands = interval_islands(read_table(spark, base, table), keys, start, end, row_id="id")
        return periods_and_gaps(islands, least_rows=2).select(F.lit(table).alias("src_table"), "k1", "k2", "k3", "kind", "from_us", "to_us")

    return of("links", ["from_slug", "to_slug", "edge_type"], "valid_at", "invalid_at").unionByName(of("triples", ["subject", "predicate", "object"], "valid_from", "valid_to"))


P1_SQL = """
WITH gone AS (SELECT page_id, min(deleted_at) AS d FROM page_tombstones GROUP BY page_id),
lives AS (SELECT DISTINCT p.id, p.slug, p.created_at AS c, g.d FROM pages p LEFT JOIN gone g ON g.page_id = p.id),
records AS (SELECT 'slug' AS ns, slug AS key, c, d FROM lives WHERE slug IS NOT NULL UNION ALL SELECT 'id', id, c, d FROM lives WHERE id IS NOT NULL),
refs AS (
  SELECT DISTINCT 'links' AS src_table, CAST(id AS VARCHAR) AS row_id, 'from_slug' AS ref_field, 'slug' AS ns, from_slug AS key, valid_at AS t FROM links
  UNION SELECT 'links', CAST(id AS VARCHAR), 'to_slug', 'slug', to_slug, valid_at FROM links
  UNION SELECT 'chunks', id, 'page_id', 'id', page_id, indexed_at FROM chunks),
judged AS (
  SELECT r.src_table, r.row_id, r.ref_field, r.t, count(c.key) AS n, min(c.c) AS first_c,
         coalesce(bool_or(c.c <= r.t AND (c.d IS NULL OR r.t < c.d)), false) AS alive
  FROM refs r LEFT JOIN records c ON c.ns = r.ns AND c.key = r.key
  WHERE r.key IS NOT NULL AND r.t IS NOT NULL GROUP BY ALL)
SELECT src_table, row_id, ref_field,
       CASE WHEN n = 0 THEN 'missing' WHEN first_c > t THEN 'late' ELSE 'deleted' END AS reason,
       strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period
FROM judged WHERE NOT alive
"""

P3_SQL = """
WITH r AS (
  SELECT DISTINCT 'links' AS src_table, id, from_slug AS k1, to_slug AS k2, edge_type AS k3, epoch_us(valid_at) AS s, coalesce(epoch_us(invalid_at), 9223372036854775807) AS e FROM links
  UNION SELECT 'triples', id, subject, predicate, object, epoch_us(valid_from), coalesce(epoch_us(valid_to), 9223372036854775807) FROM triples),
o AS (
  SELECT *, max(e) OVER (PARTITION BY src_table, k1, k2, k3 ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM r WHERE k1 IS NOT NULL AND k2 IS NOT NULL AND k3 IS NOT NULL AND s IS NOT NULL AND e > s),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY src_table, k1, k2, k3 ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT src_table, k1, k2, k3, 'period' AS kind, min(s) AS from_us, CASE WHEN max(e) = 9223372036854775807 THEN -1 ELSE max(e) END AS to_us
FROM n GROUP BY src_table, k1, k2, k3, island HAVING count(*) >= 2
UNION ALL SELECT src_table, k1, k2, k3, 'gap', prev, s FROM n WHERE s > prev
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found}
SQL = {
    "p1_found": P1_SQL,
    "p1_report": f"SELECT src_table, period, ref_field, reason, count(*) AS n_orphans FROM ({P1_SQL}) GROUP BY ALL",
    "p3_found": P3_SQL,
}
