"""The link graph and the triples: validity, as-of views, reverse search by hops, re-ranking by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstore.functions.text import links_in, valid_slug
from quillstore.sources.tables import materialize


def extract_links(pages: DataFrame, slug: str, body: str) -> DataFrame:
    """from_slug, to_slug of the valid slugs that each page's text refers to."""
    found = pages.select(F.col(slug).alias("from_slug"), F.explode(links_in(F.col(body), F.col(slug))).alias("to_slug"))
    return found.where(valid_slug(F.col("to_slug")))


def validity(puts: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """The puts with valid_at and invalid_at: a put ends where the next of its key begins; the last is open."""
    return puts.withColumn("valid_at", F.col(at)).withColumn("invalid_at", F.lead(at).over(Window.partitionBy(key).orderBy(*order)))


def as_of(edges: DataFrame, instant: Column, start: str = "valid_at", end: str = "invalid_at") -> DataFrame:
    """The rows that hold at an instant: they start at or before it and end, if at all, after it."""
    return edges.where((F.col(start) <= instant) & (F.col(end).isNull() | (F.col(end) > instant)))


def as_of_each(edges: DataFrame, instants: DataFrame, start: str = "valid_at", end: str = "invalid_at") -> DataFrame:
    """The rows that hold at each of the instants (column `instant`; a stated set, so it is small against the edges): one row per edge and instant."""
    moments = F.array_sort(F.array_distinct(F.array(*(F.lit(r.instant) for r in instants.toLocalIterator()))))
    held = F.filter(moments, lambda t: (F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))
    return edges.withColumn("instant", F.explode(held))


def backlinks(links: DataFrame, slug: str, only_current: bool = True) -> DataFrame:
    """id, from_slug, edge_type of the links to a slug, told once per id."""
    found = links.where(F.col("to_slug") == slug)
    if only_current:
        found = found.where("invalid_at is null")
    return found.select("id", "from_slug", "edge_type").distinct()


def bfs_backlinks(links: DataFrame, anchor: str, max_depth: int) -> DataFrame:
    """slug, distance of the pages that lead to the anchor over current links in at most `max_depth` steps, by the fewest.

    The anchor itself is left out, and slugs that aren't valid are neither found nor followed. Each step joins the
    frontier with the links, which are told apart and written once, and drops what has been reached; the frontier is
    written, so that the plan doesn't grow.
    """
    edges = links.where("invalid_at is null and from_slug is not null and to_slug is not null").where(valid_slug(F.col("from_slug"))).select("from_slug", "to_slug").distinct()
    edges = materialize(edges, "edges") if max_depth > 1 else edges
    start = links.sparkSession.range(1).select(F.lit(anchor).alias("slug"), F.lit(0).alias("distance"))
    reached, frontier = start, start
    for distance in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("slug").alias("to_slug")), "to_slug", "left_semi").select(F.col("from_slug").alias("slug")).distinct()
        frontier = materialize(step.join(reached.select("slug"), "slug", "left_anti").withColumn("distance", F.lit(distance)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.where("distance > 0")


def rerank_by_distance(hits: DataFrame, distances: DataFrame, boost: float, limit: int) -> DataFrame:
    """The best `limit` hits (slug, score, rank) by score * (1 + boost / (distance + 1)) where a distance is known, ranked anew; ties keep their order."""
    near = hits.join(distances, "slug", "left")
    score = F.when(F.col("distance").isNull(), F.col("score")).otherwise(F.col("score") * (1 + F.lit(boost) / (F.col("distance") + 1)))
    ranked = near.select("slug", score.alias("score"), F.col("rank").alias("was")).orderBy(F.desc("score"), "was").limit(limit)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "was"))).drop("was")


def close_triples(triples: DataFrame, closes: DataFrame) -> DataFrame:
    """Triples with the first close (id, closed_at) of an open one as its end; one that is closed stays as it is."""
    first = closes.groupBy("id").agg(F.min("closed_at").alias("closed_at"))
    return triples.join(first, "id", "left").withColumn("valid_to", F.coalesce("valid_to", "closed_at")).drop("closed_at")


def find_triples(triples: DataFrame, subject: str | None = None, object: str | None = None, only_current: bool = True) -> DataFrame:
    """id, subject, predicate, object, confidence, is_current of the triples with a subject or an object, exactly one of which is to be given."""
    if (subject is None) == (object is None):
        raise ValueError("give either a subject or an object")
    found = triples.where(F.col("subject") == subject if subject is not None else F.col("object") == object)
    if only_current:
        found = found.where("valid_to is null")
    return found.select("id", "subject", "predicate", "object", "confidence", F.col("valid_to").isNull().alias("is_current")).distinct()


def triple_nodes(triples: DataFrame) -> DataFrame:
    """node, kind (`subject`, `object`, `both`), degree of everything that triples name; a row of each id counts once."""
    once = triples.select("id", "subject", "object").distinct()
    ends = F.array(F.struct(F.col("subject").alias("node"), F.lit(1).alias("s"), F.lit(0).alias("o")), F.struct(F.col("object").alias("node"), F.lit(0).alias("s"), F.lit(1).alias("o")))
    nodes = once.select(F.inline(ends)).where("node is not null").groupBy("node").agg(F.max("s").alias("s"), F.max("o").alias("o"), F.count(F.lit(1)).alias("degree"))
    return nodes.select("node", F.when(F.col("s") + F.col("o") == 2, "both").when(F.col("s") == 1, "subject").otherwise("object").alias("kind"), "degree")
