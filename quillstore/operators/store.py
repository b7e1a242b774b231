"""The page store: an append-only log of puts, and everything that is current derived from it."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstore.functions.text import NOT_IN_QUERIES, SNIPPET, fingerprint, snippet

#: The scopes of pages, and the one of a put that names none.
SCOPES = ("project", "concept", "reference", "person", "plan")
DEFAULT_SCOPE = "concept"

_TS, _STR = T.TimestampType(), T.StringType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: The tables of a store.
SCHEMAS = {
    "pages": _schema(id=_STR, slug=_STR, scope=_STR, title=_STR, compiled_truth=_STR, timeline=T.ArrayType(_STR), frontmatter=_STR, content_fp=T.BinaryType(), created_at=_TS, updated_at=_TS),
    "chunks": _schema(id=_STR, page_id=_STR, ord=T.IntegerType(), body=_STR, content_fp=T.BinaryType(), simhash=T.LongType(), embedding=T.ArrayType(T.FloatType())),
    "tags": _schema(page_id=_STR, tag=_STR),
    "links": _schema(id=T.LongType(), from_slug=_STR, to_slug=_STR, edge_type=_STR, valid_at=_TS, invalid_at=_TS),
    "triples": _schema(id=T.LongType(), subject=_STR, predicate=_STR, object=_STR, valid_from=_TS, valid_to=_TS, confidence=T.FloatType(), source_slug=_STR, source_file=_STR, extracted_at=_TS),
    "source_versions": _schema(slug=_STR, mtime_us=T.LongType(), content_fp=T.BinaryType(), logic_fp=T.BinaryType()),
    "eval_memo": _schema(content_fp=T.BinaryType(), kind=_STR, payload=T.BinaryType(), created_at=T.LongType()),
    "vectors": _schema(id=_STR, dim=T.IntegerType(), embedding=T.ArrayType(T.FloatType()), updated_at=_TS),
}


def init_store(spark: SparkSession, base: str) -> None:
    """Create the tables that aren't there yet, empty; existing ones stay as they are."""
    for name, schema in SCHEMAS.items():
        try:
            spark.read.parquet(f"{base}/{name}.parquet")
        except AnalysisException:
            spark.createDataFrame([], schema).write.parquet(f"{base}/{name}.parquet")


def append(df: DataFrame, base: str, table: str) -> None:
    """Add rows to a table's log; columns are taken by name and cast to the table's types."""
    df.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[table].fields)).write.mode("append").parquet(f"{base}/{table}.parquet")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest `order` columns per key. Spark prunes the losers before the shuffle, so a hot key moves one row per task."""
    latest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")


def current_pages(pages: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """One row per slug: its last put. A slug whose last put is deleted has none; a put replaces the ones before for good."""
    latest = last_per_key(pages, ["slug"], ["created_at", "id"]).where("slug is not null")
    if tombstones is None:
        return latest
    gone = tombstones.where("deleted_at is not null").select(F.col("page_id").alias("id")).distinct()
    return latest.join(gone, "id", "left_anti")


def list_pages(current: DataFrame, limit: int = 20, tags: DataFrame | None = None, tag: str | None = None) -> DataFrame:
    """slug, scope, title of the newest pages, optionally of those with a tag; ties by slug."""
    if tag is not None:
        current = current.join(tags.where(F.col("tag") == tag).select(F.col("page_id").alias("id")), "id", "left_semi")
    return current.orderBy(F.desc("updated_at"), "slug").limit(limit).select("slug", "scope", "title")


def get_page(current: DataFrame, slug: str) -> DataFrame:
    """The visible columns of a page: neither its id, nor its fingerprint and times."""
    return current.where(F.col("slug") == slug).select("slug", "scope", "title", "compiled_truth", "timeline", "frontmatter")


def ascii_lower(column: Column) -> Column:
    """Lower case of A-Z only; accented capitals stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyword_hit(query: str) -> Column:
    """Whether a page has the sanitized query in its text or title.

    The query is one contiguous pattern, in which `_` stands for any character; case is folded for ASCII only. A query
    without any letter or digit left matches every page with a text or title.
    """
    pattern = "%" + sanitize_text(query).translate({c: c + 32 for c in range(65, 91)}) + "%"
    return F.coalesce(ascii_lower(F.col("compiled_truth")).like(pattern), F.lit(False)) | F.coalesce(ascii_lower(F.col("title")).like(pattern), F.lit(False))


def keyword_search(pages: DataFrame, query: str, limit: int = 10, tombstones: DataFrame | None = None) -> DataFrame:
    """slug, snippet, rank of the newest current pages with a `keyword_hit`, from the log of puts.

    The hit is told, and the first characters are taken, where the text is read, so that no text is shuffled to find the last put of a slug.
    """
    narrow = pages.select("id", "slug", "created_at", "updated_at", F.substring("compiled_truth", 1, SNIPPET).alias("head"), keyword_hit(query).alias("hit"))
    top = current_pages(narrow, tombstones).where("hit").orderBy(F.desc("updated_at"), "slug").limit(limit)
    return top.select("slug", snippet(F.col("head")).alias("snippet"), F.row_number().over(Window.orderBy(F.desc("updated_at"), "slug")).alias("rank"))


def sanitize_text(query: str) -> str:
    """`sanitize` for one string on the driver."""
    return re.sub(" +", " ", re.sub(NOT_IN_QUERIES, " ", query)).strip(" ")


def last_vectors(vectors: DataFrame, order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The vector of each id that was put last, by those of the `order` columns that there are; repeated deliveries count once."""
    known = [c for c in order if c in vectors.columns]
    return last_per_key(vectors.withColumn("_tie", F.xxhash64("embedding")), ["id"], [*known, "_tie"]).drop("_tie")


def changed_sources(current: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """The skip gate: rows of which no version with equal `keys` is known, so that only these are indexed again."""
    return current.join(versions.select(*keys).distinct(), keys, "left_anti")


def put_pages(puts: DataFrame, at: Column) -> DataFrame:
    """Rows for the page log from puts (slug, body, title, scope, frontmatter): new ids, no timeline, the default scope, JSON nulls dropped."""
    return puts.select(
        F.uuid().alias("id"),
        "slug",
        F.coalesce(F.col("scope"), F.lit(DEFAULT_SCOPE)).alias("scope"),
        "title",
        F.col("body").alias("compiled_truth"),
        F.array().cast("array<string>").alias("timeline"),
        F.when(F.col("frontmatter") != "null", F.col("frontmatter")).alias("frontmatter"),
        fingerprint(F.col("body")).alias("content_fp"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )

