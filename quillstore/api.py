"""The store's seven operations for single requests, with errors that tell their kinds apart."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstore.functions.text import is_slug, links_in, valid_slug
from quillstore.operators import graph, retrieval, store
from quillstore.sources.tables import read_table


class StoreError(Exception):
    """Any failure; `code` as in JSON-RPC, `status` as in HTTP."""

    code, status = -32603, 500


class NotFound(StoreError):
    code, status = -32001, 404


class InvalidSlug(StoreError):
    code, status = -32602, 400


class BadInput(StoreError):
    code, status = -32603, 400


class Store:
    """A store in the folder `base`. `embed` turns a text into a vector of `dim` numbers; without it, search is by keyword only."""

    def __init__(self, spark: SparkSession, base: str, embed=None, dim: int = 64) -> None:
        self.spark, self.base, self.embed, self.dim = spark, base, embed, dim
        store.init_store(spark, base)

    @classmethod
    def configured(cls, spark: SparkSession, embed=None, dim: int = 64) -> Store:
        """The store in the folder that the session's `spark.quillstore.dir` names, or else the variable QUILLSTORE_DIR."""
        folder = spark.conf.get("spark.quillstore.dir", None) or os.environ.get("QUILLSTORE_DIR")
        if not folder:
            raise StoreError("set spark.quillstore.dir or QUILLSTORE_DIR")
        return cls(spark, folder, embed, dim)

    def _table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.base, name)

    def _current(self) -> DataFrame:
        return store.current_pages(self._table("pages"))

    def _slug(self, slug: Any) -> str:
        if not isinstance(slug, str) or not is_slug(slug):
            raise InvalidSlug(f"not a slug: {slug!r}")
        return slug

    def dispatch(self, name: str, args: dict[str, Any]) -> Any:
        if name not in ("get_page", "put_page", "list_pages", "search", "backlinks", "triples_add", "triples_find"):
            raise StoreError(f"unknown operation: {name}")
        return getattr(self, name)(**args)

    def get_page(self, slug: str) -> dict[str, Any]:
        row = store.get_page(self._current(), self._slug(slug)).first()
        if row is None:
            raise NotFound(slug)
        return row.asDict(recursive=True)

    def put_page(self, slug: str, body: str, title: str | None = None, scope: str | None = None, frontmatter: str | None = None) -> dict[str, Any]:
        """Append the put and its vector, which replaces the one before. Links are a view of the log: those of the put before end at this one's instant."""
        self._slug(slug)
        if scope is not None and scope not in store.SCOPES:
            raise BadInput(f"unknown scope: {scope}")
        vector = self.embed(body) if self.embed else None
        put = self.spark.createDataFrame([(slug, body, title, scope, frontmatter)], "slug string, body string, title string, scope string, frontmatter string")
        store.append(store.put_pages(put, F.current_timestamp()), self.base, "pages")
        if vector is not None:
            if len(vector) != self.dim:
                raise StoreError(f"a vector of dimension {len(vector)}, not {self.dim}")
            row = self.spark.createDataFrame([(slug, len(vector), [float(x) for x in vector])], "id string, dim int, embedding array<float>")
            store.append(row.withColumn("updated_at", F.current_timestamp()), self.base, "vectors")
        return {"ok": True, "slug": slug}

    def list_pages(self, tag: str | None = None, limit: Any = None) -> list[dict[str, Any]]:
        limit = limit if isinstance(limit, int) and not isinstance(limit, bool) and limit >= 0 else 20
        return [r.asDict() for r in store.list_pages(self._current(), limit, self._table("tags"), tag).collect()]

    def search(self, query: str, limit: Any = None) -> list[dict[str, Any]]:
        limit = limit if isinstance(limit, int) and not isinstance(limit, bool) and limit >= 0 else 10
        if not query.strip() or limit == 0:
            return []
        embedding = self.embed(query) if self.embed else None
        found = retrieval.search(self._table("pages"), self._table("vectors"), query, embedding, limit, dim=self.dim, strict=True)
        return [{"slug": r.slug, "snippet": r.snippet} for r in found.orderBy("rank").collect()]

    def links(self) -> DataFrame:
        """from_slug, to_slug, valid_at, invalid_at of all links that puts have made: a view of the page log."""
        puts = graph.validity(self._table("pages"), "slug", "created_at", ["created_at", "id"])
        found = puts.select(F.col("slug").alias("from_slug"), F.explode(links_in(F.col("compiled_truth"), F.col("slug"))).alias("to_slug"), "valid_at", "invalid_at")
        return found.where(valid_slug(F.col("to_slug")))

    def backlinks(self, slug: str) -> list[dict[str, Any]]:
        found = graph.extract_links(self._current(), "slug", "compiled_truth").where(F.col("to_slug") == self._slug(slug))
        return [{"from_slug": r.from_slug, "edge_type": "mentions"} for r in found.orderBy("from_slug").collect()]

    def triples_add(self, subject: str, predicate: str, object: str, confidence: float = 1.0) -> dict[str, Any]:
        """The id is the greatest so far and one more, so there may be one writer at a time."""
        log = self._table("triples")
        number = (log.agg(F.max("id")).first()[0] or 0) + 1
        row = self.spark.range(1).select(F.lit(number).alias("id"), F.lit(subject).alias("subject"), F.lit(predicate).alias("predicate"), F.lit(object).alias("object"), F.current_timestamp().alias("valid_from"), F.lit(None).alias("valid_to"), F.lit(float(confidence)).alias("confidence"), F.lit(None).alias("source_slug"), F.lit(None).alias("source_file"), F.current_timestamp().alias("extracted_at"))
        store.append(row, self.base, "triples")
        return {"id": number}

    def triples_find(self, subject: str | None = None, object: str | None = None) -> list[dict[str, Any]]:
        if (subject is None) == (object is None):
            raise BadInput("give either a subject or an object")
        return [r.asDict() for r in graph.find_triples(self._table("triples"), subject, object).orderBy("id").collect()]
