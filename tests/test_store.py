from __future__ import annotations

import struct
import tempfile
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstore import api
from quillstore.operators import graph, indexing, retrieval, store
from quillstore.sources import tables
from quillstore.sources.markdown import read_markdown
from quillstore.sources.tensors import TensorFileError, read_tensors
from quillstore.streaming import logs

PAGES = store.SCHEMAS["pages"].simpleString()
T0 = datetime(2024, 1, 1)


def folder():
    return tempfile.mkdtemp(prefix="spark-store-", dir="/tmp")


def test_facade_round_trip(spark):
    s = api.Store(spark, folder(), embed=lambda t: [float(len(t)), 1.0], dim=2)
    assert s.dispatch("put_page", {"slug": "alpha", "body": "see [[beta]]", "title": "A"}) == {"ok": True, "slug": "alpha"}
    s.put_page("beta", "other text")
    page = s.get_page("alpha")
    assert (page["scope"], page["timeline"], page["compiled_truth"]) == ("concept", [], "see [[beta]]")
    assert "content_fp" not in page
    assert s.backlinks("beta") == [{"from_slug": "alpha", "edge_type": "mentions"}]
    assert [p["slug"] for p in s.list_pages(limit="x")] == ["beta", "alpha"]
    assert s.search("see")[0]["slug"] == "alpha"
    assert s.search(" ") == [] and s.search("see", 0) == []
    s.put_page("alpha", "nothing")
    assert s.backlinks("beta") == []
    assert s.links().where("invalid_at is not null").count() == 1
    assert s.triples_add("a", "knows", "b", 0.7) == {"id": 1} and s.triples_add("c", "knows", "b") == {"id": 2}
    assert [t["id"] for t in s.triples_find(object="b")] == [1, 2]
    for error, call in ((api.NotFound, lambda: s.get_page("gamma")), (api.InvalidSlug, lambda: s.get_page("/x")), (api.BadInput, lambda: s.triples_find()), (api.StoreError, lambda: s.dispatch("drop", {}))):
        with pytest.raises(error):
            call()


def test_a_put_replaces_the_vector_of_the_one_before(spark):
    s = api.Store(spark, folder(), embed=lambda t: [float(t.count("x")), float(t.count("y"))], dim=2)
    s.put_page("a", "x")
    s.put_page("b", "x y")
    assert s.search("xx")[0]["slug"] == "a"
    s.put_page("a", "y")
    vectors = store.last_vectors(s._table("vectors"))
    assert {(r.id, tuple(r.embedding)) for r in vectors.collect()} == {("a", (0.0, 1.0)), ("b", (1.0, 1.0))}
    found = retrieval.search(s._table("pages"), s._table("vectors"), "none", [1.0, 0.0], 5, (retrieval.Vector(),), dim=2)
    assert [r.slug for r in found.orderBy("rank").collect()] == ["b", "a"]
    with pytest.raises(api.StoreError):
        api.Store(spark, s.base, embed=lambda t: [1.0], dim=2).put_page("c", "x")
    with pytest.raises(Exception, match="dimension"):
        retrieval.search(s._table("pages"), s._table("vectors"), "x", [1.0, 0.0, 0.0], 5, dim=3).collect()
    gone = spark.createDataFrame([(r.id, "b", T0) for r in s._table("pages").where("slug = 'b'").collect()], "page_id string, slug string, deleted_at timestamp")
    how = dict(query="none", embedding=[1.0, 0.0], limit=5, strategies=(retrieval.Vector(),), dim=2, tombstones=gone)
    assert [r.slug for r in retrieval.search(s._table("pages"), s._table("vectors"), **how).collect()] == ["a"]
    with pytest.raises(Exception, match="no such page"):
        retrieval.search(s._table("pages"), s._table("vectors"), strict=True, **how).collect()


def test_a_backend_of_ones_own(spark):
    pages = spark.createDataFrame([(i, i, "concept", None, f"text {i}", None, None, None, T0, T0) for i in "abc"], PAGES)
    own = lambda query, limit: spark.createDataFrame([("c", 1), ("a", 2)], "slug string, rank int")
    found = retrieval.search(pages, spark.createDataFrame([], store.SCHEMAS["vectors"]), "zzz", strategies=(retrieval.FullText(),), backends={"text": own})
    assert [(r.slug, r.snippet) for r in found.orderBy("rank").collect()] == [("c", "text c"), ("a", "text a")]


def test_rows_later_than_the_watermark_are_dropped(spark):
    base = folder()
    days = [[0, 1, 1, 9], [9], [8, 1, 30], [30], [9, 29]]  # a watermark counts for late rows from the batch after the next on
    for n, file in enumerate(days):
        rows = spark.createDataFrame([("x", T0 + timedelta(days=d)) for d in file], "event_type string, ts timestamp").coalesce(1)
        rows.write.mode("append").parquet(f"{base}/events.parquet")
    stream = logs.table_stream(spark, base, "events", spark.read.parquet(f"{base}/events.parquet").schema, files=1)
    counts = logs.windowed_counts(stream, "ts", "1 day", "event_type", "2 days")
    path = f"{base}/states"
    counts.writeStream.outputMode("update").foreachBatch(lambda batch, n: logs.replace_batch(batch, path, n)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema("window_start timestamp, event_type string, n bigint, batch int").option("basePath", path).parquet(path)
    last = {(r.window_start - T0).days: r.n for r in states.groupBy("window_start").agg(F.max_by("n", "batch").alias("n")).collect()}
    assert last == {0: 1, 1: 2, 9: 2, 8: 1, 30: 2, 29: 1}


def test_a_configured_store(spark, monkeypatch):
    monkeypatch.delenv("QUILLSTORE_DIR", raising=False)
    with pytest.raises(api.StoreError):
        api.Store.configured(spark)
    monkeypatch.setenv("QUILLSTORE_DIR", place := folder())
    api.Store.configured(spark).put_page("a", "x")
    assert api.Store(spark, place).get_page("a")["compiled_truth"] == "x"


def test_scratch_tables_can_be_cleared(spark):
    df = tables.materialize(spark.range(3), "test")
    path = Path(tables._WRITTEN[-1].removeprefix("file://"))
    assert df.count() == 3 and path.exists()
    kept, tables._WRITTEN[:] = tables._WRITTEN[:-1], tables._WRITTEN[-1:]
    tables.clear_scratch(spark)
    tables._WRITTEN[:] = kept
    assert not path.exists()


def test_current_pages(spark):
    rows = [("1", "a", 0), ("2", "a", 1), ("2", "a", 1), ("3", "b", 0), ("4", None, 0)]
    pages = spark.createDataFrame([(i, s, "concept", None, "x", None, None, None, T0 + timedelta(days=d), None) for i, s, d in rows], PAGES)
    gone = spark.createDataFrame([("3", "b", T0), ("2", "a", None)], "page_id string, slug string, deleted_at timestamp")
    assert [(r.slug, r.id) for r in store.current_pages(pages, gone).collect()] == [("a", "2")]


def test_keyword_search_folds_ascii_only(spark):
    pages = spark.createDataFrame([(str(i), f"s{i}", "concept", t, b, None, None, None, T0, T0 + timedelta(days=i)) for i, (t, b) in enumerate([(None, "École ABC"), ("éabc", None), ("x", "a_c")])], PAGES)
    assert [r.slug for r in store.keyword_search(pages, "a_c").orderBy("rank").collect()] == ["s2", "s1", "s0"]
    assert [r.slug for r in store.keyword_search(pages, "É").collect()] != []  # nothing is left of the query, so every page matches
    assert store.keyword_search(pages, "!!!", 2).count() == 2


def test_bfs_and_rerank(spark):
    edges = [("a", "home"), ("b", "a"), ("home", "b"), ("c", "b"), ("bad slug", "a"), ("d", "c")]
    links = spark.createDataFrame([(i, f, t, "m", T0, None) for i, (f, t) in enumerate(edges)] + [(9, "e", "home", "m", T0, T0)], store.SCHEMAS["links"])
    assert {tuple(r) for r in graph.bfs_backlinks(links, "home", 3).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    hits = spark.createDataFrame([("z", 1.0, 1), ("c", 0.9, 2), ("a", 0.9, 3)], "slug string, score double, rank int")
    ranked = graph.rerank_by_distance(hits, graph.bfs_backlinks(links, "home", 3), 0.5, 3).orderBy("rank").collect()
    assert [r.slug for r in ranked] == ["a", "c", "z"]


def test_as_of(spark):
    edges = spark.createDataFrame([(1, 0, 5), (2, 5, None), (3, 0, None)], "id int, valid_at int, invalid_at int")
    assert {r.id for r in graph.as_of(edges, F.lit(5)).collect()} == {2, 3}
    moments = spark.createDataFrame([(4,), (5,)], "instant int")
    assert {(r.id, r.instant) for r in graph.as_of_each(edges, moments).collect()} == {(1, 4), (3, 4), (2, 5), (3, 5)}


def test_rank_fusion(spark):
    rows = [("q", n, s, r) for n, names in enumerate(("abc", "bcd")) for r, s in enumerate(names, 1)]
    fused = retrieval.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id string, list int, slug string, rank int"))
    assert [r.slug for r in fused.orderBy("rank").collect()] == ["b", "c", "a", "d"]


def test_vector_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 8)), 1)
    x[5] = 0
    x[7] = x[8]
    df = spark.createDataFrame([(f"{i:03}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, embedding array<float>").repartition(5)
    queries = df.where("id < '020'").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.vector_topk(df, queries, 4, 8).collect()}
    x = x.astype(np.float32).astype(float)
    n = np.linalg.norm(x, axis=1)
    unit = np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0)
    for q in range(20):
        s = np.round(unit @ unit[q], 9)
        assert [got[f"{q:03}", r] for r in range(1, 5)] == [f"{i:03}" for i in sorted(range(300), key=lambda i: (-s[i], i))[:4]]
    with pytest.raises(Exception, match="dimension"):
        retrieval.vector_topk(df, queries, 4, 9).collect()


def test_bm25_without_terms(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, ""), (3, None), (4, "b")], "doc_id int, text string")
    assert retrieval.bm25_search(docs, "doc_id", ["text"], [("q", "!!")], 5).count() == 0
    assert [r.doc_id for r in retrieval.bm25_search(docs, "doc_id", ["text"], [("q", "b")], 5).orderBy("rank").collect()] == [4, 1]


def test_simhash_pairs(spark):
    rng = np.random.default_rng(2)
    base = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 60)]
    values = base + [(((v & (2**64 - 1)) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))) + 2**63) % 2**64 - 2**63 for v, n in zip(base, [1, 2, 3, 4] * 15)]
    want = {(min(a, b), max(a, b)) for a in values for b in values if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = indexing.simhash_pairs(spark.createDataFrame([(v,) for v in [*values, *values[:5], None]], "h bigint"), "h", 3)
    assert {(r.hash_a, r.hash_b) for r in got.collect()} == want


def test_simhash_pairs_broadcast_nothing(spark):
    got = indexing.simhash_pairs(spark.createDataFrame([(v,) for v in range(16)], "h bigint"), "h", 3)
    assert {(r.hash_a, r.hash_b, r.bits) for r in got.collect()} == {(a, b, (a ^ b).bit_count()) for b in range(16) for a in range(b) if (a ^ b).bit_count() <= 3}
    plan = got._jdf.queryExecution().executedPlan().toString()  # as AQE left it
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_markdown_source(spark):
    root = Path(folder())
    (root / "a" / "b").mkdir(parents=True)
    for name in ("x.md", "a/y.markdown", "a/b/z.MD", "a/b/w.txt"):
        (root / name).write_text("# T")
    assert {(r.slug, r.body) for r in read_markdown(spark, str(root)).collect()} == {("x", "# T"), ("a/y", "# T")}
    assert read_markdown(spark, str(root / "none")).count() == 0


def test_tensor_source(spark):
    magic = b"TESTMODEL\0"
    data = np.arange(6, dtype="<f4").tobytes()
    entry = b"w".ljust(64, b"\0") + bytes([0, 2, 0, 0]) + struct.pack("<4IQQI", 2, 3, 1, 1, 192, len(data), zlib.crc32(data))
    path = Path(folder()) / "m.bin"
    path.write_bytes((magic + struct.pack("<II", 1, 1)).ljust(64, b"\0") + entry.ljust(128, b"\0") + data)
    row = read_tensors(spark, str(path), magic).first()
    assert (row["name"], row["shape"], row["data"], row["checksum_ok"]) == ("w", [2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], True)
    with pytest.raises(Exception, match=TensorFileError.__name__):
        read_tensors(spark, str(path), b"OTHER").collect()
