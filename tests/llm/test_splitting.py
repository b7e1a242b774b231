from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillstore.llm.splitting import pieces_laid_out, split_oversized, split_text

SCHEMA = "id string, body string, ord int, item_id string, text string"


def pieces(spark, rows, limit, overlap):
    df = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], SCHEMA)
    out = {}
    for r in split_oversized(df, "id", "body", limit, overlap).orderBy("item_id", "ord").collect():
        out.setdefault(r.item_id, []).append(r)
    return out


def check(text, rows, limit, overlap):
    assert [r.ord for r in rows] == list(range(len(rows)))
    assert all(len(r.body) <= limit for r in rows)
    assert "".join(r.body[r.shared :] for r in rows) == text
    for before, after in zip(rows, rows[1:]):
        assert after.shared == overlap and before.body.endswith(after.body[:overlap])


def test_pieces_of_random_texts(spark):
    rng = random.Random(4)
    texts = {f"t{i}": "".join(rng.choice(["a", "bcd", " ", "\n", ". ", "\n\n# h\n", "é" * rng.randint(1, 150), "😀, "]) for _ in range(rng.randint(0, 400))) for i in range(200)}
    found = pieces(spark, [*texts.items(), *list(texts.items())[:20]], 100, 20)
    assert set(found) == {i for i, t in texts.items() if len(t) > 100}
    for i, rows in found.items():
        check(texts[i], rows, 100, 20)


def test_natural_boundaries_come_first():
    text = "# A\n" + "One two three. " * 20 + "\n\n# B\n" + "Four five six. " * 20
    spans = split_text(text, 400, 50)
    assert len(spans) == 2 and text[spans[1][0] :].startswith("# B")
    words = "word " * 100
    assert all(words[a - 1] == " " for a, *_ in split_text(words, 60, 10)[1:])


def test_dirty_rows(spark):
    run = "x" * 1000
    found = pieces(spark, [("a", None), ("b", ""), ("c", "short"), (None, "y " * 300), ("d", run), ("e", "z" * 400_000), ("f", "q" * 100)], 100, 20)
    assert set(found) == {None, "d", "e"}
    check(run, found["d"], 100, 20)
    assert {r.run for r in found["d"][1:]} == {1000} and found["d"][1].boundary == "inside"
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], SCHEMA), "id", "body", 10, 10)


def test_pieces_are_full_where_boundaries_are_alike():
    text = ("a sentence of thirty chars ok. " * 200)[:5400]
    spans = split_text(text, 2000, 200)
    assert len(spans) == 3 and all(z - a > 1700 for a, z, *_ in spans[:2])


def test_a_run_is_told_only_where_it_is_cut(spark):
    """A run that a piece could hold but for the overlap is cut too, yet it is shorter than the limit."""
    rows = [("longer", "w " * 60 + "x" * 101 + " y"), ("shorter", "w " * 60 + "x" * 95 + " y"), ("blank", "w " * 60 + "x" * 50 + " " * 500 + "y"), ("fits", "w " * 60 + "x" * 80)]
    found = pieces(spark, rows, 100, 20)
    assert {i: max(r.run for r in p) for i, p in found.items()} == {"longer": 101, "shorter": 95, "blank": 0, "fits": 0}
    for i, text in rows:
        check(text, found[i], 100, 20)


def test_pieces_laid_out(spark):
    df = spark.createDataFrame([("a", "word " * 100), ("b", "x" * 500), ("c", "né " * 90)], "id string, body string")
    laid = pieces_laid_out(split_oversized(df, "id", "body", 100, 20).withColumn("most", F.lit(100)), ["item_id"], "most")
    assert {(r.item_id, r.digest, r.fits, r.overlaps) for r in laid.collect()} == {(i, hashlib.md5(t.encode()).hexdigest(), True, True) for i, t in (("a", "word " * 100), ("b", "x" * 500), ("c", "né " * 90))}
    broken = split_oversized(df, "id", "body", 100, 20).withColumn("body", F.expr("overlay(body placing '#' from 1)")).withColumn("most", F.lit(50))
    assert {(r.fits, r.overlaps) for r in pieces_laid_out(broken, ["item_id"], "most").collect()} == {(False, False)}
