from __future__ import annotations

import random
import re

import quillstore.llm.leakage as leakage
from quillstore.llm.leakage import leaked_documents, leaked_items

DOCS, ITEMS = "doc_id bigint, text string, item_id string, matches int", "item_id bigint, text string, split string"


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def brute(docs, items, n):
    out = set()
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        runs = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if w else set()
        for d, x in docs:
            v = words(x)
            if any(tuple(v[j : j + size]) in runs for j in range(len(v) - size + 1)) and runs:
                out.add((i, d))
    return out


def found(spark, docs, items, n=12):
    out = leaked_items(spark.createDataFrame([(*d, "x", 0) for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS), words=n)
    return out


def test_random_texts(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda a, z: " ".join(rng.choice(["a", "b", "C", "d-e", "É"]) for _ in range(rng.randint(a, z)))
    items = [(i, text(0, 9)) for i in range(30)] + [(99, None), (98, ""), (97, "!!"), (3, text(3, 5))]
    docs = [(d, text(0, 40)) for d in range(120)] + [(500, None), (501, ""), (502, "a " * 100_000)]
    want = brute(docs, items, 5)
    assert {(r.item_id, r.doc_id) for r in found(spark, docs, items, 5).collect()} == want
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 20)
    assert {(r.item_id, r.doc_id) for r in found(spark, docs, items, 5).collect()} == want


def test_offsets_are_those_of_the_original(spark):
    item = "one two three four"
    doc = "İİ so: ONE two\n(three) four! and one two three four."
    row = found(spark, [(1, doc)], [(7, item)], 3).first()
    assert doc[row.first_char : row.end_char] == "ONE two\n(three) four! and one two three four"
    assert row.matches == 4


def test_report_and_empty_tables(spark):
    out = found(spark, [(1, "a b c d"), (2, "x")], [(5, "a b"), (6, "c d"), (7, "x y")])
    assert [tuple(r) for r in leaked_documents(out).collect()] == [(1, [5, 6], 2, 2)]
    assert found(spark, [], [(5, "a")]).count() == 0
    assert found(spark, [(1, "a")], []).count() == 0
