from __future__ import annotations

import random

from quillstore.operators.orphans import orphan_references, orphan_report

MONTH = 31 * 86_400_000_000
REFS, RECORDS = "src_table string, row_id string, ref_field string, ns string, key string, t_us bigint, m string", "ns string, key string, from_us bigint, to_us bigint, months string"


def found(spark, refs, records, ranges=4):
    out = orphan_references(spark.createDataFrame([(*r, "x") for r in refs], REFS), spark.createDataFrame([(*r, "x") for r in records], RECORDS), ranges)
    return {tuple(r)[:4] for r in out.collect()}


def brute(refs, records):
    out = set()
    for table, row, field, ns, key, t in refs:
        if key is None or t is None:
            continue
        mine = [(a, z) for n, k, a, z in records if n == ns and k == key]
        if any(a is not None and a <= t and (z is None or t < z) for a, z in mine):
            continue
        starts = [a for a, _ in mine if a is not None]
        out.add((table, row, field, "missing" if not mine else "late" if starts and min(starts) > t else "deleted"))
    return out


def test_random_references(spark):
    rng = random.Random(5)
    keys = ["", " a", "a", "A", "ä", *(f"k{i}" for i in range(40))]
    at = lambda: rng.randrange(-2 * MONTH, 20 * MONTH)
    records = [(rng.choice(["slug", "id"]), rng.choice(keys), None if rng.random() < 0.05 else (a := at()), None if rng.random() < 0.4 else a + rng.randrange(-MONTH, 6 * MONTH)) for _ in range(60)]
    refs = [(rng.choice("xy"), str(i), "f", rng.choice(["slug", "id"]), rng.choice([*keys, None]), None if rng.random() < 0.05 else at()) for i in range(800)]
    for ranges in (1, 7):
        assert found(spark, refs + refs[:20], records, ranges) == brute(refs, records)


def test_bounds_of_a_life(spark):
    records = [("slug", "a", 10, 20), ("slug", "a", 20, 30), ("slug", "b", 5, 5)]
    refs = [("t", f"{k}{t}", "f", "slug", k, t) for t in (9, 10, 19, 20, 29, 30) for k in "ab"]
    assert found(spark, refs, records) == brute(refs, records)


def test_many_lives_of_a_key_in_a_month(spark):
    rng = random.Random(9)
    records = [("slug", "a", s, s + rng.randrange(1, 10**9)) for s in (rng.randrange(0, 2 * MONTH) for _ in range(900))] + [("slug", "b", 5, None)]
    edges = [t + d for _, k, a, z in records[:200] for t in (a, z or a) for d in (-1, 0)]
    refs = [("t", str(i), "f", "slug", rng.choice("ab"), t) for i, t in enumerate([*edges, *(rng.randrange(-MONTH, 3 * MONTH) for _ in range(1000))])]
    assert found(spark, refs, records) == brute(refs, records)


def test_hot_key_and_report(spark):
    refs = [("t", str(i), "f", "slug", "hot", i) for i in range(3000)] + [("t", "z", "f", "slug", "cold", 5)]
    out = orphan_references(spark.createDataFrame([(*r, "x") for r in refs], REFS), spark.createDataFrame([("slug", "hot", 1000, None, "")], RECORDS))
    assert {tuple(r) for r in orphan_report(out).collect()} == {("t", "1970-01", "f", "late", 1000), ("t", "1970-01", "f", "missing", 1)}


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [("t", "1", "f", "slug", "", 0)], []) == {("t", "1", "f", "missing")}
