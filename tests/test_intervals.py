from __future__ import annotations

import random

from quillstore.functions.times import OPEN_US
from quillstore.operators.intervals import _bucketed, interval_islands, periods_and_gaps

SCHEMA = "id bigint, a string, b string, s bigint, e bigint, k1 string, n string"


def brute(rows):
    entities = {}
    for i, a, b, s, e in {r[:5] for r in rows}:
        if a is not None and b is not None and s is not None and (e is None or e > s):
            entities.setdefault((a, b), []).append((s, OPEN_US if e is None else e))
    found = set()
    for key, spans in entities.items():
        islands = []
        for s, e in sorted(spans):
            if islands and s <= islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], e)
                islands[-1][2] += 1
            else:
                islands.append([s, e, 1])
        for n, (s, e, count) in enumerate(islands):
            found.add((*key, s, e, count, islands[n - 1][1] if n else None))
    return found


def islands(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {tuple(r) for r in interval_islands(df, ["a", "b"], "s", "e", row_id="id", **more).select("k1", "k2", "from_us", "to_us", "n_rows", "gap_from_us").collect()}


def test_random_intervals_in_many_bucket_sizes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        s = rng.randrange(-500, 3000)
        rows.append((i, rng.choice(["p", "q", "", None]), rng.choice(["u", "v"]), s if rng.random() > 0.05 else None, rng.choice([None, s + rng.randrange(-5, 60)]) if rng.random() < 0.03 else s + rng.randrange(-5, 12)))
    rows += rows[:50]
    want = brute(rows)
    assert islands(spark, rows) == want
    for hot_rows in (0, 20, 100):
        assert islands(spark, rows, hot_rows=hot_rows) == want


def test_touching_intervals_are_one_period_and_equal_ones_count_by_id(spark):
    rows = [(1, "a", "b", 0, 10), (2, "a", "b", 10, 20), (3, "a", "b", 10, 20), (3, "a", "b", 10, 20), (4, "a", "b", 21, None)]
    assert islands(spark, rows) == {("a", "b", 0, 20, 3, None), ("a", "b", 21, OPEN_US, 1, 20)}


def test_periods_and_gaps(spark):
    df = spark.createDataFrame([(1, "a", "b", 0, 10, "", ""), (2, "a", "b", 12, None, "", ""), (3, "a", "b", 13, 14, "", "")], SCHEMA)
    found = periods_and_gaps(interval_islands(df, ["a", "b"], "s", "e", row_id="id"), least_rows=2)
    assert {tuple(r) for r in found.collect()} == {("a", "b", "gap", 10, 12), ("a", "b", "period", 12, -1)}


def test_empty_table(spark):
    assert interval_islands(spark.createDataFrame([], SCHEMA), ["a", "b"], "s", "e").count() == 0


def test_one_hot_entity(spark):
    rows = [(i, "hot", "b", i * 10, i * 10 + 10 - (i % 100 == 99)) for i in range(3000)] + [(i, f"cold{i % 50}", "b", i, i + 20) for i in range(3000, 3500)]
    assert islands(spark, rows, hot_rows=200) == brute(rows)


def test_buckets_hold_about_as_many_rows_however_close_the_starts(spark):
    rows = spark.range(20000).selectExpr("0 as slot", "'a' as k1", "cast(if(id < 19000, id, id * 1000000) as bigint) as s", "cast(s + 1 as bigint) as e", "1 as n")
    sizes = [r.n for r in _bucketed(rows, {0: 20}).groupBy("b").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 20 and max(sizes) < 1100
