"""Continuous periods and gaps of validity intervals, per entity.

Each start is compared with the running maximum of the ends before it; where it lies beyond, a new island begins.
An entity's rows are sorted in one task, unless they are many: entities whose hash falls into a slot with more than its
share of all rows take a path in two levels, on which the running maximum is taken within time buckets of an entity, and
over the buckets. These are cut at quantiles of the slot's starts, so they hold about as many rows each, however close
in time they lie; equal starts are added up before. Both paths give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstore.functions.times import OPEN_US, micros


def _col(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


#: Slots into which entities are hashed to find hot ones, and rows up to which a slot is never hot.
SLOTS, HOT_ROWS = 1 << 16, 500_000


#: Quantiles of a slot's starts, at which buckets may be cut.
QUANTILES = 4096


def _hot_slots(rows: DataFrame, hot_rows: int) -> dict[int, int]:
    """The slots with more than `hot_rows` rows and four times the mean of all slots, and how many buckets each needs.

    A bucket holds as many rows as make a slot hot, so all slots together have no more than SLOTS / 4 buckets and as many again.
    """
    counts = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    mean = F.sum("n").over(Window.partitionBy()) / SLOTS  # over one row per slot at most
    hot = counts.withColumn("limit", F.greatest(F.lit(hot_rows), 4 * mean)).where("n > limit")
    return {r.slot: min(int(r.n // max(r.limit, 1)) + 1, QUANTILES) for r in hot.collect()}


def _bucketed(rows: DataFrame, hot: dict[int, int]) -> DataFrame:
    """The rows of hot slots with a bucket b, which grows with the start."""
    quantiles = [i / QUANTILES for i in range(1, QUANTILES)]
    cuts = {}
    for r in rows.groupBy("slot").agg(F.approx_percentile("s", quantiles, 4 * QUANTILES).alias("cuts")).toLocalIterator():
        cuts[r.slot] = sorted({r.cuts[len(r.cuts) * i // hot[r.slot]] for i in range(1, hot[r.slot])})
    bounds = rows.sparkSession.createDataFrame(list(cuts.items()), "slot int, cuts array<bigint>")
    # Binary search: the number of cuts up to the start.
    place = F.expr("aggregate(sequence(1, 13), named_struct('low', 0, 'high', size(cuts)), (x, i) -> if(x.low < x.high, if(cuts[(x.low + x.high) div 2] <= s, named_struct('low', cast((x.low + x.high) div 2 + 1 as int), 'high', x.high), named_struct('low', x.low, 'high', cast((x.low + x.high) div 2 as int))), x), x -> x.low)")
    return rows.join(F.broadcast(bounds), "slot").withColumn("b", place).drop("cuts")


def _in_one_level(rows: DataFrame, names: list[str], row_id: bool) -> DataFrame:
    """Islands of entities of which each fits a task: one shuffle."""
    rows = rows.repartition(*names)
    if row_id:
        rows = rows.dropDuplicates([*names, "s", "e", "rid"])
    within = Window.partitionBy(*names).orderBy("s")
    starts = rows.groupBy(*names, "s").agg(F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))
    labelled = (
        starts.withColumn("prev", F.max("e").over(within.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("opens", F.col("prev").isNull() | (F.col("s") > F.col("prev")))
        .withColumn("from_us", F.max(F.when(F.col("opens"), F.col("s"))).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return labelled.groupBy(*names, "from_us").agg(F.max("e").alias("to_us"), F.sum("n").alias("n_rows"), F.max(F.when(F.col("opens"), F.col("prev"))).alias("gap_from_us"))


def _in_two_levels(rows: DataFrame, names: list[str], row_id: bool, hot: dict[int, int]) -> DataFrame:
    """Islands of entities of any size."""
    part = [*names, "b"]
    if row_id:
        rows = rows.dropDuplicates(["slot", *names, "s", "e", "rid"])
    starts = _bucketed(rows.groupBy("slot", *names, "s").agg(F.max("e").alias("e"), F.count(F.lit(1)).alias("n")), hot)
    earlier = Window.partitionBy(*names).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    reach = starts.groupBy(*part).agg(F.max("e").alias("reach")).withColumn("reach", F.max("reach").over(earlier))
    within = Window.partitionBy(*part).orderBy("s")
    flagged = (
        starts.join(reach, part)
        .withColumn("prev", F.greatest("reach", F.max("e").over(within.rowsBetween(Window.unboundedPreceding, -1))))
        .withColumn("opens", F.col("prev").isNull() | (F.col("s") > F.col("prev")))
        .withColumn("island", F.max(F.when(F.col("opens"), F.col("s"))).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    )
    pieces = flagged.groupBy(*part, "island").agg(F.sum("n").alias("n"), F.max("e").alias("e"), F.max(F.when(F.col("opens"), F.col("prev"))).alias("gap_from_us"))
    before = pieces.groupBy(*part).agg(F.max("island").alias("before")).withColumn("before", F.max("before").over(earlier))
    return (
        pieces.join(before, part)
        .withColumn("from_us", F.coalesce("island", "before"))
        .groupBy(*names, "from_us")
        .agg(F.max("e").alias("to_us"), F.sum("n").alias("n_rows"), F.max("gap_from_us").alias("gap_from_us"))
    )


def interval_islands(df: DataFrame, keys: list[str], start: str, end: str, row_id: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per continuous period: k1..kn, from_us, to_us, n_rows, gap_from_us.

    An interval holds its start and not its end; a null end is open (`to_us` = OPEN_US). Intervals that overlap or
    touch belong to one period. gap_from_us is the end of the entity's period before, null at its first.
    Rows with a null key or start, or an end not after the start, are left out. With `row_id`, rows with equal id,
    keys and bounds count once, and two ids with one interval are two rows (a null id counts as one id); without it
    every row counts. Other columns of `df` are ignored, whatever their names; an empty table gives an empty result.
    """
    names = [f"k{i + 1}" for i in range(len(keys))]
    kind = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(
        *(_col(df, k).alias(n) for k, n in zip(keys, names)),
        micros(_col(df, start), kind[start]).alias("s"),
        F.coalesce(micros(_col(df, end), kind[end]), F.lit(OPEN_US)).alias("e"),
        (_col(df, row_id) if row_id else F.lit(None)).alias("rid"),
    )
    usable = F.col("s").isNotNull() & (F.col("e") > F.col("s"))
    for n in names:
        usable = usable & F.col(n).isNotNull()
    rows = rows.where(usable).withColumn("slot", F.pmod(F.xxhash64(*names), F.lit(SLOTS)).cast("int"))
    hot = _hot_slots(rows, hot_rows)
    if not hot:
        return _in_one_level(rows, names, row_id is not None)
    is_hot = F.col("slot").isin(*hot)
    return _in_one_level(rows.where(~is_hot), names, row_id is not None).unionByName(_in_two_levels(rows.where(is_hot), names, row_id is not None, hot))


def periods_and_gaps(islands: DataFrame, least_rows: int = 1) -> DataFrame:
    """k1..kn, kind (`period`, `gap`), from_us, to_us of `interval_islands`; to_us is -1 for an open period.

    Periods of fewer than `least_rows` rows are left out; the gaps between them stay.
    """
    keys = [c for c in islands.columns if c.startswith("k")]
    period = F.struct(F.lit("period").alias("kind"), F.col("from_us"), F.when(F.col("to_us") == OPEN_US, F.lit(-1)).otherwise(F.col("to_us")).alias("to_us"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("gap_from_us").alias("from_us"), F.col("from_us").alias("to_us"))
    both = F.array(F.when(F.col("n_rows") >= least_rows, period), F.when(F.col("gap_from_us").isNotNull(), gap))
    return islands.select(*keys, F.inline(F.array_compact(both)))
