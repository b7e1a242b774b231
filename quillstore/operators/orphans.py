"""References whose record does not exist at the time they name it.

Every referenced key gets an integer code: its key range (a hash of the key) and its rank in the range. A bitmap over
the codes of a range holds the keys referenced in a month; another the keys whose record lives through that whole
month. A bitmap is kept as its non-zero words of 64 bits, one row each, so that empty stretches cost nothing and Spark
can AND-NOT two bitmaps by a join of words. The bits that survive are decoded; only the references of those keys and
months are then compared with the records' exact times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstore.functions.times import DAY_US, OPEN_US, month_label, month_of, month_start
from quillstore.operators.intervals import interval_islands
from quillstore.sources.tables import materialize


#: Lives of one key within a month that a reference is compared with directly; of more, only those in its slot of the month.
FEW_LIVES, SLOT_US = 256, 31 * DAY_US // 1024


def _slot(us: Column, month: Column) -> Column:
    return F.floor((us - month_start(month)) / F.lit(SLOT_US)).cast("int")


def key_dictionary(references: DataFrame, n_ranges: int = 4096) -> DataFrame:
    """ns, key, range, code, months of each referenced key; `code` counts from 0 within (ns, range).

    `references` has ns, key and m (the month). Keys are hashed to ranges, so no key, however often it is used, makes
    a range large; the repeated references of a key are collapsed before the shuffle.
    """
    keys = references.groupBy("ns", "key").agg(F.collect_set("m").alias("months"))
    ranged = keys.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(n_ranges)).cast("int"))
    return ranged.withColumn("code", F.row_number().over(Window.partitionBy("ns", "range").orderBy("key")) - 1)


def _bitmaps(bits: DataFrame) -> DataFrame:
    """The non-zero words of one bitmap per ns, range and month m, of rows with code."""
    return bits.groupBy("ns", "range", "m", F.shiftright("code", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, code & 63)")).alias("bits"))


def orphan_references(references: DataFrame, records: DataFrame, n_ranges: int = 4096) -> DataFrame:
    """src_table, row_id, ref_field, reason, period of each reference without a living record.

    references: src_table, row_id, ref_field, ns (which kind of key), key, t_us. A null key or time is no reference;
    an empty string is one. A reference told more than once counts once per src_table, row_id and ref_field, by its
    earliest month.
    records: ns, key, from_us, to_us: a record lives from from_us (included) to to_us (excluded; null: for ever); one
    without from_us never lives, yet exists. A null key is no record.
    reason is `missing` (no record has the key), `late` (all were created after the time) or `deleted`; period is the
    month of the time. Further columns are ignored; empty tables give the result that follows from these rules.
    """
    refs = references.select("src_table", "row_id", "ref_field", "ns", "key", "t_us").where("key is not null and t_us is not null").withColumn("m", month_of(F.col("t_us")))
    lives = records.select("ns", "key", "from_us", "to_us").where("key is not null")
    codes = materialize(key_dictionary(refs, n_ranges), "dictionary")

    # A code of the record's own islands, so that two records which follow each other without a gap count as one life.
    islands = interval_islands(lives, ["ns", "key"], "from_us", "to_us").select(F.col("k1").alias("ns"), F.col("k2").alias("key"), "from_us", "to_us")
    first_full = month_of(F.col("from_us") - 1) + 1
    last_full = F.when(F.col("to_us") == OPEN_US, F.lit(1 << 30)).otherwise(month_of(F.col("to_us")) - 1)
    known = codes.join(islands, ["ns", "key"]).select("ns", "range", "code", "months", first_full.alias("a"), last_full.alias("z"))
    alive = known.select("ns", "range", "code", F.explode(F.filter("months", lambda m: (m >= F.col("a")) & (m <= F.col("z")))).alias("m"))
    named = codes.select("ns", "range", "code", F.explode("months").alias("m"))
    words = (
        _bitmaps(named)
        .join(_bitmaps(alive).withColumnRenamed("bits", "living"), ["ns", "range", "m", "word"], "left")
        .withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("living", F.lit(0).cast("bigint")))))
        .where("bits <> 0")
    )
    survivors = (
        words.select("ns", "range", "m", F.explode(F.expr("transform(filter(sequence(0, 63), i -> shiftright(bits, i) & 1 = 1), i -> word * 64 + i)")).alias("code"))
        .join(codes.select("ns", "range", "code", "key"), ["ns", "range", "code"])
        .select("ns", "key", "m")
    )

    # Only islands that begin or end within the month can cover a part of it.
    ends = F.array_distinct(F.array(month_of(F.col("from_us")), F.when(F.col("to_us") < OPEN_US, month_of(F.col("to_us"))).otherwise(month_of(F.col("from_us")))))
    partly = islands.select("ns", "key", "from_us", "to_us", F.explode(ends).alias("m"))
    many = partly.groupBy("ns", "key", "m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW_LIVES).select("ns", "key", "m", F.lit(True).alias("many"))
    first, last = F.greatest("from_us", month_start(F.col("m"))), F.least(F.col("to_us"), month_start(F.col("m") + 1)) - 1
    slots = F.when(F.col("many"), F.sequence(_slot(first, F.col("m")), _slot(last, F.col("m")))).otherwise(F.array(F.lit(-1)))
    lives_at = partly.join(many, ["ns", "key", "m"], "left").select("ns", "key", "m", F.struct("from_us", "to_us").alias("life"), F.explode(slots).alias("slot")).groupBy("ns", "key", "m", "slot").agg(F.collect_list("life").alias("lives"))
    existing = lives.groupBy("ns", "key").agg(F.min("from_us").alias("first_us"), F.lit(True).alias("exists"))
    suspects = survivors.join(existing, ["ns", "key"], "left").join(many, ["ns", "key", "m"], "left")
    t = F.col("t_us")
    reason = F.when(F.col("exists").isNull(), "missing").when(F.col("first_us") > t, "late").otherwise("deleted")
    return (
        refs.join(suspects, ["ns", "key", "m"])
        .withColumn("slot", F.when(F.col("many"), _slot(t, F.col("m"))).otherwise(-1))
        .join(lives_at, ["ns", "key", "m", "slot"], "left")
        .where(~F.coalesce(F.exists("lives", lambda x: (x.from_us <= t) & (t < x.to_us)), F.lit(False)))
        .groupBy("src_table", "row_id", "ref_field")
        .agg(F.min(F.struct(F.col("m").alias("m"), reason.alias("reason"))).alias("case"))
        .select("src_table", "row_id", "ref_field", "case.reason", month_label(F.col("case.m")).alias("period"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """src_table, period, ref_field, reason, n_orphans: the count of `orphan_references` per table and period."""
    return orphans.groupBy("src_table", "period", "ref_field", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
