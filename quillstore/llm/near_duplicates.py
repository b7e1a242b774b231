"""Near-duplicate texts by T-occurrence search with the DivideSkip split of inverted lists.

Two sets of n_a and n_b shingles with a Jaccard similarity of at least t share T = ceil(t / (1 + t) * (n_a + n_b))
of them. DivideSkip sets each set's longest inverted lists apart: with all shingles in one order of rarity, a set
searches in its n - T + SLACK rarest ones (the short lists), and a pair that shares T shingles meets in at least SLACK
of these. As T depends on the partner, n - ceil(t * n) + SLACK shingles, enough for every partner, become postings.

* The order comes from the document frequency of every shingle, counted over all texts. The lengths of the longest lists
  are sent to all tasks, as many as KNOWN; where lists longer than LONG are left over, the lengths are joined instead.
* The short lists are merged by Spark: postings are shuffled and sorted by shingle, the lists joined with themselves,
  and the meetings of each pair counted. A shingle that one text alone has needs no list.
* The pairs that meet SLACK times are looked up in the long lists: sets travel once per class, as sorted arrays, and
  the shingles of the one are binary-probed in the array of the other, which gives the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstore.llm.shingles import set_hashes, shingle_sets, slices
from quillstore.sources.tables import materialize

#: Lengths of lists that are sent to every task at most, and the length up to which a list may be unknown there.
KNOWN, LONG = 1 << 22, 64
#: Shingles that a task counts at once, and how many of them for each range at least.
COUNTED, COUNTED_PER_RANGE = 1 << 21, 16
#: Characters of text for each range of shingles, and how many ranges there may be. The frequencies of a range are added up in one task.
RANGE_CHARS, MOST_RANGES = 1 << 22, 1 << 20
#: Bits of a shingle's hash by which its frequency is counted; shingles that have these in common are counted as one.
KEY_BITS = 48
#: Meetings in short lists that are asked for; more need longer short lists, but leave fewer pairs to chance.
SLACK = 3
#: Bits per class, and 64-bit words at most, of the bitmap that keeps most sets without a candidate from being shuffled.
BITS_PER_CLASS, BITMAP_WORDS = 16, 1 << 22
#: Sets that a task remembers to have told.
REMEMBERED = 1 << 20


def _required(sizes: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * sizes - 1e-9).astype(np.int64)


def _keys(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // (KEY_BITS // 8), 8), np.uint8)
    wide[:, : KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BITS // 8)
    return wide.view("<u8").ravel().astype(np.uint64)


def _code(counts: np.ndarray) -> np.ndarray:
    """Frequencies by half powers of two; 0 for one text."""
    return (2 * np.log2(counts)).astype(np.uint8)


def _count(k: int, ranges: int):
    """(range, keys, counts): in how many texts of a task each shingle stands, many shingles in a row."""
    away = np.uint64(KEY_BITS - ranges.bit_length() + 1)

    def told(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        of = keys >> away
        begins = np.flatnonzero(np.diff(of.astype(np.int64), prepend=-1))
        spans = list(zip(begins, np.append(begins[1:], len(keys))))
        columns = [pa.array(of[begins].astype(np.int32)), pa.array([_packed(keys[x:y]) for x, y in spans], pa.binary()), pa.array([counts[x:y].astype("<u4").tobytes() for x, y in spans], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["range", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in slices(batches, 0):
            parts.append(_keys(shingle_sets(batch.column(0).to_pylist(), k)[0]))
            size += len(parts[-1])
            if size >= max(COUNTED, COUNTED_PER_RANGE * ranges):
                yield told(parts)
                parts, size = [], 0
        if size:
            yield told(parts)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n, keys): the shingles of a range by their frequency in all texts, without those of one text. Rows come sorted by range."""

    def told(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys, which = np.unique(np.concatenate([_unpacked(k) for k, _ in rows]), return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate([np.frombuffer(c, "<u4") for _, c in rows])).astype(np.int64)
        code = _code(counts)
        found = [(int(c), keys[code == c]) for c in np.unique(code[counts > 1])]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([_packed(x) for _, x in found], pa.binary())], ["code", "n", "keys"])

    current, rows = None, []
    for batch in batches:
        for at, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if at != current and rows:
                yield told(rows)
                rows = []
            current = at
            rows.append((keys, counts))
    if rows:
        yield told(rows)


def _shingle_frequencies(rows: DataFrame, k: int) -> DataFrame:
    """(code, n, keys) of all shingles that more than one text has."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = 1 << max(6, min(chars // RANGE_CHARS, MOST_RANGES).bit_length() - 1)
    counted = rows.select("text").mapInArrow(_count(k, ranges), "range int, keys binary, counts binary")
    return materialize(counted.repartition("range").sortWithinPartitions("range").mapInArrow(_add_up, "code int, n bigint, keys binary"), "frequencies")


def _known_lengths(frequencies: DataFrame, known: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(least code, sorted keys, codes) of the longest lists, as many as `known`."""
    least, left = 128, known
    for row in frequencies.groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("code")).collect():  # a row per half power of two
        if row.n > left:
            break
        least, left = row.code, left - row.n
    else:
        least = 2
    table = frequencies.where(F.col("code") >= least).select("code", "keys").toArrow()
    parts = [_unpacked(x) for x in table.column(1).to_pylist()]
    keys = np.concatenate([np.empty(0, np.uint64), *parts])
    codes = np.repeat(table.column(0).to_numpy().astype(np.uint8), [len(x) for x in parts])
    order = np.argsort(keys)
    return least, keys[order], codes[order]


class _Told:
    """Which sets a task has told, so that a hot group of copies is no more than one row per task and shingle."""

    def __init__(self) -> None:
        self.fps = np.empty(0, np.uint64)

    def first(self, fps: np.ndarray) -> np.ndarray:
        new = np.zeros(len(fps), bool)
        new[np.unique(fps, return_index=True)[1]] = True
        new &= ~np.isin(fps, self.fps)
        self.fps = np.concatenate([self.fps if len(self.fps) < REMEMBERED else self.fps[:0], fps[new]])
        return new


def _postings(hashes: np.ndarray, fps: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(fps.view(np.int64)), pa.array((sizes << 32) | place)], ["shingle", "fp", "place"])


def _short_lists(k: int, least: int, threshold: float, known):
    """(shingle, fp, place) of the rarest shingles of each set that another text may have; place holds the set's size and the shingle's rank in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (code, keys, codes), told = known.value, _Told()
        for batch in slices(batches, 0):
            hashes, offsets = shingle_sets(batch.column(0).to_pylist(), k)
            sizes, fps = np.diff(offsets), set_hashes(hashes, offsets)
            wanted = np.where(told.first(fps) & (sizes >= least), np.minimum(sizes, sizes - _required(sizes, threshold) + SLACK), 0)
            rows, rarity = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(hashes), np.int64)
            if len(keys):
                key = _keys(hashes)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                rarity = np.where(keys[at] == key, codes[at], 0).astype(np.int64)
            order = np.argsort((rows << 8) | rarity, kind="stable")  # ties stay in the order of the hashes
            place = np.arange(len(hashes)) - offsets[:-1][rows]
            kept = place < wanted[rows]
            if code <= 2:
                kept &= rarity[order] > 0
            take, rows = order[kept], rows[kept]
            yield _postings(hashes[take], fps[rows], sizes[rows], place[kept])

    return run


def _whole_sets(k: int, least: int):
    """(shingle, fp, place) of all shingles of each set, place without a rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _Told()
        for batch in slices(batches, 0):
            hashes, offsets = shingle_sets(batch.column(0).to_pylist(), k)
            sizes, fps = np.diff(offsets), set_hashes(hashes, offsets)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            kept = (told.first(fps) & (sizes >= least))[rows]
            yield _postings(hashes[kept], fps[rows[kept]], sizes[rows[kept]], np.zeros(int(kept.sum()), np.int64))

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, code) of each shingle."""
    for batch in batches:
        for code, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _unpacked(keys)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), code, np.int32))], ["key", "code"])


def _short_lists_by_join(rows: DataFrame, frequencies: DataFrame, k: int, least: int, threshold: float) -> DataFrame:
    """The same as `_short_lists`, whatever the number of long lists: the frequencies come to the shingles by a join."""
    every = rows.select("text").mapInArrow(_whole_sets(k, least), "shingle bigint, fp bigint, place bigint").withColumn("key", F.shiftrightunsigned("shingle", 64 - KEY_BITS))
    lengths = frequencies.select("code", "keys").mapInArrow(_spread, "key bigint, code int")
    shared = every.join(lengths, "key").dropDuplicates(["fp", "shingle"])
    n, rank = F.shiftright("place", 32), F.row_number().over(Window.partitionBy("fp").orderBy("code", "key", "shingle"))
    # Shingles without a frequency stand in one text, so they come first in the order.
    ranked = shared.withColumn("rank", n - F.count(F.lit(1)).over(Window.partitionBy("fp")) + rank - 1)
    return ranked.where(F.col("rank") < n - F.ceil(F.lit(threshold) * n - 1e-9) + SLACK).select("shingle", "fp", (F.col("place") + F.col("rank")).alias("place"))


def _sets(k: int, least: int, bitmap):
    """(id, fp, n, set) of each text; set is the sorted array of its shingles where a partner is likely, told once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, told = bitmap.value, _Told()
        for batch in slices(batches, 1):
            hashes, offsets = shingle_sets(batch.column(1).to_pylist(), k)
            sizes, fps = np.diff(offsets), set_hashes(hashes, offsets)
            keep = np.flatnonzero(sizes >= least)
            likely = ((words[(fps >> np.uint64(6)) % np.uint64(len(words))] >> (fps & np.uint64(63))) & np.uint64(1)).astype(bool)
            likely[likely] = told.first(fps[likely])
            sets = [np.sort(hashes[offsets[i] : offsets[i + 1]]).tobytes() if likely[i] else None for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(fps[keep].view(np.int64)), pa.array(sizes[keep].astype(np.int32)), pa.array(sets, pa.binary())], ["id", "fp", "n", "set"])

    return run


def _bitmap(classes: DataFrame) -> np.ndarray:
    """A bit for each class; where they are more than the bitmap has room for, it only lets more sets through than needed."""
    n = classes.count()
    words = 1 << max(4, min(n * BITS_PER_CLASS // 64, BITMAP_WORDS - 1).bit_length())
    bits = classes.groupBy(F.pmod(F.shiftrightunsigned("class_id", 6), F.lit(words)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(class_id & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(words, np.uint64)
    bitmap[bits.column(0).to_numpy()] = bits.column(1).to_numpy().view(np.uint64)
    return bitmap


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp_a, fp_b, shared, similarity): binary probes of the smaller set's shingles in the other's sorted array."""
    for batch in batches:
        shared, union = np.zeros(len(batch), np.int64), np.ones(len(batch), np.int64)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
            shared[i] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
            union[i] = len(x) + len(y) - shared[i]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(shared / union)], ["fp_a", "fp_b", "shared", "similarity"])


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, least: int = 1, known: int = KNOWN) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of texts whose sets of `words`-word shingles have a Jaccard similarity of `threshold` or more.

    members: id (as string), class_id, n: each id whose text has at least `least` shingles. Texts with equal sets have
    one class_id, a hash of the set in 64 bits. pairs: class_a < class_b, shared, similarity: every pair of classes that
    is similar enough, none left out. Texts that are null or too short are in neither; a repeated id with the same
    text counts once, one with several texts is a member of several classes, and a null id is left out. Other columns
    are ignored; an empty table gives empty results. `known` only decides how the lengths of lists come to the texts.
    """
    least = max(least, 1)
    context = df.sparkSession.sparkContext
    rows = df.select(df[id_col].cast("string").alias("id"), df[text_col].alias("text")).where("id is not null and text is not null")
    frequencies = _shingle_frequencies(rows, words)
    lengths = _known_lengths(frequencies, known)
    if 2 ** (lengths[0] / 2) <= LONG:
        lists = rows.select("text").mapInArrow(_short_lists(words, least, threshold, context.broadcast(lengths)), "shingle bigint, fp bigint, place bigint")
    else:
        lists = _short_lists_by_join(rows, frequencies, words, least, threshold)
    # A set told by several tasks is one from here on, and so is a group of copies.
    lists = lists.repartition("shingle").groupBy("shingle", "fp").agg(F.first("place").alias("place"))

    of = lambda x: lists.select("shingle", F.col("fp").alias(f"fp_{x}"), F.shiftright("place", 32).alias(f"n_{x}"), F.expr("place & 4294967295").alias(f"rank_{x}"))
    together = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    meets = (F.col("fp_a") < F.col("fp_b")) & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9)
    for x in "ab":
        meets = meets & (F.col(f"rank_{x}") < F.col(f"n_{x}") - together + SLACK)
    met = of("a").join(of("b"), "shingle").where(meets).groupBy("fp_a", "fp_b").agg(F.count(F.lit(1)).alias("met"), F.first(together).alias("together"))
    candidates = materialize(met.where(F.col("met") >= F.least(F.lit(SLACK), "together")).select("fp_a", "fp_b"), "candidates")

    bitmap = context.broadcast(_bitmap(candidates.select(F.explode(F.array("fp_a", "fp_b")).alias("class_id")).distinct()))
    told = materialize(rows.mapInArrow(_sets(words, least, bitmap), "id string, fp bigint, n int, set binary"), "sets")
    sets = told.where("set is not null").groupBy("fp").agg(F.first("set").alias("set"))
    both = candidates.join(sets.select(F.col("fp").alias("fp_a"), F.col("set").alias("a")), "fp_a").join(sets.select(F.col("fp").alias("fp_b"), F.col("set").alias("b")), "fp_b")
    pairs = both.select("fp_a", "fp_b", "a", "b").mapInArrow(_probe, "fp_a bigint, fp_b bigint, shared bigint, similarity double").where(F.col("similarity") >= threshold)
    members = told.select("id", F.col("fp").alias("class_id"), "n").distinct()
    return members, pairs.select(F.col("fp_a").alias("class_a"), F.col("fp_b").alias("class_b"), "shared", "similarity")


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """id_a < id_b of all similar pairs of ids: of two similar classes, and of one class."""
    of = lambda x: members.select(F.col("class_id").alias(f"class_{x}"), F.col("id").alias(f"id_{x}"))
    across = pairs.select("class_a", "class_b").join(of("a"), "class_a").join(of("b"), "class_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    copies = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("class_id")
    again = members.join(copies, "class_id")
    within = again.alias("x").join(again.alias("y"), "class_id").where("x.id < y.id").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    return across.where("id_a < id_b").unionByName(within).distinct()


def linked_members(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, class_id, n_links of every member: with how many other ids its text is similar, counted by class, without a row for each pair. class_id is the smallest id of the class."""
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("name"))
    both = pairs.select(F.inline(F.array(F.struct(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")), F.struct(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))))
    near = both.join(sizes.select(F.col("class_id").alias("other"), "copies"), "other").groupBy("class_id").agg(F.sum("copies").alias("near"))
    links = sizes.join(near, "class_id", "left").select("class_id", "name", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return members.join(links, "class_id").select("id", F.col("name").alias("class_id"), "n_links")


def named_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """class_a < class_b, shared, similarity: the pairs of classes, each class under its smallest id."""
    names = members.groupBy("class_id").agg(F.min("id").alias("name"))
    of = lambda x: names.select(F.col("class_id").alias(f"class_{x}"), F.col("name").alias(f"name_{x}"))
    named = pairs.join(of("a"), "class_a").join(of("b"), "class_b")
    return named.select(F.least("name_a", "name_b").alias("class_a"), F.greatest("name_a", "name_b").alias("class_b"), "shared", "similarity")
