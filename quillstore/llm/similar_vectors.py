"""The k most similar vectors of every vector, by a forest of sorted hash strings.

Each tree gives a vector a string of 128 bits. The first ones are letters: which coordinate of the vector, turned at
random, is the largest, and its sign. The others tell on which side of random planes it lies; where a sample shows many
vectors with the first 64 bits in common, the last 64 planes go through their middle, so that a tight cluster is parted
too, by each tree in its own way. A tree is the sorted array of these strings; vectors with long common prefixes stand
side by side in it, so that all vectors descend to their longest matches at once.

From there a vector ascends in all trees in step: the length of its prefix is the same in all of them, and becomes shorter
until the trees together hold WANTED others with that prefix. Where this is, is told by the sorted strings of the sample,
and beyond what these can tell, by halving. The task that holds this stretch of a tree compares the vector with all
others that have its prefix there (CELL at most: more only means that it stays below in this tree).

A tree's array is cut into stretches for the tasks at prefixes taken from the sample; every vector is put into every
tree, and a stretch of any size is worked off cell by cell. Vectors are first compared in a rounded form (a byte per
number). By how much the rounding may have changed a cosine is known for each vector, and all pairs that may be among
the k best are compared exactly afterwards. Where more than KEEP others may be among a vector's k best (tight clusters,
one direction in many lengths), it and they go through the trees a second time, with their unrounded numbers and CROWDED
times the candidates, and each cell gives the k best exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstore.sources.tables import materialize

#: Trees, candidates that a vector asks of all trees together, and vectors in the sample.
TREES, WANTED, SAMPLE = 16, 16_384, 20_000
#: Times the candidates for vectors in tight clusters.
CROWDED = 6
#: Vectors in a stretch, about; vectors that a task holds at a time; vectors of a cell at most, and so few that a cell needn't be parted.
STRETCH, HELD, CELL, FEW = 1 << 15, 1 << 17, 1 << 13, 1 << 8
#: Letters at the beginning of a string.
LETTERS = 5
#: Stretches of a tree for which their numbers have room, and the depth of a vector that has been compared.
STRETCHES, DONE = 1 << 20, 999
#: Vectors of the sample that tell the middle of those with equal first bits, and the length of a prefix, at least.
LEAST_SAMPLED = 8
#: Candidates of a vector in a cell above which they are compared there, unrounded, instead of pair by pair afterwards.
KEEP = 32
#: Pairs of which the cosines are held at once.
BLOCK = 1 << 21
#: Bytes of a partition of planted vectors, about.
PARTITION = 128 << 20
#: What float32 adds to the rounding of cosines; vectors of one direction are equal in unit coordinates of this grid,
#: which is so fine that all their cosines are 1 to 9 decimals (in up to 500 dimensions).
FLOAT_ERROR, GRID = 1e-5, 1 << 20


class Tree(NamedTuple):
    """What the sample tells of a tree: where its array is cut, the first bits of crowds and their middles, and the sample's sorted strings."""

    cuts: np.ndarray
    crowds: np.ndarray
    middles: np.ndarray
    first: np.ndarray
    further: np.ndarray


@lru_cache(maxsize=1024)
def _turned(seed: int, dim: int, width: int) -> np.ndarray:
    """`width` planes, orthogonal as far as the dimension allows."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.normal(size=(dim, min(dim, width))))[0] for _ in range(-(-width // dim))]
    return np.concatenate(parts, axis=1)[:, :width].astype(np.float32)


def _first_bits(unit: np.ndarray, tree: int) -> np.ndarray:
    """The first 64 bits of each vector's string: letters, then sides of planes."""
    dim = unit.shape[1]
    width = min(dim, 64)
    bits, out = max(1, (2 * width - 1).bit_length()), np.zeros(len(unit), np.uint64)
    for letter in range(LETTERS):
        x = unit @ _turned(10_000 * (letter + 1) + tree, dim, width)
        at = np.abs(x).argmax(axis=1)
        sign = np.take_along_axis(x, at[:, None], axis=1)[:, 0] > 0
        out = (out << np.uint64(bits)) | (2 * at + sign).astype(np.uint64)
    left = 64 - LETTERS * bits
    for side in (unit @ _turned(1000 + tree, dim, left) > 0).T:
        out = (out << np.uint64(1)) | side.astype(np.uint64)
    return out


def _further_bits(unit: np.ndarray, tree: int, first: np.ndarray, crowds: np.ndarray, middles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last 64 bits of each string, and the number of its crowd (-1: none)."""
    x = unit @ _turned(5000 + tree, unit.shape[1], 64)
    crowd = np.full(len(unit), -1)
    if len(crowds):
        at = np.minimum(np.searchsorted(crowds, first), len(crowds) - 1)
        crowd = np.where(crowds[at] == first, at, -1)
        x[crowd >= 0] -= middles[crowd[crowd >= 0]]
    return np.packbits(x > 0, axis=1).view(">u8").ravel().astype(np.uint64), crowd


def _of_crowds(further: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """Strings of crowds as single numbers: the crowd and the first 48 of the further bits."""
    return (crowd.astype(np.uint64) << np.uint64(48)) | (further >> np.uint64(16))


def _joined(first: np.ndarray, further: np.ndarray) -> np.ndarray:
    return np.stack([first, further], axis=1).astype(">u8").view("S16").ravel()


def _sharing(sorted_strings: np.ndarray, strings: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """How many of the sorted strings have the first `bits` (1 to 64) bits in common with each of `strings`."""
    away = (64 - bits).astype(np.uint64)
    low = (strings >> away) << away
    return np.searchsorted(sorted_strings, low | ((np.uint64(1) << away) - np.uint64(1)), side="right") - np.searchsorted(sorted_strings, low)


def _longest(count, n: int, most: int, least: float) -> np.ndarray:
    """The largest number of bits, up to `most`, of which count(bits) is at least `least`, for n vectors at once; 0 if none."""
    low, high = np.zeros(n, np.int64), np.full(n, most)
    while (low < high).any():
        middle = (low + high + 1) // 2
        enough = count(middle) >= least
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    return low


def _depths(trees: list[Tree], strings: list[tuple[np.ndarray, ...]], wanted: float) -> np.ndarray:
    """The length of each vector's prefix, one for all trees: the longest that `wanted` vectors of the sample have in common with it, counted over all trees."""
    n, least = len(strings[0][0]), max(wanted, LEAST_SAMPLED)
    depth = _longest(lambda bits: sum(_sharing(t.first, s[0], bits) for t, s in zip(trees, strings)), n, 64, least)
    deep = np.flatnonzero(depth == 64)
    if len(deep):
        inside = [(t.further, _of_crowds(s[1][deep], s[2][deep]), s[2][deep] >= 0) for t, s in zip(trees, strings)]
        depth[deep] += _longest(lambda bits: sum(np.where(hot, _sharing(known, own, bits + 16), 0) for known, own, hot in inside), len(deep), 48, least)
    return np.minimum(depth + int(np.log2(least / wanted)), 128).astype(np.uint8)


def _plan(unit: np.ndarray, trees: int, stretches: int, wanted: float, least: float) -> list[Tree]:
    """The trees of a sample; `wanted` and `least` are counted in vectors of the sample."""
    found, strings = [], []
    for tree in range(trees):
        first = _first_bits(unit, tree)
        keys, counts = np.unique(first, return_counts=True)
        keys = keys[counts >= least]
        x = unit @ _turned(5000 + tree, unit.shape[1], 64)
        middles = np.array([np.median(x[first == key], axis=0) for key in keys], np.float32).reshape(-1, 64)
        further, crowd = _further_bits(unit, tree, first, keys, middles)
        strings.append((first, further, crowd))
        found.append(Tree(np.empty(0, "S16"), keys, middles, np.sort(first), np.sort(_of_crowds(further, crowd)[crowd >= 0])))
    depth = _depths(found, strings, wanted).astype(np.int64)
    at = np.arange(1, stretches) * len(unit) // stretches
    for tree, (first, further, _) in enumerate(strings):
        order = np.lexsort((further, first))[at]
        halves = np.stack([first[order], further[order]], axis=1)
        # A cut before the cell of a vector leaves the cell whole; only equal strings are cut where they stand.
        bits = depth[order]
        begin = halves.copy()
        for half, own in enumerate((np.minimum(bits, 64), np.maximum(bits - 64, 0))):
            mask = np.where(own > 0, ~np.uint64(0) << np.minimum(64 - own, 63).astype(np.uint64), np.uint64(0))
            begin[:, half] &= mask
        again = np.append(False, (halves[1:] == halves[:-1]).all(axis=1)) if len(at) else np.zeros(0, bool)
        begin[again] = halves[again]
        cuts = np.sort(_joined(begin[:, 0], begin[:, 1]))
        same = _joined(halves[again, 0], halves[again, 1])
        keep = np.append(True, cuts[1:] != cuts[:-1]) | np.isin(cuts, same) if len(cuts) else np.zeros(0, bool)
        found[tree] = found[tree]._replace(cuts=cuts[keep])
    return found


def _dealt(vids: np.ndarray, tree: int) -> np.ndarray:
    """Hashes that differ from tree to tree."""
    x = (vids.view(np.uint64) ^ np.uint64(tree * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(33)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fixed(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    rows = np.ascontiguousarray(rows)
    kind = pa.binary(rows.nbytes // max(len(rows), 1))
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _bytes(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _plant(dim: int, plan, wanted: float, rounded: bool):
    """(stretch, string, depth) of each vector and tree, with (vid, code, error) if rounded, else all columns given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[Tree] = plan.value
        for batch in batches:
            if not len(batch):
                continue
            exact = _unit(batch.column("embedding"), dim)
            unit = exact.astype(np.float32)
            vids = batch.column("vid").to_numpy()
            names, columns = batch.schema.names, batch.columns
            if rounded:
                codes = np.round(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)
                error = np.linalg.norm(exact - codes / np.linalg.norm(codes.astype(np.float64), axis=1, keepdims=True), axis=1) + FLOAT_ERROR
                names, columns = ["vid", "code", "error"], [batch.column("vid"), _fixed(codes), pa.array(error.astype(np.float32))]
            strings = []
            for number, tree in enumerate(trees):
                first = _first_bits(unit, number)
                strings.append((first, *_further_bits(unit, number, first, tree.crowds, tree.middles)))
            depth = pa.array(_depths(trees, strings, wanted).astype(np.int16))
            for number, (tree, (first, further, _)) in enumerate(zip(trees, strings)):
                string = _joined(first, further)
                at = np.searchsorted(tree.cuts, string, side="right")
                # Strings that are cut more than once share the stretches between.
                equal = at - np.searchsorted(tree.cuts, string, side="left")
                at = number * STRETCHES + at - _dealt(vids, number).astype(np.int64) % np.maximum(equal, 1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), _fixed(string), depth, *columns], ["stretch", "string", "depth", *names])

    return run


def _cells(halves: np.ndarray, depth: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, who): cells of a sorted array with one prefix each, and the vectors in it that are to be compared with the cell. Only cells of equal strings hold more than `most`."""
    few = min(FEW, most)
    open_, stack = depth < DONE, [(0, len(halves), 0)]
    while stack:
        begin, end, bit = stack.pop()
        if end - begin < 2:
            continue
        if end - begin <= most or bit == 128:
            here = open_[begin:end]
            who = begin + np.flatnonzero(here if end - begin <= few or bit == 128 else here & (depth[begin:end] <= bit))
            if len(who):
                yield begin, end, who
                open_[who] = False
            if not open_[begin:end].any():
                continue
        side = (halves[begin:end, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1)
        middle = begin + int(np.searchsorted(side, 1))
        stack += [(middle, end, bit + 1), (begin, middle, bit + 1)]


def _parted(unit: np.ndarray, most: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """The vectors halved along random directions, until `most` hold them."""
    stack = [np.arange(len(unit))]
    while stack:
        at = stack.pop()
        if len(at) <= most:
            yield at
        else:
            x = unit[at] - unit[at[0]]
            at = at[np.argsort(x @ rng.normal(size=x.shape[1]), kind="stable")]
            stack += [at[: len(at) // 2], at[len(at) // 2 :]]


def _may_be_best(unit: np.ndarray, error: np.ndarray, who: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the pairs of a cell, with i in `who`, of which j may be among the k best of i, and the vectors to be compared unrounded."""
    keep, crowd, found, rows = max(KEEP, k), np.zeros(len(unit), bool), [], max(1, BLOCK // len(unit))
    for at in range(0, len(who), rows):
        own = who[at : at + rows]
        s = unit[own] @ unit.T
        s[np.arange(len(own)), own] = -4
        i, j = np.nonzero(s >= least - 2 * error.max())
        value, high = s[i, j], s[i, j] + error[own[i]] + error[j]
        stay = high >= least
        i, j, value, high = i[stay], j[stay], value[stay], high[stay]
        ends = np.cumsum(np.bincount(i, minlength=len(own)))
        for row in np.flatnonzero(np.diff(ends, prepend=0) > keep):
            here = np.arange(ends[row - 1] if row else 0, ends[row])
            kth = np.partition(2 * value[here] - high[here], len(here) - k)[len(here) - k]
            maybe = high[here] >= kth
            if maybe.sum() > keep:
                crowd[own[row]] = True
                crowd[j[here[maybe]]] = True
                maybe[:] = False
            high[here[~maybe]] = -4
        stay = high > -4
        found.append((own[i[stay]], j[stay], value[stay]))
    i, j, value = (np.concatenate(c) for c in zip(*found))
    return i, j, value, np.flatnonzero(crowd)


def _best(unit: np.ndarray, who: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the k best others j of each i in `who`; ties go to the one that stands first."""
    found, k, rows = [], min(k, len(unit) - 1), max(1, BLOCK // len(unit))
    for at in range(0, len(who), rows):
        own = who[at : at + rows]
        s = np.round(unit[own] @ unit.T, 9)
        s[np.arange(len(own)), own] = -4
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        best = s > kth
        tied = s == kth
        best |= tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - best.sum(1, keepdims=True))
        best &= s >= least
        i, j = np.nonzero(best)
        found.append((own[i], j, s[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _pairs(a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Pairs a < b, each once, with their values."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    keep = order[np.append(True, (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0))] if len(order) else order
    return [low[keep], high[keep], *(v[keep] for v in values)]


def _search(dim: int, most: int, rounded: bool, least: float, k: int):
    """The pairs in the cells of sorted stretches: (a, b, near, error), with a row (a, null, null, null) for each vector to be compared unrounded; or (a, b, cosine)."""

    def rounded_pairs(cells, vids: np.ndarray, codes: np.ndarray, error: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "near", "error"]
        for begin, end, who in cells:
            here = vids[begin:end]
            if end - begin > most:
                crowd = np.arange(end - begin)
            else:
                x = codes[begin:end].astype(np.float32)
                i, j, near, crowd = _may_be_best(x / np.linalg.norm(x, axis=1, keepdims=True), error[begin:end], who - begin, least, k)
                columns = _pairs(here[i], here[j], near, error[begin + i] + error[begin + j])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
            if len(crowd):
                none = len(crowd)
                yield pa.RecordBatch.from_arrays([pa.array(here[crowd]), pa.nulls(none, pa.int64()), pa.nulls(none, pa.float32()), pa.nulls(none, pa.float32())], names)

    def exact_pairs(cells, vids: np.ndarray, places: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        for begin, end, who in cells:
            asking = np.zeros(end - begin, bool)
            asking[who - begin] = True
            for part in _parted(unit[begin:end], most, np.random.default_rng(abs(int(vids[begin])))):
                part = part[np.argsort(places[begin + part])]
                if len(part) > 1 and asking[part].any():
                    i, j, cosine = _best(unit[begin + part], np.flatnonzero(asking[part]), least, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _pairs(vids[begin + part[i]], vids[begin + part[j]], cosine)], ["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        current, size = None, 0

        def work(whole: bool) -> Iterator[pa.RecordBatch]:
            """What is held of a stretch. Unless it is whole, the cells that may go on are held on, from the first of their vectors on."""
            nonlocal size
            if not held:
                return
            strings, depth, *columns = (np.concatenate(c) for c in zip(*held))
            held.clear()
            size = 0
            cells = list(_cells(strings.view(">u8").reshape(-1, 2).astype(np.uint64), depth, most))
            if not whole:
                going_on = [c for c in cells if c[1] == len(strings)]
                left = min((c[0] for c in going_on), default=len(strings))
                if 0 < left:
                    cells = [c for c in cells if c[1] < len(strings)]
                    # Who has been compared already asks for nothing more, but stays as a candidate.
                    asked = np.concatenate([c[2] for c in cells]) if cells else np.empty(0, np.int64)
                    depth[asked] = DONE
                    held.append([strings[left:], depth[left:], *(c[left:] for c in columns)])
                    size = len(strings) - left
            yield from (rounded_pairs if rounded else exact_pairs)(cells, *columns)

        for batch in batches:
            if not len(batch):
                continue
            stretch = batch.column("stretch").to_numpy()
            columns = [_bytes(batch.column("string"), "S16"), batch.column("depth").to_numpy(), batch.column("vid").to_numpy()]
            if rounded:
                columns += [_bytes(batch.column("code"), np.int8).reshape(-1, dim), batch.column("error").to_numpy()]
            else:
                columns += [batch.column("place").to_numpy(), _unit(batch.column("embedding"), dim)]
            begins = np.flatnonzero(np.diff(stretch, prepend=-1))
            for begin, end in zip(begins, np.append(begins[1:], len(stretch))):
                if stretch[begin] != current:
                    yield from work(True)
                    current = stretch[begin]
                elif size + end - begin > HELD:
                    yield from work(False)
                held.append([c[begin:end] for c in columns])
                size += end - begin
        yield from work(True)

    return run


def _exact(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for c in (2, 3))
            cosine = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(cosine, 9))], ["a", "b", "cosine"])

    return run


def _directions(dim: int):
    """(vid, grid): the unit vector on the grid, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                grid = np.round(_unit(batch.column("embedding"), dim) * GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("vid"), _fixed(grid)], ["vid", "grid"])

    return run


def usable_vectors(df: DataFrame, id_col: str, embedding_col: str, dim: int) -> DataFrame:
    """id (as string), embedding of the rows whose embedding has exactly `dim` elements, all finite and not all zero."""
    given = df[embedding_col]
    if df.schema[embedding_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        given = given.cast("array<double>")
    rows = df.select(df[id_col].cast("string").alias("id"), given.alias("embedding")).where("id is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return rows.where((F.size("embedding") == dim) & finite & F.exists("embedding", lambda x: x != 0))


def similar_vectors(df: DataFrame, id_col: str, embedding_col: str, dim: int = 64, k: int = 5, least: float = 0.85, trees: int = TREES, wanted: int = WANTED, most: int = CELL) -> DataFrame:
    """id, neighbour, cosine: for each usable vector its up to k most similar other ones.

    Similarity is the cosine in double precision, rounded to 9 decimals; ties go to the smaller id, and only
    neighbours of at least `least` stay. Usable is a vector of `dim` elements, all finite, not all zero; a
    repeated id with the same vector counts once, and null ids are left out. Equal vectors are searched for as one; each of
    them gets its own rows. The cosines are exact, but a neighbour may be missed, and one further off then takes its place;
    more `trees` and more candidates (`wanted`, over all trees) miss fewer. A table of at most `most` vectors is compared whole.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = usable_vectors(df, id_col, embedding_col, dim).withColumn("vid", F.xxhash64("embedding"))
    classes = materialize(rows.groupBy("vid").agg(F.first("embedding").alias("embedding"), F.min("id").alias("first")), "vectors")
    kind = classes.schema["embedding"].dataType.simpleString()
    total = classes.count()
    trees = trees if total > most else 1
    # Chosen by a hash, so no task holds more than its share of the sample.
    share = min(1.0, SAMPLE / max(total, 1))
    sample = classes.where(F.pmod(F.xxhash64("vid"), F.lit(1 << 30)) < F.lit(round(share * (1 << 30)))).select("embedding").toArrow().column(0).combine_chunks()
    asked = wanted * len(sample) / max(total, 1)
    stretches = max(1, min(-(-total // STRETCH), SAMPLE // 8))
    plan = spark.sparkContext.broadcast(_plan(_unit(sample, dim).astype(np.float32), trees, stretches, asked, max(LEAST_SAMPLED, asked / trees)) if len(sample) else [])

    def forest(vectors: DataFrame, rounded: bool, columns: str, found: str) -> DataFrame:
        planted = vectors.mapInArrow(_plant(dim, plan, asked if rounded else CROWDED * asked, rounded), f"stretch int, string binary, depth short, {columns}")
        parts = total * trees * (dim + 48) // PARTITION
        spread = planted.repartition(parts, "stretch") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else planted.repartition("stretch")
        return spread.sortWithinPartitions("stretch", "string", F.xxhash64("vid", "stretch")).mapInArrow(_search(dim, most, rounded, least, k), found)

    near = forest(classes.select("vid", "embedding"), True, "vid bigint, code binary, error float", "a bigint, b bigint, near float, error float")
    near = materialize(near.groupBy("a", "b").agg(F.first("near").alias("near"), F.first("error").alias("error")), "near")
    turned = lambda *c: F.inline(F.array(F.struct(F.col("a").alias("vid"), F.col("b").alias("other"), *c), F.struct(F.col("b").alias("vid"), F.col("a").alias("other"), *c)))
    both = near.where("b is not null").select(turned("near", "error"))
    lows = Window.partitionBy("vid").orderBy(F.desc(F.col("near") - F.col("error"))).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kth = F.coalesce(F.nth_value(F.col("near") - F.col("error"), k).over(lows), F.lit(-4.0))
    chosen = both.withColumn("kth", kth).where(F.col("near") + F.col("error") >= F.col("kth")).select(F.least("vid", "other").alias("a"), F.greatest("vid", "other").alias("b")).distinct()
    of = lambda x: classes.select(F.col("vid").alias(x), F.col("embedding").alias(f"embedding_{x}"))
    exact = chosen.join(of("a"), "a").join(of("b"), "b").select("a", "b", "embedding_a", "embedding_b").mapInArrow(_exact(dim), "a bigint, b bigint, cosine double").where(F.col("cosine") >= least)

    crowd = near.where("b is null").select(F.col("a").alias("vid"))
    crowded = not crowd.isEmpty()
    if crowded:
        # Their place in the order of their smallest ids decides ties.
        crowd = classes.join(crowd, "vid", "left_semi").orderBy("first").select("vid", "embedding", F.monotonically_increasing_id().alias("place"))
        crowd = materialize(crowd, "crowd")
        again = forest(crowd, False, f"vid bigint, embedding {kind}, place bigint", "a bigint, b bigint, cosine double")
        exact = exact.unionByName(again).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))

    # k + 1 ids of a class stand for all of them: any id's neighbours in a class are among its k + 1 smallest ids.
    members = rows.select("vid", "id").distinct()
    smallest = lambda df, key: df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where(F.col("rank") <= k + 1).groupBy(key).agg(F.collect_list("id").alias("ids"))
    first = smallest(members, "vid")
    links = exact.select(turned("cosine"))
    itself = first.where(F.size("ids") > 1).select("vid", F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    across = links.join(first.withColumnRenamed("vid", "other"), "other").select("vid", "cosine", F.explode("ids").alias("neighbour"))
    pairs = across.unionByName(itself)
    if crowded:
        # Vectors of one direction, however many, are met through the direction; their cosines are 1.
        directions = crowd.mapInArrow(_directions(dim), "vid bigint, grid binary").select("vid", F.xxhash64("grid").alias("direction"))
        alike = smallest(members.join(directions, "vid").select("direction", "id"), "direction")
        alike = directions.join(alike, "direction").select("vid", F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
        pairs = pairs.unionByName(alike).repartition("vid").groupBy("vid", "neighbour").agg(F.max("cosine").alias("cosine"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("rank") <= k + 1)
    lists = ranked.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "cosine"))).alias("list"))
    own = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return members.join(lists, "vid").select("id", F.inline(own)).select("id", "neighbour", "cosine")


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """id_a < id_b of the pairs of which at least one is a neighbour of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
