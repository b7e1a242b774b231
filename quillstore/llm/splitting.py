"""Oversized texts cut into overlapping pieces at natural boundaries, by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strengths of the boundaries between neighbouring segments; pieces are cut at the strongest that fit.
INSIDE, BLANK, CLAUSE, WRAP, SENTENCE, LINE, PARAGRAPH, HEADING = range(8)
_NAMES = ("inside", "blank", "clause", "wrap", "sentence", "line", "paragraph", "heading")
_SPACE = re.compile("[ \t\r\n]+")
_STRONG = re.compile("(?<=[.!?…:])[ \t\r\n]+|[ \t\r]*\n[ \t\r\n]*")
_CLAUSE = re.compile("(?<=[,;)])[ \t\r\n]+")


def _strength(text: str, begin: int, end: int) -> int:
    """Of the boundary after the white space text[begin:end]."""
    lines = text.count("\n", begin, end)
    last = text[begin - 1] if begin else ""
    if lines and text.startswith("#", end):
        return HEADING
    if lines > 1:
        return PARAGRAPH
    if lines and (last in ".!?…:" or text[end : end + 2] in ("- ", "* ", "+ ", "> ")):
        return LINE
    if last in ".!?…:" and last:
        return SENTENCE
    if lines:
        return WRAP
    return CLAUSE if last and last in ",;)" else BLANK


def _segments(text: str, begin: int, end: int, room: int, patterns: tuple[re.Pattern, ...]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, strength of the boundary at the end, length of the run cut there) of segments of at most `room` characters; the last strength is to be ignored."""
    if not patterns:
        # One run without white space, and what white space follows it.
        run = len(text[begin:end].rstrip(" \t\r\n"))
        for at in range(begin, end, room):
            inside = at + room < begin + run
            yield at, min(at + room, end), INSIDE if inside else BLANK, run if inside else 0
        return
    spans, at = [], begin
    for m in patterns[0].finditer(text, begin, end):
        if at < m.end() < end:
            spans.append((at, m.end(), _strength(text, m.start(), m.end())))
            at = m.end()
    spans.append((at, end, INSIDE))
    for a, z, strength in spans:
        if z - a <= room:
            yield a, z, strength, 0
        else:
            *inner, (x, y, _, _) = _segments(text, a, z, room, patterns[1:])
            yield from inner
            yield x, y, strength, 0


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, strength of the boundary at the start, length of the run cut there) of consecutive spans that cover the text.

    The first span is at most `limit` characters long, every other at most limit - overlap. Neighbouring segments wait
    in a heap, those with the weakest boundary first, among these the leftmost, so that spans fill up; a pair is merged if
    the sum fits, and can never fit later if it doesn't.
    """
    room = limit - overlap
    found = list(_segments(text, 0, len(text), room, (_STRONG, _CLAUSE, _SPACE)))
    start, end, strength, run = [list(x) for x in zip(*found)]
    n = len(found)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(strength[i], i, i + 1, end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, i, j, z = heapq.heappop(heap)
        if not (alive[i] and alive[j] and right[i] == j and end[j] == z):
            continue
        if z - start[i] > (room if start[i] else limit):
            continue
        alive[j], end[i], strength[i], run[i], right[i] = False, z, strength[j], run[j], right[j]
        if right[i] < n:
            k = right[i]
            left[k] = i
            heapq.heappush(heap, (strength[i], i, k, end[k]))
        if left[i] >= 0:
            heapq.heappush(heap, (strength[left[i]], left[i], i, z))
    kept = [i for i in range(n) if alive[i]]
    return [(start[i], end[i], *((strength[kept[p - 1]], run[kept[p - 1]]) if p else (HEADING, 0))) for p, i in enumerate(kept)]


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int = 200) -> DataFrame:
    """item_id, ord, start, shared, body, boundary, run: the pieces of each text longer than `limit` characters.

    Pieces are numbered from 0 per item; each is at most `limit` characters (code points) long and, but for the first,
    begins with the last `overlap` characters of the piece before (shared), exactly, be they within a word or not. Without these,
    the pieces laid end to end are the text; start is where the piece's own part begins. boundary names the natural boundary
    before that part; it is `inside` where a run without space, tab, CR or LF had to be cut, and run is the length of that
    run then, else 0. Shorter and null texts give no rows; repeated rows of one id and text give their
    pieces once; null ids stay. Other columns are ignored. Only the oversized rows leave the JVM or are shuffled.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for n, (a, z, strength, cut) in enumerate(split_text(text, limit, overlap)):
                    shared = min(overlap, a)
                    rows.append((item, n, a, shared, text[a - shared : z], "start" if not n else _NAMES[strength], cut))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    long = df.select(df[id_col].cast("string").alias("item_id"), df[text_col].alias("text")).where(F.length("text") > limit)
    once = long.withColumn("hash", F.xxhash64("text")).dropDuplicates(["item_id", "hash"]).select("item_id", "text")
    return once.mapInArrow(run, "item_id string, ord int, start bigint, shared int, body string, boundary string, run bigint")


def pieces_laid_out(pieces: DataFrame, keys: list[str], limit: str) -> DataFrame:
    """keys, digest, n_chars, n_pieces, fits, overlaps: per item, the MD5 and length of its pieces' own parts laid end to end, and whether all pieces keep to the column `limit` and begin with the end of the one before."""
    each = pieces.select(*keys, F.col(limit).alias("limit"), F.struct("ord", F.expr("substring(body, shared + 1)").alias("own"), "shared", "body").alias("piece"))
    items = each.groupBy(*keys).agg(F.array_sort(F.collect_list("piece")).alias("p"), F.max("limit").alias("limit"))
    text = F.array_join(F.transform("p", lambda x: x["own"]), "")
    follows = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.expr("true") & (F.get("p", i)["ord"] == i) & F.get("p", i - 1)["body"].endswith(F.substring(F.get("p", i)["body"], F.lit(1), F.get("p", i)["shared"])))
    return items.select(*keys, F.md5(text).alias("digest"), F.length(text).alias("n_chars"), F.size("p").alias("n_pieces"), F.forall("p", lambda x: F.length(x["body"]) <= F.col("limit")).alias("fits"), F.when(F.size("p") > 1, follows).otherwise(True).alias("overlaps"))


_SCHEMA = pa.schema([("item_id", pa.string()), ("ord", pa.int32()), ("start", pa.int64()), ("shared", pa.int32()), ("body", pa.string()), ("boundary", pa.string()), ("run", pa.int64())])
