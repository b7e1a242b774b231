"""Evaluation texts inside a corpus, found with an Aho-Corasick automaton over the normalised test items.

Items and documents are compared by their words: the longest runs of a-z and 0-9 in the lower-cased text. The words of
the items are numbered, and each document is turned into numbers once (0 for a word that no item has) and scanned once.
The automaton's patterns are sequences of these numbers: all words of an item that has fewer than asked for, and every
half as many from the beginning of a longer one, without overlap. Any run of the words asked for holds one of these whole, so
the automaton has a node per word instead of one per word and run; the runs around its matches are then looked up
in the sorted runs of the items.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstore.llm.shingles import _odd, mix

WORD = re.compile("[a-z0-9]+")
#: Words of test items that one automaton holds; a larger set of items is scanned for in blocks of this size.
BLOCK_WORDS = 1_000_000


class _Matcher:
    """The automaton of a block of items, and the runs of the long ones."""

    def __init__(self, items: list[tuple[int, str]], words: int) -> None:
        self.words, self.numbers, half = words, {}, (words + 1) // 2
        patterns: dict[tuple[int, ...], tuple[bool, list[int]]] = {}
        long, owners = [np.empty(0, np.int64)], []
        for item, text in items:
            codes = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in WORD.findall(text.lower())]
            if len(codes) >= words:
                for i in range(0, len(codes) - half + 1, half):
                    key = tuple(codes[i : i + half])
                    patterns[key] = (True, patterns.get(key, (False, []))[1])
                long.append(np.array([*codes, -1]))
                owners.append((item, len(codes) + 1))
            elif codes:
                part, short = patterns.setdefault(tuple(codes), (False, []))
                if item not in short:
                    short.append(item)
        self.codes = np.concatenate(long)
        item = np.repeat(np.array([i for i, _ in owners], np.int64), np.array([n for _, n in owners], np.int64))
        start = np.flatnonzero(self._whole(self.codes))
        runs, item = self._hashes(self.codes, start), item[start]
        order = np.lexsort((start, item, runs))
        runs, item, start = runs[order], item[order], start[order]
        new = np.append(True, (runs[1:] != runs[:-1]) | (item[1:] != item[:-1])) if len(runs) else np.empty(0, bool)
        self.runs, self.item, self.start = runs[new], item[new], start[new]
        self.automaton = None
        if patterns:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for pattern, (part, short) in patterns.items():
                self.automaton.add_word(pattern, (len(pattern), part, short))
            self.automaton.make_automaton()

    def _whole(self, codes: np.ndarray) -> np.ndarray:
        """Where a run begins that doesn't reach into the next item."""
        ends = np.append(0, np.cumsum(codes < 0))
        n = max(len(codes) - self.words + 1, 0)
        return ends[self.words : self.words + n] == ends[:n]

    def _hashes(self, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
        total = np.zeros(len(start), np.uint64)
        for i, odd in enumerate(_odd(self.words, 13)):
            total += mix(codes[start + i].astype(np.uint64)) * odd
        return mix(total)

    def find(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(item, first word, last word, number of matches) of each item that the words hold."""
        known, near, spans = self.numbers.get, set(), {}
        codes = tuple([known(w, 0) for w in words])
        for end, (size, part, short) in self.automaton.iter(codes):
            for item in short:
                span = spans.setdefault(item, [end - size + 1, end, 0])
                span[1], span[2] = end, span[2] + 1
            if part:
                near.update(range(max(end - self.words + 1, 0), min(end - size + 1, len(codes) - self.words) + 1))
        found = [(item, *span) for item, span in spans.items()]
        if near:
            start, own = np.array(sorted(near)), np.array(codes)
            runs = self._hashes(own, start)
            low = np.searchsorted(self.runs, runs)
            sizes = np.searchsorted(self.runs, runs, side="right") - low
            at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            start = np.repeat(start, sizes)
            window = np.arange(self.words)
            same = (own[start[:, None] + window] == self.codes[self.start[at][:, None] + window]).all(axis=1)
            item, start = self.item[at[same]], start[same]
            order = np.lexsort((start, item))
            item, start = item[order], start[order]
            first = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
            last = np.append(first[1:], len(item))[: len(first)] - 1
            found += zip(item[first].tolist(), start[first].tolist(), (start[last] + self.words - 1).tolist(), (last - first + 1).tolist())
        return found


#: The matcher that this worker built last, by the name of its items.
_BUILT: dict[str, _Matcher] = {}


def _matcher(name: str, items, words: int) -> _Matcher:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = _Matcher(items.value, words)
    return _BUILT[name]


def _original_words(text: str) -> list[tuple[int, int]]:
    """Start and end, in the original text, of each word. Lower-casing may change the length, so it is done by character where it does."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    origin, parts = [], []
    for i, c in enumerate(text):
        part = c.lower()
        parts.append(part)
        origin += [i] * len(part)
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer("".join(parts))]


def _scan(items, words: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, items, words)
        for batch in batches:
            docs, found = batch.column(0), []
            for i, text in enumerate(batch.column(1).to_pylist() if matcher.automaton else ()):
                matches = matcher.find(WORD.findall(text.lower()))
                if matches:
                    at = _original_words(text)
                    found += [(item, i, at[a][0], at[z][1], n) for item, a, z, n in matches]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), docs.take(pa.array(columns[1], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[2:])],
                ["item_id", "doc_id", "first_char", "end_char", "matches"],
            )

    return run


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 12) -> DataFrame:
    """item_id, doc_id, first_char, end_char, matches: the documents that share `words` successive words with an item.

    An item of fewer words must occur with all of them, consecutively; one without words is never found. first_char
    and end_char bound, in characters of the original text, everything from the first to the last match; matches
    counts the places where one begins. Null and empty texts have no words; a repeated item gives its rows once, two items
    with one text each their own. Items are the stated query set: they are sent to all tasks, and a worker builds the
    automaton once. A set of more than BLOCK_WORDS words takes a scan of the documents for every so many. Both ids are integers.
    """
    spark = documents.sparkSession
    docs = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text")).where("text is not null and doc_id is not null")
    rows = items.select(items[item_id].cast("bigint").alias("item_id"), items[item_text].alias("text")).where("text is not null and item_id is not null").distinct()
    schema = "item_id bigint, doc_id bigint, first_char bigint, end_char bigint, matches bigint"
    found, block, size = None, [], 0
    iterator = rows.orderBy("item_id", "text").toLocalIterator()
    for row in _with_end(iterator):
        if row is not None:
            block.append((row.item_id, row.text))
            size += len(WORD.findall(row.text.lower()))
        if block and (row is None or size >= BLOCK_WORDS):
            part = docs.mapInArrow(_scan(spark.sparkContext.broadcast(block), words), schema)
            found = part if found is None else found.unionByName(part)
            block, size = [], 0
    return found if found is not None else spark.createDataFrame([], schema)


def _with_end(rows):
    yield from rows
    yield None


def leaked_documents(found: DataFrame) -> DataFrame:
    """doc_id, items (ascending), n_items, matches: one row per document that leaks."""
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.countDistinct("item_id").alias("n_items"), F.sum("matches").alias("matches"))
