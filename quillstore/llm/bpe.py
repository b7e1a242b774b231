"""Byte-level BPE of a whole corpus in batched numpy merge rounds.

The texts of a batch are split into words by classes of characters, all at once; words are told apart by a hash, and
only words that the task hasn't met are merged. For these, the symbols of many words lie in one flat array: each round
looks up all neighbouring pairs by binary search over the sorted pair keys, and merges in every word its pairs of the
lowest rank. Words without a pair left drop out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillstore.llm.shingles import _odd, mix

#: Characters that are split at once, and words that a task remembers; both only bound the memory.
CHARS = 1 << 19
REMEMBERED = 1 << 20
_NONE = np.int64(1) << 40
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: The endings that the public pattern splits off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Ranks:
    """A vocabulary as sorted arrays: `keys` of pairs of symbols, `merged` (rank and id of their union), `of_byte`."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys, merged = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], merged[order]

    @classmethod
    def read(cls, path: str) -> Ranks:
        """From a file with a token in base64 and its rank per line; every single byte must be a token."""
        rows = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in rows})


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, range(0xD800))) + "\ue000" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, everything):
            table[found.start() : found.end()] = kind
    return table


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, text number): the words of all texts by where they start in the UTF-8 bytes laid end to end.

    A word is an apostrophe with one of the fixed endings, or a run of letters, of numbers or of other characters with
    a blank before it, if any; of a run of white space before a word, the last character stands by itself or, if it
    is a blank, goes to that word.
    """
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _classes()[points]
    ends = np.cumsum([len(t) for t in texts])
    begins = np.zeros(len(points) + 1, bool)
    begins[0] = True
    begins[ends] = True
    run = begins.copy()
    run[1:-1] |= kind[1:] != kind[:-1]
    start = run[:-1].copy()
    blank = points == 32
    space = kind == _SPACE
    # The last of a run of white space starts a word if something else follows in the same text; a blank takes it along.
    follows = np.zeros(len(points), bool)
    follows[:-1] = space[:-1] & ~space[1:] & ~begins[1:-1]
    start |= follows
    start[1:] &= ~(follows[:-1] & blank[:-1])
    # Contractions: an apostrophe that is a run of its own, without a blank before it, and letters after it.
    marks = np.flatnonzero((points[:-1] == 39) & run[:-2] & run[1:-1] & (kind[1:] == _LETTER) & ~begins[1:-1] & start[:-1])
    for ending in _ENDINGS:
        size = len(ending)
        at = marks[marks + size < len(points)]
        for i, c in enumerate(ending):
            at = at[(points[at + 1 + i] == ord(c)) & ((i == 0) | ~begins[at + 1 + i])]
        start[at + 1] = False
        inner = at + 1 + size
        start[inner[inner < len(points)]] = True
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.flatnonzero(start)
    places = np.cumsum(sizes) - sizes
    return np.frombuffer(joined.encode(), np.uint8), places[at], np.searchsorted(ends, at, side="right")


def merge_words(ranks: Ranks, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words given as bytes and offsets, in rounds over one flat array of symbols."""
    n = len(offsets) - 1
    symbols = ranks.of_byte[data]
    word = np.repeat(np.arange(n), np.diff(offsets))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        rank = np.full(len(symbols), _NONE)
        key = (symbols[:-1] << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(ranks.keys, key), len(ranks.keys) - 1)
        hit = (ranks.keys[at] == key) & (word[:-1] == word[1:])
        rank[:-1][hit] = ranks.merged[at[hit]]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
        over = lowest == _NONE
        if over.any():
            done.append((word[over], symbols[over]))
            symbols, word, rank, lowest = symbols[~over], word[~over], rank[~over], lowest[~over]
            if not len(symbols):
                break
        merge = rank == lowest
        # Of overlapping pairs (three or more equal symbols), every second one from the left is merged.
        where = np.flatnonzero(merge)
        head = np.flatnonzero(np.diff(where, prepend=-2) > 1)
        place = np.arange(len(where)) - np.repeat(head, np.diff(np.append(head, len(where))))
        where = where[place % 2 == 0]
        symbols[where] = rank[where]
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done:
        return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
    word, symbols = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
    order = np.argsort(word, kind="stable")
    return symbols[order].astype(np.int32), np.append(0, np.cumsum(np.bincount(word, minlength=n)))


def _take(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of `rows`, end to end, and their sizes."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) - np.repeat(ends - sizes - offsets[rows], sizes)], sizes


class Encoder:
    """Encodes batches of texts and remembers the words it has merged."""

    def __init__(self, ranks: Ranks) -> None:
        self.ranks = ranks
        self._forget()

    def _forget(self) -> None:
        self.known, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of all texts end to end, and how many each text has."""
        data, starts, text = split_words(texts)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        sizes = np.diff(np.append(starts, len(data)))
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        hashes = mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _odd(int(sizes.max()), 5)[place], starts) + sizes.astype(np.uint64))
        seen, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(seen, self.known, assume_unique=True)
        if len(self.known) + new.sum() > REMEMBERED and len(self.known):
            self._forget()
            new[:] = True
        if new.any():
            spans = first[new]
            word_bytes, lengths = _take(data, np.append(starts, len(data)), spans)
            ids, offsets = merge_words(self.ranks, word_bytes, np.append(0, np.cumsum(lengths)))
            rows = np.arange(len(self.offsets) - 1, len(self.offsets) - 1 + len(spans))
            self.ids, self.offsets = np.concatenate([self.ids, ids]), np.append(self.offsets, self.offsets[-1] + offsets[1:])
            at = np.searchsorted(self.known, seen[new])  # both are sorted
            self.known, self.row = np.insert(self.known, at, seen[new]), np.insert(self.row, at, rows)
        ids, counts = _take(self.ids, self.offsets, self.row[np.searchsorted(self.known, seen)][which])
        return ids, np.bincount(text, weights=counts, minlength=len(texts)).astype(np.int64)


def _cuts(text: str) -> list[str]:
    """A long text in pieces of about CHARS characters, cut before a blank between two other characters, where a word starts in any case."""
    pieces, begin = [], 0
    while len(text) - begin > CHARS:
        cut = regex.compile(r"[^\s] (?=[^\s])").search(text, begin + CHARS)
        if not cut:
            break
        pieces.append(text[begin : cut.start() + 1])
        begin = cut.start() + 1
    return [*pieces, text[begin:]]


def encode_texts(encoder: Encoder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of any number of texts, of any length, a bounded number of characters at a time."""
    ids, sizes = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
    block: list[str] = []
    owner: list[int] = []
    chars = 0

    def flush() -> None:
        got, counts = encoder(block)
        ids.append(got)
        np.add.at(sizes, owner, counts)

    for i, text in enumerate(texts):
        for piece in _cuts(text) if text else ():
            if block and chars + len(piece) > CHARS:
                flush()
                block, owner, chars = [], [], 0
            block.append(piece)
            owner.append(i)
            chars += len(piece)
    if block:
        flush()
    return np.concatenate(ids), sizes


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """`id_col`, ids (array<int>) of each row: its text under the byte-level BPE in the file `vocabulary`, without special tokens.

    A null or empty text has an empty list. Every row gives a row, repeated ones too, and other columns are ignored.
    The special tokens' strings are ordinary text. The file is read on the driver and sent to the tasks (about 3 MB).
    """
    ranks = df.sparkSession.sparkContext.broadcast(Ranks.read(vocabulary))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            ids, sizes = encode_texts(encoder, batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "ids"])

    return df.select(df[id_col], df[text_col]).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
