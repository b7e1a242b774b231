"""Word shingles of many texts at once, as numpy arrays of 64-bit hashes.

A word is a longest run of a-z and 0-9 in the lower-cased text. All texts of an Arrow batch are laid end to end in one
byte array; words, their hashes and the hashes of k successive words are then found by whole-array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once; bounds the memory of a task.
PIECE = 1 << 20
_WORD_BYTES = np.zeros(256, np.uint8)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _WORD_BYTES[_c] = _i + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers (a bijection)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _pieces(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about PIECE bytes that end outside words."""
    begin = 0
    while begin < len(codes):
        end = min(begin + PIECE, len(codes))
        while end < len(codes):
            gap = np.flatnonzero(codes[end : end + PIECE] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + PIECE, len(codes))
        yield begin, end
        begin = end


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 2 * PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in batches with about `size` bytes of text in a column (one text may be longer); bounds the memory of a task."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        begin = 0
        while begin < len(batch):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word, in order. A null text has no words."""
    lowered = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)
    codes = _WORD_BYTES[np.frombuffer(("\n".join(lowered) + "\n").encode("ascii", "replace"), np.uint8)]
    hashes, begins = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for left, right in _pieces(codes):
        at = np.flatnonzero(codes[left:right])
        if not len(at):
            continue
        begin = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        lengths = np.diff(np.append(begin, len(at)))
        place = np.arange(len(at)) - np.repeat(begin, lengths)
        values = codes[left:right][at] * _odd(int(lengths.max()), 7)[place]
        hashes.append(mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        begins.append(at[begin] + left)
    return np.concatenate(hashes), np.searchsorted(ends, np.concatenate(begins), side="right")


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct k-word shingles of text i are hashes[offsets[i]:offsets[i + 1]], ascending as unsigned numbers but for the lowest 16 bits."""
    words, rows = word_hashes(texts)
    n = len(texts)
    if len(words) < k:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    whole = rows[: len(rows) - k + 1] == rows[k - 1 :]
    total = np.zeros(len(whole), np.uint64)
    for i, m in enumerate(_odd(k, 11)):
        total += words[i : len(words) - k + 1 + i] * m
    hashes, rows = mix(total[whole]), rows[: len(whole)][whole]
    if not len(hashes):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    order = np.argsort((rows.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))) if n < 1 << 16 else np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.append(0, np.cumsum(np.bincount(rows, minlength=n))).astype(np.int64)


def set_hashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set, the same for equal sets; 0 for an empty set."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        out[full] = mix(np.add.reduceat(mix(hashes + np.uint64(0x632BE59BD9B4E019)), offsets[:-1][full]) + sizes[full].astype(np.uint64))
    return out
