"""WordPiece encoding of text columns with a given vocabulary, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


#: Different words that a task remembers.
REMEMBERED = 1 << 18
#: White space that stays when a text is cleaned, and any.
_BLANKS = "[\t\n\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANK, _SPACE = re.compile(f"{_BLANKS}+"), re.compile(r"\s+")
_PART, _WORD = re.compile(_BLANKS.replace("[", "[^") + "+"), re.compile(r"\S+")


class VocabularyError(ValueError):
    """A vocabulary that can't be used, or an id outside it."""


@dataclass(frozen=True)
class WordPiece:
    """A vocabulary and how texts are prepared for it; small enough to be sent with each task."""

    tokens: tuple[str, ...]
    lowercase: bool = True
    clean: bool = True
    split_cjk: bool = True
    strip_accents: bool = True
    longest_word: int = 100
    max_length: int = 512
    ids: dict[str, int] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        ids = {t: i for i, t in enumerate(self.tokens)}
        if not self.tokens or len(ids) != len(self.tokens):
            raise VocabularyError("the vocabulary is empty or has a token twice")
        if missing := [t for t in SPECIAL if t not in ids]:
            raise VocabularyError(f"missing special tokens: {missing}")
        object.__setattr__(self, "ids", ids)

    def normalize(self, text: str) -> str:
        """Clean, put blanks around CJK characters, strip accents, lower-case, as far as asked for; white space becomes blanks one by one."""
        if self.clean:
            text = "".join(" " if c.isspace() else c for c in text if c in "\t\n\r" or not (c in "\0�" or unicodedata.category(c)[0] == "C"))
        if self.split_cjk:
            text = "".join(f" {c} " if _is_cjk(c) else c for c in text)
        if self.strip_accents:
            text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        return text.lower() if self.lowercase else text

    def words(self, text: str) -> list[str]:
        """Runs between white space; every punctuation character is a word of its own, special tokens stay whole."""
        found, run = [], []
        at = 0
        while at < len(text):
            special = next((s for s in SPECIAL if text.startswith(s, at)), None)
            c = text[at]
            if special or c.isspace() or _is_punctuation(c):
                if run:
                    found.append("".join(run))
                    run = []
                if special or not c.isspace():
                    found.append(special or c)
                at += len(special or c)
            else:
                run.append(c)
                at += 1
        return [*found, "".join(run)] if run else found

    def pieces(self, word: str) -> list[int]:
        """The longest tokens from the left, later ones with ##; the unknown token alone if that fails or the word is too long."""
        if len(word) > self.longest_word:
            return [self.ids["[UNK]"]]
        found, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in self.ids), None)
            if end is None:
                return [self.ids["[UNK]"]]
            found.append(self.ids[("##" if at else "") + word[at:end]])
            at = end
        return found

    def normalize_with_origin(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The normal form, character by character, and the bytes of the original that each of its characters comes from."""
        out, origin, at = [], [], 0
        for c in text:
            # Accents may stand apart from their letter, so each character is taken by itself.
            for x in self.normalize(c):
                out.append(x)
                origin.append((at, at + len(c.encode())))
            at += len(c.encode())
        return "".join(out), origin

    def _part_with_offsets(self, part: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        normal, origin = self.normalize_with_origin(part)
        found, at = [], 0
        for word in self.words(normal):
            at = normal.index(word, at)
            ids = self.pieces(word)
            sizes = [len(word)] if ids == [self.ids["[UNK]"]] else [len(self.tokens[i]) - 2 * (n > 0) for n, i in enumerate(ids)]
            for i, size in zip(ids, sizes):
                found.append((i, origin[at][0], origin[at + size - 1][1]))
                at += size
        return tuple(np.array([f[c] for f in found], np.int32) for c in range(3))

    def offsets(self, text: str, memory: dict[str, tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, begins, ends of the pieces, in bytes of the original text; (0, 0) for [CLS] and [SEP]. What stands between white space is encoded once and remembered."""
        parts, begins, at, place = [], [], 0, 0
        for m in (_PART if self.clean else _WORD).finditer(text):
            part = m[0]
            if part not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[part] = self._part_with_offsets(part)
            place += len(text[at : m.start()].encode())
            parts.append(memory[part])
            begins.append(place)
            place += len(part.encode())
            at = m.end()
        shift = np.repeat(np.array(begins, np.int32), [len(p[0]) for p in parts])
        ids, begin, end = (np.concatenate([np.empty(0, np.int32), *(p[c] for p in parts)])[: max(self.max_length - 2, 0)] for c in range(3))
        shift = shift[: len(ids)]
        edge = lambda x, first, last: np.concatenate([[first], x, [last]]).astype(np.int32)
        return edge(ids, self.ids["[CLS]"], self.ids["[SEP]"]), edge(begin + shift, 0, 0), edge(end + shift, 0, 0)

    def encode_with_offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of each piece, see `offsets`."""
        return list(zip(*(c.tolist() for c in self.offsets(text, {}))))

    def encode(self, text: str, memory: dict[str, list[int]]) -> list[int]:
        """Ids between [CLS] and [SEP], cut to max_length. White space separates, so what stands between is encoded once and remembered."""
        ids: list[int] = []
        for part in (_BLANK if self.clean else _SPACE).split(text):
            if part not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[part] = [i for word in self.words(self.normalize(part)) for i in self.pieces(word)]
            ids += memory[part]
        return [self.ids["[CLS]"], *ids[: max(self.max_length - 2, 0)], self.ids["[SEP]"]]


def _is_cjk(c: str) -> bool:
    # The blocks of CJK ideographs.
    blocks = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
    return c >= "㐀" and any(a <= ord(c) <= z for a, z in blocks)


def _is_punctuation(c: str) -> bool:
    return (c.isascii() and c.isprintable() and not c.isalnum() and c != " ") or unicodedata.category(c)[0] == "P"


def character_vocabulary() -> tuple[str, ...]:
    """A vocabulary by rule: the special tokens, every printable ASCII character, and the letters and digits as continuations."""
    printable = [chr(c) for c in range(33, 127)]
    return (*SPECIAL, *printable, *(f"##{c}" for c in printable if c.isalnum()))


def normalized(text: Column, model: WordPiece) -> Column:
    @F.pandas_udf(T.StringType())
    def run(rows: pd.Series) -> pd.Series:
        memory: dict[str, str] = {}

        def part(m: re.Match) -> str:
            if m[0] not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[m[0]] = model.normalize(m[0])
            return memory[m[0]]

        return rows.map(lambda x: None if x is None else re.sub(r"\S+|\s", part, x))

    return run(text)


def encoded(text: Column, model: WordPiece) -> Column:
    """array<int> of a text, null for null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(rows: pd.Series) -> pd.Series:
        memory: dict[str, list[int]] = {}
        return rows.map(lambda x: None if x is None else model.encode(x, memory))

    return run(text)


def encoding(text: Column, model: WordPiece) -> Column:
    """array<struct<id, begin, end>> of a text: its pieces with the bytes of the original they come from."""
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("id", "begin", "end")]))

    @F.pandas_udf(kind)
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else [dict(zip(("id", "begin", "end"), e)) for e in model.encode_with_offsets(x)])

    return run(text)


def located(df: DataFrame, row: str, text: str, model: WordPiece) -> DataFrame:
    """row, id, begin, end: a row for each piece of `encoding`, for texts of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for at, x in enumerate(batch.column(1)):
                if x.is_valid:
                    found = model.offsets(x.as_py(), memory)
                    of = batch.column(0).take(pa.array(np.full(len(found[0]), at)))
                    yield pa.RecordBatch.from_arrays([of, *map(pa.array, found)], [row, "id", "begin", "end"])

    kind = df.schema[row].dataType.simpleString()
    return df.select(row, text).mapInArrow(run, f"`{row}` {kind}, id int, begin int, end int")


def read_vocabulary(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The tokens of a text file with one token per line, in order; the number of the line is the id."""
    return tuple(spark.sparkContext.wholeTextFiles(path).values().first().rstrip("\n").split("\n"))


def joined_pair(first: Column, second: Column, model: WordPiece, cut: str = "longest_first") -> Column:
    """struct(ids, type_ids) of two encoded texts: [CLS] first [SEP] second [SEP], cut to max_length: the longer first (the first one if both are as long), or only one of them."""
    inner = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 2, F.lit(0)))
    a, b = inner(first), inner(second)
    room, na, nb = F.lit(max(model.max_length - 3, 0)), F.size(a), F.size(b)
    if cut == "longest_first":
        over = F.greatest(na + nb - room, F.lit(0))
        # The longer one gives first until both are as long; what is left is shared, the first one giving the odd one.
        lead_a, lead_b = F.least(over, F.greatest(na - nb, F.lit(0))), F.least(over, F.greatest(nb - na, F.lit(0)))
        rest = over - lead_a - lead_b
        keep_a, keep_b = na - lead_a - F.ceil(rest / 2).cast("int"), nb - lead_b - F.floor(rest / 2).cast("int")
    elif cut in ("only_first", "only_second"):
        over = F.greatest(na + nb - room, F.lit(0))
        length = na if cut == "only_first" else nb
        left = F.when(over <= length, length - over).otherwise(F.raise_error(F.lit("the other text alone is too long")).cast("int"))
        keep_a, keep_b = (left, nb) if cut == "only_first" else (na, left)
    else:
        raise ValueError(f"unknown way to cut: {cut}")
    a, b = F.slice(a, 1, keep_a), F.slice(b, 1, keep_b)
    cls, sep = F.array(F.lit(model.ids["[CLS]"])), F.array(F.lit(model.ids["[SEP]"]))
    types = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 1))
    return F.struct(F.concat(cls, a, sep, b, sep).alias("ids"), types.alias("type_ids"))


def decoded(df: DataFrame, row: str, ids: str, model: WordPiece) -> DataFrame:
    """row, text: the tokens of ids, continuations joined, without [CLS], [SEP] and [PAD]; an id outside the vocabulary is an error."""
    table = F.array(*(F.lit(t) for t in model.tokens))
    skipped = [model.ids[t] for t in ("[CLS]", "[SEP]", "[PAD]")]
    kept = F.filter(F.col(ids), lambda i: ~i.isin(*skipped))
    tokens = F.transform(kept, lambda i: F.when((i >= 0) & (i < len(model.tokens)), F.element_at(table, i + 1)).otherwise(F.raise_error(F.lit("an id outside the vocabulary"))))
    return df.select(row, F.regexp_replace(F.array_join(tokens, " "), " ##", "").alias("text"))
