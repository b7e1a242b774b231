"""Reading level of texts by a familiar-word formula: the share of unfamiliar words and the average sentence length.

The familiar words of a language are those that stand in many of its plainest documents: by document frequencies, over
the whole corpus, in the PLAIN_SHARE of the documents with the shortest sentences. Words that all documents use, but
plain ones seldom do, are so kept off the list. Every distinct text counts once in all frequencies, however many copies
it has. What language a text has is told by document frequencies too; the column with the language only serves to
collect these, as it may be missing or wrong.

Texts are measured once: their distinct words, with counts, and sentence lengths are written, and all that follows
works on these. How the two figures turn into a level is fitted to the graders' levels, a multinomial logistic regression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstore.sources.tables import materialize

#: Part of a language's documents that counts as plain, and the part of these that a familiar word stands in.
PLAIN_SHARE, FAMILIAR_SHARE = 0.1, 0.3
#: A word needs this part of a language's documents to tell the language of a text, and a language this many documents.
LEAST_WORD, LEAST_DOCS = 0.01, 30
#: Codes whose frequencies point in one direction, up to this cosine, are names of one language.
SAME_LANGUAGE = 0.8
#: Labelled documents that the regression is fitted to; more are sampled by a hash of the id.
MAX_LABELLED = 50_000
#: Sentence lengths are binned by this many words when the plain documents are sought; longer ones than BINS bins are as long.
BIN, BINS = 0.25, 4000
#: Sentences of fewer words (remains of lists and markup) don't count in the average.
LEAST_SENTENCE = 3

_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_LINK = re.compile(r"\[\[[^\]]*\]\]|\]\([^)]*\)|https?://\S+")
_HEADING = re.compile(r"^[ \t]*#+ .*$", re.M)
_END = re.compile(r"[.!?…。]+(?=\s|\Z)|\n\s*\n|\n(?=\s*(?:[-*+>]|\d+\.)\s)")
_TOKEN = regex.compile(r"\p{L}+|\x00")
_ASCII_TOKEN = re.compile("[a-z]+|\x00")


def _tokens(text: str) -> list[str]:
    """The lower-cased words of a text, and its marks."""
    if text.isascii():
        return _ASCII_TOKEN.findall(text.lower())
    low = text.lower()
    return _TOKEN.findall(low) if len(low) == len(text) else [t.lower() for t in _TOKEN.findall(text)]


def _measure(text: str, least: int) -> tuple[list[str], float] | None:
    """(lower-cased words, average sentence length) of the prose in a text; of the whole text if nothing else has words. None for fewer than `least` words in the whole text."""
    prose = _CODE.sub("\n\n", text) if "```" in text else text
    prose = _HEADING.sub("\n\n", _LINK.sub(" ", prose)) if any(x in prose for x in ("[[", "](", "http", "#")) else prose
    tokens = _tokens(_END.sub(" \0 ", prose.replace("\0", " ")))
    marks = [i for i, t in enumerate(tokens) if t == "\0"]
    if len(tokens) - len(marks) < least:
        every = _tokens(text.replace("\0", " "))
        if len(every) < least:
            return None
        if len(tokens) == len(marks):
            tokens, marks = every, []
    words, lengths, begin = [t for t in tokens if t != "\0"], [], 0
    for i in [*marks, len(tokens)]:
        if i > begin:
            lengths.append(i - begin)
        begin = i + 1
    whole = [n for n in lengths if n >= LEAST_SENTENCE] or lengths
    return words, sum(whole) / max(len(whole), 1)


def _measured(least: int):
    """(doc_id, lang, fp, n_words, sentence_length, words, counts) of each document with enough words: its distinct words in one string, and the bytes of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, length, words, counts = [], [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                measured = _measure(text, least)
                if measured is not None:
                    found = Counter(measured[0])
                    kept.append(i)
                    total.append(len(measured[0]))
                    length.append(measured[1])
                    words.append(" ".join(found))
                    counts.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            given = [batch.column(c).take(pa.array(kept, pa.int64())) for c in range(3)]
            columns = [*given, pa.array(total, pa.int32()), pa.array(length, pa.float64()), pa.array(words, pa.string()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "fp", "n_words", "sentence_length", "words", "counts"])

    return run


class _Profiles:
    """Languages, the share of each language's documents that a word stands in, and which words are familiar in it."""

    def __init__(self, shares: dict[tuple[str, str], float], familiar: set[tuple[str, str]] = frozenset()) -> None:
        self.langs = sorted({lang for lang, _ in shares})
        self.words = sorted({word for _, word in shares} | {word for _, word in familiar})
        at, lang_at = {w: i for i, w in enumerate(self.words)}, {x: i for i, x in enumerate(self.langs)}
        # The last row is for words that are in no list.
        self.share = np.zeros((len(self.words) + 1, len(self.langs)))
        self.familiar = np.zeros((len(self.words) + 1, len(self.langs)), bool)
        for (lang, word), x in shares.items():
            self.share[at[word], lang_at[lang]] = x
        for lang, word in familiar:
            self.familiar[at[word], lang_at[lang]] = True

    def rows_of(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, pa.array(self.words, pa.string())), len(self.words)).to_numpy(zero_copy_only=False)

    def told(self, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The number of each text's language; of equals, the first by name."""
        return np.round(np.add.reduceat(self.share[rows], begins, axis=0), 9).argmax(axis=1)

    def names(self, told: np.ndarray) -> pa.Array:
        return pa.array(self.langs, pa.string()).take(pa.array(told))


def _flat(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and where each text's begin. Every text has words."""
    words = pc.split_pattern(texts, " ")
    return words.flatten(), words.offsets.to_numpy()[:-1]


def _told(profiles):
    """(lang, bin, words): the language that the words tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Profiles = profiles.value
        for batch in batches:
            if len(batch):
                words, begins = _flat(batch.column("words"))
                bins = np.minimum(batch.column("sentence_length").to_numpy() / BIN, BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([known.names(known.told(known.rows_of(words), begins)), pa.array(bins), batch.column("words")], ["lang", "bin", "words"])

    return run


def _shares(profiles):
    """(doc_id, n_words, lang, sentence_length, unfamiliar) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Profiles = profiles.value
        for batch in batches:
            if not len(batch):
                continue
            words, begins = _flat(batch.column("words"))
            counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i4")
            lang, share = pa.nulls(len(batch), pa.string()), np.ones(len(batch))
            if known.langs:
                rows = known.rows_of(words)
                told = known.told(rows, begins)
                each = np.repeat(told, np.diff(np.append(begins, len(counts))))
                lang, share = known.names(told), np.add.reduceat(counts * ~known.familiar[rows, each], begins) / np.add.reduceat(counts, begins)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), lang, batch.column("sentence_length"), pa.array(share)], ["doc_id", "n_words", "lang", "sentence_length", "unfamiliar"])

    return run


def _one_name_each(shares: dict[tuple[str, str], float], docs: dict[str, int]) -> dict[tuple[str, str], float]:
    """The shares of languages, without codes that are other names of one with more documents."""
    rows = _Profiles(shares)
    length = np.maximum(np.linalg.norm(rows.share, axis=0), 1e-300)
    alike, kept = (rows.share.T @ rows.share) / length[:, None] / length, []
    for i in sorted(range(len(rows.langs)), key=lambda i: (-docs[rows.langs[i]], rows.langs[i])):
        if all(alike[i, k] < SAME_LANGUAGE for k in kept):
            kept.append(i)
    names = {rows.langs[i] for i in kept}
    return {key: x for key, x in shares.items() if key[0] in names}


def text_features(df: DataFrame, id_col: str, text_col: str, lang_col: str, least_words: int = 60) -> DataFrame:
    """doc_id, n_words, lang, sentence_length, unfamiliar of each text with at least `least_words` words (runs of letters).

    n_words counts the words of the prose, that is without code, links and headings, unless there are no others.
    Null texts have no words. lang is the language that the document frequencies tell, of those that at least LEAST_DOCS
    distinct texts state (by the whole first part of the code, in lower case); null if there is none, and all words are unfamiliar
    then. Codes that have the same words are one language. Repeated rows give a row each; other columns are ignored.
    """
    spark, least_words = df.sparkSession, max(least_words, 1)
    code = F.nullif(F.lower(F.trim(F.split(df[lang_col].cast("string"), "[-_]")[0])), F.lit(""))
    docs = df.select(df[id_col].alias("doc_id"), code.alias("lang"), F.xxhash64(df[text_col]).alias("fp"), df[text_col].alias("text")).where(F.length("text") >= 2 * least_words - 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = materialize(docs.mapInArrow(_measured(least_words), f"doc_id {kind}, lang string, fp bigint, n_words int, sentence_length double, words string, counts binary"), "measured")
    # One row of each distinct text; the others are dropped before the shuffle.
    once = measured.withColumn("copy", F.row_number().over(Window.partitionBy("fp").orderBy("doc_id", "lang"))).where("copy = 1")
    once = materialize(once.select("lang", "sentence_length", "words"), "distinct")

    stated = once.where("lang is not null")
    sizes = {r.lang: r.n for r in stated.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS).collect()}  # a row per language
    # A text has a bounded number of different words on average, so only so many can stand in a hundredth of the texts.
    shares = {}
    if sizes:
        of = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))
        counted = stated.where(F.col("lang").isin(*sizes)).select("lang", F.explode(F.split("words", " ")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
        common = counted.withColumn("share", F.col("n") / of[F.col("lang")]).where(F.col("share") >= LEAST_WORD)
        shares = _one_name_each({(r.lang, r.word): r.share for r in common.orderBy("lang", "word").collect()}, sizes)
    familiar: set[tuple[str, str]] = set()
    if shares:
        told = once.mapInArrow(_told(spark.sparkContext.broadcast(_Profiles(shares))), "lang string, bin int, words string")
        bins = told.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "bin").collect()  # of each language BINS + 1 at most
        docs_of = Counter()
        for row in bins:
            docs_of[row.lang] += row.n
        # Up to which bin a language's documents are plain, and how many that are.
        limits: dict[str, tuple[int, int]] = {}
        for row in bins:
            before = limits.get(row.lang, (-1, 0))[1]
            if before < PLAIN_SHARE * docs_of[row.lang]:
                limits[row.lang] = (row.bin, before + row.n)
        limit = F.create_map(*(F.lit(x) for lang, (at, _) in limits.items() for x in (lang, at)))
        plain = told.where(F.col("bin") <= limit[F.col("lang")]).select("lang", F.explode(F.split("words", " ")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
        least = F.create_map(*(F.lit(x) for lang, (_, n) in limits.items() for x in (lang, FAMILIAR_SHARE * n)))
        familiar = {(r.lang, r.word) for r in plain.where(F.col("n") >= least[F.col("lang")]).select("lang", "word").collect()}
    profiles = spark.sparkContext.broadcast(_Profiles(shares, familiar))
    return measured.mapInArrow(_shares(profiles), f"doc_id {kind}, n_words int, lang string, sentence_length double, unfamiliar double")


def _design(langs: list[str], lang: np.ndarray, length: np.ndarray, share: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.log(np.maximum(length, 1.0)) - 2.8, share * 8 - 2])
    one = np.array([[a == b for b in langs] for a in lang], float).reshape(len(lang), len(langs))
    return np.hstack([np.ones((len(x), 1)), x, x**2, x[:, :1] * x[:, 1:], one, *(one[:, [i]] * x for i in range(len(langs)))])


def _fit(a: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1.0, rounds: int = 80) -> np.ndarray:
    """Coefficients of a multinomial logistic regression, by damped Newton steps for one class after another."""
    b = np.zeros((a.shape[1], classes))
    wanted = np.eye(classes)[y]
    ridge = np.eye(a.shape[1]) * penalty
    for _ in range(rounds):
        for c in range(classes):
            p = np.exp(a @ b - (a @ b).max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True))[:, c]
            b[:, c] -= 0.8 * np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - wanted[:, c]) + penalty * b[:, c])
    return b


def reading_levels(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level_col: str = "level", levels: int = 5, least_words: int = 60) -> DataFrame:
    """doc_id, level, n_words, lang, sentence_length, unfamiliar of each text with at least `least_words` words.

    labels has the graders' levels under `id_col` and `level_col`: those outside 1 to `levels` and nulls are ignored, rows told
    again count once, and the median of a document counts where graders disagree. Without any usable label, level is null.
    """
    features = materialize(text_features(df, id_col, text_col, lang_col, least_words), "features")
    graded = labels.distinct().select(labels[id_col].alias("doc_id"), labels[level_col].cast("int").alias("level")).where(F.col("level").between(1, levels))
    graded = graded.groupBy("doc_id").agg(F.floor(F.percentile("level", F.lit(0.5)) + 0.5).cast("int").alias("level"))
    sample = features.join(graded, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).select("lang", "sentence_length", "unfamiliar", "level").toPandas()
    langs = sorted(sample["lang"].dropna().unique())
    b = None
    if len(sample):
        a = _design(langs, sample["lang"].to_numpy(), sample["sentence_length"].to_numpy(float), sample["unfamiliar"].to_numpy(float))
        b = _fit(a, sample["level"].to_numpy(int) - 1, levels)
        b[:, np.bincount(sample["level"].to_numpy(int) - 1, minlength=levels) == 0] = 0
        b[0, np.bincount(sample["level"].to_numpy(int) - 1, minlength=levels) == 0] = -1e9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = pa.nulls(len(batch), pa.int32())
            if b is not None and len(batch):
                x = _design(langs, np.array(batch.column(2).to_pylist(), object), batch.column(3).to_numpy(), batch.column(4).to_numpy())
                level = pa.array(((x @ b).argmax(1) + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), level, *batch.columns[1:]], ["doc_id", "level", *batch.schema.names[1:]])

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(run, f"doc_id {kind}, level int, n_words int, lang string, sentence_length double, unfamiliar double")


def level_profile(levels: DataFrame) -> DataFrame:
    """lang, level, n_docs, mean_sentence_length: how demanding the corpus is."""
    return levels.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("sentence_length").alias("mean_sentence_length"))
