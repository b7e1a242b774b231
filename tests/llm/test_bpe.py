from __future__ import annotations

import base64
import random
import unicodedata

import pytest
import tiktoken

from quillstore.llm.bpe import Encoder, Ranks, encode_corpus, encode_texts
from quillstore.llm.queries import VOCABULARY

# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(reference, texts):
    ids, sizes = encode_texts(Encoder(Ranks.read(VOCABULARY)), texts)
    at = 0
    for text, size in zip(texts, sizes):
        assert ids[at : at + size].tolist() == reference.encode_ordinary(text or ""), repr(text)[:200]
        at += size


def test_mixed_characters(reference):
    rng = random.Random(1)
    letters = "  '''\n\t\r\xa0 sdtmrevl12.,!é中😀ÀaaaAbc　\x85\x1c½²ाֿ‍"
    same(reference, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)])


def test_any_code_points(reference):
    rng = random.Random(2)
    point = lambda: rng.choice([rng.randrange(1, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x10FFFF)])
    # Only assigned ones: what a code point added by a later Unicode version is depends on the library.
    texts = ["".join(chr(point()) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    same(reference, ["".join(c for c in t if unicodedata.category(c) != "Cn") for t in texts])


def test_long_and_empty_texts(reference):
    same(reference, [None, "", " ", "x" * 5000, "ab" * 20_000, "hello world's " * 100_000, "a\n" * 200_000 + " b", "don't 'start <|endoftext|>"])


def test_documents(spark, base, reference):
    rows = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: r.ids for r in encode_corpus(rows, "doc_id", "text", VOCABULARY).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in texts.items()}


def test_empty_table_and_clashing_names(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", VOCABULARY).count() == 0
    row = encode_corpus(spark.createDataFrame([("a", None, 1)], "k string, ids string, n int"), "k", "ids", VOCABULARY).first()
    assert (row.k, row.ids) == ("a", [])
