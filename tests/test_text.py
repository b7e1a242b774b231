from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstore.functions import text, wordpiece
from quillstore.plans import text_queries


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_known_fingerprints(spark):
    got = column(spark, ["hello world", "alpha", None], lambda x: F.lower(F.hex(text.fingerprint(x))))
    assert got == ["bee2fd405d03a109da6961af15f0230f", "4357f560568e8f6f6bc254dd441c816c", None]


def test_known_simhashes(spark):
    got = column(spark, ["", "a", "a b", "hello world hello", None], lambda x: F.lower(F.lpad(F.hex(text.simhash64(x)), 16, "0")))
    assert got == ["ffffffffffffffff", "cabd1bca128197ca", "cafd3bca16e9b7fe", "0ea3b05fba4df22c", None]


def test_slugs(spark):
    assert column(spark, ["a/b", "/a", "a/", "", "a b", "a\n", "é", None], text.valid_slug) == [True, False, False, False, False, False, False, None]


def test_sanitize(spark):
    assert column(spark, ["(a AND b)*", "it's well-known_x", "!!!", None], text.sanitize) == ["a AND b", "it's well-known_x", "", None]


def test_links(spark):
    body = "[[b/c]] [[me]] [x](./d.md) [y](/e) [z](http) [w](https://a.b/c) [[b/c]]"
    assert column(spark, [body, "", None], lambda x: text.links_in(x, F.lit("me"))) == [["b/c", "d", "e"], [], None]


def test_sections(spark):
    got = column(spark, ["pre\n# a\nx\n  ## b\n#word\n####### c\n\n###### d", "", " \n\n", None, "#\n# "], text.sections)
    assert got == [["pre", "# a\nx", "## b\n#word\n####### c", "###### d"], [], [], None, ["#", "#"]]


def test_intent(spark):
    assert column(spark, ["#x", "a TAG:b", "what links to x", "Yesterday", "depends on", "other", None], text.intent) == ["tag", "tag", "backlink", "temporal", "relational", "semantic", None]


def test_dialect(spark):
    got = column(spark, ["The API decided to love Bob", "", None], lambda x: text.compress_dialect(x, {"bob": "B1"}))
    assert got == ["api TECHNICAL decided emotion_determ DECISION love emotion_love B1", "", None]
    assert column(spark, ["", "a"], text.compression_ratio) == [1.0, 0.0]


def test_wordpiece(spark):
    vocabulary = (*wordpiece.SPECIAL, "hello", "world", "un", "##afford", "##able", ",", "!")
    model = wordpiece.WordPiece(vocabulary, max_length=16)
    got = column(spark, ["Unaffordable", "Héllo, WORLD!", "xyz", "", None], lambda x: wordpiece.encoded(x, model))
    assert got == [[2, 7, 8, 9, 3], [2, 5, 10, 6, 11, 3], [2, 1, 3], [2, 3], None]
    with pytest.raises(wordpiece.VocabularyError):
        wordpiece.WordPiece(("a", "a"))


def test_wordpiece_pair_and_decode(spark):
    vocabulary = (*wordpiece.SPECIAL, "a", "b", "##c")
    model = wordpiece.WordPiece(vocabulary, max_length=7)
    df = spark.createDataFrame([(1, "a a a a a", "bc b")], "i int, x string, y string")
    pair = df.select("i", wordpiece.joined_pair(wordpiece.encoded(F.col("x"), model), wordpiece.encoded(F.col("y"), model), model).alias("p"))
    row = pair.select("i", "p.ids", "p.type_ids").first()
    assert (row.ids, row.type_ids) == ([2, 5, 5, 3, 6, 7, 3], [0, 0, 0, 0, 1, 1, 1])
    assert wordpiece.decoded(pair.select("i", F.col("p.ids").alias("ids")), "i", "ids", model).first().text == "a a bc"


def test_wordpiece_offsets_are_bytes_of_the_original(spark):
    vocabulary = (*wordpiece.SPECIAL, "hello", "world", "un", "##afford", "##able", ",", "!")
    model = wordpiece.WordPiece(vocabulary)
    text_ = "Héllo, 世 Unaffordable\0!"
    (pieces,) = column(spark, [text_], lambda x: wordpiece.encoding(x, model))
    raw = text_.encode()
    assert [raw[p.begin : p.end].decode() for p in pieces[1:-1]] == ["Héllo", ",", "世", "Un", "afford", "able", "!"]
    assert (pieces[0].begin, pieces[-1].end) == (0, 0)
    assert [p.id for p in pieces] == column(spark, [text_], lambda x: wordpiece.encoded(x, model))[0]


def test_wordpiece_by_parts_is_that_of_the_whole_text(spark):
    model = wordpiece.WordPiece(wordpiece.character_vocabulary(), max_length=10**6)
    texts = ["A\x0bb c\x1cd\xa0É x y [CLS]z\t\n q[MASK]", "世界á ́b", "", "\x85 \0"]
    whole = [[2, *(i for w in model.words(model.normalize(t)) for i in model.pieces(w)), 3] for t in texts]
    assert column(spark, texts, lambda x: wordpiece.encoded(x, model)) == whole
    assert column(spark, texts, lambda x: wordpiece.normalized(x, model)) == [model.normalize(t) for t in texts]


def test_wordpiece_queries_take_whole_texts(spark, base):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").where("text is not null and doc_id % 5 = 0").collect()}
    of = lambda name: text_queries.QUERIES[name](spark, base).where("doc_id % 5 = 0")
    want = {d: text_queries.MODEL.encode(x, {}) for d, x in texts.items()}
    assert max(map(len, want.values())) > 128
    assert {r.doc_id: r.ids for r in of("wordpiece_encode").collect()} == want
    assert {r.row: r.n for r in of("wordpiece_offsets").groupBy(F.col("doc_id").alias("row")).agg(F.count("id").alias("n")).collect()} == {d: len(x) for d, x in want.items()}
    assert {r.doc_id for r in of("wordpiece_decode").where("length(text) > 300").select("doc_id").collect()}
    for r in of("wordpiece_truncated").collect():
        ids = want[r.doc_id]
        assert r.overflow == max(len(ids) - 128, 0) and r.ids == (ids if len(ids) <= 128 else [*ids[:127], ids[-1]])


def test_wordpiece_is_that_of_another_implementation(spark, base):
    """Whole documents, with the corpus' frequent words, all characters and their continuations as a vocabulary."""
    tokenizers = pytest.importorskip("tokenizers")
    texts = [r.text for r in spark.read.parquet(f"{base}/documents.parquet").where("text is not null").orderBy("doc_id").select("text").collect()]
    texts += ["Ünïcode 日本語 text\u0000 \ufffd[tab]\t-- O'Neill's", "\u3000wide blank", "a" * 101 + " b", "İstanbul ǅ ß"]
    bert = tokenizers.normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=True, lowercase=True)
    words = Counter(w for t in texts for w, _ in tokenizers.pre_tokenizers.BertPreTokenizer().pre_tokenize_str(bert.normalize_str(t)))
    frequent = [w for w, n in words.items() if n >= 5 and len(w) > 1]
    characters = sorted({c for w in words for c in w})
    tokens = tuple(dict.fromkeys((*wordpiece.SPECIAL, *sorted(frequent), *characters[: len(characters) // 2], *(f"##{c}" for c in characters), *(f"##{w[2:]}" for w in sorted(frequent) if len(w) > 4))))
    other = tokenizers.Tokenizer(tokenizers.models.WordPiece({t: i for i, t in enumerate(tokens)}, unk_token="[UNK]", max_input_chars_per_word=100))
    other.normalizer, other.pre_tokenizer = bert, tokenizers.pre_tokenizers.BertPreTokenizer()
    model = wordpiece.WordPiece(tokens, max_length=2**31 - 1)
    got = column(spark, texts, lambda x: wordpiece.encoded(x, model))
    assert [ids[1:-1] for ids in got] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
