from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillstore.llm.reading_level import _measure, level_profile, reading_levels, text_features

DOCS, LABELS = "doc_id bigint, text string, lang string, level int, n_words int", "doc_id bigint, level int, rater string"


def corpus(n):
    rng = random.Random(8)
    plain, hard = [f"p{chr(97 + i)}" for i in range(20)], [f"specialist{chr(97 + i)}" for i in range(20)]
    docs = []
    for d in range(n):
        level = 1 + d % 5
        sentences = [" ".join(rng.choice(hard if rng.random() < level * 0.12 else plain) for _ in range(round(level * 6 * rng.uniform(0.8, 1.2)))) + "." for _ in range(90 // (level * 6) + 6)]
        docs.append((d, " ".join(sentences), rng.choice(["en", "EN", "en-x", None, "?"]), level))
    return docs


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d[:3], 0, 0) for d in docs], DOCS), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(spark):
    docs = corpus(600)
    labels = [(d[0], d[3], "r") for d in docs if d[0] % 3] + [(1, None, "r"), (2, 9, "r"), (4, d[3], "r")] if (d := docs[4]) else []
    got = {r.doc_id: r.level for r in reading_levels(*frames(spark, docs, labels)).collect()}
    held = [d for d in docs if d[0] % 3 == 0]
    assert len(got) == len(docs)
    assert sum(got[d[0]] == d[3] for d in held) >= 0.85 * len(held)


def test_held_out_accuracy_of_the_given_labels(spark, base):
    docs, labels = spark.read.parquet(f"{base}/../sf0.01/documents.parquet"), spark.read.parquet(f"{base}/../sf0.01/reading_labels.parquet")
    graded = labels.where("level between 1 and 5").groupBy("doc_id").agg(F.min("level").alias("low"), F.max("level").alias("high"))
    got = reading_levels(docs, labels.where("doc_id % 2 = 0")).join(graded.where("doc_id % 2 = 1"), "doc_id").select("level", "low", "high").collect()
    near = [r for r in got if r.low - 1 <= r.level <= r.high + 1]
    assert len(got) >= 10 and len(near) >= 0.9 * len(got)


def test_only_prose_of_enough_words_counts(spark):
    text = "plain words here and there. " * 12
    docs = [(1, text, "en"), (2, "short text.", "en"), (3, None, None), (4, "", ""), (5, "123 " * 500, "en"), (6, "слово два. " * 30, "ru"), (7, "x" * 500_000, "en"), (8, "日本 語\n" * 40, None)]
    got = reading_levels(*frames(spark, docs, []))
    assert {r.doc_id: r.level for r in got.collect()} == {1: None, 6: None, 8: None}
    assert level_profile(got).count() >= 1
    assert reading_levels(*frames(spark, [], [])).count() == 0


def test_sentences():
    words, length = _measure("# A heading here\n\nOne two three. Four five six seven!\n- eight nine ten\n```\ncode x y\n```\n[[a/b]]", 1)
    assert words == "one two three four five six seven eight nine ten".split() and round(length, 3) == 3.333


def notes(words, n, seed, lang, first, length=10):
    rng = random.Random(seed)
    return [(first + i, " ".join(" ".join(rng.choice(words) for _ in range(length)) + "." for _ in range(8)), lang) for i in range(n)]


def test_codes_are_languages_by_their_words_not_by_their_first_letters(spark):
    """fi and fil are two languages, en and english-gb one; what no code or a wrong one has goes by its words."""
    of = lambda prefix: [f"{prefix}{chr(97 + i)}" for i in range(25)]
    docs = notes(of("suo"), 60, 1, "fi", 0) + notes(of("tag"), 60, 2, "FIL-ph", 100) + notes(of("eng"), 90, 3, "en", 200) + notes(of("eng"), 50, 4, "english", 300)
    docs += notes(of("tag"), 5, 5, None, 400) + notes(of("suo"), 5, 6, "en", 410) + notes(of("xyz"), 29, 7, "rare", 500)
    df, _ = frames(spark, docs, [])
    told = {r.doc_id: r.lang for r in text_features(df, "doc_id", "text", "lang").collect()}
    assert {told[i] for i in range(60)} == {"fi"} and {told[100 + i] for i in range(60)} == {"fil"}
    assert {told[200 + i] for i in range(90)} | {told[300 + i] for i in range(50)} == {"en"}
    assert {told[400 + i] for i in range(5)} == {"fil"} and {told[410 + i] for i in range(5)} == {"fi"}
    assert set(told.values()) == {"fi", "fil", "en"}  # 29 texts are too few for a list of their own


def test_copies_count_once(spark):
    """A third of the rows that are one text of short sentences changes no figure of the others."""
    plain, odd = [f"word{chr(97 + i)}" for i in range(25)], "go now. do it. " * 20
    docs = notes(plain, 200, 9, "en", 0)
    figures = lambda rows: {r.doc_id: (r.sentence_length, r.unfamiliar) for r in text_features(frames(spark, rows, [])[0], "doc_id", "text", "lang").collect()}
    one, many = figures([*docs, (900, odd, "en")]), figures([*docs, *((900 + i, odd, "en") for i in range(100))])
    assert {i: one[i] for i, *_ in docs} == {i: many[i] for i, *_ in docs}
    assert max(x for _, x in one.values()) == one[900][1] == many[950][1]
