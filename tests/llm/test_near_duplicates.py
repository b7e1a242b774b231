from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillstore.llm import near_duplicates as near
from quillstore.llm.near_duplicates import expand_pairs, linked_members, near_duplicates
from quillstore.llm.shingles import shingle_sets, slices, word_hashes

SCHEMA = "id string, body string, class_id string, n int, text string, fp string"


def sets(texts, k):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts.items()}
    return {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, w in words.items()}


def brute(texts, k, threshold, least):
    s = {i: x for i, x in sets(texts, k).items() if len(x) >= max(least, 1)}
    ids = sorted(s)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)
    return {tuple(r) for r in expand_pairs(*near_duplicates(df, "id", "body", **how)).collect()}


def corpus(seed, size, vocabulary):
    rng = random.Random(seed)
    texts = {}
    for i in range(size):
        if texts and rng.random() < 0.6:
            words = list(rng.choice(list(texts.values())).split())
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [f"w{rng.randrange(vocabulary)}"] * rng.randrange(2)
        else:
            words = [f"W{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 60))]
        texts[f"c{i:04}"] = rng.choice([" ", "  ", "-é-"]).join(words)
    return texts


@pytest.mark.parametrize(("k", "threshold", "least", "vocabulary"), [(3, 0.6, 10, 500), (5, 0.8, 1, 500), (1, 0.6, 1, 12), (2, 0.3, 3, 40)])
def test_pairs_are_those_of_brute_force(spark, k, threshold, least, vocabulary):
    texts = corpus(k, 300, vocabulary)
    assert found(spark, texts.items(), words=k, threshold=threshold, least=least) == brute(texts, k, threshold, least)


@pytest.mark.parametrize("known", [0, 30, 300])
def test_the_way_of_the_lengths_changes_nothing(spark, known):
    """Without room for the lengths of the lists, they are joined; with room for some, lists up to LONG stay unknown."""
    texts = corpus(9, 300, 60)
    how = dict(words=2, threshold=0.5, least=3)
    assert found(spark, texts.items(), known=known, **how) == brute(texts, 2, 0.5, 3)


def test_frequencies_are_exact_and_the_longest_lists_are_known(spark):
    texts = {f"c{i}": " ".join(["common words here", *(f"u{i}x{j}" for j in range(5)), f"pair{i // 2} a b"]) for i in range(400)}
    rows = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(5)
    frequencies = near._shingle_frequencies(rows, 3)
    least, keys, codes = near._known_lengths(frequencies, 1 << 22)
    want = Counter(g for s in sets(texts, 3).values() for g in s)
    assert least == 2 and len(keys) == sum(n > 1 for n in want.values())
    assert Counter(codes.tolist()) == Counter(int(2 * np.log2(n)) for n in want.values() if n > 1)
    assert (np.diff(keys.astype(object)) > 0).all()
    least, keys, codes = near._known_lengths(frequencies, 10)
    assert len(keys) <= 10 and codes.min() == codes.max() == int(2 * np.log2(400)) == least


def test_dirty_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [("a", None), ("b", ""), ("c", "one two"), (None, "x " * 50), ("d", long), ("e", long + " end"), ("d", long), ("f", "Ünïcode 日本 " * 3)]
    assert found(spark, rows, words=3, threshold=0.6, least=10) == {("d", "e")}
    assert found(spark, [], words=3, threshold=0.6) == set()


def test_hot_group_of_copies_is_one_class(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(f"h{i}", text, "", 0, "", "") for i in range(2000)] + [("z", text + " more", "", 0, "", "")], SCHEMA).repartition(6)
    members, pairs = near_duplicates(df, "id", "body", words=3, threshold=0.6, least=10)
    assert members.count() == 2001 and members.select("class_id").distinct().count() == 2
    assert pairs.count() == 1
    assert {r.n_links for r in linked_members(members, pairs).collect()} == {2000}


def test_words_are_runs_of_lower_cased_letters_and_digits():
    texts = ["Ab-cİx1 KK", None, "", "a" * 3_000_000 + " b"]
    hashes, rows = word_hashes(texts)
    assert [int((rows == i).sum()) for i in range(4)] == [len(re.findall("[a-z0-9]+", (t or "").lower())) for t in texts]
    assert hashes[-1] == word_hashes(["b"])[0][0]
    assert shingle_sets(texts, 3)[1].tolist() == [0, *[len(s) for s in [sets({0: texts[0]}, 3)[0]]] * 4]


def test_slices_hold_all_rows_in_order():
    texts = ["a" * n for n in (5, 0, 30, 1, 1, 1, 200)] + [None, "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["n", "t"]).slice(1)
    parts = list(slices(iter([batch, batch.slice(0, 0)]), 1, 20))
    assert [v for p in parts for v in p.column(0).to_pylist()] == list(range(1, len(texts)))
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 20 for p in parts)


def test_an_id_with_several_texts_is_in_several_classes(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [("x", one), ("x", two), ("y", one + " z"), ("z", two + " z"), ("x", one + " w")]
    assert found(spark, rows, words=3, threshold=0.6, least=10) == {("x", "y"), ("x", "z")}
