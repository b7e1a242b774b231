from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstore.functions import vectors


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    return df.select(expression).first()[0]


def test_elementwise_functions(spark):
    x = [-2.0, 0.0, 0.5, 3.0]
    v = np.array(x)
    c = F.col("x")
    for name, want in {
        "relu": np.maximum(v, 0),
        "sigmoid": 1 / (1 + np.exp(-v)),
        "tanh": np.tanh(v),
        "softmax": np.exp(v - 3) / np.exp(v - 3).sum(),
        "layer_norm": (v - v.mean()) / np.sqrt(v.var() + 1e-5),
        "l2_normalize": v / np.linalg.norm(v),
        "gelu": 0.5 * v * (1 + np.tanh(np.sqrt(2 / np.pi) * (v + 0.044715 * v**3))),
    }.items():
        assert one(spark, getattr(vectors, name)(c), x=x) == pytest.approx(want.tolist())
    assert one(spark, vectors.split_array(c, 2), x=x) == [x[:2], x[2:]]
    assert one(spark, vectors.pad_ids(F.array(F.lit(1)), 3, 0, left=True), x=x) == [0, 0, 1]
    assert one(spark, vectors.causal_mask(F.lit(2)), x=x) == [[1, 0], [1, 1]]
    assert one(spark, vectors.cosine_distance(c, F.array(*[F.lit(0.0)] * 4)), x=x) == 1.0


def test_errors(spark):
    for bad in (vectors.l2_normalize(F.array(F.lit(0.0))), vectors.split_array(F.col("x"), 3), vectors.add(F.col("x"), F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="RAISE|USER"):
            one(spark, bad, x=[1.0, 2.0])
    with pytest.raises(ValueError):
        vectors.activation("swish", F.col("x"))


def test_matrix_products(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 3, 4)), rng.normal(size=(2, 4, 2))
    cells = lambda m, names: spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(m)], names)
    got = vectors.matmul(cells(a, ["n", "i", "k", "value"]), cells(b, ["n", "k", "j", "value"]), ("n",))
    want = a @ b
    assert {(r.n, r.i, r.j): pytest.approx(r.value) for r in got.collect()} == {i: v for i, v in np.ndenumerate(want)}
    out = vectors.linear(cells(a[0], ["i", "k", "value"]), cells(b[0].T, ["j", "k", "value"]), spark.createDataFrame([(0, 1.0), (1, 2.0)], "j int, bias double"))
    assert {(r.i, r.j): pytest.approx(r.value) for r in out.collect()} == {i: v for i, v in np.ndenumerate(a[0] @ b[0] + [1, 2])}


def test_attention(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 3))
    df = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(x)], "row int, pos int, embedding array<double>")
    out = vectors.attention(df, df.withColumn("value", F.col("embedding")), df.where("pos < 3")).orderBy("pos").collect()
    s = x @ x[:3].T / np.sqrt(3)
    w = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    assert [r.embedding for r in out] == [pytest.approx(v) for v in (w @ x[:3]).tolist()]


def test_viterbi(spark):
    rng = np.random.default_rng(2)
    move, begin, end = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    rows = [rng.normal(size=(n, 3)) for n in (0, 1, 2, 5)]
    score = lambda e, p: begin[p[0]] + end[p[-1]] + sum(e[i, t] for i, t in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "i int, e array<array<double>>")
    got = df.orderBy("i").select(vectors.viterbi(F.col("e"), move.tolist(), begin.tolist(), end.tolist())).collect()
    want = [list(max(product(range(3), repeat=len(e)), key=lambda p: score(e, p))) if len(e) else [] for e in rows]
    assert [r[0] for r in got] == want


def test_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, 5, 0.5), (1, 1, 1, 2.0), (1, 2, 5, 0.7), (1, 3, 9, -1.0), (1, 4, 0, 3.0)], "row int, pos int, id int, weight double")
    assert [r.position for r in vectors.position_ids(tokens, 1).orderBy("pos").collect()] == [2, 1, 3, 4, 5]
    assert vectors.sparse_weights(tokens, [0, 1]).first().weights == {5: 0.7}
    with pytest.raises(Exception, match="outside the table"):
        vectors.embedding_lookup(tokens, spark.createDataFrame([(5, [1.0])], "id int, embedding array<double>")).collect()
