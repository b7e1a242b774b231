"""Arithmetic on arrays of numbers as Spark expressions; null arrays give null."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once per row, not once per element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(doubles(x), doubles(y), lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine_distance(x: Column, y: Column) -> Column:
    """1 - cosine, from 0 to 2; 1 if either vector is zero."""
    return F.when((norm(x) == 0) | (norm(y) == 0), F.lit(1.0)).otherwise(1 - dot(x, y) / (norm(x) * norm(y)))


def add(x: Column, y: Column) -> Column:
    """Element by element; arrays of different lengths are an error."""
    same = F.when(F.size(x) == F.size(y), doubles(x)).otherwise(F.raise_error(F.lit("arrays of different lengths")))
    return F.zip_with(same, doubles(y), lambda a, b: a + b)


def scale(x: Column, factor: float) -> Column:
    return F.transform(doubles(x), lambda v: v * factor)


def relu(x: Column) -> Column:
    return F.transform(doubles(x), lambda v: F.greatest(v, F.lit(0.0)))


def gelu(x: Column) -> Column:
    """The form with tanh."""
    return F.transform(doubles(x), lambda v: 0.5 * v * (1 + F.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v * v * v))))


def sigmoid(x: Column) -> Column:
    return F.transform(doubles(x), lambda v: 1 / (1 + F.exp(-v)))


def tanh(x: Column) -> Column:
    return F.transform(doubles(x), F.tanh)


def activation(name: str, x: Column) -> Column:
    """By name: gelu, gelu_tanh and gelu_new are one; relu."""
    known = {"gelu": gelu, "gelu_tanh": gelu, "gelu_new": gelu, "relu": relu}
    if name not in known:
        raise ValueError(f"unknown activation: {name}")
    return known[name](x)


def softmax(x: Column) -> Column:
    raised = let(F.array_max(doubles(x)), lambda m: F.transform(doubles(x), lambda v: F.exp(v - m)))
    return let(raised, lambda r: let(total(r), lambda t: F.transform(r, lambda v: v / t)))


def layer_norm(x: Column, gamma: Column | None = None, beta: Column | None = None, eps: float = 1e-5) -> Column:
    """With the variance of the population; gamma and beta are arrays of the same length."""
    d = doubles(x)
    centred = let(total(d) / F.size(d), lambda mean: F.transform(d, lambda v: v - mean))
    out = let(centred, lambda c: let(F.sqrt(dot(c, c) / F.size(c) + eps), lambda spread: F.transform(c, lambda v: v / spread)))
    if gamma is not None:
        out = F.zip_with(out, doubles(gamma), lambda a, b: a * b)
    return add(out, beta) if beta is not None else out


def l2_normalize(x: Column) -> Column:
    """Of length 1; a zero or non-finite length is an error."""
    checked = lambda n: F.when((n > 0) & (n < F.lit(float("inf"))), n).otherwise(F.raise_error(F.lit("the length is zero or not finite")).cast("double"))
    return let(norm(x), lambda n: F.transform(doubles(x), lambda v: v / checked(n)))


def pad_ids(ids: Column, size: int, pad: int, left: bool = False) -> Column:
    """ids filled with `pad` up to `size`; longer ones stay."""
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def keep_mask(ids: Column, pad: int) -> Column:
    """1 for each id but `pad`."""
    return F.transform(ids, lambda i: (i != pad).cast("int"))


def causal_mask(n: Column) -> Column:
    """n rows of n: ones up to the diagonal."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n), lambda j: (j <= i).cast("int")))


def position_ids(tokens: DataFrame, pad: int) -> DataFrame:
    """tokens (row, pos, id) with position: 0, 1, ... for pad id 0; else the pad id for pads, and for others the pad id plus their count so far."""
    if pad == 0:
        return tokens.withColumn("position", F.col("pos").cast("bigint"))
    count = F.sum((F.col("id") != pad).cast("bigint")).over(Window.partitionBy("row").orderBy("pos"))
    return tokens.withColumn("position", F.when(F.col("id") == pad, F.lit(pad)).otherwise(count + pad).cast("bigint"))


def matmul(a: DataFrame, b: DataFrame, batch: tuple[str, ...] = ()) -> DataFrame:
    """i, j, value of the product of two matrices given as rows (i, k, value) and (k, j, value); absent elements are zero. With `batch` columns, one product per value of these."""
    left, right = a.select(*batch, "i", "k", F.col("value").alias("x")), b.select(*batch, "k", "j", F.col("value").alias("y"))
    return left.join(right, [*batch, "k"]).groupBy(*batch, "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def gram(df: DataFrame, array_col: str) -> DataFrame:
    """i, j, value of A^T A for the matrix A whose rows are the arrays: products within each row, summed before the shuffle."""
    rows = df.select(F.posexplode(doubles(F.col(array_col))).alias("i", "x"), doubles(F.col(array_col)).alias("y"))
    return rows.select("i", "x", F.posexplode("y").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def linear(x: DataFrame, weight: DataFrame, bias: DataFrame) -> DataFrame:
    """i, j, value of x W^T + b, from x (i, k, value), weight (j, k, value) and bias (j, bias)."""
    product = matmul(x, weight.select("k", "j", "value"))
    return product.join(bias, "j").select("i", "j", (F.col("value") + F.col("bias")).alias("value"))


def attention(queries: DataFrame, keys: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """row, pos, embedding: scaled dot-product attention within each row.

    queries (row, pos, embedding), keys (row, pos, embedding, value); kept (row, pos) are the positions that may be
    attended to, all without it. The weights are a softmax of q.k / sqrt(dimension), shifted by the largest score.
    """
    allowed = keys if kept is None else keys.join(kept.select("row", "pos"), ["row", "pos"], "left_semi")
    pairs = queries.select("row", F.col("pos").alias("q_pos"), F.col("embedding").alias("q")).join(allowed.select("row", "pos", F.col("embedding").alias("k"), F.col("value").alias("v")), "row")
    scored = pairs.select("row", "q_pos", "pos", "v", (dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q"))).alias("score"))
    by_query = Window.partitionBy("row", "q_pos")
    weighted = scored.withColumn("weight", F.exp(F.col("score") - F.max("score").over(by_query)))
    weighted = weighted.withColumn("weight", F.col("weight") / F.sum("weight").over(by_query))
    cells = weighted.select("row", F.col("q_pos").alias("pos"), F.posexplode(F.transform(doubles(F.col("v")), lambda x: x * F.col("weight"))).alias("at", "value"))
    sums = cells.groupBy("row", "pos", "at").agg(F.sum("value").alias("value"))
    return sums.groupBy("row", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("embedding"))


def sinusoidal_positions(positions: Column, dim: int) -> Column:
    """The positional code of a position: sine at even, cosine at odd places, of falling frequency."""
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    angle = lambda i: positions / F.pow(F.lit(10000.0), (i - i % 2) / F.lit(float(dim)))
    return F.transform(places, lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def viterbi(emissions: Column, transitions: list[list[float]], start: list[float], end: list[float]) -> Column:
    """The best sequence of tags, as array<int>, of emissions (array of arrays, one score per tag and step) and scores for steps between tags.

    A fold over the steps keeps, for each tag, the best path that ends in it; ties go to the smaller tag.
    """
    tags = range(len(start))
    kind = "array<struct<score:double,path:array<int>>>"
    best = lambda paths: F.array_max(F.transform(paths, lambda p, i: F.struct(p["score"].alias("score"), (-i).alias("tie"), p["path"].alias("path"))))
    begin = F.array(*(F.struct((F.lit(float(start[t])) + emissions[0][t]).cast("double").alias("score"), F.array(F.lit(t)).alias("path")) for t in tags)).cast(kind)

    def step(paths: Column, scores: Column) -> Column:
        into = lambda t: best(F.transform(paths, lambda p, i: F.struct((p["score"] + F.array(*(F.lit(float(transitions[f][t])) for f in tags))[i] + scores[t]).alias("score"), p["path"].alias("path"))))
        return F.array(*(F.struct(into(t)["score"].cast("double").alias("score"), F.concat(into(t)["path"], F.array(F.lit(t))).alias("path")) for t in tags)).cast(kind)

    folded = F.aggregate(F.slice(emissions, 2, F.greatest(F.size(emissions) - 1, F.lit(0))), begin, step)
    ended = F.transform(folded, lambda p, i: F.struct((p["score"] + F.array(*(F.lit(float(e)) for e in end))[i]).alias("score"), p["path"].alias("path")))
    return F.when(F.size(emissions) == 0, F.array().cast("array<int>")).otherwise(best(ended)["path"])


def concatenated(*parts: Column) -> Column:
    """Arrays end to end; null if one is."""
    return F.concat(*(doubles(x) for x in parts))


def dense_embedding(tokens: DataFrame, group: str, order: str) -> DataFrame:
    """group, embedding: the vector at the first place of each group, of length 1."""
    first = tokens.where(F.col(order) == 0)
    return first.select(group, l2_normalize(F.col("embedding")).alias("embedding"))


@F.pandas_udf(T.BinaryType())
def encode_embedding(x: pd.Series) -> pd.Series:
    """The numbers of an array as 4-byte floats, little end first; null for null."""
    return x.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def decode_embedding(blob: Column, dim: int) -> Column:
    """The array of `dim` numbers in a blob; another length is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.frombuffer(v, "<f4"))

    checked = F.when(blob.isNull() | (F.octet_length(blob) == 4 * dim), blob).otherwise(F.raise_error(F.lit("a blob of another length")).cast("binary"))
    return run(checked)


def long_form(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """row, pos, value: one row per element of an array."""
    return df.select(F.col(id_col).alias("row"), F.posexplode(doubles(F.col(array_col))).alias("pos", "value"))


def embedding_lookup(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """tokens (row, pos, id) with the embedding of each id from table (id, embedding); an id that isn't there is an error."""
    found = tokens.join(table, "id", "left")
    return found.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.lit("an id outside the table"))))


def mean_pool(df: DataFrame, group: str, array_col: str) -> DataFrame:
    """group, embedding: the mean of the arrays of a group, element by element; partial sums are made before the shuffle."""
    means = df.select(group, F.posexplode(doubles(F.col(array_col))).alias("pos", "value")).groupBy(group, "pos").agg(F.avg("value").alias("value"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("embedding"))


def first_pool(tokens: DataFrame) -> DataFrame:
    """The rows at position 0."""
    return tokens.where("pos = 0")


def split_array(x: Column, chunks: int) -> Column:
    """An array in `chunks` equal parts; a length that can't be divided is an error."""
    size = F.when(F.size(x) % chunks == 0, F.size(x) / chunks).otherwise(F.raise_error(F.lit("the length can't be divided")).cast("double")).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: F.slice(x, c * size + 1, size))


def sparse_weights(tokens: DataFrame, special: list[int]) -> DataFrame:
    """row, weights (map of token id to weight) from tokens (row, id, weight): the largest positive weight per id, without special ids."""
    kept = tokens.where(~F.col("id").isin(*special)).groupBy("row", "id").agg(F.max(F.greatest("weight", F.lit(0.0))).alias("weight")).where("weight > 0")
    return kept.groupBy("row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "weight")))).alias("weights"))


def late_interaction(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, doc_id, score: the sum over a query's token vectors of the best dot product among a document's.

    queries (query_id, pos, embedding) and candidates in documents (query_id, doc_id, pos, embedding), vectors of length 1.
    """
    pairs = queries.select("query_id", F.col("pos").alias("q_pos"), F.col("embedding").alias("q")).join(documents.select("query_id", "doc_id", F.col("embedding").alias("d")), "query_id")
    best = pairs.groupBy("query_id", "doc_id", "q_pos").agg(F.max(dot(F.col("q"), F.col("d"))).alias("best"))
    return best.groupBy("query_id", "doc_id").agg(F.sum("best").alias("score"))
