"""Queries of text, indexing and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstore.functions import text, vectors, wordpiece
from quillstore.operators import indexing, retrieval
from quillstore.plans.store_queries import _CUR, _current
from quillstore.sources.tables import read_table

#: No text reaches this length: whole texts are encoded; only wordpiece_truncated cuts.
MODEL = wordpiece.WordPiece(wordpiece.character_vocabulary(), max_length=2**31 - 1)
TRUNCATED = 128


def chunk_markdown(spark, base):
    return indexing.chunk_markdown(_current(spark, base), "slug", "compiled_truth")


def atx_headings(spark, base):
    lines = _current(spark, base).select("slug", F.posexplode(F.split("compiled_truth", "\n")).alias("line", "body"))
    return lines.where(F.col("body").rlike(r"^[ \t]*#{1,6}[ \t]")).groupBy("slug").agg(F.count(F.lit(1)).alias("headings"))


def index_markdown(spark, base):
    chunks = indexing.index_markdown(_current(spark, base), "slug", "compiled_truth")
    return chunks.select("id", "page_id", "ord", F.hex("content_fp").alias("fp"), "simhash", F.size("embedding").alias("dim"))


def index_chunks(spark, base):
    """What SQL can check of index_markdown."""
    chunks = indexing.index_markdown(_current(spark, base), "slug", "compiled_truth")
    return chunks.select("id", "ord", F.md5("body").alias("digest"), F.lpad(F.bin("simhash"), 64, "0").alias("bits"), F.size("embedding").alias("dim"))


def _bodies(spark, base):
    return read_table(spark, base, "chunks").dropDuplicates(["id"])


def simhash(spark, base):
    return _bodies(spark, base).where("body is not null").select("id", F.lpad(F.bin(text.simhash64(F.col("body"))), 64, "0").alias("bits"))


def simhash_audit(spark, base):
    """How many chunks have a right, a wrong or no stored SimHash."""
    rows = _bodies(spark, base).where("body is not null").select("simhash", text.simhash64(F.col("body")).alias("right"))
    state = F.when(F.col("simhash").isNull(), "none").when(F.col("simhash") == F.col("right"), "right").otherwise("wrong")
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n_chunks"))


def simhash_near_dup(spark, base):
    return indexing.simhash_pairs(read_table(spark, base, "chunks"), "simhash", 3)


def dialect_compress(spark, base):
    rows = read_table(spark, base, "documents").where("text is not null")
    return rows.select("doc_id", text.compress_dialect(F.col("text"), {"garden": "GDN", "the": "ART"}).alias("short"))


def compression_ratio(spark, base):
    rows = read_table(spark, base, "documents").where("text is not null")
    return rows.select("doc_id", F.round(text.compression_ratio(F.col("text")), 6).alias("ratio"))


def fake_embedding(spark, base):
    rows = read_table(spark, base, "documents").where("text is not null")
    return rows.select("doc_id", F.transform(text.fake_embedding(F.col("text")), lambda v: F.round(v.cast("double"), 5)).alias("embedding"))


def normalize_text(spark, base):
    return read_table(spark, base, "documents").where("text is not null").select("doc_id", wordpiece.normalized(F.col("text"), MODEL).alias("normal"))


def wordpiece_encode(spark, base):
    return read_table(spark, base, "documents").where("text is not null").select("doc_id", wordpiece.encoded(F.col("text"), MODEL).alias("ids"))


def wordpiece_truncated(spark, base):
    """The first TRUNCATED pieces of each text, the last one [SEP], and how many were left out."""
    ids, over = F.col("ids"), F.greatest(F.size("ids") - TRUNCATED, F.lit(0))
    cut = F.when(over > 0, F.concat(F.slice(ids, 1, TRUNCATED - 1), F.slice(ids, -1, 1))).otherwise(ids)
    return wordpiece_encode(spark, base).select("doc_id", cut.alias("ids"), over.alias("overflow"))


def wordpiece_pair(spark, base):
    rows = read_table(spark, base, "documents").where("text is not null and title is not null")
    pair = wordpiece.joined_pair(wordpiece.encoded(F.col("title"), MODEL), wordpiece.encoded(F.col("text"), MODEL), MODEL)
    return rows.select("doc_id", pair.alias("pair")).select("doc_id", "pair.ids", "pair.type_ids")


def wordpiece_decode(spark, base):
    rows = read_table(spark, base, "documents").where("text is not null").select("doc_id", wordpiece.encoded(F.col("text"), MODEL).alias("ids"))
    return wordpiece.decoded(rows, "doc_id", "ids", MODEL)


def _elementwise(name):
    def run(spark, base):
        rows = read_table(spark, base, "embeddings")
        return rows.select(F.col("vec_id").alias("row"), F.posexplode(getattr(vectors, name)(F.col("embedding"))).alias("pos", "value")).withColumn("value", F.round("value", 6))

    return run


def vec_add_scale(spark, base):
    rows = read_table(spark, base, "embeddings")
    out = vectors.add(vectors.scale(F.col("embedding"), 0.5), F.col("embedding"))
    return rows.select(F.col("vec_id").alias("row"), F.posexplode(out).alias("pos", "value")).withColumn("value", F.round("value", 6))


def vec_mean_pool_by_label(spark, base):
    pooled = vectors.mean_pool(read_table(spark, base, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6))


def matmul_gram(spark, base):
    """The product of the embeddings' matrix, turned, with itself."""
    return vectors.gram(read_table(spark, base, "embeddings"), "embedding").withColumn("value", F.round("value", 5))


def embedding_lookup(spark, base):
    tokens = read_table(spark, base, "events").select(F.col("event_id").alias("row"), F.lit(0).alias("pos"), F.pmod("user_id", F.lit(400)).alias("id"))
    found = vectors.embedding_lookup(tokens, read_table(spark, base, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return found.select("row", "id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"))


def _tokens(spark, base):
    words = F.split(F.lower("title"), " ")
    return read_table(spark, base, "documents").where("title is not null").select(F.col("doc_id").alias("row"), F.posexplode(F.transform(words, lambda w: F.length(w))).alias("pos", "id"))


def position_ids(spark, base):
    return vectors.position_ids(_tokens(spark, base), 4).select("row", "pos", "position")


def pad_ids(spark, base):
    ids = F.transform(F.split(F.lower("title"), " "), lambda w: F.length(w))
    rows = read_table(spark, base, "documents").where("title is not null").select("doc_id", vectors.pad_ids(ids, 8, 0).alias("ids"))
    return rows.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.array_join(vectors.keep_mask(F.col("ids"), 0).cast("array<string>"), ",").alias("mask"))


def sparse_weights(spark, base):
    tokens = _tokens(spark, base).withColumn("weight", F.col("pos").cast("double") - 0.5)
    return vectors.sparse_weights(tokens, [0, 2]).select("row", F.explode("weights").alias("id", "weight"))


def late_interaction(spark, base):
    """Every row whose id is divisible by 100 is a query of three vectors, compared with the documents, of four vectors each, that hold the 50 rows next to its first one."""
    unit = read_table(spark, base, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("embedding"))
    asked = unit.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    q = asked.withColumn("vec_id", F.col("query_id") + F.col("pos")).join(unit, "vec_id").select("query_id", "pos", "embedding")
    near = retrieval.vector_topk(unit, q.where("pos = 0").select("query_id", "embedding"), 50, 64, id_col="vec_id")
    document = lambda c: F.floor(F.col(c).cast("bigint") / 4).alias("doc_id")
    d = near.select(F.col("query_id").cast("bigint").alias("query_id"), document("id")).distinct().join(unit.select(document("vec_id"), "embedding"), "doc_id").withColumn("pos", F.lit(0))
    return vectors.late_interaction(q, d).withColumn("score", F.round("score", 5))


def wordpiece_offsets(spark, base):
    return wordpiece.located(read_table(spark, base, "documents"), "doc_id", "text", MODEL)


def wordpiece_offset_ids(spark, base):
    """The ids of the pieces in the order of their places, and how many places are empty or not inside the text."""
    size = read_table(spark, base, "documents").where("text is not null").select("doc_id", F.octet_length("text").alias("size"))
    special = F.col("id").isin(MODEL.ids["[CLS]"], MODEL.ids["[SEP]"])
    rows = wordpiece_offsets(spark, base).withColumn("place", F.when(F.col("id") == MODEL.ids["[CLS]"], -1).when(F.col("id") == MODEL.ids["[SEP]"], 2**31 - 1).otherwise(F.col("begin")))
    outside = ~special & ((F.col("begin") < 0) | (F.col("end") <= F.col("begin")) | (F.col("end") > F.col("size")))
    each = rows.join(size, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "end", "id"))).alias("p"), F.sum(outside.cast("bigint")).alias("n_outside"))
    return each.select("doc_id", F.transform("p", lambda x: x["id"]).alias("ids"), "n_outside")


def attention(spark, base):
    """Attention within groups of eight vectors, the first six of which may be attended to."""
    rows = read_table(spark, base, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("row"), F.pmod("vec_id", F.lit(8)).alias("pos"), vectors.doubles(F.col("embedding")).alias("embedding"))
    out = vectors.attention(rows, rows.withColumn("value", F.col("embedding")), rows.where("pos < 6"))
    return out.select("row", "pos", F.posexplode("embedding").alias("at", "value")).withColumn("value", F.round("value", 5) + 0.0)  # no negative zero


def sinusoidal_positions(spark, base):
    rows = read_table(spark, base, "embeddings").select("vec_id", F.posexplode(vectors.sinusoidal_positions(F.col("vec_id").cast("double"), 16)).alias("pos", "value"))
    return rows.withColumn("value", F.round("value", 6))


def viterbi_tags(spark, base):
    """The best tags of each vector, read as 21 steps of three scores, and how often tags follow each other."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice(vectors.doubles(F.col("embedding")), i * 3 + 1, 3))
    tags = vectors.viterbi(steps, [[0.1, -0.2, 0.05], [0.0, 0.15, -0.1], [-0.05, 0.1, 0.2]], [0.1, 0.0, -0.1], [0.0, 0.1, 0.0])
    return read_table(spark, base, "embeddings").select("vec_id", F.array_join(tags.cast("array<string>"), "").alias("tags"))


_E = "CAST(embedding AS DOUBLE[])"


def _elements(expression: str, source: str = f"SELECT vec_id, {_E} AS x FROM embeddings") -> str:
    return f"SELECT vec_id AS row, CAST(i AS INTEGER) AS pos, round(y[i + 1], 6) AS value FROM (SELECT vec_id, {expression} AS y, unnest(range(len(x))) AS i FROM ({source}))"


_MAP = lambda f: _elements(f"list_transform(x, lambda v: {f})")
_SECTIONS = "string_split(regexp_replace(compiled_truth, '(^|\\n)([ \\t]*#{1,6}[ \\t])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
_TRIMMED = "regexp_replace(y, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
_WHITE = "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_SIMHASH = f"""b AS (SELECT id, any_value(body) AS body, any_value(simhash) AS simhash FROM chunks WHERE body IS NOT NULL GROUP BY id),
t AS (SELECT id, unnest(list_filter(string_split_regex(body, '{_WHITE}'), lambda w: w <> '')) AS w FROM b),
d AS (SELECT w, sha256(w) AS h FROM (SELECT DISTINCT w FROM t)),
s AS (SELECT w, i, CAST((CAST('0x' || substr(h, 2 * (i // 8) + 1, 2) AS INTEGER) >> (i % 8)) & 1 AS INTEGER) AS bit FROM d, (SELECT unnest(range(64)) AS i)),
v AS (SELECT id, i, sum(2 * bit - 1) >= 0 AS bit FROM t JOIN s USING (w) GROUP BY ALL),
r AS (SELECT b.id, b.simhash, coalesce(string_agg(CASE WHEN v.bit THEN '1' ELSE '0' END, '' ORDER BY v.i DESC), repeat('1', 64)) AS bits FROM b LEFT JOIN v ON v.id = b.id GROUP BY ALL)"""


def _pieces(text: str) -> str:
    """The ids of a text's pieces under the vocabulary of characters, without [CLS] and [SEP]: an expression for DuckDB."""
    first, later = "5 + unicode(w) - 33", "99 + CASE WHEN c <= '9' THEN unicode(c) - 48 WHEN c <= 'Z' THEN 10 + unicode(c) - 65 ELSE 36 + unicode(c) - 97 END"
    word = f"CASE WHEN {_UNKNOWN} THEN [1] ELSE list_prepend({first}, list_transform(string_split(w[2:], ''), lambda c: {later})) END"
    return f"flatten(list_transform({_words(text)}, lambda w: CASE WHEN length(w) = 1 AND NOT ({_UNKNOWN}) THEN [{first}] ELSE {word} END))"


def _words(text: str) -> str:
    clean = f"regexp_replace(regexp_replace({text}, '[\\t\\n\\r]', ' ', 'g'), '[\\x{{fffd}}\\pC]', '', 'g')"
    spaced = f"regexp_replace({clean}, '([\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{20000}}-\\x{{2a6df}}\\x{{2a700}}-\\x{{2ceaf}}\\x{{2f800}}-\\x{{2fa1f}}])', ' \\1 ', 'g')"
    return f"regexp_extract_all(lower(strip_accents({spaced})), '[!-/:-@\\[-`{{-~\\pP]|[^\\s\\pZ!-/:-@\\[-`{{-~\\pP]+')"


_UNKNOWN = "length(w) > 100 OR NOT regexp_full_match(w, '[!-~]+')"


def _cases(d: dict[str, str], prefix: str = "") -> str:
    return "CASE w " + " ".join(f"WHEN '{k}' THEN '{prefix}{v}'" for k, v in d.items()) + " END"


def _dialect(entities: dict[str, str]) -> str:
    kept = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"
    named = "(" + ", ".join(f"'{w}'" for w in entities or {"": ""}) + ")"
    code = _cases(entities) if entities else "NULL"
    parts = f"CASE WHEN w IN {named} THEN [{code}] ELSE list_filter([w, {_cases(text.EMOTIONS, 'emotion_')}, {_cases(text.FLAGS)}], lambda z: z IS NOT NULL) END"
    tokens = "list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z_-]{2,}'), lambda w: lower(w))"
    return f"array_to_string(flatten(list_transform(list_filter({tokens}, lambda w: w NOT IN {kept} OR w IN {named}), lambda w: {parts})), ' ')"


_WORDS = "SELECT doc_id, list_transform(string_split(lower(title), ' '), lambda w: length(w)) AS x FROM documents WHERE title IS NOT NULL"
QUERIES = {
    "chunk_markdown": chunk_markdown, "atx_headings": atx_headings, "index_markdown": index_markdown, "index_chunks": index_chunks,
    "simhash64": simhash, "simhash_audit": simhash_audit, "simhash_near_dup": simhash_near_dup,
    "dialect_compress": dialect_compress, "compression_ratio": compression_ratio, "fake_embedding": fake_embedding,
    "normalize_text": normalize_text, "wordpiece_encode": wordpiece_encode, "wordpiece_truncated": wordpiece_truncated, "wordpiece_pair": wordpiece_pair, "wordpiece_decode": wordpiece_decode,
    **{f"vec_{n}": _elementwise(n) for n in ("l2_normalize", "softmax", "layer_norm", "relu", "gelu", "sigmoid", "tanh")},
    "vec_add_scale": vec_add_scale, "vec_mean_pool_by_label": vec_mean_pool_by_label, "matmul_gram": matmul_gram, "embedding_lookup": embedding_lookup,
    "position_ids": position_ids, "pad_ids": pad_ids, "wordpiece_offsets": wordpiece_offsets, "wordpiece_offset_ids": wordpiece_offset_ids, "attention": attention, "sinusoidal_positions": sinusoidal_positions, "viterbi_tags": viterbi_tags,
    "sparse_weights": sparse_weights, "late_interaction": late_interaction,
}
SQL = {
    "chunk_markdown": f"""WITH {_CUR}, s AS (SELECT slug, list_filter(list_transform({_SECTIONS}, lambda y: {_TRIMMED}), lambda y: y <> '') AS b FROM live WHERE compiled_truth IS NOT NULL)
SELECT slug, CAST(i AS INTEGER) AS ord, b[i + 1] AS body FROM (SELECT slug, b, unnest(range(len(b))) AS i FROM s)""",
    "atx_headings": f"WITH {_CUR}, l AS (SELECT slug, unnest(string_split(compiled_truth, chr(10))) AS body FROM live) SELECT slug, count(*) AS headings FROM l WHERE regexp_matches(body, '^[ \\t]*#{{1,6}}[ \\t]') GROUP BY slug",
    "wordpiece_encode": f"SELECT doc_id, list_append(list_prepend(2, {_pieces('text')}), 3) AS ids FROM documents WHERE text IS NOT NULL",
    "wordpiece_truncated": f"""SELECT doc_id, CASE WHEN len(ids) > {TRUNCATED} THEN list_append(ids[1:{TRUNCATED - 1}], 3) ELSE ids END AS ids, CAST(greatest(len(ids) - {TRUNCATED}, 0) AS INTEGER) AS overflow
FROM (SELECT doc_id, list_append(list_prepend(2, {_pieces('text')}), 3) AS ids FROM documents WHERE text IS NOT NULL)""",
    "wordpiece_pair": f"""SELECT doc_id, flatten([[2], a, [3], b, [3]]) AS ids, list_concat(list_transform(range(len(a) + 2), lambda i: 0), list_transform(range(len(b) + 1), lambda i: 1)) AS type_ids
FROM (SELECT doc_id, {_pieces('title')} AS a, {_pieces('text')} AS b FROM documents WHERE text IS NOT NULL AND title IS NOT NULL)""",
    "wordpiece_offset_ids": f"SELECT doc_id, list_append(list_prepend(2, {_pieces('text')}), 3) AS ids, CAST(0 AS BIGINT) AS n_outside FROM documents WHERE text IS NOT NULL",
    "wordpiece_decode": f"SELECT doc_id, array_to_string(list_transform({_words('text')}, lambda w: CASE WHEN {_UNKNOWN} THEN '[UNK]' ELSE w END), ' ') AS text FROM documents WHERE text IS NOT NULL",
    "index_chunks": f"""WITH {_CUR}, c AS (SELECT slug, list_filter(list_transform({_SECTIONS}, lambda y: {_TRIMMED}), lambda y: y <> '') AS b FROM live WHERE compiled_truth IS NOT NULL),
k AS (SELECT slug || '#' || i AS id, CAST(i AS INTEGER) AS ord, b[i + 1] AS body FROM (SELECT slug, b, unnest(range(len(b))) AS i FROM c)),
t AS (SELECT id, unnest(list_filter(string_split_regex(body, '{_WHITE}'), lambda w: w <> '')) AS w FROM k),
d AS (SELECT w, sha256(w) AS h FROM (SELECT DISTINCT w FROM t)),
s AS (SELECT w, i, CAST((CAST('0x' || substr(h, 2 * (i // 8) + 1, 2) AS INTEGER) >> (i % 8)) & 1 AS INTEGER) AS bit FROM d, (SELECT unnest(range(64)) AS i)),
v AS (SELECT id, i, sum(2 * bit - 1) >= 0 AS bit FROM t JOIN s USING (w) GROUP BY ALL),
r AS (SELECT id, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY i DESC) AS bits FROM v GROUP BY id)
SELECT k.id, k.ord, md5(k.body) AS digest, r.bits, 16 AS dim FROM k JOIN r USING (id)""",
    "simhash64": f"WITH {_SIMHASH} SELECT id, bits FROM r",
    "simhash_audit": f"""WITH {_SIMHASH}, x AS (SELECT id, string_agg(CAST((simhash >> i) & 1 AS VARCHAR), '' ORDER BY i DESC) AS stored FROM (SELECT id, CAST(simhash AS HUGEINT) + CASE WHEN simhash < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END AS simhash FROM r WHERE simhash IS NOT NULL), (SELECT unnest(range(64)) AS i) GROUP BY id)
SELECT CASE WHEN stored IS NULL THEN 'none' WHEN stored = bits THEN 'right' ELSE 'wrong' END AS state, count(*) AS n_chunks FROM r LEFT JOIN x USING (id) GROUP BY ALL""",
    "simhash_near_dup": """WITH h AS (SELECT DISTINCT simhash AS h FROM chunks WHERE simhash IS NOT NULL)
SELECT a.h AS hash_a, b.h AS hash_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS bits FROM h a JOIN h b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 3""",
    "dialect_compress": f"SELECT doc_id, {_dialect({'garden': 'GDN', 'the': 'ART'})} AS short FROM documents WHERE text IS NOT NULL",
    "compression_ratio": f"SELECT doc_id, round(CASE WHEN text = '' THEN 1.0::DOUBLE ELSE strlen({_dialect({})})::DOUBLE / strlen(text) END, 6) AS ratio FROM documents WHERE text IS NOT NULL",
    "vec_l2_normalize": _elements("list_transform(x, lambda v: v / n)", f"SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM (SELECT vec_id, {_E} AS x FROM embeddings)"),
    "vec_softmax": _elements("list_transform(x, lambda v: exp(v - m) / n)", f"SELECT vec_id, x, m, list_sum(list_transform(x, lambda v: exp(v - m))) AS n FROM (SELECT vec_id, {_E} AS x, list_max({_E}) AS m FROM embeddings)"),
    "vec_layer_norm": _elements("list_transform(x, lambda v: (v - m) / sqrt(s + 0.00001::DOUBLE))", f"SELECT vec_id, x, m, list_sum(list_transform(x, lambda v: (v - m) * (v - m))) / len(x) AS s FROM (SELECT vec_id, {_E} AS x, list_avg({_E}) AS m FROM embeddings)"),
    "vec_relu": _MAP("greatest(v, 0.0::DOUBLE)"),
    "vec_gelu": _MAP("0.5::DOUBLE * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715::DOUBLE * v * v * v)))"),
    "vec_sigmoid": _MAP("1 / (1 + exp(-v))"),
    "vec_tanh": _MAP("tanh(v)"),
    "vec_add_scale": _MAP("0.5::DOUBLE * v + v"),
    "vec_mean_pool_by_label": f"SELECT label, CAST(i AS INTEGER) AS pos, round(avg(x[i + 1]), 6) AS value FROM (SELECT label, x, unnest(range(len(x))) AS i FROM (SELECT label, {_E} AS x FROM embeddings)) GROUP BY label, i",
    "matmul_gram": f"""WITH c AS (SELECT vec_id, CAST(i AS INTEGER) AS i, x[i + 1] AS v FROM (SELECT vec_id, x, unnest(range(len(x))) AS i FROM (SELECT vec_id, {_E} AS x FROM embeddings)))
SELECT a.i AS i, b.i AS j, round(sum(a.v * b.v), 5) AS value FROM c a JOIN c b USING (vec_id) GROUP BY ALL""",
    "embedding_lookup": f"SELECT event_id AS row, user_id % 400 AS id, round(sqrt(list_sum(list_transform({_E}, lambda v: v * v))), 6) AS length FROM events JOIN embeddings ON vec_id = user_id % 400",
    "position_ids": f"""WITH w AS ({_WORDS}), t AS (SELECT doc_id AS row, CAST(i AS INTEGER) AS pos, x[i + 1] AS id FROM (SELECT doc_id, x, unnest(range(len(x))) AS i FROM w))
SELECT row, pos, CAST(CASE WHEN id = 4 THEN 4 ELSE 4 + sum(CASE WHEN id <> 4 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY pos) END AS BIGINT) AS position FROM t""",
    "pad_ids": f"""WITH w AS (SELECT doc_id, list_concat(x, list_transform(range(greatest(0, 8 - len(x))), lambda z: 0::BIGINT)) AS x FROM ({_WORDS}))
SELECT doc_id, array_to_string(x, ',') AS ids, array_to_string(list_transform(x, lambda z: CASE WHEN z <> 0 THEN 1 ELSE 0 END), ',') AS mask FROM w""",
    "sparse_weights": f"""WITH w AS ({_WORDS}), t AS (SELECT doc_id AS row, i - 0.5 AS weight, x[i + 1] AS id FROM (SELECT doc_id, x, unnest(range(len(x))) AS i FROM w))
SELECT row, CAST(id AS INTEGER) AS id, CAST(max(weight) AS DOUBLE) AS weight FROM t WHERE id NOT IN (0, 2) GROUP BY row, id HAVING max(weight) > 0""",
    "late_interaction": f"""WITH e AS (SELECT vec_id, CAST({_E} AS DOUBLE[64]) AS e FROM embeddings),
q AS (SELECT e.vec_id - e.vec_id % 100 AS q, e.vec_id, e.e FROM e WHERE e.vec_id % 100 <= 2 AND e.vec_id - e.vec_id % 100 IN (SELECT vec_id FROM e)),
n AS (SELECT q.q, d.vec_id // 4 AS doc_id, row_number() OVER (PARTITION BY q.q ORDER BY round(array_cosine_similarity(q.e, d.e), 9) DESC, CAST(d.vec_id AS VARCHAR)) AS rank FROM q JOIN e d ON q.vec_id = q.q QUALIFY rank <= 50),
c AS (SELECT DISTINCT q, doc_id FROM n),
b AS (SELECT q.q, q.vec_id, c.doc_id, max(array_cosine_similarity(q.e, d.e)) AS best FROM q JOIN c ON c.q = q.q JOIN e d ON d.vec_id // 4 = c.doc_id GROUP BY ALL)
SELECT q AS query_id, doc_id, round(sum(best), 5) AS score FROM b GROUP BY ALL""",
    "attention": f"""WITH e AS (SELECT vec_id // 8 AS row, vec_id % 8 AS pos, {_E} AS e FROM embeddings),
s AS (SELECT q.row AS row, q.pos AS pos, k.e AS v, list_dot_product(q.e, k.e) / 8 AS s FROM e q JOIN e k ON q.row = k.row AND k.pos < 6),
w AS (SELECT row, pos, v, exp(s - max(s) OVER (PARTITION BY row, pos)) AS w FROM s),
n AS (SELECT row, pos, v, w / sum(w) OVER (PARTITION BY row, pos) AS w FROM w)
SELECT row, pos, CAST(i AS INTEGER) AS at, round(sum(w * v[i + 1]), 5) + 0 AS value FROM (SELECT *, unnest(range(64)) AS i FROM n) GROUP BY row, pos, i""",
    "sinusoidal_positions": """SELECT vec_id, CAST(i AS INTEGER) AS pos, round(CASE WHEN i % 2 = 0 THEN sin(a) ELSE cos(a) END, 6) AS value
FROM (SELECT vec_id, i, vec_id / pow(10000, (i - i % 2) / 16) AS a FROM embeddings, (SELECT unnest(range(16)) AS i))""",
}
