"""Queries whose result needs all rows against all, long sequences, or a file written by many tasks; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.functions import tensors as V
from gavel.functions.quant import MXFP4_VALUES, dequantize
from gavel.operators import tiles
from gavel.operators.prefixes import longest_shared_prefix
from gavel.operators.tables import new_folder
from gavel.plans.tensor_queries import _ATT, _X, SEQ, _digest, _v
from gavel.plans.text_queries import _table
from gavel.sources import register
from gavel.sources.gguf import write_tensors

LONG = 512
KINDS = ("Q8_0", "Q5_1", "MXFP4")


def largest_product(spark, sf_dir):
    """Each vector's largest product with another one."""
    v = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return tiles.largest_product(v, v).select(F.col("row").alias("vec_id"), V.rounded(F.col("y")).alias("product"))


def long_attention(spark, sf_dir):
    """Causal attention over sequences of 512 vectors, merged from blocks of 64 keys."""
    s = _v(spark, sf_dir).select(F.floor(F.col("vec_id") / LONG).cast("long").alias("seq"), (F.col("vec_id") % LONG).alias("pos"), "x")
    out = tiles.causal_attention(s.select("seq", "pos", F.col("x").alias("q"), F.col("x").alias("k"), F.col("x").alias("v")), dim=64, block=64)
    return out.select("seq", "pos", *_digest(F.col("o")))


def top20_by_label(spark, sf_dir):
    """The twenty vectors of each label whose product with vector 0 is largest; some values are no numbers and come last."""
    v = _v(spark, sf_dir)
    first = v.filter("vec_id = 0").limit(1).select(F.col("x").alias("w"))
    value = F.when(F.col("vec_id") % 97 == 5, float("nan")).otherwise(F.round(V.dot("x", "w"), 6))
    rows = v.crossJoin(F.broadcast(first)).select("label", "vec_id", value.alias("value"))
    return tiles.top_k(rows, "label", "vec_id", "value", 20).select("label", "rank", "vec_id", V.rounded(F.col("value")).alias("value"))


def longest_prefix(spark, sf_dir):
    """How many characters each whole document shares with the start of any user's turn."""
    asked = _table(spark, sf_dir, "conversations").filter("role = 'user'")
    return longest_shared_prefix(_table(spark, sf_dir, "documents"), "doc_id", "text", asked, "text")


def gguf_round_trip(spark, sf_dir):
    """All vectors written as rows of a file of each type and read again: the errors of each row."""
    register(spark)
    v = _v(spark, sf_dir)
    rows = v.select(F.lit("token_embd.weight").alias("tensor"), F.col("vec_id").alias("row_id"), F.col("x").alias("values"))
    parts = []
    for kind in KINDS:
        path = f"{new_folder(spark)}.gguf"
        write_tensors(rows, path, kind, {"general.architecture": ("string", "mistral3")})
        read = spark.read.format("gguf").option("path", path).option("view", "rows").load()
        parts.append(read.select(F.lit(kind).alias("type"), F.col("row_id").cast("long").alias("vec_id"), dequantize(kind, "packed").alias("y")))
    both = parts[0].union(parts[1]).union(parts[2]).join(v, "vec_id")
    off = F.zip_with("x", "y", lambda a, b: F.abs(a - b.cast("double")))
    return both.select("type", "vec_id", V.rounded(F.array_max(off), 7).alias("worst"), V.rounded(F.sqrt(F.aggregate(off, F.lit(0.0), lambda a, d: a + d * d)), 6).alias("l2"))


def integer_product_error(spark, sf_dir):
    """Relative L2 of each vector's integer products with all vectors, quantized, from the float ones."""
    v = _v(spark, sf_dir).select(F.col("vec_id").alias("id"), "x")
    parts = [tiles.integer_error(v, tiles.packed_rows(v, kind), kind).select(F.lit(kind).alias("type"), F.col("row").alias("vec_id"), V.rounded(F.col("relative_l2"), 6).alias("relative_l2")) for kind in KINDS[:2]]
    return parts[0].union(parts[1])


_HALF = "(CASE WHEN {v} = 0 THEN 0 ELSE round_even({v}::DOUBLE / greatest(pow(2, floor(log2(abs({v}))) - 10), pow(2, -24)), 0) * greatest(pow(2, floor(log2(abs({v}))) - 10), pow(2, -24)) END)"
_D8, _D5 = "(top / 127::FLOAT)", "((most - least) / 31::FLOAT)"
_Q8 = f"sign(x) * least(127, floor(abs(x / {_D8}) + 0.5::FLOAT))"
_Q5 = f"least(31, floor((x - least) / {_D5} + 0.5::FLOAT))"
_P4 = "pow(2, floor(log2(top)) - 2 + 127 - 128)"
_Y4 = f"(CASE WHEN top = 0 THEN 0 ELSE {_P4} * list_extract([{', '.join(map(str, map(float, MXFP4_VALUES)))}], 1 + list_min(list_transform(range(16), lambda k: {{'d': abs(x / {_P4} - list_extract([{', '.join(map(str, map(float, MXFP4_VALUES)))}], k + 1)), 'k': k}})).k) END)"
_BLOCKS = "SELECT vec_id, x, max(abs(x)) OVER w AS top, min(x) OVER w AS least, max(x) OVER w AS most FROM (SELECT vec_id, i // 32 AS b, embedding[i + 1]::FLOAT AS x FROM embeddings, (SELECT unnest(range(64)) AS i)) WINDOW w AS (PARTITION BY vec_id, b)"
_Y = {
    "Q8_0": f"(CASE WHEN top = 0 THEN 0 ELSE {_HALF.format(v=_D8)} * {_Q8} END)::FLOAT",
    "Q5_1": f"((CASE WHEN most = least THEN 0 ELSE {_HALF.format(v=_D5)} * {_Q5} END)::FLOAT + {_HALF.format(v='least')}::FLOAT)",
    "MXFP4": _Y4,
}
_CODED = f"""SELECT *, CASE WHEN top = 0 THEN 0 ELSE {_Q8} END AS q8, {_HALF.format(v=_D8)} AS s8, CASE WHEN most = least THEN 0 ELSE {_Q5} END AS q5, {_HALF.format(v=_D5)} AS s5, {_HALF.format(v='least')} AS m5, {_Y['Q8_0']} AS y8, {_Y['Q5_1']} AS y5
FROM (SELECT vec_id, i, x, max(abs(x)) OVER w AS top, min(x) OVER w AS least, max(x) OVER w AS most FROM (SELECT vec_id, i, embedding[i + 1]::FLOAT AS x FROM embeddings, (SELECT unnest(range(64)) AS i)) WINDOW w AS (PARTITION BY vec_id, i // 32))"""
_ERRORS = f"""WITH e AS ({_CODED}),
r AS (SELECT vec_id, list(x::DOUBLE ORDER BY i) AS x, list(q8::DOUBLE ORDER BY i) AS q8, list(q5::DOUBLE ORDER BY i) AS q5, list(y8::DOUBLE ORDER BY i) AS y8, list(y5::DOUBLE ORDER BY i) AS y5, {', '.join(f"max({c}) FILTER (i // 32 = {b})::DOUBLE AS {c}_{b}" for c in ('s8', 's5', 'm5') for b in (0, 1))} FROM e GROUP BY vec_id),
p AS (SELECT a.vec_id, list_dot_product(a.x, w.y8) AS f8, list_dot_product(a.x, w.y5) AS f5,
    {' + '.join(f'a.s8_{b} * w.s8_{b} * list_dot_product(a.q8[{32 * b + 1}:{32 * b + 32}], w.q8[{32 * b + 1}:{32 * b + 32}])' for b in (0, 1))} AS i8,
    {' + '.join(f'a.s8_{b} * w.s5_{b} * list_dot_product(a.q8[{32 * b + 1}:{32 * b + 32}], w.q5[{32 * b + 1}:{32 * b + 32}]) + w.m5_{b} * a.s8_{b} * list_sum(a.q8[{32 * b + 1}:{32 * b + 32}])' for b in (0, 1))} AS i5 FROM r a, r w)"""
_LONG_SQL = _ATT(1, 1, 64).replace(f"vec_id // {SEQ} ", f"vec_id // {LONG} ").replace(f"vec_id % {SEQ} ", f"vec_id % {LONG} ")

QUERIES = {f.__name__: f for f in (largest_product, long_attention, top20_by_label, longest_prefix, gguf_round_trip, integer_product_error)}
ORACLE_SQL = {
    "largest_product": f"WITH v AS ({_X}) SELECT a.vec_id, round(max(list_dot_product(a.x, b.x)), 4) + 0.0 AS product FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1",
    "long_attention": f"{_LONG_SQL}",
    "top20_by_label": f"SELECT label, (n - 1)::INTEGER AS rank, vec_id, round(value, 4) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY isnan(value), value DESC, vec_id) AS n FROM (SELECT a.label, a.vec_id, CASE WHEN a.vec_id % 97 = 5 THEN 'nan'::DOUBLE ELSE round(list_dot_product(a.x, z.x), 6) END AS value FROM ({_X}) a, (SELECT x FROM ({_X}) WHERE vec_id = 0) z)) WHERE n <= 20",
    "longest_prefix": """WITH p AS (SELECT DISTINCT text AS p FROM conversations WHERE role = 'user'),
s AS (SELECT DISTINCT i, p[1:i] AS s FROM p, (SELECT unnest(range(1, 9)) AS i) WHERE length(p) >= i),
a AS (SELECT doc_id, max(i) AS n FROM documents JOIN s ON text[1:i] = s AND length(text) >= i GROUP BY doc_id),
b AS (SELECT doc_id, text, p, least(length(text), length(p)) AS m FROM documents JOIN p ON text[1:8] = p[1:8] AND length(text) >= 8 AND length(p) >= 8),
c AS (SELECT doc_id, max(i) AS n FROM (SELECT doc_id, text, p, unnest(range(8, m + 1)) AS i FROM b) WHERE text[1:i] = p[1:i] GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN greatest(coalesce(a.n, 0), coalesce(c.n, 0)) END::BIGINT AS shared FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "integer_product_error": _ERRORS + " UNION ALL ".join(f" SELECT '{k}' AS type, vec_id, round(sqrt(sum(pow(i{c} - f{c}, 2))) / sqrt(sum(pow(f{c}, 2))), 6) + 0.0 AS relative_l2 FROM p GROUP BY vec_id" for k, c in (("Q8_0", 8), ("Q5_1", 5))),
    "gguf_round_trip": f"WITH b AS ({_BLOCKS}) " + " UNION ALL ".join(f"SELECT '{k}' AS type, vec_id, round(max(abs(x::DOUBLE - y)), 7) + 0.0 AS worst, round(sqrt(sum(pow(x::DOUBLE - y, 2))), 6) + 0.0 AS l2 FROM (SELECT vec_id, x, {_Y[k]} AS y FROM b) GROUP BY vec_id" for k in KINDS),
}
