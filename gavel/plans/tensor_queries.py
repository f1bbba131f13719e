"""Queries of vector arithmetic, positions, attention and verdicts over the embeddings, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions import tensors as V
from gavel.functions import text as T


def _v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", V.doubles("embedding").alias("x"))


def _head(v: DataFrame, n: int = 8) -> DataFrame:
    """One row: the first n vectors as rows of the output head."""
    own = v.filter(F.col("vec_id") < n)
    return own.agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda r: r["x"]).alias("head"))


def _logits(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """Only the rows of the head that are asked for; one broadcast row, no shuffle of the vectors."""
    v = _v(spark, sf_dir)
    return v.crossJoin(F.broadcast(_head(v, n))).select("vec_id", "label", F.transform("head", lambda w: V.dot("x", w)).alias("logits"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _logits(spark, sf_dir).select("vec_id", "label", V.best(F.slice("logits", 1, 4)).alias("yes"), V.best(F.slice("logits", 5, 4)).alias("no"))
    return best.withColumn("score", V.verdict(F.col("yes"), F.col("no")))


def verdict_from_hidden(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", V.rounded(F.col("score")).alias("score"), V.rounded(F.col("yes")).alias("yes_logit"), V.rounded(F.col("no")).alias("no_logit"), T.is_unsafe(F.round("score", 4)).alias("is_unsafe"))


THRESHOLDS = [0.1 * k for k in range(1, 10)]


def verdict_threshold_sweep(spark, sf_dir):
    s = _scored(spark, sf_dir).select(F.round("score", 4).alias("s"), F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("t"))
    return s.groupBy(F.round("t", 1).alias("threshold")).agg(F.count("*").alias("n"), F.sum((F.col("s") > F.col("t")).cast("int")).alias("unsafe"))


def verdict_by_label(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.sum((F.round("score", 4) > 0.5).cast("int")).alias("unsafe"), V.rounded(F.avg("score")).alias("mean_score"))


def verdict_vs_label(spark, sf_dir):
    """Confusion counts of verdicts against toxic labels, joined by id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    s = _scored(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), (F.round("score", 4) > 0.5).alias("unsafe"))
    return labels.join(s, "doc_id").groupBy("toxic", "unsafe").agg(F.count("*").alias("n"))


def verdict_logits_full(spark, sf_dir):
    return _logits(spark, sf_dir, 32).select("vec_id", F.posexplode(V.rounded_all(F.col("logits"))).alias("token", "logit"))


def top_verdict_token(spark, sf_dir):
    return _logits(spark, sf_dir, 32).select("vec_id", V.arg_max("logits").cast("long").alias("token"))


def top20_logits(spark, sf_dir):
    """The twenty greatest logits of each vector, ties by token."""
    l = _logits(spark, sf_dir, 32).select("vec_id", F.transform("logits", lambda x, i: F.struct((-F.round(x, 6)).alias("k"), i.alias("token"), x.alias("x"))).alias("p"))  # noqa: E741
    top = F.slice(F.array_sort("p"), 1, 20)
    return l.select("vec_id", F.posexplode(top).alias("rank", "p")).select("vec_id", "rank", F.col("p.token").alias("token"), V.rounded(F.col("p.x")).alias("logit"))


def top20_overlap(spark, sf_dir):
    """How many of the top twenty two neighbours share."""
    t = top20_logits(spark, sf_dir).groupBy("vec_id").agg(F.collect_set("token").alias("s"))
    n = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("other"))
    return t.join(n, "vec_id").select("vec_id", F.size(F.array_intersect("s", "other")).cast("long").alias("shared"))


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", *[V.rounded(F.col(c)).alias(c) for c in ("score", "yes", "no")])


def verdict_string(spark, sf_dir):
    """Verdicts as text, of scores rounded to four decimals first."""
    return _shown(spark, sf_dir).select("vec_id", T.verdict_text("score", "yes", "no").alias("verdict"))


def verdict_json(spark, sf_dir):
    """Verdicts as JSON; characters of the document of the same id stand for prompt tokens, and no model runs, so times are 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), F.char_length("text").alias("n"))
    none = F.lit(0)
    j = T.verdict_json("score", "yes", "no", F.coalesce("n", none), none, none, none)
    return _shown(spark, sf_dir).join(docs, "vec_id", "left").select("vec_id", j.alias("verdict"))


def _with_next(spark, sf_dir, more: int = 1) -> DataFrame:
    """Vectors beside the ones that follow by id: y, z ..."""
    v = _v(spark, sf_dir).select("vec_id", "x")
    out = v
    for k in range(1, more + 1):
        out = out.join(v.select((F.col("vec_id") - k).alias("vec_id"), F.col("x").alias("yzuw"[k - 1])), "vec_id")
    return out


def _digest(c: Column, places: int = 4) -> list[Column]:
    """An array as its sum, its sum weighted by position, and its ends."""
    s = F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    w = F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return [V.rounded(s, places).alias("v_sum"), V.rounded(w, places - 1).alias("v_weighted"), V.rounded(c[0], places).alias("v_first"), V.rounded(F.element_at(c, -1), places).alias("v_last")]


def _digest_sql(v: str, places: int = 4) -> str:
    return f"round(list_sum({v}), {places}) + 0.0 v_sum, round(list_sum(list_transform(range(len({v})), lambda i: {v}[i + 1] * (i + 1))), {places - 1}) + 0.0 v_weighted, round({v}[1], {places}) + 0.0 v_first, round({v}[len({v})], {places}) + 0.0 v_last"


def dot(spark, sf_dir):
    return _with_next(spark, sf_dir).select("vec_id", V.rounded(V.dot("x", "y")).alias("dot"))


def dot4(spark, sf_dir):
    return _with_next(spark, sf_dir, 4).select("vec_id", *[V.rounded(V.dot("x", c)).alias(f"dot{i}") for i, c in enumerate("yzuw")])


def checksum(spark, sf_dir):
    return _v(spark, sf_dir).select("vec_id", V.rounded(V.dot("x", "x")).alias("squares"))


def rms_norm(spark, sf_dir):
    r = _with_next(spark, sf_dir).select("vec_id", V.rms_norm("x", "y").alias("r"))
    return r.select("vec_id", *_digest(F.col("r")))


def softmax(spark, sf_dir):
    s = _v(spark, sf_dir).select("vec_id", V.softmax(F.transform("x", lambda a: a * 20)).alias("s"))
    return s.select("vec_id", *_digest(F.col("s")))


def softmax_masked(spark, sf_dir):
    """A part masked, and for every ninth vector all of it: then uniform."""
    masked = F.transform("x", lambda a, i: F.when((F.col("vec_id") % 9 == 0) | (i % 4 == 0), F.lit(float("-inf"))).otherwise(a * 20))
    s = _v(spark, sf_dir).select("vec_id", masked.alias("m")).select("vec_id", V.softmax("m").alias("s"))
    return s.select("vec_id", *_digest(F.col("s")))


def swiglu(spark, sf_dir):
    return _with_next(spark, sf_dir).select("vec_id", V.swiglu("x", "y").alias("s")).select("vec_id", *_digest(F.col("s")))


def sigmoid(spark, sf_dir):
    return _v(spark, sf_dir).select("vec_id", F.transform("x", V.sigmoid).alias("s")).select("vec_id", *_digest(F.col("s")))


def add_scaled(spark, sf_dir):
    return _with_next(spark, sf_dir).select("vec_id", V.add_scaled("x", "y", 0.5).alias("s")).select("vec_id", *_digest(F.col("s")))


def argmax(spark, sf_dir):
    return _v(spark, sf_dir).select("vec_id", V.arg_max("x").cast("long").alias("place"))


def relative_l2(spark, sf_dir):
    return _with_next(spark, sf_dir).select("vec_id", V.rounded(V.relative_l2("x", "y")).alias("relative_l2"))


def worst_relative_error(spark, sf_dir):
    return _with_next(spark, sf_dir).select("vec_id", V.rounded(V.worst_error("x", "y")).alias("worst"))


ROW_IDS = [5, 3, 5, 12]


def parity_report(spark, sf_dir):
    """All vectors are expected; those of labelled documents have an actual one."""
    a = _v(spark, sf_dir).select("vec_id", "x")
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("vec_id"))
    actual = a.join(labelled, "vec_id", "left_semi").select("vec_id", F.transform("x", lambda t: t * 1.01).alias("a"))
    return a.join(actual, "vec_id", "left").select("vec_id", V.rounded(V.relative_l2("a", "x")).alias("relative_l2"))


def matmul(spark, sf_dir):
    """All vectors by the first sixteen rows of a weight."""
    v = _v(spark, sf_dir)
    y = v.crossJoin(F.broadcast(_head(v, 16))).select(F.col("vec_id").alias("token"), F.posexplode(F.transform("head", lambda w: V.dot("x", w))).alias("row_id", "y"))
    return y.select("token", "row_id", V.rounded(F.col("y")).alias("y"))


def matmul_rows(spark, sf_dir):
    """All vectors by the rows asked for, in that order, repeated ones too."""
    v = _v(spark, sf_dir)
    ids = spark.createDataFrame(list(enumerate(ROW_IDS)), "pos int, row_id long")
    w = ids.join(v.select(F.col("vec_id").alias("row_id"), F.col("x").alias("w")), "row_id")
    return v.crossJoin(F.broadcast(w)).select(F.col("vec_id").alias("token"), "pos", V.rounded(V.dot("x", "w")).alias("y"))


def gather_rows(spark, sf_dir):
    """Embedding rows of token ids that range over the whole table, joined before anything is computed; an id out of range is an error."""
    v = _v(spark, sf_dir)
    last = v.agg(F.max("vec_id").alias("last"))
    tokens = v.select(F.col("vec_id").alias("pos")).crossJoin(F.broadcast(last)).select("pos", F.pmod(F.col("pos") * 7, F.col("last") + 1).alias("vec_id"))
    rows = tokens.join(v.select("vec_id", "x"), "vec_id", "left")
    x = F.when(F.col("x").isNull(), F.raise_error(F.concat(F.lit("no row for token "), F.col("vec_id").cast("string"))).cast("array<double>")).otherwise(F.col("x").cast("array<double>"))
    return rows.select("pos", F.col("vec_id").alias("token"), V.rounded(V.total(x)).alias("row_sum"))


def id_range_check(spark, sf_dir):
    """Which ids are not rows of the table."""
    v = _v(spark, sf_dir)
    asked = v.select((F.col("vec_id") * 3).alias("id"))
    return asked.join(v.select(F.col("vec_id").alias("id")), "id", "left_anti")


def rope_rotate(spark, sf_dir):
    """Two heads of 32, turned by their vector's position; the last eight of each head stay."""
    r = _v(spark, sf_dir).select("vec_id", V.rotate("x", "vec_id", V.rope_frequencies(24, 1e4), 32).alias("r"))
    return r.select("vec_id", *_digest(F.col("r")))


def attn_temperature(spark, sf_dir):
    return _v(spark, sf_dir).select("vec_id", V.rounded(V.temperature("vec_id", 0.1, 64)).alias("scale"))


SEQ = 16


def _sequences(spark, sf_dir) -> DataFrame:
    """The vectors as sequences of SEQ positions."""
    return _v(spark, sf_dir).select((F.floor(F.col("vec_id") / SEQ)).cast("long").alias("seq"), (F.col("vec_id") % SEQ).alias("pos"), "x")


def _attention(spark, sf_dir, heads: int, kv: int, dim: int) -> DataFrame:
    """Causal attention by a range join inside each sequence; queries, keys and values are parts of the vector."""
    s = _sequences(spark, sf_dir)
    h = s.select("seq", "pos", F.posexplode(F.array(*[F.slice("x", 1 + dim * i, dim) for i in range(heads)])).alias("head", "q"))
    h = h.withColumn("kv_head", F.floor(F.col("head") * kv / heads).cast("int"))
    k = s.select("seq", F.col("pos").alias("p"), F.posexplode(F.array(*[F.slice("x", 1 + dim * i, dim) for i in range(kv)])).alias("kv_head", "k"))
    pairs = h.join(k, ["seq", "kv_head"]).filter("p <= pos").select("seq", "pos", "head", "p", (V.dot("q", "k") / math.sqrt(dim)).alias("s"), "k")
    rows = pairs.groupBy("seq", "pos", "head").agg(F.array_sort(F.collect_list(F.struct("p", "s", "k"))).alias("r"))
    w = V.softmax(F.transform("r", lambda x: x["s"]))
    out = rows.select("seq", "pos", "head", w.alias("w"), F.transform("r", lambda x: x["k"]).alias("k"))
    mixed = F.aggregate(F.zip_with("w", "k", lambda a, b: F.transform(b, lambda t: t * a)), F.array_repeat(F.lit(0.0), dim), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return out.select("seq", "pos", "head", mixed.alias("o")).select("seq", "pos", "head", *_digest(F.col("o")))


def causal_attention(spark, sf_dir):
    return _attention(spark, sf_dir, 1, 1, 64).drop("head")


def gqa_attention(spark, sf_dir):
    return _attention(spark, sf_dir, 4, 2, 16)


def last_position(spark, sf_dir):
    """Only the last position of a sequence goes on to the head."""
    last = _sequences(spark, sf_dir).groupBy("seq").agg(F.max_by("x", "pos").alias("x"), F.max("pos").alias("pos"))
    return last.select("seq", "pos", V.rounded(V.total(F.col("x"))).alias("v_sum"))


_X = "SELECT vec_id, label, embedding::DOUBLE[] x FROM embeddings"
_LOGITS = lambda n: f"SELECT vec_id, label, list_transform(h, lambda w: list_dot_product(x, w)) l FROM ({_X}), (SELECT list(embedding::DOUBLE[] ORDER BY vec_id) h FROM embeddings WHERE vec_id < {n})"
_SCORED = f"SELECT vec_id, label, y, n, exp(y - greatest(y, n)) / (exp(y - greatest(y, n)) + exp(n - greatest(y, n))) s FROM (SELECT vec_id, label, list_max(l[1:4]) y, list_max(l[5:8]) n FROM ({_LOGITS(8)}))"
_NEXT = lambda k=1: "SELECT a.vec_id, a.x, " + ", ".join(f"n{i}.x {'yzuw'[i - 1]}" for i in range(1, k + 1)) + f" FROM ({_X}) a " + " ".join(f"JOIN ({_X}) n{i} ON n{i}.vec_id = a.vec_id + {i}" for i in range(1, k + 1))
_SOFTMAX = lambda m: f"CASE WHEN isinf(list_max({m})) THEN list_transform({m}, lambda a: 1.0::DOUBLE / len({m})) ELSE list_transform({m}, lambda a: exp(a - list_max({m})) / list_sum(list_transform({m}, lambda c: exp(c - list_max({m}))))) END"
_L2 = lambda a, e: f"sqrt(list_sum(list_transform(range(64), lambda i: pow({a}[i + 1] - {e}[i + 1], 2)))) / sqrt(list_dot_product({e}, {e}))"
_TOP = f"SELECT vec_id, t, lg, row_number() OVER (PARTITION BY vec_id ORDER BY round(lg, 6) DESC, t) - 1 r FROM (SELECT vec_id, unnest(range(32))::INTEGER t, unnest(l) lg FROM ({_LOGITS(32)}))"
_ATT = lambda heads, kv, dim: f"""WITH s AS (SELECT vec_id // {SEQ} seq, vec_id % {SEQ} pos, x FROM ({_X})),
q AS (SELECT seq, pos, head, x[head * {dim} + 1 : head * {dim} + {dim}] q FROM s, (SELECT unnest(range({heads}))::INTEGER head)),
k AS (SELECT seq, pos p, g, x[g * {dim} + 1 : g * {dim} + {dim}] k FROM s, (SELECT unnest(range({kv})) g)),
w AS (SELECT q.seq, q.pos, q.head, p, k, list_dot_product(q, k) / sqrt({dim}) s FROM q JOIN k ON q.seq = k.seq AND k.g = q.head * {kv} // {heads} AND p <= q.pos),
z AS (SELECT *, exp(s - max(s) OVER h) / sum(exp(s - m)) OVER h a FROM (SELECT *, max(s) OVER (PARTITION BY seq, pos, head) m FROM w) WINDOW h AS (PARTITION BY seq, pos, head)),
e AS (SELECT seq, pos, head, i, sum(a * k[i] ORDER BY p) v FROM z, (SELECT unnest(range(1, {dim} + 1)) i) GROUP BY ALL),
o AS (SELECT seq, pos, head, list(v ORDER BY i) o FROM e GROUP BY ALL)
SELECT seq, pos, {"head, " if heads > 1 else ""}{_digest_sql("o")} FROM o"""  # noqa: E731
_TURN = "CASE WHEN j % 32 >= 24 THEN x[j + 1] WHEN j % 2 = 0 THEN x[j + 1] * cos(vec_id * pow(10000.0, -2.0 * ((j % 32) // 2) / 24)) - x[j + 2] * sin(vec_id * pow(10000.0, -2.0 * ((j % 32) // 2) / 24)) ELSE x[j] * sin(vec_id * pow(10000.0, -2.0 * ((j % 32) // 2) / 24)) + x[j + 1] * cos(vec_id * pow(10000.0, -2.0 * ((j % 32) // 2) / 24)) END"
QUERIES = {f.__name__: f for f in (verdict_from_hidden, verdict_threshold_sweep, verdict_by_label, verdict_vs_label, verdict_logits_full, top_verdict_token, top20_logits, top20_overlap, verdict_string, verdict_json, dot, dot4, checksum, rms_norm, softmax, softmax_masked, swiglu, sigmoid, add_scaled, argmax, relative_l2, worst_relative_error, parity_report, matmul, matmul_rows, gather_rows, id_range_check, rope_rotate, attn_temperature, causal_attention, gqa_attention, last_position)}
ORACLE_SQL = {
    "verdict_from_hidden": f"SELECT vec_id, round(s, 4) + 0.0 score, round(y, 4) + 0.0 yes_logit, round(n, 4) + 0.0 no_logit, round(s, 4) > 0.5 is_unsafe FROM ({_SCORED})",
    "verdict_threshold_sweep": f"SELECT round(t, 1) threshold, count(*) n, sum((round(s, 4) > t)::INTEGER)::BIGINT unsafe FROM ({_SCORED}), (SELECT unnest([{', '.join(map(repr, THRESHOLDS))}]::DOUBLE[]) t) GROUP BY 1",
    "verdict_by_label": f"SELECT label, count(*) n, sum((round(s, 4) > 0.5)::INTEGER)::BIGINT unsafe, round(avg(s), 4) + 0.0 mean_score FROM ({_SCORED}) GROUP BY 1",
    "verdict_vs_label": f"SELECT toxic, round(s, 4) > 0.5 unsafe, count(*) n FROM ({_SCORED}) JOIN labels ON doc_id = vec_id GROUP BY ALL",
    "verdict_logits_full": f"SELECT vec_id, unnest(range(32))::INTEGER token, unnest(list_transform(l, lambda x: round(x, 4) + 0.0)) logit FROM ({_LOGITS(32)})",
    "top_verdict_token": f"SELECT vec_id, list_position(l, list_max(l))::BIGINT - 1 token FROM ({_LOGITS(32)})",
    "top20_logits": f"SELECT vec_id, r::INTEGER rank, t token, round(lg, 4) + 0.0 logit FROM ({_TOP}) WHERE r < 20",
    "top20_overlap": f"WITH t AS (SELECT vec_id, list(t) s FROM ({_TOP}) WHERE r < 20 GROUP BY 1) SELECT a.vec_id, len(list_intersect(a.s, b.s)) shared FROM t a JOIN t b ON b.vec_id = a.vec_id + 1",
    "verdict_string": f"SELECT vec_id, CASE WHEN round(s, 4) > 0.5 THEN 'UNSAFE' ELSE 'safe' END || printf(' score=%.6f (yes=%.4f no=%.4f)', round(s, 4) + 0.0, round(y, 4) + 0.0, round(n, 4) + 0.0) verdict FROM ({_SCORED})",
    "verdict_json": f"""SELECT v.vec_id, printf('{{"score":%.4f,"unsafe_verdict":%s,"yes_logit":%.4f,"no_logit":%.4f,"prompt_tokens":%d,"prefilled_tokens":0,"load_ms":0,"inference_ms":0}}', round(s, 4) + 0.0, (round(s, 4) > 0.5)::VARCHAR, round(y, 4) + 0.0, round(n, 4) + 0.0, coalesce(length(d.text), 0)) verdict FROM ({_SCORED}) v LEFT JOIN documents d ON d.doc_id = v.vec_id""",
    "dot": f"SELECT vec_id, round(list_dot_product(x, y), 4) + 0.0 dot FROM ({_NEXT()})",
    "dot4": f"SELECT vec_id, {', '.join(f'round(list_dot_product(x, {c}), 4) + 0.0 dot{i}' for i, c in enumerate('yzuw'))} FROM ({_NEXT(4)})",
    "checksum": f"SELECT vec_id, round(list_dot_product(x, x), 4) + 0.0 squares FROM ({_X})",
    "rms_norm": f"SELECT vec_id, {_digest_sql('r')} FROM (SELECT vec_id, list_transform(range(64), lambda i: x[i + 1] / sqrt(list_dot_product(x, x) / 64 + 1e-5) * y[i + 1]) r FROM ({_NEXT()}))",
    "softmax": f"SELECT vec_id, {_digest_sql('s')} FROM (SELECT vec_id, {_SOFTMAX('m')} s FROM (SELECT vec_id, list_transform(x, lambda a: a * 20) m FROM ({_X})))",
    "softmax_masked": f"SELECT vec_id, {_digest_sql('s')} FROM (SELECT vec_id, {_SOFTMAX('m')} s FROM (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN vec_id % 9 = 0 OR i % 4 = 0 THEN '-inf'::DOUBLE ELSE x[i + 1] * 20 END) m FROM ({_X})))",
    "swiglu": f"SELECT vec_id, {_digest_sql('s')} FROM (SELECT vec_id, list_transform(range(64), lambda i: x[i + 1] / (1 + exp(-x[i + 1])) * y[i + 1]) s FROM ({_NEXT()}))",
    "sigmoid": f"SELECT vec_id, {_digest_sql('s')} FROM (SELECT vec_id, list_transform(x, lambda a: 1 / (1 + exp(-a))) s FROM ({_X}))",
    "add_scaled": f"SELECT vec_id, {_digest_sql('s')} FROM (SELECT vec_id, list_transform(range(64), lambda i: x[i + 1] + 0.5::DOUBLE * y[i + 1]) s FROM ({_NEXT()}))",
    "argmax": f"SELECT vec_id, list_position(x, list_max(x))::BIGINT - 1 place FROM ({_X})",
    "relative_l2": f"SELECT vec_id, round({_L2('x', 'y')}, 4) + 0.0 relative_l2 FROM ({_NEXT()})",
    "worst_relative_error": f"SELECT vec_id, round(list_max(list_transform(range(64), lambda i: abs(x[i + 1] - y[i + 1]) / greatest(1, abs(y[i + 1])))), 4) + 0.0 worst FROM ({_NEXT()})",
    "parity_report": f"SELECT e.vec_id, round({_L2('a.x', 'e.x')}, 4) + 0.0 relative_l2 FROM ({_X}) e LEFT JOIN (SELECT vec_id, list_transform(x, lambda t: t * 1.01::DOUBLE) x FROM ({_X}) WHERE vec_id IN (SELECT doc_id FROM labels)) a ON a.vec_id = e.vec_id",
    "matmul": f"SELECT a.vec_id token, b.vec_id::INTEGER row_id, round(list_dot_product(a.x, b.x), 4) + 0.0 y FROM ({_X}) a, ({_X}) b WHERE b.vec_id < 16",
    "matmul_rows": f"SELECT a.vec_id token, pos::INTEGER pos, round(list_dot_product(a.x, b.x), 4) + 0.0 y FROM ({_X}) a, ({_X}) b, (SELECT unnest(range({len(ROW_IDS)})) pos, unnest({ROW_IDS}) id) WHERE b.vec_id = id",
    "gather_rows": f"SELECT t.vec_id pos, w.vec_id token, round(list_sum(w.x), 4) + 0.0 row_sum FROM ({_X}) t JOIN ({_X}) w ON w.vec_id = t.vec_id * 7 % (SELECT max(vec_id) + 1 FROM embeddings)",
    "id_range_check": "SELECT vec_id * 3 id FROM embeddings WHERE vec_id * 3 NOT IN (SELECT vec_id FROM embeddings)",
    "rope_rotate": f"SELECT vec_id, {_digest_sql('r')} FROM (SELECT vec_id, list_transform(range(64), lambda j: {_TURN}) r FROM ({_X}))",
    "attn_temperature": "SELECT vec_id, round(1 + 0.1::DOUBLE * ln(1 + floor(vec_id / 64.0::DOUBLE)), 4) + 0.0 scale FROM embeddings",
    "causal_attention": _ATT(1, 1, 64),
    "gqa_attention": _ATT(4, 2, 16),
    "last_position": f"SELECT vec_id // {SEQ} seq, max(vec_id % {SEQ}) pos, round(list_sum(arg_max(x, vec_id)), 4) + 0.0 v_sum FROM ({_X}) GROUP BY 1",
}
