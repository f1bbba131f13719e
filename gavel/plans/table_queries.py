"""Queries of types, names, metadata, sizes, verdict forms and positions, each over rows of the given tables; with their SQL.

A document stands for a tensor: its id names it and its type, its text's length is its width. Dimensions of fixed values (types, names) are broadcast.
"""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from gavel.functions import tensors as V
from gavel.functions import text as T
from gavel.functions.geometry import INTEGER, OFFSET, TYPES, ZERO_POINT
from gavel.functions.quant import DECODERS
from gavel.operators.convert import LAYER, TOP, file_names, output_types
from gavel.operators.tables import new_folder
from gavel.operators.tokenizer import raw_hex
from gavel.plans.tensor_queries import _X, _v
from gavel.plans.text_queries import _EXPLODED, _NORMAL, _q, _table
from gavel.plans.token_queries import _RANKED, SPECIAL, vocabulary_of_corpus
from gavel.sources import register
from gavel.sources.documents import model_files
from gavel.sources.gguf import header_bytes, local_path, write_tensors

_TYPES, _LAYERS, _TOPS = list(TYPES), list(LAYER), list(TOP)
#: The words that stand for yes and no among the corpus's pieces.
YES, NO = "the", "la"
_pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
_pick_sql = lambda names, i: f"([{', '.join(map(_q, names))}])[1 + {i}]"


def _tensors(spark, sf_dir):
    """(doc_id, name, type, r, c): every 33rd type, and every 13th name, is unknown."""
    d, i = _table(spark, sf_dir, "documents"), lambda n: (F.col("doc_id") % n).cast("int")
    kind = i(13)
    layer = F.concat(F.lit("layers."), i(26).cast("string"), F.lit("."), _pick(_LAYERS, kind), F.lit(".weight"))
    name = F.when(kind < 9, layer).when(kind < 12, F.concat(_pick(_TOPS, kind - 9), F.lit(".weight"))).otherwise("layers.1.strange.weight")
    width = F.coalesce(F.char_length("text"), F.lit(0)).cast("long") * F.when(F.col("doc_id") % 2 == 0, 32).otherwise(1)
    return d.select("doc_id", name.alias("name"), F.coalesce(_pick(_TYPES, i(33)), F.lit("Q9_0")).alias("type"), (1 + F.col("doc_id") % 5).alias("r"), width.alias("c"))


_TENSORS = f"""(SELECT doc_id, CASE WHEN doc_id % 13 < 9 THEN 'layers.' || (doc_id % 26) || '.' || {_pick_sql(_LAYERS, 'doc_id % 13')} || '.weight' WHEN doc_id % 13 < 12 THEN {_pick_sql(_TOPS, 'doc_id % 13 - 9')} || '.weight' ELSE 'layers.1.strange.weight' END AS name,
coalesce({_pick_sql(_TYPES, 'doc_id % 33')}, 'Q9_0') AS type, 1 + doc_id % 5 AS r, coalesce(length(text), 0) * CASE WHEN doc_id % 2 = 0 THEN 32 ELSE 1 END AS c FROM documents)"""
_GEOMETRY = "(VALUES " + ", ".join(f"('{k}', {c}, {e}, {b})" for k, (c, e, b) in TYPES.items()) + ") g(type, code, elements, bytes)"


def _geometry(spark):
    return F.broadcast(spark.createDataFrame([(k, *v) for k, v in TYPES.items()], "type string, code int, elements int, bytes int"))


def _row_bytes():
    return F.when(F.col("c") % F.col("elements") == 0, (F.col("c") / F.col("elements")).cast("long") * F.col("bytes"))


def type_geometry(spark, sf_dir):
    """Bits a value of each type, and how many documents' widths are whole blocks of it."""
    both = _tensors(spark, sf_dir).drop("type").crossJoin(_geometry(spark))
    return both.groupBy("type", "code", "elements", "bytes").agg(F.sum((F.col("c") % F.col("elements") == 0).cast("long")).alias("whole")).withColumn("bits", F.round(F.col("bytes") * 8 / F.col("elements"), 4))


def row_bytes(spark, sf_dir):
    """Bytes of each document's row; -1 where its width is no whole number of blocks."""
    return _tensors(spark, sf_dir).join(_geometry(spark), "type").select("doc_id", "type", F.coalesce(_row_bytes(), F.lit(-1)).alias("row_bytes"))


def integer_path_flags(spark, sf_dir):
    zero = F.create_map(*[F.lit(x) for kv in ZERO_POINT.items() for x in kv])
    return _tensors(spark, sf_dir).select("doc_id", F.col("type").isin(*INTEGER).alias("integer_dot"), F.col("type").isin(*OFFSET).alias("has_offset"), F.coalesce(zero[F.col("type")], F.lit(-1)).alias("zero_point"))


def decodable_types(spark, sf_dir):
    """How many documents' types have a decoder."""
    return _tensors(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.max(F.col("type").isin(*DECODERS)).alias("decodable"))


def types_without_fixture(spark, sf_dir):
    """Types and rows of documents that no labelled document has."""
    t = _tensors(spark, sf_dir).select("doc_id", "type", "r")
    labelled = _table(spark, sf_dir, "labels").select("doc_id")
    return t.select("type", "r").distinct().exceptAll(t.join(labelled, "doc_id", "left_semi").select("type", "r").distinct())


def type_parse(spark, sf_dir):
    """Types by name, whatever its case; an unknown one has code -1."""
    way = F.col("doc_id") % 3
    named = _tensors(spark, sf_dir).select("doc_id", F.when(way == 0, F.lower("type")).when(way == 1, F.initcap("type")).otherwise(F.col("type")).alias("name"))
    known = _geometry(spark).select("type", "code")
    return named.join(known, F.upper("name") == known["type"], "left").select("doc_id", "type", F.coalesce("code", F.lit(-1)).alias("code"))


def output_type_choice(spark, sf_dir):
    """What each tensor is written as when its type is asked for."""
    t = _tensors(spark, sf_dir).join(_geometry(spark), "type")
    return t.select("doc_id", output_types(F.col("name"), F.col("r"), F.col("c"), F.col("type"), F.col("elements")).alias("written"))


def element_counts(spark, sf_dir):
    shape = F.array("c", "r")
    product = lambda x: F.aggregate(x, F.lit(1).cast("long"), lambda a, b: a * b)
    return _tensors(spark, sf_dir).select("doc_id", product(shape).alias("n_elements"), product(F.slice(shape, 2, 9)).alias("n_rows"))


def inspect_types(spark, sf_dir):
    """Tensors and bytes of each type, most bytes first; rows that are no whole blocks count nothing."""
    t = _tensors(spark, sf_dir).join(_geometry(spark), "type")
    return t.groupBy("type").agg(F.count("*").alias("tensors"), F.sum(F.coalesce(_row_bytes(), F.lit(0)) * F.col("r")).alias("bytes")).orderBy(F.desc("bytes"), "type")


def _metadata(spark, sf_dir):
    """(key, value_type, value): what a file on the corpus would say of each language."""
    by_lang = _table(spark, sf_dir, "documents").filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.min("source").alias("s"))
    rows = F.array(
        F.struct(F.concat(F.lit("corpus."), "lang", F.lit(".documents")).alias("key"), F.lit("uint32").alias("value_type"), F.col("n").cast("string").alias("value")),
        F.struct(F.concat(F.lit("corpus."), "lang", F.lit(".source")).alias("key"), F.lit("string").alias("value_type"), F.col("s").alias("value")),
    )
    return by_lang.select(F.inline(rows))


def inspect_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir).orderBy("key")


def typed_getters(spark, sf_dir):
    """Values by key, or their defaults: a number, a string, a string asked of a number (its default), and a key that is not there."""
    langs = _table(spark, sf_dir, "documents").filter("lang is not null").select("lang").distinct()
    m = _metadata(spark, sf_dir)
    keys = langs.select("lang", F.explode(F.array(*map(F.lit, ("documents", "source", "merges")))).alias("name")).withColumn("key", F.concat(F.lit("corpus."), "lang", F.lit("."), "name"))
    own = lambda name, kind: F.max(F.when((F.col("name") == name) & (F.col("value_type") == kind), F.col("value")))
    return keys.join(m, "key", "left").groupBy("lang").agg(
        F.coalesce(own("documents", "uint32").cast("long"), F.lit(0)).alias("documents"), F.coalesce(own("source", "string"), F.lit("none")).alias("source"),
        F.coalesce(own("documents", "string"), F.lit("none")).alias("wrong"), F.coalesce(own("merges", "uint32").cast("long"), F.lit(7)).alias("missing"),
    )


def tensor_name_map(spark, sf_dir):
    """File names of checkpoint tensors; one that the conversion refuses is null."""
    return _tensors(spark, sf_dir).select("doc_id", file_names(F.col("name")).alias("file_name"))


def marker_order(spark, sf_dir):
    """The prompt's markers, and a user-defined one for each source of documents, longest first."""
    own = _table(spark, sf_dir, "documents").filter("source is not null").select(F.concat(F.lit("["), F.upper("source"), F.lit("]")).alias("marker"))
    m = own.union(spark.createDataFrame([(x,) for x in T.MARKERS], "marker string")).distinct()
    return m.select("marker", F.char_length("marker").cast("long").alias("n")).orderBy(F.desc("n"), "marker")


def human_sizes(spark, sf_dir):
    n = F.octet_length("text").cast("long") * 10007 * (1 + F.col("doc_id") % 1000)
    return _table(spark, sf_dir, "documents").select("doc_id", T.human_bytes(n).alias("shown"))


def bench_label(spark, sf_dir):
    name = F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.substring_index(name, "-", -1).alias("label"))


def normalize_piece(spark, sf_dir):
    """The verdict form of every distinct piece of the documents."""
    pieces = _table(spark, sf_dir, "documents").select(F.explode(T.pre_tokens("text")).alias("piece")).distinct()
    return pieces.select("piece", T.normal_piece("piece").alias("normal"))


def verdict_token_ids(spark, sf_dir):
    """Ids of the corpus's vocabulary whose piece says yes or no, here by the words YES and NO."""
    v = vocabulary_of_corpus(spark, sf_dir).filter("type = 1").select("token_id", T.normal_piece(F.unhex(raw_hex("piece")).cast("string")).alias("verdict"))
    return v.filter(F.col("verdict").isin(YES, NO))


def verdict_union(spark, sf_dir):
    """The ids of yes, then those of no."""
    ids = verdict_token_ids(spark, sf_dir)
    side = lambda v, k: ids.filter(F.col("verdict") == v).select(F.lit(k).alias("side"), "token_id")
    return side(YES, 0).unionAll(side(NO, 1))


def eos_union(spark, sf_dir):
    """Ids that end a sequence, each once and the first one first: the lengths of a conversation's turns modulo 7."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.octet_length("text") % 7).alias("id")))).alias("l"))
    ids = F.transform("l", lambda x: x["id"])
    return turns.select("conv_id", F.posexplode(F.array_union(F.slice(ids, 1, 1), ids)).alias("pos", "token"))


def sign_expand(spark, sf_dir):
    """The byte of eight signs that seven stored bits stand for, and the sum of a vector's first eight values with these signs."""
    i = (F.col("vec_id") % 128).cast("int")
    v = _v(spark, sf_dir).select("vec_id", i.bitwiseOR(F.shiftleft(F.bit_count(i) % 2, 7)).alias("signs"), F.slice("x", 1, 8).alias("x"))
    turned = F.transform("x", lambda a, t: a * (1 - 2 * F.getbit(F.col("signs"), t)))
    return v.select("vec_id", "signs", V.rounded(V.total(turned)).alias("v_sum"))


DIM, CONTEXT = 32, 16384
_BASE = lambda: F.lit(10000.0) * (1 + F.col("label"))
_FACTOR = lambda: 1.0 + F.col("vec_id") % 5


def rope_freqs(spark, sf_dir):
    """The angle of each pair, by a base that a vector's label gives."""
    f = V.frequencies(_BASE(), _FACTOR(), DIM)
    return _v(spark, sf_dir).select("vec_id", F.posexplode(f).alias("pair", "f")).select("vec_id", "pair", F.round("f", 8).alias("frequency"))


def yarn_freqs(spark, sf_dir):
    """The same, stretched along a ramp of pairs; a factor of 1 stretches nothing."""
    f = V.stretched(_BASE(), _FACTOR(), DIM, CONTEXT)
    return _v(spark, sf_dir).select("vec_id", F.posexplode(f).alias("pair", "f")).select("vec_id", "pair", F.round("f", 8).alias("frequency"))


def yarn_magnitude(spark, sf_dir):
    m, own = (F.col("vec_id") % 3) / 2, (F.col("label") % 2) * 0.7
    return _v(spark, sf_dir).select("vec_id", F.round(V.magnitude_of(_FACTOR(), m, own), 6).alias("magnitude"))


def _by_label(spark, sf_dir):
    """Vectors as a tensor for each label."""
    v = _v(spark, sf_dir).filter("label is not null")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return v.select(F.format_string("blk.%d.attn_q.weight", F.col("label")).alias("tensor"), place.cast("long").alias("row_id"), F.col("x").alias("values"))


def _written(spark, sf_dir) -> str:
    register(spark)
    path = f"{new_folder(spark)}.gguf"
    counts = _table(spark, sf_dir, "embeddings").filter("label is not null").agg(F.count("*"), F.countDistinct("label")).first()
    metadata = {"general.architecture": ("string", "mistral3"), "mistral3.block_count": ("uint32", counts[1]), "mistral3.vocab_size": ("uint64", counts[0]), "mistral3.sizes": ("array[int32]", [counts[1], counts[0]])}
    write_tensors(_by_label(spark, sf_dir), path, "Q8_0", metadata)
    return path


def gguf_tensors(spark, sf_dir):
    """The tensor table of a file that holds the vectors by label."""
    return spark.read.format("gguf").option("path", _written(spark, sf_dir)).option("view", "tensors").load().withColumn("shape", F.array_join(F.col("shape").cast("array<string>"), "x"))


def gguf_metadata(spark, sf_dir):
    """Its metadata."""
    return spark.read.format("gguf").option("path", _written(spark, sf_dir)).option("view", "metadata").load()


MODELS = ("F16", "Q8_0", "Q5_1", "MXFP4")


def models_by_size(spark, sf_dir):
    """Files of a folder that hold the vectors in some types, the smallest first; a projector among them is left out. Bytes are those of the rows."""
    folder = new_folder(spark)
    rows = _v(spark, sf_dir).select(F.lit("token_embd.weight").alias("tensor"), F.col("vec_id").alias("row_id"), F.col("x").alias("values"))
    os.makedirs(local_path(folder))
    for kind in (*MODELS, "mmproj-F16"):
        write_tensors(rows, f"{folder}/vectors-{kind}.gguf", kind.removeprefix("mmproj-"))
    files = model_files(spark, folder)
    place = F.row_number().over(Window.orderBy("bytes", "name"))  # a folder's few files
    return files.select("name", place.alias("place"), (F.col("bytes") - HEADER).alias("row_bytes"))


#: Bytes of the header of a file with that one tensor.
HEADER = len(header_bytes({}, [("token_embd.weight", (64, 1), "F16", 0)]))
_KNOWN = f"{_TENSORS} t JOIN {_GEOMETRY} USING (type)"
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (LAYER | TOP).items())
_SIZE = "(octet_length(encode(text)) * 10007 * (1 + doc_id % 1000))"
_IDS = f"(SELECT (256 + {len(SPECIAL)} + row_number() OVER (ORDER BY n DESC, piece) - 1)::INTEGER AS token_id, {_NORMAL} AS verdict FROM k)"
_WORD = f"WITH {_RANKED.split('z AS (')[0].rstrip().rstrip(',')} SELECT COLUMNS FROM {_IDS} WHERE verdict IN ('{YES}', '{NO}')"
_POWER = f"pow(10000.0::DOUBLE * (1 + label), -2.0 * i / {DIM})"
_TURNS = lambda beta: f"({DIM} * ln({CONTEXT} / ({beta}::DOUBLE * 2 * pi())) / (2 * ln(10000.0::DOUBLE * (1 + label))))"
_RAMP = f"least(1, greatest(0, (i - greatest(0, floor({_TURNS(32.0)}))) / greatest(0.001, least({DIM / 2 - 1}, ceil({_TURNS(1.0)})) - greatest(0, floor({_TURNS(32.0)})))))"
_PAIRS = f"embeddings, (SELECT unnest(range({DIM // 2}))::INTEGER AS i)"
_MS = lambda m: f"(CASE WHEN f <= 1 THEN 1 ELSE 0.1 * {m} * ln(f) + 1 END)"

QUERIES = {f.__name__: f for f in (type_geometry, row_bytes, integer_path_flags, decodable_types, types_without_fixture, type_parse, output_type_choice, element_counts, inspect_types, inspect_metadata, typed_getters, tensor_name_map, marker_order, human_sizes, bench_label, normalize_piece, verdict_token_ids, verdict_union, eos_union, sign_expand, rope_freqs, yarn_freqs, yarn_magnitude, gguf_tensors, gguf_metadata, models_by_size)}
ORACLE_SQL = {
    "type_geometry": f"SELECT g.type, code, elements, bytes, sum((c % elements = 0)::INT)::BIGINT AS whole, round(bytes * 8 / elements::DOUBLE, 4) AS bits FROM {_TENSORS} t, {_GEOMETRY} GROUP BY ALL",
    "row_bytes": f"SELECT doc_id, type, (CASE WHEN c % elements = 0 THEN c // elements * bytes ELSE -1 END)::BIGINT AS row_bytes FROM {_KNOWN}",
    "integer_path_flags": f"SELECT doc_id, type IN ('Q8_0', 'Q4_0', 'Q4_1', 'Q5_0', 'Q5_1') AS integer_dot, type IN ('Q4_1', 'Q5_1') AS has_offset, CASE type WHEN 'Q4_0' THEN 8 WHEN 'Q5_0' THEN 16 WHEN 'Q8_0' THEN 128 WHEN 'Q4_1' THEN 0 WHEN 'Q5_1' THEN 0 ELSE -1 END AS zero_point FROM {_TENSORS}",
    "decodable_types": f"SELECT t.type, count(*) AS n, bool_or(g.type IS NOT NULL) AS decodable FROM {_TENSORS} t LEFT JOIN {_GEOMETRY} ON g.type = t.type GROUP BY 1",
    "types_without_fixture": f"SELECT DISTINCT type, r FROM {_TENSORS} EXCEPT SELECT type, r FROM {_TENSORS} WHERE doc_id IN (SELECT doc_id FROM labels)",
    "type_parse": f"SELECT doc_id, g.type, coalesce(code, -1) AS code FROM {_TENSORS} t LEFT JOIN {_GEOMETRY} ON g.type = t.type",
    "output_type_choice": f"SELECT doc_id, CASE WHEN elements = 1 THEN type WHEN name LIKE '%norm.weight' OR r = 1 THEN 'F32' WHEN c % elements <> 0 THEN 'F16' ELSE type END AS written FROM {_KNOWN}",
    "element_counts": f"SELECT doc_id, c * r AS n_elements, r AS n_rows FROM {_TENSORS}",
    "inspect_types": f"SELECT type, count(*) AS tensors, sum(CASE WHEN c % elements = 0 THEN c // elements * bytes * r ELSE 0 END)::BIGINT AS bytes FROM {_KNOWN} GROUP BY 1 ORDER BY bytes DESC, type",
    "inspect_metadata": "SELECT 'corpus.' || lang || '.documents' AS key, 'uint32' AS value_type, count(*)::VARCHAR AS value FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'corpus.' || lang || '.source', 'string', min(source) FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "typed_getters": "SELECT lang, count(*) AS documents, coalesce(min(source), 'none') AS source, 'none' AS wrong, 7::BIGINT AS missing FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "tensor_name_map": f"SELECT doc_id, CASE WHEN name LIKE 'layers.%' THEN 'blk.' || regexp_extract(name, '^layers\\.(\\d+)\\.', 1) || '.' ELSE '' END || CASE regexp_replace(regexp_replace(name, '^layers\\.\\d+\\.', ''), '\\.weight$', '') {_CASES} END || '.weight' AS file_name FROM {_TENSORS}",
    "marker_order": f"SELECT marker, length(marker) AS n FROM (SELECT '[' || upper(source) || ']' AS marker FROM documents WHERE source IS NOT NULL UNION SELECT unnest([{', '.join(map(_q, T.MARKERS))}])) ORDER BY n DESC, marker",
    "human_sizes": f"SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', n / 1073741824.0::DOUBLE) END AS shown FROM (SELECT doc_id, {_SIZE} AS n FROM documents)",
    "bench_label": "SELECT doc_id, doc_id::VARCHAR AS label FROM documents",
    "normalize_piece": f"SELECT piece, {_NORMAL} AS normal FROM (SELECT DISTINCT piece FROM ({_EXPLODED}))",
    "verdict_token_ids": _WORD.replace("COLUMNS", "token_id, verdict"),
    "verdict_union": _WORD.replace("COLUMNS", f"CASE verdict WHEN '{YES}' THEN 0 ELSE 1 END AS side, token_id"),
    "eos_union": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY t) - 1)::INTEGER AS pos, token FROM (SELECT conv_id, (octet_length(encode(text)) % 7)::INTEGER AS token, min(turn) AS t FROM conversations GROUP BY ALL)",
    "sign_expand": f"SELECT vec_id, s AS signs, round(list_sum(list_transform(range(8), lambda t: x[t + 1] * (1 - 2 * ((s >> t::INTEGER) & 1)))), 4) + 0.0 AS v_sum FROM (SELECT vec_id, x, (vec_id % 128 + 128 * (bit_count((vec_id % 128)::INTEGER) % 2))::INTEGER AS s FROM ({_X}))",
    "rope_freqs": f"SELECT vec_id, i AS pair, round({_POWER} / (1 + vec_id % 5), 8) AS frequency FROM {_PAIRS}",
    "yarn_freqs": f"SELECT vec_id, i AS pair, round(CASE WHEN vec_id % 5 = 0 THEN p ELSE p / f * m + p * (1 - m) END, 8) AS frequency FROM (SELECT vec_id, i, {_POWER} AS p, 1.0 + vec_id % 5 AS f, {_RAMP} AS m FROM {_PAIRS})",
    "yarn_magnitude": f"SELECT vec_id, round(CASE WHEN a <> 0 THEN {_MS('CASE WHEN m = 0 THEN 1 ELSE m END')} / {_MS('a')} ELSE {_MS('1.0')} END, 6)::DOUBLE AS magnitude FROM (SELECT vec_id, (1 + vec_id % 5)::DOUBLE AS f, (vec_id % 3) / 2::DOUBLE AS m, (label % 2) * 0.7::DOUBLE AS a FROM embeddings)",
    "gguf_tensors": "WITH t AS (SELECT 'blk.' || label || '.attn_q.weight' AS name, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label) SELECT name, '64x' || n AS shape, 'Q8_0' AS type, (coalesce(sum((n * 68 + 31) // 32 * 32) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS data_offset, n * 64 AS n_elements, n AS n_rows, n * 68 AS n_bytes FROM t",
    "models_by_size": "SELECT name, row_number() OVER (ORDER BY row_bytes, name)::INTEGER AS place, row_bytes FROM (SELECT 'vectors-' || type || '.gguf' AS name, ((SELECT count(*) FROM embeddings) * size + 31) // 32 * 32 AS row_bytes FROM (VALUES ('F16', 128), ('Q8_0', 68), ('Q5_1', 48), ('MXFP4', 34)) t(type, size))",
    "gguf_metadata": "WITH t AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings WHERE label IS NOT NULL) SELECT 'general.architecture' AS key, 'string' AS value_type, 'mistral3' AS value, 1::BIGINT AS items UNION ALL SELECT 'mistral3.block_count', 'uint32', k::VARCHAR, 1 FROM t UNION ALL SELECT 'mistral3.vocab_size', 'uint64', n::VARCHAR, 1 FROM t UNION ALL SELECT 'mistral3.sizes', 'array[int32]', '[' || k || ', ' || n || ']', 2 FROM t",
}
