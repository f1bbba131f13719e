"""Queries of prompts, templates, markers and pre-tokens, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions import text as T
from gavel.functions.bpe import ALPHABET, byte_decoded, byte_encoded, tiny_vocabulary
from gavel.operators.tokenizer import encode_in_sets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


POLICIES = [(1, "Hate", "Does this attack a group?"), (2, "Spam", "Is this an advert?"), (3, T.DEFAULT_INSTRUCT, T.DEFAULT_QUERY)]
_MESSAGE = r"'<Instruct>: ' || {i} || chr(10) || chr(10) || '<Query>: ' || {q} || chr(10) || chr(10) || '<Document>: ' || text"
_DEFAULT = _MESSAGE.format(i=_q(T.DEFAULT_INSTRUCT), q=_q(T.DEFAULT_QUERY))
_OPEN = _q(T.SYSTEM_OPEN + T.SYSTEM_PROMPT + T.SYSTEM_CLOSE + T.USER_OPEN)


def format_user_message(spark, sf_dir):
    m = T.user_message(F.lit(T.DEFAULT_INSTRUCT), F.lit(T.DEFAULT_QUERY), F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(m.cast("binary")).alias("digest"), F.char_length(m).cast("long").alias("n_chars"))


def render_prompt(spark, sf_dir):
    p = T.prompt(F.lit(T.DEFAULT_INSTRUCT), F.lit(T.DEFAULT_QUERY), F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(p.cast("binary")).alias("digest"), F.char_length(p).cast("long").alias("n_chars"))


def policies_x_documents(spark, sf_dir):
    from gavel.operators.moderate import requests

    asked = requests(_table(spark, sf_dir, "documents"), _rows(spark, POLICIES, "policy_id long, instruct string, query string"))
    return asked.select("doc_id", "policy_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


def render_conversation(spark, sf_dir):
    out = T.render_conversations(_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("digest"), F.char_length("prompt").cast("long").alias("n_chars"))


def _odd_turns(spark, sf_dir):
    """Conversations with some turns spoilt: an unknown role, an empty answer."""
    c = _table(spark, sf_dir, "conversations")
    role = F.when(F.col("conv_id") % 5 == 0, F.when(F.col("turn") == 1, "tool").otherwise(F.col("role"))).otherwise(F.col("role"))
    text = F.when((F.col("conv_id") % 7 == 0) & (F.col("role") == "assistant"), "").otherwise(F.col("text"))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def render_errors(spark, sf_dir):
    return T.render_conversations(_odd_turns(spark, sf_dir)).select("conv_id", "error", F.col("prompt").isNotNull().alias("rendered"))


def render_images(spark, sf_dir):
    out = T.render_conversations(_table(spark, sf_dir, "conversations"), images=F.col("turn") % 3)
    return out.select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


_TURN = f"""CASE role WHEN 'system' THEN {_q(T.SYSTEM_OPEN)} || text || {_q(T.SYSTEM_CLOSE)} WHEN 'user' THEN {_q(T.USER_OPEN)} || repeat('[IMG]', {{n}}) || text || {_q(T.USER_CLOSE)} WHEN 'assistant' THEN text || '</s>' END"""


def _conversation_sql(images: str) -> str:
    return f"SELECT conv_id, string_agg({_TURN.format(n=images)}, '' ORDER BY turn) p FROM conversations GROUP BY 1"


# the tables have no markers, so the middle and the end of every seventh text get some
_HALF = "CAST(floor(length(text) / 2) AS INT)"
MARKED = f"CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, {_HALF}) || '[/INST] [INST]x[/SYSTEM_PROMPT]' || substr(text, {_HALF} + 1) || '</s>' ELSE text END"


def _marked(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKED).alias("t"))


def control_marker_split(spark, sf_dir):
    parts = _marked(spark, sf_dir).select("doc_id", F.posexplode(T.split_markers("t")).alias("pos", "part"))
    return parts.select("doc_id", F.col("pos").cast("long").alias("pos"), "part", F.col("part").isin(*T.MARKERS).alias("is_marker"))


def has_control_marker(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", T.has_marker("t").alias("has_marker"))


def pretokenize_pieces(spark, sf_dir):
    p = T.pre_tokens("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(p).cast("long").alias("n_pieces"), F.md5(F.array_join(p, "\x1f").cast("binary")).alias("digest"))


def _pieces(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(T.pre_tokens("text")).alias("piece"))


def piece_histogram(spark, sf_dir):
    return _pieces(spark, sf_dir).groupBy("piece").agg(F.count("*").alias("n"))


def digit_pieces(spark, sf_dir):
    return _pieces(spark, sf_dir).filter(F.col("piece").rlike("^[0-9]$")).groupBy("doc_id").agg(F.count("*").alias("n"))


# (?!\S) has no counterpart in SQL's engine: a cut is put where it would end a run of spaces
_W, _H = r"\t-\r\x{85}\p{Z}", r"\t\x{b}\x{c}\x{85}\p{Z}"
_ALTERNATIVES = T.PRE_TOKEN.replace(r"|\s+(?!\S)", "").replace(r"[^\s\p{L}\p{N}]", rf"[^{_W}\p{{L}}\p{{N}}]").replace(r"\s", f"[{_W}]")
_PIECES = f"flatten(list_transform(string_split(regexp_replace(text, '([{_H}])([{_H}][^{_W}])', '\\1' || chr(57344) || '\\2', 'g'), chr(57344)), lambda s: regexp_extract_all(s, {_q(_ALTERNATIVES)})))"
_EXPLODED = f"SELECT doc_id, unnest({_PIECES}) piece FROM documents"


def byte_encode(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", byte_encoded("text").alias("shown"))


def byte_decode(spark, sf_dir):
    return byte_encode(spark, sf_dir).select("doc_id", byte_decoded("shown").alias("text"))


#: Pieces of the made-up vocabulary: so many of the commonest.
VOCABULARY = 500


def vocab_lookup(spark, sf_dir):
    """Pieces of the benchmark found in a vocabulary of the corpus's commonest pieces, or -1."""
    common = piece_histogram(spark, sf_dir).orderBy(F.desc("n"), "piece").limit(VOCABULARY)
    vocabulary = common.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "piece"))), lambda x: x["piece"]).alias("v")).select(F.posexplode("v").alias("id", "piece"))
    asked = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.pre_tokens("text")).alias("piece"))
    found = asked.join(F.broadcast(vocabulary), "piece", "left").select("item_id", F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("id"))
    return found.groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("id") < 0, 1).otherwise(0)).alias("missing"), F.sum("id").alias("id_sum"))


_NORMAL = r"lower(regexp_replace(regexp_replace(piece, '^\s+|\s+$', '', 'g'), '^[\"''.]+|[\"''.]+$', '', 'g'))".replace('\\"', '"')






def _codes(spark, sf_dir):
    """Characters of whole texts by number; an empty text is one of number -1, as in SQL."""
    codes = F.when(F.col("text") == "", F.array(F.lit(-1))).otherwise(F.transform(F.split("text", ""), lambda c: F.ascii(c)))
    return _table(spark, sf_dir, "documents").select("doc_id", codes.alias("tokens"))


def prefix_match(spark, sf_dir):
    """Which documents begin with the two first characters of document 0."""
    first = _codes(spark, sf_dir).filter("doc_id = 0").select(F.slice("tokens", 1, 2).alias("prefix"))
    both = _codes(spark, sf_dir).crossJoin(F.broadcast(first.limit(1)))
    return both.select("doc_id", (F.slice("tokens", 1, F.size("prefix")) == F.col("prefix")).alias("fits"))


def prefilled_tokens(spark, sf_dir):
    return prefix_match(spark, sf_dir).select("doc_id", F.when(F.col("fits"), 2).otherwise(0).alias("prefilled"))


def _fingerprint():
    """Of the model and a text's tokens; null for a null text."""
    return F.sha2(F.concat(F.lit("tiny.gguf|1024|mistral3|2x64x32|"), F.array_join("tokens", ",")).cast("binary"), 256).alias("fingerprint")


def fingerprint(spark, sf_dir):
    return _codes(spark, sf_dir).select("doc_id", _fingerprint())


def _tokens_whole(spark, sf_dir):
    return encode_in_sets(_table(spark, sf_dir, "documents"), "doc_id", "text", tiny_vocabulary(), special=False)


def prefix_match_whole(spark, sf_dir):
    """How many tokens of whole documents are those that document 0 begins with, and whether the first two are."""
    first = _table(spark, sf_dir, "documents").filter("doc_id = 0").limit(1)
    prefix = encode_in_sets(first, "doc_id", "text", tiny_vocabulary(), special=False).select(F.col("tokens").alias("prefix"))
    both = _tokens_whole(spark, sf_dir).crossJoin(F.broadcast(prefix))
    differs = F.array_position(F.zip_with("tokens", "prefix", lambda a, b: a.eqNullSafe(b)), False)
    shared = F.when(differs > 0, differs - 1).otherwise(F.size("tokens").cast("long"))
    return both.select("doc_id", F.when(F.col("tokens").isNotNull(), shared).alias("shared")).select("doc_id", "shared", (F.col("shared") >= 2).alias("fits"))


def prefilled_tokens_whole(spark, sf_dir):
    return prefix_match_whole(spark, sf_dir).select("doc_id", F.when(F.col("fits"), 2).otherwise(0).alias("prefilled"))


def fingerprint_whole(spark, sf_dir):
    return _tokens_whole(spark, sf_dir).select("doc_id", _fingerprint())


_CODES = "list_transform(string_split(text, ''), lambda c: unicode(c)::INTEGER)"
_ODD = "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 'tool' ELSE role END role, CASE WHEN conv_id % 7 = 0 AND role = 'assistant' THEN '' ELSE text END text FROM conversations"
_DIGITS = "(strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1"
_SPLIT = f"list_filter(string_split(regexp_replace(t, '({T.marker_pattern().replace(chr(39), chr(39) * 2)})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> '')"
QUERIES = {f.__name__: f for f in (format_user_message, render_prompt, policies_x_documents, render_conversation, render_errors, render_images, control_marker_split, has_control_marker, pretokenize_pieces, piece_histogram, digit_pieces, byte_encode, byte_decode, vocab_lookup, prefix_match, prefilled_tokens, fingerprint, prefix_match_whole, prefilled_tokens_whole, fingerprint_whole)}
ORACLE_SQL = {
    "format_user_message": f"SELECT doc_id, md5({_DEFAULT}) digest, length({_DEFAULT}) n_chars FROM documents",
    "render_prompt": f"SELECT doc_id, md5({_OPEN} || {_DEFAULT} || '[/INST]') digest, length({_OPEN} || {_DEFAULT} || '[/INST]') n_chars FROM documents",
    "policies_x_documents": f"SELECT doc_id, policy_id, md5({_OPEN} || {_MESSAGE.format(i='i', q='q')} || '[/INST]') digest FROM documents, (VALUES {', '.join(f'({p}::BIGINT, {_q(i)}, {_q(q)})' for p, i, q in POLICIES)}) p(policy_id, i, q)",
    "render_conversation": f"SELECT conv_id, md5(p) digest, length(p) n_chars FROM ({_conversation_sql('0')})",
    "render_errors": f"SELECT conv_id, arg_min(e, turn) FILTER (e IS NOT NULL) error, count(e) = 0 rendered FROM (SELECT *, CASE WHEN role = 'assistant' AND text = '' THEN 'empty assistant' WHEN role NOT IN ('system', 'user', 'assistant') THEN 'unknown role: ' || role END e FROM ({_ODD})) GROUP BY 1",
    "render_images": f"SELECT conv_id, md5(p) digest FROM ({_conversation_sql('(turn % 3)::INTEGER')})",
    "control_marker_split": f"SELECT doc_id, (i - 1)::BIGINT pos, p[i] part, p[i] IN ({', '.join(map(_q, T.MARKERS))}) is_marker FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) i FROM (SELECT doc_id, {_SPLIT} p FROM (SELECT doc_id, {MARKED} t FROM documents)))",
    "has_control_marker": f"SELECT doc_id, {' OR '.join(f'contains(t, {_q(m)})' for m in T.MARKERS)} has_marker FROM (SELECT doc_id, {MARKED} t FROM documents)",
    "pretokenize_pieces": f"SELECT doc_id, len(p) n_pieces, md5(array_to_string(p, chr(31))) digest FROM (SELECT doc_id, {_PIECES} p FROM documents)",
    "piece_histogram": f"SELECT piece, count(*) n FROM ({_EXPLODED}) GROUP BY 1",
    "digit_pieces": f"SELECT doc_id, count(*) n FROM ({_EXPLODED}) WHERE regexp_full_match(piece, '[0-9]') GROUP BY 1",
    "byte_encode": f"SELECT doc_id, array_to_string(list_transform(range(length(h) // 2), lambda i: list_extract([{', '.join(f'chr({ord(c)})' for c in ALPHABET)}], {_DIGITS} + 1)), '') shown FROM (SELECT doc_id, hex(encode(text)) h FROM documents)",
    "byte_decode": "SELECT doc_id, text FROM documents",
    "vocab_lookup": f"WITH v AS (SELECT piece, row_number() OVER (ORDER BY n DESC, piece) - 1 id FROM (SELECT piece, count(*) n FROM ({_EXPLODED}) GROUP BY 1) ORDER BY n DESC, piece LIMIT {VOCABULARY}), a AS (SELECT item_id, unnest({_PIECES}) piece FROM benchmark) SELECT item_id, count(*) n, count(*) FILTER (id IS NULL) missing, sum(coalesce(id, -1))::BIGINT id_sum FROM a LEFT JOIN v USING (piece) GROUP BY 1",
    "prefix_match": f"WITH c AS (SELECT doc_id, {_CODES} t FROM documents) SELECT c.doc_id, c.t[1:2] = z.t[1:2] fits FROM c, (SELECT t FROM c WHERE doc_id = 0) z",
    "prefilled_tokens": f"WITH c AS (SELECT doc_id, {_CODES} t FROM documents) SELECT c.doc_id, CASE WHEN c.t[1:2] = z.t[1:2] THEN 2 ELSE 0 END prefilled FROM c, (SELECT t FROM c WHERE doc_id = 0) z",
    "fingerprint": f"SELECT doc_id, sha256('tiny.gguf|1024|mistral3|2x64x32|' || array_to_string({_CODES}, ',')) fingerprint FROM documents",
}
