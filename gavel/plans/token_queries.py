"""Queries of the tokenizer in sets: pieces merged by rank, ids of whole texts and back, vocabulary and merges of a corpus; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.functions.bpe import ALPHABET, tiny_vocabulary
from gavel.functions.text import pre_tokens
from gavel.operators.tokenizer import corpus_vocabulary, decode_in_sets, encode_in_sets, merge_pieces, merges_of, vocabulary_tables
from gavel.plans.text_queries import _DIGITS, _PIECES, _q, _table

#: Pieces of the vocabulary that is made from the corpus, beside the bytes.
CORPUS_PIECES = 2000
SPECIAL = ("<unk>", "<s>", "</s>")


def encode_pieces_by_rank(spark, sf_dir):
    """Ids of every distinct piece of all documents."""
    pieces = _table(spark, sf_dir, "documents").select(F.explode(pre_tokens("text")).alias("piece")).distinct()
    return merge_pieces(pieces, tiny_vocabulary()).select("piece", F.size("ids").cast("long").alias("n_tokens"), F.array_join("ids", ",").alias("ids"))


def _encoded(spark, sf_dir):
    return encode_in_sets(_table(spark, sf_dir, "documents"), "doc_id", "text", tiny_vocabulary())


def encode_with_bos(spark, sf_dir):
    """Token ids of whole documents."""
    return _encoded(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.col("tokens")[0].alias("first"), F.md5(F.array_join("tokens", ",").cast("binary")).alias("digest"))


def decode_tokens(spark, sf_dir):
    """Whole documents from their token ids: the texts again."""
    vocabulary = vocabulary_tables(spark, tiny_vocabulary())
    text = decode_in_sets(_encoded(spark, sf_dir), "doc_id", "tokens", vocabulary)
    return text.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _corpus(spark, sf_dir):
    return corpus_vocabulary(_table(spark, sf_dir, "documents"), "text", CORPUS_PIECES, SPECIAL)


def vocabulary_of_corpus(spark, sf_dir):
    """Special pieces (rank -1), bytes, and the commonest pieces of the documents, in rank order."""
    return _corpus(spark, sf_dir).withColumn("rank", F.coalesce("rank", F.lit(-1)))


def derived_merges(spark, sf_dir):
    """The merges of that vocabulary."""
    return merges_of(_corpus(spark, sf_dir))


def _shown(text: str) -> str:
    """SQL of the byte alphabet's form of a text."""
    letters = f"[{', '.join(f'chr({ord(c)})' for c in ALPHABET)}]"
    digits = _DIGITS.replace("substr(h,", f"substr(hex(encode({text})),")
    return f"array_to_string(list_transform(range(strlen({text})), lambda i: list_extract({letters}, {digits} + 1)), '')"


def _by_rank() -> str:
    """CTEs: pieces in their places (x), and each distinct one with the ids it is merged to (y)."""
    v = tiny_vocabulary()
    merges = ", ".join(f"{{'l': {_q(a)}, 'r': {_q(b)}}}" for a, b in v.merges if a + b in v.ids)
    hit = f"list_filter([{merges}], lambda m: contains(STRING, ' ' || m.l || '  ' || m.r || ' '))[1]"
    pair = "' ' || best.l || '  ' || best.r || ' '"
    merged = f"s[:instr(s, {pair}) - 1] || ' ' || best.l || best.r || ' ' || s[instr(s, {pair}) + length({pair}):]"
    pieces = ", ".join(f"({_q(p)}, {i})" for p, i in v.ids.items())
    return f"""WITH RECURSIVE x AS (SELECT doc_id, i AS pos, p[i] AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {_PIECES} AS p FROM documents))),
v(symbol, id) AS (VALUES {pieces}),
d AS (SELECT piece, {_shown('piece')} AS symbol FROM (SELECT DISTINCT piece FROM x)),
w AS (SELECT piece, symbol, id FROM d LEFT JOIN v USING (symbol)),
r(piece, s, best) AS (
    SELECT piece, s, {hit.replace('STRING', 's')} FROM (SELECT piece, regexp_replace(symbol, '(.)', ' \\1 ', 'gs') AS s FROM w WHERE id IS NULL)
    UNION ALL SELECT piece, t, {hit.replace('STRING', 't')} FROM (SELECT piece, {merged} AS t FROM r WHERE best IS NOT NULL)),
u AS (SELECT piece, unnest(string_split(s[2:length(s) - 1], '  ')) AS symbol, generate_subscripts(string_split(s[2:length(s) - 1], '  '), 1) AS n FROM r WHERE best IS NULL),
y AS (SELECT piece, string_agg(id, ',' ORDER BY n) AS ids, count(id) AS n_tokens FROM u LEFT JOIN v USING (symbol) GROUP BY piece UNION ALL SELECT piece, id::VARCHAR, 1 FROM w WHERE id IS NOT NULL)"""


_RANKED = f"""k AS (SELECT piece, count(*) AS n FROM (SELECT unnest({_PIECES}) AS piece FROM documents) WHERE strlen(piece) > 1 GROUP BY 1 ORDER BY n DESC, piece LIMIT {CORPUS_PIECES}),
z AS (SELECT (256 + row_number() OVER (ORDER BY n DESC, piece) - 1)::INTEGER AS rank, {_shown('piece')} AS piece FROM k
    UNION ALL SELECT * FROM (VALUES {', '.join(f'({b}, chr({ord(c)}))' for b, c in enumerate(ALPHABET))}) t(rank, piece))"""

#: A split of all entries by rounds; an entry of rank r sees the entries of smaller rank alone.
_SPLIT = f"""WITH RECURSIVE {_RANKED},
g(rank, p, best) AS (
    SELECT rank, string_split(piece, ''), -1::BIGINT FROM z
    UNION ALL SELECT rank, p, best FROM (
        SELECT rank, p, (SELECT min(b.rank::BIGINT * 16777216 + i) FROM (SELECT unnest(range(1, len(p))) AS i) JOIN z b ON b.piece = p[i] || p[i + 1] AND b.rank < h.rank) AS best FROM (
            SELECT rank, CASE WHEN best < 0 THEN p ELSE p[:best % 16777216 - 1] || [p[best % 16777216] || p[best % 16777216 + 1]] || p[best % 16777216 + 2:] END AS p FROM g) h
        WHERE len(p) > 2) WHERE best IS NOT NULL),
e AS (SELECT rank, CASE WHEN best < 0 THEN p ELSE p[:best % 16777216 - 1] || [p[best % 16777216] || p[best % 16777216 + 1]] || p[best % 16777216 + 2:] END AS p FROM g)
SELECT rank, p[1] AS "left", p[2] AS "right" FROM e WHERE len(p) = 2"""

QUERIES = {f.__name__: f for f in (encode_pieces_by_rank, encode_with_bos, decode_tokens, vocabulary_of_corpus, derived_merges)}
ORACLE_SQL = {
    "encode_pieces_by_rank": f"{_by_rank()} SELECT piece, n_tokens, coalesce(ids, '') AS ids FROM y",
    "encode_with_bos": f"{_by_rank()} SELECT c.doc_id, 1 + coalesce(n, 0)::BIGINT AS n_tokens, 1 AS first, md5(concat_ws(',', '1', nullif(ids, ''))) AS digest FROM documents c LEFT JOIN (SELECT doc_id, sum(n_tokens) AS n, string_agg(ids, ',' ORDER BY pos) AS ids FROM x JOIN y USING (piece) GROUP BY doc_id) USING (doc_id)",
    "decode_tokens": "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents",
    "vocabulary_of_corpus": f"WITH {_RANKED} SELECT (rank + {len(SPECIAL)})::INTEGER AS token_id, rank, piece, 1 AS type FROM z UNION ALL SELECT * FROM (VALUES {', '.join(f'({i}, -1, {_q(p)}, 3)' for i, p in enumerate(SPECIAL))})",
    "derived_merges": _SPLIT,
}
