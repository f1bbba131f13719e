"""The tokenizer in sets against the one that takes a text at a time."""

import random

import pytest
from pyspark.sql import functions as F

from gavel.functions import bpe
from gavel.operators import tables
from gavel.operators import tokenizer as T
from gavel.plans.token_queries import QUERIES

TEXTS = ["yes the man", "", None, "x[INST]no[/INST]</s>", "日本 🚨 test\n\n", "aaa [IMG][IMG] b", "[INST] the", "the then the", "a" * 300, "ÿ\x00\x7f\xad ĠtheĠ▁"]


def _texts(n, seed):
    rng = random.Random(seed)
    parts = ["the", "then", " the", "🚨", "", "[INST]", "</s>", "banana", "ann", "a", "é", "日", "\r\n", "  ", "x𝒜bc", "1", "!?/", " ", "'"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("bound", [3, 200_000])
def test_encoding_in_sets_equals_one_at_a_time(spark, monkeypatch, bound):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", bound)
    v = bpe.tiny_vocabulary(("the", "then", "hen", "ann", "banana", "nana", " the", "aa", "aaaa"))
    texts = TEXTS + _texts(120, bound)
    rows = [*enumerate(texts), (0, "yes the man"), (None, "the")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = sorted(((r.k is not None, r.k or 0, r.tokens) for r in T.encode_in_sets(df, "k", "t", v).collect()), key=repr)
    assert got == sorted(((k is not None, k or 0, None if t is None else v.encode(t)) for k, t in rows), key=repr)


def test_merges_that_are_out_of_order(spark):
    """Products that are merged before their parts' merge: one place at a time, as the queue does it."""
    letters = bpe.tiny_vocabulary().pieces[:8]
    words = ("ab", "abc", "bc", "ca", "abab", "cab")
    v = bpe.Vocabulary((*letters, *bpe.ALPHABET, *words), (2, *[3] * 7, *[1] * (256 + len(words))), (("ab", "ab"), ("ab", "c"), ("b", "c"), ("c", "ab"), ("a", "b"), ("c", "a")))
    assert not T.ordered_merges(v) and T.ordered_merges(bpe.tiny_vocabulary())
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(300)})
    got = {r.piece: r.ids for r in T.merge_pieces(spark.createDataFrame([(p,) for p in pieces], "piece string"), v).collect()}
    assert got == {p: v.merge(p) for p in pieces}


def test_long_pieces_end_in_the_queue(spark, monkeypatch):
    monkeypatch.setattr(T, "JOBS", 1)
    monkeypatch.setattr(T, "ROUNDS", 1)
    v = bpe.tiny_vocabulary()
    pieces = ["then", "heritheronan" * 200, "zzz", "~"]
    got = {r.piece: r.ids for r in T.merge_pieces(spark.createDataFrame([(p,) for p in pieces], "piece string"), v).collect()}
    assert got == {p: v.merge(p) for p in pieces}


def test_decoding(spark):
    v = bpe.tiny_vocabulary()
    vocabulary = T.vocabulary_tables(spark, v)
    texts = [t for t in TEXTS if t is not None and "▁" not in t] + _texts(60, 5)
    ids = [v.encode(t) for t in texts] + [[v.ids[c] for c in map(lambda b: bpe.ALPHABET[b], raw)] for raw in (b"\xff\xfea", b"\xe6\x97", b"\xf0\x9f\x9a", b"a\xc3\x28", b"\xed\xa0\x80x")]
    df = spark.createDataFrame([*enumerate(ids), (-1, None), (-2, [])], "k int, ids array<int>")
    for special in (False, True):
        got = {r.k: r.text for r in T.decode_in_sets(df, "k", "ids", vocabulary, special).collect()}
        assert got[-1] is None and got[-2] == ""
        for k, x in enumerate(ids):
            assert got[k] == v.decode(x, special), x
    for bad in ([5, 10**6], [-1], [None]):
        with pytest.raises(Exception, match="no token"):
            T.decode_in_sets(spark.createDataFrame([(1, bad)], "k int, ids array<int>"), "k", "ids", vocabulary).collect()


def test_bytes_of_pieces(spark):
    pieces = ["▁the", "Ġa", "日", "", "Ńx", *bpe.ALPHABET]
    got = spark.createDataFrame([(p,) for p in pieces], "p string").select("p", F.unhex(T.raw_hex("p")).alias("b")).collect()
    assert {r.p: bytes(r.b) for r in got} == {p: bpe.from_alphabet(p) for p in pieces}
    text = "".join(map(chr, range(300))) + "日🚨"
    assert spark.createDataFrame([(text,)], "t string").select(T.shown("t")).first()[0] == bpe.to_alphabet(text)


def test_merges_of_a_vocabulary_equal_a_plain_loop(spark):
    rng = random.Random(9)
    words = list(dict.fromkeys("".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(200)))
    for extra in (["ab", "bc", *words], ["xyz", *words, "ab"], list(bpe.tiny_vocabulary().pieces[264:])):
        pieces = [*"abcxyz", *(w for w in dict.fromkeys(extra) if len(w) > 1)]
        df = spark.createDataFrame(list(enumerate(pieces)), "rank int, piece string")
        got = [(r.left, r.right) for r in T.merges_of(df).orderBy("rank").collect()]
        assert got == bpe.derive_merges(pieces)


def test_corpus_vocabulary_makes_an_encoder(spark, sf_dir):
    """Pieces and merges of the corpus encode it: every one of the commonest pieces is one token."""
    rows = sorted(QUERIES["vocabulary_of_corpus"](spark, sf_dir).collect(), key=lambda r: r.token_id)
    merges = QUERIES["derived_merges"](spark, sf_dir).orderBy("rank").collect()
    assert [(m.left, m.right) for m in merges] == bpe.derive_merges([r.piece for r in rows if r.rank >= 0])
    v = bpe.Vocabulary(tuple(r.piece for r in rows), tuple(r.type for r in rows), tuple((m.left, m.right) for m in merges))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    got = {r.doc_id: r.tokens for r in T.encode_in_sets(docs, "doc_id", "text", v).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == v.encode(r.text)


def test_rounds_shuffle_nothing_and_pieces_are_dealt_once(spark):
    v = bpe.tiny_vocabulary()
    merges = T.small_or_not(T.merge_table(spark, v))
    df = spark.range(50).select(F.concat(F.lit("th"), F.col("id").cast("string")).alias("piece")).repartition("piece").select("piece", T.shown("piece").alias("s"), F.lit(False).alias("done"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = T._round(T._round(df, merges, True), merges, True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_texts_and_tokens_are_not_shuffled(spark):
    """Ids of texts and bytes of ids are found where the rows lie."""
    v = bpe.tiny_vocabulary()
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    encoded = T.encode_in_sets(df, "k", "t", v)
    back = T.decode_in_sets(encoded, "k", "tokens", T.vocabulary_tables(spark, v))
    for made in (encoded, back):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "Generate" not in plan


def test_decoding_by_a_large_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 10)
    test_decoding(spark)


def test_bytes_of_texts_need_no_python(spark):
    texts = [*(t for t in TEXTS if t is not None), *_texts(60, 3), "".join(map(chr, range(400))), "\x00a\x00", "日" * 50]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, t string").select("k", bpe.byte_encoded("t").alias("shown"))
    back = df.select("k", "shown", bpe.byte_decoded("shown").alias("text"))
    assert "Python" not in back._jdf.queryExecution().executedPlan().toString()
    got = {r.k: (r.shown, r.text) for r in back.collect()}
    assert got == {-1: (None, None)} | {i: (bpe.to_alphabet(t), t) for i, t in enumerate(texts)}
    odd = ["▁the", "日Ġa", "", "Āx▁Ā", "ÿþ", "\x00\x7f", "Ńŀ é", " a", *bpe.ALPHABET]
    got = {r.p: r.t for r in spark.createDataFrame([(p,) for p in odd], "p string").select("p", bpe.byte_decoded("p").alias("t")).collect()}
    assert got == {p: bpe.from_alphabet(p).decode("utf-8", "replace") for p in odd}
