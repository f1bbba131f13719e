"""Operators 4 and 7 against the library, a plain Viterbi and round trips."""

import random

import pytest

from gavel.llm.pieces import PieceModel, decode_pieces, encode_pieces
from gavel.llm.token_counts import MARK, PieceCounter, default_model, token_counts

PARTS = [" ", "  ", "a", "the ", MARK, "\n", "é", "日", "🚨", "\t", "<s>", "</s>", "<unk>", "<0x41>", "\0", "er", "ing ", "tion", "x" * 70]


def _texts(n, seed, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_counts_equal_the_library():
    c = PieceCounter(default_model())
    assert c.splits and len(c.whole) > 10_000
    texts = _texts(3000, 1)
    assert c.count(texts) == [len(x) for x in c.sp.encode(texts)]
    c.splits = False
    assert c.count(texts[:50]) == [len(x) for x in c.sp.encode(texts[:50])]


def test_counts_survive_a_full_memory(monkeypatch):
    import gavel.llm.token_counts as t

    monkeypatch.setattr(t, "REMEMBERED", 10)
    c = PieceCounter(default_model())
    for seed in range(20):
        texts = _texts(20, seed)
        assert c.count(texts) == [len(x) for x in c.sp.encode(texts)]


def test_token_counts_table(spark):
    long = "word " * 5000
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello hello", "y"), (3, "hello hello", "y"), (4, long, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(map(tuple, token_counts(df).collect()))
    assert out[0] == (1, 0, 0, False) and out[1] == (2, 0, 0, False) and out[2] == out[3] and out[4] == (4, 25000, out[4][2], True)
    assert token_counts(df.limit(0)).count() == 0


def _best(m, s):
    best = [0.0] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(e):
            score = m.score.get(s[b:e], m.below if e - b == 1 else None)
            if score is not None and (best[e] is None or best[b] + score > best[e]):
                best[e] = best[b] + score
    return best[-1]


def _score(m, s, ids):
    total = at = k = 0
    special = set(m.bytes.values())
    while k < len(ids):
        if ids[k] in special:
            total, k, at = total + m.below, k + len(s[at].encode()), at + 1
        else:
            total, at, k = total + m.score[m.pieces[ids[k]]], at + len(m.pieces[ids[k]]), k + 1
    assert at == len(s)
    return total


def test_viterbi_is_best_and_decodes():
    m = PieceModel(default_model())
    assert m.splits
    for t in _texts(800, 2, [p for p in PARTS if p != MARK]):
        ids = m.encode(t)
        assert m.decode(ids) == t
        if t:
            s = MARK + t.replace(" ", MARK)
            assert _score(m, s, ids) == pytest.approx(_best(m, s), rel=1e-12)


def test_pieces_table(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a▁b"), (5, "日本 🚨\n"), (5, "日本 🚨\n"), (6, "x" * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' token_ids")
    out = encode_pieces(df)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[3]["round_trip"] and not got[4]["round_trip"] and got[6]["round_trip"] and out.count() == 7
    back = {r["doc_id"]: r["text"] for r in decode_pieces(out).collect()}
    assert back[5] == "日本 🚨\n" and back[4] == "a b" and back[1] == ""
    assert encode_pieces(df.limit(0)).count() == 0
