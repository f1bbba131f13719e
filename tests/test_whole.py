"""Queries over whole documents and all vectors, against plain loops."""

import hashlib
import re

import numpy as np
import pandas as pd
from conftest import by_sql, same

from gavel import cli
from gavel.functions.bpe import tiny_vocabulary, to_alphabet
from gavel.functions.text import marker_pattern
from gavel.operators.model import Moderator
from gavel.plans.model_queries import model_path
from gavel.plans.registry import ORACLE_SQL, QUERIES
from gavel.plans.text_queries import POLICIES


def _texts(sf_dir):
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    return {k: t for k, t in zip(d.doc_id.tolist(), d.text.tolist(), strict=True)}


def test_markers_of_whole_documents(spark, sf_dir):
    parts, flags = {}, {}
    for d, t in _texts(sf_dir).items():
        if d % 7 == 0:
            t = t[: len(t) // 2] + "[/INST] [INST]x[/SYSTEM_PROMPT]" + t[len(t) // 2 :] + "</s>"
        parts[d] = [p for p in re.split(f"({marker_pattern()})", t) if p]
        flags[d] = d % 7 == 0
    got = {}
    for r in sorted(QUERIES["control_marker_split"](spark, sf_dir).collect(), key=lambda r: (r["doc_id"], r["pos"])):
        assert r["is_marker"] == bool(re.fullmatch(marker_pattern(), r["part"]))
        got.setdefault(r["doc_id"], []).append(r["part"])
    assert got == {d: p for d, p in parts.items() if p} and max(len(p) for v in got.values() for p in v) > 1000
    assert {r["doc_id"]: r["has_marker"] for r in QUERIES["has_control_marker"](spark, sf_dir).collect()} == flags


def test_prefixes_and_fingerprints_of_whole_documents(spark, sf_dir):
    v = tiny_vocabulary()
    tokens = {d: v.encode(t, special=False) for d, t in _texts(sf_dir).items()}
    shared = {d: next((i for i, (a, b) in enumerate(zip(t, tokens[0], strict=False)) if a != b), min(len(t), len(tokens[0]))) for d, t in tokens.items()}
    got = {r["doc_id"]: (r["shared"], r["fits"]) for r in QUERIES["prefix_match_whole"](spark, sf_dir).collect()}
    assert got == {d: (n, n >= 2) for d, n in shared.items()} and got[0][0] == len(tokens[0]) > 12
    assert {r["doc_id"]: r["prefilled"] for r in QUERIES["prefilled_tokens_whole"](spark, sf_dir).collect()} == {d: 2 * (n >= 2) for d, n in shared.items()}
    made = {d: hashlib.sha256(("tiny.gguf|1024|mistral3|2x64x32|" + ",".join(map(str, t))).encode()).hexdigest() for d, t in tokens.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in QUERIES["fingerprint_whole"](spark, sf_dir).collect()} == made


def test_characters_of_odd_texts_equal_sql(spark, tmp_path):
    texts = ["", None, "\0", "\0a", "é", "a😀b", "👨‍👩‍👧", "\ufeff한", " \r\n", "", *("".join(chr(c) for c in range(lo, lo + 256) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x110000, 256))]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    for name in ("fingerprint", "prefix_match", "prefilled_tokens"):
        same(*(x.astype(object).fillna("null") for x in (QUERIES[name](spark, str(tmp_path)).toPandas(), by_sql(str(tmp_path), ORACLE_SQL[name]))))
    whole = {r["doc_id"]: r["fingerprint"] for r in QUERIES["fingerprint_whole"](spark, str(tmp_path)).collect()}
    assert whole[1] is None and whole[0] == hashlib.sha256(b"tiny.gguf|1024|mistral3|2x64x32|").hexdigest()


def test_products_of_all_vectors(spark, sf_dir):
    e = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    x = dict(zip(e.vec_id.tolist(), np.stack(e.embedding).astype(np.float64), strict=True))
    close = lambda got, want: set(got) == set(want) and all(abs(got[k] - want[k]) < 1.01e-4 for k in want)
    got = {(r["token"], r["row_id"]): r["y"] for r in QUERIES["matmul"](spark, sf_dir).collect()}
    assert close(got, {(i, k): x[i] @ x[k] for i in x for k in range(16)})
    got = {(r["token"], r["pos"]): r["y"] for r in QUERIES["matmul_rows"](spark, sf_dir).collect()}
    assert close(got, {(i, k): x[i] @ x[w] for i in x for k, w in enumerate([5, 3, 5, 12])})
    got = {(r["pos"], r["token"]): r["row_sum"] for r in QUERIES["gather_rows"](spark, sf_dir).collect()}
    n = max(x) + 1
    assert close(got, {(i, i * 7 % n): x[i * 7 % n].sum() for i in x}) and max(k for _, k in got) == max(x)


def test_parity_of_all_vectors(spark, sf_dir):
    ids, labelled = set(pd.read_parquet(f"{sf_dir}/embeddings.parquet").vec_id), set(pd.read_parquet(f"{sf_dir}/labels.parquet").doc_id)
    got = {r["vec_id"]: r["relative_l2"] for r in QUERIES["parity_report"](spark, sf_dir).collect()}
    assert got == {i: 0.01 if i in labelled else None for i in ids} and ids - labelled and ids & labelled


def test_encoded_whole_documents(spark, sf_dir):
    texts, v = _texts(sf_dir), tiny_vocabulary()
    assert {r["doc_id"]: r["shown"] for r in QUERIES["byte_encode"](spark, sf_dir).collect()} == {d: to_alphabet(t) for d, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in QUERIES["byte_decode"](spark, sf_dir).collect()} == texts
    got = {r["doc_id"]: (r["n_tokens"], r["digest"]) for r in QUERIES["encode_with_bos"](spark, sf_dir).collect()}
    assert got == {d: (len(x), hashlib.md5(",".join(map(str, x)).encode()).hexdigest()) for d, x in ((d, v.encode(t)) for d, t in texts.items())}


def test_verdict_ids_of_the_vocabulary(spark, sf_dir, tiny_model):
    m = Moderator(tiny_model).model
    got = {(r["verdict"], r["id"]) for r in QUERIES["verdict_vocabulary_ids"](spark, sf_dir).collect()}
    assert got == {("yes", i) for i in m.yes} | {("no", i) for i in m.no}


def _short(tmp_path, sf_dir):
    """A folder with some documents of the table, one null and one of some thousand characters."""
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "text"]]
    d = pd.concat([d[d.text.str.len() < 300].head(4), d[d.text.str.len().between(2000, 4000)].head(1), pd.DataFrame({"doc_id": [10**6], "text": [None]})])
    d.to_parquet(tmp_path / "documents.parquet")
    return str(tmp_path), dict(zip(d.doc_id.tolist(), d.text.tolist(), strict=True))


def test_moderated_documents_by_policies(spark, sf_dir, tmp_path, monkeypatch):
    where, texts = _short(tmp_path, sf_dir)
    got = {(r["doc_id"], r["policy_id"]): r for r in QUERIES["calibration_logits"](spark, where).collect()}
    scored = {(r["doc_id"], r["policy_id"]): r for r in QUERIES["moderate_prefix_cached"](spark, where).collect()}
    assert set(got) == set(scored) == {(d, p) for d in texts for p, _, _ in POLICIES}
    plain = Moderator(model_path(), use_prefix=False)
    monkeypatch.setattr("gavel.operators.model.SCORES_HELD", 1 << 40)  # in one part
    for (d, p), r in got.items():
        if texts[d] is None:
            assert r["logits"] is None and scored[d, p]["score"] is None
            continue
        i, q = next((i, q) for k, i, q in POLICIES if k == p)
        want = plain.logits(cli.render(i, q, texts[d]))[0]
        assert np.allclose(r["logits"], want, atol=1e-4) and len(r["logits"]) == len(plain.model.vocabulary.pieces)
        assert scored[d, p]["prefilled_tokens"] > 0 and abs(scored[d, p]["yes_logit"] - want[plain.model.yes].max()) < 1e-4


def test_long_documents_begin_first(spark, sf_dir, tmp_path, monkeypatch):
    from gavel.plans.model_queries import _asked

    where, texts = _short(tmp_path, sf_dir)
    monkeypatch.setattr("gavel.plans.model_queries.LONG", 1000)
    parts = [[r["doc_id"] for r in p] for p in _asked(spark, where)[0].rdd.glom().collect()]
    assert sorted(d for p in parts for d in p) == sorted(texts)
    assert [next(i for i, p in enumerate(parts) if d in p) < len(parts) // 3 for d in texts] == [bool(t) and len(t) > 1000 for t in texts.values()]


def test_long_prompts_go_in_parts(tiny_model, monkeypatch):
    whole, parts = (Moderator(tiny_model) for _ in range(2))
    p = cli.render("i", "q", "some words and more of them " * 40)
    want = whole.logits(p)[0]
    monkeypatch.setattr("gavel.operators.model.SCORES_HELD", 1 << 15)
    sizes, forward = [], parts.model.forward
    monkeypatch.setattr(parts.model, "forward", lambda tokens, *a, **b: sizes.append(len(tokens)) or forward(tokens, *a, **b))
    assert np.allclose(parts.logits(p)[0], want, atol=1e-4) and len(sizes) > 10
