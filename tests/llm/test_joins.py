"""Operators 5, 8 and 9 against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from conftest import by_sql, same

from gavel.llm.components import components
from gavel.llm.decontaminate import decontaminate
from gavel.llm.hashing import shingle_sets, word_hashes
from gavel.llm.jaccard import bounds, count_vector, similar_components, tree_join
from gavel.llm.neighbours import neighbours
from gavel.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), by_sql(sf_dir, ORACLE_SQL[name]))


def test_word_hashes_tell_words_apart(monkeypatch):
    import gavel.llm.hashing as h

    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    got = word_hashes(" ".join(words).encode())[1]
    assert len({(w, x) for w, x in zip(words, got.tolist(), strict=True)}) == len(set(words)) == len(set(got.tolist()))
    monkeypatch.setattr(h, "BLOCK", 64)
    again = word_hashes(("  ".join(words) + "\n").encode())[1]
    assert (again == got).all()
    long = word_hashes(b"a " + b"b" * 200 + b" c")
    assert long[0].tolist() == [0, 2, 203]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    own = {i: i for e in edges for i in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(own[a], own[b])
            changed |= own[a] != m or own[b] != m
            own[a] = own[b] = m
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: v for k, v in own.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bound", [200_000, 0])
def test_components_of_few_edges_take_few_tasks(spark, monkeypatch, bound):
    import gavel.llm.components as c

    seen, kept = [], c.stored
    monkeypatch.setattr(c, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(c, "stored", lambda df: seen.append(df.rdd.getNumPartitions()) or kept(df))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = dict(map(tuple, components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 70), (80, 90)], "a long, b long")).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {**dict.fromkeys(range(41), 0), 70: 70, 80: 70, 90: 70}
    assert max(seen) <= 4 if bound else max(seen) >= 31  # a table that is too large to be sent is shuffled


def test_tree_join_finds_all_bounds():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m = int(rng.integers(2, 90))
        base = rng.integers(0, 400, (5, 60))
        rows = []
        for _ in range(m):
            b = base[rng.integers(5)].copy()
            k = rng.integers(0, 25)
            b[rng.integers(0, 60, k)] = rng.integers(0, 4000, k)
            rows.append(np.unique(b[: rng.integers(20, 60)]).astype(np.uint64))
        vec = np.stack([np.frombuffer(v, np.uint8) * 2.0**k for v, k in map(count_vector, rows)]).astype(np.float32)
        n, comp = np.array([len(r) for r in rows]), rng.integers(0, m // 2 + 1, m)
        a, b = tree_join(vec, n, comp)
        got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
        want = {(i, j) for i in range(m) for j in range(i + 1, m) if comp[i] != comp[j] and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]) and 7 * np.minimum(vec[i], vec[j]).sum() >= 3 * (n[i] + n[j])}
        assert got == want
        long = [np.arange(i * 50, i * 50 + int(rng.integers(300, 5000)), dtype=np.uint64) for i in range(4)]
        both = [count_vector(r) for r in rows[:3] + long]
        i, j = (x.ravel() for x in np.indices((len(both), len(both))))
        real = [len(np.intersect1d((rows[:3] + long)[x], (rows[:3] + long)[y])) for x, y in zip(i, j, strict=True)]
        assert (bounds([v for v, _ in both], np.array([k for _, k in both]), i, j) >= real).all()
    flat = count_vector(np.zeros(2000, np.uint64))  # all in one group
    assert flat[1] == 3 and np.frombuffer(flat[0], np.uint8).astype(int).sum() << flat[1] >= 2000


def _documents():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(4)]
    rows = []
    for d in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            t[rng.randrange(60)] = rng.choice(words)
        rows.append((d, " ".join(t).title() if d % 3 else " ".join(t)))
    return rows + [(900, None), (901, ""), (902, "a b"), (903, "A B"), (904, "a b c"), (905, " \n"), (906, "\xa0a b"), (907, "x " * 30_000)]


def _classes(rows, size=5):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(d, []).append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    ids = sorted(sets)
    own = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                m = {own[a], own[b]}
                own = {k: min(m) if v in m else v for k, v in own.items()}
    return own


@pytest.mark.parametrize("block, large", [(1024, 4096), (16, 8)])
def test_similar_components_equal_brute_force(spark, monkeypatch, block, large):
    import gavel.llm.jaccard as j

    monkeypatch.setattr(j, "BLOCK_ROWS", block)
    monkeypatch.setattr(j, "LARGE", large)
    rows = _documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 n", "7 comp", "'x' token")
    got = {r["doc_id"]: r["component_id"] for r in similar_components(df).collect()}
    assert got == _classes(rows)


def test_similar_components_odd_ids(spark):
    t = "one two three four five six seven"
    rows = [(5, t), (5, "other words here that are not like it"), (9, t), (2, "other words here that are not like it"), (None, t)]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["component_id"]) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 2), (5, 2), (5, 2), (9, 2), (99, None)]
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _components_by_id(df):
    rows = [(r["doc_id"], r["component_id"]) for r in similar_components(df).collect()]
    assert len(set(rows)) == len({d for d, _ in rows})  # one component for each id
    return dict(rows), len(rows)


def _text(k, *changed, words=80):
    return " ".join(f"new{k}x{i}x{changed[0]}" if i in changed else f"w{k}x{i}" for i in range(words))


def _only_pairs(groups):
    """Ids 3g, 3g + 1, 3g + 2: the rarest shingles of the first are shared with one of the others each."""
    return [row for g in range(groups) for row in ((3 * g, _text(g)), (3 * g + 1, _text(g, 10, 20)), (3 * g + 2, _text(g, 50, 60)))]


def test_similar_components_of_doubled_rows(spark):
    rows = _only_pairs(6) + [(100, None), (101, "a b"), (None, _text(0))]
    got, n = _components_by_id(spark.createDataFrame(rows * 2, "doc_id long, text string"))
    assert got.pop(None) is None and n == 2 * len(rows)
    assert got == _classes(rows[:-1]) and got[4] == got[5] == 3


def test_similar_components_of_one_id_with_two_texts(spark):
    common = _text("y", words=104)
    # near texts under one id
    rows = [(d, t + more) for d, t in _only_pairs(3) for more in ("", f" end{d}")]
    # unlike ones, the second near to another id's, beside a longer document that has all of its shingles
    for g in range(30):
        d = 1000 + 3 * g
        rows += [(d, _text(f"a{g}")), (d, _text(f"z{g}")), (d + 1, _text(f"z{g}", 40)), (d + 2, _text(f"z{g}") + " " + common)]
    # texts of an id link those of others; a text without words goes with its id
    rows += [(50, _text("p")), (50, _text("q")), (50, None), (40, _text("q", 3)), (60, _text("p", 70)), (70, _text("q")), (8, None), (8, "")]
    got, n = _components_by_id(spark.createDataFrame(rows, "doc_id long, text string"))
    want = _classes(rows)
    assert got == want and n == len(rows) and want[60] == want[70] == 40 and want[1001] == 1000


def test_shingles_of_short_texts():
    a, b, c, d = shingle_sets(["a b", "A  B", "a b c", None])
    assert (a == b).all() and len(a) == 1 and a[0] != c[0] and len(d) == 0


def _words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def _contamination(docs, items):
    windows = {}
    for i, t in items:
        w = _words(t)
        for k in range(max(0, len(w) - min(13, len(w)) + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + min(13, len(w))]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w, hit, found = _words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        ids = sorted(map(str, found))
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontaminate_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["ab", "CD", "É", "é", "x1", "日", "q", "İ", "k", "K"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 13, 14, 40])))) for i in range(20)] + [(50, None), (51, "--"), (52, "q"), (10, "ab CD É é x1 日 q ab")]
    docs = []
    for d in range(80):
        parts = ["-".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(items)[1] or "", " ".join(word() for _ in range(rng.randint(0, 20)))]
        docs.append((d, "! ".join(parts)))
    docs += [(200, None), (201, ""), (202, "no hit at all " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 item_id", "2 win", "3 h")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 doc_id")
    got = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate(df, bench).collect()}
    assert got == _contamination(docs, items)
    assert decontaminate(df.limit(0), bench).count() == 0
    assert {r["contaminated"] for r in decontaminate(df, bench.limit(0)).collect()} == {False}


def test_decontaminate_repetitive_texts(spark):
    """Cost follows the words, not the places of a word times its places in an item; ids that are null or shared; repeated rows."""
    import time

    docs = [(1, "la " * 100_000), (2, "la la"), (3, "x " + "la " * 12 + "y"), (3, "x " + "la " * 13 + "y"), (None, "la " * 14), (None, None), (4, "ab cd " * 30_000), (4, "ab cd " * 30_000)]
    items = [(1, "la " * 1000), (2, "la " * 13), (3, "ab cd " * 500), (4, "cd ab " * 7)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    began = time.time()
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate(df, bench).collect()))
    assert got == [(0, 0, 0, ()), (0, 14, 14, ("1", "2")), (1, 100_000, 100_000, ("1", "2")), (2, 2, 0, ()), (3, 14, 0, ()), (3, 15, 13, ("1", "2")), *[(4, 60_000, 60_000, ("3", "4"))] * 2]
    assert time.time() - began < 60


def test_decontaminate_is_native(spark, sf_dir):
    plan = QUERIES["op8_decontaminate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _nearest(rows, every, top=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q)[:top]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 24)) * 2
    rows = [(i, (centres[i % 20] + 0.4 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(10_000 + i, rows[0][1]) for i in range(40)]  # one very common vector
    rows += [(20_000, None), (20_100, [0.0] * 24), (20_200, [float("nan")] * 24), (20_300, [None] * 24), (20_400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 list", "2 key", "3 rank")
    want = _nearest([r for r in rows if r[0] != 20_400], 100)
    got = neighbours(df).toPandas().sort_values(["query_id", "rank"])
    assert set(got.query_id) == set(want) and (got.groupby("query_id")["rank"].apply(list).map(lambda r: r == list(range(1, 11)))).all()
    found = right = 0
    for q, g in got.groupby("query_id"):
        truth = dict((i, d) for d, i in want[q])
        found += len(truth)
        right += len(set(g.vec_id) & set(truth))
        assert g.score.is_monotonic_increasing
    assert right / found >= 0.9
    assert got[got.query_id == 10_000].vec_id.tolist() == [0, *range(10_001, 10_010)]


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours(df).toPandas()
    assert got.vec_id.tolist() == [2, 1] and got.score.tolist() == pytest.approx([1, 2**0.5])
    assert neighbours(df.limit(0)).count() == 0
    assert isinstance(got, pd.DataFrame)


def test_shingles_shared_by_chance_make_no_large_buckets(spark, monkeypatch):
    """A phrase of 20 documents of 600 is no bucket of a document that has rarer shingles; what is near stays linked."""
    import gavel.llm.jaccard as j

    monkeypatch.setattr(j, "OFTEN", 16)
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    phrase = lambda g: " ".join(f"p{g}x{k}" for k in range(12))
    rows = [(i, f"{phrase(i % 30)} {own(i)}") for i in range(600)] + [(1000 + i, f"{phrase(i % 30)} {own(i)} more") for i in range(0, 600, 50)] + [(2000 + i, phrase(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token, late = j.common_shingles(df, len(rows), j.SHINGLE)
    assert len(token) == 30 * 8 and set(late.tolist()) == {2, 3} and (np.sort(token) == token).all()
    found = j.buckets(df.filter("doc_id < 2000"), (token, late), j.SHINGLE)
    assert found.groupBy("token").count().agg({"count": "max"}).first()[0] == 2
    got = {r["doc_id"]: r["component_id"] for r in similar_components(df).collect()}
    assert got == _classes(rows)
