"""Operator 2: suffix arrays against sorting, removal against a plain scan of all strings."""

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gavel.llm import suffixes
from gavel.llm.repeats import SHARD, merged, remove_repeats
from gavel.llm.suffixes import anchors, permuted_lcp, suffix_array


@pytest.mark.parametrize(("buckets", "short"), [(2, 0), (1024, 0), (2, 1 << 15), (1024, 1 << 15)])
def test_suffix_array_and_prefixes(monkeypatch, buckets, short):
    monkeypatch.setattr(suffixes, "BUCKETS", buckets)
    monkeypatch.setattr(suffixes, "SHORT", short)
    rng = np.random.default_rng(buckets)
    for trial in range(300):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint8)
        t = np.tile(t, 3) if trial % 3 == 0 else t
        raw = bytes(t)
        want = sorted(range(len(t)), key=lambda i: raw[i:])
        sa = suffix_array(t)
        assert sa.tolist() == want
        if len(t) > 1:
            lcp = permuted_lcp(t, sa, 5)
            for a, b in zip(want, want[1:], strict=False):
                k = 0
                while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                    k += 1
                assert min(k, 5) == min(lcp[b], 5)


def test_a_full_shard_is_sorted_by_recursion(monkeypatch, sf_dir):
    raw = "".join(t or "" for t in pd.read_parquet(f"{sf_dir}/documents.parquet").text).encode()
    raw = (raw * (SHARD // len(raw) + 1))[:SHARD]
    sizes, plain = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda t, sigma=256: sizes.append((len(t), sigma)) or plain(t, sigma))
    sa = suffixes.suffix_array(np.frombuffer(raw, np.uint8))
    assert len(sizes) > 2 and sizes[0][0] == SHARD and all(4 * b[0] < 3 * a[0] for a, b in zip(sizes, sizes[1:], strict=False))
    assert (np.sort(sa) == np.arange(SHARD)).all()
    rank = np.empty(SHARD + 1, np.int64)
    rank[sa], rank[SHARD] = np.arange(SHARD), -1
    t = np.frombuffer(raw, np.uint8)
    a, b = sa[:-1], sa[1:]  # neighbours are in order by their first byte, then by the rank of the rest
    assert ((t[a] < t[b]) | ((t[a] == t[b]) & (rank[a + 1] < rank[b + 1]))).all()


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 5000).astype(np.uint8)
    buf = np.concatenate([text, rng.integers(97, 123, 333).astype(np.uint8), text])
    ends = np.array([len(buf)])
    at, h = anchors(buf, np.array([0]), ends, 100, 48, block=1024)
    first, second = at[at < 5000 - 100], at[at >= 5333]
    inside = second[(second - 5333 >= 100) & (second - 5333 < 4800)] - 5333
    assert set(inside) <= set(first) and (np.diff(at) <= 53).all()


def _brute(rows, w):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - w + 1):
            x = raw[i : i + w]
            if x in seen:
                gone[i : i + w] = b"\1" * w
            seen.add(x)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def _rows():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(50, 200))) for _ in range(12)]
    rows = []
    for d in range(80):
        t = "".join(rng.choice(base)[rng.randint(0, 30) :] if rng.random() < 0.6 else "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(0, 6)))
        t = "ab" * rng.randint(10, 200) if rng.random() < 0.1 else t
        t = rng.choice(rows)[1] if rng.random() < 0.1 and rows else t
        rows.append((d, t))
    return [*rows, (200, None), (201, ""), (202, "é" * 3000)]


@pytest.mark.parametrize("most", [16_384, 2])
def test_removal_equals_plain_scan(spark, most):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' spans", "1 key")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, most=most).collect()}
    assert got == _brute(rows, 100)


def test_lists_too_long_to_send_are_joined(spark, monkeypatch):
    import gavel.llm.repeats as r

    monkeypatch.setattr(r, "SENT", 1)
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in remove_repeats(df).collect()}
    assert got == _brute(rows, 100)


def test_repeated_rows_and_empty_tables(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh") for _ in range(150))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["n_removed"], r["text"] or "") for r in remove_repeats(df).collect())
    assert got == [(1, 0, t), (1, 0, t), (2, 150, ""), (99, 150, "")]
    assert remove_repeats(df.limit(0)).count() == 0


def test_merged_runs_touch():
    assert merged([{"s": 5, "e": 9}, {"s": 0, "e": 5}, {"s": 20, "e": 30}]) == [(0, 9), (20, 30)] and merged(None) == []


def test_batches_sent_to_workers_are_bounded_by_bytes(spark):
    from gavel.llm.common import SLICE_BYTES, map_slices

    def largest(session):
        def make():
            def run(part):
                # the buffer is the whole batch's, not the slice's alone
                return pa.RecordBatch.from_arrays([pa.array([part.column(1).buffers()[2].size]), pa.array([part.num_rows])], names=["held", "n"])

            return run

        docs = session.range(0, 1000, 1, 1).selectExpr("id doc_id", "repeat('word ', 8000) text")
        found = map_slices(docs, make, "held long, n long").collect()
        assert sum(r.n for r in found) == 1000
        return max(r.held for r in found)

    fresh = spark.newSession()
    assert largest(fresh) <= 2 * SLICE_BYTES
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    assert largest(own) > 2 * SLICE_BYTES
