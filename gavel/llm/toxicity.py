"""Operator 3: toxicity severity by cumulative-link ordinal regression over hashed words and word heads.

Grades are ordered: 0 clean, then toxic rows cut at quantiles of the share of
words that occur far more often in toxic training texts than in others. One
weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - t_k)
with t_0 < t_1 < ...; the expected severity is the sum of these over k. Weights
are fitted with accelerated proximal gradient steps and an L1 penalty, so that
words without evidence keep weight 0 and long clean texts gather no score.

Learning uses a bounded sample of labelled rows (``SAMPLE_ROWS``) and at most
MOST features, those whose toxic share is furthest off; scoring reads every
whole text. Defined results: null and empty texts have no
features, and so get the grade of the thresholds alone; without usable labels
every severity is 0; of grades that are equally likely the least is given; a
very long text is one row's features; an empty table has no rows; repeated rows
each give a row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import map_slices, stored
from gavel.llm.hashing import letter_words
from gavel.llm.quality import labelled_sample

SAMPLE_ROWS = 8_000
BITS = 22
GRADES = 4
#: Word heads of so many bytes are features beside whole words: they find inflected and compound forms.
HEADS = (4, 5, 6, 7)
#: Features that at least LEAST sampled rows have and whose toxic share is SURE standard errors off; MOST of them.
LEAST, SURE, MOST = 5, 3.0, 50_000


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all texts: hashed words and word heads, 1 + log of their counts."""
    hashes, cut = letter_words(texts, HEADS)
    row = np.repeat(np.arange(len(texts)), np.diff(cut))
    key = np.concatenate([((row << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))[h != 0] for h in hashes])
    key, n = np.unique(key, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), 1 + np.log(n)


@dataclass(frozen=True)
class Ordinal:
    """Shared weights and ordered thresholds."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, rows: int, row: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        if not len(self.buckets):
            x = np.zeros(rows)
        else:
            i = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            x = np.bincount(row, np.where(self.buckets[i] == bucket, self.weights[i], 0) * value, rows)
        return 1 / (1 + np.exp(-(x[:, None] - self.thresholds[None])))


def _clip(t: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(t + np.arange(len(t)) * 1e-3)


def grades(toxic: np.ndarray, row: np.ndarray, bucket: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0 for clean rows; toxic rows by terciles of the share of words typical of toxic rows."""
    width = 1 << BITS
    bad = np.bincount(bucket[toxic[row] == 1], minlength=width)
    good = np.bincount(bucket[toxic[row] == 0], minlength=width)
    typical = (bad >= 5) & (bad * max(1, (toxic == 0).sum()) > 10 * (good + 0.5) * max(1, (toxic == 1).sum()))
    share = np.bincount(row, typical[bucket], len(toxic)) / np.maximum(words, 1)
    cuts = np.quantile(share[toxic == 1], np.linspace(0, 1, GRADES)[1:-1]) if (toxic == 1).any() else np.zeros(GRADES - 2)
    return np.where(toxic == 1, 1 + (share[:, None] > cuts[None]).sum(1), 0)


def fit_ordinal(n: int, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, steps: int = 200, l1: float = 1.5e-4) -> Ordinal:
    """Minimise the mean of the binary losses of all thresholds plus l1 * |w|."""
    if not n or not (grade > 0).any():
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 40.0))
    buckets, col = np.unique(bucket, return_inverse=True)
    above = (grade[:, None] > np.arange(GRADES - 1)[None]).astype(float)
    rate = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
    t = _clip(-np.log(rate / (1 - rate)))
    w, z, tz, momentum = np.zeros(len(buckets)), np.zeros(len(buckets)), t.copy(), 1.0
    norm = np.sqrt(np.bincount(row, value**2, n).mean()) + 1
    step = 40 / norm**2
    for _ in range(steps):
        x = np.bincount(row, z[col] * value, n)
        r = 1 / (1 + np.exp(-(x[:, None] - tz[None]))) - above
        g = np.bincount(col, r.sum(1)[row] * value, len(buckets)) / n
        new = z - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_t = _clip(tz + step * 0.5 * r.mean(0))
        if ((z - new) * (new - w)).sum() > 0:  # restart when momentum points uphill
            momentum = 1.0
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, tz = new + (momentum - 1) / after * (new - w), _clip(new_t + (momentum - 1) / after * (new_t - t))
        w, t, momentum = new, new_t, after
    keep = w != 0
    return Ordinal(buckets[keep], w[keep], t)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """Features are made where the texts are; the driver gets the sparse rows of the bounded sample."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(2).to_pylist()
            row, bucket, value = features(texts)
            cut = np.searchsorted(row, np.arange(len(texts) + 1))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, kind))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(bucket, pa.int32()), lists(value, pa.float32())], names=["doc_id", "y", "bucket", "value"])

        return run

    sample = labelled_sample(docs, labels, "toxic", sample_rows).selectExpr("cast(doc_id as long) doc_id", "y", "text")
    rows = stored(map_slices(sample, make, "doc_id long, y int, bucket array<int>, value array<float>"))
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = bad / n if n else 0.0
    if not 0 < rate < 1:
        return fit_ordinal(0, *[np.zeros(0)] * 4)
    seen = rows.select("y", F.explode("bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))
    off = F.abs(F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    picked = seen.filter(F.col("n") >= LEAST).select("bucket", off.alias("off")).filter(F.col("off") >= SURE).orderBy(F.desc("off"), "bucket").limit(MOST).toArrow()
    vocabulary = np.sort(picked.column("bucket").to_numpy())

    def known(batches):
        for b in batches:
            flat, values = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            cut = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy())])
            keep = np.isin(flat, vocabulary)
            at = np.concatenate([[0], np.cumsum(keep)])[cut]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(flat[keep]), lists(values[keep])], names=["doc_id", "y", "bucket", "value"])

    got = rows.mapInArrow(known, "doc_id long, y int, bucket array<int>, value array<float>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    lists = got.column("bucket").combine_chunks()
    row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    bucket = lists.flatten().to_numpy().astype(np.int64)
    value = got.column("value").combine_chunks().flatten().to_numpy().astype(float)
    toxic = np.array(got.column("y").to_pylist(), np.int64)
    return fit_ordinal(n, row, bucket, value, grades(toxic, row, bucket, np.bincount(row, np.exp(value - 1), n)))


def toxicity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Per document: doc_id, expected severity 0..3, P(toxic), the likeliest grade, toxic 0/1."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(1).to_pylist()
            p = model.above(len(texts), *features(texts))
            full = np.concatenate([np.ones((len(texts), 1)), p, np.zeros((len(texts), 1))], axis=1)
            grade = (full[:, :-1] - full[:, 1:]).argmax(1)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(grade.astype(np.int32)), pa.array((p[:, 0] >= 0.5).astype(np.int32))], names=["doc_id", "severity", "score", "grade", "toxic"])

        return run

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, severity double, score double, grade int, toxic int")
