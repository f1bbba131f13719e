"""Operator 10: quality classifier, histogram gradient-boosted trees over document statistics.

The trees are fitted in numpy on a bounded sample of labelled rows
(``SAMPLE_ROWS``, the rows with the smallest hash of doc_id), binned into at
most 64 quantile bins, grown level by level on gradient histograms, and stored
as flat arrays of a complete binary tree, so scoring is one vectorised step
per level for all rows of a slice.

Defined results: null and empty texts have all statistics 0 and get a score
like any other; labels that are null or not 0/1 are not learned from; without
any usable label every score is 0.5; a score of exactly 0.5 is predicted 1; a very long text is
read whole, and its longest word counts as 200 characters at most (longer ones say no more about it); an
empty table has no rows; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import held_out, map_slices

#: At most so many labelled rows are learned from; the bound is a parameter of fit_quality.
SAMPLE_ROWS = 12_000
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "space", "newline", "non_ascii",
    "stop_marks", "comma", "hash_dollar", "percent_amp_star", "pipe", "bang", "brackets", "quotes", "other_marks",
    "distinct_words", "top_word", "lines", "line_length", "repeated_lines", "upper_words", "letter_words", "byte_entropy", "control",
)


def _table(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars])


_CLASSES = [_table(x) for x in (".?;:", ",", "#$", "%&*", "|", "!", "()[]{}<>", "\"'`")]
_LISTED = np.concatenate(_CLASSES)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in set(_LISTED.tolist())])


def document_statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = text.split()
    k = max(len(words), 1)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    m = max(len(lines), 1)
    p = h[h > 0] / n
    lengths = sum(map(len, words))
    return [
        np.log1p(n), np.log1p(len(words)), lengths / k, min(max(map(len, words), default=0), 200), h[65:91].sum() / n, h[48:58].sum() / n, h[32] / n, h[10] / n, h[128:].sum() / n,
        *(h[c].sum() / n for c in _CLASSES), h[_MARKS].sum() / n,
        len(seen) / k, max(seen.values(), default=0) / k, np.log1p(len(lines)), np.log1p(n / m), 1 - len(set(lines)) / m, sum(map(str.isupper, words)) / k, sum(map(str.isalpha, words)) / k, float(-(p * np.log2(p)).sum()), (h[:9].sum() + h[11:32].sum() + h[127]) / n,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth in flat arrays: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # trees x inner nodes: go right if the value is greater
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, above, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 1.0) -> Trees:
    """Boost logistic loss; a split needs `least` hessian on both sides and a positive gain."""
    n, width = x.shape if x.size else (0, len(FEATURES))
    inner = 2**depth - 1
    if not n:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    out = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(count), np.zeros(count, np.int64), np.full(count, bins, np.int64)
            for j in range(width):
                key = at * bins + binned[:, j]
                gl = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(1)
                hl = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                better = top > best[0] + 1e-12
                best[0][better], best[1][better], best[2][better] = top[better], j, k[better]
            for i in range(count):
                if best[0][i] > 0:
                    out[0][t, first + i], out[1][t, first + i] = best[1][i], edges[best[1][i]][best[2][i]]
            right = binned[np.arange(n), best[1][at]] > best[2][at]
            node = 2 * node + 1 + right
        at = node - inner
        value = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        out[2][t] = value
        margin += value[at]
    return Trees(*out, base)


def with_statistics(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    keep = extra or []

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [document_statistics(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            cols = [part.column(part.schema.get_field_index(c)) for c in ["doc_id", *keep]]
            return pa.RecordBatch.from_arrays([*cols, pa.array([[float(v) for v in r] for r in rows], pa.list_(pa.float64()))], names=["doc_id", *keep, "stats"])

        return run

    kinds = dict(docs.dtypes)
    return map_slices(docs.select("doc_id", *keep, "text"), make, ", ".join([f"`{c}` {kinds[c]}" for c in ["doc_id", *keep]] + ["stats array<double>"]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled rows outside the held-out fold; the id list is bounded, so it is broadcast."""
    picked = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    return docs.select(F.col("doc_id").alias("_d"), "text").join(F.broadcast(picked), F.col("_d") == F.col("doc_id")).drop("_d")


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    rows = with_statistics(labelled_sample(docs, labels, "quality", sample_rows), ["y"]).orderBy("doc_id", "y", "stats").collect()
    x = np.array([r["stats"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([r["y"] for r in rows], float))


def quality_scores(docs: DataFrame, model: Trees) -> DataFrame:
    """Per document: doc_id, held_out, score in 0..1, predicted 0/1."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([document_statistics(t) for t in part.column(1).to_pylist()], float)
            s = model.score(x)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return run

    kind = dict(docs.dtypes)["doc_id"]
    scored = map_slices(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows, with all their columns, whose score is at least 0.5; one pass without a join."""
    at = docs.columns.index("text")

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            s = model.score(np.array([document_statistics(t) for t in part.column(at).to_pylist()], float))
            return part.filter(pa.array(s >= 0.5))

        return run

    return map_slices(docs, make, docs.schema)
