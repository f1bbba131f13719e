"""Operator 6: language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into chunks of CHUNK bytes. In each direction a gated recurrent
unit reads a chunk byte by byte (the input weights are a table with a row for
each byte value); from both states every position gets a label distribution,
and a document's probabilities are the mean over all its positions. The network
is trained in numpy by backpropagation through time, with Adam, on a bounded
sample of documents (``SAMPLE_ROWS``): each step draws documents, then one chunk
of each, so that a long text weighs as much as a short one. The chunks that may
be drawn are picked where the texts lie, from all chunks of a text by hash
(``DRAWS`` of them, all if there are no more), so the driver gets at most
SAMPLE_ROWS * DRAWS * CHUNK bytes, however long texts are. Prediction reads whole texts.

Defined results: a text that is null, empty or without a letter is `und` with
score 0; without any document to learn from all are `und`; of labels with equal
probability the first in order wins; an empty table gives an empty result; very
long texts are read chunk by chunk; repeated rows each give a row; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import held_out, map_slices

SAMPLE_ROWS = 3_000
CHUNK, STATES = 64, 10
#: Chunks of a sampled document that come to the driver, at most.
DRAWS = 64
#: Chunks computed at once.
AT_ONCE = 2_048


@dataclass
class Network:
    labels: list[str]
    p: dict[str, np.ndarray]  # table_f, state_f, out_f, table_b, state_b, out_b, bias

    @staticmethod
    def new(labels: list[str], seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        h, k = STATES, len(labels)
        p = {"bias": np.zeros(k, np.float32)}
        for d in "fb":
            p[f"table_{d}"] = (rng.standard_normal((256, 3 * h)) * 0.3).astype(np.float32)
            p[f"state_{d}"] = (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32)
            p[f"out_{d}"] = (rng.standard_normal((h, k)) * 0.1).astype(np.float32)
        return Network(labels, p)

    def _read(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Label scores of one direction for each position of x (positions x chunks); keep gets what training needs."""
        table, state, out = (self.p[f"{n}_{d}"] for n in ("table", "state", "out"))
        k = STATES
        h = np.zeros((x.shape[1], k), np.float32)
        scores = np.empty((*x.shape, out.shape[1]), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, s = table[x[t]], h @ state
            zr = a[:, : 2 * k] + s[:, : 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r, u = zr[:, :k], zr[:, k:], s[:, 2 * k :]
            n = r * u
            n += a[:, 2 * k :]
            np.tanh(n, out=n)
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, z, r, u, n))
            h = new
            np.matmul(h, out, out=scores[t])
            if keep is not None:
                keep[-1] += (h,)
        return scores

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities at each position."""
        s = self._read(x, "f") + self._read(x, "b") + self.p["bias"]
        s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(2, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions and its gradients, by backpropagation through time."""
        kept = {"f": [], "b": []}
        s = self._read(x, "f", kept["f"]) + self._read(x, "b", kept["b"]) + self.p["bias"]
        s -= s.max(2, keepdims=True)
        e = np.exp(s)
        q = e / e.sum(2, keepdims=True)
        total = mask.sum()
        loss = float(-(np.log(q[:, np.arange(len(y)), y] + 1e-12) * mask).sum() / total)
        q[:, np.arange(len(y)), y] -= 1
        q *= (mask / total)[:, :, None].astype(np.float32)
        g = {"bias": q.sum((0, 1))}
        k = STATES
        for d in "fb":
            state, out = self.p[f"state_{d}"], self.p[f"out_{d}"]
            d_state, d_out = np.zeros_like(state), np.zeros_like(out)
            d_in = np.empty((*x.shape, 3 * k), np.float32)
            back = np.zeros((x.shape[1], k), np.float32)
            for t, h, z, r, u, n, new in reversed(kept[d]):
                d_out += new.T @ q[t]
                back = back + q[t] @ out.T
                dn = back * (1 - z) * (1 - n**2)
                dz = back * (h - n) * z * (1 - z)
                dr = dn * u * r * (1 - r)
                d_in[t] = np.concatenate([dz, dr, dn], 1)
                ds = np.concatenate([dz, dr, dn * r], 1)
                d_state += h.T @ ds
                back = back * z + ds @ state.T
            flat, at = d_in.reshape(-1, 3 * k), x.ravel()
            g[f"table_{d}"] = np.stack([np.bincount(at, flat[:, j], 256) for j in range(3 * k)], 1).astype(np.float32)
            g[f"state_{d}"], g[f"out_{d}"] = d_state, d_out
        return loss, g


def chunks(raw: bytes) -> np.ndarray:
    """The bytes in rows of CHUNK, filled up with 0."""
    n = -(-len(raw) // CHUNK)
    out = np.zeros(n * CHUNK, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, CHUNK)


def train(texts: list[list[bytes]], y: np.ndarray, labels: list[str], steps: int = 160, batch: int = 320, rate: float = 0.02, seed: int = 5) -> Network:
    """texts: of each text the chunks that may be drawn (its last chunk may be shorter), none empty; y: label numbers."""
    net = Network.new(labels)
    rng = np.random.default_rng(seed)
    count = np.array([len(t) for t in texts])
    first = np.cumsum(count) - count
    left = np.array([len(c) for t in texts for c in t])
    x = np.concatenate([chunks(c) for t in texts for c in t])
    one, two = ({n: np.zeros_like(v) for n, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        doc = rng.integers(0, len(texts), batch)
        at = rng.integers(0, count[doc])
        mask = (np.arange(CHUNK)[:, None] < left[first[doc] + at][None]).astype(np.float32)
        _, g = net.gradients(x[first[doc] + at].T, y[doc], mask)
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))
        for n, v in net.p.items():
            one[n] = 0.9 * one[n] + 0.1 * g[n]
            two[n] = 0.99 * two[n] + 0.01 * g[n] ** 2
            v -= (lr * (one[n] / (1 - 0.9**step)) / (np.sqrt(two[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def drawn() -> Column:
    """The chunks of raw that may be drawn: all, or DRAWS of them picked by the text's digest."""
    n = F.ceil(F.octet_length("raw") / CHUNK).cast("long")
    some = F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), lambda i: F.pmod(F.xxhash64("digest", i), n))
    every = F.sequence(F.lit(0).cast("long"), n - 1)
    return F.transform(F.when(n <= DRAWS, every).otherwise(some), lambda i: F.substring("raw", (i * CHUNK + 1).cast("int"), F.lit(CHUNK)))


def fit_language(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """The driver gets chunks of at most sample_rows documents, the first by the hash of their ids."""
    usable = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("raw") > 0) & ~held_out())
    usable = usable.withColumn("digest", F.sha2("raw", 256))
    keys = ("doc_id", "lang", "digest")
    picked = usable.select(*keys).orderBy(F.xxhash64("doc_id"), *keys).limit(sample_rows)
    of_sample = usable.join(F.broadcast(picked.distinct()), list(keys)).select(*keys, drawn().alias("chunks"))
    rows = sorted((str(r.doc_id), r.lang, [bytes(c) for c in r.chunks]) for r in of_sample.dropDuplicates(list(keys)).collect())
    labels = sorted({r[1] for r in rows})
    if not rows:
        return None
    return train([r[2] for r in rows], np.array([labels.index(r[1]) for r in rows]), labels)


def probabilities(net: Network, raws: list[bytes]) -> np.ndarray:
    """The mean label distribution over all positions of each text; 0 for empty texts."""
    every = [chunks(r) for r in raws]
    doc = np.repeat(np.arange(len(raws)), [len(c) for c in every])
    x = np.concatenate(every) if every else np.zeros((0, CHUNK), np.uint8)
    size = np.array([len(r) for r in raws])
    first = np.cumsum([0] + [len(c) for c in every])[:-1]
    left = np.minimum(size[doc] - (np.arange(len(doc)) - first[doc]) * CHUNK, CHUNK)
    sums = np.zeros((len(raws), len(net.labels)))
    for i in range(0, len(x), AT_ONCE):
        p = net.positions(np.ascontiguousarray(x[i : i + AT_ONCE].T))
        if (left[i : i + AT_ONCE] < CHUNK).any():
            p *= (np.arange(CHUNK)[:, None] < left[i : i + AT_ONCE][None])[:, :, None]
        np.add.at(sums, doc[i : i + AT_ONCE], p.sum(0))
    return sums / np.maximum(size, 1)[:, None]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(1).to_pylist()
            known = [bool(net) and t is not None and any(map(str.isalpha, t)) for t in texts]
            p = probabilities(net, [t.encode() if k else b"" for t, k in zip(texts, known, strict=True)]) if net else None
            best = p.argmax(1) if net else None
            return pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([net.labels[best[i]] if k else "und" for i, k in enumerate(known)]), pa.array([float(min(1.0, p[i, best[i]])) if k else 0.0 for i, k in enumerate(known)])],
                names=["doc_id", "lang_pred", "score"],
            )

        return run

    kind = dict(docs.dtypes)["doc_id"]
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {kind}, lang_pred string, score double").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
