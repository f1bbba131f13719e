"""Operator 2: removal of repeated byte strings by suffix arrays of shards.

A byte is removed if it is in a string of WINDOW bytes that also starts earlier
(in a document of smaller id, or earlier in its own), judged on the input.

1. Of equal documents only that of the smallest id goes on; others are
   removed whole (if they have WINDOW bytes).
2. Winnowing picks anchors: grams of GRAM bytes such that each string of WINDOW
   bytes holds the anchor that depends on that string alone. So equal strings
   have equal anchors at the same place, and are found among the contexts (the
   bytes from which a string can reach an anchor) of equal anchors. Anchors that
   occur once, in all the corpus, go.
3. Equal contexts of an anchor are pre-aggregated: all but the first are removed.
4. What is left, the differing contexts of equal anchors, is dealt into shards by anchor. Each shard gets a
   suffix array by induced sorting (classify, sort leftmost-smaller substrings
   recursively, induce) and permuted common prefixes; in a run of suffixes that share WINDOW bytes
   all but the first are removed.
5. An anchor with more than CONTEXTS contexts is too much for one shard; its strings are
   grouped by their hash over all tasks instead, with the same result.

Lists that are sent to all tasks are counted first (SENT at most); longer ones
are joined. Defined results: null or empty texts have 0 bytes; equal rows of one
id are one document and give equal rows; different texts of one id are ordered
by their hash (so ties have one order); a null id counts as the largest; an empty table gives no rows; a very long text is
cut into contexts as any other; other columns are ignored, or passed through where asked for, also those named like this operator's own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import map_slices, small_or_not, stored
from gavel.llm.suffixes import anchors, permuted_lcp, suffix_array

WINDOW, GRAM = 100, 48
#: Contexts of one anchor in a shard; hashes sent to all tasks; bytes of a shard.
CONTEXTS, SENT, SHARD = 16_384, 4_000_000, 1 << 19
LAST = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """key (the id, null as the largest) and text_hash tell documents apart and order them."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _found(part: pa.RecordBatch, window: int, gram: int):
    """Anchors of a slice (key, text_hash, text): row, hash, context's start and end in the text, and the slice's bytes."""
    raws = [t.encode() for t in part.column(2).to_pylist()]
    ends = np.cumsum([len(r) for r in raws])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    raw = b"".join(raws)
    # empty texts would share their start with the next one
    full = np.flatnonzero(ends > starts)
    at, h = anchors(np.frombuffer(raw, np.uint8), starts[full], ends[full], window, gram) if len(full) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    row = full[np.searchsorted(starts[full], at, side="right") - 1] if len(at) else np.zeros(0, np.int64)
    first, last = np.maximum(at - (window - gram), starts[row]), np.minimum(at + window, ends[row])
    return row, h.view(np.int64), first, last, starts, raw


def _pick(known, h: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array that was sent; all if none was."""
    if known is None:
        return np.ones(len(h), bool)
    k = known.value
    if not len(k):
        return np.zeros(len(h), bool)
    return k[np.minimum(np.searchsorted(k, h), len(k) - 1)] == h


def _sent(df: DataFrame, column: str):
    """A sorted array of the column for all tasks, or None if there are too many values."""
    if df.limit(SENT + 1).count() > SENT:
        return None
    return df.sparkSession.sparkContext.broadcast(np.sort(df.select(column).toArrow().column(0).to_numpy()))



def anchor_counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(hash, n): anchors that occur more than once."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            h, n = np.unique(_found(part, window, gram)[1], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2).astype(np.int32))], names=["hash", "n"])

        return run

    return map_slices(docs, make, "hash long, n int").groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash")


def contexts(docs: DataFrame, window: int, gram: int, known, wanted=None) -> DataFrame:
    """(hash, ctx, key, text_hash, start, bytes) of the contexts of known anchors; with wanted, of those contexts only, and raw."""
    raw_too = wanted is not None

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            row, h, first, last, starts, raw = _found(part, window, gram)
            keep = _pick(known, h)
            row, h, first, last = row[keep], h[keep], first[keep], last[keep]
            ctx = np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64).view(np.int64)
            if raw_too and wanted.value is not None:
                keep = _pick(wanted, h ^ ctx)
                row, h, first, last, ctx = row[keep], h[keep], first[keep], last[keep], ctx[keep]
            at = pa.array(row)
            cols = [pa.array(h), pa.array(ctx), part.column(0).take(at), part.column(1).take(at), pa.array(first - starts[row]), pa.array((last - first).astype(np.int32))]
            names = ["hash", "ctx", "key", "text_hash", "start", "bytes"]
            if raw_too:
                cols.append(pa.array([raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()))
                names.append("raw")
            return pa.RecordBatch.from_arrays(cols, names=names)

        return run

    return map_slices(docs, make, "hash long, ctx long, key long, text_hash long, start long, bytes int" + ", raw binary" * raw_too)


class _All:
    value = None


def shard_spans(t: np.ndarray, size: np.ndarray, rank: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to) to be removed: strings of a shard's contexts that also start earlier, by (rank, start).

    t, size: the contexts' bytes, one after the other, and how many each has.
    """
    none = (np.zeros(0, np.int64),) * 3
    ends = np.cumsum(size)
    if len(t) < 2:
        return none
    sa = suffix_array(t)
    run = np.cumsum(permuted_lcp(t, sa, window)[sa] < window, dtype=np.int32)
    own = np.repeat(np.arange(len(size), dtype=np.int32), size)
    valid = (ends[own] - np.arange(len(t)) >= window)[sa]
    sa, run = sa[valid], run[valid]
    if not len(sa):
        return none
    begins = ends - size
    c = own[sa]
    place = (rank[c] << 40) + (start - begins)[c] + sa
    new = run[1:] != run[:-1]
    least = np.minimum.reduceat(place, np.flatnonzero(np.concatenate([[True], new])))[np.cumsum(np.concatenate([[False], new]), dtype=np.int32)]
    gone = np.sort(sa[place > least])
    if not len(gone):
        return none
    cut = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (own[gone[1:]] != own[gone[:-1]]), [True]])
    a, b = gone[cut[:-1]], gone[cut[1:]]
    c = own[a]
    shift = (start - begins)[c]
    return c, shift + a, shift + b + window


SPANS = "key long, text_hash long, s long, e long"


def by_suffix_array(rows: DataFrame, window: int) -> DataFrame:
    """Spans found in shards: contexts are dealt by anchor, and a shard ends between two anchors."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        key, text, start = (rows.column(c).to_numpy() for c in ("key", "text_hash", "start"))
        order = np.lexsort((text, key))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])]))
        raws = rows.column("raw").cast(pa.large_binary()).combine_chunks()
        edges = np.frombuffer(raws.buffers()[1], np.int64)[raws.offset : raws.offset + len(raws) + 1]
        t = np.frombuffer(raws.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        c, s, e = shard_spans(t, np.diff(edges), rank, start, window)
        return pa.RecordBatch.from_arrays([pa.array(key[c]), pa.array(text[c]), pa.array(s), pa.array(e)], names=["key", "text_hash", "s", "e"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            bytes_before = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(4)).to_numpy(), dtype=np.int64)])
            firsts = np.flatnonzero(np.concatenate([[last is None or h[0] != last], h[1:] != h[:-1]]))
            at = 0
            for i in firsts.tolist():
                if size + bytes_before[i] - bytes_before[at] > SHARD:
                    yield work([*held, b.slice(at, i - at)])
                    held, size, at = [], 0, i
            held.append(b.slice(at))
            size += bytes_before[-1] - bytes_before[at]
            last = h[-1]
        if held:
            yield work(held)

    return rows.select("hash", "key", "text_hash", "start", "raw").repartition("hash").sortWithinPartitions("hash").mapInArrow(run, SPANS)


def by_windows(rows: DataFrame, window: int) -> DataFrame:
    """The same spans for anchors with very many contexts: equal strings meet by their hash, summed up before the shuffle."""
    at = rows.select("key", "text_hash", "start", "raw", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - window)).alias("o"))
    text = F.substring("raw", F.col("o") + 1, F.lit(window))
    at = stored(at.select("key", "text_hash", (F.col("start") + F.col("o")).alias("s"), F.xxhash64(text).alias("w1"), F.xxhash64(F.lit(1), text).alias("w2")).distinct())
    first = at.groupBy("w1", "w2").agg(F.min(F.struct("key", "text_hash", "s")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("w1", "w2", "first")
    return at.join(first, ["w1", "w2"]).filter(F.struct("key", "text_hash", "s") != F.col("first")).select("key", "text_hash", "s", (F.col("s") + window).alias("e"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = CONTEXTS) -> DataFrame:
    """(key, text_hash, spans) of each document of which something is removed; spans: byte ranges (s, e) that may touch or overlap."""
    docs = keyed(docs)
    sized = docs.select("key", "text_hash", F.xxhash64(F.lit(1), "text").alias("more_hash"), F.octet_length("text").cast("long").alias("n")).filter(F.col("n") >= window).distinct()
    sized = stored(sized)
    same = ["text_hash", "more_hash", "n"]
    firsts = sized.groupBy(*same).agg(F.min("key").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select(*same, "first")
    copies = stored(sized.join(firsts, same).filter("key != first").select("key", "text_hash", F.lit(0).cast("long").alias("s"), F.col("n").alias("e")))
    unique = docs.select("key", "text_hash", "text").filter(F.octet_length("text") >= window).join(small_or_not(copies.select("key", "text_hash")), ["key", "text_hash"], "left_anti")

    counted = stored(anchor_counts(unique, window, gram))
    known = _sent(counted, "hash")
    found = contexts(unique, window, gram, known)
    if known is None:
        found = found.join(counted, "hash", "left_semi")
    found = stored(found)
    each = found.groupBy("hash", "ctx").agg(F.min(F.struct("key", "text_hash", "start")).alias("first"), F.count("*").alias("n"))
    each = stored(each)
    later = found.join(each.filter("n > 1").select("hash", "ctx", "first"), ["hash", "ctx"]).filter(F.struct("key", "text_hash", "start") != F.col("first"))
    later = later.select("key", "text_hash", F.col("start").alias("s"), (F.col("start") + F.col("bytes")).alias("e"))

    sizes = each.groupBy("hash").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    differing = stored(each.join(sizes, "hash").select("hash", "ctx", F.col("first.key").alias("key"), F.col("first.text_hash").alias("text_hash"), F.col("first.start").alias("start"), "contexts"))
    wanted = _sent(differing.select(F.col("hash").bitwiseXOR(F.col("ctx")).alias("x")).distinct(), "x")
    raw = contexts(unique, window, gram, known, wanted or _All).join(differing, ["hash", "ctx", "key", "text_hash", "start"]).dropDuplicates(["hash", "ctx", "key", "text_hash", "start"])
    raw = stored(raw)
    spans = copies.unionByName(later).unionByName(by_suffix_array(raw.filter(F.col("contexts") <= most), window))
    if raw.filter(F.col("contexts") > most).limit(1).count():
        spans = spans.unionByName(by_windows(raw.filter(F.col("contexts") > most), window))
    return spans.groupBy("key", "text_hash").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in runs:
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, window: int = WINDOW, gram: int = GRAM, most: int = CONTEXTS) -> DataFrame:
    """Per document the input's `columns` (default doc_id), the text that is left, n_bytes, n_removed, n_spans, kept_sha256.

    The kept bytes may begin or end inside a character; the text leaves such parts out, the digest has all kept bytes.
    """
    columns = columns or ["doc_id"]
    spans = repeated_spans(docs, window, gram, most)
    others = [c for c in columns if c not in ("doc_id", "text")]
    # the input's columns may have any name, so they go by their place here
    hidden = [f"_o{i}" for i in range(len(others))]
    own = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(others, hidden, strict=True)], "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), "text")
    joined = own.join(spans, (own["_key"] == spans["key"]) & (own["_hash"] == spans["text_hash"]), "left").select("doc_id", *hidden, "spans", "text")
    kinds = dict(docs.dtypes)
    names = ["doc_id", *hidden, "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            k = 1 + len(others)
            texts, n, gone, runs, sha = [], [], [], [], []
            for spans, text in zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist(), strict=True):
                raw = (text or "").encode()
                cut = merged(spans)
                left = kept(raw, cut)
                texts.append(text if not cut else left.decode("utf-8", "ignore"))
                n.append(len(raw))
                gone.append(len(raw) - len(left))
                runs.append(len(cut))
                sha.append(hashlib.sha256(left).hexdigest())
            return pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)], names=names)

        return run

    schema = ", ".join([f"doc_id {kinds['doc_id']}", *[f"{h} {kinds[c]}" for c, h in zip(others, hidden, strict=True)], "text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    out = map_slices(joined, make, schema)
    return out.select("doc_id", *[F.col(h).alias(c) for c, h in zip(others, hidden, strict=True)], *[c for c in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256") if c not in others])
