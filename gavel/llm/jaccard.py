"""Operator 9: Jaccard join of 5-word shingle sets with a count-vector R-tree, and its components.

1. Equal sets are one class; a class goes on with its smallest id.
2. Shingles have one global order: by hash, but the COMMON ones (those that a sample of bounded
   size shows in OFTEN documents or more, a list of bounded length) come last, the commoner the later, and before them those
   that would deal more than LARGE documents to one bucket. So buckets of shingles that documents share by chance don't
   grow with the table, and their pairs not with its square. The sample is for the order alone, which any list keeps exact. Sets that reach the threshold
   share a shingle among the first n - ceil(3n/4) + 1 of each, so only those are
   dealt to buckets by shingle; shingles of one document go at once. Where a bucket is found
   to be LARGE its shingle moves back in the order, and its documents are dealt
   again, until no bucket that could be smaller is LARGE.
3. Count vectors (how many of a set's shingles fall into each of GROUPS groups) are
   the points of an R-tree in each bucket. The tree is joined with itself from the root: two
   nodes go on only if they hold different components, their sizes can match, and the sum
   of the coordinate minima of their upper corners can reach the overlap needed. What
   survives is verified on the sets in the same task, the nearest bound of each component first,
   and united there; pairs inside a component are dropped. So a
   task puts out at most one link for each of its documents.
4. First each document meets one bucket, its fullest, in blocks; then a few members of each component of
   a bucket that was cut into blocks meet; then all buckets that still hold different
   components are joined whole. In a bucket of many blocks the rows of its largest component
   are not compared with each other, and each other block meets every block.
   Points go first, and the texts of those documents alone whose points come near enough. Long sets have
   finer groups, and a pair is bounded in the finest that both have; the tree has GROUPS.

Every pair of different components that could link is compared, so the
components are exact. Links, ids and sets stay in tables; the driver gets
counts and the list of common shingles.

Defined results: null and empty texts, and texts without words, have 0 shingles
and link with nothing; equal texts link, ties included; rows with the same doc_id are one
document; a row without doc_id has no component; an empty table gives no rows; a very long text is
one set, held whole by a task; other columns, also those named like this operator's own, are ignored.
Where ids repeat, each differing text of an id is a row with a number of its own
until the links are found, so that buckets and points hold every row once.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import map_slices, slices, small_or_not, stored
from gavel.llm.components import components
from gavel.llm.hashing import mix, shingle_sets

SHINGLE = 5
GROUPS = 128
FANOUT = 8
#: Common shingles that are sent to all tasks at most (9 MB); they affect the order only.
COMMON = 1_000_000
#: Documents in which a shingle is common, and the documents that are counted to find those shingles.
OFTEN, COUNTED = 128, 40_000
#: Documents of a bucket beyond which its shingle moves back in the order.
LARGE = 4_096
#: Documents and shingles of one block of a bucket, and node pairs held at once.
BLOCK_ROWS, BLOCK_SHINGLES, AT_ONCE = 1_024, 1 << 21, 20_000
#: Members that stand for a component of a bucket that was cut into blocks.
STAND_IN = 4
#: Stand-ins meet again if one in so many found a link.
WORTH = 50


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _class_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(s):
        return 0, 0
    a, b = mix(s), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(np.array([a.sum() + np.uint64(len(s))]).view(np.int64)[0]), int(np.array([np.bitwise_xor.reduce(b * np.uint64(3))]).view(np.int64)[0])


def members_of(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, k1, k2) of documents: the sets' sizes and keys."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(part.column(1).to_pylist(), size)
            keys = [_class_keys(s) for s in sets]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64())], names=["doc_id", "n", "k1", "k2"])

        return run

    return map_slices(docs, make, "doc_id long, n long, k1 long, k2 long")


def common_shingles(docs: DataFrame, documents: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles that OFTEN documents or more have, by those of about COUNTED, the commonest COMMON at most; and the place of each in the order: the power of two of its documents, from 2."""
    every = max(1, -(-documents // COUNTED))

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(shingle_sets(part.column(0).to_pylist(), size)), return_counts=True)
            return pa.RecordBatch.from_arrays([_signed(token), pa.array(seen.astype(np.int64))], names=["token", "seen"])

        return run

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    # a shingle of two documents of the sample may be there by chance
    seen = map_slices(some, make, "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= max(3, OFTEN // every))
    found = seen.orderBy(F.desc("seen"), "token").limit(COMMON).select("token", F.log2(F.col("seen") * every / OFTEN).cast("byte").alias("late")).toArrow()
    token = found.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.maximum(found.column("late").to_numpy().astype(np.int8), 0)[order] + np.int8(2)


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _places(x: np.ndarray, known: np.ndarray, late: np.ndarray) -> np.ndarray:
    """late of the entries of x that are in known, else 0."""
    if not len(known) or not len(x):
        return np.zeros(len(x), np.int8)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, late[at], np.int8(0))


def signatures(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int) -> DataFrame:
    """(token, doc, late) of documents (doc_id, text, large): the first shingles of each in the global order, as many as the threshold needs.

    late is 0, 1 for shingles of `large`, 2 and more for common ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        known, place = shared.value

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(part.column(1).to_pylist(), size)
            n = np.array([len(s) for s in sets])
            back = _places(np.concatenate(sets), known, place)
            token, late, count, at = [], [], [], 0
            for i, s in enumerate(sets):
                k = len(s) - -(-3 * len(s) // 4) + 1 if len(s) else 0
                c = back[at : at + len(s)]
                at += len(s)
                large = part.column(2)[i].as_py()
                if large:
                    c = np.maximum(c, _within(s, np.sort(np.array(large, np.int64).view(np.uint64))))
                if c[:k].any():
                    order = np.argsort(c, kind="stable")[:k]
                    s, c = s[order], c[order]
                token.append(s[:k])
                late.append(c[:k])
                count.append(min(k, int(n[i])))
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            return pa.RecordBatch.from_arrays([_signed(np.concatenate(token)), pa.array(np.repeat(ids, count)), pa.array(np.concatenate(late))], names=["token", "doc", "late"])

        return run

    return map_slices(docs, make, "token long, doc long, late byte")


def shared_shingles(rows: DataFrame, moved: DataFrame | None) -> DataFrame:
    """(token, doc, late, n_docs, same): rows whose shingle another document has too.

    same stands for the bucket's members. n_docs is LARGE + 1 for all buckets that are larger, and for the
    shingles `moved`, which only have late rows in the end. Rows stream through in order; at most LARGE and a batch are held.
    """

    def whole(t, d, c):
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        n = np.diff(np.append(head, len(t)))
        mark = np.repeat(c[head] < 0, n)
        same = np.repeat(np.add.reduceat(mix(d.view(np.uint64)), head), n).view(np.int64)
        n = np.repeat(n, n)
        large = mark | (n > LARGE)
        keep = (n > 1) & (c >= 0)
        return out(t[keep], d[keep], c[keep], np.where(large, LARGE + 1, n)[keep], np.where(large, t, same)[keep])

    def out(t, d, c, n, same):
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(d), pa.array(c), pa.array(n.astype(np.int32)), pa.array(same)], names=["token", "doc", "late", "n_docs", "same"])

    def run(batches):
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8))
        held, running = none, None
        for b in chain(batches, [None]):
            t, d, c = (b.column(i).to_numpy() for i in range(3)) if b is not None else none
            if running is not None and len(t):
                k = int(np.searchsorted(t, running, side="right"))
                if k:
                    yield out(t[:k], d[:k], c[:k], np.full(k, LARGE + 1), t[:k])
                running = running if k == len(t) else None
                t, d, c = t[k:], d[k:], c[k:]
            t, d, c = (np.concatenate(x) for x in zip(held, (t, d, c), strict=True))
            last = len(t) if b is None or not len(t) else int(np.searchsorted(t, t[-1]))
            if last:
                yield whole(t[:last], d[:last], c[:last])
            held = t[last:], d[last:], c[last:]
            if len(held[0]) > LARGE:
                keep = held[2] >= 0
                yield out(held[0][keep], held[1][keep], held[2][keep], np.full(int(keep.sum()), LARGE + 1), held[0][keep])
                held, running = none, int(held[0][0])

    if moved is not None:
        rows = rows.unionByName(moved.select("token", F.lit(0).cast("long").alias("doc"), F.lit(-1).cast("byte").alias("late")))
    return rows.repartition("token").sortWithinPartitions("token", "late").mapInArrow(run, "token long, doc long, late byte, n_docs int, same long")


def buckets(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int) -> DataFrame:
    """Stored shared_shingles of documents (doc_id, text), after as many turns as large buckets need."""
    given = docs.withColumn("large", F.lit(None).cast("array<bigint>"))
    moved = own = None
    while True:
        found = stored(shared_shingles(signatures(given, common, size), moved))
        over = found.filter((F.col("n_docs") > LARGE) & (F.col("late") == 0)).select("token", "doc")
        if not over.limit(1).count():
            return found
        # a document's own shingles, so a list is no longer than its text
        own = stored(over if own is None else own.unionByName(over))
        moved = stored(own.select("token").distinct())
        given = docs.join(own.groupBy("doc").agg(F.collect_set("token").alias("large")).withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", "text", "large")


def count_vector(s: np.ndarray) -> tuple[bytes, int]:
    """Counts of the set in each group as bytes, GROUPS of them or, so that chance overlaps stay few, as many times 2 as give four to a group; counts over 255 are halved upwards so many times."""
    bits = max(GROUPS.bit_length() - 1, (len(s) // 4 - 1).bit_length() if len(s) > 4 else 0)
    c = np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    shift = max(0, int(c.max(initial=0)).bit_length() - 8)
    c = (c + (1 << shift) - 1) >> shift
    if c.max(initial=0) > 255:
        shift += 1
        c = (c + 1) >> 1
    return c.astype(np.uint8).tobytes(), shift


def points(docs: DataFrame, size: int) -> DataFrame:
    """(doc, n, vec, shift) of each document."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(part.column(1).to_pylist(), size)
            vecs = [count_vector(s) for s in sets]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([v for v, _ in vecs], pa.binary()), pa.array([k for _, k in vecs], pa.int32())], names=["doc", "n", "vec", "shift"])

        return run

    return map_slices(docs, make, "doc long, n int, vec binary, shift int")


def _counts(vec: bytes, shift: int, groups: int) -> np.ndarray:
    """The counts in so many groups; those of finer groups are summed."""
    return np.frombuffer(vec, np.uint8).astype(np.uint32).reshape(groups, -1).sum(1) << shift


def bounds(vecs: list[bytes], shift: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of pairs: summed minima in the finest groups that both ends have."""
    groups = np.array([len(v) for v in vecs])
    level, out = np.minimum(groups[a], groups[b]), np.zeros(len(a), np.int64)
    for g in np.unique(level).tolist():
        at = np.flatnonzero(level == g)
        own, where = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        counts = np.stack([_counts(vecs[i], int(shift[i]), g) for i in own.tolist()])
        counts = counts.astype(np.uint8) if counts.max(initial=0) < 256 else counts
        x, y = where[: len(at)], where[len(at) :]
        for s in range(0, len(at), AT_ONCE):
            out[at[s : s + AT_ONCE]] = np.minimum(counts[x[s : s + AT_ONCE]], counts[y[s : s + AT_ONCE]]).sum(1, dtype=np.int64)
    return out


def tree_join(vec: np.ndarray, n: np.ndarray, comp: np.ndarray, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components (and blocks, if given) whose bound reaches the overlap needed."""
    # a component of one row is no use as a group
    many = np.unique(comp, return_inverse=True, return_counts=True)
    order = np.lexsort((n, np.where(many[2][many[1]] > 1, comp, -1)))
    levels = [(vec[order], n[order], n[order], comp[order], comp[order])]
    while len(levels[-1][0]) > 1:
        hi, low, top, c0, c1 = levels[-1]
        at = np.arange(0, len(hi), FANOUT)
        levels.append((np.maximum.reduceat(hi, at), np.minimum.reduceat(low, at), np.maximum.reduceat(top, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    out_a, out_b = [], []
    while todo:
        level, i, j = todo.pop()
        if len(i) > AT_ONCE:
            todo += [(level, i[:AT_ONCE], j[:AT_ONCE]), (level, i[AT_ONCE:], j[AT_ONCE:])]
            continue
        hi, low, top, c0, c1 = levels[level]
        keep = ((c0[i] != c1[j]) | (c1[i] != c0[j])) & (100 * top[i] >= 75 * low[j]) & (100 * top[j] >= 75 * low[i])
        i, j = i[keep], j[keep]
        if len(i):
            keep = 7 * np.minimum(hi[i], hi[j]).sum(1) >= 3 * (low[i] + low[j])
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            a, b = order[i], order[j]
            if block is not None:
                a, b = a[block[a] != block[b]], b[block[a] != block[b]]
            out_a.append(a)
            out_b.append(b)
            continue
        size = len(levels[level - 1][0])
        ci = (i[:, None] * FANOUT + np.arange(FANOUT))[:, :, None]
        cj = (j[:, None] * FANOUT + np.arange(FANOUT))[:, None, :]
        ok = (ci < size) & (cj < size) & ((i != j)[:, None, None] | ((ci < cj) if level == 1 else (ci <= cj)))
        ci, cj = np.broadcast_to(ci, ok.shape)[ok], np.broadcast_to(cj, ok.shape)[ok]
        todo.append((level - 1, ci, cj))
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _overlaps(sets: list[np.ndarray]):
    """A function of pairs (a, b) that gives the sizes of their common parts."""
    if len(sets) < 8:
        return lambda a, b: np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum([0] + [len(s) for s in sets])
    own = [flat[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]
    has = np.zeros(len(names), bool)

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        order = np.argsort(a, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]]))
        for s, e in zip(head.tolist(), [*head[1:].tolist(), len(a)], strict=True):
            has[own[a[order[s]]]] = True
            for k in order[s:e].tolist():
                out[k] = np.count_nonzero(has[own[b[k]]])
            has[own[a[order[s]]]] = False
        return out

    return run


def _rank_in(label: np.ndarray) -> np.ndarray:
    """The place of each entry among those of the same label, in the given order."""
    order = np.argsort(label, kind="stable")
    sorted_ = label[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    out = np.empty(len(label), np.int64)
    out[order] = np.arange(len(label)) - np.repeat(head, np.diff(np.append(head, len(label))))
    return out


def united(a: np.ndarray, b: np.ndarray, bound: np.ndarray, n: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links among the candidate pairs (a, b): as many as it takes to unite every two components that a pair links.

    Each turn verifies the candidates with the nearest bound of each component, one of each first and then twice as many in a turn;
    a pair whose ends are in one component by then is dropped.
    """
    order = np.argsort(-bound, kind="stable")
    a, b = a[order], b[order]
    parent = np.unique(comp, return_inverse=True)[1].astype(np.int64)
    parent, label = np.arange(int(parent.max(initial=-1)) + 1), parent
    common, most, out = None, 1, []
    while len(a):
        ca, cb = label[a], label[b]
        pick = (_rank_in(ca) < most) | (_rank_in(cb) < most)
        i, j = a[pick], b[pick]
        common = common or _overlaps(sets)
        both = common(i, j)
        good = 100 * both >= 75 * (n[i] + n[j] - both)
        for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
            p, q = label[x], label[y]
            while parent[p] != p:
                p = parent[p]
            while parent[q] != q:
                q = parent[q]
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
        a, b = a[~pick], b[~pick]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        most *= 2
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


KEY = ["key", "bi", "bj"]


def joined(places: DataFrame, known: DataFrame, texts: DataFrame | None, size: int) -> DataFrame:
    """R-tree joins of the documents placed (key, bi, bj, doc, comp, side): all of one key, or the two sides if bi and bj differ.

    With texts (doc, text) the links (a, b) that unite components, else the places of documents that have a candidate at all.
    """
    sent, first = places.join(known, "doc"), texts is None
    if not first:
        sent = sent.join(texts, "doc")

    def work(t: pa.Table) -> pa.RecordBatch | None:
        n, comp, side, shift = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "comp", "side", "shift"))
        if len(n) < 2 or comp.min() == comp.max():
            return None
        vecs = t.column("vec").to_pylist()
        vec = np.stack([_counts(v, int(k), GROUPS) for v, k in zip(vecs, shift, strict=True)]).astype(np.float32)
        cross = t.column("bi")[0].as_py() != t.column("bj")[0].as_py()
        a, b = tree_join(vec, n, comp, side if cross else None)
        bound = bounds(vecs, shift, a, b)
        near = 7 * bound >= 3 * (n[a] + n[b])
        a, b, bound = a[near], b[near], bound[near]
        if not len(a):
            return None
        if first:
            return t.take(pa.array(np.unique(np.concatenate([a, b])))).select([*KEY, "doc", "comp", "side"]).combine_chunks().to_batches()[0]
        a, b = united(a, b, bound / (n[a] + n[b]), n, comp, shingle_sets(t.column("text").to_pylist(), size))
        doc = t.column("doc").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(doc[b])], names=["a", "b"]) if len(a) else None

    def run(batches):
        held: list[pa.RecordBatch] = []

        def ends(t: pa.Table) -> np.ndarray:
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in KEY], 1)
            return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))

        for b in chain(batches, [None]):
            if b is not None:
                held.append(b)
                if b.num_rows == 0 or all(b.column(c)[0] == b.column(c)[b.num_rows - 1] == held[0].column(c)[0] for c in range(3)):
                    continue  # the key goes on
            t = pa.Table.from_batches(held, held[0].schema) if held else None
            if t is None or not t.num_rows:
                continue
            cut = ends(t)
            stop = len(cut) - 1 if b is None else len(cut) - 2
            for s, e in zip(cut[:stop].tolist(), cut[1 : stop + 1].tolist(), strict=True):
                out = work(t.slice(s, e - s))
                if out is not None:
                    yield out
            held = t.slice(int(cut[stop])).combine_chunks().to_batches()

    shape = "key long, bi int, bj int, doc long, comp long, side int" if first else "a long, b long"
    return sent.select(*KEY, "doc", "comp", "side", "n", "vec", "shift", *[] if first else ["text"]).repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, shape)


def linked(places: DataFrame, known: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Stored links (a, b) of the places: points meet first, then the texts of those that come near enough."""
    near = stored(joined(places, known, None, size))
    texts = texts.join(small_or_not(stored(near.select("doc").distinct())), "doc", "left_semi")
    return stored(joined(near, known, texts, size))


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _block(seed: int, blocks: str | Column) -> Column:
    return F.pmod(F.xxhash64("doc", F.lit(seed)), blocks if isinstance(blocks, Column) else F.col(blocks)).cast("int")


def alone(rows: DataFrame, blocks: str, seed: int) -> DataFrame:
    """Places of rows (token, doc, comp) in blocks that don't meet."""
    return rows.withColumn("bi", _block(seed, blocks)).select(F.col("token").alias("key"), "bi", F.col("bi").alias("bj"), "doc", "comp", F.lit(0).alias("side"))


def banded(rows: DataFrame) -> DataFrame:
    """rows (key, doc, comp, n) with keys of more than a block cut by set size: sets that can link are in one band or in neighbours, so a row goes to two."""
    large = stored(rows.groupBy("key").count().filter(F.col("count") > BLOCK_ROWS).select("key"))
    band = F.floor(F.log("n") / F.log(F.lit(1.34)))
    cut = rows.join(small_or_not(large), "key", "left_semi").withColumn("band", F.explode(F.array(band, band + 1)))
    cut = cut.select(F.xxhash64("key", "band").alias("key"), "doc", "comp", "n")
    return rows.join(small_or_not(large), "key", "left_anti").unionByName(cut)


def whole(rows: DataFrame) -> DataFrame:
    """Places of rows (key, doc, comp, n) so that every two of a key in different components meet.

    Blocks of the largest component's rows come after those of the rest and don't meet each other.
    """
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    sums = parts.groupBy("key").agg(F.max(F.struct("m", "w", "comp")).alias("big"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.count("*").alias("comps")).filter("comps > 1")
    sums = sums.select("key", F.col("big.comp").alias("big"), F.when(_blocks(F.col("m"), F.col("w")) == 1, 0).otherwise(_blocks(F.col("big.m"), F.col("big.w"))).alias("nb"), _blocks(F.col("m") - F.col("big.m"), F.col("w") - F.col("big.w")).alias("nr"))
    own = rows.join(small_or_not(stored(sums)), "key")
    in_big = (F.col("nb") > 0) & (F.col("comp") == F.col("big"))
    own = own.withColumn("block", F.when(F.col("nb") == 0, 0).when(in_big, F.col("nr") + _block(0, "nb")).otherwise(_block(0, "nr")))
    meets = F.when(F.col("nb") == 0, F.array(F.lit(0))).when(in_big, F.sequence(F.lit(0), F.col("nr") - 1)).otherwise(F.sequence(F.lit(0), F.col("nr") + F.col("nb") - 1))
    out = own.select("key", "doc", "comp", "block", F.explode(meets).alias("other"))
    return out.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "doc", "comp", (F.col("block") > F.col("other")).cast("int").alias("side"))


def _named(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with comp: the component of doc by the links."""
    own = stored(components(links))
    cols = [c for c in rows.columns if c != "comp"]
    return rows.join(small_or_not(own), rows["doc"] == own["id"], "left").select(*[rows[c] for c in cols], F.coalesce("component", "doc").alias("comp"))


def _open(rows: DataFrame) -> DataFrame:
    """rows of buckets (token) that hold more than one component."""
    many = rows.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1").select("token")
    return stored(rows.join(small_or_not(stored(many)), "token", "left_semi"))


def links_of(found: DataFrame, known: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links (a, b) that unite all components, of the buckets `found`, the documents' points `known` and their texts (doc, text)."""
    # of buckets with the same members one is enough
    rows = found.groupBy("doc", "same", "n_docs").agg(F.min("token").alias("token")).join(known.select("doc", "n"), "doc")
    sums = rows.groupBy("token").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.min("doc").alias("low")).select("token", "m", "low", _blocks(F.col("m"), F.col("w")).alias("blocks"))
    rows = stored(rows.select("token", "doc", "n").join(sums, "token"))

    fullest = rows.groupBy("doc").agg(F.max(F.struct("m", "token", "blocks")).alias("x")).select(F.col("x.token").alias("token"), "doc", F.col("doc").alias("comp"), F.col("x.blocks").alias("blocks"))
    links = linked(alone(fullest, "blocks", 0), known, texts, size)
    rows = _open(_named(rows, links))
    turn = 0
    while True:
        turn += 1
        # members of the components of buckets that were cut meet, as long as that unites some; what is left is compared whole below
        cut = rows.filter("blocks > 1")
        least = [F.min(F.struct(F.xxhash64("doc", F.lit(100 * turn + i)).alias("h"), "doc", "n")).alias(f"x{i}") for i in range(STAND_IN)]
        few = cut.groupBy("token", "comp").agg(*least).select("token", "comp", F.explode(F.array(*[f"x{i}" for i in range(STAND_IN)])).alias("x")).select("token", "comp", "x.doc", "x.n").distinct()
        few = stored(few)
        sums = few.groupBy("token").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
        more = linked(alone(few.join(sums, "token"), "blocks", turn), known, texts, size)
        links = links.unionByName(more)
        rows = _open(_named(rows, links))
        if more.count() * WORTH <= few.count():
            break
    # buckets with the same lowest member are one, so that a document is sent once for all of them
    return links.unionByName(linked(whole(banded(stored(rows.select(F.col("low").alias("key"), "doc", "comp", "n").distinct()))), known, texts, size))


def _components_of(docs: DataFrame, size: int) -> DataFrame:
    """similar_components of rows (doc_id, text) whose ids differ; some may be null."""
    members = stored(members_of(docs, size))
    common = common_shingles(docs, members.count(), size)
    classes = stored(members.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc")))
    idle = members.select("doc_id").distinct().join(classes.select(F.col("doc").alias("doc_id")), "doc_id", "left_anti")
    unique = docs.filter(F.col("doc_id").isNotNull()).join(small_or_not(stored(idle)), "doc_id", "left_anti").select("doc_id", "text")

    found = buckets(unique, common, size)
    active = stored(found.select(F.col("doc").alias("doc_id")).distinct())
    known = stored(points(unique.join(small_or_not(active), "doc_id", "left_semi"), size))
    final = components(links_of(found, known, unique.withColumnRenamed("doc_id", "doc"), size))

    named = members.join(classes, ["k1", "k2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("doc")).alias("doc"))
    named = named.join(final, named["doc"] == final["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc", "doc_id").alias("own"))
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("own")).alias("component_id"))


def similar_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id that links of similarity 3/4 or more reach)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = stored(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not again.limit(1).count():
        return _components_of(docs, size)
    ids = small_or_not(again)
    rows = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    rows = rows.unionByName(docs.join(ids, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies")))
    rows = stored(rows.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    found = stored(_components_of(rows.select(F.col("row").alias("doc_id"), "text"), size))
    named = stored(rows.select("row", "doc_id", "copies").join(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("own")), "row").drop("row"))
    # rows of one id are one document
    ties = named.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("own").alias("a"), F.collect_set("own").alias("b")).select("a", F.explode("b").alias("b"))
    united = components(ties)
    named = stored(named.join(united, named["own"] == united["id"], "left").select("doc_id", "n_shingles", "copies", F.coalesce("component", "own").alias("own")))
    out = named.join(named.groupBy("own").agg(F.min("doc_id").alias("component_id")), "own")
    out = out.select("doc_id", "n_shingles", "component_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
    return out.unionByName(found.filter(F.col("doc_id").isNull()))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) k FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d)
SELECT w.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d doc_id, min(c) c FROM r GROUP BY 1) m USING (doc_id)
"""
