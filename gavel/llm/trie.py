"""Operator 13: the prefix trie of conversations, summed over subtrees by heavy-path decomposition.

1. Turns become (hash, code points). A task reads each rebuilt conversation's turns in order and gives a row for each prefix: its
   node, whose hash is that of its parent and its last turn. Nodes are counted with partial sums, so the root and common first turns are not hot.
2. Heavy paths: each node's largest child (most conversations, then greatest hash) continues its path, other children begin
   one. A path's nodes learn its head by pointer jumping: each round doubles the length of the known links, and only nodes whose link is not yet at
   a head are joined again. A path also ends after PATH nodes, so a conversation of any length makes arrays of bounded size.
3. A path is one row of arrays. Paths without unfinished paths below them are suffix-summed along their arrays; their heads' totals are
   summed by (path, place) and added to the paths above. A light child has at most half of its parent's conversations, so a
   logarithmic number of rounds is enough (and one for each PATH nodes of depth).
4. Ids of conversations that end at a node are sorted by ranges of (node, id), joined to pieces of bounded size where they lie, and a
   node's digest is updated with its pieces in order, so a node where a third of all conversations end is no large group.

A parent's row reaches its children by (parent, salt), so that the root's many children are spread. Lookups along heavy links are one to one.

Defined results: null turns come first, turns of the same number are ordered by role and hash of the text; a null role or text is empty;
rows of a null conv_id belong to no conversation; a conversation without turns ends at the root; equal turns in a row are nodes of their own; an empty
table has no nodes; long texts are hashed whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import batch_of, stored
from gavel.llm.repair import crc32_sql

#: Nodes of a path at most; a longer one goes on as another path.
PATH = 16_384
SALTS = 64
#: Characters of a piece of a list of ids.
PIECE = 32_000
PREFIXES = "conv_id long, depth long, node binary, parent binary, chars long, ends long"
SUMS = "node binary, n_leaves long, saved_tokens long"
PATHS = "head binary, nodes array<binary>, leaves array<long>, saved array<long>, up binary, place long, waits long"
HEADS = "up binary, place long, leaves long, saved long"
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, source, turn, role, hash, chars, skip): every conversation's head from the one that its hundred begins with, then its own turns, of which the first skip are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("hash"), F.char_length(text).cast("long").alias("chars")).filter("conv_id is not null")
    ids = turns.select("conv_id").distinct().withColumn("skip", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("long"))
    first = Window.partitionBy("base").orderBy("turn", "role", "hash")
    heads = turns.filter("conv_id % 100 = 0").withColumnRenamed("conv_id", "base").withColumn("place", F.row_number().over(first)).filter("place <= 5")
    copied = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base").filter("place <= skip")
    columns = ("conv_id", "source", "turn", "role", "hash", "chars")
    none = F.lit(None)
    marks = ids.select("conv_id", F.lit(0).alias("source"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("hash"), none.cast("long").alias("chars"))
    return copied.withColumn("source", F.lit(1)).select(*columns).union(turns.withColumn("source", F.lit(2)).select(*columns)).union(marks)


def plain(conversations: DataFrame) -> DataFrame:
    """The same rows for conversations as they are, without another's head."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(3).alias("source"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("hash"), F.char_length(text).cast("long").alias("chars"))
    return turns.filter("conv_id is not null")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one conversation after another, its head first: a row for each node on its way. A row is put out when the next one shows whether it is the last."""
    import zlib

    at, skip, row, out = None, 0, None, []
    for batch in batches:
        for conv_id, source, _, role, turn, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv_id != at:
                if row:
                    out.append((*row, 1))
                at, skip, row = conv_id, zlib.crc32(str(conv_id).encode()) % 6, (conv_id, 0, ROOT, None, 0)
            if source == 0:
                continue
            if source == 2 and skip:
                skip -= 1
                continue
            raw = role.encode()
            node = hashlib.blake2b(row[2] + len(raw).to_bytes(8, "big") + raw + turn, digest_size=16).digest()
            out.append((*row, 0))
            row = (conv_id, row[1] + 1, node, row[2], chars)
        if len(out) >= 20_000:
            yield batch_of(out, PREFIXES)
            out = []
    if row:
        out.append((*row, 1))
    if out:
        yield batch_of(out, PREFIXES)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows to (node, first, joined ids) of bounded size."""
    schema = "node binary, first long, ids string"
    node, first, held, size, out, total = None, 0, [], 0, [], 0
    for batch in batches:
        for n, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (n != node or size > PIECE):
                out.append((node, first, ",".join(held)))
                held, size, total = [], 0, total + size
            if not held:
                node, first = n, conv_id
            held.append(str(conv_id))
            size += len(held[-1]) + 1
            if len(out) >= 5000 or total > 1 << 20:
                yield batch_of(out, schema)
                out, total = [], 0
    if held:
        out.append((node, first, ",".join(held)))
    if out:
        yield batch_of(out, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one node after another, in order, to the digest of all its ids."""
    schema = "node binary, ends_sha256 string"
    node, sha, out = None, None, []
    for batch in batches:
        for n, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if n != node:
                if sha:
                    out.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(out) >= 20_000:
            yield batch_of(out, schema)
            out = []
    if sha:
        out.append((node, sha.hexdigest()))
    if out:
        yield batch_of(out, schema)


def heads_of(nodes: DataFrame) -> DataFrame:
    """(node, head) for nodes (node, parent, is_head): pointer jumping along the heavy links."""
    links = stored(nodes.select("node", F.when(F.col("is_head"), F.col("node")).otherwise(F.col("parent")).alias("at"), F.col("is_head").alias("done")))
    known = links.filter("done").select("node", "at")
    open_ = links.filter("not done").select("node", "at")
    while not open_.isEmpty():
        to = known.select(F.col("node").alias("at"), F.col("at").alias("next"), F.lit(True).alias("done")).union(open_.select(F.col("node"), F.col("at"), F.lit(False)))
        jumped = stored(open_.join(to, "at").select("node", F.col("next").alias("at"), "done"))
        known, open_ = known.union(jumped.filter("done").select("node", "at")), jumped.filter("not done").select("node", "at")
    return known.withColumnRenamed("at", "head")


def _summed(batches: Iterator[pa.RecordBatch], heads: bool) -> Iterator[pa.RecordBatch]:
    """Suffix sums along path arrays: the totals of all nodes, or of heads alone with the place above that they go to."""
    for batch in batches:
        out = []
        for nodes, leaves, saved, up, place in zip(*(batch.column(c).to_pylist() for c in ("nodes", "leaves", "saved", "up", "place")), strict=True):
            if heads:
                if up is not None:
                    out.append((up, place, sum(leaves), sum(saved)))
            else:
                sums = [np.cumsum(np.array(x[::-1], np.int64))[::-1].tolist() for x in (leaves, saved)]
                out += zip(nodes, *sums, strict=True)
            if len(out) >= 20_000:
                yield batch_of(out, HEADS if heads else SUMS)
                out = []
        if out:
            yield batch_of(out, HEADS if heads else SUMS)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What finished paths below give to the nodes of a path is added to its arrays."""
    for batch in batches:
        new = {}
        for c in ("leaves", "saved"):
            new[c] = []
            for own, places, more in zip(*(batch.column(x).to_pylist() for x in (c, "more_place", f"more_{c}")), strict=True):
                sums = np.array(own, np.int64)
                np.add.at(sums, np.array(places or [], np.int64), np.array(more or [], np.int64))
                new[c].append(sums)
        cols = {c: pa.array(new[c], pa.list_(pa.int64())) if c in new else batch.column(c) for c in (f.split()[0] for f in PATHS.split(", "))}
        yield pa.RecordBatch.from_pydict(cols)


def subtree_sums(paths: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) over subtrees; paths: head, nodes, leaves, saved (arrays down the path), up (head of the path above, null for the root), place (in it)."""
    below = paths.filter("up is not null").groupBy("up").agg(F.count("*").alias("waits")).withColumnRenamed("up", "head")
    open_ = stored(paths.join(below, "head", "left").withColumn("waits", F.coalesce("waits", F.lit(0))))
    done = None
    while not open_.isEmpty():
        ready = open_.filter("waits = 0")
        sums = ready.mapInArrow(lambda b: _summed(b, False), SUMS)
        done = sums if done is None else done.union(sums)
        totals = ready.mapInArrow(lambda b: _summed(b, True), HEADS)
        by_place = totals.groupBy("up", "place").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n"))
        gifts = by_place.groupBy("up").agg(*(F.collect_list(c).alias(f"more_{c}") for c in ("place", "leaves", "saved")), F.sum("n").alias("n")).withColumnRenamed("up", "head")
        waiting = open_.filter("waits > 0").join(gifts, "head", "left").withColumn("waits", F.col("waits") - F.coalesce("n", F.lit(0)))
        open_ = stored(waiting.mapInArrow(_added, PATHS))
    return done


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of the trie of all conversations. turns: what rebuilt() or plain() gives."""
    dealt = turns.select("conv_id", "source", "turn", "role", "hash", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "source", "turn", "role", "hash")
    prefixes = stored(dealt.mapInArrow(_prefixes, PREFIXES))
    nodes = stored(prefixes.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")))
    if nodes.isEmpty():
        return nodes.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", *(F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), F.lit("").alias("ends_sha256"))
    ended = prefixes.filter("ends = 1").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ended.mapInArrow(_pieces, "node binary, first long, ids string")
    ends = pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")

    children = nodes.filter("parent is not null")
    heavy = children.groupBy("parent").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "node")).alias("largest"))
    kids = heavy.select(F.col("parent").alias("node"), "n_children")
    follows = heavy.select(F.col("largest.node").alias("node"), F.lit(True).alias("follows"))
    nodes = nodes.join(kids, "node", "left").join(follows, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.withColumn("is_head", F.col("follows").isNull() | (F.col("depth") % PATH == 0)).drop("follows"))
    nodes = stored(nodes.join(heads_of(nodes), "node"))

    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    known = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("head").alias("up"))
    asked = nodes.filter("parent is not null").select("parent", salt.alias("salt")).distinct().join(known, "parent")
    full = stored(nodes.withColumn("salt", salt).join(asked, ["parent", "salt"], "left").drop("salt"))

    own = F.sort_array(F.collect_list(F.struct("depth", "node", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))))
    paths = full.groupBy("head").agg(own.alias("own"), F.max(F.when(F.col("is_head"), F.col("up"))).alias("up"))
    paths = paths.select("head", *(F.col(f"own.{c}").alias(c if c != "node" else "nodes") for c in ("node", "leaves", "saved")), "up", F.col("own.depth")[0].alias("depth"))
    starts = paths.select(F.col("head").alias("up"), F.col("depth").alias("up_depth"))
    # a path above is asked for once by each (path, salt) of those below it
    lower = paths.withColumn("salt", F.pmod(F.xxhash64("head"), F.lit(SALTS)))
    above = lower.filter("up is not null").select("up", "salt").distinct().join(starts, "up")
    paths = lower.join(above, ["up", "salt"], "left").select("head", "nodes", "leaves", "saved", "up", (F.col("depth") - 1 - F.col("up_depth")).alias("place"))
    out = full.join(subtree_sums(paths), "node").join(ends, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


#: The query in SQL: a node's sums are those of all nodes whose smallest member passes it.
ORACLE = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as pos from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, {crc32_sql("conv_id::VARCHAR")} % 6 as h from (select distinct conv_id from t)),
r as (select c.conv_id, pos, role, text from c join t on t.conv_id = c.base where pos <= h
    union all select c.conv_id, pos, role, text from c join t on t.conv_id = c.conv_id where pos > h),
s as (select conv_id, row_number() over (partition by conv_id order by pos) as d, sha256(length(role) || ':' || role || text) as k, length(text) as chars from r),
p as (select conv_id, d, chars, sha256(string_agg(k, '') over (partition by conv_id order by d rows unbounded preceding)) as key from s
    union all select conv_id, 0, 0, 'root' from c),
n as (select d, key, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars from p group by d, key),
m as (select n.*, u.key as up from n left join p u on u.conv_id = n.conv_id and u.d = n.d - 1),
k as (select up as key, count(*) as n_children from m where up is not null group by up),
f as (select m.*, coalesce(n_children, 0) as n_children from m left join k on k.key = m.key),
w as (select a.key, sum((f.n_children = 0)::INT)::BIGINT as n_leaves, sum((f.n_convs - 1) * f.chars)::BIGINT as saved_tokens
    from f join p a on a.conv_id = f.conv_id and a.d <= f.d group by a.key),
e as (select key, sha256(string_agg(conv_id::VARCHAR, ',' order by conv_id)) as ends_sha256 from (select * from p qualify d = max(d) over (partition by conv_id)) group by key)
select f.conv_id, f.d as depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from f join w on w.key = f.key left join n u on u.key = f.up left join e on e.key = f.key"""
