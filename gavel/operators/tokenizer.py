"""Byte-pair encoding of tables in sets: each distinct piece is merged once in the whole job, by rounds of joins.

Encoding. Texts are cut into pieces, once; the distinct ones are the dictionary. A piece is a string with one character a symbol: those of the byte
alphabet, and for each product of a merge a character that tells its id, so a pair of symbols is two characters and a merge replaces them by one. In a
round the adjacent pairs of all pieces are joined with the merge table, each piece takes the
least rank, and that pair is merged in all of them at once: everywhere, from the left, if no merge of a product comes before
the merge that makes it (checked on the table), else at its leftmost place alone. Pieces without a pair in the table are done. Rounds of one
job keep the pieces where they are: the dictionary is dealt by piece once, the merge table is broadcast if it is within a counted bound.
Of a corpus the commonest pieces are the dictionary, as many as its bound allows; texts stay where they lie and look their pieces up in it. The rest, each rare,
are merged by a queue each where they stand, so that nothing but counted pieces is shuffled: no text, and no list of ids.

Decoding lays the bytes of ids in a row by the vocabulary, where the ids lie, and replaces what is not UTF-8; an id without a piece is an error. A vocabulary beyond
the bound is joined instead.

A vocabulary comes from a corpus by counting its pieces; its merges are found by splitting each entry with the entries of smaller rank alone,
again by rounds of joins, keeping those that end in two parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gavel.functions.bpe import ALPHABET, CONTROL, USER_DEFINED, Vocabulary, raw_hex, shown, to_alphabet
from gavel.functions.text import has_marker, pre_tokens, split_markers
from gavel.operators import tables
from gavel.operators.tables import counted_small, small_or_not, stored

#: Rounds of one job; the pieces that are not done go on in the next.
ROUNDS = 3
#: Jobs after which the pieces left (few and long) are merged by a queue each, in the tasks that hold them.
JOBS = 8
#: Characters of a piece that may be broadcast.
SHORT = 64
#: Entries of lists that a task works on at once, and rare pieces that it remembers.
AT_ONCE, REMEMBERED = 200_000, 100_000


def vocabulary_tables(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """(token_id, piece, type)."""
    rows = [(i, p, int(t)) for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True))]
    return spark.createDataFrame(rows, "token_id int, piece string, type int")


#: The character of a product is this code point and its id.
PRODUCT = 0x20000
_PLACES = max(map(ord, ALPHABET)) + 1


def merge_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """(rank, pair, product) as characters; merges whose product is no piece, or whose parts are none, never happen."""
    one = lambda x: x if len(x) == 1 else chr(PRODUCT + v.ids[x])
    made = lambda x: len(x) == 1 or x in v.ids
    rows = [(r, one(a) + one(b), one(a + b)) for (a, b), r in v.ranks.items() if a + b in v.ids and made(a) and made(b)]
    return spark.createDataFrame(rows, "rank int, pair string, product string")


def _ids(s: Column, v: Vocabulary) -> Column:
    """Ids of a string of symbols; bytes without an id are dropped."""
    own = F.array(*[F.lit(v.ids.get(chr(c), -1)) for c in range(_PLACES)])
    code = lambda c: F.when(F.ascii(c) >= PRODUCT, F.ascii(c) - PRODUCT).otherwise(F.get(own, F.ascii(c)))
    return F.filter(F.transform(F.split(s, ""), code), lambda i: i >= 0)


def ordered_merges(v: Vocabulary) -> bool:
    """Whether every merge comes after those that make its parts, so that a pair of least rank stays that while it is merged everywhere."""
    first = {}
    for (a, b), r in v.ranks.items():
        for s in (a, b):
            first[s] = min(first.get(s, r), r)
    return all(first.get(a + b, r + 1) > r for (a, b), r in v.ranks.items())


def cut(df: DataFrame, key: str, text: str, v: Vocabulary) -> DataFrame:
    """(key, pieces): the pieces of each text, null for a null one; written once, as the pattern is the dearest step. A table of few splits is spread, a large one is cut where it lies."""
    rows, cores = df.select(F.col(key).alias("key"), F.col(text).alias("text")), df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(4 * cores)
    return stored(rows.select("key", _pieces_of(v).alias("pieces")))


def _pieces_of(v: Vocabulary) -> Column:
    whole = pre_tokens("text")
    if not v.markers:
        return whole
    parts = F.flatten(F.transform(split_markers("text", v.markers), lambda p: F.when(p.isin(*v.markers), F.array(p)).otherwise(pre_tokens(p))))
    return F.when(has_marker("text", v.markers), parts).otherwise(whole)


def _round(df: DataFrame, merges: DataFrame, everywhere: bool) -> DataFrame:
    """One merge of every piece that has one; done: none was left. With merges marked for broadcast nothing is shuffled: the rows stay dealt by piece."""
    parts = F.split("s", "")
    pairs = F.array_distinct(F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: F.concat(a, b)))
    open_ = df.select("piece", "s", F.explode_outer(F.when(~F.col("done") & (F.char_length("s") > 1), pairs)).alias("pair"))
    ranked = open_.join(merges, "pair", "left").groupBy("piece", "s").agg(F.min("rank").alias("rank"))
    best = ranked.join(merges, "rank", "left")
    merged = F.replace("s", F.col("pair"), F.col("product")) if everywhere else F.overlay("s", "product", F.instr("s", F.col("pair")), F.lit(2))
    return best.select("piece", F.when(F.col("rank").isNull(), F.col("s")).otherwise(merged).alias("s"), F.col("rank").isNull().alias("done"))


def merge_pieces(pieces: DataFrame, v: Vocabulary) -> DataFrame:
    """(piece, ids) for distinct pieces (a column piece): a marker's or a whole piece's own id, else those of its symbols after all merges; unknown symbols are dropped."""
    spark = pieces.sparkSession
    merges = small_or_not(merge_table(spark, v))
    whole = small_or_not(spark.createDataFrame([(p, chr(PRODUCT + i)) for p, i in v.ids.items()], "s string, token string"))
    marker = F.col("piece").isin(*v.markers) if v.markers else F.lit(False)
    named = pieces.select("piece", F.when(marker, F.col("piece")).otherwise(shown("piece")).alias("s")).join(whole, "s", "left")
    # a piece that is one itself is done before the first round
    open_, done = named.select("piece", F.coalesce("token", "s").alias("s"), F.col("token").isNotNull().alias("done")), None
    everywhere = ordered_merges(v)
    for _ in range(JOBS):
        step = open_.repartition("piece")
        for _ in range(ROUNDS):
            step = _round(step, merges, everywhere)
        step = stored(step)
        ended = step.filter("done").select("piece", "s")
        done = ended if done is None else done.union(ended)
        open_ = step.filter("not done")
        if open_.isEmpty():
            break
    else:
        name = lambda c: v.pieces[ord(c) - PRODUCT] if ord(c) >= PRODUCT else c
        sign = lambda x: x if len(x) == 1 else chr(PRODUCT + v.ids[x])
        queue = pandas_udf(lambda xs: xs.map(lambda s: "".join(map(sign, v.merged(list(map(name, s)))))), "string")
        done = done.union(open_.select("piece", queue("s").alias("s")))
    return done.select("piece", _ids(F.col("s"), v).alias("ids"))


def _common(counts: DataFrame) -> int:
    """The least power of two of a count, so that the pieces which occur as often are few enough to be broadcast."""
    by_size = counts.filter(F.length("piece") <= SHORT).groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("m")).collect()
    held, least = 0, 63
    for k, m in sorted(((r.k, r.m) for r in by_size), reverse=True):
        if held + m > tables.BROADCAST_ROWS:
            break
        held, least = held + m, k
    return 1 << least


def _parts(batch: pa.RecordBatch, lists: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch cut so that a part has about AT_ONCE entries of its lists, with the places where its rows' entries begin and end."""
    size = pc.fill_null(pc.list_value_length(batch.column(lists)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < batch.num_rows:
        hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(end, end[lo] + AT_ONCE, side="right")) - 1))
        yield batch.slice(lo, hi - lo), end[lo : hi + 1] - end[lo]
        lo = hi


def _laid(table: np.ndarray, start: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs start, size of a table named by index, one after the other, and where each begins and ends."""
    n = size[index]
    end = np.concatenate([[0], np.cumsum(n)])
    return table[np.repeat(start[index] - end[:-1], n) + np.arange(end[-1])], end


def encode_in_sets(df: DataFrame, key: str, text: str, v: Vocabulary, special: bool = True) -> DataFrame:
    """(key, tokens) for each row. A null text has null tokens, an empty one no pieces; rows of equal keys stay rows of their own."""
    rows = cut(df, key, text, v)
    counts = stored(rows.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("n")))
    common = merge_pieces(counts.filter((F.col("n") >= _common(counts)) & (F.length("piece") <= SHORT)).select("piece"), v).toArrow()
    shared = df.sparkSession.sparkContext.broadcast((common.column("piece").to_pylist(), common.column("ids").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(zip(*shared.value, strict=True))
        rare = lru_cache(REMEMBERED)(lambda p: [v.ids[p]] if p in v.markers else v.merge(to_alphabet(p)))
        for batch in batches:
            for part, end in _parts(batch, 1):
                codes = part.column(1).flatten().dictionary_encode()
                ids = [known[p] if p in known else rare(p) for p in codes.dictionary.to_pylist()]
                size = np.array([len(x) for x in ids], np.int64)
                tokens, cuts = _laid(np.array([i for x in ids for i in x], np.int32), np.cumsum(size) - size, size, codes.indices.to_numpy())
                made = pa.ListArray.from_arrays(pa.array(cuts[end], pa.int32()), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).is_null(), made], names=["key", "missing", "tokens"])

    out = rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, missing boolean, tokens array<int>")
    first, last = ([x] if special and add else [] for x, add in ((v.bos, v.add_bos), (v.eos, v.add_eos)))
    tokens = F.concat(*([F.array(*map(F.lit, first))] if first else []), "tokens", *([F.array(*map(F.lit, last))] if last else []))
    return out.select(F.col("key").alias(key), F.when(~F.col("missing"), tokens).alias("tokens"))


def decode_in_sets(df: DataFrame, key: str, tokens: str, vocabulary: DataFrame, special: bool = False) -> DataFrame:
    """(key, text) for each row of token arrays. vocabulary: token_id, piece, type. Markers have no text unless special asks for it; invalid UTF-8 becomes U+FFFD; an id that the vocabulary has not is an error."""
    marker = F.col("type").isin(CONTROL, USER_DEFINED)
    literal = F.hex(F.encode("piece", "UTF-8")) if special else F.lit("")
    by_id = vocabulary.select(F.col("token_id").cast("int").alias("token_id"), F.when(marker, literal).otherwise(raw_hex("piece")).alias("hex"))
    if not counted_small(by_id):
        return _decoded_by_join(df, key, tokens, by_id)
    own = by_id.filter("token_id is not null").toArrow()
    shared = df.sparkSession.sparkContext.broadcast((own.column("token_id").to_pylist(), own.column("hex").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sorted(zip(*shared.value, strict=True))
        names, pieces = np.array([i for i, _ in order], np.int64), [bytes.fromhex(h) for _, h in order]
        size = np.array([len(x) for x in pieces], np.int64)
        table, start = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
        for batch in batches:
            for part, end in _parts(batch, 1):
                asked = part.column(1).flatten()
                if asked.null_count:
                    raise ValueError("no token null")
                ids = asked.to_numpy().astype(np.int64)
                at = np.searchsorted(names, ids)
                bad = ids[names[np.minimum(at, len(names) - 1)] != ids] if len(names) else ids
                if len(bad):
                    raise ValueError(f"no token {bad[0]}")
                laid, cuts = _laid(table, start, size, at)
                made = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(cuts[end].astype(np.int64).tobytes()), pa.py_buffer(laid.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).is_null(), made.cast(pa.binary())], names=["key", "missing", "raw"])

    rows = df.select(F.col(key).alias("key"), F.col(tokens).cast("array<int>").alias("tokens"))
    out = rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, missing boolean, raw binary")
    return out.select(F.col("key").alias(key), F.when(~F.col("missing"), F.make_valid_utf8(F.col("raw").cast("string"))).alias("text"))


def _decoded_by_join(df: DataFrame, key: str, tokens: str, by_id: DataFrame) -> DataFrame:
    """decode_in_sets by a vocabulary (token_id, hex) that is too large to be sent to tasks."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(tokens).alias("tokens")).repartition("row")
    each = rows.select("row", "key", F.col("tokens").isNull().alias("missing"), F.posexplode_outer("tokens").alias("pos", "token_id"))
    found = each.join(by_id, "token_id", "left")
    asked = F.col("pos").isNotNull()
    checked = F.when(asked & F.col("hex").isNull(), F.raise_error(F.concat(F.lit("no token "), F.coalesce(F.col("token_id").cast("string"), F.lit("null")))).cast("string")).otherwise(F.col("hex"))
    parts = F.array_sort(F.collect_list(F.when(asked, F.struct("pos", checked.alias("hex")))))
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform(parts, lambda x: x["hex"]), "")).cast("string"))
    out = found.groupBy("row").agg(F.first("key").alias("key"), F.first("missing").alias("missing"), text.alias("text"))
    return out.select(F.col("key").alias(key), F.when(~F.col("missing"), F.col("text")).alias("text"))


def corpus_vocabulary(df: DataFrame, text: str, size: int, special: tuple[str, ...] = ()) -> DataFrame:
    """(token_id, rank, piece, type): special pieces, the byte alphabet, then the size commonest pieces of more than one byte, ties in text order.

    rank counts from the first byte; special pieces have none. The commonest are a bounded top-k, taken from each task's own.
    """
    spark = df.sparkSession
    counts = df.select(F.explode(pre_tokens(text)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).filter(F.octet_length("piece") > 1)
    top = counts.orderBy(F.desc("n"), "piece").limit(size)
    listed = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "piece"))), lambda x: x["piece"]).alias("v"))
    ranked = listed.select(F.posexplode("v").alias("i", "piece")).select((F.col("i") + len(ALPHABET)).alias("rank"), shown("piece").alias("piece"))
    fixed = [(i, None, p, CONTROL) for i, p in enumerate(special)] + [(len(special) + b, b, c, 1) for b, c in enumerate(ALPHABET)]
    return spark.createDataFrame(fixed, "token_id int, rank int, piece string, type int").union(ranked.select((F.col("rank") + len(special)).cast("int"), F.col("rank").cast("int"), "piece", F.lit(1)))


def merges_of(vocabulary: DataFrame) -> DataFrame:
    """(rank, left, right) derived from a vocabulary (rank, piece): each entry is put together from its symbols by entries of smaller rank, least rank and leftmost place first; those left in two parts are merges.

    Entries are split once each, all at the same time; an entry stays in the rounds while something in it can be joined and it has more than two parts.
    """
    own = vocabulary.filter("rank is not null").groupBy("piece").agg(F.max("rank").alias("rank"))  # of equal entries the last one's rank counts
    by_piece = small_or_not(own.select(F.col("piece").alias("product"), F.col("rank").alias("r")))
    open_, finished = vocabulary.filter("rank is not null").select("rank", F.split("piece", "").alias("p")), []
    while True:
        step = open_.repartition("rank").withColumn("done", F.size("p") <= 2)
        for _ in range(ROUNDS):
            products = F.zip_with(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"), lambda a, b: F.concat(a, b))
            pairs = step.select("rank", "p", F.posexplode_outer(F.when(~F.col("done"), products)).alias("pos", "product"))
            order = F.when(F.col("r") < F.col("rank"), F.col("r").cast("long") * (1 << 24) + F.col("pos"))
            best = pairs.join(by_piece, "product", "left").groupBy("rank", "p").agg(F.min(order).alias("best"))
            at = (F.col("best") % (1 << 24)).cast("int")
            joined = F.concat(F.slice("p", F.lit(1), at), F.array(F.concat(F.get("p", at), F.get("p", at + 1))), F.slice("p", at + 3, F.greatest(F.size("p") - at - 2, F.lit(0))))
            step = best.select("rank", F.when(F.col("best").isNull(), F.col("p")).otherwise(joined).alias("p"), F.col("best").isNull().alias("stop"))
            step = step.select("rank", "p", (F.col("stop") | (F.size("p") <= 2)).alias("done"))
        step = stored(step)
        finished.append(step.filter("done"))
        open_ = step.filter("not done").select("rank", "p")
        if open_.isEmpty():
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.union(more)
    return out.filter(F.size("p") == 2).select("rank", F.col("p")[0].alias("left"), F.col("p")[1].alias("right"))
