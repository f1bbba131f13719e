"""Operator 8: benchmark decontamination by winnowing, DataFrame expressions only.

1. Words are hashed, hashes of GRAM consecutive words are k-grams, and a document keeps the minimum
   k-gram hash of each WINDOW of words once: its fingerprints, about 2 for 9 words. Equal windows have
   equal minima at the same place, so documents that hold a window of the benchmark share a fingerprint with it.
2. Fingerprints of documents and benchmark are joined. In the documents that are hit (few), the places of the shared
   k-grams are found again.
3. Each such place is extended on the words to every window of the document that holds it; overlapping places share their windows, so a
   document has a window a word at most, however often it repeats itself. The words of these windows are looked up among the
   benchmark's distinct windows. So hashes only find candidates, and every shared window is found.

Items of fewer than WINDOW words are one window of their own length; each length that occurs is looked up by a hash of
so many words and then by the words in the same way.

Bounds: the benchmark's fingerprints are broadcast only if they were counted and are
within a bound; otherwise the join is shuffled.

Defined results: null and empty texts have no words (n_words 0, clean); an item
without words is ignored; repeated documents each give the same row; rows without doc_id, and texts that share an id, are
documents of their own; equal items each count (ties are no matter of order); an empty table of documents gives
no rows, an empty benchmark clean ones; a very long text is one row's array; other columns, also those named like this
operator's, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import small_or_not, stored

WINDOW, GRAM = 13, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of what is neither an ASCII control, mark nor space; A-Z are words' characters too, lowered later.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _shifted(a: str, b: str, by: int, f) -> Column:
    """f(a[i], b[i + by]) for every i that has both."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1 + by, n), f)


def _lowered(w: Column) -> Column:
    return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))


def _words() -> Column:
    return F.regexp_extract_all("text", F.lit(WORD), F.lit(0))


def _grams(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h (the hash of each word) and g (that of GRAM words from there) of rows with text."""
    both = lambda x, y: F.xxhash64(x, y)
    df = _hashes(df, keys)
    df = df.select(*keys, "h", _shifted("h", "h", 1, both).alias("g2"))
    df = df.select(*keys, "h", "g2", _shifted("g2", "g2", 2, both).alias("g4"))
    return df.select(*keys, "h", _shifted("g4", "g2", GRAM - 2, both).alias("g"))


def fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_words and the distinct fingerprints of each row's text."""
    low = lambda x, y: F.least(x, y)
    df = _grams(df, keys).select(*keys, F.greatest(F.size("h"), F.lit(0)).cast("long").alias("n_words"), "g")
    for by in (1, 2, WINDOW - GRAM + 1 - 4):  # minima of 2, 4 and all 8 k-grams of a window
        df = df.select(*keys, "n_words", _shifted("g", "g", by, low).alias("g"))
    return df.select(*keys, "n_words", F.array_distinct("g").alias("prints"))


def _hashes(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and h: the hash of each word."""
    return df.select(*keys, F.transform(_words(), lambda w: F.xxhash64(_lowered(w))).alias("h"))


def _short(hashed: DataFrame, keys: list[str], words: int) -> DataFrame:
    """A row for each run of so many words: keys, at, win."""
    runs = F.transform(F.sequence(F.lit(1), F.size("h") - words + 1), lambda i: F.xxhash64(F.lit(words), F.slice("h", i, words)))
    return hashed.filter(F.size("h") >= words).select(*keys, F.posexplode(runs).alias("at", "win"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["text_hash"].eqNullSafe(b["text_hash"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    keys = ["doc_id", "text_hash"]
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text", F.transform(_words(), _lowered).alias("item_words"))
    items = stored(items.filter(F.size("item_words") > 0).select(F.xxhash64("item_id", "text").alias("item"), "*").distinct())
    long = items.filter(F.size("item_words") >= WINDOW)
    short = [r[0] for r in items.filter(F.size("item_words") < WINDOW).select(F.size("item_words").alias("n")).distinct().orderBy("n").collect()]  # 12 values at most

    # which documents share a fingerprint with which items
    # arrays are stored before they are exploded, or the filter on their size would compute each array again, level by level
    tests = stored(fingerprints(long, ["item"])).select("item", F.explode("prints").alias("print"))
    read = stored(fingerprints(docs, keys))
    hits = stored(read.select(*keys, F.explode("prints").alias("print")).join(small_or_not(tests.select("print").distinct()), "print", "left_semi"))
    hit = small_or_not(stored(hits.select(*keys).distinct()))
    own = stored(docs.join(hit, _same(docs, hit), "left_semi").distinct())
    # where: the windows around each place of a shared k-gram, as start * 16 + length
    size = lambda x: x.bitwiseAND(F.lit(15))
    start = lambda x: F.shiftright(x, 4)
    places = stored(_grams(own, keys)).select(*keys, F.size("h").alias("n"), F.posexplode("g").alias("at", "print")).join(small_or_not(hits.select("print").distinct()), "print", "left_semi")
    from_ = F.greatest(F.col("at") - (WINDOW - GRAM), F.lit(0))
    around = F.when(from_ <= F.col("n") - WINDOW, F.sequence(from_, F.least(F.col("at"), F.col("n") - WINDOW)))
    near = places.select(*keys, F.explode(around).alias("start")).select(*keys, (F.col("start").cast("long") * 16 + WINDOW).alias("span"))
    hashed = stored(_hashes(docs, keys)) if short else None
    for n in short:
        tiny = items.filter(F.size("item_words") == n)
        found = _short(hashed, keys, n).join(small_or_not(_short(stored(_hashes(tiny, ["item"])), ["item"], n).select("win").distinct()), "win", "left_semi")
        near = near.unionByName(found.select(*keys, (F.col("at").cast("long") * 16 + n).alias("span")))
    spans = stored(near.groupBy(*keys).agg(F.collect_set("span").alias("spans")))

    # the words of these windows among those of the benchmark
    need = F.least(F.size("item_words"), F.lit(WINDOW))
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("item_words") - need + 1), lambda i: F.array_join(F.slice("item_words", i, need), " ")))
    listed = items.select("item_id", F.explode(windows).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    listed = stored(stored(listed).withColumn("number", F.monotonically_increasing_id()))
    words = docs.join(small_or_not(spans), _same(docs, spans)).select(docs["doc_id"], docs["text_hash"], "text", "spans")
    words = words.dropDuplicates(keys).select(*keys, "spans", F.transform(_words(), _lowered).alias("words"))
    texts = F.transform("spans", lambda x: F.struct(x.alias("span"), F.array_join(F.slice("words", (start(x) + 1).cast("int"), size(x).cast("int")), " ").alias("window")))
    rows = stored(words).select(*keys, F.explode(texts).alias("w")).select(*keys, "w.*")
    found = rows.join(small_or_not(listed.select("window", "number")), "window").groupBy(*keys).agg(F.collect_list("span").alias("spans"), F.collect_set("number").alias("numbers"))
    found = stored(found)
    which = found.select(*keys, F.explode("numbers").alias("number")).join(small_or_not(listed.select("number", "ids")), "number")
    which = stored(which.select(*keys, F.explode("ids").alias("item_id")).groupBy(*keys).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    found = found.join(which, _same(found, which)).select(found["doc_id"], found["text_hash"], "spans", "item_ids")

    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], start(x) + size(x)).alias("end"), (a["n"] + F.greatest(F.lit(0), start(x) + size(x) - F.greatest(a["end"], start(x)))).alias("n")),
        lambda a: a["n"],
    )
    both = small_or_not(found.select(*keys, covered.alias("n_hit"), "item_ids"))
    joined = read.join(both, _same(read, both), "left").select(read["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return joined.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "item_ids",
    )


_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
b AS (SELECT item_id, {_WORDS} w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') s FROM (SELECT item_id, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
cov AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) x FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
