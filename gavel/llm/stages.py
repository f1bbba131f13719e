"""The corpus pipeline's stages: each takes (spark, docs, sf_dir), works on all of docs and returns a table.

Defined results of every stage: an empty table gives an empty one; a null or empty text is a text of no bytes, words and
shingles (its quality is scored, it links with nothing and is clean); rows of one doc_id are decided together by the join and by
decontamination, and each by its own text by the classifier and the removal of repeats; a row without doc_id is never
dropped but by the classifier; of equal documents that with the smallest id stays; a very long text is worked on whole;
other columns, also those named like an operator's, pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm.common import small_or_not, stored, table
from gavel.llm.decontaminate import decontaminate
from gavel.llm.jaccard import similar_components
from gavel.llm.pieces import encode_pieces
from gavel.llm.quality import fit_quality, keep_good
from gavel.llm.repeats import remove_repeats


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less those with the ids; rows without an id stay."""
    return docs.join(small_or_not(stored(ids.select("doc_id").distinct())), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents that with the smallest id stays; rows of one id are one document."""
    return _without(docs, similar_components(docs).filter("doc_id != component_id"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that start earlier are cut out of the texts; n_chars follows the text."""
    out = remove_repeats(docs, docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they decode to its text."""
    return encode_pieces(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("benchmark decontamination", benchmark), ("SentencePiece encoding and decoding", pieces)]
