"""The operators' registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import decontaminate as _dec
from gavel.llm import html as _html
from gavel.llm import jaccard as _jaccard
from gavel.llm import language as _language
from gavel.llm import neighbours as _near
from gavel.llm import pieces as _pieces
from gavel.llm import quality as _quality
from gavel.llm import repair as _repair
from gavel.llm import repeats as _repeats
from gavel.llm import token_counts as _tokens
from gavel.llm import toxicity as _toxic
from gavel.llm import trie as _trie
from gavel.llm import warc as _warc
from gavel.llm.common import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.main_text(table(spark, sf_dir, "pages"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _toxic.toxicity(docs, _toxic.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.neighbours(table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _language.identify(docs, _language.fit_language(docs))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = _pieces.encode_pieces(table(spark, sf_dir, "documents"))
    return encoded.withColumn("ids_sha256", F.sha2(F.array_join("token_ids", ",").cast("binary"), 256)).drop("token_ids")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dec.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.similar_components(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _quality.quality_scores(docs, _quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repair.repair(_repair.damaged(table(spark, sf_dir, "conversations"))).drop("n_turns", "opens")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _warc.new_folder(spark)
    _warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return _warc.read_archives(spark, folder).drop("url", "file")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trie.prefix_trie(_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_main_text, op2_repeats, op3_toxicity, op4_token_counts, op5_neighbours, op6_language, op7_pieces, op8_decontaminate, op9_jaccard, op10_quality, op11_repair, op12_warc, op13_prefix_trie)}
ORACLE_SQL = {"op8_decontaminate": _dec.ORACLE, "op9_jaccard": _jaccard.ORACLE, "op11_repair": _repair.ORACLE, "op12_warc": _warc.ORACLE, "op13_prefix_trie": _trie.ORACLE}
