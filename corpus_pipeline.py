"""The corpus pipeline: language identification, near-duplicate removal, substring removal, benchmark decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``. What a stage wrote on its way is
deleted once its result is written, and a stage's docs once the next result is.

Cases, in all stages: an empty table gives an empty one; extra columns are dropped, whatever their names; very long texts
are worked on whole; null ids and null languages or sources are kept as they are. Each stage's docstring says what
becomes of null and empty texts, repeated rows and ties.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odotrail.llm import bpe, decontaminate, langid, minhash, substring
from odotrail.llm.common import discard, materialize, scratch_tables, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language: null and empty texts, and texts without a letter. Repeated rows are judged one by one."""
    found = langid.identify(docs, langid.fit(docs), keep=COLUMNS)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five words, 0.8): one row, of several
    with that id one of the text with the least hash. Texts without words are no group and stay, equal rows once; so does one
    row of each group in which all ids are null."""
    found = minhash.near_duplicates(docs, shingle=5, percent=80).filter("kept")
    wordless = F.when(F.col("component").isNull(), F.struct("component_id", "text_hash"))
    chosen = found.groupBy("component", wordless).agg(F.min(F.struct("component_id", "text_hash")).alias("c")).select("c.*")
    named = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    one = named.join(chosen, named.doc_id.eqNullSafe(chosen.component_id) & (named["__hash"] == chosen.text_hash), "left_semi")
    return one.dropDuplicates(["doc_id", "__hash"]).select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words that a document with a smaller id holds; drops documents of which nothing is left.
    Documents of equal id do not cut each other; a null id is larger than all others. Null and shorter texts stay."""
    found = substring.remove_repeats(docs, window=50, keep=("lang", "source"), with_text=True)
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to a twentieth of edits. Null and empty texts hold none."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.filter(F.size("matches") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with proof that they decode to it: one row a row; null and empty texts have no ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, keep=("lang", "source"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Trained models, hashing and tokenisation are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_tables() as keep:
            out = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = out
    return docs
