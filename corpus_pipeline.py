"""The corpus pipeline: language ID, line dedup, near-duplicate join, mixing sources to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. A stage
works on every row that its predecessor kept: texts may be null, empty or of any length, ids may repeat (the mix takes
documents up to three times) and further columns pass through, whatever their names. An empty table stays empty. A result is
computed when it is written, so the stages that use Python bound the session's batches, and leave them bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm import langid, line_dedup, mixing, ngram_join, packing
from studylake.llm.common import forget, held_out, keep, text_batches, without_ids, word_count


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined (null texts and those without a letter, too) or whose best two languages
    are too near."""
    text_batches(spark)
    known = langid.fit_dictionaries(docs.where(~held_out(F.col("doc_id"))))
    return langid.accepted_rows(docs, known)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes often repeated lines out of the texts and counts their characters anew; no document goes."""
    return line_dedup.without_repeated_lines(docs, length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five-word shingles, similarity 0.8). Null texts and
    those without words are near nothing and stay, as do rows with a null id; rows that share an id stay or go together."""
    text_batches(spark)
    found = ngram_join.near_components(docs)
    lost = keep(found.where("component <> id").select(F.col("id").alias("lost")).distinct(), "near-duplicates")
    return without_ids(docs, "doc_id", lost, "lost")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents none to three times, so that sources come near their target words; long ones are preferred by the root
    of their words. Texts without words are taken no times."""
    words = word_count(F.col("text"))
    return mixing.mixed_rows(docs, "doc_id", "source", words, preference=mixing.root_of(words))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents, copies included, into sequences of 1,024. Gives pieces, not documents."""
    text_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Compression, Pareto sampling and token ids are beyond SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table of documents, one written table after the other."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
