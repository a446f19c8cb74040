"""From raw documents to token ids: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage works on all that the one before it kept.  ``run`` writes what a stage returns as Parquet in the shared
folder, so that a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, decontam, ngram_join, quality, substring_dedup
from basketry.llm.common import table, unused, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; the classifier learns from labelled rows that op7 doesn't hold out."""
    model = quality.fit(quality.sample(docs, table(spark, sf_dir, "labels"), "quality", fold=(3, 1)))
    score = unused(docs, "quality")
    return quality.score(docs, model, out=score).filter(F.col(score) >= 0.5).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.75 of its five-word shingles, link by link."""
    return ngram_join.deduplicate(docs, n=5, threshold=0.75)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated windows of 35 words cover; n_chars follows the text."""
    return substring_dedup.remove(docs, width=35).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = unused(docs, "leaks")
    return decontam.matches(docs, table(spark, sf_dir, "benchmark"), out=leaks).filter(F.size(leaks) == 0).drop(leaks)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and exact: whether the ids decode to the text."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern, exact="exact")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("substring_dedup", remove_repeats),
    ("decontamination", drop_leaks),
    ("tokens", tokens),
]

#: SQL has no such classifier; tests/llm/test_pipeline.py compares what each stage keeps with plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
