"""A pipeline over documents: toxicity, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the
columns of its input. Stages are written to the shared folder and read again, so a lost executor
repeats part of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.llm import decontamination, line_templates, near_duplicates, packing, toxicity
from episcope.llm.common import fresh, id_and_text, saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a lexicon learned from the labels does not find toxic."""
    lexicon = toxicity.fit_lexicon(id_and_text(docs), _table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, lexicon)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs; ``n_chars`` follows the text.

    Columns of the input that are named like the operator's counts keep their values.
    """
    clashing = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]
    aside = dict(zip(clashing, fresh(docs.columns, *(f"own_{c}" for c in clashing)), strict=True))
    cleaned = line_templates.drop_recurring_lines(docs.withColumnsRenamed(aside))
    changed = F.col("n_dropped") > 0
    columns = {c: F.col(aside.get(c, c)).alias(c) for c in docs.columns}
    if "n_chars" in docs.columns:
        n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
        columns["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cleaned.select(*columns.values())


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontamination.without_benchmark(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: Signatures, a fitted lexicon and a tokenizer have no SQL; tests/llm holds stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
