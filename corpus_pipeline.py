"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathloom.llm import line_dedup, minhash_dedup, mixing, packing, toxicity
from pathloom.llm._common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; it is fitted on the labelled ones. Null and empty texts stay, rows that
    repeat an id are judged one by one, a score of just 0.5 is toxic, whole texts count, and an empty table stays empty."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and runs of lines go, and n_chars follows; a document of which nothing is left goes as well. What is
    found first, by doc_id, stays; null ids come last. Null and empty texts stay as they are, rows equal in id and text
    lose the same, rows that share only the id are told apart, whole texts count, and an empty table stays empty."""
    out = line_dedup.deduplicated(docs, run_words=line_dedup.RUN_WORDS)
    out = out.where((F.col("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id, and of rows that share it one. Rows
    without an id are grouped, too; null and wordless texts stay, whole texts count, a similarity of just 0.85 links, and
    an empty table stays empty. The stage sees what line dedup left, so near copies that lost all they shared are no longer
    near."""
    return minhash_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights; a document that is taken twice is there twice. Null sources are a source,
    null texts have no words, equal rows and rows without ids are taken one by one, and an empty table stays empty."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, a row per piece. Null and empty texts are the end token alone, equal rows are packed one by one,
    whole texts are cut, and an empty table stays empty."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages of learnt scores, sets of shingles and tokens are beyond SQL; a brute-force version tests them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
