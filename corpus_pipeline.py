"""A corpus pipeline of five stages; each is written as Parquet and read again before the next.

Every stage but the last returns the columns of documents. What it decides takes effect: rejected languages, near
copies, contaminated documents and documents that the mix doesn't take are gone for the stages after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterforge.llm import decontaminate, langid, minhash, mixing, queries
from rosterforge.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this calibrated probability a language counts as rejected, as does "und".
LEAST_LANG_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the language column holds what was recognised."""
    x = langid.predict(docs, langid.learn(docs))
    x = x.filter((F.col("lang_pred") != langid.UND) & (F.col("lang_score") >= LEAST_LANG_SCORE))
    return x.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id."""
    gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, each row once at most.

    Rows without an id, and rows that share one, are taken or left one by one, as their tokens fit the budget.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_content"), F.monotonically_increasing_id().alias("_row"))
    rows = Scratch(spark, "mixing").write(rows, "rows")
    taken = mixing.mix(rows, queries.domain(F.col("source")), queries.MIX_SHARE, queries.MIX_WEIGHTS, seed=queries.MIX_SEED, max_epochs=1, carry=("_content", "_row"))
    return rows.join(taken.select("_row"), "_row", "left_semi").select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the token files, read back from them."""
    return queries.token_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token IDs", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = tmp.write(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
