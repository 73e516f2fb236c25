"""Raw documents to token ids: language ID, exact and near duplicates, benchmark leaks, BPE.

Each stage reads what the one before kept. Rows are told apart by id and text, so ids that are null or repeated do no harm: rows
equal in both are repeats, and one decision holds for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.common import cut
from lodestone.llm import bpe, decontamination, exact_dedup, jaccard_join, language_id
from lodestone.llm.base import table, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row() -> Column:
    return F.struct(F.col("doc_id"), F.xxhash64(text_or_empty()).alias("text"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of `docs` whose id and text are not among `dropped` (row)."""
    return docs.withColumn("_row", _row()).join(dropped.select(F.col("row").alias("_row")).distinct(), "_row", "left_anti").select(*docs.columns)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null, have no letter, or resemble no language more than all others together go."""
    keyed = language_id.with_fold(docs).withColumn("_id", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(text_or_empty())))
    found = language_id.predict_language(keyed, id_col="_id")
    rejected = found.filter("lang_pred = 'und' OR ambiguous").select("_id").distinct()
    return keyed.join(rejected, "_id", "left_anti").select(*docs.columns)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays, of repeated rows one."""
    keyed = docs.withColumn("_sha", F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256))
    found = cut(exact_dedup.exact_dedup(docs).filter("NOT kept").select("doc_id", F.col("text_sha256").alias("_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")), "dropped")
    row = F.struct("doc_id", "_sha").alias("_row")
    keyed = keyed.withColumn("_row", row)
    dropped, again = (found.filter(c).select(row).distinct() for c in ("NOT again", "again"))
    rest = keyed.join(dropped, "_row", "left_anti")
    once = rest.join(again, "_row", "left_semi").dropDuplicates(["_row"])
    return rest.join(again, "_row", "left_anti").unionByName(once).select(*docs.columns)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (sets of five words, similarity 0.8) the row with the smallest id stays."""
    found = jaccard_join.near_duplicates(docs.withColumn("_row", _row()), id_col="_row", width=5, percent=80)
    return _without(docs, found.filter("_row <> component_id").select(F.col("_row").alias("row")))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontamination.contaminated(docs.withColumn("_row", _row()), table(spark, sf_dir, "benchmark"), id_col="_row")
    return _without(docs, found.select(F.col("_row").alias("row")))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    return bpe.token_digests(docs, bpe.vocabulary_path(), with_ids=True)


STAGES = [
    ("language_id", stage_language),
    ("exact_dedup", stage_exact),
    ("jaccard_join", stage_near),
    ("decontamination", stage_decontaminate),
    ("bpe", stage_encode),
]
#: No SQL: language ID, latent retrieval and BPE are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
