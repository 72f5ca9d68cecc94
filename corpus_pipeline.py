"""A corpus pipeline over ``documents``: each stage's Parquet output is the next stage's input.

Stages keep the columns of ``documents``; the last gives token ids. SQL has neither trained
models nor sampled segmentations, so there is no ORACLE_SQL; tests/llm checks each stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.langid import fit_languages, predict_languages, training_rows
from casewise.llm.partenum import near_duplicates
from casewise.llm.pii import replace_entities
from casewise.llm.sampling import encode_sampled
from casewise.llm.scratch import Scratch
from casewise.llm.wumanber import contaminated, contamination


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null, empty or without a letter) go.

    Each row is judged by its own text, so null and repeated ids, repeated rows and very long
    texts need no care; where no language can be learned, every row goes. An empty table
    stays empty; extra columns are kept.
    """
    found = predict_languages(docs, fit_languages(docs.where(training_rows("doc_id"))), whole=True)
    return found.where("lang_pred <> 'und'").select("record.*")


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the least doc_id, a null one last.

    Where ids repeat, the text's hash decides; of rows that repeat both id and text one stays.
    Rows without a word have no copies and stay, null texts among them. An empty table stays
    empty; extra columns are kept.
    """
    mark = F.xxhash64("text")
    found = near_duplicates(docs, mark=mark).where("n_shingles > 0")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("best_id"), F.col("best.mark").alias("best_mark"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = lambda right_id, right_mark: F.col("doc_id").cast("long").eqNullSafe(F.col(right_id)) & (mark == F.col(right_mark))
    kept = docs.where(worded).join(best, same("best_id", "best_mark"), "left_semi")
    again = found.groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("again_id"), F.col("mark").alias("again_mark"))
    again = again.join(best, F.col("again_id").eqNullSafe(F.col("best_id")) & (F.col("again_mark") == F.col("best_mark")), "left_semi")
    if again.take(1):  # rows of one id and one text
        kept = kept.join(again, same("again_id", "again_mark"), "left_anti").union(kept.join(again, same("again_id", "again_mark"), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.union(docs.where(~worded))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth or more of the words lie in benchmark windows go.

    Each row is judged by its own text: null ids, repeated rows and very long texts need no
    care. Null and wordless texts stay, and with an empty benchmark all rows. An empty table
    stays empty; extra columns are kept.
    """
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True)
    return found.where(~contaminated()).select("record.*")


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts become surrogates; n_chars, if it is there, follows the text.

    No row goes; null and empty texts stay as they are, equal texts get equal results. An
    empty table stays empty; extra columns are kept.
    """
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return replace_entities(docs).select(*[new.get(c, F.col(f"record.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's sampled token ids; null and empty texts have none, an empty table gives none."""
    return encode_sampled(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", dedupe),
    ("benchmark_decontamination", decontaminate),
    ("pii_surrogates", pseudonymise),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
