"""The corpus pipeline: five stages, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before
it kept, and returns the columns of documents; the last returns packed pieces.
``run`` writes what each stage returns to the shared folder and reads it again,
so that a lost executor costs at most the stage at hand.

Near copies are texts whose five-word shingles have a similarity of 0.8 or more,
as their SimHash bits tell it.

Defined cases are those of the operators: null and wordless texts fail the
quality rules, so no later stage sees one; documents that repetition removal
empties stay, with an empty text; texts of any length are read whole; of near
copies the row of least id stays, and of equal ids the one read first; repeated
rows are copies; columns of any name pass through unchanged, but for text and
n_chars where a stage changes texts; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common, packing, pii, quality, simhash, suffixdedup
from tarn.llm.queries import MODEL


def _texts_changed(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of ``like``, in order, and n_chars as its texts now have."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[docs[f"`{c}`"] for c in like.columns])


@common.stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge(common.boxed(docs, "doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return common.unboxed(judged.filter("kept"), docs.columns)


@common.stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.without_near_duplicates(docs)


@common.stage
def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat."""
    return _texts_changed(suffixdedup.without_repeats(docs), docs)


@common.stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _texts_changed(pii.redact(docs, pii.train(pii.pattern_counts(docs))), docs)


@common.stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(MODEL), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("personal_data", personal_data),
    ("packing", packing_stage),
]

#: SQL has neither XXH64, the trained span classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.swept(spark) as kept:
            docs, path = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(path)
        if before:
            common.delete(spark, before)
        before = path
        common.release(spark)
    return docs
