"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept (the
first gets the table ``documents``), and returns the rows it keeps with the columns of
``documents``; the last returns the packing.  Between stages the rows are written as
Parquet and read again.  Ids are those of ``documents``, and need not be unique: every
stage decides by row.

Rows: null texts are empty; quality rejects by its score, language ID rejects texts without a
recognised language, exact dedup keeps one row of equal texts (the largest id; a null id is
the smallest), near dedup one row of each group (the smallest id; a null id is the largest; of
one id the text of the smaller digest), and packing gives a document without text no
bin.  A table without labels rejects nothing for quality, one without languages
nothing for language; an empty table gives an empty packing; extra columns are kept up
to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm import exact_dedup, lang_id, packing, quality, simhash
from promptloom.llm.common import free_name, label_split, shared_folder

FIT_MARGIN = 0.1     # share of known words below what 999 of 1,000 texts of a language reach
ORACLE_SQL = None    # the classifiers are trained; tests/llm holds a brute-force version


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score 0.7 or more; learns as op5 does."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.fit(docs, labels, label_split("_id", 4) != 2)
    if not model.fitted:
        return docs
    score = free_name(docs.columns, "score")
    return quality.score(docs, model, out=score).filter(F.col(score) >= 0.7).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of a recognised language: a posterior of 0.5 or more and, in a text of 20 words
    or more, about the share of known words that its own texts have; learns as op4 does."""
    model = lang_id.fit(docs, label_split("doc_id", 4) != 2)
    if not model.langs:
        return docs
    pred = free_name(docs.columns, "lang_pred")
    score = free_name([*docs.columns, pred], "score")
    fit = free_name([*docs.columns, pred, score], "fit")
    out = lang_id.predict(docs, model, pred=pred, score=score, fit=fit)
    good = (F.col(pred) != lang_id.UNKNOWN) & (F.col(score) >= 0.5) & F.coalesce(F.col(fit) >= -FIT_MARGIN, F.lit(True))
    return out.filter(good).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of largest id among equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest id."""
    return simhash.drop_near_duplicates(docs, words=3, max_bits=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-token sequences packed into bins, as op8 does."""
    n = F.octet_length(F.coalesce("text", F.lit("")))
    return packing.pack(docs, F.when(n > 0, n + 1).otherwise(0))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
