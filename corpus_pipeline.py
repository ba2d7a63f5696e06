"""The corpus pipeline: stages that each keep, change or pack the documents of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm.decontaminate import contamination
from paneltide.llm.minhash_dedup import near_duplicates
from paneltide.llm.packing import pack_documents
from paneltide.llm.pii import redact
from paneltide.llm.queries import TOKENIZER
from paneltide.llm.tables import by_row, table
from paneltide.llm.toxicity import score_toxicity
from paneltide.sources.io import stage_via_parquet

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_KEY = ["doc_id", "text_key"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Null and empty texts are scored too; repeated rows share their answer. A null doc_id is a
    document like any other. Further columns pass through.
    """
    scored = score_toxicity(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    toxic = stage_via_parquet(scored.where("predicted = 1").select(*_KEY).distinct())
    return by_row(docs, toxic, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Rows that share a doc_id and a text are one row afterwards (the least in its other columns);
    rows that share a doc_id but not the text are one document of several texts and stay
    together. Documents without a doc_id are in no group and stay, and so do empty texts.
    """
    found = stage_via_parquet(near_duplicates(docs.select("doc_id", "text")))
    gone = stage_via_parquet(found.where(~F.col("kept")).select(*_KEY).distinct())
    left = by_row(docs, gone, "left_anti")
    # An id on several rows: of equal texts one row stays. Texts of other rows aren't shuffled.
    again = stage_via_parquet(found.where("kept and doc_id is not null").groupBy(*_KEY).count()
                              .where("count > 1").select(*_KEY))
    if again.isEmpty():
        return left.select(*docs.columns)
    repeated = by_row(left, again, "left_semi").select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = (repeated.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest"))
             .select("doc_id", "text", "rest.*") if rest else repeated.distinct())
    return (by_row(left, again, "left_anti").select(*docs.columns)
            .unionByName(least.select(*docs.columns)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; repeated rows share their answer.
    """
    found = contamination(docs.select("doc_id", "text"),
                          table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    gone = stage_via_parquet(found.where("contaminated").select(*_KEY).distinct())
    return by_row(docs, gone, "left_anti").select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; every row stays.

    A null text stays null, and n_chars, where there is such a column, follows the new text.
    """
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences.

    A null or empty text is one piece, its end id; repeated rows are packed each; an empty table
    gives no rows.
    """
    return pack_documents(docs.select("doc_id", "text"), TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

# The scores, tokens and links of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the result of the one before, starting with all documents."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = stage_via_parquet(stage(spark, docs, sf_dir))
    return docs
