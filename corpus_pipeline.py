"""The training-data pipeline: quality rules, near-duplicate removal, substring dedup, secret masking, packing.

Every stage works on what its predecessor kept, written as Parquet to the shared folder and read again.

Defined results: a null text counts as empty and fails the quality rules; an empty text that reaches a later stage stays one
of no words. Rows with equal or null doc_id are documents of their own; of a group of near copies the row with the least
doc_id stays, null last, and of equal ones any one. Of ties in substring dedup the first in the order of doc_id (null first)
and text keeps its words. Columns besides text and n_chars pass through as they are, whatever their names. Empty tables give
empty tables. A text is worked on whole, so that one row's text must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import common
from lexloom.llm.best_fit_packing import best_fit_packing
from lexloom.llm.ngram_jaccard import ngram_jaccard_join
from lexloom.llm.quality_rules import judge
from lexloom.llm.secret_scans import digest, find_secrets, mask
from lexloom.llm.substring_dedup import substring_dedup
from lexloom.session import ship


def _named(name: str, of: str = "") -> Column:
    """A column by its whole name, whatever characters it has; of: the struct that holds it."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def _clean(text: str) -> str | None:
    """The text without the lines that fail, or None where the document is rejected."""
    *_, kept, _, clean = judge(text)
    return clean if kept else None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines."""
    ship(spark)
    return common.edit_texts(docs, _clean)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more): that with the least doc_id."""
    ship(spark)
    # The documents travel as one struct, beside which only this stage's own columns stand.
    whole = F.struct(*(_named(c) for c in docs.columns))
    numbered = common.Scratch(spark).save(docs.select(whole.alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    groups = ngram_jaccard_join(numbered.select("row", F.col("doc.text").alias("text")), n=5, pct=80, key="row").select(F.col("doc_id").alias("row"), "component_id")
    # Groups are by row; the least doc_id of each stays, and of equal ones the least row.
    by_group = groups.join(numbered.select("row", F.col("doc.doc_id").alias("doc_id")), "row")
    first = by_group.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))["row"].alias("row")).select("row")
    return numbered.join(first, "row", "left_semi").select(*(_named(c, "doc").alias(c) for c in docs.columns))


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 20-word windows that occur earlier."""
    ship(spark)
    rest = {c: _named(c) for c in docs.columns if c != "text"} or {"doc_id": F.lit(None).cast("long")}
    out = substring_dedup(docs, carry=rest, with_text=True)

    def column(c: str) -> Column:
        if c == "text":
            return F.col("kept_text").alias(c)
        if c == "n_chars":
            return F.length("kept_text").cast(docs.schema["n_chars"].dataType).alias(c)
        return _named(c, "_carried").alias(c)

    return out.select(*map(column, docs.columns))


def _mask(text: str) -> str:
    base, added, _ = find_secrets(text)
    return mask(text, digest(base + added)) if base or added else text


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    ship(spark)
    return common.edit_texts(docs, _mask)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    ship(spark)
    return best_fit_packing(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("substring dedup", substrings_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenizers and decoders aren't SQL: tests/llm/test_pipeline.py holds every stage and the whole against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark)
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
