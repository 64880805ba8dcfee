"""Word-level substring dedup by difference-cover anchors.

Windows are 20 words. Anchors of 8 words are hashed only at places 0, 1, 3 and 9 modulo 13, a perfect difference cover:
whatever the alignment of two equal windows, some covered place is shared, so any match shares an anchor and is then
extended. See repeats.py for the plan.

Defined results: null or empty text has no words and keeps the empty text; documents with an equal doc_id are ordered by
text; of identical rows one is the first; a null doc_id comes before all others; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import common
from lexloom.llm.repeats import Spec, remove_repeats

WORDS = Spec(window=20, period=13, cover=(0, 1, 3, 9), block_bytes=4 << 20)


def substring_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", carry: dict | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: its key, n_words, n_removed, n_spans, kept_sha256, kept_text.

    With carry (names and columns), the struct _carried holds these instead of the key, whatever their names.
    """
    out = remove_repeats(df, WORDS, key, text, carry or {"doc_id": F.col(key).cast("long")}, with_text).withColumnRenamed("n_units", "n_words")
    out = out if carry else out.select("_carried.doc_id", *out.columns[1:])
    return out if with_text else out.drop("kept_text")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(common.documents(spark, sf_dir))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES: dict[str, str] = {}
