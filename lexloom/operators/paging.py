"""Pages by key: a sorted table whose next page is found by the last key of the one before.

Rows are dealt out by ranges of their order, sorted within each, and written as one folder a range, with an index of their last keys
and counts. A page reads of the index the first ranges that aren't past, and of the table only those that can hold its rows, so
that the ten-thousandth page costs what the first one does. Nothing is sorted beyond a range, and no count or offset is worked out.

Defined results: keys must tell rows apart, or rows of an equal last key are lost between pages; null comes first in ascending order
and last in descending order. An empty table has one empty page.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.session import shared_dir
from lexloom.sources.commits import create_once


class PagedTable:
    """A table below a folder, in the order of keys: names, with a '-' before those in descending order."""

    def __init__(self, spark: SparkSession, keys: list[str], root: str | None = None) -> None:
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/lexloom-paged-{uuid.uuid4().hex}"
        self.keys = [(k.removeprefix("-"), k.startswith("-")) for k in keys]

    def _order(self) -> list[Column]:
        return [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_first() for k, down in self.keys]

    def write(self, df: DataFrame, ranges: int | None = None) -> None:
        """ranges: how many; by default as many as a shuffle has partitions."""
        order = self._order()
        dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
        dealt.withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order).write.partitionBy("_range").parquet(f"{self.root}/rows")
        create_once(self.spark, f"{self.root}/schema/schema.json", df.schema.json())
        # of every range the last row, by its order turned round
        back = [F.col(k).asc_nulls_first() if down else F.col(k).desc_nulls_last() for k, down in self.keys]
        keys = self._rows().select("_range", *(k for k, _ in self.keys))
        last = keys.withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(*back))).where("_nth = 1").select("_range", F.struct(*(k for k, _ in self.keys)).alias("last"))
        last.join(keys.groupBy("_range").agg(F.count("*").alias("n")), "_range").coalesce(1).write.parquet(f"{self.root}/index")

    def _rows(self, ranges: list[int] | None = None) -> DataFrame:
        known = self.spark.read.option("wholetext", True).text(f"{self.root}/schema/schema.json").first()[0]
        schema = StructType.fromJson(json.loads(known)).add("_range", "integer")
        paths = [f"{self.root}/rows"] if ranges is None else [f"{self.root}/rows/_range={r}" for r in ranges]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/rows").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _past(self, of: str, after: tuple) -> Column:
        """Whether the keys come after those given."""
        out = F.lit(False)
        for i in reversed(range(len(self.keys))):
            name, down = self.keys[i]
            c, v = F.col(f"{of}{name}"), F.lit(after[i])
            if after[i] is None:
                further = F.lit(False) if down else c.isNotNull()
            else:
                further = F.coalesce(c < v, F.lit(True)) if down else F.coalesce(c > v, F.lit(False))
            out = further | (c.eqNullSafe(v) & out)
        return out

    def page(self, after: tuple | None = None, limit: int = 20) -> tuple[list, tuple | None]:
        """Rows, and the key after which the next page begins; None where there is none."""
        index = self.spark.read.parquet(f"{self.root}/index")
        if after is not None:
            index = index.where(self._past("last.", after))
        # of the first range some rows may be before the page; the others count in full
        parts, held = [], 0
        for r in index.orderBy("_range").limit(limit + 2).toLocalIterator():
            parts.append(r["_range"])
            held += r["n"] if len(parts) > 1 else 0
            if held > limit:
                break
        rows = self._rows(parts).drop("_range")
        rows = rows if after is None else rows.where(self._past("", after))
        got = rows.orderBy(*self._order()).limit(limit + 1).collect()
        more = len(got) > limit
        return got[:limit], tuple(got[limit - 1][k] for k, _ in self.keys) if more else None
