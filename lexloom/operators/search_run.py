"""Searches of many runs at several providers, page after page, that can stop after any step and go on.

A step takes the frontier (the runs' next pages), asks for as many pages of each as the step is wide, keeps those up to the first
that ends its list or fails, and writes the pages, the next frontier and what is over. It counts once its number is in the log, so
a step that was cut off is done again, and what is committed is never asked for nor read again: the frontier is all that a step
reads. Runs are rows, so that a step is one job for all of them, and there are as many steps as the longest run has widths of pages.

States: running; exhausted at the end of a provider's list; page_limit at the last page that was asked for; paused at a failed
answer, or where none came, until resume(). Defined results: requests without run or provider are left out, repeated ones are one
(of several, that with the least pages); with a last page before the first a request is at its page_limit at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.session import shared_dir
from lexloom.sources.commits import Log

FRONTIER = "run_id string, provider string, page int, end_page int, tries int, pages_completed int, results long, status string"


class SearchRuns:
    """Searches below a shared folder.

    fetch: asked pages (run_id, provider, page, tries) to answers (run_id, provider, page, reached_end, failure, records), records an array;
    reached_end null: a page of fewer than page_size records is the last one.
    """

    def __init__(self, spark: SparkSession, fetch: Callable[[DataFrame], DataFrame], records: str, root: str | None = None, width: int = 4, page_size: int = 20) -> None:
        self.spark, self.fetch, self.records, self.width, self.page_size = spark, fetch, records, width, page_size
        self.root = root or f"{shared_dir(spark)}/lexloom-search-{uuid.uuid4().hex}"
        self.log = Log(spark, f"{self.root}/log")

    def _table(self, kind: str, schema: str, steps: list[int]) -> DataFrame:
        if not steps:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{kind}/step-{k}" for k in steps))

    def _write(self, df: DataFrame, kind: str, step: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{kind}/step-{step}")

    def _steps(self, kind: str = "pages") -> list[int]:
        return [k for k, e in self.log.entries().items() if kind in e]

    def start(self, requests: DataFrame) -> None:
        """requests: run_id, provider, start_page, end_page. Does nothing where the searches were started already."""
        if self.log.entries():
            return
        rows = requests.where("run_id IS NOT NULL AND provider IS NOT NULL").groupBy("run_id", "provider")
        one = rows.agg(F.min(F.struct((F.col("end_page") - F.col("start_page")).alias("n"), "start_page", "end_page")).alias("r"))
        status = F.when(F.col("r.start_page") > F.col("r.end_page"), "page_limit").otherwise("running")
        first = one.select("run_id", "provider", F.col("r.start_page").cast("int").alias("page"), F.col("r.end_page").cast("int").alias("end_page"), F.lit(0).alias("tries"), F.lit(0).alias("pages_completed"), F.lit(0).cast("long").alias("results"), status.alias("status"))
        self._commit(0, first)

    def _commit(self, step: int, rows: DataFrame, pages: DataFrame | None = None) -> None:
        """Writes a step's tables, of which rows is read once, and adds it to the log."""
        told = f"{self.root}/told/step-{step}"
        rows.write.mode("overwrite").parquet(told)
        rows = self.spark.read.schema(FRONTIER).parquet(told)
        over = F.col("status").isin("exhausted", "page_limit")
        self._write(rows.where(~over), "frontier", step)
        self._write(rows.where(over), "over", step)
        left = {r["status"]: r["count"] for r in self._table("frontier", FRONTIER, [step]).groupBy("status").count().collect()}
        entry = {"frontier": left, **({"pages": 1} if pages is not None else {})}
        if not self.log.add(step, entry):
            raise RuntimeError(f"step {step} was committed by another writer")

    def step(self) -> bool:
        """Takes one step; False if nothing is running."""
        entries = self.log.entries()
        last = max(entries)
        if not entries[last]["frontier"].get("running"):
            return False
        now = self._table("frontier", FRONTIER, [last])
        running, resting = now.where("status = 'running'"), now.where("status <> 'running'")
        asked = running.select("run_id", "provider", F.explode(F.sequence("page", F.least(F.col("end_page"), F.col("page") + self.width - 1))).alias("page"), "tries")
        answers = self.fetch(asked).select("run_id", "provider", "page", "reached_end", "failure", "records").dropDuplicates(["run_id", "provider", "page"])
        got = asked.join(answers, ["run_id", "provider", "page"], "left")
        failed = F.col("records").isNull() | F.col("failure").isNotNull()
        ended = ~failed & F.coalesce("reached_end", F.size("records") < self.page_size)
        # up to the first page that ends the list or fails: as many rows of a run as the step is wide
        before = Window.partitionBy("run_id", "provider").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        got = got.withColumn("failed", failed).withColumn("ended", ended).withColumn("past", F.coalesce(F.max(F.col("failed") | F.col("ended")).over(before), F.lit(False)))
        self._write(got.where(~F.col("past")).select("run_id", "provider", "page", "failed", "ended", "records"), "pages", last + 1)
        taken = self._table("pages", f"run_id string, provider string, page int, failed boolean, ended boolean, records {self.records}", [last + 1])
        moved = taken.groupBy("run_id", "provider").agg(
            F.sum((~F.col("failed")).cast("int")).cast("int").alias("n"), F.sum(F.when(~F.col("failed"), F.size("records")).otherwise(0)).alias("found"), F.max("ended").alias("ended"), F.max("failed").alias("failed")
        )
        page = F.col("page") + F.col("n")
        status = F.when(F.col("ended"), "exhausted").when(F.col("failed"), "paused").when(page > F.col("end_page"), "page_limit").otherwise("running")
        after = running.drop("status").join(moved, ["run_id", "provider"]).select(
            "run_id", "provider", page.cast("int").alias("page"), "end_page", F.when(F.col("n") > 0, 0).otherwise(F.col("tries")).alias("tries"), (F.col("pages_completed") + F.col("n")).cast("int").alias("pages_completed"),
            (F.col("results") + F.col("found")).alias("results"), status.alias("status"),
        )
        self._commit(last + 1, after.unionByName(resting), taken)
        return True

    def run(self, max_steps: int | None = None) -> int:
        """Steps until nothing is running, or so many; returns how many."""
        n = 0
        while (max_steps is None or n < max_steps) and self.step():
            n += 1
        return n

    def resume(self, more_pages: int = 0) -> bool:
        """Lets paused runs ask again, and those at their last page for more; False if there is none of them."""
        entries = self.log.entries()
        last = max(entries)
        paused = entries[last]["frontier"].get("paused", 0)
        limited = self._over().where("status = 'page_limit'") if more_pages else None
        if not paused and (limited is None or limited.isEmpty()):
            return False
        rows = self._table("frontier", FRONTIER, [last]).withColumn("tries", F.when(F.col("status") == "paused", F.col("tries") + 1).otherwise(F.col("tries"))).withColumn("status", F.lit("running"))
        if limited is not None:
            rows = rows.unionByName(limited.withColumn("end_page", F.col("end_page") + more_pages).withColumn("status", F.lit("running")))
        self._commit(last + 1, rows)
        return True

    def _over(self) -> DataFrame:
        """The runs that are over, of those that went on again only the last time."""
        over = self._table("over", FRONTIER, list(self.log.entries()))
        row = F.max_by(F.struct(*[c.split()[0] for c in FRONTIER.split(", ")]), "end_page").alias("r")
        last = max(self.log.entries())
        going = self._table("frontier", FRONTIER, [last]).select("run_id", "provider")
        return over.groupBy("run_id", "provider").agg(row).select("r.*").join(going, ["run_id", "provider"], "left_anti")

    def states(self) -> DataFrame:
        """run_id, provider, page (the next one), end_page, tries, pages_completed, results, status."""
        return self._table("frontier", FRONTIER, [max(self.log.entries())]).unionByName(self._over())

    def pages(self) -> DataFrame:
        """run_id, provider, page, ended, records of every committed page."""
        schema = f"run_id string, provider string, page int, failed boolean, ended boolean, records {self.records}"
        return self._table("pages", schema, self._steps()).where("NOT failed").drop("failed")
