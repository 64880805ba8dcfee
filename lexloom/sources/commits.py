"""Commits on Hadoop paths: a numbered log in a shared folder, artefacts that are published exactly once, and their reading.

Spark's tasks write new files into the folder of their job, where its own commit protocol leaves one copy of what speculative or
repeated tasks write. Nothing of it counts until the driver adds one entry to the log, by creating a file that mustn't exist yet.
So a job that fails leaves nothing that is read, a job that is run again finds its artefacts published, and of two writers that
took the same number the second looks again at what the first has published. What is stored is never rewritten: a publication costs
its own rows, and of the index what Parquet's statistics can't leave out by the buckets that its names fall into.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import session

#: Parts of an index by the hash of the name, by which its files are sorted.
BUCKETS = 64
INDEX = "name string, sha256 string, version int, bytes long"


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file, and only if there is none; False if there is one."""
    p, fs = _filesystem(spark, path)
    if fs.exists(p):
        return False
    from py4j.protocol import Py4JJavaError

    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass()):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it isn't there."""
    p, fs = _filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class Log:
    """Numbered entries (JSON), each written once. An entry that a writer left unfinished counts for nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._known = spark, root, {}

    def entries(self) -> dict[int, dict]:
        names = [n for n in names_in(self.spark, self.root) if n.endswith(".json") and n not in self._known]
        if names:
            for r in self.spark.read.option("wholetext", True).text([f"{self.root}/{n}" for n in names]).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect():
                try:
                    self._known[r["name"]] = json.loads(r["value"])
                except ValueError:
                    pass
        return {int(n.removesuffix(".json")): e for n, e in sorted(self._known.items())}

    def next_number(self) -> int:
        taken = [int(n.removesuffix(".json")) for n in names_in(self.spark, self.root) if n.endswith(".json")]
        return max(taken, default=-1) + 1

    def add(self, number: int, entry: dict) -> bool:
        """False if the number is taken."""
        return create_once(self.spark, f"{self.root}/{number:010d}.json", json.dumps(entry) + "\n")


class Published:
    """Artefacts (name, content) below a folder: each content of a name is kept once, as a version of it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, f"{self.root}/log")

    def _index(self, attempts: list[str], buckets: list[int] | None = None) -> DataFrame:
        if not attempts:
            return self.spark.createDataFrame([], f"{INDEX}, job string")
        paths = [f"{self.root}/index/{a}" for a in attempts]
        df = self.spark.read.schema(f"{INDEX}, job string, kind string, bucket int").option("basePath", f"{self.root}/index").parquet(*paths).where("kind = 'new'")
        return (df if buckets is None else df.where(F.col("bucket").isin(buckets))).select("name", "sha256", "version", "bytes", "job")

    def index(self) -> DataFrame:
        """name, sha256, version, bytes of all that is published."""
        return self._index([e["index"] for e in self.log.entries().values()]).drop("job")

    def contents(self) -> DataFrame:
        """name, version, sha256, content of all that is published."""
        entries = self.log.entries().values()
        jobs = [f"{self.root}/data/job={e['job']}" for e in entries]
        if not jobs:
            return self.spark.createDataFrame([], "name string, version int, sha256 string, content string")
        data = self.spark.read.schema("name string, content string, sha256 string, job string").option("basePath", f"{self.root}/data").parquet(*jobs)
        return self._index([e["index"] for e in entries]).join(data, ["job", "name", "sha256"]).select("name", "version", "sha256", "content")

    def publish(self, artefacts: DataFrame, versions: bool = True, before_commit=None) -> DataFrame:
        """name, sha256, version, outcome of every different artefact (name, content): existing if the name has that content already, created,
        versioned if it had another one, or refused then (versions=False). Rows of null name or content are left out.

        Of several new contents of a name the one with the least hash comes first. before_commit: called when all is written.
        """
        job = uuid.uuid4().hex
        given = artefacts.where("name IS NOT NULL AND content IS NOT NULL").select(F.col("name").cast("string"), F.col("content").cast("string"))
        # Written first and once, as the caller's rows may not come out alike again.
        staged = f"{self.root}/data/job={job}"
        given.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["name", "sha256"]).write.option("compression", "zstd").parquet(staged)
        mine = self.spark.read.schema("name string, content string, sha256 string").parquet(staged)
        rows = mine.select("name", "sha256", F.octet_length("content").cast("long").alias("bytes"), F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # at most BUCKETS numbers
        for attempt in range(1000):
            number, name = self.log.next_number(), f"attempt={job}-{attempt}"
            known = self._index([e["index"] for e in self.log.entries().values()], touched)
            kind = F.when(F.col("outcome").isin("created", "versioned"), "new").otherwise("old")
            settled = _settled(rows, known, versions).select("name", "sha256", "version", "bytes", F.lit(job).alias("job"), "outcome", kind.alias("kind"), "bucket")
            settled.repartition("bucket").sortWithinPartitions("bucket").write.partitionBy("kind").parquet(f"{self.root}/index/{name}")
            if before_commit:
                before_commit()
            if self.log.add(number, {"job": job, "index": name}):
                schema = f"{INDEX}, job string, outcome string, kind string, bucket int"
                return self.spark.read.schema(schema).parquet(f"{self.root}/index/{name}").select("name", "sha256", "version", "outcome")
        raise RuntimeError("other writers were first a thousand times")

    def vacuum(self) -> int:
        """Removes what jobs left that aren't in the log; to be called when no writer is at work. Returns how many folders went."""
        entries = self.log.entries().values()
        keep = {f"job={e['job']}" for e in entries} | {e["index"] for e in entries}
        gone = [f"{self.root}/{d}/{n}" for d in ("data", "index") for n in names_in(self.spark, f"{self.root}/{d}") if n not in keep and not n.startswith((".", "_"))]
        for path in gone:
            session.remove(self.spark, path)
        return len(gone)


def _settled(rows: DataFrame, known: DataFrame, versions: bool) -> DataFrame:
    """rows (name, sha256, ...) with outcome and version, by what is known (name, sha256, version)."""
    have = known.select("name", "sha256", F.col("version").alias("_have"))
    last = known.groupBy("name").agg(F.max("version").alias("_last"))
    out = rows.join(have, ["name", "sha256"], "left").join(last, "name", "left")
    # a name has few new contents at a time, which are numbered on
    nth = F.row_number().over(Window.partitionBy("name", F.col("_have").isNull()).orderBy("sha256"))
    outcome = (
        F.when(F.col("_have").isNotNull(), "existing")
        .when(F.col("_last").isNull() & (F.col("_nth") == 1), "created")
        .otherwise("versioned" if versions else "refused")
    )
    version = F.coalesce("_have", F.coalesce("_last", F.lit(0)) + F.col("_nth")).cast("int")
    out = out.withColumn("_nth", nth).withColumn("outcome", outcome).withColumn("version", F.when(F.col("outcome") != "refused", version))
    return out.drop("_have", "_last", "_nth")
