"""Components that grow by increments: records that share keys, directly or through others, as new records arrive.

What is stored is only added to: items and keys with the component they had when they came, and moves of components into others.
An increment looks up its own keys and items among the stored ones, in the buckets that they fall into, and settles a graph of
its own records and of the components that they meet, each of these as one node, however many records it holds. So an increment
costs its own rows, what the touched buckets of the index hold and the moves, a row for each component that ever went into
another; components that no new key meets aren't read, and nothing is rewritten. It counts once it is in the log.

A component is named by its least item, as by entities.components(). Defined results: null items are left out; a null list of keys,
or null keys in it, link nothing; an item that comes again, with the same keys or others, stays one item, and links what it meets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import session
from lexloom.operators.entities import contract, node_order
from lexloom.sources.commits import Log

#: Parts of the indexes of items and keys, by hash.
BUCKETS = 256


def _bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


class GrowingComponents:
    """The components below a shared folder. item: the type of items' ids; keys are strings."""

    def __init__(self, spark: SparkSession, root: str | None = None, item: str = "long") -> None:
        self.spark, self.item = spark, item
        self.root = root or f"{session.shared_dir(spark)}/lexloom-components-{uuid.uuid4().hex}"
        self.log = Log(spark, f"{self.root}/log")
        self.schemas = {"items": f"name {item}, component {item}", "keys": f"name string, component {item}", "moves": f"old {item}, component {item}"}

    def _read(self, kind: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{kind}/increment={e['folder']}" for e in self.log.entries().values()]
        columns = self.schemas[kind]
        if not paths:
            return self.spark.createDataFrame([], columns)
        df = self.spark.read.schema(f"{columns}, bucket int").parquet(*paths)
        return (df if buckets is None or len(buckets) == BUCKETS else df.where(F.col("bucket").isin(buckets))).select(*(c.split()[0] for c in columns.split(", ")))

    def _moves(self) -> DataFrame:
        """Where every component that went into another is now."""
        paths = {n: f"{self.root}/moves/increment={e['folder']}" for n, e in self.log.entries().items()}
        if not paths:
            return self.spark.createDataFrame([], self.schemas["moves"])
        df = self.spark.read.schema(f"{self.schemas['moves']}, number long").parquet(*paths.values())
        return df.groupBy("old").agg(F.max_by("component", "number").alias("component"))

    def _met(self, kind: str, wanted: DataFrame, touched: list[int] | None, first: Column, *more: Column) -> DataFrame:
        """Of rows (name, by: an item that has it) each name once, with the first of its items and the component that it is stored
        with (old), null if it isn't. One shuffle finds both; hot names are one row a task before it."""
        none = F.lit(None).cast(self.item)
        stored = self._read(kind, touched).select("name", none.alias("by"), F.col("component").alias("old"))
        rows = wanted.select("name", "by", none.alias("old")).unionByName(stored)
        return rows.groupBy("name").agg(first.alias("by"), F.min("old").alias("old"), *more).where("by IS NOT NULL")

    def _touched(self, mine: DataFrame) -> tuple[list[int] | None, list[int] | None]:
        """The buckets of the items and of the keys of an increment, at most BUCKETS numbers each; None: all, as many rows meet them all."""
        if mine.count() > 64 * BUCKETS:
            return None, None
        rows = mine.select(_bucket("name").alias("i"), F.explode_outer("keys").alias("k"))
        return tuple(rows.agg(F.collect_set("i"), F.collect_set(F.when(F.col("k").isNotNull(), _bucket("k")))).head())

    def add(self, records: DataFrame, item: str = "item", keys: str = "keys", before_commit=None) -> int:
        """Takes an increment (item, array of keys); returns its number. before_commit: called when all is written."""
        folder = uuid.uuid4().hex
        work = f"{self.root}/work-{folder}"
        mine = session.saved(records.select(F.col(item).cast(self.item).alias("name"), F.col(keys).cast("array<string>").alias("keys")).where("name IS NOT NULL"), f"{work}/records")
        keyed = mine.select(F.col("name").alias("by"), F.explode("keys").alias("name")).where("name IS NOT NULL")
        least = F.min_by("by", F.when(F.col("by").isNotNull(), node_order("by")))
        touched = self._touched(mine)
        while True:
            entries = self.log.entries()
            number = self.log.next_number()
            items = session.saved(self._met("items", mine.select("name", F.col("name").alias("by")), touched[0], F.max("by")), f"{work}/items-{number}")
            names = session.saved(self._met("keys", keyed, touched[1], least, F.count("by").alias("n")), f"{work}/keys-{number}")
            moves = self._moves()
            # a component stands for its records by its name, the least of its items; one that went into another is linked to that
            met = items.select("old").unionByName(names.select("old")).where("old IS NOT NULL").distinct()
            now = session.saved(met.join(moves, "old", "left").select("old", F.coalesce("component", "old").alias("component")), f"{work}/now-{number}")
            # of a key's items and its component all are linked to the least one by hash; keys of one item that are new link nothing
            hub = F.when(F.col("old").isNotNull() & (node_order("old") < node_order("by")), F.col("old")).otherwise(F.col("by"))
            hubs = names.where("n > 1 OR old IS NOT NULL").select("name", "old", hub.alias("hub"))
            edges = keyed.join(hubs, "name").select(F.col("by").alias("a"), F.col("hub").alias("b")).unionByName(hubs.where("old IS NOT NULL").select(F.col("old").alias("a"), F.col("hub").alias("b")))
            edges = edges.unionByName(items.where("old IS NOT NULL").select(F.col("name").alias("a"), F.col("old").alias("b"))).unionByName(now.select(F.col("old").alias("a"), F.col("component").alias("b")))
            settled = contract(edges, f"{work}/graph-{number}")
            to = settled.withColumnRenamed("node", "old")
            went = now.select(F.col("component").alias("old")).distinct().join(to, "old").where("old <> component")
            # those that had gone into a component that goes on now go on with it
            further = moves.join(went.withColumnRenamed("old", "via").withColumnRenamed("component", "to"), F.col("component") == F.col("via")).select("old", F.col("to").alias("component"))
            for kind, new in (("items", items), ("keys", names)):
                self._write(new.where("old IS NULL").select("name", F.col("by").alias("node")).join(settled, "node", "left").select("name", F.coalesce("component", "node").alias("component")), kind, folder)
            went.unionByName(further).withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.root}/moves/increment={folder}")
            if before_commit:
                before_commit()
            if self.log.add(number, {"folder": folder, "after": len(entries)}):
                session.remove(self.spark, work)
                return number

    def _write(self, rows: DataFrame, kind: str, folder: str) -> None:
        # sorted by bucket, so that the statistics of Parquet leave out what a later increment doesn't touch
        rows.withColumn("bucket", _bucket("name")).repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{self.root}/{kind}/increment={folder}")

    def labels(self) -> DataFrame:
        """item, component of all increments."""
        held = self._read("items").withColumnRenamed("component", "old")
        return held.join(self._moves(), "old", "left").select(F.col("name").alias("item"), F.coalesce("component", "old").alias("component"))
