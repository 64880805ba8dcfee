"""Exact top-k inner-product search by MaxScore.

Vectors are turned into integers, and a dimension is a term of the query. For every shard of candidates and every term the
least and the greatest contribution are known; counted from the least, contributions are non-negative and have upper
bounds. A query's terms, by bound, split into essential and non-essential ones: the non-essential together cannot lift a
candidate whose essential part falls short of the threshold. The essential terms are traversed for all candidates of a
block, the others are probed in turn for those that stay competitive, and the threshold rises with the k-th best score.
Thresholds start from a bounded sample of candidates, which tasks over the queries score, so that shards only emit what can
still matter.

Queries are taken in blocks of fixed bytes (a broadcast of proven size), as many as fit one pass over the candidates, which
stay where they are. Each shard emits at most k rows a query; shards are merged by a window over the query.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a shorter vector counts as
padded with zeros; repeated rows are candidates each for itself, and a query's own row is every row of its vec_id; rows
with a null vec_id are candidates of no query (an id is needed to report them). No candidates: no rows. Components and scores
beyond 64 bits count as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexloom.llm import common

K = 20
#: Bytes of the queries of one pass, and candidates that give the first thresholds.
QUERY_BYTES, SAMPLE = 32 << 20, 4_096
#: Candidates of one traversal.
BLOCK = 4_096
SCHEMA = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) for every component; rows that take part only."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    # exists() is null where a component is, which the coalesce turns into taking no part
    sound = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of integers, padded with zeros or cut to width."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for i, n in enumerate(lengths):
        out[i, : min(n, width)] = flat[at[i] : at[i] + min(n, width)]
    return out


class MaxScore:
    """One shard's traversal for a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, thresholds: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.thresholds = thresholds.astype(np.float64).copy()
        self.best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ids]
        self.held = np.zeros(len(ids), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids):
            return
        v, q = vectors, self.queries
        # float64 sums integers exactly to 2**53; beyond, every candidate is scored in int64 and no bound is used
        if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1]) >= 2.0**53:
            wide = float(np.abs(v).astype(np.float64).max(initial=0)) * float(np.abs(q).astype(np.float64).max(initial=0)) * max(1, v.shape[1]) >= 2.0**63
            for i in range(len(q)):
                if wide:  # Python's integers, and the nearest 64-bit score
                    exact = vectors.astype(object) @ self.queries[i].astype(object)
                    self._keep(i, ids, np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64))
                else:
                    self._keep(i, ids, vectors @ self.queries[i])
            return
        v, q = v.astype(np.float64), q.astype(np.float64)
        low, high = v.min(0), v.max(0)
        a, b = q * low, q * high
        least, bound = np.minimum(a, b), np.abs(b - a)
        order = np.argsort(-bound, axis=1, kind="stable")
        base = least.sum(1)
        ranked = np.take_along_axis(bound, order, 1)
        after = np.concatenate([np.cumsum(ranked[:, ::-1], 1)[:, ::-1], np.zeros((len(q), 1))], 1)  # what terms i.. can add
        reach = base + after[:, 0]
        for i in np.flatnonzero(reach >= self.thresholds):
            need = self.thresholds[i]
            # Essential: as few leading terms as make the rest unable to reach the threshold by itself.
            n = max(1, int(np.searchsorted(-(base[i] + after[i, 1:]), -need, side="right")))
            n = min(max(n, 16), len(order[i]))
            alive = np.arange(len(ids))
            part = v[:, order[i, :n]] @ q[i, order[i, :n]]
            floor = np.concatenate([[0.0], np.cumsum(np.take(least[i], order[i]))])
            while True:
                # part holds true contributions of the first n terms; the others add at most their greatest one
                most = (base[i] - floor[n]) + after[i, n]
                keep = part + most >= need
                alive, part = alive[keep], part[keep]
                if n == len(order[i]) or not len(alive):
                    break
                step = order[i, n : n + 16]
                part = part + v[np.ix_(alive, step)] @ q[i, step]
                n += len(step)
            if len(alive):
                self._keep(i, ids[alive], part)

    def _keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        own = ids != self.ids[i]
        self.best[i].append((ids[own], scores[own]))
        self.held[i] += int(own.sum())
        if self.held[i] > 4 * self.k:
            self._trim(i)

    def _trim(self, i: int) -> None:
        ids, scores = (np.concatenate(x) for x in zip(*self.best[i], strict=True))
        top = np.lexsort((ids, -scores))[: self.k]
        self.best[i] = [(ids[top], scores[top])]
        self.held[i] = len(top)
        if len(top) == self.k and scores.dtype == np.float64:
            self.thresholds[i] = max(self.thresholds[i], scores[top[-1]])

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, q in enumerate(self.ids):
            if self.held[i]:
                self._trim(i)
                ids, scores = self.best[i][0]
                yield np.full(len(ids), q), ids, scores.astype(np.int64)


def _first_thresholds(sample, width: int, k: int):
    """Adds to queries (vec_id, v) the k-th best score among the sample, minus infinity where it can't be told in floating point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_ids, seed = sample.value
        for b in batches:
            ids, q = b.column(0).to_numpy(), matrix(b.column(1), width)
            out = np.full(len(ids), -np.inf)
            small = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(seed).max(initial=0)) * max(1, width) < 2.0**53
            for lo in range(0, len(ids) if small and len(seed) >= k else 0, 1024):
                s = q[lo : lo + 1024].astype(np.float64) @ seed.T
                s[ids[lo : lo + 1024, None] == seed_ids[None, :]] = -np.inf
                out[lo : lo + 1024] = np.partition(s, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["vec_id", "v", "threshold"])

    return run


def exact_top_k(df: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = 64, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Every query's k best candidates: query_id, rank, vec_id, score. is_query tells query rows by their vec_id."""
    spark = df.sparkSession
    scratch = common.Scratch(spark)
    vectors = scratch.save(integer_vectors(df, key, vector, scale), "vectors")
    stats = vectors.agg(F.max(F.size("v")), F.sum(is_query.cast("long"))).first()
    width, n_queries = int(stats[0] or 0), int(stats[1] or 0)
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    parts = []
    if n_queries:
        blocks = -(-n_queries * 8 * (width + 2 * k) // query_bytes)
        # A bounded sample, alike for equal tables: the least hashes of ids.
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        seeds = spark.sparkContext.broadcast((sample["vec_id"].to_numpy(), matrix(sample["v"].combine_chunks(), width).astype(np.float64)))
        queries = vectors.where(is_query).mapInArrow(_first_thresholds(seeds, width, k), "vec_id long, v array<long>, threshold double")
        queries = scratch.save(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "queries")
        seeds.destroy()
    for b in range(blocks if n_queries else 0):
        own = queries.where(F.col("block") == b).orderBy("vec_id").toArrow()
        if not len(own):
            continue
        shared = spark.sparkContext.broadcast((own["vec_id"].to_numpy(), matrix(own["v"].combine_chunks(), width), own["threshold"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = MaxScore(*shared.value, k)
            for batch in batches:
                own_ids, own_v = batch.column(0).to_numpy(), matrix(batch.column(1), width)
                for lo in range(0, len(own_ids), BLOCK):
                    search.add(own_ids[lo : lo + BLOCK], own_v[lo : lo + BLOCK])
            cols = list(zip(*search.rows(), strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=pa.int64()) for c in cols], schema=schema)

        found = vectors.mapInArrow(run, SCHEMA)
        if blocks > 1:  # one block's broadcast at a time
            found = scratch.save(found, f"block-{b}")
            shared.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


#: Every query against every row: exact, and quadratic by contract.
ORACLE_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op5_exact_top_k": op5_exact_top_k}
ORACLES = {"op5_exact_top_k": ORACLE_OP5}
