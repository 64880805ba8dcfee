"""Hard-negative mining with a table of pivots.

Every vector x of norm |x| <= M gets one more coordinate, sqrt(M^2 - |x|^2), and an anchor q gets 0, which turns the inner product
into a distance: q.x = (|q|^2 + M^2 - d(q, x)^2) / 2. The distances of all rows to a few pivots are stored with them. By the
triangle inequality a stored distance d(p, x) and the anchor's d(q, p) bracket d(q, x), and so the score; rows lie by their
nearest pivot and their distance to it, so that first whole blocks and then rows are ruled out. What a bracket can't rule out
is checked by its integer inner product, and nothing else decides.

Anchors are taken in blocks of fixed bytes (a broadcast of proven size), and each block passes over the candidates, which stay
where they are: once for the positives, once for the negatives. A task emits at most k rows for an anchor or pair, and those of
all tasks are merged by a window over it. Labels group nothing, so a frequent one is no hot key. Pivots come from a bounded
sample of rows; whatever they are, the result is the same.

Defined results: rows with a null label, id or vector, or any null or non-finite component take no part. A shorter vector counts
as padded with zeros. Repeated rows are rows each: an anchor's own row is every row of its id, repeated anchors are anchors
each, and a repeated positive is mined for itself. Without positives or negatives in the window an anchor gives no rows.
Components beyond 64 bits count as the nearest 64-bit number, and so do scores. Other columns are not read.
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
from lexloom.llm.exact_top_k import matrix

POSITIVES = NEGATIVES = 5
#: Percents of the positive's score between which a negative's must lie.
LOW, HIGH = 80, 100
PIVOTS = 12
#: Bytes of the anchors of one pass, and rows from which pivots are chosen.
ANCHOR_BYTES, SAMPLE = 32 << 20, 4_096
#: Candidates that are ruled out or met together.
BLOCK = 1_024
FOUND = "anchor int, anchor_id long, pair int, vec_id long, score long"
#: Room for rounding, relative to the squares that distances are made of.
SLACK = 1e-9
LIMIT = 2.0**63


def labelled_vectors(df: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label and v: floor(scale * x) for every component; rows that take part only."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))


def _exact(q: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products of one anchor with rows, the nearest 64-bit number where they are greater. most: a bound of the sums."""
    if most < 2.0**53:  # where floating point adds integers exactly
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return v @ q
    return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in v.astype(object) @ q.astype(object)], np.int64)


class PivotTable:
    """Pivots in the space of one more coordinate, for rows of a norm of at most `norm`."""

    def __init__(self, pivots: np.ndarray, norm: float) -> None:
        self.square = norm * norm * (1 + SLACK)
        self.pivots = self._raised(pivots.astype(np.float64))
        self.size = (self.pivots**2).sum(1)

    def _raised(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(0.0, self.square - (v**2).sum(1)))[:, None]])

    def _distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (v**2).sum(1)[:, None] + self.size - 2.0 * (v @ self.pivots.T)))

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        return self._distances(self._raised(v.astype(np.float64)))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self._distances(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]))

    def error(self, squares: np.ndarray) -> np.ndarray:
        """How far off a distance can be for rounding: squares are exact to SLACK of their greatest term."""
        return np.sqrt(SLACK * (squares + self.square + self.size.max(initial=0.0)))

    def scores(self, squares: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score of anchors (squares: their |q|^2) whose distance lies between the two."""
        total, off = squares[:, None] + self.square, self.error(squares)[:, None]
        near, far = np.maximum(0.0, nearest - 2 * off), farthest + 2 * off
        # a score beyond 64 bits counts as the nearest 64-bit number
        return np.clip((total * (1 - SLACK) - far**2) / 2 - 1, -LIMIT, LIMIT), np.clip((total * (1 + SLACK) - near**2) / 2 + 1, -LIMIT, LIMIT)


class _Best:
    """The k best of an anchor or pair: greatest score, then least id."""

    __slots__ = ("k", "ids", "scores")

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        top = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -(1 << 63) else -scores))[: self.k]
        self.ids, self.scores = ids[top], scores[top]

    @property
    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf


class Anchors:
    """A block of anchors and what each looks for.

    positives: None looks for the k best of the same label; else, for every positive's score, for the k best of other labels
    within the window below it.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, k: int, positives: list[np.ndarray] | None = None, window: tuple[int, int] = (LOW, HIGH)) -> None:
        self.ids, self.labels, self.q, self.k, self.positives, self.window = ids, labels, q, k, positives, window
        n = [1] * len(ids) if positives is None else [len(p) for p in positives]
        self.best = [[_Best(k) for _ in range(m)] for m in n]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that still matters to each anchor."""
        low, high = np.full(len(self.ids), np.inf), np.full(len(self.ids), -np.inf)
        for i, best in enumerate(self.best):
            for j, b in enumerate(best):
                top = np.inf if self.positives is None else float(self.positives[i][j]) * self.window[1] / 100
                bottom = -np.inf if self.positives is None else float(self.positives[i][j]) * self.window[0] / 100
                if bottom <= top:
                    low[i], high[i] = min(low[i], max(bottom, b.least)), max(high[i], top)
        with np.errstate(invalid="ignore"):  # an anchor that looks for nothing has no bounds
            return low - SLACK * np.abs(low), high + SLACK * np.abs(high)

    def fit(self, i: int, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Which rows an anchor may have, whatever their score."""
        return (ids != self.ids[i]) & ((labels == self.labels[i]) if self.positives is None else (labels != self.labels[i]))

    def meet(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows that the bracket left for an anchor, with their exact scores."""
        if self.positives is None:
            self.best[i][0].add(ids, scores)
            return
        for j, p in enumerate(self.positives[i]):
            # Python's integers where a hundredfold score leaves 64 bits
            wide = max(abs(int(p)), *(int(abs(float(x))) for x in (scores.min(initial=0), scores.max(initial=0)))) > 1 << 55
            s = scores.astype(object) if wide else scores
            inside = np.asarray((self.window[0] * int(p) <= 100 * s) & (100 * s <= self.window[1] * int(p)), bool)
            self.best[i][j].add(ids[inside], scores[inside])

    def rows(self, target: pa.Schema) -> pa.RecordBatch:
        found = [(i, j, b) for i, best in enumerate(self.best) for j, b in enumerate(best) if len(b.ids)]
        n = [len(b.ids) for *_, b in found]
        cols = [np.repeat([i for i, *_ in found], n), np.repeat([self.ids[i] for i, *_ in found], n), np.repeat([j for _, j, _ in found], n), *(np.concatenate([getattr(b, x) for *_, b in found] or [np.empty(0, np.int64)]) for x in ("ids", "scores"))]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64), pa.int64()).cast(f.type) for c, f in zip(cols, target, strict=True)], schema=target)


def traverse(anchors: Anchors, table: PivotTable, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, stored: np.ndarray) -> int:
    """All anchors against a batch of rows and their stored distances; returns how many pairs were checked exactly."""
    checked = 0
    if not len(ids) or not len(anchors.ids):
        return checked
    q = anchors.q.astype(np.float64)
    most_sum = float(np.abs(q).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * max(1, v.shape[1])
    squares, to_pivots = (q**2).sum(1), table.of_anchors(anchors.q)
    # near rows together: by the nearest pivot, then by the distance to it
    nearest = stored.argmin(1)
    order = np.lexsort((stored[np.arange(len(ids)), nearest], nearest))
    for lo in range(0, len(order), BLOCK):
        at = order[lo : lo + BLOCK]
        own = stored[at]
        first, last = own.min(0), own.max(0)
        low, high = anchors.bounds()
        least, most = table.scores(squares, np.maximum(to_pivots - last, first - to_pivots).max(1)[:, None], (to_pivots + last).min(1)[:, None])
        met = np.flatnonzero((most[:, 0] >= low) & (least[:, 0] <= high))
        for part in (met[i : i + 64] for i in range(0, len(met), 64)):
            near, far = np.zeros((len(part), len(at))), np.full((len(part), len(at)), np.inf)
            for p in range(own.shape[1]):
                a, b = to_pivots[part, p][:, None], own[None, :, p]
                np.maximum(near, np.abs(a - b), out=near)
                np.minimum(far, a + b, out=far)
            least, most = table.scores(squares[part], near, far)
            left = (most >= low[part, None]) & (least <= high[part, None])
            for k, i in enumerate(part):
                own_left = np.flatnonzero(left[k])
                own_left = own_left[anchors.fit(i, ids[at[own_left]], labels[at[own_left]])]
                if anchors.positives is None and len(own_left) > anchors.k:  # as many rows surely reach the k-th of the least scores
                    surely = np.partition(least[k, own_left], -anchors.k)[-anchors.k]
                    own_left = own_left[most[k, own_left] >= surely]
                rows = at[own_left]
                if len(rows):
                    checked += len(rows)
                    anchors.meet(i, ids[rows], _exact(anchors.q[i], v[rows], most_sum))
    return checked


def _mined(candidates: DataFrame, shared) -> DataFrame:
    """What each task's rows hold for a block of anchors. shared: (anchors' arguments, pivot table, width)."""
    target = to_arrow_schema(StructType.fromDDL(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, table, width = shared.value
        anchors = Anchors(*given)
        for b in batches:
            traverse(anchors, table, b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), width), matrix_of_floats(b.column(3)))
        yield anchors.rows(target)

    return candidates.mapInArrow(run, FOUND)


def matrix_of_floats(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "pair").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES,
    window: tuple[int, int] = (LOW, HIGH), pivots: int = PIVOTS, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """For every anchor and each of its first positives, the first rows of other labels whose score lies in the window of percents of
    the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = df.sparkSession
    scratch = common.Scratch(spark)
    rows = scratch.save(labelled_vectors(df, label, key, vector, scale), "rows")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    width, n_anchors, norm = rows.agg(F.max(F.size("v")), F.sum(is_anchor.cast("long")), F.sqrt(F.max(square))).first()
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], out_schema)
    width = max(1, width)
    # A bounded sample, alike for equal tables: the least hashes of ids.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()["v"].combine_chunks()
    table = PivotTable(_spread(matrix(sample, width), pivots), float(norm))
    scratch.save(_with_distances(rows, table, width), "table")
    candidates = spark.read.schema("vec_id long, label long, v array<long>, distances array<double>").parquet(f"{scratch.dir}/table")

    size = 8 * (width + len(table.pivots) + 4 * positives * (negatives + 2) + 8)
    blocks = -(-n_anchors * size // anchor_bytes)
    anchors = rows.where(is_anchor).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    parts = []
    for b in range(blocks):
        own = anchors.where(F.col("block") == b).orderBy("vec_id", "label", "v").toArrow()
        if not len(own):
            continue
        ids, labels, q = own["vec_id"].to_numpy(), own["label"].to_numpy(), matrix(own["v"].combine_chunks(), width)
        shared = spark.sparkContext.broadcast(((ids, labels, q, positives), table, width))
        pairs = _best_of(_mined(candidates, shared), positives).select("anchor", (F.col("rank") - 1).alias("pair"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        pairs = scratch.save(pairs, f"pairs-{b}")
        shared.destroy()
        # as many rows as the block has anchors times the positives
        got = pairs.select("anchor", "pair", "positive_score").toArrow()
        order = np.lexsort((got["pair"].to_numpy(), got["anchor"].to_numpy()))
        ends = np.searchsorted(got["anchor"].to_numpy()[order], np.arange(len(ids) + 1))
        scores = got["positive_score"].to_numpy()[order]
        shared = spark.sparkContext.broadcast(((ids, labels, q, negatives, [scores[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)], window), table, width))
        found = _best_of(_mined(candidates, shared), negatives).join(pairs, ["anchor", "pair"])
        parts.append(scratch.save(found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), f"found-{b}"))
        shared.destroy()
        scratch.drop(f"pairs-{b}")
    for name in ("rows", "table"):
        scratch.drop(name)
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots far apart: each next one is the row that lies farthest from those that are chosen."""
    v = sample.astype(np.float64)
    if not len(v):
        return v
    chosen = [int((v**2).sum(1).argmax())]
    away = np.full(len(v), np.inf)
    while len(chosen) < min(n, len(v)):
        away = np.minimum(away, ((v - v[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(away.argmax()))
    return v[chosen]


def _with_distances(rows: DataFrame, table: PivotTable, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = table.of_rows(matrix(b.column(2), width))
            at = pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(far.ravel()))], names=["vec_id", "label", "v", "distances"])

    return rows.mapInArrow(run, "vec_id long, label long, v array<long>, distances array<double>")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, moved)


#: Every anchor against every row: exact, and quadratic by contract.
ORACLE_OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": ORACLE_OP12}
