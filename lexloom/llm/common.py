"""Shared helpers of the training-data operators: reading, scratch tables, per-document Arrow maps."""

from __future__ import annotations

import gc
import secrets
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from lexloom import session

#: Rows of a batch are handed to Python in slices of at most this many characters.
SLICE_CHARS = 1 << 22


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir."""
    return f"{session.shared_dir(spark)}/lexloom-{uuid.uuid4().hex}"


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor's tasks read them again."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.dir = spark, shared_dir(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.dir}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes a table (or all of them) once nothing lazy reads it any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing can reach any more, now that their results are in tables.

    Its cleaner works beside the driver and is given a moment, so that the next step doesn't fill the disks before it is through.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts add up to about SLICE_CHARS; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > SLICE_CHARS:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def map_texts(df: DataFrame, fn: Callable[[list[int | None], list[str]], dict], schema: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Applies fn to (ids, texts) slices of every partition; fn returns columns. Null texts arrive as ''.

    fn must be a module-level function or a picklable callable. Other columns of df are not read.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo, hi in slices_of(texts):
                part = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                cols = fn(ids[lo:hi], part)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in target], schema=target)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def slices_of(column: pa.Array) -> Iterator[tuple[int, int]]:
    """As slices(), by the byte lengths of an Arrow column."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
        yield begin, end
        begin = end


def new_seed() -> int:
    """A secret that hashes of one run are keyed with, so that nobody can write texts whose hashes are equal. Drawn once, on the driver."""
    return secrets.randbits(63)


#: The secret of hashes that never leave a process.
OWN_SEED = new_seed()


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    """64-bit keyed hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words))


def multilinear_keys(seed: int, words: int, names: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, (names, words + 1), np.uint64)


def multilinear(columns: Iterable[np.ndarray], keys: np.ndarray, n: int) -> np.ndarray:
    """Names of n sequences of 32-bit words, given word by word: one row of 32 bits for each row of keys.

    The high half of a keyed sum modulo 2**64 is strongly universal: whatever two different sequences are, their names are equal with
    probability 2**-32 for each row, independently of the others.
    """
    out = np.repeat(keys[:, -1:], n, 1)
    for i, column in enumerate(columns):
        x = column.astype(np.uint64)
        for row, k in zip(out, keys[:, i], strict=True):
            row += x * k
    return out >> np.uint64(32)


def lookup(keys: list[bytes], known: dict[bytes, bytes], learn: Callable[[list[bytes]], None]) -> list[bytes]:
    """known[k] for every key, after learn() has added the missing ones."""
    found = list(map(known.get, keys))
    missing = list(set(compress(keys, map(is_, found, repeat(None)))))
    if missing:
        learn(missing)
        found = [known[k] if x is None else x for k, x in zip(keys, found, strict=True)]
    return found


M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    x ^= x >> np.uint64(32)
    x *= M3
    x ^= x >> np.uint64(29)
    return x


#: Elements that are hashed at a time, so that all steps on them stay in a core's cache.
CHUNK = 1 << 14


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a, b; not symmetric."""
    out = np.empty(len(a), np.uint64)
    spare = np.empty(min(CHUNK, len(a)), np.uint64)
    for i in range(0, len(a), CHUNK):
        x = out[i : i + CHUNK]
        s = spare[: len(x)]
        np.multiply(a[i : i + CHUNK], M1, out=x)
        x += b[i : i + CHUNK]
        np.right_shift(x, np.uint64(29), out=s)
        x ^= s
        x *= M2
        np.right_shift(x, np.uint64(32), out=s)
        x ^= s
    return out


def gram_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-unit sequences that start at each place; len(units) - n + 1 of them, none if too short.

    Built by doubling, so that every level passes through a nonlinear finaliser.
    """
    if n <= 0 or len(units) < n:
        return np.empty(0, np.uint64)
    level, size, out, done, rest = units.astype(np.uint64, copy=True), 1, None, 0, n
    while True:
        if rest & 1:
            have = len(units) - done - size + 1
            out = level[:have].copy() if out is None else pair_hash(out[: have], level[done : done + have])
            done += size
        rest >>= 1
        if not rest:
            return out[: len(units) - n + 1]
        level, size = pair_hash(level[:-size], level[size:]), 2 * size


def edit_texts(df: DataFrame, edit: Callable[[str], str | None], text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """df with every text replaced by edit(text), rows dropped where that is None, and the length column kept true.

    edit must be picklable; null texts are edited as ''. All columns pass through.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.toDF(*(f"c{i}" for i in range(len(df.columns)))).schema)
    at = df.columns.index(text)
    n_at = df.columns.index(length) if length in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices_of(b.column(at)):
                part = b.slice(lo, hi - lo)
                new = [edit(t or "") for t in part.column(at).to_pylist()]
                keep = pa.array([t is not None for t in new])
                cols = [c.filter(keep) for c in part.columns]
                kept = [t for t in new if t is not None]
                cols[at] = pa.array(kept, schema.field(at).type)
                if n_at is not None:
                    cols[n_at] = pa.array([len(t) for t in kept], schema.field(n_at).type)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    # Columns are known by their places here, as names may hold points.
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
