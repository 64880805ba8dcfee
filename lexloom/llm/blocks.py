"""Blocks of documents in the order of their keys, and the sets and flags that blocks and buckets exchange.

What the exact dedup operators share: how documents are packed, coded and given back. What is compared, and how, is theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from lexloom.llm import common

#: Bytes of text whose hashes one bucket sorts at a time, and least number of buckets.
BUCKET_BYTES, MIN_BUCKETS = 48 << 20, 24
#: Blocks are written once and shuffled twice.
ZSTD_LEVEL = 7
NO_KEY = -(1 << 63)
#: Characters of a text by which rows of one key are dealt to range partitions.
TEXT_PREFIX = 32

BLOCKS = "block long, upto long, size long, data binary"
SENT = "k int, block long, kind int, data binary"
RESULT = [StructField("n_units", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType()), StructField("kept_text", StringType())]


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted uint64 array as differences, their bytes by place, compressed."""
    d = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def unpack_bits(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8), count=n).astype(bool)


def edges(buckets: int, bits: int) -> np.ndarray:
    """Where the hash ranges of the buckets begin, without the first."""
    return np.array([((i << bits) + buckets - 1) // buckets for i in range(1, buckets)], np.uint64)


def by_bucket(values: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array's parts that aren't empty."""
    at = np.concatenate([[0], np.searchsorted(values, edges(buckets, bits)), [len(values)]])
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]


def pack_array(values: np.ndarray) -> bytes:
    """An array, its bytes by place, compressed."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    raw = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(len(values), width)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack_array(data: bytes, dtype: str, width: int = 1) -> np.ndarray:
    """What pack_array() packed: elements, or rows of width of them."""
    size = np.dtype(dtype).itemsize * width
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype)
    return out.ravel() if width == 1 else out


def frames(*parts: bytes) -> bytes:
    return b"".join(x for p in parts for x in (len(p).to_bytes(8, "little"), p))


def unframe(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def later(values: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """True where an equal value (of one or two parts) stands before, in the order given."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    if second is not None and same.any():
        other = second[order]
        if (other[1:][same] != other[:-1][same]).any():  # equal first parts of different values: sorted by both
            order = np.lexsort((second, values))
            ordered, other = values[order], second[order]
            same = (ordered[1:] == ordered[:-1]) & (other[1:] == other[:-1])
    out = np.zeros(len(values), bool)
    out[order[1:]] = same
    return out


def spread(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """True at the places of the ranges begin..end (exclusive)."""
    d = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def schema_of(ddl: str) -> pa.Schema:
    """Also on executors, where no session parses DDL."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def pack_blocks(df: DataFrame, block_bytes: int, numbered: bool = False) -> DataFrame:
    """Rows (_key, _text, ...) as blocks, in the order of their partitions. No number of rows of one key makes a block larger.

    A block is named by its least key, or numbered uniquely; numbers hold once the blocks are written.
    """
    schema = schema_of(BLOCKS)

    def close(parts: list[pa.RecordBatch], nth: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        t = pa.Table.from_batches(parts).sort_by([("_key", "ascending"), ("_text", "ascending")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))) as w:
            w.write_table(t.combine_chunks())
        keys = t["_key"].to_numpy()
        name = (TaskContext.get().partitionId() << 32) + nth if numbered else int(keys[0])
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(keys[-1])]), pa.array([_size(parts)]), pa.array([sink.getvalue().to_pybytes()])], schema=schema)

    def _size(parts: list[pa.RecordBatch]) -> int:
        import pyarrow.compute as pc

        return sum(pc.sum(pc.binary_length(p.column(1))).as_py() or 0 for p in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: list[pa.RecordBatch] = []
        size, nth = 0, 0
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = 0
            for i in range(b.num_rows):
                if size >= block_bytes:
                    if i > begin:
                        held.append(b.slice(begin, i - begin))
                    yield close(held, nth)
                    held, size, begin, nth = [], 0, i, nth + 1
                size += int(sizes[i])
            if b.num_rows > begin:
                held.append(b.slice(begin))
        if held:
            yield close(held, nth)

    return df.mapInArrow(run, BLOCKS)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition of (block, upto): its least block, its greatest upto, and whether its blocks' ranges are apart."""
    low = high = None
    apart = True
    for b in batches:
        for block, upto in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            apart = apart and (high is None or block > high)
            low = block if low is None else low
            high = upto if high is None else max(high, upto)
    if low is not None:
        yield pa.RecordBatch.from_pydict({"low": [low], "high": [high], "apart": [apart]})


def disjoint(blocks: DataFrame) -> bool:
    """Whether blocks that are named by their least keys have disjoint ranges of keys. One row a partition comes to the driver."""
    ranges = blocks.select("block", "upto").repartitionByRange(64, "block").sortWithinPartitions("block", "upto")
    rows = sorted(tuple(r) for r in ranges.mapInArrow(_ranges, "low long, high long, apart boolean").collect())
    return all(r[2] for r in rows) and all(b[0] > a[1] for a, b in zip(rows, rows[1:], strict=False))


def ordered_blocks(df: DataFrame, block_bytes: int, scratch: common.Scratch) -> DataFrame:
    """Blocks in the order of keys, rows of one key by text. The input's own order serves if it gives blocks with disjoint
    ranges of keys, which one pass finds out; else rows are dealt by ranges of key and text, so that no key fills a task."""
    blocks = scratch.save(pack_blocks(df, block_bytes), "as-read")
    if disjoint(blocks):
        return blocks
    total = blocks.agg(F.sum("size")).first()[0] or 0
    scratch.drop("as-read")
    text = F.substring(F.coalesce("_text", F.lit("")), 1, TEXT_PREFIX)
    ranged = df.repartitionByRange(max(1, -(-total // (16 << 20))), "_key", text).sortWithinPartitions("_key", "_text")
    return scratch.save(pack_blocks(ranged, block_bytes, numbered=True), "by-key")


def count_buckets(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(MIN_BUCKETS, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // bucket_bytes))


def keyed(df: DataFrame, key: str, text: str, carry: dict[str, Column]) -> DataFrame:
    """_key, _text and the carried columns, as one struct, so that their names never meet the operator's own."""
    carried = F.struct(*(c.alias(n) for n, c in carry.items())).alias("_carried")
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_key"), F.col(text).cast("string").alias("_text"), carried)


def kept_text(raw: bytes, words: bool, units: list[bytes], covered: np.ndarray) -> tuple[bytes, str]:
    """What is hashed, and the text without the removed units; between kept words the blanks before them stay."""
    if not words:
        data = np.frombuffer(raw, np.uint8)[~covered].tobytes()
        return data, data.decode("utf-8", "replace")
    digest = b" ".join(w for w, c in zip(units, covered.tolist(), strict=True) if not c)
    if not covered.any():
        return digest, raw.decode()
    out, at = [], 0
    for w, c in zip(units, covered.tolist(), strict=True):
        begin = raw.index(w, at)
        if not c:
            out += [raw[at:begin] if out else b"", w]
        at = begin + len(w)
    return digest, b"".join(out).decode()


def results(raw: list[bytes], parts: list[list[bytes]] | None, begins: np.ndarray, ends: np.ndarray, covered: np.ndarray, text: bool) -> list[list]:
    """The columns of RESULT of a block's documents. parts: their units, if these are words."""
    cols: list[list] = [[], [], [], [], []]
    for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        c = covered[a:b]
        digest, kept = kept_text(raw[i], parts is not None, parts[i] if parts is not None else [], c)
        runs = int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if len(c) else 0
        for col, x in zip(cols, (b - a, int(c.sum()), runs, hashlib.sha256(digest).hexdigest(), kept if text else None), strict=True):
            col.append(x)
    return cols
