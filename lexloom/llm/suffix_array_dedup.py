"""Byte-level dedup of repeated 100-byte strings by suffix buckets and difference-cover ranks, one bucket at a time.

A suffix is a place from which at least DEPTH bytes of its document follow; suffixes are compared to that depth. Places of a
document are in the cover if they are in a difference cover modulo PERIOD. Then, for any two suffixes, there is a k < PERIOD
with both k-th bytes in the cover: they are equal if their heads of k bytes are, the cover suffixes at k are of one rank, and
their tails behind the ranked depth are. No more than PERIOD - 1 bytes of a suffix are ever sent beside a rank.

1. Documents are packed into blocks in the order of their keys (by a range shuffle only if the input isn't so ordered).
   What follows is done for one range of suffix buckets after the other (PASSES of them), so that no more than that is on disk.
2. Ranks of the cover sample to depth DEPTH - PERIOD + 1: keys of 56 bits that grow with the first two bytes, by a count of
   all of them, and fill equal ranges evenly; among equal first bytes the order is that of a keyed name. So buckets of key ranges
   are buckets of suffixes in alphabetical order that no frequent prefix makes large. A block sends each of its keys once
   to a bucket; the bucket sorts them and ranks those that occur again. What has no rank occurs once and is done.
3. Blocks send every ranked cover suffix with the bytes around it: the heads and tails of the up to PERIOD suffixes that meet
   it. One bucket at a time is sorted: by rank and tail, and by head; a suffix's order among those of one k is the pair of
   both, and of equal ones all but the first, by document and place, are removed. A rank is told apart by 64 bits more.
4. Each block applies the answers and yields its documents.

Keys and the further bits are four keyed sums over the bytes. They are strongly universal, and their secret is drawn anew for every
run: whatever the texts, two different strings have equal further bits with probability 2**-64 and, independently of that, one
key with about 2**-56 over the share that their first two bytes have of all. Heads and tails are compared byte by byte.

Copies of a cover suffix with equal bytes around are sent once a block and told apart once a bucket, so a passage that
millions of documents share costs one entry per block. Memory is bounded by one block or one bucket. Answers are written to
the shared folder, so that the shuffle files of a step are gone before the next one fills the disks.

Defined results: null or empty text has 0 bytes and the digest of no bytes; documents with an equal doc_id are ordered by
text; of identical rows one is the first; a null doc_id comes before all others; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexloom.llm import common
from lexloom.llm.blocks import RESULT, SENT, by_bucket, count_buckets, frames, keyed, later, ordered_blocks, pack_array, pack_bits, pack_sorted, results, rows_of, schema_of, spread, unframe, unpack_array, unpack_bits, unpack_sorted

PREFIXES = 1 << 16
#: A rank is told by this many bits of its key and 64 more. Bytes of text whose keys one bucket sorts; ranges of buckets.
KEY_BITS, BUCKET_BYTES, PASSES = 56, 16 << 20, 3
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


@dataclass(frozen=True)
class Spec:
    """The depth to which suffixes are compared, and the cover."""

    depth: int = 100
    period: int = 21
    cover: tuple[int, ...] = (0, 1, 4, 14, 16)
    block_bytes: int = 2 << 20
    #: The secret of a run's names.
    seed: int = 0

    def __post_init__(self) -> None:
        differences = {(a - b) % self.period for a in self.cover for b in self.cover}
        if len(differences) < self.period or self.ranked < 4:
            raise ValueError("the cover leaves out a difference, or the period exceeds the depth")

    @property
    def ranked(self) -> int:
        """The depth of ranks: what any suffix has behind the last place at which it may meet the cover."""
        return self.depth - self.period + 1

    @property
    def side(self) -> int:
        return self.period - 1


BYTES = Spec()


class Scale:
    """Keys that grow with the first two bytes: every prefix has a range of keys as wide as its share of all."""

    def __init__(self, counts: np.ndarray) -> None:
        ends = np.cumsum(np.maximum(counts, 1).astype(object))
        bounds = [0, *((int(e) << 64) // int(ends[-1]) for e in ends)]
        self.base = np.array(bounds[:-1], np.uint64)
        self.width = np.array([b - a - 1 for a, b in zip(bounds, bounds[1:], strict=False)], np.uint64)

    def keys(self, prefix: np.ndarray, name: np.ndarray) -> np.ndarray:
        width = self.width[prefix]
        a, b, c, d = name >> HALF, name & LOW, width >> HALF, width & LOW
        return (self.base[prefix] + a * c + ((a * d) >> HALF) + ((b * c) >> HALF)) >> np.uint64(64 - KEY_BITS)


@dataclass(frozen=True)
class Part:
    """A range of buckets, and of their keys (both inclusive)."""

    buckets: int
    low: int
    high: int

    @property
    def first(self) -> np.uint64:
        return np.uint64(((self.low << KEY_BITS) + self.buckets - 1) // self.buckets)

    @property
    def last(self) -> np.uint64:
        return np.uint64((((self.high + 1) << KEY_BITS) + self.buckets - 1) // self.buckets - 1)


class Block:
    """The bytes of a block's documents and the cover suffixes among them."""

    def __init__(self, spec: Spec, data: bytes) -> None:
        self.spec = spec
        self.table = pa.ipc.open_stream(data).read_all()
        self.raw = [t.encode("utf-8", "replace") if t else b"" for t in self.table["_text"].to_pylist()]
        sizes = np.array([len(r) for r in self.raw], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.n = int(sizes.sum())
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def places(self) -> np.ndarray:
        """The cover suffixes that meet a suffix. The cover begins anew with every document."""
        spec = self.spec
        inside = np.zeros(spec.period, bool)
        inside[list(spec.cover)] = True
        sizes = self.ends - self.begins
        pattern = np.resize(inside, int(sizes.max())) if self.n else np.zeros(0, bool)
        out = np.flatnonzero(np.concatenate([np.zeros(0, bool), *(pattern[:n] if n >= spec.depth else np.zeros(n, bool) for n in sizes.tolist())]))
        return out[out + spec.ranked <= self.ends[self.document(out)]]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def prefixes(self, places: np.ndarray) -> np.ndarray:
        return (self.bytes[places].astype(np.int64) << 8) | self.bytes[places + 1]

    def ranged(self, scale: Scale, part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, keys and further bits of the cover suffixes in one range of keys."""
        places = self.places()
        prefix = self.prefixes(places)
        near = (scale.base[prefix] >> np.uint64(64 - KEY_BITS) <= part.last) & ((scale.base[prefix] + scale.width[prefix]) >> np.uint64(64 - KEY_BITS) >= part.first)
        places, prefix = places[near], prefix[near]
        names, further = self.names(places)
        keys = scale.keys(prefix, names)
        held = (keys >= part.first) & (keys <= part.last)
        return places[held], keys[held], further[held]

    def names(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the ranked depth from each place two names of 64 bits."""
        spec = self.spec
        starts = [min(i, spec.ranked - 4) for i in range(0, spec.ranked, 4)]
        keys = common.multilinear_keys(spec.seed, len(starts), 4)
        words = np.ndarray((max(0, self.n - 3),), "<u4", self.bytes.tobytes(), 0, (1,)).copy() if self.n > 3 else np.zeros(0, "<u4")
        out = np.empty((4, len(places)), np.uint64)
        for lo in range(0, len(places), common.CHUNK):
            at = places[lo : lo + common.CHUNK]
            out[:, lo : lo + common.CHUNK] = common.multilinear((words[at + i] for i in starts), keys, len(at))
        return (out[0] << HALF) | out[1], (out[2] << HALF) | out[3]


def _counts(spec: Spec) -> Callable:
    schema = schema_of(SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PREFIXES, np.int64)
        for b in batches:
            for data in b.column(1):
                own = Block(spec, data.as_py())
                total += np.bincount(own.prefixes(own.places()), minlength=PREFIXES)
        yield from rows_of(schema, [(0, 0, 0, pack_array(total))]).to_batches()

    return run


def _add(key: tuple, parts: pa.Table) -> pa.Table:
    total = sum((unpack_array(d.as_py(), "<i8") for d in parts["data"]), np.zeros(PREFIXES, np.int64))
    return rows_of(schema_of(SENT), [(0, 0, 0, pack_array(total))])


def scale_of(units: DataFrame, spec: Spec) -> Scale:
    """The scale of all cover suffixes: 65,536 counts, whatever the corpus."""
    rows = units.mapInArrow(_counts(spec), SENT).groupBy("k").applyInArrow(_add, SENT).collect()
    return Scale(unpack_array(bytes(rows[0]["data"]), "<i8") if rows else np.zeros(PREFIXES, np.int64))


def _send_keys(spec: Spec, scale, part: Part) -> Callable:
    schema = schema_of(SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = Block(spec, data.as_py())
                values, counts = np.unique(own.ranged(scale.value, part)[1], return_counts=True)
                rows = [(k, block, 0, frames(pack_sorted(values[x:y]), pack_bits(counts[x:y] > 1))) for k, x, y in by_bucket(values, part.buckets, KEY_BITS)]
                yield from rows_of(schema, rows).to_batches()

    return run


def rank(key: tuple, sent: pa.Table) -> pa.Table:
    """For one bucket each block's flags, which of its keys occur again, and the ranks of these."""
    data, blocks = [unframe(d.as_py()) for d in sent["data"]], sent["block"].to_pylist()
    values = [unpack_sorted(d[0]) for d in data]
    twice = np.concatenate([unpack_bits(d[1]) for d in data])
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    new = np.ones(len(every), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    again = (np.diff(first, append=len(every)) > 1) | np.logical_or.reduceat(twice[order], first)
    ranks = np.cumsum(again) - 1
    of = np.empty(len(every), np.int64)
    of[order] = np.where(again, ranks, -1)[np.cumsum(new) - 1]
    cut = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    rows = []
    for j, block in enumerate(blocks):
        mine = of[cut[j] : cut[j + 1]]
        rows.append((key[0].as_py(), block, 0, frames(pack_bits(mine >= 0), pack_sorted(mine[mine >= 0].astype(np.uint64)))))
    return rows_of(schema_of(SENT), rows)


def _answers(right: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(bucket, data) of one kind in the order of buckets."""
    return sorted((k, d) for k, c, d in zip(right["k"].to_pylist(), right["kind"].to_pylist(), right["data"].to_pylist(), strict=True) if c == kind)


def _around(data: np.ndarray, places: np.ndarray, before: int, size: int) -> np.ndarray:
    """The size bytes that begin so many before each place; zeros where the block ends."""
    padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(size, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, size)[places]


def _send_suffixes(spec: Spec, scale, part: Part) -> Callable:
    schema, side = schema_of(SENT), spec.side

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        told = [(k, *unframe(d)) for k, d in _answers(right, 0)]
        for data in left["data"]:
            own, block = Block(spec, data.as_py()), key[0].as_py()
            if not told:
                continue
            places, keys, seconds = own.ranged(scale.value, part)
            _, inverse = np.unique(keys, return_inverse=True)
            flags = np.concatenate([unpack_bits(f) for _, f, _ in told])
            where = np.cumsum(flags) - 1
            held = flags[inverse]
            places, seconds, nth = places[held], seconds[held], where[inverse[held]]
            documents = own.document(places)
            before = np.minimum(places - own.begins[documents], side)
            behind = np.minimum(own.ends[documents] - places - spec.ranked, side)
            # Of places with equal bytes all around the first stands for all.
            whole = np.flatnonzero((before == side) & (behind == side))
            heads, tails = _around(own.bytes, places[whole], side, side), _around(own.bytes, places[whole] + spec.ranked, 0, side)
            copies = whole[_copies(_classes(nth[whole].astype(np.uint64), seconds[whole]), heads, tails)]
            removed = spread(places[copies] - side, places[copies] + 1, own.n)
            sent = np.ones(len(places), bool)
            sent[copies] = False
            order = np.flatnonzero(sent)
            order = order[np.argsort(nth[order], kind="stable")]
            places, seconds, nth, before, behind = places[order], seconds[order], nth[order], before[order], behind[order]
            heads, tails = _around(own.bytes, places, side, side), _around(own.bytes, places + spec.ranked, 0, side)
            at = 0
            for k, _, r in told:
                ranks = unpack_sorted(r)
                x, y = np.searchsorted(nth, [at, at + len(ranks)])
                if y > x:
                    mine = ranks[nth[x:y] - at]
                    parts = (pack_array(mine.astype("<u4")), pack_array(seconds[x:y]), pack_array(heads[x:y]), pack_array(tails[x:y]), pack_array(before[x:y].astype(np.uint8)), pack_array(behind[x:y].astype(np.uint8)))
                    rows.append((k, block, 2, frames(*parts)))
                at += len(ranks)
            own_group = -1 - (block * 0x9E3779B1 >> 7) % (1 << 30)  # spreads the blocks' states
            rows += [(own_group, block, 3, pack_bits(removed)), (own_group, block, 4, pack_array(places.astype("<u4")))]
        return rows_of(schema, rows)

    return run


def _words(columns: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as 64-bit numbers that sort like them, the most significant first."""
    width = -(-columns.shape[1] // 8) * 8
    padded = np.zeros((len(columns), width), np.uint8)
    padded[:, : columns.shape[1]] = columns
    numbers = padded.view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(numbers[:, i]) for i in range(numbers.shape[1])]


def _sorted_classes(columns: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by group and bytes, and how many bytes each row shares with the one before it, -1 in another group."""
    words = _words(columns)
    order = np.lexsort([*words[::-1], group])
    differ = columns[order][1:] != columns[order][:-1]
    shared = np.where(differ.any(1), differ.argmax(1), columns.shape[1])
    shared[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], shared])


def _classes(ranks: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Numbers of the different pairs."""
    order = np.lexsort((seconds, ranks))
    a, b = ranks[order], seconds[order]
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(order)])
    return out


def _copies(group: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """True where an earlier row of the group has equal bytes: by hash, and compared."""
    mixed = common.mix(group.astype(np.uint64) * common.M1)
    for w in (*_words(heads), *_words(tails)):
        mixed = common.pair_hash(mixed, w)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    a, b = order[1:][same], order[:-1][same]
    equal = (group[a] == group[b]) & (heads[a] == heads[b]).all(1) & (tails[a] == tails[b]).all(1)
    out = np.zeros(len(group), bool)
    out[a[equal]] = True
    return out


def sort_suffixes(spec: Spec) -> Callable:
    """For one bucket: of every suffix that meets one of its cover suffixes whether an equal one stands before it."""

    side = spec.side

    def run(key: tuple, sent: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # a block's own state, on its way to the last step
            return sent.select(["k", "block", "kind", "data"])
        by_block = np.argsort(sent["block"].to_numpy(), kind="stable").tolist()
        data, blocks = [unframe(d.as_py()) for d in sent["data"]], sent["block"].to_pylist()
        of = lambda i, dtype, width=1: [unpack_array(data[j][i], dtype, width) for j in by_block]
        sizes = [len(x) for x in of(0, "<u4")]
        ranks, seconds = np.concatenate(of(0, "<u4")).astype(np.uint64), np.concatenate(of(1, "<u8"))
        heads, tails = (np.concatenate(of(i, "u1", side)).reshape(-1, side) for i in (2, 3))
        before, behind = (np.concatenate(of(i, "u1")) for i in (4, 5))
        group = _classes(ranks, seconds)
        out = np.zeros((len(group), spec.period), bool)
        whole = np.flatnonzero((before == side) & (behind == side))
        copies = whole[_copies(group[whole], heads[whole], tails[whole])]
        out[copies] = True
        # What is left of groups of several: their suffixes in order.
        rest = np.ones(len(group), bool)
        rest[copies] = False
        left = np.flatnonzero(rest)
        _, inverse, counts = np.unique(group[left], return_inverse=True, return_counts=True)
        left = left[counts[inverse] > 1]
        if len(left):
            group, before, behind = group[left], before[left], behind[left]
            by_tail, tail_shared = _sorted_classes(tails[left], group)
            by_head, head_shared = _sorted_classes(np.ascontiguousarray(heads[left][:, ::-1]), group)
            tail_class, head_class = np.empty(len(left), np.uint64), np.empty(len(left), np.uint64)
            for k in range(spec.period):
                fits = np.flatnonzero((before >= k) & (behind >= side - k))
                tail_class[by_tail] = np.cumsum(tail_shared < side - k)
                head_class[by_head] = np.cumsum(head_shared < k)
                out[left[fits], k] = later((tail_class[fits] << HALF) | head_class[fits])
        cut = np.concatenate([[0], np.cumsum(sizes)])
        rows = [(key[0].as_py(), blocks[i], 2, pack_bits(np.ascontiguousarray(out[cut[j] : cut[j + 1]].T).ravel())) for j, i in enumerate(by_block)]
        return rows_of(schema_of(SENT), rows)

    return run


def _finish(spec: Spec, schema: pa.Schema, text: bool) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        done = []
        for data in left["data"]:
            own = Block(spec, data.as_py())
            removed = np.zeros(own.n, bool)
            for p in range(PASSES):
                mine = right.filter(pc.equal(right["pass"], p))
                for _, d in _answers(mine, 3):
                    removed |= unpack_bits(d)
                places = np.concatenate([np.zeros(0, np.int64), *(unpack_array(d, "<u4").astype(np.int64) for _, d in _answers(mine, 4))])
                at = 0
                for _, d in _answers(mine, 2):
                    flags = unpack_bits(d).reshape(spec.period, -1)
                    here = places[at : at + flags.shape[1]]
                    for k in range(spec.period):
                        removed[here[flags[k]] - k] = True
                    at += len(here)
            starts = np.flatnonzero(removed)
            covered = spread(starts, starts + spec.depth, own.n) if own.n else removed
            cols = results(own.raw, None, own.begins, own.ends, covered, text)
            done.append(pa.table([own.table["_carried"], *(pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[-5:], strict=True))], schema=schema))
        return pa.concat_tables(done) if done else schema.empty_table()

    return run


def suffix_array_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", carry: dict | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: its key, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    With carry (names and columns), the struct _carried holds these instead of the key, whatever their names.
    """
    spark, spec = df.sparkSession, replace(BYTES, seed=common.new_seed())
    scratch = common.Scratch(spark)
    rows = keyed(df, key, text, carry or {"doc_id": F.col(key).cast("long")})
    blocks = ordered_blocks(rows, spec.block_bytes, scratch)
    buckets = count_buckets(blocks, BUCKET_BYTES)
    units = blocks.select("block", "data")
    scale = spark.sparkContext.broadcast(scale_of(units, spec))
    answers = []
    for p in range(PASSES):
        part = Part(buckets, p * buckets // PASSES, (p + 1) * buckets // PASSES - 1)
        ranks = scratch.save(units.mapInArrow(_send_keys(spec, scale, part), SENT).groupBy("k").applyInArrow(rank, SENT), f"ranks-{p}")
        common.release(spark)
        sent = units.groupBy("block").cogroup(ranks.groupBy("block")).applyInArrow(_send_suffixes(spec, scale, part), SENT)
        answers.append(scratch.save(sent.groupBy("k").applyInArrow(sort_suffixes(spec), SENT).withColumn("pass", F.lit(p)), f"suffixes-{p}"))
        del ranks, sent
        scratch.drop(f"ranks-{p}")
        common.release(spark)
    scale.destroy()
    told = reduce(DataFrame.unionByName, answers)
    result = StructType([rows.schema["_carried"], *RESULT])
    out = units.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_finish(spec, to_arrow_schema(result), with_text), result)
    out = out.withColumnRenamed("n_units", "n_bytes")
    out = out if carry else out.select("_carried.doc_id", *out.columns[1:])
    return out if with_text else out.drop("kept_text")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(common.documents(spark, sf_dir))


QUERIES = {"op3_suffix_array_dedup": op3_suffix_array_dedup}
ORACLES: dict[str, str] = {}
