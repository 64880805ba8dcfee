"""Exact removal of repeated windows of words over blocks of documents: the machinery of substring dedup.

A window is L consecutive words of one document. Every window but the first of equal ones, by document and start, is
removed, and with it the words that it covers. No pair of occurrences is ever formed:

1. Documents are packed into blocks in the order of their keys (by a range shuffle only if the input isn't so ordered).
2. Each block hashes short windows at the places that a difference cover modulo a period selects. Two equal windows of L
   words always contain a pair of equal short ones at covered places, whatever their alignment. Blocks send sorted,
   delta-coded sets of these anchors to hash-range buckets, which answer with one bit each: seen in another block or not.
3. Windows with no repeated anchor cannot repeat. The others are extended: named over all L words and sent, again as sorted
   sets by hash range, one range sorted at a time, and answered by: seen in an earlier block or not.
4. Each block applies the answers and yields its documents.

A hash goes to a bucket once per block however often it occurs, so a passage that millions of documents share costs one
entry per block. Memory is bounded by one block or one bucket. The answers of steps 2 and 3 are written to the shared
folder, so that the shuffle files of a step are gone before the next one fills the disks. Windows are named by 96 bits, three
keyed sums over the 128-bit keyed hashes of their words: whatever the texts, two different windows have one name with
probability 2**-96, as the secret is drawn anew for every run. Anchors have 48 bits, where an accidental equality only costs work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexloom.llm import common
from lexloom.llm.blocks import RESULT, SENT, by_bucket, count_buckets, frames, keyed, later, ordered_blocks, pack_array, pack_bits, pack_sorted, results, rows_of, schema_of, spread, unframe, unpack_array, unpack_bits, unpack_sorted

ANCHOR_BITS = 48


@dataclass(frozen=True)
class Spec:
    """How long a window is, and the cover."""

    window: int
    period: int
    cover: tuple[int, ...]
    block_bytes: int
    #: The secret of a run's hashes.
    seed: int = 0

    def __post_init__(self) -> None:
        differences = {(a - b) % self.period for a in self.cover for b in self.cover}
        if len(differences) < self.period or self.anchor < 1:
            raise ValueError("the cover leaves out a difference, or the period exceeds the window")

    @property
    def anchor(self) -> int:
        """Units of an anchor: the last window of that length that starts in the first period of places."""
        return self.window - self.period + 1


class Block:
    """The words of a block's documents and what is derived from them."""

    def __init__(self, spec: Spec, data: bytes) -> None:
        self.spec = spec
        self.table = pa.ipc.open_stream(data).read_all()
        self.raw = [t.encode("utf-8", "replace") if t else b"" for t in self.table["_text"].to_pylist()]
        self.parts = [r.split() for r in self.raw]
        words = [w for ws in self.parts for w in ws]
        #: 128 bits of every word, in four parts.
        self.words = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words, repeat(spec.seed))), "<u4").reshape(-1, 4)
        units = np.ascontiguousarray(self.words[:, :2]).view("<u8").ravel()
        sizes = [len(p) for p in self.parts]
        self.n = len(units)
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.begins = self.ends - np.asarray(sizes, np.int64)
        self._levels = {1: units}

    def level(self, size: int) -> np.ndarray:
        """Hashes of the size words from every place, size a power of two; places too near the end hash what wraps around."""
        if size not in self._levels:
            half = self.level(size // 2)
            self._levels[size] = common.pair_hash(half, np.concatenate([half[size // 2 :], half[: size // 2]])[: len(half)])
        return self._levels[size]

    def grams(self, places: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each place."""
        out, done, size = None, 0, 1 << n.bit_length()
        while size:
            if n & size:
                h = self.level(size)[places + done]
                out = h.copy() if out is None else common.pair_hash(out, h)
                done += size
            size >>= 1
        return out

    def names(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows from each place as 64 bits and 32 more."""
        keys = common.multilinear_keys(self.spec.seed, 4 * self.spec.window, 3)
        out = np.empty((3, len(places)), np.uint64)
        for lo in range(0, len(places), common.CHUNK):
            at = places[lo : lo + common.CHUNK]
            out[:, lo : lo + common.CHUNK] = common.multilinear((column for i in range(self.spec.window) for column in self.words[at + i].T), keys, len(at))
        return (out[0] << np.uint64(32)) | out[1], out[2].astype(np.uint32)

    def fits(self, n: int) -> np.ndarray:
        """True at places from which n words of the same document follow."""
        ok = np.zeros(self.n, bool)
        for a, b in zip(self.begins.tolist(), self.ends.tolist(), strict=True):
            if b - a >= n:
                ok[a : b - n + 1] = True
        return ok

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and cut hashes of the short windows at covered places."""
        at = np.zeros(self.spec.period, bool)
        at[list(self.spec.cover)] = True
        whole = np.resize(at, self.n) if self.n else np.zeros(0, bool)
        places = np.flatnonzero(whole & self.fits(self.spec.anchor))
        return places, self.grams(places, self.spec.anchor) >> np.uint64(64 - ANCHOR_BITS)


def _unique_names(names: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names in order, and for every name its place among them."""
    first, second = names
    order = np.lexsort((second, first)) if len(first) else np.zeros(0, np.int64)
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return a[new], b[new], inverse


def _send_anchors(spec: Spec, buckets: int) -> Callable:
    schema = schema_of(SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = Block(spec, data.as_py())
                values = np.unique(own.anchors()[1])
                rows = [(k, block, 0, pack_sorted(values[x:y])) for k, x, y in by_bucket(values, buckets, ANCHOR_BITS)]
                yield from rows_of(schema, rows).to_batches()

    return run


def answer(key: tuple, sent: pa.Table) -> pa.Table:
    """For one bucket and kind: each block's flags. Kind 0: in another block; kind 1: the same, and what is in one; kind 2 (names of two
    parts): in an earlier one."""
    if key[0].as_py() < 0:  # a block's own state, on its way to the last step
        return sent.select(["k", "block", "kind", "data"])
    order = np.argsort(sent["block"].to_numpy(), kind="stable")
    data, blocks, kind = [d.as_py() for d in sent["data"]], sent["block"].to_pylist(), key[1].as_py()
    second = None
    if kind == 2:
        pairs = [unframe(data[int(i)]) for i in order]
        values = [unpack_sorted(p[0]) for p in pairs]
        second = np.concatenate([unpack_array(p[1], "<u4") for p in pairs])
    else:
        values = [unpack_sorted(data[int(i)]) for i in order]
    every = np.concatenate(values)
    again = later(every, second)
    flags = again
    if kind in (0, 1):
        twice = np.unique(every[again])
        at = np.minimum(np.searchsorted(twice, every), max(0, len(twice) - 1))
        flags = twice[at] == every if len(twice) else again
    cut = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    told = [(pack_bits(flags[x:y]), every[x:y][flags[x:y]]) for x, y in zip(cut, cut[1:], strict=False)]
    rows = [(key[0].as_py(), blocks[int(i)], kind, frames(bits, pack_sorted(found)) if kind == 1 else bits) for i, (bits, found) in zip(order, told, strict=True)]
    return rows_of(schema_of(SENT), rows)


def flags_of(right: pa.Table, kind: int) -> np.ndarray:
    """A block's answers of one kind, put together in the order of its sorted hashes."""
    mine = sorted((k, d) for k, c, d in zip(right["k"].to_pylist(), right["kind"].to_pylist(), right["data"].to_pylist(), strict=True) if c == kind)
    return np.concatenate([unpack_bits(d) for _, d in mine]) if mine else np.zeros(0, bool)


def _send_windows(spec: Spec, buckets: int) -> Callable:
    schema = schema_of(SENT)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for data in left["data"]:
            own, block = Block(spec, data.as_py()), key[0].as_py()
            if not own.n:
                continue
            places, hashes = own.anchors()
            unique, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            repeated = places[((counts > 1) | flags_of(right, 0))[inverse]] if len(unique) else places
            sent = spread(np.maximum(repeated - (spec.period - 1), 0), repeated + 1, own.n) & own.fits(spec.window)
            first, second, _ = _unique_names(own.names(np.flatnonzero(sent)))
            rows += [(k, block, 2, frames(pack_sorted(first[x:y]), pack_array(second[x:y]))) for k, x, y in by_bucket(first, buckets, 64)]
            own_group = -1 - (block * 0x9E3779B1 >> 7) % (1 << 30)  # spreads the blocks' states
            rows.append((own_group, block, 4, pack_bits(sent)))
        return rows_of(schema, rows)

    return run


def _finish(spec: Spec, schema: pa.Schema, text: bool) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        done = []
        for data in left["data"]:
            own = Block(spec, data.as_py())
            removed, sent = np.zeros(own.n, bool), np.flatnonzero(flags_of(right, 4))
            if len(sent):
                first, second = own.names(sent)
                removed[sent] = flags_of(right, 2)[_unique_names((first, second))[2]] | later(first, second)
            places = np.flatnonzero(removed)
            covered = spread(places, places + spec.window, own.n) if own.n else np.zeros(0, bool)
            cols = results(own.raw, own.parts, own.begins, own.ends, covered, text)
            done.append(pa.table([own.table["_carried"], *(pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[-5:], strict=True))], schema=schema))
        return pa.concat_tables(done) if done else schema.empty_table()

    return run


def remove_repeats(df: DataFrame, spec: Spec, key: str, text: str, carry: dict[str, Column], with_text: bool = False) -> DataFrame:
    """Of every row the carried columns, as the struct _carried, with n_units, n_removed, n_spans, kept_sha256 and, if asked for, kept_text."""
    scratch, spec = common.Scratch(df.sparkSession), replace(spec, seed=common.new_seed())
    rows = keyed(df, key, text, carry)
    blocks = ordered_blocks(rows, spec.block_bytes, scratch)
    buckets = count_buckets(blocks)
    units = blocks.select("block", "data")
    told = scratch.save(units.mapInArrow(_send_anchors(spec, buckets), SENT).groupBy("k", "kind").applyInArrow(answer, SENT), "anchors")
    common.release(df.sparkSession)
    sent = units.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send_windows(spec, buckets), SENT)
    answers = scratch.save(sent.groupBy("k", "kind").applyInArrow(answer, SENT), "windows")
    scratch.drop("anchors")
    del told, sent
    common.release(df.sparkSession)
    result = StructType([rows.schema["_carried"], *RESULT])
    return units.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(spec, to_arrow_schema(result), with_text), result)
