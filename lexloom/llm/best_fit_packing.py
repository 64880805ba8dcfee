"""Best-fit-decreasing packing of token sequences.

Best fit decreasing depends on the lengths alone, so it is run once over the histogram of lengths (at most `capacity`
rows, however large the corpus): a segment tree over remaining capacities finds the tightest open bins that still hold a
length, in logarithmic time, and a whole run of equal pieces is placed into a whole run of equal bins at once. The result
is a plan of intervals (length, ranks from..to) -> (bins from.., offset), whose size depends on `capacity`, not on the
corpus. Every piece then looks up its place by its length and its rank among equal lengths. Ranks come from counts by
(partition, length), so that no task sees all pieces of a length.

Defined results: null or empty text is the single id 0; repeated rows are packed each for itself; a null doc_id is kept.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexloom.llm import common

CAPACITY = 2048
#: Words whose ids a worker remembers.
CACHE = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class SegmentTree:
    """Over capacities 0..size-1: which of them have open bins; finds the least marked one at or above a bound."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << max(1, (size - 1).bit_length())
        self.any = bytearray(2 * self.leaves)

    def put(self, i: int, marked: bool) -> None:
        i += self.leaves
        self.any[i] = marked
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least(self, bound: int) -> int | None:
        """The least marked leaf >= bound."""
        i = bound + self.leaves
        if bound >= self.leaves:
            return None
        if self.any[i]:
            return bound
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.any[2 * i])
                return i - self.leaves
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Best fit decreasing over {length: count} as (length, first rank, first bin, offset), ranks of a length in order.

    A row holds for the ranks up to the next row of the same length; rank r goes to bin first bin + r - first rank.
    """
    tree = SegmentTree(capacity + 1)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs of bins (first, count)
    rows: list[tuple[int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            open_bins.setdefault(room, []).append((first, count))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.least(length)
            if room is None:
                # No open bin holds it: new bins, each of which then is the tightest for further ones of this length.
                each = capacity // length
                full, rest = divmod(left, each)
                for k in range(each):
                    n = full + (k < rest)
                    if n:
                        rows.append((length, rank, bins, k * length))
                        rank += n
                put(capacity - each * length, bins, full)
                if rest:
                    put(capacity - rest * length, bins + full, 1)
                bins += full + bool(rest)
                break
            first, count = open_bins[room].pop()
            if not open_bins[room]:
                tree.put(room, False)
            n = min(left, count)
            rows.append((length, rank, first, capacity - room))
            rank += n
            left -= n
            put(room - length, first, n)
            put(room, first + n, count - n)
    return rows


@lru_cache(4)
def _tokenizer(path: str, ordinary: bool = False):
    """The tokenizer of a file. ordinary: it takes the strings of its added tokens for any other text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = ordinary
    return t


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def merger(path: str):
    """A function from a word's UTF-8 bytes to its ids, by the merges in the file, or None where it can't be built.

    The end of a word is a byte of its own (0xFF, never in UTF-8) that joins the last byte before any other merge; then
    the merged strings' ranks decide, as in any merge list built pair by pair.
    """
    try:
        import tiktoken
    except ImportError:
        return None
    with open(path) as f:
        model = json.load(f)["model"]
    visible = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    visible |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in visible.values())}

    def raw(token: str) -> bytes:
        end = token.endswith("</w>")
        return bytes(visible[c] for c in token.removesuffix("</w>")) + b"\xff" * end

    ranks = {bytes([i]): i for i in range(256)}
    ids = np.full(512 + len(model["merges"]), -1, np.int64)
    for i in range(255):
        ranks[bytes([i, 255])] = 256 + i
    for token, i in model["vocab"].items():
        if (r := ranks.get(raw(token))) is not None:
            ids[r] = i
    for k, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if raw(a + b) in ranks:
            return None
        ranks[raw(a + b)] = 512 + k
        ids[512 + k] = model["vocab"][a + b]
    ranks[b"\xff\xff"] = 511
    table = ids.tolist()
    core = tiktoken.Encoding("merges", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda word: [table[r] for r in core(word + b"\xff")]


class WordIds:
    """Ids of whole texts by way of remembered words.

    The tokenizer drops white space before it merges, and none of its pieces reaches across it, so a text's ids are its
    words' ids put together. It finds its added tokens first, before it lower-cases, so a text is cut at them. It also lower-cases, so A-Z may be lowered before. Words of ASCII letters, or of letters that
    are lower-case already, are one piece; a mark after them is another. Those are merged directly, the rest by the tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.known, self.merge = _tokenizer(path), {}, merger(path)
        self.ordinary = _tokenizer(path, True)
        self.added = {x.content: pack("<I", i) for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.tails = {c.encode(): np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in ".,;:!?"}

    def learn(self, missing: list[bytes]) -> None:
        known, tails, merge, rest = self.known, self.tails, self.merge, []
        for w, s in zip(missing, b"\n".join(missing).decode().split("\n"), strict=True):
            if merge:
                tail = b""
                if w[-1:] in tails:
                    s, tail = s[:-1], w[-1:]
                # Lower-case letters of Latin, Greek and Cyrillic are one code point each in NFC.
                if s.isalpha() and s.islower() and (s.isascii() or max(s) < "\u0500"):
                    ids = merge(w[: len(w) - len(tail)])
                    known[w] = pack(f"<{len(ids)}I", *ids) + tails.get(tail, b"")
                    continue
            rest.append(w)
        for w, e in zip(rest, self.ordinary.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        # ordinary text and added tokens in turn
        parts = [self.cut.split(t) if any(x in t for x in self.added) else [t] for t in texts]
        words = [[p.encode("utf-8", "replace").lower().split() for p in ps[::2]] for ps in parts]
        found = iter(common.lookup(list(chain.from_iterable(chain.from_iterable(words))), self.known, self.learn))
        out = []
        for ps, ws in zip(parts, words, strict=True):
            own = [b"".join(islice(found, len(w))) + self.added.get(x, b"") for w, x in zip(ws, [*ps[1::2], ""], strict=True)]
            out.append(b"".join(own) + b"\0\0\0\0")
        return out


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(df: DataFrame, capacity: int = CAPACITY, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every text's ids cut into pieces of at most capacity, with the piece's rank among equal lengths of its partition."""
    schema = to_arrow_schema(StructType.fromDDL(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = word_ids(path or default_path())
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo, hi in common.slices_of(texts):
                rows: list[tuple] = []
                for i, packed in zip(ids[lo:hi], encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()]), strict=True):
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        own = packed[at : at + 4 * capacity]
                        n = len(own) // 4
                        rows.append((i, k, at // 4, n, zlib.crc32(own), part, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit_packing(df: DataFrame, capacity: int = CAPACITY, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    scratch = common.Scratch(df.sparkSession)
    cut = scratch.save(pieces(df, capacity, path, text, key), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rows = sorted(plan(histogram, capacity))
    lengths, ranks, firsts, offsets = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = cut.join(base.select("part", "length", F.coalesce("base", F.lit(0)).alias("base")), ["part", "length"])
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    begin = np.searchsorted(lengths, np.arange(capacity + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("base").to_numpy()
            at = np.zeros(len(n), np.int64)
            for length in np.unique(n):
                own = n == length
                a, z = begin[length], begin[length + 1]
                at[own] = a + np.searchsorted(ranks[a:z], rank[own], side="right") - 1
            cols = {"sequence_id": firsts[at] + rank - ranks[at], "offset": offsets[at]} if len(rows) else {"sequence_id": at, "offset": at}
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if f.name in cols else b.column(f.name) for f in schema], schema=schema)

    return placed.mapInArrow(run, SCHEMA)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(common.documents(spark, sf_dir))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLES: dict[str, str] = {}
