"""Exact n-gram Jaccard join by universe partition, as classes, links' components and set sizes.

Sets of word n-grams with Jaccard similarity >= t differ in at most H = (1-t)/(1+t) * (sum of sizes) elements. The universe
of n-gram hashes is partitioned into segments, more of them for larger sets: sizes fall into bands, each pair of
neighbouring bands is a group with its own H and number of segments. Among M segments of two such sets at least M - H are
identical. A cost model allocates, for each group, one of two signatures:

* identical segments: each set indexes only H + 1 of its segments, those that hold the rarest n-grams (a prefix in one global
  order), rarity estimated by a fixed-size count sketch over all documents; M is a multiple of H + 1;
* one-deletion neighbourhoods: (H + 1) / 2 segments, of which one differs by at most one element; each set indexes every
  segment and every segment less one element. At 90 percent the cost model never chooses them, at 80 only for the smallest sets.

Signatures that occur once anywhere are dropped through exchanges of sorted sets by hash range (see repeats.py). For the
others, equal sets count as one class. In buckets of at most SMALL members every member is verified exactly against one
centre, the same for nearly all buckets of a group of near copies; members that it doesn't connect are compared in pairs. A
brief form of the sets, whose differences bound theirs from below, rules most pairs out before any set travels. Larger
buckets that have members in common form a family, whose members are compared by their differences from the family's
consensus (see _family_links): linear in the family but for pairs that share rare differences. Nothing emits all pairs of a
bucket, and no link between different components is lost.

Defined results: null or empty text and texts without words have no n-grams, no links, and their own component; texts with
fewer than n words have one, the whole sequence. Rows with equal doc_id each count as documents; the component is the
smallest doc_id of a connected group, null ids ignored (null if there is no other). Classes of equal sets are told apart by
64-bit digests. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import common
from lexloom.llm.blocks import NO_KEY, SENT, by_bucket, count_buckets, frames, pack_array, pack_blocks, pack_sorted, rows_of, schema_of, unframe, unpack_array, unpack_bits, unpack_sorted
from lexloom.llm.repeats import answer

SKETCH_BITS, SKETCH_PARTS = 22, 16
#: Up to this many members, a bucket's pairs are few enough to compare their brief forms.
SMALL = 32
#: Parts in which a family's rows meet what is known of the family.
SALTS = 64
KEY_BITS = 48
#: Bytes of text in a block, and of text whose signatures one bucket sorts.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Rows of documents (keys null), and of sets that share a signature (doc_id null).
MEMBERS = "doc_id long, size long, class long, keys array<long>, brief binary, elements binary"
#: Bytes of a set's brief form.
BRIEF = 256


class Join:
    """The parameters of one join and what follows from them for sets of a size. pct: the threshold in percent; seed: the secret of its hashes."""

    def __init__(self, n: int, pct: int, lower: bool, repeated: float = 0.0, seed: int = 0) -> None:
        self.n, self.pct, self.lower, self.repeated, self.seed = n, pct, lower, repeated, seed
        self.lows = [1]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * 100 // self.pct + 1)
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def differences(self, total: int) -> int:
        """The most elements in which two linked sets of that many elements together differ."""
        return (100 - self.pct) * total // (100 + self.pct)

    def group(self, g: int) -> tuple[int, int, bool]:
        """H, number of segments and whether neighbourhoods are used, for sets of bands g and g + 1."""
        self.band(1)
        while len(self.lows) < g + 3:
            self.lows.append(self.lows[-1] * 100 // self.pct + 1)
        h = self.differences(2 * (self.lows[g + 2] - 1))
        size = self.lows[g + 1]
        best = None
        for times in (1, 2, 3):
            m = times * (h + 1)
            # among `times` segments the rarest is taken: as if that many more elements were in it
            cost = (h + 1) * (1 + 100 * self.repeated ** max(0.5, size / (h + 1)))
            best = min(best, (cost - times * 1e-6, m, False)) if best else (cost - times * 1e-6, m, False)
        m = h // 2 + 1
        cost = (m + size) * (1 + 100 * self.repeated ** max(0.5, size / m - 1))
        best = min(best, (cost, m, True))
        return h, best[1], best[2]

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct n-gram hashes of every text."""
        out = []
        for t in texts:
            raw = (t or "").encode("utf-8", "replace")
            words = (raw.lower() if self.lower else raw).split()
            h = common.word_hashes(words, self.seed)
            if words and len(words) < self.n:
                g = common.gram_hashes(h, len(h)) ^ np.uint64(len(h))
            else:
                g = common.gram_hashes(h, self.n)
            out.append(np.unique(g))
        return out

    def keys(self, own: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """The signatures that a set indexes."""
        out = []
        b = self.band(len(own))
        mixed = common.mix(own * common.M2)
        seen = sketch[(own & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
        for g in (b - 1, b) if b else (b,):
            h, m, near = self.group(g)
            segment = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # grows with the hash: segments are runs
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            held = segment[first]
            total = np.add.reduceat(mixed, first)
            salt = np.uint64((g * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), held)
            if near:
                which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
                sums = np.concatenate([total, total[which] - mixed, np.zeros(len(empty), np.uint64)])
                places = np.concatenate([held, held[which], empty])
            else:
                rarity = np.minimum.reduceat(seen, first).astype(np.int64)
                sums, places = total, held
                if len(empty) and len(held) < h + 1:
                    sums = np.concatenate([sums, np.zeros(len(empty), np.uint64)])
                    places = np.concatenate([places, empty])
                    rarity = np.concatenate([rarity, np.full(len(empty), 1 << 40)])
            k = common.mix((sums + salt) * common.M1 + places) >> np.uint64(64 - KEY_BITS)
            if not near and len(k) > h + 1:
                k = k[np.lexsort((k, rarity))[: h + 1]]
            out.append(k)
        return np.unique(np.concatenate(out))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            yield block, pa.ipc.open_stream(data.as_py()).read_all()


def sketch_of(units: DataFrame, join: Join) -> np.ndarray:
    """A count sketch of all documents' n-grams: 2**SKETCH_BITS graded counters, whatever the corpus; added up by parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, t in _blocks(batches):
            every = np.concatenate([np.zeros(0, np.uint64), *join.sets(t["_text"].to_pylist())])
            total += np.bincount((every & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
        rows = [(k, 0, 0, zstandard.ZstdCompressor(level=1).compress(p.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())) for k, p in enumerate(np.split(total, SKETCH_PARTS))]
        yield from rows_of(schema_of(SENT), rows).to_batches()

    def part(data: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = sum((part(d.as_py()) for d in t["data"]), np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64))
        return rows_of(schema_of(SENT), [(key[0].as_py(), 0, 0, grade(total).tobytes())])

    parts = {r["k"]: np.frombuffer(bytes(r["data"]), np.uint8) for r in units.mapInArrow(count, SENT).groupBy("k").applyInArrow(add, SENT).collect()}
    return np.concatenate([parts.get(k, np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint8)) for k in range(SKETCH_PARTS)])


def grade(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that grow with them: up to 16 as they are, eight to a doubling beyond."""
    return np.where(counts <= 16, counts, 16 + np.floor(8 * np.log2(np.maximum(counts, 16) / 16))).clip(0, 255).astype(np.uint8)


def counts_of() -> np.ndarray:
    """About the count that each grade stands for."""
    g = np.arange(256, dtype=np.float64)
    return np.where(g <= 16, g, 16 * 2 ** ((g - 16) / 8))


def brief(elements: np.ndarray) -> bytes:
    """A byte for each of BRIEF segments of the universe. Sets that differ in d elements differ in at most d of the bytes."""
    segment = (elements >> np.uint64(56)).astype(np.int64)
    low = ((elements * common.M3) >> np.uint64(40)) & np.uint64(0xFFFF)
    return np.bincount(segment, weights=low.astype(np.float64), minlength=BRIEF).astype(np.int64).astype(np.uint16).astype(np.uint8).tobytes()


def _may_link(pct: int):
    """Keeps pairs (member, centre, sizes, briefs) whose briefs and sizes allow a link, or a link of both to a third."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BRIEF) for c in (b.column(4), b.column(5)))
            apart = (x != y).sum(1)
            total = b.column(2).to_numpy() + b.column(3).to_numpy()
            keep = pa.array(apart <= (100 - pct) * total // (100 + pct))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keep], names=["member", "centre", "near"])

    return run


def _class_of(elements: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(elements.tobytes()), "little", signed=True)


def _distinct(join: Join, table: pa.Table, of: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Class and elements of a block's different sets, in the order of its rows; of gets (size, class) of every row."""
    done = set()
    for own in join.sets(table["_text"].to_pylist()):
        c = _class_of(own) if len(own) else None
        if of is not None:
            of.append((len(own), c))
        if c is not None and c not in done:
            done.add(c)
            yield c, own


def components(edges: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """node, label of every node of the edges (a, b): contraction towards the neighbour with the least hash, until none is left."""
    node = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    edges = scratch.save(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    labels = None
    for step in range(1, 64):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min(F.least(node("a"), node("b")))["n"].alias("p"))
        parent = scratch.save(parent, f"{name}-p{step}")
        pa_, pb = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(pa_, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct()
        edges = scratch.save(edges, f"{name}-{step}")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            labels = labels.join(parent.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
    else:
        raise RuntimeError("components not settled after 63 steps")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def keep_keys(keys: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
    """The different keys of a block's sets in order, and whose they are: of each key how many sets have it and which, without the
    keys that only one has, as the buckets tell those that count."""
    every = np.concatenate([np.zeros(0, np.uint64), *keys])
    order = np.argsort(every, kind="stable")
    owners = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])[order]
    values, counts = np.unique(every[order], return_counts=True)
    return values, frames(pack_array(owners), pack_array(counts.astype(np.uint32)), pack_sorted(values[counts > 1]))


def shared_keys(state: bytes, told: list[bytes], sets: int) -> list[np.ndarray]:
    """Of each set its keys in order that another set of its block or of others has. told: the buckets' answers in their order."""
    owners, counts, twice = (f(d) for f, d in zip((lambda d: unpack_array(d, "<u4"), lambda d: unpack_array(d, "<u4"), unpack_sorted), unframe(state), strict=True))
    parts = [unframe(d) for d in told]
    elsewhere = np.concatenate([np.zeros(0, bool), *(unpack_bits(p[0]) for p in parts)])
    values = np.zeros(len(counts), np.uint64)
    values[counts > 1] = twice
    values[elsewhere] = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(p[1]) for p in parts)])
    hit = np.repeat(elsewhere | (counts > 1), counts)
    of, values = owners[hit], np.repeat(values, counts)[hit]
    order = np.argsort(of, kind="stable")
    return np.split(values[order], np.searchsorted(of[order], np.arange(1, sets))) if sets else []


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (member, centre, large, their elements) to (member, centre, large, sizes, the elements in which they differ)."""
    for b in batches:
        out: list[list] = [[], [], []]
        for x, y in zip(b.column(3), b.column(4), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            for col, v in zip(out, (len(p), len(q), np.setxor1d(p, q, assume_unique=True).view(np.int64)), strict=True):
                col.append(v)
        cols = [pa.array(v, pa.int64()) for v in out[:2]]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *cols, pa.array(out[2], pa.list_(pa.int64()))], names=["member", "centre", "large", "size", "centre_size", "diff"])


def ngram_links(df: DataFrame, n: int, pct: int, lower: bool, text: str = "text", key: str = "doc_id", scratch: common.Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class of every row; links between classes: enough of them to connect what is connected).

    Both read tables in scratch, which are the caller's to remove.
    """
    scratch = scratch or common.Scratch(df.sparkSession)
    order = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_key")
    rows = df.select(order, F.col(text).cast("string").alias("_text"), F.col(key).cast("long").alias("_id"))
    blocks = scratch.save(pack_blocks(rows, BLOCK_BYTES, numbered=True), "blocks")
    units = blocks.select("block", "data")
    buckets = count_buckets(blocks, BUCKET_BYTES)
    seed = common.new_seed()
    sketch = sketch_of(units, Join(n, pct, lower, seed=seed))
    # The share of n-grams that stand in a crowded counter, for the cost model.
    value = counts_of()
    held = np.bincount(sketch, minlength=256) * value
    level = max(1.0, float(value[int(np.median(sketch))]))
    repeated = float(held[value > 4 * level + 8].sum() / max(1, held.sum()))
    join = Join(n, pct, lower, min(0.9, max(0.01, repeated)), seed)
    shared = df.sparkSession.sparkContext.broadcast(sketch)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in _blocks(batches):
            values, state = keep_keys([join.keys(own, shared.value) for _, own in _distinct(join, t)])
            out = [(k, block, 1, pack_sorted(values[x:y])) for k, x, y in by_bucket(values, buckets, KEY_BITS)]
            # whose the block's keys are comes back to it with the answers, so that they aren't worked out twice
            own_group = -1 - (block * 0x9E3779B1 >> 7) % (1 << 30)
            out.append((own_group, block, 4, state))
            yield from rows_of(schema_of(SENT), out).to_batches()

    def pick(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        for data in left["data"]:
            table, of = pa.ipc.open_stream(data.as_py()).read_all(), []
            own = list(_distinct(join, table, of))
            for doc, (size, c) in zip(table["_id"].to_pylist(), of, strict=True):
                for col, v in zip(out, (doc, size, c, None, None, None), strict=True):
                    col.append(v)
            told = sorted((k, d) for k, c, d in zip(right["k"].to_pylist(), right["kind"].to_pylist(), right["data"].to_pylist(), strict=True) if c == 1)
            state = next(d for c, d in zip(right["kind"].to_pylist(), right["data"].to_pylist(), strict=True) if c == 4)
            for (c, elements), hit in zip(own, shared_keys(state, [d for _, d in told], len(own)), strict=True):
                if len(hit):
                    for col, v in zip(out, (None, len(elements), c, hit.astype(np.int64), brief(elements), elements.tobytes()), strict=True):
                        col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.table([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["doc_id", "size", "class", "keys", "brief", "elements"])

    # Written, so that the shuffle files of this step are gone before the next one fills the disks.
    found = scratch.save(units.mapInArrow(send, SENT).groupBy("k", "kind").applyInArrow(answer, SENT), "answers")
    common.release(df.sparkSession)
    members = units.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(pick, MEMBERS)
    every = scratch.save(members, "members")
    # What follows reads the tables alone.
    shared.destroy()
    del units, blocks, found, members
    scratch.drop("blocks")
    scratch.drop("answers")
    common.release(df.sparkSession)
    meta = every.where("keys IS NULL").select("doc_id", F.col("size").alias("n_shingles"), "class")
    members = every.where("keys IS NOT NULL").drop("doc_id")
    # A class may come from several blocks; any of its rows has the same keys and elements.
    light = members.groupBy("class").agg(F.first("size").alias("size"), F.first("brief").alias("brief"))
    indexed = members.select("class", F.explode("keys").alias("key")).distinct()
    rank = F.struct(F.xxhash64("class").alias("h"), F.col("class").alias("n"))
    centres = indexed.groupBy("key").agg(F.min(rank)["n"].alias("centre"), F.count("*").alias("held")).where("held > 1")
    by_key = scratch.save(indexed.join(centres, "key").where("class <> centre").select("key", F.col("class").alias("member"), "centre", (F.col("held") <= SMALL).alias("small")), "by-key")
    family = components(by_key.where(~F.col("small")).select(F.col("member").alias("a"), F.col("centre").alias("b")), scratch, "families")
    family = family.select(F.col("node").alias("member"), F.col("label").alias("centre"), F.lit(True).alias("large"))
    pairs = _near(by_key.where("small").select("member", "centre").distinct(), light, pct).withColumn("large", F.lit(False))
    pairs = scratch.save(pairs.unionByName(family), "pairs")  # they are read three times
    linked = _links(F.col("size") + F.col("centre_size"), F.size("diff"), pct)
    compared = scratch.save(_compare(pairs, members).withColumn("linked", linked), "compared")
    common.release(df.sparkSession)
    links = compared.where("linked AND NOT large").select(F.col("member").alias("a"), F.col("centre").alias("b"))
    # Small buckets: pairs that their centre doesn't connect yet.
    told = compared.where("linked AND NOT large").select("member", "centre", "linked")
    side = by_key.where("small").join(told, ["member", "centre"], "left").select("key", "member", F.col("linked").isNotNull().alias("linked"))
    few = side.join(side.select("key", F.col("member").alias("centre"), F.col("linked").alias("other")), "key").where("member < centre AND NOT (linked AND other)").select("member", "centre").distinct()
    few = scratch.save(_near(few, light, pct).withColumn("large", F.lit(False)), "few")
    small = scratch.save(_compare(few, members).where(linked).select(F.col("member").alias("a"), F.col("centre").alias("b")), "small")
    common.release(df.sparkSession)
    return meta, links.unionByName(small).unionByName(_family_links(compared.where("large"), pct, scratch))


def _links(sizes: Column, apart: Column, pct: int) -> Column:
    """Whether two sets that hold that many elements together and differ in `apart` of them link."""
    return (100 + pct) * apart <= (100 - pct) * sizes


def _near(pairs: DataFrame, light: DataFrame, pct: int) -> DataFrame:
    """The pairs (member, centre) whose brief forms allow a link."""
    both = pairs.join(light.select(F.col("class").alias("member"), F.col("size").alias("s"), F.col("brief").alias("x")), "member").join(
        light.select(F.col("class").alias("centre"), F.col("size").alias("cs"), F.col("brief").alias("y")), "centre"
    )
    return both.select("member", "centre", "s", "cs", "x", "y").mapInArrow(_may_link(pct), "member long, centre long, near boolean").where("near").select("member", "centre")


def _compare(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """member, centre, large, their sizes and the elements in which they differ; only sets of the pairs travel.

    A family may hold most rows and has one centre, whose set is therefore dealt out in SALTS copies that meet its members in as
    many parts. Families have over SMALL members, so that the copies are at most twice the members.
    """
    used = pairs.select(F.col("member").alias("class")).unionByName(pairs.select(F.col("centre").alias("class"))).distinct()
    sets = members.select("class", "elements").join(used, "class", "left_semi").dropDuplicates(["class"])
    salt = F.when(F.col("large"), F.pmod(F.xxhash64("member"), F.lit(SALTS))).otherwise(0)
    one = pairs.withColumn("salt", salt).join(sets.select(F.col("class").alias("member"), "elements"), "member")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("large"), SALTS - 1).otherwise(0).cast("long")))
    centres = pairs.select("centre", "large").distinct().withColumn("salt", copies).join(sets.select(F.col("class").alias("centre"), F.col("elements").alias("centre_elements")), "centre")
    both = one.join(centres, ["centre", "large", "salt"])
    return both.select("member", "centre", "large", "elements", "centre_elements").mapInArrow(_differences, "member long, centre long, large boolean, size long, centre_size long, diff array<long>")


def _with_family(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of their family's one row, if any. A family may hold most rows, so that it is dealt out by a salt."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)))
    return salted.join(one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))), ["centre", "salt"], "left").drop("salt")


def _family_links(compared: DataFrame, pct: int, scratch: common.Scratch) -> DataFrame:
    """Links that connect the linked members of each family (rows: member, centre, size, diff; the centre's own among them).

    The elements in which most members differ from the centre are turned over, so that diffs are from the consensus: the
    elements that over half of the family hold. With x = (100 + pct) |diff| - (100 - pct) size, two members link if they have
    at least (x + x') / (2 (100 + pct)) of their differences in common. Where x + x' <= 0 they link for sure, and each of
    them links to the hub, the member with the least x. Other links have a difference in common, and by the prefix principle
    one among the rarest of both, fewer the more they must have in common. Pairs that both link to the hub are left out.
    """
    unit = 2 * (100 + pct)
    tokens = compared.select("centre", F.explode("diff").alias("token")).groupBy("centre", "token").agg(F.count("*").alias("held")).where("held > 1")
    total = compared.groupBy("centre").agg(F.count("*").alias("n"))
    turned = tokens.join(total, "centre").where("2 * held > n").groupBy("centre").agg(F.collect_list("token").alias("turned"))
    both = _with_family(compared, turned).withColumn("turned", F.coalesce("turned", F.array().cast("array<long>")))
    both = both.select("centre", "member", "size", F.concat(F.array_except("diff", "turned"), F.array_except("turned", "diff")).alias("diff"))
    both = both.withColumn("x", (100 + pct) * F.size("diff") - (100 - pct) * F.col("size"))
    hubs = both.groupBy("centre").agg(F.min(F.struct("x", "member", "size", "diff")).alias("hub"))
    apart = F.size("diff") + F.size("hub.diff") - 2 * F.size(F.array_intersect("diff", "hub.diff"))
    both = _with_family(both, hubs).withColumn("in_hub", _links(F.col("size") + F.col("hub.size"), apart, pct))
    both = scratch.save(both.select("centre", "member", "size", "diff", "x", "in_hub", F.col("hub.x").alias("hub_x"), F.col("hub.member").alias("hub")), "family-members")
    star = both.where("in_hub AND member <> hub").select(F.col("member").alias("a"), F.col("hub").alias("b"))
    # What a member must have in common with any that could still matter: with those of greater x, and with those of less.
    least = F.when(F.col("in_hub"), 1 - F.col("hub_x")).otherwise(F.col("hub_x"))
    common_of = lambda x: F.greatest(F.lit(1), F.ceil(x / F.lit(unit)))
    above = F.size("diff") - common_of(F.col("x") + F.greatest("x", least))
    below = F.when(F.col("x") >= least, F.size("diff") - common_of(F.col("x") + least)).otherwise(-1)
    side = both.select("centre", "member", "x", "in_hub", F.size("diff").alias("d"), above.alias("above"), below.alias("below"), "diff")
    flat = side.select("centre", "member", F.explode("diff").alias("token"))
    held = flat.groupBy("centre", "token").agg(F.count("*").alias("held"))
    ranked = flat.join(held, ["centre", "token"]).groupBy("centre", "member").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("ranked"))
    ranked = side.drop("diff").join(ranked, ["centre", "member"]).withColumn("ranked", F.slice("ranked", 1, F.greatest(F.lit(0), F.greatest("above", "below") + 1).cast("int")))
    prefix = scratch.save(ranked.select("centre", "member", "x", "in_hub", "d", "above", "below", F.posexplode("ranked").alias("p", "t")).where("t.held > 1").withColumn("token", F.col("t.token")).drop("t"), "family-prefixes")
    one = prefix.where("p <= below").select("centre", "token", *(F.col(c).alias(f"{c}_a") for c in ("member", "x", "in_hub", "d", "p")))
    two = prefix.where("p <= above").select("centre", "token", *(F.col(c).alias(f"{c}_b") for c in ("member", "x", "in_hub", "d", "p")))
    need = common_of(F.col("x_a") + F.col("x_b"))
    ordered = (F.col("x_a") > F.col("x_b")) | ((F.col("x_a") == F.col("x_b")) & (F.col("member_a") > F.col("member_b")))
    fits = ordered & ~(F.col("in_hub_a") & F.col("in_hub_b")) & (F.col("p_a") + need <= F.col("d_a")) & (F.col("p_b") + need <= F.col("d_b"))
    found = one.join(two, ["centre", "token"]).where(fits).select("centre", F.col("member_a").alias("a"), F.col("member_b").alias("b")).distinct()
    of = lambda c: both.select("centre", F.col("member").alias(c), F.col("size").alias(f"size_{c}"), F.col("diff").alias(f"diff_{c}"))
    apart = F.size("diff_a") + F.size("diff_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
    checked = found.join(of("a"), ["centre", "a"]).join(of("b"), ["centre", "b"]).where(_links(F.col("size_a") + F.col("size_b"), apart, pct))
    return star.unionByName(checked.select("a", "b"))


def ngram_jaccard_join(df: DataFrame, n: int = 5, pct: int = 80, lower: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of every row: links are pairs with similarity of at least pct percent."""
    scratch = common.Scratch(df.sparkSession)
    meta, links = ngram_links(df, n, pct, lower, text, key, scratch)
    label = components(links, scratch, "components")
    least = meta.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = least.join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = scratch.save(named, "named")
    whole = named.groupBy("label").agg(F.min("least").alias("component"))
    by_class = named.join(whole, "label").select("class", "component")
    alone = meta.where("class IS NULL").withColumn("component", F.col("doc_id"))
    rows = meta.where("class IS NOT NULL").join(by_class, "class").select(*alone.columns).unionByName(alone)
    rows = rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("class").alias("class_id"))
    # One narrow table is left; what led to it goes.
    out = common.Scratch(df.sparkSession).save(rows, "components")
    scratch.drop()
    return out


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(common.documents(spark, sf_dir), n=3, pct=90, lower=True)


#: Exact, over the pairs that share a 3-gram.
ORACLE_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM g JOIN r ON r.a = g.doc_id GROUP BY ALL
"""


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_ngram_jaccard(spark, sf_dir).drop("class_id")


QUERIES = {"op1_ngram_jaccard": op1_query}
ORACLES = {"op1_ngram_jaccard": ORACLE_OP1}
