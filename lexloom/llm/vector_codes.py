"""Codes of vectors by parts: every part of a vector is named by the nearest entry of its place's codebook, found by a VA-file.

Entries' coordinates are quantised to a few bits each: per place, part coordinate and codebook the range of the entries is cut
into equal cells. For a part, a table per coordinate tells the least and the greatest squared distance to each cell; summed over
an entry's cells they bracket its distance. Entries whose lower bound exceeds the least upper bound are ruled out, the others,
whose brackets overlap, are compared by integer distances, ties to the lower index.

Codebooks start as the parts of the least ids and move in rounds: each is a pass over all rows, which stay where they are. A
task adds up its parts by entry, so that it sends one row for each place and entry, and what the driver holds is the codebooks
(places * entries * coordinates). Errors of a label are added up in the same way and joined back: by broadcast where the labels
are few, else with salted keys, as one label may hold a third of all rows.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; a null id stays, and is the
greatest. A shorter vector counts as padded with zeros, and all are padded to a multiple of the parts. With fewer rows than entries,
codebooks have as many entries as rows. Of equal least ids the least vector comes first. Entries of equal distance: the lower index.
Components beyond +-2^27 (for up to 64 coordinates, less for more, so that an error fits 64 bits) count as that. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexloom.llm import common
from lexloom.llm.exact_top_k import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a quantised coordinate.
BITS = 3
#: Rows whose tables are made at a time.
SLICE = 4_096
#: Labels whose errors are broadcast, and copies of a label's error where there are more.
FEW_LABELS, SALTS = 100_000, 32
CODES = "vec_id long, label long, code string, error long"
SUMS = "place int, entry int, n long, sums array<long>"


class Cells:
    """The VA-file of one codebook (entries x coordinates, integers)."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries, n = entries, 1 << bits
        low, high = entries.min(0), entries.max(0)
        step = np.maximum(1, -(-(high - low + 1) // n))
        cell = (entries - low) // step
        #: First and last integer of every cell, by coordinate.
        self.first = low[:, None] + np.arange(n) * step[:, None]
        self.last = self.first + step[:, None] - 1
        # one row for each coordinate and cell, one column for each entry that lies there
        self.lies = (cell.T[:, None, :] == np.arange(n)[None, :, None]).reshape(-1, len(entries)).astype(np.float64)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of every part the nearest entry and its squared distance, and how many distances were worked out."""
        x = parts[:, :, None]
        below, above = (self.first - x).astype(np.float64), (x - self.last).astype(np.float64)
        least = (np.maximum(0.0, np.maximum(below, above)) ** 2).reshape(len(parts), -1) @ self.lies
        most = (np.maximum(np.abs(self.last - x), np.abs(self.first - x)).astype(np.float64) ** 2).reshape(len(parts), -1) @ self.lies
        # sums of squares are right to a few units of the last place
        row, entry = np.nonzero(least * (1 - 1e-12) <= most.min(1)[:, None] * (1 + 1e-12))
        off = parts[row] - self.entries[entry]
        far = np.full((len(parts), len(self.entries)), np.iinfo(np.int64).max)
        far[row, entry] = np.einsum("ij,ij->i", off, off)
        best = far.argmin(1)
        return best, far[np.arange(len(parts)), best], len(row)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _assigned(column: pa.Array, width: int, books: list[Cells], most: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows, place by place: from, to, place, parts, entries, squared distances."""
    for lo in range(0, len(column), SLICE):
        v = np.clip(matrix(column.slice(lo, SLICE), width), -most, most)
        size = width // len(books)
        for place, book in enumerate(books):
            part = np.ascontiguousarray(v[:, place * size : (place + 1) * size])
            yield lo, lo + len(v), place, part, *book.nearest(part)[:2]


def _summed(rows: DataFrame, shared) -> DataFrame:
    """Each task's sums of the parts of every entry."""
    target = _arrow(SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, width, most = shared.value
        books = [Cells(e) for e in entries]
        total, count = np.zeros_like(entries), np.zeros(entries.shape[:2], np.int64)
        for b in batches:
            for _, _, place, part, entry, _ in _assigned(b.column(0), width, books, most):
                np.add.at(total[place], entry, part)
                count[place] += np.bincount(entry, minlength=len(count[place]))
        place, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * total.shape[2], pa.int32()), pa.array(total[place, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[place, entry]), sums], schema=target)

    return rows.select("v").mapInArrow(run, SUMS)


def _moved(rows: DataFrame, entries: np.ndarray, width: int, most: int) -> np.ndarray:
    """The codebooks after one round."""
    shared = rows.sparkSession.sparkContext.broadcast((entries, width, most))
    wide = F.transform("sums", lambda x: x.cast("decimal(38,0)"))
    each = _summed(rows, shared).select("place", "entry", "n", F.posexplode(wide).alias("at", "s")).groupBy("place", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = entries.copy()
    # at most places * entries * coordinates rows
    for place, entry, at, n, s in each.toLocalIterator():
        out[place, entry, at] = int(s) // int(n)
    shared.destroy()
    return out


def _coded(rows: DataFrame, shared) -> DataFrame:
    target = _arrow(CODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, width, most = shared.value
        books = [Cells(e) for e in entries]
        for b in batches:
            codes, errors = np.zeros((b.num_rows, len(books)), np.uint8), np.zeros(b.num_rows, np.int64)
            for lo, hi, place, _, entry, far in _assigned(b.column(2), width, books, most):
                codes[lo:hi, place] = entry
                errors[lo:hi] += far
            text = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(errors)], schema=target)

    return rows.select("vec_id", "label", "v").mapInArrow(run, CODES)


def bound_of(width: int) -> int:
    """The greatest component with which an error of `width` coordinates fits 64 bits."""
    return 1 << min(27, (61 - max(1, width - 1).bit_length()) // 2 - 1)


def fit(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (places x entries x coordinates) of rows (vec_id, v) after some rounds."""
    most = bound_of(width)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()["v"].combine_chunks()
    start = np.clip(matrix(first, width), -most, most)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(rows, books, width, most)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal numbers, by place, entry and coordinate."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def integer_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label and v: floor(scale * x) for every component; rows that take part only."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v")).where(F.col("v").isNotNull() & sound)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))


def with_label_errors(coded: DataFrame, few: int = FEW_LABELS) -> DataFrame:
    """coded with label_error: the errors of all rows of the same label, nulls together."""
    spark, scratch = coded.sparkSession, common.Scratch(coded.sparkSession)
    sums = scratch.save(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "sums").withColumnRenamed("label", "_label")
    if sums.limit(few + 1).count() <= few:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    # a label's rows are dealt out to several tasks, each of which gets its sum
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = coded.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return own.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt"))).drop("_label", "_own", "_salt")


def vector_codes(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code, error of every row that takes part, and the codebooks; None where there are no rows."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is two hex digits")
    scratch = common.Scratch(df.sparkSession)
    rows = scratch.save(integer_rows(df, key, vector, label, scale), "rows")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return df.sparkSession.createDataFrame([], CODES), None
    width = -(-max(1, longest) // parts) * parts
    books = fit(rows, width, parts, entries, rounds)
    shared = df.sparkSession.sparkContext.broadcast((books, width, bound_of(width)))
    coded = scratch.save(_coded(rows, shared), "codes")
    shared.destroy()
    scratch.drop("rows")
    return coded, books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_errors(coded).withColumn("codebooks_sha256", F.lit(digest(books) if books is not None else None).cast("string"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """The rounds written out one after the other; books as rows of place, entry, pos, c."""
    size = "(SELECT max(len(e)) // 8 FROM v)"
    near = """SELECT r, place, entry, d FROM (
      SELECT x.r, x.place, b.entry, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{k} b USING (place, pos) GROUP BY x.r, x.place, b.entry)
      QUALIFY row_number() OVER (PARTITION BY r, place ORDER BY d, entry) = 1"""
    ctes = [
        """v AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT))) AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)""",
        f"x AS MATERIALIZED (SELECT r, i // {size} AS place, i % {size} AS pos, e[i + 1] AS c FROM (SELECT r, e, unnest(range(len(e))) AS i FROM v))",
        "b0 AS MATERIALIZED (SELECT place, r - 1 AS entry, pos, c FROM x WHERE r <= 16)",
    ]
    for k in range(ROUNDS):
        ctes.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        ctes.append(f"""m{k} AS MATERIALIZED (SELECT place, entry, pos, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (r, place) GROUP BY place, entry, pos)""")
        ctes.append(f"""b{k + 1} AS MATERIALIZED (
      SELECT place, entry, pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM b{k} LEFT JOIN m{k} USING (place, entry, pos))""")
    ctes.append(f"a AS MATERIALIZED ({near.format(k=ROUNDS)})")
    ctes.append("g AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY place) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY r)")
    ctes.append(f"h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY place, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN g USING (r) CROSS JOIN h"


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": _oracle()}
