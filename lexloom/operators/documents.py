"""Documents to blocks, parts, search results and integrity states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexloom.functions import text as T
from lexloom.session import saved

# Target length of a block's text, what it may exceed it by, and the first letter of block ids, by profile.
PROFILES = {"analysis": (1600, 250, "P"), "draft": (1800, 300, "D")}
#: Words of a quotation by which documents are looked up, and hashes that are sent to every task at most.
RUN, FEW = 8, 1_000_000


def numbered_blocks(df: DataFrame, texts: Column, key: str, prefix: str) -> DataFrame:
    """key, block_no, block_id, text of an array of texts. The numbers are the array's own positions, so there is no shuffle."""
    out = df.select(F.col(key), F.posexplode(texts).alias("p", "text"))
    number = F.col("p") + 1
    return out.select(key, number.cast("int").alias("block_no"), F.concat(F.lit(prefix), F.lpad(number.cast("string"), 5, "0")).alias("block_id"), "text")


def blocks(df: DataFrame, key: str = "doc_id", text: str = "text", prefix: str = "P", profile: str = "analysis") -> DataFrame:
    """The non-empty paragraphs of every text, numbered from 1."""
    return numbered_blocks(df, T.paragraphs(F.col(text), profile), key, prefix)


def split_long(value: str, target: int = 1600, window: int = 250) -> list[str]:
    """Chunks of about target characters, cut after the last sentence, clause or word within the window."""
    out = []
    while len(value) > target + window:
        reach = value[: target + window]
        cut = next((at + len(mark) for mark in (". ", "; ", " ") if (at := reach.rfind(mark)) >= target // 2), target)
        out.append(value[:cut].strip())
        value = value[cut:].strip()
    return [*out, value] if value else out


def long_blocks(df: DataFrame, key: str = "doc_id", text: str = "text", profile: str = "analysis") -> DataFrame:
    """blocks() with long paragraphs cut into chunks; a map over rows."""
    target, window, prefix = PROFILES[profile]

    def chunks(s: pd.Series) -> pd.Series:
        return s.map(lambda ps: [c for p in ps for c in split_long(p, target, window)])

    cut = F.pandas_udf(chunks, ArrayType(StringType()))
    return numbered_blocks(df, cut(T.paragraphs(F.col(text), profile)), key, prefix)


def block_ranges(blocks_: DataFrame, key: str = "doc_id", gap: int = 2) -> DataFrame:
    """start_at and end_at of every block in its document's text joined by gap characters."""
    w = Window.partitionBy(key).orderBy("block_no")
    end = F.sum(F.length("text") + gap).over(w) - gap
    return blocks_.withColumn("end_at", end.cast("long")).withColumn("start_at", (F.col("end_at") - F.length("text")).cast("long"))


def parts_of(sizes: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Runs (first, last) of blocks, from 1: as many as fit the limit, one at least. The next run begins so far back that it
    shares the overlap; if that would be the same beginning again, it begins behind the run."""
    ends, total = [0], 0
    for n in sizes:
        total += n
        ends.append(total)
    out, begin = [], 0
    while begin < len(sizes):
        end = begin + 1
        while end < len(sizes) and ends[end + 1] - ends[begin] <= limit:
            end += 1
        out.append((begin + 1, end))
        if end == len(sizes):
            break
        back = end
        while back > begin and ends[end] - ends[back] < overlap:
            back -= 1
        begin = end if back == begin else back
    return out


def overlapping_parts(df: DataFrame, limit: int = 120_000, overlap: int = 2_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part_no, first_block, last_block: runs of a document's blocks within a token limit, each repeating the last of the run before.

    Only the sizes of a document's blocks reach Python, as one array of its row: no shuffle.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive, and the overlap less than it and not negative")

    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda sizes: [{"first_block": a, "last_block": b} for a, b in parts_of(list(sizes), limit, overlap)])

    sizes = F.transform(T.paragraphs(F.col(text)), T.token_estimate)
    runs = F.pandas_udf(fold, "array<struct<first_block:int,last_block:int>>")(sizes)
    return df.select(key, F.posexplode(runs).alias("p", "r")).select(key, (F.col("p") + 1).alias("part_no"), "r.first_block", "r.last_block")


def subset_text(blocks_: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, tokens: the blocks of every document that are left, joined again in their order."""
    rows = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    joined = F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n")
    return blocks_.groupBy(key).agg(joined.alias("text")).withColumn("tokens", T.input_tokens(F.col("text")))


def integrity(
    html: Column, html_sha256: Column, text_sha256: Column | None = None, minimum: int = 200, text: Column | None = None, most: int = 50_000_000, regular: Column | None = None, size: Column | None = None
) -> Column:
    """missing, unreadable, empty, unverified, changed or valid.

    html: the saved bytes or text; what is measured and compared with text_sha256 is the opinion's own text, collapsed (text, if
    that is extracted otherwise). regular: whether it is a file inside its library; size: its bytes, if not those of html.
    """
    own = T.collapse(text if text is not None else T.opinion_html_to_text(html.cast("string")))
    length = size if size is not None else F.octet_length(html)
    changed = F.sha2(html, 256) != html_sha256
    if text_sha256 is not None:
        changed = changed | F.coalesce(F.sha2(own, 256) != F.nullif(text_sha256, F.lit("")), F.lit(False))
    return (
        F.when(html.isNull() & (size.isNull() if size is not None else F.lit(True)), "missing")
        .when(~regular if regular is not None else F.lit(False), "unreadable")
        .when(length > most, "unreadable")
        .when(F.length(own) < minimum, "empty")
        .when(F.coalesce(html_sha256, F.lit("")) == "", "unverified")
        .when(changed, "changed")
        .otherwise("valid")
    )


def acquisition_hashes(html: Column, text: Column | None = None) -> Column:
    """struct(html_sha256, text_sha256): what a saved opinion is recorded with."""
    own = T.collapse(text if text is not None else T.opinion_html_to_text(html.cast("string")))
    return F.struct(F.sha2(html, 256).alias("html_sha256"), F.sha2(own, 256).alias("text_sha256"))


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, duplicate_of for every row whose text has an earlier copy. Partial aggregation meets hot groups; no window over a group."""
    hashed = df.select(F.col(key), F.sha2(F.col(text), 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min(key).alias("duplicate_of"), F.count("*").alias("n")).where("n > 1").drop("n")
    return hashed.join(first, "h").where(F.col(key) != F.col("duplicate_of")).select(key, "duplicate_of")


def search(df: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    """Rows in whose columns together every term occurs, whatever its case."""
    haystack = F.lower(F.concat_ws("\n", *columns))
    for t in terms:
        df = df.where(F.contains(haystack, F.lit(t.lower())))
    return df


def search_library(library: DataFrame, query: str | None = None, case_key: str | None = None, court: str | None = None) -> DataFrame:
    """Rows (case_key, title, citations, court, date_filed, year, text, integrity, ...) with the passage that matches.

    Texts count only where they are whole. Key and court are pushed down before any text is read.
    """
    if case_key:
        library = library.where(F.col("case_key") == case_key)
    if court:
        library = library.where(F.contains(F.lower(F.coalesce("court", F.lit(""))), F.lit(court.lower())))
    terms = [t for t in (query or "").lower().split() if t]
    text = F.when(F.col("integrity") == "valid", F.col("text")).otherwise("")
    haystack = F.lower(F.concat_ws(" ", "title", F.concat_ws(" ", "citations"), "court", "date_filed", "year", text))
    for t in terms:
        library = library.where(F.contains(haystack, F.lit(t)))
    passage = T.snippet(text, terms) if terms else F.lit(None).cast("string")
    return library.withColumn("matching_passage", passage).withColumn("date", F.coalesce("date_filed", "year"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page, the total and the next offset; the total is an aggregate of its own, so that no window holds all rows."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def next_offset(total: Column, offset: int, limit: int) -> Column:
    return F.when(F.lit(offset + limit) < total, F.lit(offset + limit))


def quoted_documents(quotes: DataFrame, docs: DataFrame, quote_key: str = "item_id", key: str = "doc_id", words: int = RUN) -> DataFrame:
    """quote_key, key of every document that contains a quotation after folding typography.

    Candidates share the hash of the quotation's first whole words; only hashes and keys meet, first against the quotations'
    own hashes, which go to every task if they are at most FEW, else by a shuffle. Texts are fetched for the candidates alone.
    Quotations of fewer words are looked up by their longest inner word, and those without one through the distinct words of
    all documents, never by comparing each of them with every text.
    """
    fold = T.fold_typography
    q = quotes.select(quote_key, fold(F.col("text")).alias("q")).where("q <> ''").withColumn("ws", F.split("q", " "))
    # the words are a column of their own, or they would be cut anew for every run
    d = docs.select(key, fold(F.col("text")).alias("t")).withColumn("ws", F.split("t", " "))
    run_at = lambda i: F.xxhash64(*(F.get("ws", i + j) for j in range(words)))
    # inner words only: the first and last word of a quotation may be cut out of longer ones
    inner = F.slice("ws", 2, F.greatest(F.size("ws") - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    probes = q.select(quote_key, F.when(F.size("ws") >= words + 2, run_at(F.lit(1))).when(F.size("ws") >= 3, F.xxhash64(longest)).alias("h"), (F.size("ws") >= words + 2).alias("run"))
    probes = probes.where("h IS NOT NULL")

    def candidates(run: bool) -> DataFrame:
        mine = probes.where("run" if run else "NOT run").select(quote_key, "h")
        n = mine.limit(FEW + 1).count()
        if not n:
            return mine.select(quote_key, F.lit(None).cast(dict(d.dtypes)[key]).alias(key)).where("false")
        runs = F.transform(F.sequence(F.lit(0), F.size("ws") - words), run_at) if run else F.transform("ws", lambda w: F.xxhash64(w))
        grams = d.where(F.size("ws") >= (words if run else 3)).select(key, F.explode(F.array_distinct(runs)).alias("h"))
        return grams.join(F.broadcast(mine) if n <= FEW else mine, "h").select(quote_key, key)

    short = q.where(F.size("ws") < 3).withColumn("piece", F.element_at(F.array_sort("ws", lambda a, b: F.length(b) - F.length(a)), 1))
    found = candidates(True).unionByName(candidates(False))
    if not short.isEmpty():
        each = d.select(key, F.explode(F.array_distinct("ws")).alias("w"))
        known = each.select("w").distinct().join(short.select(quote_key, "piece"), F.contains("w", "piece")).select(quote_key, "w")
        found = found.unionByName(each.join(known, "w").select(quote_key, key))
    pairs = saved(found.distinct())  # read twice
    texts = d.drop("ws").join(pairs.select(key).distinct(), key, "left_semi")
    return pairs.join(texts, key).join(q.select(quote_key, "q"), quote_key).where(F.contains("t", "q")).select(quote_key, key)


def _locate(quote: str, text: str, least: int, gap: int) -> tuple[str, int, int] | None:
    """How and where (from, to, in the text as it is) a quotation stands in a text: exact, or by pieces between omissions."""
    from lexloom.operators.verification import quotation_pieces

    folded, at = T.folded_index(text)
    needle = T.folded_index(quote)[0]
    if not needle:
        return None
    if (i := folded.find(needle)) >= 0:
        return "exact", at[i], at[i + len(needle) - 1] + 1
    pieces, first, here = quotation_pieces(quote, least), None, 0
    for p in pieces if len(pieces) > 1 else ():
        i = folded.find(p, here)
        if i < 0 or (first is not None and i - here > gap):
            return None
        first, here = i if first is None else first, i + len(p)
    return ("omission", at[first], at[here - 1] + 1) if first is not None else None


def locate_quotations(df: DataFrame, quote: str = "quotation", text: str = "source_text", least: int = 15, gap: int = 5000) -> DataFrame:
    """df with how, start_at, end_at and source_quote: where its quotation stands in its source text, in the text's own places.

    One row holds one source and one quotation; a map over rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([*df.schema.fields, *StructType.fromDDL("how string, start_at int, end_at int, source_quote string").fields])
    target = to_arrow_schema(out)
    a, b = df.columns.index(quote), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                f = _locate(x, y, least, gap) if x and y else None
                for col, v in zip(cols, (*f, y[f[1] : f[2]]) if f else (None,) * 4, strict=True):
                    col.append(v)
            arrays = [c.cast(t.type) for c, t in zip(batch.columns, target, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, t.type) for c, t in zip(cols, list(target)[-4:], strict=True))], schema=target)

    return df.mapInArrow(run, out)
