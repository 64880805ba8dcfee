"""Authority resolution, checks and their rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of checks by what they lead to.
ISSUES = ("metadata_mismatch", "quote_mismatch", "wrong_pincite", "wrong_speaker", "does_not_support", "not_addressed")
MANUAL = ("ambiguous_authority", "not_found", "source_unavailable", "unresolved_short_form", "unsupported_authority_type", "manual_review_required", "pincite_unverifiable", "insufficient_context")
QUALIFIED = ("supports_with_qualification", "holding_dicta_concern")
IDLE = ("not_checked", "not_applicable")
PRIORITY = ("issue_found", "manual_review_required", "verified_with_qualification", "verified", "not_checked")


def overall(states: Column) -> Column:
    """The state of an occurrence from an array of its checks' states. A state that is missing counts as not_checked, and none at all too."""
    states = F.transform(F.coalesce(states, F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("not_checked")))
    some = lambda names: F.arrays_overlap(states, F.array(*map(F.lit, names)))
    idle = F.forall(states, lambda s: s.isin(*IDLE))
    return F.when(idle, "not_checked").when(some(ISSUES), "issue_found").when(some(MANUAL), "manual_review_required").when(some(QUALIFIED), "verified_with_qualification").otherwise("verified")


def priority(state: Column) -> Column:
    out = F.lit(len(PRIORITY))
    for k, name in reversed(list(enumerate(PRIORITY))):
        out = F.when(state == name, k).otherwise(out)
    return out


def counts(df: DataFrame, state: str = "overall_status") -> DataFrame:
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col(state) == n).alias(n) for n in PRIORITY))


def resolve(cited: DataFrame, by_citation: DataFrame, by_name: DataFrame) -> DataFrame:
    """cited (occ, citation, name) with candidates, authority_id, status and located_by; citations before names.

    The key tables are (citation, authority_id) and (name, authority_id).
    """
    group = lambda t, k: t.groupBy(k).agg(F.array_sort(F.collect_set("authority_id")).alias(f"by_{k}"))
    out = cited.join(group(by_citation, "citation"), "citation", "left").join(group(by_name, "name"), "name", "left")
    found = F.coalesce("by_citation", "by_name", F.array().cast("array<string>"))
    how = F.when(F.col("by_citation").isNotNull(), "citation").when(F.col("by_name").isNotNull(), "name")
    n = F.size("candidates")
    return (
        out.withColumn("candidates", found)
        .withColumn("located_by", how)
        .withColumn("status", F.when(n == 0, "not_found").when(n > 1, "ambiguous_authority").otherwise("verified"))
        .withColumn("authority_id", F.when(n == 1, F.element_at("candidates", 1)))
        .drop("by_citation", "by_name")
    )


def choose_candidate(candidates: DataFrame, by: str, keep: list[str]) -> DataFrame:
    """by and the kept columns of the candidate (explicit, metadata_path, path) that is taken of several: an explicit one, one with metadata, the first path."""
    rank = F.struct(F.when(F.col("explicit"), 0).otherwise(1).alias("e"), F.when(F.col("metadata_path").isNotNull(), 0).otherwise(1).alias("m"), F.col("path").alias("p"))
    return candidates.groupBy(by).agg(F.min_by(F.struct(*keep), rank).alias("r")).select(by, *[F.col(f"r.{c}").alias(c) for c in keep])


def identity_state(authority_type: Column, kind: Column, candidates: Column, identities: Column, loaded: Column, mismatches: Column, requested: Column) -> Column:
    """The state of an occurrence that is looked up itself: candidates and the different cases among them, whether its source could be read, and what differs."""
    return (
        F.when(~requested, "not_checked").when(authority_type != "case", "unsupported_authority_type").when(kind.isin("short_form", "id"), "unresolved_short_form").when(candidates < 1, "not_found")
        .when(identities > 1, "ambiguous_authority").when(~loaded, "source_unavailable").when(F.size(mismatches) > 0, "metadata_mismatch").otherwise("verified")
    )


def mismatches(name: Column, year: Column, title: Column, source_year: Column) -> Column:
    """What a citation and its source disagree on: year, name."""
    from lexloom.functions.citations import names_compatible

    differ = F.array(F.when(year.isNotNull() & source_year.isNotNull() & (year != source_year), "year"), F.when(name.isNotNull() & title.isNotNull() & ~names_compatible(name, title), "name"))
    return F.filter(differ, lambda m: m.isNotNull())


def compatible_pairs(rows: DataFrame, by: str, key: str, name: str) -> DataFrame:
    """a, b, compatible: every pair of a group's rows (by, key, name), a < b by key, with names_compatible().

    Names are compared as kinds, each two keys of a group once, whatever the number of rows that have them.
    """
    from lexloom.functions.citations import key_tokens, keys_compatible, name_key
    from lexloom.operators.pairs import pairs_by_kind

    # a name that is missing is a kind too, whose verdicts are null
    none = "\0"
    known = rows.where(F.col(by).isNotNull()).select(by, key, F.coalesce(name_key(F.col(name)), F.lit(none)).alias("k"))
    kinds = known.select(by, key, F.struct("k", key_tokens(F.col("k")).alias("t")).alias("_kind"))
    verdict = lambda x, y: F.when((x["k"] != none) & (y["k"] != none), keys_compatible(x["k"], y["k"], x["t"], y["t"]))
    return pairs_by_kind(kinds, [by], key, "_kind", verdict, "compatible")


def resolve_occurrences(occ: DataFrame, direct: DataFrame, key: str = "doc_id") -> DataFrame:
    """occ (key, seq, kind, authority_type, linked_seq, anchor) with identity_status, authority_id, located_by of direct (key, seq, ...): linked
    short forms have what their anchor has, mismatches included; without an anchor they are unresolved."""
    fields = ("identity_status", "authority_id", "located_by")
    own = direct.select(key, F.col("seq").alias("anchor"), *fields)
    out = occ.join(own, [key, "anchor"], "left")
    linked = F.col("kind").isin("short_form", "id")
    state = F.when(F.col("authority_type") != "case", "unsupported_authority_type").when(linked & F.col("authority_id").isNull(), "unresolved_short_form").otherwise(F.col("identity_status"))
    return out.withColumn("identity_status", state)


def initial_states(requested: Column, quotation: Column, loaded: Column, authority_type: Column) -> Column:
    """struct(speaker, proposition): where analyses stand before any model was asked."""
    speaker = F.when(~F.array_contains(requested, "speaker"), "not_checked").when(quotation.isNull(), "not_applicable").when(~loaded, "source_unavailable").otherwise("manual_review_required")
    proposition = F.when(~F.array_contains(requested, "proposition_support"), "not_checked").when(authority_type != "case", "manual_review_required").when(~loaded, "source_unavailable").otherwise("manual_review_required")
    return F.struct(speaker.alias("speaker"), proposition.alias("proposition"))


def quotation_state(requested: Column, quote: Column, source: Column, exact: Column, omission: Column) -> Column:
    return F.when(~requested, "not_checked").when(quote.isNull(), "not_applicable").when(source.isNull(), "source_unavailable").when(exact, "verified").when(omission, "manual_review_required").otherwise("quote_mismatch")


# What stands for an omission. Of more than three points in a row none is text: where a sentence ends before an
# omission, its point would else be left over for the next piece, which then stands nowhere.
OMISSION = r"\.(?:\s*\.){2,}|…|\[\s*(?:\.\s*){3,}\]"


def quotation_pieces(quote: str, least: int = 15) -> list[str]:
    """The folded pieces of a quotation between its omissions, without those that are too short to tell anything."""
    import re

    from lexloom.functions.text import folded_index

    return [p for x in re.split(OMISSION, quote) if len(p := folded_index(x)[0]) >= least]


def omission_match(quote: Column, source: Column, least: int = 15, gap: int = 5000) -> Column:
    """True if the pieces of a quotation between omissions follow each other in the source, not too far apart; short pieces are passed over.

    quote: as it is, since an ellipsis that is folded can't be told from points; source: folded.
    """
    from lexloom.functions.text import fold_typography

    pieces = F.filter(F.transform(F.split(quote, OMISSION), fold_typography), lambda p: F.length(p) >= least)

    def step(at: Column, piece: Column) -> Column:
        begin = F.call_function("locate", piece, source, F.greatest(at, F.lit(1)))
        good = (at >= 0) & (begin > 0) & ((at == 0) | (begin - at <= gap))
        return F.when(good, (begin + F.length(piece)).cast("int")).otherwise(F.lit(-1))

    return (F.size(pieces) >= 2) & (F.aggregate(pieces, F.lit(0), step) > 0)


# How pages are marked in a text: [410 U.S. 113], page 113, *113.
PAGE_MARKS = (r"\[(?:\d+\s+)?[A-Za-z.\d ]+\s+(\d{1,7})\]", r"(?i)(?<![A-Za-z0-9_])page\s+(\d{1,7})(?![A-Za-z0-9_])", r"(?:^|\s)\*(\d{1,7})(?=\s|$)")


def page_markers(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, page, start_at, end_at (from 0, end exclusive) of every page marker.

    Places follow from the lengths of what stands between the matches, so all of it stays in expressions.
    """

    def rows(pattern: str) -> Column:
        marks, pages = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        between = F.transform(F.split(F.col(text), pattern), lambda x: F.length(x))
        total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda acc, x: acc + x)
        sizes = F.transform(marks, lambda m: F.length(m))
        each = F.transform(pages, lambda p, i: F.struct(p.cast("long").cast("string").alias("page"), (total(between, i + 1) + total(sizes, i)).alias("start_at"), F.get(sizes, i).alias("n")))
        return F.when(F.size(pages) > 0, each).otherwise(F.array().cast("array<struct<page:string,start_at:int,n:int>>"))

    found = [rows(p) for p in PAGE_MARKS]
    out = texts.select(key, F.explode(F.concat(*found)).alias("m"))
    return out.select(key, "m.page", "m.start_at", (F.col("m.start_at") + F.col("m.n")).alias("end_at"))


def pincite_state(requested: Column, pincite: Column, loaded: Column, quotation: Column, unique: Column, crossed: Column, observed: Column) -> Column:
    """struct(status, observed_page). A pinpoint holds only if the quotation is exact, stands once, crosses no marker, and the page before it is the one cited."""
    page = F.when((quotation == "verified") & unique & ~crossed, observed)
    holds = pincite.rlike(r"^\d+$") & (page == pincite.cast("long").cast("string"))
    status = F.when(~requested, "not_checked").when(pincite.isNull(), "not_applicable").when(~loaded, "source_unavailable").when(F.coalesce(holds, F.lit(False)), "verified").otherwise("pincite_unverifiable")
    return F.struct(status.alias("status"), F.when(status.isin("verified", "pincite_unverifiable"), page).alias("observed_page"))


def verify_pincites(quotes: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """quotes (key, q_id, pincite, status of the quotation, source_quote, start_at) with pincite_status and observed_page.

    Markers and texts meet the quotations by document: the page is the last marker that ends before the quotation begins.
    """
    q = quotes.join(texts.select(key, F.col(text).alias("_text")), key, "left")
    at = F.call_function("locate", F.col("source_quote"), F.col("_text"), F.lit(1))
    again = F.call_function("locate", F.col("source_quote"), F.col("_text"), at + 1)
    q = q.withColumn("_at", (at - 1).cast("int")).withColumn("_once", F.coalesce((at > 0) & (again == 0), F.lit(False)))
    inside = page_markers(texts, key, text)
    marks = inside.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at", "page"))).alias("_marks"))
    q = q.join(marks, key, "left")
    ended = F.filter("_marks", lambda m: m["end_at"] <= F.col("_at"))
    crossed = F.coalesce(F.exists("_marks", lambda m: (m["start_at"] >= F.col("_at")) & (m["start_at"] < F.col("_at") + F.length("source_quote"))), F.lit(False))
    observed = F.try_element_at(ended, F.lit(-1))["page"]
    state = pincite_state(F.lit(True), F.col("pincite"), F.col("_text").isNotNull(), F.col("status"), F.col("_once"), crossed, observed)
    return q.withColumn("_state", state).select(*quotes.columns, F.col("_state.status").alias("pincite_status"), F.col("_state.observed_page").alias("observed_page"))


def pincites(markers: DataFrame, quotes: DataFrame, key: str = "doc_id") -> DataFrame:
    """quotes (key, q_id, start_at) with observed_page: the page of the last marker (key, page, end_at) that ends before."""
    left = markers.select(key, F.col("end_at").alias("at"), F.lit(0).alias("o"), "page", F.lit(None).cast("long").alias("q_id"))
    right = quotes.select(key, F.col("start_at").alias("at"), F.lit(1).alias("o"), F.lit(None).cast(dict(markers.dtypes)["page"]).alias("page"), "q_id")
    w = Window.partitionBy(key).orderBy("at", "o", "page", "q_id").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("observed_page", F.last("page", ignorenulls=True).over(w))
    return both.where("o = 1").select(key, "q_id", F.col("at").alias("start_at"), "observed_page")


def interval_join(spans: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """spans (key, s, e) x ranges (key, start_at, end_at) of the same key that overlap: start_at < e and end_at > s. Places are whole numbers.

    Both meet in dyadic cells, so that one very long document is dealt out by place. An interval has the level whose cells are as
    long as it is, and touches one or two of them; two intervals meet at the greater of their levels, in the cell that holds the
    first place of both. So an interval is sent once or twice for its own level and for each greater one of the other side, and a
    pair is found once. Only the levels that occur, 64 numbers at most, come to the driver. Empty intervals are places, and a null
    key or place meets nothing.
    """
    width = lambda lo, hi: F.length(F.bin(F.col(hi) - F.col(lo))).cast("int")
    a = spans.withColumn("_lo", F.least("s", "e").cast("long")).withColumn("_hi", F.greatest("s", "e").cast("long")).where("s IS NOT NULL AND e IS NOT NULL").withColumn("_level", width("_lo", "_hi"))
    b = ranges.withColumn("_lo", F.least("start_at", "end_at").cast("long")).withColumn("_hi", F.greatest("start_at", "end_at").cast("long")).where("start_at IS NOT NULL AND end_at IS NOT NULL").withColumn("_level", width("_lo", "_hi"))
    levels = [sorted(r[0] for r in x.select("_level").distinct().collect()) for x in (a, b)]

    def dealt(x: DataFrame, others: list[int], names: str) -> DataFrame:
        upper = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda v: v > F.col("_level"))
        x = x.withColumn("_at", F.explode(F.concat(F.array("_level"), upper)))
        cell = lambda c: F.call_function("shiftright", F.col(c), F.col("_at"))
        x = x.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("_lo"), cell("_hi")))))
        return x.withColumnRenamed("_lo", f"_lo{names}").withColumnRenamed("_level", f"_level{names}").drop("_hi")

    met = dealt(a, levels[1], "_a").join(dealt(b, levels[0], "_b"), [key, "_at", "_cell"])
    here = F.col("_cell") == F.call_function("shiftright", F.greatest("_lo_a", "_lo_b"), F.col("_at"))
    fits = (F.col("_at") == F.greatest("_level_a", "_level_b")) & here & (F.col("start_at") < F.col("e")) & (F.col("end_at") > F.col("s"))
    return met.where(fits).drop("_at", "_cell", "_lo_a", "_lo_b", "_level_a", "_level_b")


def neighbours(items: DataFrame, cited: DataFrame, key: str, order: str) -> DataFrame:
    """Items at a cited place or next to one: a semi-join on places, each cited one spread over three."""
    wide = cited.select(key, F.explode(F.array(F.col(order) - 1, F.col(order), F.col(order) + 1)).alias(order)).distinct()
    return items.join(wide, [key, order], "left_semi")


def first_seen_ids(df: DataFrame, by: str, order: str, prefix: str = "A", width: int = 4) -> DataFrame:
    """by, id: numbered by first appearance.

    Values are dealt out by ranges of their first appearance, written, counted range by range, and numbered within each: no
    task sees them all. Only one count a range comes to the driver.
    """
    from lexloom.session import saved

    first = df.groupBy(by).agg(F.min(order).alias("_first"))
    dealt = saved(first.repartitionByRange("_first", by).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    table = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    n = F.row_number().over(Window.partitionBy("_part").orderBy("_first", by)) + F.element_at(table, F.col("_part"))
    return dealt.select(by, F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0")).alias("id"))
