"""Append-only journals: replay, latest wins, comparison, resumption; cursors and partitions of collections.

A state machine is a row, and a step of it an expression over that row and what was fetched: a table of machines takes its
steps together, and a stream takes one for each page that arrives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scholar's page size and the offset at which it shows no more, and the years that filters span.
SCHOLAR_PAGE, LAST_OFFSET, COURTLISTENER_PAGE, FIRST_YEAR = 20, 980, 20, 1600


def latest(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The last event of every key; an aggregate with partial results, so hot keys don't gather."""
    row = F.max_by(F.struct(*columns), order).alias("r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"r.{c}").alias(c) for c in columns])


def first_of_each(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """The first event of every non-null id."""
    row = F.min_by(F.struct(*columns), order).alias("r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def committed_lines(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, line_no, line, torn of journals (whole files as text or bytes): lines that end with a newline; torn: what follows the last one."""
    text = F.col(content).cast("string")
    whole = F.regexp_extract(text, r"(?s)^(.*\n)", 1)
    torn = F.nullif(F.substring(text, F.length(whole) + 1, F.length(text)), F.lit(""))
    lines = F.filter(F.transform(F.split(whole, "\n"), lambda x, i: F.struct((i + 1).alias("no"), F.regexp_replace(x, "\r$", "").alias("line"))), lambda r: F.trim(r["line"]) != "")
    return files.select(key, F.explode_outer(lines).alias("r"), torn.alias("torn")).select(key, F.col("r.no").alias("line_no"), F.col("r.line").alias("line"), "torn")


def journal_events(lines: DataFrame, schema: str, key: str = "path") -> DataFrame:
    """key, line_no, event, bad: each committed line against a schema; bad if it isn't JSON, which stops a replay."""
    bad = F.col("line").isNotNull() & F.try_parse_json("line").isNull()
    return lines.select(key, "line_no", F.from_json("line", schema).alias("event"), bad.alias("bad")).where("line_no IS NOT NULL")


def refuse_bad_lines(events: DataFrame) -> DataFrame:
    """events, failing as soon as one is bad."""
    return events.where(F.when(F.col("bad"), F.raise_error(F.concat(F.lit("invalid committed JSON on line "), F.col("line_no").cast("string"))).cast("boolean")).otherwise(F.lit(True)))


def replay(events: DataFrame, run: str = "run_id", order: str = "line_no") -> DataFrame:
    """run, last_retrieved_at, completed_pages, downloads (a map) of a journal's events (type, page, retrieved_at, case_key, download).

    The journal counts, not what was written beside it: the last page's time, the last download of each case, all pages once.
    """
    page = F.col("type") == "page"
    pages = events.groupBy(run).agg(F.max_by(F.when(page, F.col("retrieved_at")), F.when(page, F.col(order))).alias("last_retrieved_at"), F.array_sort(F.collect_set(F.when(page, F.col("page")))).alias("completed_pages"))
    last = latest(events.where("type = 'download'"), [run, "case_key"], F.col(order), ["download"])
    downloads = last.groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct("case_key", "download"))).alias("downloads"))
    return pages.join(downloads, run, "left")


def load_journal(events: DataFrame, run: str = "run_id", order: str = "line_no") -> DataFrame:
    """The events that count of a collection's journal (event_id, records, retrieved_at): the first of each id, none without id or records."""
    usable = events.where("event_id IS NOT NULL AND event_id <> '' AND records IS NOT NULL")
    row = F.min_by(F.struct(order, "records", "retrieved_at"), F.col(order)).alias("r")
    return usable.groupBy(run, "event_id").agg(row).select(run, "event_id", "r.*")


def append_new(journal: DataFrame, events: DataFrame, run: str = "run_id") -> DataFrame:
    """The events whose ids a journal doesn't have yet, each once."""
    known = journal.select(run, "event_id").distinct()
    return events.dropDuplicates([run, "event_id"]).join(known, [run, "event_id"], "left_anti")


def page_event(cases: Column, raw_positions: Column, page: Column, reached_end: Column, at: Column) -> Column:
    """The journal's event of one page: its cases with the positions that the provider gave, else counted from 1."""
    records = F.transform(cases, lambda c, i: F.struct(F.coalesce(F.get(raw_positions, i), (i + 1).cast("int")).alias("position"), c.alias("case")))
    return F.struct(F.lit("page").alias("type"), page.alias("page"), at.alias("retrieved_at"), reached_end.alias("reached_end"), records.alias("records"))


def download_event(case_key: Column, download: Column, at: Column) -> Column:
    return F.struct(F.lit("download").alias("type"), at.alias("recorded_at"), case_key.alias("case_key"), download.alias("download"))


def observations(events: DataFrame, run: str = "run_id", latest_only: bool = True) -> DataFrame:
    """run, result_ref, page, position, retrieved_at, case: one row per record of the page events (event_no from 0, page, retrieved_at, records, raw: the event as written).

    References stay what they are when a page is captured again. Order by page and position.
    """
    pages = events.where("type = 'page'")
    if latest_only:
        pages = latest(pages, [run, "page"], F.col("event_no"), ["event_no", "retrieved_at", "records", "raw"])
    rows = pages.select(run, "page", "event_no", "retrieved_at", "raw", F.posexplode("records").alias("record_no", "record"))
    ref = result_ref(F.col(run), F.col("event_no"), F.col("record_no"), F.col("raw"))
    return rows.select(run, ref.alias("result_ref"), "page", F.col("record.position").alias("position"), "retrieved_at", F.col("record.case").alias("case"))


def compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change: 'new' or 'no_longer_observed'."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("no_longer_observed")))


def completed_pages(df: DataFrame, run: str, page: str) -> DataFrame:
    """run, pages (sorted, distinct), resume_page: the first that is missing."""
    pages = df.groupBy(run).agg(F.array_sort(F.collect_set(page)).alias("pages"))
    gap = F.array_min(F.array_except(F.sequence(F.lit(1), F.array_max("pages").cast("int") + 1), F.col("pages").cast("array<int>")))
    return pages.withColumn("resume_page", gap)


def result_ref(run: Column, event: Column, record: Column, payload: Column) -> Column:
    """A stable reference of one observation: of its run, the places of its event and record, and the event itself (JSON, as written)."""
    quoted = F.to_json(F.array(run.cast("string")))
    body = F.concat(F.substring(quoted, 1, F.length(quoted) - 1), F.lit(","), event.cast("string"), F.lit(","), record.cast("string"), F.lit(","), payload, F.lit("]"))
    return F.concat(F.lit("r_"), F.substring(F.sha2(body, 256), 1, 32))


def list_runs(runs: DataFrame, query: str | None = None, case_key: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Runs (run_id, created_at, request, downloads) by substring of their request and by a case among their downloads or latest pages (seen: run_id, case_key)."""
    if query:
        runs = runs.where(F.contains(F.lower("request"), F.lit(query.lower())))
    if case_key:
        held = F.map_contains_key("downloads", F.lit(case_key))
        if seen is not None:
            marked = seen.where(F.col("case_key") == case_key).select("run_id").distinct().withColumn("_seen", F.lit(True))
            runs = runs.join(marked, "run_id", "left")
            held = F.coalesce(held, F.lit(False)) | F.col("_seen").isNotNull()
        runs = runs.where(held).drop("_seen")
    return runs.orderBy(F.desc("created_at"), F.desc("run_id"))


def list_collections(collections: DataFrame, case_key: str | None = None, citing: bool = False) -> DataFrame:
    """Collections (run_id, created_at, seed_key, results: array of case keys) of a seed, or also those with it among their results, newest first."""
    if case_key:
        mine = F.col("seed_key") == case_key
        collections = collections.where(mine | F.array_contains("results", case_key) if citing else mine)
    return collections.orderBy(F.desc("created_at"), F.desc("run_id"))


def start_run(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """requests (fingerprint, run_id, refresh_of) with started: new, resumed or refreshed, or why not: both, unknown_run, changed_request."""
    known = runs.select(F.col("run_id"), F.col("fingerprint").alias("_saved"))
    out = requests.join(known, "run_id", "left").join(runs.select(F.col("run_id").alias("refresh_of"), F.lit(True).alias("_base")), "refresh_of", "left")
    state = (
        F.when(F.col("run_id").isNotNull() & F.col("refresh_of").isNotNull(), "both")
        .when(F.col("run_id").isNotNull() & F.col("_saved").isNull(), "unknown_run")
        .when(F.col("run_id").isNotNull() & (F.col("_saved") != F.col("fingerprint")), "changed_request")
        .when(F.col("run_id").isNotNull(), "resumed")
        .when(F.col("refresh_of").isNotNull() & F.col("_base").isNull(), "unknown_run")
        .when(F.col("refresh_of").isNotNull(), "refreshed")
        .otherwise("new")
    )
    return out.withColumn("started", state).drop("_saved", "_base")


# Collections ------------------------------------------------------------------------------------------------------

PARTITION = "struct<id:string,court:string,year_lo:int,year_hi:int,next_offset:int,pages_completed:int>"
STATE = f"struct<kind:string,status:string,cited_by_id:string,next_page:int,pages_completed:int,raw_results:int,partitions:array<{PARTITION}>,completed_partitions:int,partitioned:boolean,expanded_partitions:array<string>,error:string>"


def _state(**given: Column) -> Column:
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(f"s {STATE}")["s"].dataType.fields
    return F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def new_state(provider: str, cited_by: Column, court: Column, low: Column, high: Column) -> Column:
    """The state in which a provider's collection begins: running if the seed has an id by which to ask, else failed."""
    status = F.when(cited_by.isNotNull(), "running").otherwise("failed")
    root = F.array(F.struct(F.lit("root").alias("id"), court.cast("string").alias("court"), low.cast("int").alias("year_lo"), high.cast("int").alias("year_hi"), F.lit(0).alias("next_offset"), F.lit(0).alias("pages_completed")))
    none = F.array().cast(f"array<{PARTITION}>")
    return _state(
        kind=F.lit(provider), status=status, cited_by_id=cited_by, next_page=F.lit(1), pages_completed=F.lit(0), raw_results=F.lit(0),
        partitions=F.when(cited_by.isNotNull(), root.cast(f"array<{PARTITION}>")).otherwise(none) if provider == "scholar" else none,
        completed_partitions=F.lit(0), partitioned=F.lit(False), expanded_partitions=F.array().cast("array<string>"), error=F.when(cited_by.isNull(), f"the seed has no id of {provider}"),
    )


def effective_years(p: Column, filters: Column, last: int) -> Column:
    """struct(low, high): the years of a partition that the filters (year_from, year_to, filed_after, filed_before) leave."""
    year = lambda c: F.substring(c, 1, 4).cast("int")
    low = F.greatest(F.coalesce(p["year_lo"], F.lit(FIRST_YEAR)), F.coalesce(filters["year_from"], F.lit(FIRST_YEAR)), F.coalesce(year(filters["filed_after"]), F.lit(FIRST_YEAR)))
    high = F.least(F.coalesce(p["year_hi"], F.lit(last)), F.coalesce(filters["year_to"], F.lit(last)), F.coalesce(year(filters["filed_before"]), F.lit(last)))
    return F.struct(low.alias("low"), high.alias("high"))


def children(p: Column, years: Column, courts: tuple[str, ...]) -> Column:
    """The partitions that one is split into: by court if it has none, else its years in two; null if it can't be split."""
    from lexloom.functions.text import slug

    part = lambda name, court, lo, hi: F.struct(name.alias("id"), court.alias("court"), lo.cast("int").alias("year_lo"), hi.cast("int").alias("year_hi"), F.lit(0).alias("next_offset"), F.lit(0).alias("pages_completed"))
    by_court = F.array(*(part(F.concat(p["id"], F.lit(f"/court-{n}-"), slug(F.lit(c), folded=True)), F.lit(c), years["low"], years["high"]) for n, c in enumerate(courts, 1)))
    middle = F.floor((years["low"] + years["high"]) / 2).cast("int")
    half = lambda lo, hi: part(F.concat(p["id"], F.lit("/"), lo.cast("string"), F.lit("-"), hi.cast("string")), p["court"], lo, hi)
    return F.when(F.coalesce(p["court"], F.lit("")) == "", by_court).when(years["low"] < years["high"], F.array(half(years["low"], middle), half(middle + 1, years["high"])))


def courtlistener_step(s: Column, results: Column, reached_end: Column) -> Column:
    """The state after one page: the next page, or exhausted at the end or a page that isn't full."""
    ended = F.coalesce(reached_end, results < COURTLISTENER_PAGE)
    new = s.withField("raw_results", s["raw_results"] + results).withField("pages_completed", s["pages_completed"] + 1).withField("next_page", s["next_page"] + 1)
    return new.withField("status", F.when(ended, "exhausted").otherwise(s["status"]))


def finished(s: Column) -> Column:
    """A Scholar state without partitions left: exhausted, but blocked if it was split, as parts don't prove the whole."""
    done = F.size(s["partitions"]) == 0
    status = F.when(~done, s["status"]).when(s["partitioned"], "blocked").otherwise("exhausted")
    error = F.when(~done, s["error"]).when(s["partitioned"], "the parts of a split collection don't prove that it is complete")
    return s.withField("status", status).withField("error", error)


def scholar_step(s: Column, filters: Column, results: Column, reached_end: Column, courts: tuple[str, ...], last: int) -> Column:
    """The state after one page of its first partition: the next page, the next partition, or at the provider's last offset its parts."""
    p, rest = F.get(s["partitions"], F.lit(0)), F.slice(s["partitions"], 2, F.greatest(F.size(s["partitions"]), F.lit(1)))
    years = effective_years(p, filters, last)
    empty = years["low"] > years["high"]
    shifted = s.withField("partitions", rest).withField("completed_partitions", s["completed_partitions"] + 1)
    capped = (p["next_offset"] >= LAST_OFFSET) & (results >= SCHOLAR_PAGE)
    ended = ~capped & F.coalesce(reached_end, results < SCHOLAR_PAGE)
    counted = lambda x: x.withField("raw_results", s["raw_results"] + results).withField("pages_completed", s["pages_completed"] + 1)
    seen = p.withField("pages_completed", p["pages_completed"] + 1)
    onward = s.withField("partitions", F.concat(F.array(seen.withField("next_offset", p["next_offset"] + SCHOLAR_PAGE)), rest))
    parts = children(p, years, courts)
    split = s.withField("partitions", F.concat(parts, rest)).withField("partitioned", F.lit(True)).withField("expanded_partitions", F.concat(s["expanded_partitions"], F.array(p["id"])))
    stuck = s.withField("partitions", F.concat(F.array(seen), rest)).withField("status", F.lit("blocked")).withField("error", F.concat(F.lit("partition can't be split: "), p["id"]))
    return (
        F.when(F.size(s["partitions"]) == 0, finished(s))
        .when(empty, finished(shifted))
        .when(ended, counted(finished(shifted)))
        .when(p["next_offset"] < LAST_OFFSET, counted(onward))
        .when(parts.isNull(), counted(stuck))
        .otherwise(counted(split))
    )


def public_state(s: Column) -> Column:
    """What is told of a provider's state."""
    over = s["status"].isin("exhausted", "capped")
    scholar = s["kind"] == "scholar"
    return F.struct(
        s["status"].alias("status"), s["pages_completed"].alias("pages_completed"), s["raw_results"].alias("raw_results"), F.when(~scholar & ~over, s["next_page"]).alias("next_page"),
        F.when(scholar, s["completed_partitions"]).alias("completed_partitions"), F.when(scholar, F.size(s["partitions"])).alias("pending_partitions"), F.when(scholar, F.get(s["partitions"], F.lit(0))).alias("next_partition"),
        F.when(scholar, s["partitioned"]).alias("partitioned"), F.when(scholar, F.size(s["expanded_partitions"])).alias("expanded_partitions"), F.when(scholar, ~s["partitioned"] & (s["status"] == "exhausted")).alias("coverage_proven"), s["error"].alias("error"),
    )


def next_provider(states: Column, order: tuple[str, ...]) -> Column:
    """The first provider, in order, that still runs. states: a map of providers to states' names."""
    return F.coalesce(*(F.when(F.try_element_at(states, F.lit(p)) == "running", p) for p in order), F.lit(None).cast("string"))


def split_years(df: DataFrame, low: str, high: str) -> DataFrame:
    """Partitions bisected at the middle year into two children; a single year can't be split and has none."""
    middle = F.floor((F.col(low) + F.col(high)) / 2).cast("int")
    pair = F.array(F.struct(F.lit(0).alias("child"), F.col(low).cast("int").alias("lo"), middle.alias("hi")), F.struct(F.lit(1).alias("child"), (middle + 1).alias("lo"), F.col(high).cast("int").alias("hi")))
    return df.where(F.col(low) < F.col(high)).select("*", F.explode(pair).alias("c")).select(*df.columns, "c.*")


def completeness(df: DataFrame, by: str, state: str, stopped: Column | None = None) -> DataFrame:
    """complete if all are exhausted; paused if the run was stopped or any is running or paused; else incomplete. A provider without a state isn't exhausted."""
    done = F.every(F.coalesce(F.col(state) == "exhausted", F.lit(False)))
    going = F.some(F.coalesce(F.col(state).isin("running", "paused"), F.lit(False)) | (stopped if stopped is not None else F.lit(False)))
    return df.groupBy(by).agg(F.when(done, "complete").when(going, "paused").otherwise("incomplete").alias("status"))


def run_status(stop_reason: Column, failed_downloads: Column, failed_derivatives: Column) -> Column:
    """Of a search: stopped, partial_failure or completed."""
    return F.when(stop_reason.isNotNull(), "stopped").when((failed_downloads > 0) | (failed_derivatives > 0), "partial_failure").otherwise("completed")


def collection_status(enumeration: Column, interrupted: Column, failed: Column) -> Column:
    """Of a collection: paused while it can go on or was interrupted with downloads to come, incomplete, partial_failure, or completed."""
    return F.when(enumeration.isin("paused", "running") | interrupted, "paused").when(enumeration == "incomplete", "incomplete").when(failed > 0, "partial_failure").otherwise("completed")


def totals(states: DataFrame, records: DataFrame, run: str = "run_id") -> DataFrame:
    """run, raw_results (over all providers), record_count."""
    raw = states.groupBy(run).agg(F.sum("raw_results").alias("raw_results"))
    n = records.groupBy(run).agg(F.count("*").alias("record_count"))
    return raw.join(n, run, "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)))


def page_reached_end(page: Column, size: Column, has_next: Column, last_page: int = 50, full: int = 20) -> Column:
    """The end of a result list: no next page, except that a full page at the cap proves nothing."""
    return ~has_next & ~((page >= last_page) & (size >= full))


def download_status(limit: Column, selected: Column, outcome: Column) -> Column:
    """Of a search's row: not_requested, not_selected, downloaded, failed or not_attempted."""
    return F.when(limit == 0, "not_requested").when(~selected, "not_selected").when(outcome.isin("downloaded", "existing"), "downloaded").when(outcome == "failed", "failed").otherwise("not_attempted")


def unfinished(downloads: DataFrame, key: str = "result_ref") -> DataFrame:
    """What is to be tried again."""
    return downloads.where(~F.coalesce(F.col("status").isin("downloaded", "existing"), F.lit(False))).select(key).distinct()


def prune_selections(selections: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Selections (handle, created_at, used_at) that can still be claimed: not used, and not older than some days."""
    return selections.where(F.col("used_at").isNull() & (F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")))


def claim(selections: DataFrame, claims: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """claims (handle, link, claimed_at) with outcome: claimed for the first one of a handle that may be, else used, expired, unknown or not_offered."""
    s = selections.select("handle", F.col("created_at").alias("_made"), F.col("used_at").alias("_used"), F.col("links").alias("_links"))
    first = F.row_number().over(Window.partitionBy("handle").orderBy("claimed_at", "link")) == 1
    out = claims.withColumn("_first", first).join(s, "handle", "left")
    state = (
        F.when(F.col("_made").isNull(), "unknown")
        .when(F.col("_used").isNotNull() | ~F.col("_first"), "used")
        .when(F.col("_made") < now - F.expr(f"INTERVAL {days} DAYS"), "expired")
        .when(~F.array_contains("_links", F.col("link")), "not_offered")
        .otherwise("claimed")
    )
    return out.withColumn("outcome", state).drop("_first", "_made", "_used", "_links")


def resolve_selected(refs: DataFrame, observed: DataFrame, library: DataFrame) -> DataFrame:
    """refs (result_ref) with case_key, provider, provider_id and action: invalid for refs that no run has, reuse where the library has a valid
    copy of that very opinion (provider, provider_id, integrity), duplicate for a further ref of the same opinion, else acquire. None stands in for another."""
    rows = refs.dropDuplicates(["result_ref"]).join(observed.select("result_ref", "case_key", "provider", "provider_id"), "result_ref", "left")
    have = library.where("integrity = 'valid'").select("provider", "provider_id").distinct().withColumn("_have", F.lit(True))
    one = F.row_number().over(Window.partitionBy("provider", "provider_id").orderBy("result_ref")) == 1
    out = rows.withColumn("_one", one).join(have, ["provider", "provider_id"], "left")
    action = F.when(F.col("case_key").isNull(), "invalid").when(F.col("_have"), "reuse").when(F.col("provider_id").isNotNull() & ~F.col("_one"), "duplicate").otherwise("acquire")
    return out.withColumn("action", action).select("result_ref", "case_key", "provider", "provider_id", "action")


def derivative_action(source: DataFrame, derived: DataFrame, key: str = "case_key") -> DataFrame:
    """source (key, html_sha256) with action: make where there is none, reuse where the derivative (source_sha256, body_sha256, recorded_body_sha256) is
    of the same source and unedited, refuse where its body was edited, remake where its source changed."""
    out = source.join(derived.select(key, "source_sha256", "body_sha256", "recorded_body_sha256"), key, "left")
    edited = F.col("body_sha256") != F.col("recorded_body_sha256")
    return out.withColumn("action", F.when(F.col("source_sha256").isNull(), "make").when(edited, "refuse").when(F.col("source_sha256") == F.col("html_sha256"), "reuse").otherwise("remake"))


# What a tool's last state is shown as.
TERMINAL = {"completed": "complete", "complete": "complete", "partial_failure": "warning", "incomplete": "warning", "paused": "paused", "stopped": "paused", "aborted": "paused", "failed": "error"}


def tool_status(outcome: Column, failed: Column) -> Column:
    """A call's last state: error if it threw, else by its outcome's status."""
    table = F.create_map(*[F.lit(x) for kv in TERMINAL.items() for x in kv])
    return F.when(failed, "error").otherwise(F.coalesce(F.try_element_at(table, outcome), F.lit("complete")))
