"""Queries over runs, collections, requests, responses, reports and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import citations as C
from lexloom.functions import jurisdictions as Z
from lexloom.functions import text as T
from lexloom.functions import urls as U
from lexloom.operators import documents as D
from lexloom.operators import entities as E
from lexloom.operators import journal as J
from lexloom.operators import models as P
from lexloom.operators import reports as B
from lexloom.operators import requests as R
from lexloom.operators import structured as S
from lexloom.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _pick(k, *values):
    """The value at place k."""
    return F.element_at(F.array(*(v if not isinstance(v, (str, int, type(None))) else F.lit(v) for v in values)), (k + 1).cast("int"))


# Names and addresses ----------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [(p_size + 1) || ' F.3d ' || p_partkey, '7 U.S. 9'] WHEN 1 THEN [] ELSE [(p_size + 1) || ' F.3d ' || p_partkey] END AS citations,
CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_type || ' Ct.' END AS court, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE '1999' END AS year FROM part""")
def scholar_metadata(t):
    k, cite = F.col("p_partkey") % 3, F.concat(F.col("p_size") + 1, F.lit(" F.3d "), F.col("p_partkey"))
    line = F.when(k == 0, F.concat(cite, F.lit(", junk, 7 U.S. 9  - "), "p_type", F.lit(" Ct., 1999 rev."))).when(k == 1, F.concat("p_type", F.lit(" Ct. 1999"))).otherwise(F.concat(cite, F.lit(", more")))
    return t("part").select("p_partkey", C.scholar_meta(line).alias("m")).select("p_partkey", "m.citations", "m.court", "m.year")


@query("SELECT p_partkey, p_name || ', ' || p_brand AS name, (p_size + 1) || ' F.3d 9' AS citation, p_type AS court, '1999' AS year FROM part")
def opinion_titles(t):
    title = F.concat("p_name", F.lit(", "), "p_brand", F.lit(", "), F.col("p_size") + 1, F.lit(" F.3d 9 - "), "p_type", F.lit(" 1999"))
    return t("part").select("p_partkey", C.opinion_title(title).alias("m")).select("p_partkey", "m.*")


@query("SELECT p_partkey, 'Citations for ' || left(rtrim(replace(p_name || '- ' || p_brand || '-x', '#', '#'), '. '), 80) AS folder, 'Cases/' || p_brand_key AS place FROM (SELECT *, lower(replace(p_brand, '#', '-')) || '-' || p_partkey AS p_brand_key FROM part)")
def folder_names(t):
    key = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("-"), F.col("p_partkey"))
    return t("part").select("p_partkey", T.folder_name(F.concat("p_name", F.lit(":/ "), "p_brand", F.lit("?x. ."))).alias("folder"), U.case_folder("Cases/", key).alias("place"))


@query("""SELECT o_orderkey, '/scholar?hl=en&as_sdt=' || CASE o_orderkey % 3 WHEN 0 THEN '2006' ELSE '4%2C33' END || '&q=duty+of+care+' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '&as_ylo=' || year(o_orderdate) ELSE '' END || '&num=20' AS scholar,
CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE '/?q=' || CASE o_orderkey % 3 WHEN 0 THEN 'duty' ELSE 'cites%3A%28' || o_custkey || '%29' END || '&type=o&court_ca9=on&stat_Published=on&stat_Errata=on&filed_after=' || replace(strftime(o_orderdate, '%m/%d/%Y'), '/', '%2F') || '&page=2' END AS court FROM orders""")
def search_addresses(t):
    k, year = F.col("o_orderkey") % 3, F.year("o_orderdate")
    none = F.lit(None).cast("string")
    scholar = U.scholar_search_path(F.concat(F.lit("duty of care "), "o_custkey"), none, F.when(k != 0, "33"), F.when(F.col("o_orderkey") % 2 == 0, year), F.lit(None))
    statuses = F.when(k == 2, F.array(F.lit("odd"))).otherwise(F.array(F.lit(" Published"), F.lit("errata")))
    court = U.courtlistener_search_path(F.lit(" duty "), F.when(k == 1, F.col("o_custkey").cast("string")), F.array(F.lit("ca9")), statuses, F.date_format("o_orderdate", "yyyy-MM-dd"), none, F.lit(2))
    return t("orders").select("o_orderkey", scholar.alias("scholar"), court.alias("court"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'new york,ed texas' WHEN 1 THEN 'us supreme court,9th circuit court of appeals' WHEN 2 THEN NULL WHEN 3 THEN '!Atlantis' ELSE 'tax court' END AS scholar,
CASE n_nationkey % 5 WHEN 0 THEN 'ny,nyappdiv,nyappterm,nyhospcommn,txed' WHEN 1 THEN 'scotus,ca9' WHEN 2 THEN NULL WHEN 3 THEN 'atlantis' ELSE '!Tax Court' END AS court FROM nation""")
def court_filters(t):
    spec = _pick(F.col("n_nationkey") % 5, "ny, Eastern District of Texas, NY", "SCOTUS, Ninth Cir.", " , ", "Atlantis", "Tax Court")
    rows = t("nation").select("n_nationkey", spec.alias("s"))
    return rows.select("n_nationkey", Z.provider_filter(F.col("s"), "scholar").alias("scholar"), Z.provider_filter(F.col("s"), "courtlistener").alias("court"))


@query("SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN ['scotus', 'ca9', 'nysd'] WHEN 1 THEN NULL ELSE [] END AS ids FROM region")
def court_ids(t):
    spec = _pick(F.col("r_regionkey") % 3, "US Supreme Court, ca9, nysd , ca9", "9th court of x", None)
    return t("region").select("r_regionkey", Z.court_ids(spec).alias("ids"))


# Requests ---------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN [] WHEN 1 THEN ['year_order', 'scholar_years'] WHEN 2 THEN ['filed_after'] WHEN 3 THEN ['scholar_filed_after'] WHEN 4 THEN ['justia_query'] WHEN 5 THEN ['justia_courts', 'justia_dates'] WHEN 6 THEN ['page'] ELSE ['scholar_years'] END AS errors FROM events""")
def provider_parameters(t):
    k = F.col("event_id") % 8
    r = F.struct(
        F.when(k != 4, "duty").alias("query"), F.lit(None).cast("string").alias("cites"), F.when(k == 5, "ny").alias("courts"), F.when(k == 1, 2000).when(k == 7, 2001).cast("int").alias("year_from"), F.when(k == 1, 1990).when(k == 5, 1990).cast("int").alias("year_to"),
        F.when(k == 2, "2001-02-30").when(k == 3, "2001-02-03").alias("filed_after"), F.when(k == 7, "2000-12-31").alias("filed_before"), F.when(k == 6, 0).otherwise(1).alias("page"),
    )
    by = F.when(k.isin(4, 5), "justia").when(k == 2, "courtlistener").otherwise("scholar")
    return t("events").select("event_id", R.parameter_errors(by, r).alias("errors"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 1 THEN ['save_path'] WHEN 2 THEN ['max_pages', 'download_limit'] WHEN 4 THEN ['providers'] WHEN 5 THEN ['courts', 'year_to'] ELSE [] END AS errors, event_id % 6 = 2 AS lower, event_id % 6 = 3 AS higher FROM events""")
def resume_requests(t):
    k = F.col("event_id") % 6
    none = F.lit(None)
    new = F.struct(
        F.when(k == 1, "x").alias("save_path"), F.when(k == 4, F.array(F.lit("scholar"))).alias("providers"), F.when(k == 2, 3).when(k == 3, -1).cast("int").alias("max_pages"), F.when(k == 2, 4).when(k == 3, 9).cast("int").alias("download_limit"),
        F.when(k == 5, "ny").alias("courts"), none.cast("int").alias("year_from"), F.when(k == 5, 1999).cast("int").alias("year_to"), none.cast("string").alias("filed_after"), none.cast("string").alias("filed_before"),
    )
    old = F.struct(
        F.lit("y").alias("save_path"), F.array(F.lit("scholar"), F.lit("courtlistener")).alias("providers"), F.lit(5).alias("max_pages"), F.lit(7).alias("download_limit"), F.lit("tx").alias("courts"), none.cast("int").alias("year_from"), none.cast("int").alias("year_to"),
        none.cast("string").alias("filed_after"), none.cast("string").alias("filed_before"),
    )
    lower, higher = R.limit_is_lower(F.coalesce(new["max_pages"], F.lit(5)), F.lit(5)), R.limit_is_higher(F.coalesce(new["max_pages"], F.lit(5)), F.lit(5))
    return t("events").select("event_id", R.resume_errors(new, old).alias("errors"), lower.alias("lower"), higher.alias("higher"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN -1 ELSE 3 END::INTEGER AS max_pages, CASE event_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 2001 ELSE 8 END::INTEGER AS download_limit,
CASE event_id % 4 WHEN 2 THEN ['download_limit'] WHEN 3 THEN ['action'] ELSE [] END AS errors FROM events""")
def collection_limits(t):
    k = F.col("event_id") % 4
    limits = R.collection_limits(_pick(k, "collect", "resume", "refresh", "delete"), F.when(k == 2, -1).when(k == 3, 3).cast("int"), F.when(k == 2, 2001).when(k == 3, 8).cast("int"), F.lit(9), F.lit(8))
    return t("events").select("event_id", limits.alias("l")).select("event_id", "l.max_pages", "l.download_limit", "l.errors")


# Runs and collections ---------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS run_id FROM orders WHERE contains(lower(o_orderpriority), 'low') AND (o_custkey % 4 = 1 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1))""")
def run_search(t):
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("request"), F.create_map(F.concat(F.lit("c"), F.col("o_custkey") % 4), F.lit("x")).alias("downloads"))
    seen = t("lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("c"), F.col("l_suppkey")).alias("case_key"))
    return J.list_runs(runs, "LOW", "c1", seen).select("run_id")


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_custkey % 7 = 3 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)")
def collection_search(t):
    results = t("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_set(F.concat(F.lit("c"), F.col("l_suppkey"))).alias("results"))
    rows = t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("c"), F.col("o_custkey") % 7).alias("seed_key")).join(results, "run_id", "left")
    return J.list_collections(rows, "c3", citing=True).select("run_id")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'resumed' WHEN 2 THEN 'changed_request' WHEN 3 THEN 'both' WHEN 4 THEN 'refreshed' ELSE 'unknown_run' END AS started FROM events""")
def run_starts(t):
    k = F.col("event_id") % 6
    runs = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("run_id"), F.lit("f").alias("fingerprint"))
    asked = t("events").select("event_id", F.when(k == 2, "g").otherwise("f").alias("fingerprint"), F.when(k.isin(1, 2, 3), "r1").when(k == 5, "r99").alias("run_id"), F.when(k.isin(3, 4), "r2").alias("refresh_of"))
    return J.start_run(asked, runs).select("event_id", "started")


@query("""WITH e AS (SELECT user_id AS run, event_id % 5 AS page, event_id, value, props FROM events), l AS (SELECT run, page, max(event_id) AS event_no FROM e GROUP BY ALL)
SELECT l.run, 'r_' || left(sha256('["' || l.run || '",' || l.event_no || ',' || n || ',' || e.props || ']'), 32) AS result_ref, l.page, (n + 1)::INTEGER AS position, e.event_id + n AS "case" FROM l JOIN e ON e.event_id = l.event_no, (VALUES (0), (1)) v(n)""")
def run_observations(t):
    k = F.col("event_id")
    records = F.array(*(F.struct(F.lit(n + 1).alias("position"), (k + n).alias("case")) for n in (0, 1)))
    events = t("events").select(F.col("user_id").alias("run_id"), F.lit("page").alias("type"), (k % 5).alias("page"), k.alias("event_no"), F.col("value").alias("retrieved_at"), records.alias("records"), F.col("props").alias("raw"))
    return J.observations(events).select(F.col("run_id").alias("run"), "result_ref", "page", "position", "case")


@query("SELECT user_id AS run_id, event_id FROM events WHERE event_type <> 'error' AND event_id % 3 <> 0")
def journal_append(t):
    rows = t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("event_id"), "event_type")
    return J.append_new(rows.where("event_id % 3 = 0"), rows.where("event_type <> 'error'").unionByName(rows.where("event_type <> 'error'"))).select("run_id", "event_id")


@query("""SELECT event_id AS result_ref, CASE WHEN event_id % 5 = 0 THEN 'invalid' WHEN event_id % 2 = 0 THEN 'reuse' WHEN event_id % 1000 >= 500 AND (event_id - 500) % 5 <> 0 THEN 'duplicate' ELSE 'acquire' END AS action FROM events""")
def selected_downloads(t):
    # an opinion is seen under two refs that are 500 apart; even ones are in the library
    k, opinion = F.col("event_id"), (F.floor(F.col("event_id") / 1000) * 500 + F.col("event_id") % 500).cast("string")
    rows = t("events")
    refs = rows.select(k.alias("result_ref"))
    seen = rows.where(k % 5 != 0).select(k.alias("result_ref"), F.concat(F.lit("c"), opinion).alias("case_key"), F.lit("scholar").alias("provider"), opinion.alias("provider_id"))
    library = rows.where(k % 2 == 0).select(F.lit("scholar").alias("provider"), opinion.alias("provider_id"), F.lit("valid").alias("integrity"))
    library = library.unionByName(rows.select(F.lit("scholar").alias("provider"), opinion.alias("provider_id"), F.lit("changed").alias("integrity")))
    return J.resolve_selected(refs, seen, library).select("result_ref", "action")


@query("""SELECT o_orderkey AS case_key, CASE o_orderkey % 4 WHEN 0 THEN 'make' WHEN 1 THEN 'reuse' WHEN 2 THEN 'refuse' ELSE 'remake' END AS action FROM orders""")
def derivative_actions(t):
    k = F.col("o_orderkey")
    source = t("orders").select(k.alias("case_key"), F.lit("a").alias("html_sha256"))
    derived = t("orders").where(k % 4 != 0).select(k.alias("case_key"), F.when(k % 4 == 3, "b").otherwise("a").alias("source_sha256"), F.when(k % 4 == 2, "edited").otherwise("body").alias("body_sha256"), F.lit("body").alias("recorded_body_sha256"))
    return J.derivative_action(source, derived).select("case_key", "action")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'not_requested' WHEN 1 THEN 'not_selected' WHEN 2 THEN 'downloaded' WHEN 3 THEN 'failed' ELSE 'not_attempted' END AS row_status, CASE WHEN event_id % 3 = 0 THEN 'stopped' WHEN event_id % 3 = 1 THEN 'partial_failure' ELSE 'completed' END AS run_status,
CASE event_id % 4 WHEN 0 THEN 'paused' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'partial_failure' ELSE 'completed' END AS collection_status, CASE event_id % 4 WHEN 0 THEN 'scholar' WHEN 1 THEN 'courtlistener' END AS next FROM events""")
def workflow_states(t):
    k = F.col("event_id")
    row = J.download_status(F.when(k % 5 == 0, 0).otherwise(5), k % 5 != 1, _pick(k % 5, None, None, "existing", "failed", None))
    run = J.run_status(F.when(k % 3 == 0, "deadline"), F.when(k % 3 == 1, 1).otherwise(0), F.lit(0))
    collection = J.collection_status(_pick(k % 4, "running", "incomplete", "complete", "complete"), F.lit(False), F.when(k % 4 == 2, 3).otherwise(0))
    states = F.create_map(F.lit("scholar"), F.when(k % 4 == 0, "running").otherwise("blocked"), F.lit("courtlistener"), F.when(k % 4 < 2, "running").otherwise("exhausted"))
    return t("events").select("event_id", row.alias("row_status"), run.alias("run_status"), collection.alias("collection_status"), J.next_provider(states, ("scholar", "courtlistener")).alias("next"))


@query("SELECT DISTINCT o_orderkey AS result_ref FROM orders WHERE o_orderstatus <> 'F'")
def retry_set(t):
    rows = t("orders").select(F.col("o_orderkey").alias("result_ref"), F.when(F.col("o_orderstatus") == "F", "downloaded").when(F.col("o_orderstatus") == "O", "failed").alias("status"))
    return J.unfinished(rows)


# Sources and candidates -------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ['scholar:1', 'courtlistener:2', 'justia:3'] WHEN p_partkey % 3 = 1 THEN ['courtlistener:2', 'justia:3'] ELSE ['justia:3'] END AS tried, CASE p_partkey % 3 WHEN 0 THEN 'scholar' WHEN 1 THEN 'courtlistener' ELSE 'justia' END AS chosen,
CASE p_partkey % 3 WHEN 0 THEN ['scholar', 'courtlistener'] WHEN 1 THEN ['courtlistener'] ELSE [] END AS citing FROM part""")
def source_choice(t):
    k = F.col("p_partkey") % 3
    one = lambda by, n, cites: F.struct(F.lit(by).alias("provider"), F.lit(n).alias("provider_id"), F.lit(cites).cast("string").alias("cited_by_id"), F.lit("u").alias("url"))
    every = F.array(one("justia", "3", None), one("courtlistener", "2", "77"), one("courtlistener", "2", None), one("scholar", "1", None))
    mine = F.filter(every, lambda s: ~(((k == 1) & (s["provider"] == "scholar")) | ((k == 2) & (s["provider"] != "justia"))))
    rows = t("part").select("p_partkey", mine.alias("s"))
    tried = F.transform(E.source_candidates(F.col("s")), lambda s: F.concat(s["provider"], F.lit(":"), s["provider_id"]))
    return rows.select("p_partkey", tried.alias("tried"), E.choose_source(F.col("s"))["provider"].alias("chosen"), E.citing_providers(F.col("s")).alias("citing"))


@query("SELECT doc_id, left(text, 40) AS head FROM documents WHERE lang LIKE '%e%' AND doc_id % 3 <> 0 AND contains(lower(text), 'the') ORDER BY doc_id")
def library_texts(t):
    rows = t("documents").select(
        F.col("doc_id").cast("string").alias("case_key"), F.lit("").alias("title"), F.array().cast("array<string>").alias("citations"), F.upper("lang").alias("court"), F.lit(None).cast("string").alias("date_filed"), F.lit(None).cast("string").alias("year"), "text",
        F.when(F.col("doc_id") % 3 == 0, "changed").otherwise("valid").alias("integrity"), "doc_id",
    )
    return D.search_library(rows, "The", court="e").select("doc_id", F.substring("text", 1, 40).alias("head"))


@query("""WITH f AS (SELECT n_regionkey, min(n_nationkey) AS first FROM nation GROUP BY 1) SELECT n_nationkey AS number, CASE WHEN n_nationkey > first THEN 'same source as selection ' || first END AS error FROM nation JOIN f USING (n_regionkey)""")
def repeated_selections(t):
    rows = t("nation").select(F.col("n_nationkey").alias("number"), F.col("n_regionkey").cast("string").alias("raw_sha256"))
    return P.reject_duplicates(rows).select("number", "error")


@query("""WITH c AS (SELECT conv_id, max(turn) AS b, count(*) FILTER (role = 'user' AND turn % 4 = 2) AS n FROM conversations GROUP BY 1)
SELECT v.conv_id, v.turn FROM conversations v JOIN c USING (conv_id) WHERE (n = 0 AND (turn = 0 OR turn = b)) OR (n > 0 AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = v.conv_id AND x.role = 'user' AND x.turn % 4 = 2 AND abs(x.turn - v.turn) <= 1))""")
def evidence_source(t):
    v = t("conversations")
    blocks = v.select("conv_id", F.col("turn").alias("block_no"), F.concat(F.lit("P"), F.lpad(F.col("turn").cast("string"), 5, "0")).alias("block_id"), "text")
    cited = v.where("role = 'user' AND turn % 4 = 2").select("conv_id", F.concat(F.lit("P"), F.lpad(F.col("turn").cast("string"), 5, "0")).alias("block_id"))
    return P.evidence_blocks(blocks, cited, "conv_id").select("conv_id", F.col("block_no").alias("turn"))


@query("""WITH p AS (SELECT user_id AS doc_id, (event_id % 6)::INTEGER AS part_no FROM events GROUP BY ALL), r AS (SELECT *, part_no * 3 + 1 AS a, part_no * 3 + 5 AS b FROM p),
w AS (SELECT *, lag(b) OVER v AS pb, lead(a) OVER v AS na, count(*) OVER (PARTITION BY doc_id) AS n FROM r WINDOW v AS (PARTITION BY doc_id ORDER BY part_no))
SELECT doc_id, part_no, n AS total_parts, pb IS NOT NULL AS has_previous, na IS NOT NULL AS has_next, list_filter(range(a, b + 1), lambda x: coalesce(x <= pb, false) OR coalesce(x >= na, false)) AS overlap_blocks FROM w""")
def part_contexts(t):
    p = t("events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 6).cast("int").alias("part_no")).distinct()
    rows = p.withColumn("first_block", F.col("part_no") * 3 + 1).withColumn("last_block", F.col("part_no") * 3 + 5)
    return P.part_context(rows).select("doc_id", "part_no", "total_parts", "has_previous", "has_next", F.array_sort("overlap_blocks").alias("overlap_blocks"))


# Responses --------------------------------------------------------------------------------------------------------


def _statement(confidence="high", blocks='["P00001"]'):
    return f'[{{"text":"x","source_blocks":{blocks},"confidence":"{confidence}"}}]'


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['treatment_status', 'case_identity.empty_text', 'issues.no_blocks'] WHEN 2 THEN ['case_identity.missing', 'holdings.missing', 'key_quotes.speaker'] ELSE ['json'] END AS errors,
CASE doc_id % 4 WHEN 3 THEN [] ELSE ['P00001', 'P00002'] END AS refs FROM labels""")
def summary_validation(t):
    k = F.col("doc_id") % 4
    sections = ",".join(f'"{s}":{_statement()}' for s in S.SECTIONS if s not in ("issues", "holdings"))
    head = lambda status, identity, issues, holdings, speaker: f'{{"schema_version":1,"treatment_status":"{status}",{identity}{sections},"issues":{issues}{holdings},"key_quotes":[{{"text":"q","source_blocks":["P00002"],"speaker":"{speaker}","opinion_part":"m"}}]}}'
    identity = '"case_identity":{"name":"A","citations":[]},'
    holdings = f',"holdings":{_statement()}'
    texts = (
        head("not_checked", identity, _statement(), holdings, "court"), head("checked", identity.replace('"A"', '" "'), _statement(blocks="[]"), holdings, "court"),
        head("not_checked", "", _statement(), "", " "), "none",
    )
    rows = t("labels").select("doc_id", S.case_summary(_pick(k, *texts)).alias("v"))
    return rows.select("doc_id", F.col("v.errors").alias("errors"), F.when(F.col("v.value").isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(S.references(F.col("v.value")))).alias("refs"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['findings.category', 'findings.target', 'required_corrections'] ELSE ['findings.missing', 'disagreements'] END AS errors FROM labels""")
def audit_validation(t):
    one = '{"category":"%s","severity":"high","target":"%s","finding":"f","source_blocks":[],"required_correction":"c"}'
    texts = (
        f'{{"disagreements":[],"findings":[{one % ("reasoning", "t")}],"required_corrections":["x"]}}', f'text {{"disagreements":["d"],"findings":[{one % ("style", " ")}],"required_corrections":[" "]}} text',
        '{"required_corrections":[]}',
    )
    return t("labels").select("doc_id", S.summary_audit(_pick(F.col("doc_id") % 3, *texts))["errors"].alias("errors"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['repeated'] WHEN 2 THEN ['speaker.status', 'proposition_support.explanation'] ELSE ['schema_version', 'findings'] END AS errors FROM labels""")
def findings_validation(t):
    one = '{"occurrence_id":"%s","speaker":%s,"proposition_support":%s}'
    good = '{"status":"%s","explanation":"%s","source_blocks":["P00001"]}'
    texts = (
        f'{{"schema_version":1,"findings":[{one % ("C1", "null", good % ("supports", "e"))},{one % ("C2", good % ("verified", "e"), "null")}]}}', f'{{"schema_version":1,"findings":[{one % ("C1", "null", "null")},{one % (" C1", "null", "null")}]}}',
        f'{{"schema_version":1,"findings":[{one % ("C1", good % ("supports", "e"), good % ("supports", " "))}]}}', '{"schema_version":2}',
    )
    return t("labels").select("doc_id", S.authority_findings(_pick(F.col("doc_id") % 4, *texts))["errors"].alias("errors"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['sha256', 'parentArtifactIds', 'reviewStatus'] ELSE ['artifactId', 'createdAt', 'createdBy'] END AS artifact, CASE doc_id % 2 WHEN 0 THEN [] ELSE ['matterId', 'status'] END AS matter FROM labels""")
def record_validation(t):
    k = F.col("doc_id")
    body = lambda i, sha, parents, at, by, review: f'{{"schemaVersion":1,"artifactId":"{i}","matterId":"m","artifactType":"x","path":"p","sha256":"{sha}","parentArtifactIds":{parents},"createdAt":"{at}"{by},"reviewStatus":"{review}"}}'
    moment, by = "2024-01-02T03:04:05Z", ',"createdBy":{"tool":"t"}'
    texts = (body("a", "0" * 64, '["b","c"]', moment, by, "approved"), body("a", "0" * 63, '["b","b"]', moment, by, "odd"), body("", "a" * 64, "[]", "yesterday", "", "rejected"))
    matter = F.when(k % 2 == 0, f'{{"schemaVersion":1,"matterId":"a-1","status":"active","createdAt":"{moment}","updatedAt":"{moment}"}}').otherwise(f'{{"schemaVersion":1,"matterId":"-a","status":"open","createdAt":"{moment}","updatedAt":"{moment}"}}')
    return t("labels").select(k, S.artifact_errors(F.from_json(_pick(k % 3, *texts), S.ARTIFACT)).alias("artifact"), S.matter_errors(F.from_json(matter, S.MATTER)).alias("matter"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS kept, CASE WHEN doc_id % 2 = 0 THEN ['no issues', 'no disposition'] ELSE ['1 quotations not found in their blocks were dropped', 'no issues', 'no disposition'] END AS warnings FROM labels")
def finished_quotes(t):
    k = F.col("doc_id")
    text = F.concat(F.lit('{"key_quotes":[{"text":"'), F.when(k % 2 == 0, "of  care").otherwise("of caring"), F.lit('","source_blocks":["P00001","P00002"],"speaker":"s","opinion_part":"o"}],"holdings":' + _statement() + "}"))
    v = F.from_json(text, S.SUMMARY)
    blocks = F.create_map(F.lit("P00001"), F.lit("the duty of"), F.lit("P00002"), F.lit("care is owed"))
    kept = S.supported_quotes(v["key_quotes"], blocks)
    return t("labels").select(k, F.size(kept).alias("kept"), S.summary_warnings(v, kept).alias("warnings"))


# Reports ----------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT doc_id % 20 AS d, doc_id, CASE WHEN toxic = 1 THEN 'issue_found' WHEN quality = 0 THEN 'manual_review_required' ELSE 'verified' END AS o, CASE WHEN doc_id % 3 = 0 THEN 'statute' ELSE 'case' END AS a FROM labels)
SELECT d, count(*) AS occurrences, count(*) FILTER (a = 'case') AS case_occurrences, count(*) FILTER (a <> 'case') AS unsupported_occurrences, count(*) FILTER (o = 'verified') AS verified, 0::BIGINT AS qualified, count(*) FILTER (o = 'issue_found') AS issues, count(*) FILTER (o = 'manual_review_required') AS manual_review, 0::BIGINT AS not_checked FROM s GROUP BY 1""")
def report_counts(t):
    state = F.when(F.col("toxic") == 1, "issue_found").when(F.col("quality") == 0, "manual_review_required").otherwise("verified")
    rows = t("labels").select((F.col("doc_id") % 20).alias("d"), state.alias("overall_status"), F.when(F.col("doc_id") % 3 == 0, "statute").otherwise("case").alias("authority_type"))
    return B.verification_counts(rows, "d")


@query(r"""SELECT p_size, 'Cases (' || count(*) || '):' || chr(10) || chr(10) || string_agg(p_partkey || '. **' || p_name || '**' || chr(10) || '   Citations: 1 U.S. ' || p_partkey || chr(10) || '   Case key: k' || p_partkey || chr(10) || '   ' || p_type || ' · 1999' || chr(10) || '   Providers: scholar' || chr(10) || '   scholar: https://x/' || p_partkey || chr(10) || '   No snippet.', chr(10) || chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1""")
def case_lists(t):
    none = F.lit(None).cast("string")
    source = F.struct(F.lit("scholar").alias("provider"), F.concat(F.lit("https://x/"), F.col("p_partkey")).alias("url"))
    record = F.struct(F.col("p_name").alias("title"), F.array(F.concat(F.lit("1 U.S. "), F.col("p_partkey"))).alias("citations"), F.concat(F.lit("k"), F.col("p_partkey")).alias("canonical_key"), F.col("p_type").alias("court"), none.alias("date_filed"), F.lit("1999").alias("year"), F.array(source).alias("sources"), none.alias("snippet"))
    return B.case_list(t("part").select("p_size", "p_partkey", record.alias("r")), "p_size", "p_partkey", "r")


@query(r"""SELECT p_size, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Size &lt;' || p_size || '&gt;</title></head><body><h1>Size &lt;' || p_size || '&gt;</h1>' || string_agg('<article><h2>' || p_partkey || '. ' || p_name || ' &amp; Co</h2><p>' || p_type || '</p><p><a href="https://x/?a=1&amp;b=2">scholar</a></p><p>' ||
CASE p_partkey % 4 WHEN 0 THEN 'Not selected.' WHEN 1 THEN 'Saved: <code>a&lt;b</code>' WHEN 2 THEN 'Failed: &quot;no&quot;' ELSE 'Pending.' END || '</p></article>', chr(10) ORDER BY p_partkey) || '</body></html>' AS html FROM part GROUP BY 1""")
def html_index(t):
    k, none = F.col("p_partkey") % 4, F.lit(None).cast("string")
    source = F.array(F.struct(F.lit("scholar").alias("provider"), F.lit("https://x/?a=1&b=2").alias("url")))
    record = F.struct(F.concat("p_name", F.lit(" & Co")).alias("title"), F.array().cast("array<string>").alias("citations"), F.col("p_type").alias("court"), none.alias("date_filed"), none.alias("year"), source.alias("sources"), none.alias("snippet"))
    entry = B.index_entry(F.col("p_partkey"), record, k != 0, F.when(k == 1, "a<b"), F.when(k == 2, '"no"'))
    rows = t("part").select("p_size", F.concat(F.lit("Size <"), "p_size", F.lit(">")).alias("title"), F.col("p_partkey").alias("number"), entry.alias("entry"))
    return B.index_page(rows, "p_size", "title")


@query(r"""SELECT doc_id, '# A v. B' || chr(10) || chr(10) || '- **Court:** C' || chr(10) || '- **Citations:** 1 U.S. 2' || chr(10) || '- **Case key:** `k`' || chr(10) || chr(10) || '## Executive summary' || chr(10) || chr(10) || '- s [`P00001`, `P00002`]' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' _(medium)_' END AS head FROM labels""")
def summary_markdown(t):
    k = F.col("doc_id")
    text = F.concat(F.lit('{"case_identity":{"name":"A v. B","court":"C","citations":["1 U.S. 2"]},"executive_summary":[{"text":"s","source_blocks":["P00001","P00002"],"confidence":"'), F.when(k % 2 == 0, "high").otherwise("medium"), F.lit('"}]}'))
    source = F.struct(F.lit("p").alias("path"), F.lit("k").alias("case_key"), F.lit("r").alias("raw_sha256"), F.lit("t").alias("text_sha256"))
    whole = B.summary_report(F.from_json(text, S.SUMMARY), source, F.array().cast("array<string>"))
    return t("labels").select(k, F.regexp_extract(whole, r"(?s)^(.*?)\n\n## Procedural", 1).alias("head"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'resume run r' WHEN 1 THEN 'a provider stopped or was blocked; resume run r' WHEN 2 THEN 'resume with more pages, or without a limit' WHEN 3 THEN 'some downloads failed; resume run r' ELSE '' END AS next FROM events""")
def collection_outcomes(t):
    k = F.col("event_id") % 5
    n = F.lit(1)
    o = F.struct(_pick(k, "paused", "incomplete", "incomplete", "partial_failure", "completed").alias("status"), F.lit("s").alias("seed"), F.lit("r").alias("run_id"), n.alias("raw_records"), n.alias("unique"), n.alias("selected"), n.alias("downloaded"), n.alias("failed"), F.when(k == 1, -1).otherwise(5).alias("pages_to_search"))
    return t("events").select("event_id", F.regexp_extract(B.collection_text(o), "(?m)^Next: (.*)$", 1).alias("next"))
