"""Queries over citations and their checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import citations as C
from lexloom.operators import citations as O
from lexloom.operators import documents as D
from lexloom.operators import verification as V
from lexloom.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

# Event types play the kinds of citations, days the roots.
OCC = "SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'full' WHEN 'click' THEN 'short_form' WHEN 'error' THEN 'id' ELSE 'unsupported' END AS kind, CASE WHEN event_type IN ('view', 'click') THEN (event_id % 7)::VARCHAR END AS root FROM events"


def _occ(t):
    kind = F.when(F.col("event_type") == "view", "full").when(F.col("event_type") == "click", "short_form").when(F.col("event_type") == "error", "id").otherwise("unsupported")
    root = F.when(F.col("event_type").isin("view", "click"), (F.col("event_id") % 7).cast("string"))
    return t("events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), kind.alias("kind"), root.alias("root"), F.lit("case").alias("authority_type"))


@query(f"""WITH o AS ({OCC}), l AS (SELECT *, CASE kind WHEN 'short_form' THEN max(CASE WHEN kind = 'full' THEN seq END) OVER (PARTITION BY doc_id, root ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) WHEN 'id' THEN NULL ELSE seq END AS own FROM o),
w AS (SELECT *, CASE WHEN kind <> 'id' THEN {{'a': own}} END AS s FROM l)
SELECT doc_id, seq, CASE WHEN kind = 'id' THEN last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).a ELSE own END AS anchor FROM w""")
def shortform_anchor(t):
    return O.anchors(_occ(t)).select("doc_id", "seq", "anchor")


@query(f"""WITH o AS ({OCC}) SELECT doc_id, seq, CASE kind WHEN 'id' THEN lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) WHEN 'short_form' THEN max(seq) OVER (PARTITION BY doc_id, root ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS linked_seq FROM o""")
def shortform_links(t):
    return O.link_short_forms(_occ(t)).select("doc_id", "seq", "linked_seq")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NOT NULL AND l_partkey % 3 <> 0 THEN 'P' || p_partkey WHEN s_suppkey IS NOT NULL THEN 'S' || s_suppkey END AS authority_id,
CASE WHEN p_partkey IS NOT NULL AND l_partkey % 3 <> 0 THEN 'citation' WHEN s_suppkey IS NOT NULL THEN 'name' END AS located_by,
CASE WHEN (p_partkey IS NOT NULL AND l_partkey % 3 <> 0) OR s_suppkey IS NOT NULL THEN 'verified' ELSE 'not_found' END AS status
FROM c LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def identity_resolve(t):
    cited = t("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("1:us:"), F.col("l_partkey")).alias("citation"), F.concat(F.lit("supplier "), F.col("l_suppkey")).alias("name"))
    by_citation = t("part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("1:us:"), F.col("p_partkey")).alias("citation"), F.concat(F.lit("P"), F.col("p_partkey")).alias("authority_id"))
    by_name = t("supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey")).alias("name"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("authority_id"))
    return V.resolve(cited, by_citation, by_name).select("l_orderkey", "l_linenumber", "authority_id", "located_by", "status")


STATES = "['verified', CASE WHEN quality = 0 THEN 'quote_mismatch' ELSE 'not_applicable' END, CASE WHEN toxic = 1 THEN 'manual_review_required' ELSE 'verified' END, CASE WHEN doc_id % 5 = 0 THEN 'supports_with_qualification' ELSE 'not_checked' END]"
OVERALL = "CASE WHEN quality = 0 THEN 'issue_found' WHEN toxic = 1 THEN 'manual_review_required' WHEN doc_id % 5 = 0 THEN 'verified_with_qualification' ELSE 'verified' END"


def _rolled(t):
    states = F.array(
        F.lit("verified"),
        F.when(F.col("quality") == 0, "quote_mismatch").otherwise("not_applicable"),
        F.when(F.col("toxic") == 1, "manual_review_required").otherwise("verified"),
        F.when(F.col("doc_id") % 5 == 0, "supports_with_qualification").otherwise("not_checked"),
    )
    return t("labels").select("doc_id", V.overall(states).alias("overall_status"))


@query(f"SELECT doc_id, {OVERALL} AS overall_status FROM labels")
def status_rollup(t):
    return _rolled(t)


@query(f"""WITH s AS (SELECT {OVERALL} AS o FROM labels) SELECT count(*) AS total, count_if(o = 'issue_found') AS issue_found, count_if(o = 'manual_review_required') AS manual_review_required,
count_if(o = 'verified_with_qualification') AS verified_with_qualification, count_if(o = 'verified') AS verified, count_if(o = 'not_checked') AS not_checked FROM s""")
def verification_counts(t):
    return V.counts(_rolled(t))


@query(f"SELECT doc_id, (CASE {OVERALL} WHEN 'issue_found' THEN 0 WHEN 'manual_review_required' THEN 1 WHEN 'verified_with_qualification' THEN 2 ELSE 3 END)::INTEGER AS priority FROM labels")
def result_priority(t):
    return _rolled(t).select("doc_id", V.priority(F.col("overall_status")).alias("priority"))


@query("""WITH m AS (SELECT user_id AS doc_id, event_id AS page, ts FROM events WHERE event_type = 'view'), q AS (SELECT user_id AS doc_id, event_id AS q_id, ts FROM events WHERE event_type = 'click')
SELECT q.doc_id, q.q_id, m.page AS observed_page FROM q ASOF LEFT JOIN m ON q.doc_id = m.doc_id AND q.ts >= m.ts""")
def pincite_asof(t):
    e = t("events").select(F.col("user_id").alias("doc_id"), "event_id", "event_type", "ts")
    markers = e.where("event_type = 'view'").select("doc_id", F.col("event_id").alias("page"), F.col("ts").alias("end_at"))
    quotes = e.where("event_type = 'click'").select("doc_id", F.col("event_id").alias("q_id"), F.col("ts").alias("start_at"))
    return V.pincites(markers, quotes).select("doc_id", "q_id", "observed_page")


@query("""WITH c AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND turn % 3 = 1) SELECT v.conv_id, v.turn FROM conversations v WHERE EXISTS (SELECT 1 FROM c WHERE c.conv_id = v.conv_id AND abs(c.turn - v.turn) <= 1)""")
def evidence_neighbors(t):
    v = t("conversations")
    cited = v.where("role = 'assistant' AND turn % 3 = 1").select("conv_id", "turn")
    return V.neighbours(v.select("conv_id", "turn"), cited, "conv_id", "turn")


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS linked_seq, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'statute' ELSE 'statute' END AS authority_type FROM conversations")
def id_previous(t):
    # a chain of id's behind a statute: each is linked to the one before, all are of its type
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))
    occ = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.when(first, "unsupported").otherwise("id").alias("kind"), F.lit(None).cast("string").alias("root"), F.when(first, "statute").otherwise("case").alias("authority_type"))
    out = O.link_short_forms(occ)
    return out.select(F.col("doc_id").alias("conv_id"), F.col("seq").alias("turn"), F.when(F.col("kind") == "id", F.col("linked_seq")).alias("linked_seq"), "authority_type")


@query("""WITH n AS (SELECT *, p_name || ' ' || lower(p_type) AS k, string_split(p_name || ' ' || lower(p_type), ' ') AS ws FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, contains(a.k, b.k) OR contains(b.k, a.k) OR (len(list_intersect(list_distinct(a.ws), b.ws)) >= 2 AND len(list_intersect(list_distinct(a.ws), b.ws)) / greatest(len(list_distinct(a.ws)), len(list_distinct(b.ws))) >= 0.5) AS compatible
FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey""")
def name_compatible(t):
    return V.compatible_pairs(t("part").select("p_brand", "p_partkey", F.concat("p_name", F.lit(" "), "p_type", F.lit(" Co.")).alias("n")), "p_brand", "p_partkey", "n")


@query("SELECT source, arg_min(doc_id, {'a': CASE lang WHEN 'en' THEN 0 ELSE 1 END, 'm': CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END, 'b': lpad(doc_id::VARCHAR, 9, '0')}) AS doc_id FROM documents GROUP BY 1")
def choose_candidate(t):
    rows = t("documents").select("source", "doc_id", (F.col("lang") == "en").alias("explicit"), F.when(F.col("doc_id") % 3 == 0, "x.md").alias("metadata_path"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"))
    return V.choose_candidate(rows, "source", ["doc_id"]).select("source", "doc_id")


OCCURRENCES = """WITH o AS (SELECT o_orderkey AS k, (o_custkey % 900 + 1)::VARCHAR AS v, year(o_orderdate)::VARCHAR AS y FROM orders)
SELECT k AS doc_id, 1 AS seq, 'full' AS kind, 'case' AS authority_type, 'Smith v. Jones, ' || v || ' F.3d ' || k || ', ' || (k + 5) || ' (6th Cir. ' || y || ')' AS raw_citation, v || ':f3d:' || k AS norm_citation, (k + 5)::VARCHAR AS pincite, y AS cited_year, NULL::INTEGER AS linked_seq, 0 AS start_at FROM o
UNION ALL SELECT k, 2, 'short_form', 'case', v || ' F.3d at ' || (k + 6), NULL, (k + 6)::VARCHAR, NULL, 1, length('Smith v. Jones, ' || v || ' F.3d ' || k || ', ' || (k + 5) || ' (6th Cir. ' || y || '), holds. Smith, ') FROM o
UNION ALL SELECT k, 3, 'id', 'case', 'Id. at ' || (k + 7), NULL, (k + 7)::VARCHAR, NULL, 2, length('Smith v. Jones, ' || v || ' F.3d ' || k || ', ' || (k + 5) || ' (6th Cir. ' || y || '), holds. Smith, ' || v || ' F.3d at ' || (k + 6) || ', adds. ') FROM o
UNION ALL SELECT k, 4, 'unsupported', 'statute', '42 U.S.C. § 1983.', NULL, NULL, NULL, NULL, length('Smith v. Jones, ' || v || ' F.3d ' || k || ', ' || (k + 5) || ' (6th Cir. ' || y || '), holds. Smith, ' || v || ' F.3d at ' || (k + 6) || ', adds. Id. at ' || (k + 7) || '. See ') FROM o"""


@query(OCCURRENCES)
def citation_occurrences(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("Smith v. Jones, "), c % 900 + 1, F.lit(" F.3d "), k, F.lit(", "), k + 5, F.lit(" (6th Cir. "), F.year("o_orderdate"), F.lit("), holds. Smith, "), c % 900 + 1, F.lit(" F.3d at "), k + 6, F.lit(", adds. Id. at "), k + 7, F.lit(". See 42 U.S.C. § 1983."))
    found = O.occurrences(t("orders").select(k.alias("doc_id"), text.alias("text")), link=True)
    return found.select("doc_id", "seq", "kind", "authority_type", "raw_citation", "norm_citation", "pincite", "cited_year", "linked_seq", "start_at")


MARKED = "'x page ' || o_orderkey || ' and [410 U.S. ' || o_custkey || '] then *' || o_orderkey || ' end'"


def _marked(t):
    text = F.concat(F.lit("x page "), "o_orderkey", F.lit(" and [410 U.S. "), "o_custkey", F.lit("] then *"), "o_orderkey", F.lit(" end"))
    return t("orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", text.alias("text"))


@query(f"""WITH m AS (SELECT o_orderkey AS doc_id, o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS c, {MARKED} AS t FROM orders)
SELECT doc_id, k AS page, 2 AS start_at, 7 + length(k) AS end_at FROM m UNION ALL SELECT doc_id, c, 12 + length(k), 22 + length(k) + length(c) + 1 FROM m UNION ALL SELECT doc_id, k, length(t) - 4 - length(k) - 2, length(t) - 4 FROM m""")
def page_markers(t):
    return V.page_markers(_marked(t))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 5 THEN 'pincite_unverifiable' WHEN o_orderkey % 3 = 0 THEN 'verified' ELSE 'pincite_unverifiable' END AS pincite_status, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderkey::VARCHAR END AS observed_page FROM orders""")
def pincite_states(t):
    k = F.col("doc_id")
    rows = _marked(t)
    pin = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, (k + 1).cast("string")).otherwise(F.concat(k, F.lit("-"), k + 2))
    # one in six quotations runs over a marker, so that its page isn't known
    quotes = rows.select("doc_id", k.alias("q_id"), pin.alias("pincite"), F.lit("verified").alias("status"), F.when(k % 6 == 5, F.concat(F.lit("and [410 U.S. "), "o_custkey")).otherwise(F.lit("and")).alias("source_quote"))
    return V.verify_pincites(quotes, rows).select("doc_id", "pincite_status", "observed_page")


@query("SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END::INTEGER AS n FROM region")
def identity_counts(t):
    from lexloom.operators import entities as E

    k = F.col("r_regionkey") % 3
    one = lambda title, year: F.struct(F.lit(title).cast("string").alias("title"), F.lit(year).cast("string").alias("year"))
    same = F.array(one("Ann Lee v. Bo Kay", "1990"), one("ANN LEE v. BO KAY Co.", None), one(None, "1990"))
    apart = F.array(one("Ann Lee v. Bo Kay", "1990"), one("Ann Lee v. Bo Kay", "1991"), one("State v. Roe", "1990"))
    # the second fits the first, the third only the second: what counts is the first
    chain = F.array(one("Ann Lee v. Bo Kay", "1990"), one("Ann Lee v. Bo Kay", None), one("Ann Lee v. Bo Kay", "1991"))
    return t("region").select("r_regionkey", E.identity_counts(F.when(k == 0, same).when(k == 1, apart).otherwise(chain)).alias("n"))


@query("""WITH s AS (SELECT doc_id, start_at, end_at, block_no FROM (WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n+'), lambda x: trim(regexp_replace(x, '[\\s\\x{00a0}]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents),
blocks AS (SELECT doc_id, unnest(range(1, len(ps) + 1))::INTEGER AS block_no, unnest(ps) AS text FROM b) SELECT doc_id, block_no, (sum(length(text) + 2) OVER w - 2)::BIGINT AS end_at, (sum(length(text) + 2) OVER w - 2 - length(text))::BIGINT AS start_at FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)))
SELECT d.doc_id, s.block_no FROM documents d JOIN s ON d.doc_id = s.doc_id AND s.start_at < 900 AND s.end_at > 300""")
def quote_blocks(t):
    ranges = D.block_ranges(D.blocks(t("documents"))).select("doc_id", "block_no", "start_at", "end_at")
    spans = t("documents").select("doc_id", F.lit(300).alias("s"), F.lit(900).alias("e"))
    return V.interval_join(spans, ranges).select("doc_id", "block_no")


@query("""WITH b AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark) SELECT item_id, CASE item_id % 4 WHEN 1 THEN false WHEN 3 THEN false ELSE length(t) >= 160 END AS matched FROM b""")
def omission_quote(t):
    from lexloom.functions.text import fold_typography

    whole, k = fold_typography(F.col("text")), F.col("item_id") % 4
    one, two = F.substring(whole, 1, 40), F.substring(whole, 101, 60)
    # in order; the wrong way round; in order with a piece that is too short to count; a piece that isn't there
    in_order = F.concat(one, F.lit(" ... "), two)
    quote = F.when(k == 0, in_order).when(k == 1, F.concat(two, F.lit(" … "), one)).when(k == 2, F.concat(one, F.lit(" [ . . . ] zz … "), two)).otherwise(F.concat(one, F.lit(". . . nothing of the kind stands here")))
    return t("benchmark").select("item_id", ((F.length(whole) >= 160) & V.omission_match(quote, whole)).alias("matched"))


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN ['schema_version', 'answer_not_addressed'] WHEN toxic = 1 THEN ['answer.confidence', 'relevant_passages.quote'] WHEN doc_id % 5 = 0 THEN ['json'] ELSE [] END AS errors FROM labels""")
def answer_validation(t):
    from lexloom.operators import structured as S

    text = lambda s: F.concat(F.lit('{"schema_version":'), F.when(F.col("quality") == 0, "2").otherwise("1"), F.lit(s))
    identity = '"case_identity":{"name":"A v. B","court":null,"citations":[]},"treatment_status":"not_checked","limitations":[]'
    answer = '"answer":[{"text":"x","source_blocks":["P00001"],"confidence":"%s"}]'
    good = text(f',"status":"answered",{identity},{answer % "high"},"relevant_passages":[]}}')
    odd = text(f',"status":"answered",{identity},{answer % "sure"},"relevant_passages":[{{"quote":" ","source_blocks":["P00001"],"speaker":"c","opinion_part":"m"}}]}}')
    silent = text(f',"status":"not_addressed",{identity},{answer % "high"},"relevant_passages":[]}}')
    body = F.when(F.col("quality") == 0, silent).when(F.col("toxic") == 1, odd).when(F.col("doc_id") % 5 == 0, F.lit("I can't say {that")).otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```")))
    return t("labels").select("doc_id", S.case_answer(body)["errors"].alias("errors"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'supports' WHEN doc_id % 4 = 1 THEN 'manual_review_required' WHEN doc_id % 4 = 2 THEN 'manual_review_required' ELSE 'insufficient_context' END AS state FROM labels""")
def evidence_states(t):
    from lexloom.operators import structured as S

    k = F.col("doc_id") % 4
    blocks = F.create_map(F.lit("P00001"), F.lit("The “duty” of"), F.lit("P00002"), F.lit("care is owed…"))
    x = F.struct(F.when(k == 3, "insufficient_context").otherwise("supports").alias("status"), F.when(k == 1, F.array(F.lit("P00001"), F.lit("P00009"))).otherwise(F.array(F.lit("P00001"), F.lit("P00002"))).alias("source_blocks"), F.when(k == 2, "no such words").otherwise('"duty" of care is owed...').alias("evidence_quote"))
    return t("labels").select("doc_id", S.proposition_state(x, blocks).alias("state"))
