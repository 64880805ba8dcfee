"""Queries over runs that go on: collections as keyed state, resumable searches, journals, published artefacts, growing components."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.operators.growing import GrowingComponents
from lexloom.operators.paging import PagedTable
from lexloom.operators.search_run import SearchRuns
from lexloom.plans.registry import Registry
from lexloom.session import shared_dir
from lexloom.sources.commits import Published
from lexloom.sources.journal_source import numbered, read_journal
from lexloom.streaming import collections as K

REGISTRY = Registry()
query = REGISTRY.query

PROVIDERS = ("scholar", "courtlistener", "justia")


def _folder(spark, name):
    return f"{shared_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex}"


# Collections as keyed state ---------------------------------------------------------------------------------------

#: What the provider of the query below shows: pages of four, the last at offset 12, and years 1990 to 2005.
SHOWN = K.Limits(page=4, last_offset=12)
YEARS = (1990, 2005)


def _partitions(name="root", low=YEARS[0], high=YEARS[1]):
    """All partitions that halving the years can lead to."""
    middle = (low + high) // 2
    below = [p for a, b in ((low, middle), (middle + 1, high)) for p in _partitions(f"{name}/{a}-{b}", a, b)] if low < high else []
    return [(name, low, high), *below]


def collection_answers(events):
    """What two providers answer about every user's events, as cases of a year: every page of CourtListener, and every page of every
    partition of years of Scholar, whether it will be asked for or not; some pages fail first."""
    k = F.get_json_object("props", "$.k").cast("int")
    cases = events.where("user_id IS NOT NULL").select("user_id", (YEARS[0] + F.when(F.col("user_id") % 2 == 0, k % 16).otherwise(k * k % 16)).alias("year"))
    users = cases.groupBy("user_id").agg(F.count("*").alias("n"))
    text, none = (lambda x: F.lit(x).cast("string")), {"cited_by_id": F.lit(None), "court": F.lit(None), "year_lo": F.lit(None), "year_hi": F.lit(None), "max_pages": F.lit(None)}

    def rows(df, provider, event_id, results, failure, **opened):
        given = {"run_id": F.col("user_id").cast("string"), "provider": text(provider), "event_id": event_id, "results": results, "reached_end": F.lit(None), "failure": failure, **none, **opened}
        return df.select(*(given[n].cast(t).alias(n) for n, t in (c.split() for c in K.ANSWERS.split(", "))))

    def pages(df, last):
        """One row a page: full ones, and one that isn't."""
        return df.withColumn("p", F.explode(F.sequence(F.lit(0), F.least(F.floor(F.col("n") / SHOWN.page).cast("int"), F.lit(last)))))

    shown = F.greatest(F.lit(0), F.least(F.lit(SHOWN.page), F.col("n") - F.col("p") * SHOWN.page))
    listed = pages(users, 1 << 30)
    name = F.concat(F.lit("courtlistener:page:"), (F.col("p") + 1).cast("string"))
    nodes = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, a, b in _partitions()))
    asked = users.select("user_id", F.explode(nodes).alias("d")).select("user_id", "d.*")
    per_year = cases.groupBy("user_id", "year").count().select(F.col("user_id").alias("_u"), "year", "count")
    counted = asked.join(per_year, (F.col("user_id") == F.col("_u")) & F.col("year").between(F.col("lo"), F.col("hi")), "left").groupBy("user_id", "id").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    at = F.concat(F.lit("scholar:"), "id", F.lit(":offset:"), (F.col("p") * SHOWN.page).cast("string"))
    opened = {"cited_by_id": F.when(F.col("user_id") % 10 != 3, F.col("user_id").cast("string")), "court": F.lit("ca6"), "year_lo": F.lit(YEARS[0]), "year_hi": F.lit(YEARS[1])}
    limit = F.when(F.col("user_id") % 5 == 1, 6)
    parts = [
        rows(users, "courtlistener", F.lit(K.OPEN), F.lit(0), F.lit(None), **opened | {"max_pages": limit}),
        rows(users, "scholar", F.lit(K.OPEN), F.lit(0), F.lit(None), **opened),
        rows(listed, "courtlistener", name, shown, F.lit(None)),
        rows(listed.where((F.col("user_id") + F.col("p")) % 3 == 0), "courtlistener", name, F.lit(0), F.lit("transient")),
        rows(pages(counted, SHOWN.last_offset // SHOWN.page), "scholar", at, shown, F.lit(None)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
WITH RECURSIVE e AS (
  SELECT user_id AS u, 1990 + CASE WHEN user_id % 2 = 0 THEN k % 16 ELSE k * k % 16 END AS year
  FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE user_id IS NOT NULL)),
t AS (SELECT u, count(*) AS n FROM e GROUP BY u),
c AS (SELECT t.u, y, (SELECT count(*) FROM e WHERE e.u = t.u AND e.year <= y) AS upto FROM t, range(1989, 2006) r(y)),
v(u, lo, hi, n) AS (
  SELECT u, 1990, 2005, n FROM t
  UNION ALL
  SELECT v.u, h.lo, h.hi, b.upto - a.upto
  FROM v, LATERAL (SELECT unnest([v.lo, (v.lo + v.hi) // 2 + 1]) AS lo, unnest([(v.lo + v.hi) // 2, v.hi]) AS hi) h
  JOIN c a ON a.u = v.u AND a.y = h.lo - 1 JOIN c b ON b.u = v.u AND b.y = h.hi
  WHERE v.n >= 16 AND v.lo < v.hi),
s AS (SELECT u, min(lo) AS stuck FROM v WHERE n >= 16 AND lo = hi GROUP BY u),
w AS (SELECT v.*, s.stuck FROM v LEFT JOIN s USING (u) WHERE s.stuck IS NULL OR v.lo <= s.stuck)
SELECT CAST(u AS VARCHAR) AS run_id, 'scholar' AS provider, CASE WHEN u % 10 = 3 THEN 'failed' WHEN bool_or(n >= 16) THEN 'blocked' ELSE 'exhausted' END AS status,
  CAST(CASE WHEN u % 10 = 3 THEN 0 ELSE sum(CASE WHEN n >= 16 THEN 4 ELSE n // 4 + 1 END) END AS BIGINT) AS pages_completed,
  CAST(CASE WHEN u % 10 = 3 THEN 0 ELSE sum(least(n, 16)) END AS BIGINT) AS raw_results,
  CASE WHEN u % 10 = 3 THEN 0 ELSE count(*) FILTER (n < 16) END AS completed_partitions,
  CASE WHEN u % 10 = 3 THEN 0 ELSE count(*) FILTER (n >= 16 AND lo < hi) END AS expanded_partitions
FROM w GROUP BY u
UNION ALL
SELECT CAST(u AS VARCHAR), 'courtlistener', CASE WHEN u % 10 = 3 THEN 'failed' WHEN u % 5 = 1 AND n // 4 + 1 > 6 THEN 'capped' ELSE 'exhausted' END,
  CASE WHEN u % 10 = 3 THEN 0 WHEN u % 5 = 1 THEN least(6, n // 4 + 1) ELSE n // 4 + 1 END,
  CASE WHEN u % 10 = 3 THEN 0 WHEN u % 5 = 1 THEN least(24, n) ELSE n END, 0, 0
FROM t
""")
def collection_states(t):
    """Answers arrive in three lots, dealt out by a hash, so that most come before their turn; each lot ends the stream, which goes on from its checkpoint."""
    events = t("events")
    spark, folder = events.sparkSession, _folder(events.sparkSession, "answers")
    answers = collection_answers(events).withColumn("lot", F.pmod(F.xxhash64("run_id", "provider", "event_id", "failure"), F.lit(3)))
    answers.write.partitionBy("lot").parquet(f"{folder}/all")
    runs = K.Collections(spark, limits=SHOWN)
    for lot in range(3):
        spark.read.schema(K.ANSWERS).parquet(f"{folder}/all/lot={lot}").write.mode("append").parquet(f"{folder}/come")
        runs.run(K.answers_of(spark, f"{folder}/come"))
    return runs.states().select("run_id", "provider", "status", "pages_completed", "raw_results", "completed_partitions", "expanded_partitions")


# Searches at several providers -------------------------------------------------------------------------------------


def order_pages(spark, orders, folder, size=2):
    """A connector: customers' orders as what three providers list, in pages of two. Some pages fail when they are asked for the first time."""
    w = Window.partitionBy("o_custkey", "provider").orderBy("o_orderkey")
    provider = F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    listed = orders.where("o_custkey IS NOT NULL").withColumn("provider", provider).withColumn("rank", F.row_number().over(w))
    listed = listed.groupBy(F.col("o_custkey").cast("string").alias("run_id"), "provider", (F.floor((F.col("rank") - 1) / size) + 1).cast("int").alias("page")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("records"))
    listed.write.parquet(folder)
    listed = spark.read.schema(listed.schema).parquet(folder)

    def fetch(asked):
        out = asked.join(listed, ["run_id", "provider", "page"], "left")
        failing = (F.col("tries") == 0) & ((F.col("run_id").cast("long") + F.col("page")) % 11 == 0)
        return out.select("run_id", "provider", "page", F.lit(None).cast("boolean").alias("reached_end"), F.when(failing, "transient").alias("failure"), F.coalesce("records", F.array().cast("array<bigint>")).alias("records"))

    return fetch


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, ['scholar', 'courtlistener', 'justia'][o_orderkey % 3 + 1] AS provider FROM orders WHERE o_custkey IS NOT NULL),
r AS (SELECT *, (row_number() OVER (PARTITION BY c, provider ORDER BY k) - 1) // 2 + 1 AS page, (row_number() OVER (PARTITION BY c, provider ORDER BY k) - 1) % 2 + 1 AS position FROM o),
n AS (SELECT u.c, p.provider, count(k) AS n, 1 + u.c % 4 AS last FROM (SELECT DISTINCT c FROM o) u CROSS JOIN (SELECT unnest(['scholar', 'courtlistener', 'justia']) AS provider) p LEFT JOIN o ON o.c = u.c AND o.provider = p.provider GROUP BY u.c, p.provider)
SELECT CAST(n.c AS VARCHAR) AS run_id, n.provider, CASE WHEN n // 2 + 1 <= last THEN 'exhausted' ELSE 'page_limit' END AS status,
  CAST(least(last, n // 2 + 1) AS INTEGER) AS pages_completed, CAST(least(n, 2 * last) AS BIGINT) AS results, CAST(r.page AS INTEGER) AS page, CAST(r.position AS INTEGER) AS position, r.k AS o_orderkey
FROM n LEFT JOIN r ON r.c = n.c AND r.provider = n.provider AND r.page <= last
""")
def search_run_steps(t):
    """The process ends after every step, and the next one goes on from what is committed; failed pages are asked for again."""
    orders = t("orders")
    spark, folder = orders.sparkSession, _folder(orders.sparkSession, "listed")
    fetch = order_pages(spark, orders, folder)
    users = orders.where("o_custkey IS NOT NULL").select(F.col("o_custkey").alias("c")).distinct()
    requests = users.select(F.col("c").cast("string").alias("run_id"), F.explode(F.array(*map(F.lit, PROVIDERS))).alias("provider"), F.lit(1).alias("start_page"), (F.col("c") % 4 + 1).cast("int").alias("end_page"))
    root = _folder(spark, "search")
    searches = lambda: SearchRuns(spark, fetch, "array<bigint>", root, width=2, page_size=2)
    searches().start(requests)
    while searches().run(max_steps=1) or searches().resume():
        pass
    rows = searches().pages().select("run_id", "provider", "page", F.posexplode("records").alias("position", "o_orderkey")).withColumn("position", F.col("position") + 1)
    return searches().states().drop("page", "end_page", "tries").join(rows, ["run_id", "provider"], "left")


# Published artefacts -----------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT DISTINCT 'case-' || (page_id % 50) AS name, sha256(html) AS sha256, octet_length(encode(html)) AS bytes, page_id % 3 AS lot FROM pages WHERE html IS NOT NULL),
f AS (SELECT name, sha256, any_value(bytes) AS bytes, min(lot) AS lot FROM a GROUP BY name, sha256)
SELECT name, sha256, CAST(row_number() OVER (PARTITION BY name ORDER BY lot, sha256) AS INTEGER) AS version, bytes FROM f
""")
def published_artefacts(t):
    """Three lots are published one after the other. Before the second is committed another writer publishes the first again, and a job
    that fails after it has written all is left out."""
    pages = t("pages")
    spark = pages.sparkSession
    out = Published(spark, _folder(spark, "published"))
    artefacts = pages.select(F.concat(F.lit("case-"), F.col("page_id") % 50).alias("name"), F.col("html").alias("content"), (F.col("page_id") % 3).alias("lot"))
    lot = lambda k: artefacts.where(F.col("lot") == k)
    others = []

    def another():
        if not others:
            others.append(Published(spark, out.root).publish(lot(0)))

    def fail():
        raise InterruptedError("cut off before the commit")

    out.publish(lot(0))
    try:
        out.publish(artefacts.withColumn("content", F.reverse("content")), before_commit=fail)
    except InterruptedError:
        pass
    out.publish(lot(1), before_commit=another)
    out.publish(lot(2))
    out.vacuum()
    held = out.contents().select("name", F.sha2("content", 256).alias("sha256"), "version", F.octet_length("content").cast("long").alias("bytes"))
    return held


# Journals as a source ----------------------------------------------------------------------------------------------


def write_journals(events, folder, n=4):
    """n journals of the events in their order, whose last line is torn: its writer hasn't ended it."""
    own = events.where("event_id IS NOT NULL").withColumn("journal", F.pmod("event_id", F.lit(n)))
    last = own.groupBy("journal").agg(F.max("event_id").alias("event_id")).withColumn("torn", F.lit(True))
    rows = own.join(last, ["journal", "event_id"], "left")
    # Spark's writer ends every row by its separator; a blank leaves the line breaks to the rows, and JSON may begin with one
    line = F.concat(F.to_json(F.struct("event_id", "user_id", "event_type")), F.when(F.col("torn"), "").otherwise("\n"))
    rows.select("journal", "event_id", line.alias("value")).repartition(n, "journal").sortWithinPartitions("journal", "event_id").select("journal", "value").write.partitionBy("journal").option("lineSep", " ").text(folder)


@query("""
WITH l AS (SELECT * FROM events WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT max(event_id) FROM events WHERE event_id IS NOT NULL GROUP BY event_id % 4))
SELECT CAST(event_id % 4 AS INTEGER) AS journal, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line_no, event_id, user_id, event_type FROM l
""")
def journal_lines(t):
    events = t("events")
    spark = events.sparkSession
    folder = _folder(spark, "journals")
    write_journals(events, folder)
    lines = numbered(read_journal(spark, folder))
    event = F.from_json("line", "event_id long, user_id long, event_type string", {"mode": "FAILFAST"})
    return lines.select(F.regexp_extract("path", r"journal=(\d+)", 1).cast("int").alias("journal"), "line_no", event.alias("e")).select("journal", "line_no", "e.*")


# Growing components ------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE o AS (SELECT o_orderkey AS item, o_custkey || ':' || o_orderpriority || ':' || year(o_orderdate) AS a, o_custkey || ':' || month(o_orderdate) || ':' || o_orderstatus AS b FROM orders),
e AS (SELECT x.item AS i, y.item AS j FROM o x JOIN o y ON x.a = y.a UNION SELECT x.item, y.item FROM o x JOIN o y ON x.b = y.b),
r(i, j) AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i)
SELECT i AS item, min(j) AS component FROM r GROUP BY i
""")
def growing_components(t):
    """Orders that share a customer's priority and year, or month and state, in five increments; the fourth is cut off before its commit and taken again."""
    orders = t("orders")
    keys = F.array(F.concat_ws(":", "o_custkey", "o_orderpriority", F.year("o_orderdate")), F.concat_ws(":", "o_custkey", F.month("o_orderdate"), "o_orderstatus"))
    rows = orders.select(F.col("o_orderkey").alias("item"), keys.alias("keys"))
    grown = GrowingComponents(orders.sparkSession)

    def fail():
        raise InterruptedError("cut off before the commit")

    for k in range(5):
        lot = rows.where(F.pmod(F.xxhash64("item"), F.lit(5)) == k)
        if k == 3:
            try:
                grown.add(lot, before_commit=fail)
            except InterruptedError:
                pass
        grown.add(lot)
    return grown.labels()


# Pages by key ------------------------------------------------------------------------------------------------------


@query("""
SELECT * FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST((row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) - 1) // 25 AS INTEGER) AS page
  FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1997-01-01') WHERE page < 4
""")
def keyset_pages(t):
    """The first four pages of 25 orders before 1997, newest first, each found by the last key of the one before."""
    from datetime import date

    orders = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    spark = orders.sparkSession
    table = PagedTable(spark, ["-day", "o_orderkey"])
    table.write(orders)
    rows, after = [], (date(1997, 1, 1), (1 << 62))
    for n in range(4):
        got, after = table.page(after, 25)
        rows += [(r.o_orderkey, r.day, n) for r in got]
        if after is None:
            break
    return spark.createDataFrame(rows, "o_orderkey long, day date, page int")
