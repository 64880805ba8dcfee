"""Queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import markup as M
from lexloom.functions import text as T
from lexloom.functions import urls as U
from lexloom.operators import documents as D
from lexloom.operators import structured as S
from lexloom.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|h\d|blockquote|li|section|article|header|footer|tr|opinion|author|judges|footnote)>', chr(10), 'g'), '<[^>]+>', '', 'g')"
ENTITY_SQL = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"
TIDY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({}, chr(13), ''), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
ARTICLE = "regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
#: Places behind the last sentence, clause and word within a reach of 1,850 characters.
LAST = [f"CASE WHEN contains(left(rest, 1850), '{m}') THEN 1850 - strpos(reverse(left(rest, 1850)), reverse('{m}')) + 1 ELSE 0 END" for m in (". ", "; ", " ")]
BLOCKS = r"""b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n+'), lambda x: trim(regexp_replace(x, '[\s\x{00a0}]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents),
blocks AS (SELECT doc_id, unnest(range(1, len(ps) + 1))::INTEGER AS block_no, unnest(ps) AS text FROM b)"""


@query(f"SELECT page_id, {TIDY.format(ENTITY_SQL.format(STRIPPED))} AS text FROM pages")
def html_to_text(t):
    return t("pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {ENTITY_SQL.format('html')} AS decoded FROM pages")
def html_entities(t):
    return t("pages").select("page_id", T.decode_entities(F.col("html")).alias("decoded"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM documents")
def html_escape(t):
    return t("documents").select("doc_id", T.escape_html(F.col("text")).alias("escaped"))


@query(r"SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS scope FROM pages")
def opinion_scope(t):
    return t("pages").select("page_id", M.opinion_scope(F.col("html")).alias("scope"))


@query("SELECT doc_id, '<div>' || doc_id || '</div><div/>' || lang || '<div>' || source || '</div>' AS inner, NULL::VARCHAR AS none FROM documents")
def element_by_id(t):
    page = F.concat(F.lit('<p id="x">a</p><DIV class="c" id="opinion"><div>'), "doc_id", F.lit("</div><div/>"), "lang", F.lit("<div>"), "source", F.lit("</div></DIV><div>tail</div>"))
    rows = t("documents").select("doc_id", page.alias("html"))
    return rows.select("doc_id", M.by_id(F.col("html"), "none", "opinion").alias("inner"), M.by_id(F.col("html"), "nowhere").alias("none"))


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE {TIDY.format(ENTITY_SQL.format(STRIPPED.replace("html", ARTICLE)))} END AS text FROM pages""")
def opinion_text(t):
    # a third of the pages is taken for Scholar's, which mark their opinions otherwise
    p = t("pages")
    return p.select("page_id", F.when(F.col("page_id") % 3 == 0, F.nullif(M.opinion_text(F.col("html"), "scholar"), F.lit(""))).otherwise(M.opinion_text(F.col("html"))).alias("text"))


@query("SELECT doc_id, '# ' || source || chr(10) || chr(10) || '**' || lang || '** and [' || doc_id || '](https://x.example/' || doc_id || ')' || chr(10) || chr(10) || '*   ' || n_chars || chr(10) || chr(10) || repeat('word ', 50) || 'end' AS md FROM documents")
def opinion_markdown(t):
    lit = F.lit
    html = F.concat(
        lit("<article><nav>menu</nav><h1>"), "source", lit("</h1><p><b>"), "lang", lit('</b>  and <a href="https://x.example/'), "doc_id", lit('">'), "doc_id", lit('</a><a class="jumpback" href="#r">back</a></p><ul><li>'),
        "n_chars", lit("</li></ul><p>" + "word " * 50 + "end</p></article>"),
    )
    return t("documents").select("doc_id", M.opinion_markdown(html).alias("md"))


@query("SELECT page_id, CASE WHEN s = '' THEN 'case' ELSE s END AS slug FROM (SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 90) AS s FROM pages)")
def page_slug(t):
    return t("pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.courtlistener.com/opinion/' || page_id || '/x/' WHEN 1 THEN 'https://scholar.google.com/scholar_case?case=' || page_id
WHEN 2 THEN 'http://law.justia.com/cases/a/' || page_id WHEN 3 THEN 'https://law.justia.com/cases/a/' || page_id || '/' ELSE url END AS url FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'courtlistener' WHEN 1 THEN 'scholar' WHEN 2 THEN 'justia' WHEN 3 THEN 'justia' END AS provider,
CASE page_id % 5 WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN page_id::VARCHAR WHEN 2 THEN 'a/' || page_id WHEN 3 THEN 'a/' || page_id END AS native_id, page_id % 5 IN (0, 1, 3) AS valid, page_id % 5 IN (0, 1) AS safe,
CASE page_id % 5 WHEN 0 THEN 'courtlistener:' || page_id WHEN 1 THEN 'scholar:' || page_id END AS candidate, page_id % 5 IN (2, 3) AS justia FROM u""")
def opinion_url_valid(t):
    k = F.col("page_id")
    at = lambda s: F.concat(F.lit(s), k.cast("string"))
    url = (
        F.when(k % 5 == 0, F.concat(at("https://www.courtlistener.com/opinion/"), F.lit("/x/")))
        .when(k % 5 == 1, at("https://scholar.google.com/scholar_case?case="))
        .when(k % 5 == 2, at("http://law.justia.com/cases/a/"))
        .when(k % 5 == 3, F.concat(at("https://law.justia.com/cases/a/"), F.lit("/")))
        .otherwise(F.col("url"))
    )
    rows = t("pages").select("page_id", url.alias("url"))
    return rows.select("page_id", U.provider(F.col("url")).alias("provider"), U.native_id(F.col("url")).alias("native_id"), U.is_opinion_url(F.col("url")).alias("valid"),
        U.is_safe_source(U.provider(F.col("url")), F.col("url")).alias("safe"), U.candidate_key(U.provider(F.col("url")), U.native_id(F.col("url"))).alias("candidate"), U.is_host(F.col("url"), "justia").alias("justia"))


@query(f"WITH {BLOCKS} SELECT doc_id, block_no, 'P' || lpad(block_no::VARCHAR, 5, '0') AS block_id, text FROM blocks")
def doc_blocks(t):
    return D.blocks(t("documents"))


@query(f"""WITH RECURSIVE {BLOCKS}, c(doc_id, block_no, n, chunk, rest) AS (SELECT doc_id, block_no, 0, NULL::VARCHAR, text FROM blocks UNION ALL
SELECT doc_id, block_no, n + 1, CASE WHEN length(rest) > 1850 THEN trim(left(rest, cut)) ELSE rest END, CASE WHEN length(rest) > 1850 THEN trim(substring(rest, cut + 1)) END
FROM (SELECT *, CASE WHEN s >= 802 THEN s WHEN m >= 802 THEN m WHEN w >= 801 THEN w ELSE 1600 END AS cut FROM (SELECT *, {LAST[0]} AS s, {LAST[1]} AS m, {LAST[2]} AS w FROM c WHERE rest IS NOT NULL)))
SELECT doc_id, block_no, 'P' || lpad(block_no::VARCHAR, 5, '0') AS block_id, text FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, n)::INTEGER AS block_no, chunk AS text FROM c WHERE n > 0 AND chunk <> '')""")
def doc_blocks_long(t):
    return D.long_blocks(t("documents"))


@query(f"WITH {BLOCKS} SELECT doc_id, block_no, (sum(length(text) + 2) OVER w - 2)::BIGINT AS end_at, (sum(length(text) + 2) OVER w - 2 - length(text))::BIGINT AS start_at FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)")
def block_offsets(t):
    return D.block_ranges(D.blocks(t("documents"))).select("doc_id", "block_no", "end_at", "start_at")


@query("SELECT doc_id, sha256(text) AS text_sha256, left(sha256(text), 10) AS short_hash, greatest(1, ceil(length(text) / 4.0))::INTEGER AS tokens FROM documents")
def text_hash(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.sha2(c, 256).alias("text_sha256"), T.short_hash(c).alias("short_hash"), T.token_estimate(c).alias("tokens"))


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '<p>' || left(url, 30) || '</p>' WHEN page_id % 11 <> 0 THEN html END AS html FROM pages),
q AS (SELECT page_id, html, trim(regexp_replace({ENTITY_SQL.format(STRIPPED)}, '[\\s\\x{{00a0}}]+', ' ', 'g')) AS own FROM p)
SELECT page_id, CASE WHEN html IS NULL THEN 'missing' WHEN page_id % 13 = 1 THEN 'unreadable' WHEN length(own) < 200 THEN 'empty' WHEN page_id % 5 = 1 THEN 'unverified' WHEN page_id % 5 IN (2, 3) THEN 'changed' ELSE 'valid' END AS status FROM q""")
def integrity_status(t):
    k = F.col("page_id")
    rows = t("pages").select(k, F.when(k % 7 == 0, F.concat(F.lit("<p>"), F.substring("url", 1, 30), F.lit("</p>"))).when(k % 11 != 0, F.col("html")).alias("html"))
    hashes = D.acquisition_hashes(F.col("html"))
    html_hash = F.when(k % 5 == 2, "0").when(k % 5 != 1, hashes["html_sha256"])
    text_hash = F.when(k % 5 == 3, "0").when(k % 2 == 0, hashes["text_sha256"])
    return rows.select(k, D.integrity(F.col("html"), html_hash, text_hash, regular=k % 13 != 1).alias("status"))


@query("SELECT doc_id, f AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id <> f")
def exact_duplicates(t):
    return D.exact_duplicates(t("documents"))


@query("SELECT doc_id, lang, count(*) OVER ()::BIGINT AS total FROM documents WHERE contains(lower(concat_ws(chr(10), source, lang, text)), 'the') AND contains(lower(concat_ws(chr(10), source, lang, text)), 'on') ORDER BY doc_id LIMIT 100")
def library_search(t):
    hits = D.search(t("documents"), ["The", "on"], ["source", "lang", "text"])
    return D.page(hits.select("doc_id", "lang"), [F.col("doc_id")], 0, 100)


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x{00a0}]+', ' ', 'g')) AS text FROM documents),
p AS (SELECT doc_id, text, list_min(list_filter([instr(lower(text), 'ation'), instr(lower(text), 'ver')], lambda x: x > 0)) AS pos FROM d),
q AS (SELECT doc_id, text, greatest(1, pos - 180) AS b, least(length(text) + 1, pos + 180) AS e FROM p WHERE pos IS NOT NULL)
SELECT doc_id, CASE WHEN b > 1 THEN '…' ELSE '' END || substring(text, b, e - b) || CASE WHEN e <= length(text) THEN '…' ELSE '' END AS passage FROM q""")
def matching_passage(t):
    # exploded, as a condition on the passage would have it worked out once more
    passage = T.snippet(F.col("text"), ["ation", "ver"])
    return t("documents").select("doc_id", F.explode(F.filter(F.array(passage), lambda p: p.isNotNull())).alias("passage"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), q AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark)
SELECT item_id, doc_id FROM q JOIN f ON contains(t, q) WHERE q <> ''""")
def quote_verify(t):
    return D.quoted_documents(t("benchmark"), t("documents"))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k')::INTEGER END AS k, json_valid(props) AND json_extract(props, '$.k') IS NOT NULL AS ok FROM events")
def json_validate(t):
    body = S.embedded_json(F.col("props"))
    k = F.get_json_object(body, "$.k").cast("int")
    return t("events").select("event_id", k.alias("k"), F.coalesce(k.isNotNull(), F.lit(False)).alias("ok"))


@query(f"""WITH RECURSIVE {BLOCKS}, n AS (SELECT doc_id, list(t ORDER BY block_no) AS ts FROM (SELECT doc_id, block_no, greatest(1, ceil(length(text) / 4.0))::INTEGER AS t FROM blocks) GROUP BY 1),
c AS (SELECT doc_id, len(ts) AS n, list_transform(range(0, len(ts) + 1), lambda i: coalesce(list_sum(ts[1:i]), 0)) AS c FROM n),
r(doc_id, n, c, part_no, s, e) AS (SELECT doc_id, n, c, 0, 0, 0 FROM c UNION ALL
SELECT doc_id, n, c, part_no + 1, b, greatest(b + 1, list_max(list_filter(range(b, n + 1), lambda i: c[i + 1] - c[b + 1] <= 300)))
FROM (SELECT *, CASE WHEN e = 0 THEN 0 WHEN k > s THEN k ELSE e END AS b FROM (SELECT *, list_max(list_filter(range(s, e + 1), lambda i: c[e + 1] - c[i + 1] >= 60)) AS k FROM r)) WHERE e < n)
SELECT doc_id, part_no::INTEGER AS part_no, (s + 1)::INTEGER AS first_block, e::INTEGER AS last_block FROM r WHERE part_no > 0""")
def overlapping_parts(t):
    return D.overlapping_parts(t("documents"), 300, 60)


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'omission' END AS how, CASE WHEN doc_id % 4 < 2 THEN 5 END::INTEGER AS start_at,
CASE doc_id % 4 WHEN 0 THEN 5 + length(lang) + 5 + length(doc_id::VARCHAR) WHEN 1 THEN 5 + length(lang) + 5 + length(doc_id::VARCHAR) + 18 + 17 END::INTEGER AS end_at FROM documents""")
def quotation_offsets(t):
    k = F.col("doc_id")
    # curly quotes, an ellipsis, a soft hyphen and doubled blanks, which change the places of what follows them
    source = F.concat(F.lit("AA  "), F.lit("\u00ad“"), "lang", F.lit("” — "), k, F.lit(" are words enough, and these end it all"))
    exact = F.concat(F.lit('"'), "lang", F.lit('" - '), k)
    pieces = F.concat(F.lit('"'), "lang", F.lit('" - '), k, F.lit(" are words enough ... no ... and these end it"))
    quote = F.when(k % 4 == 0, exact).when(k % 4 == 1, pieces).when(k % 4 == 2, F.concat(F.lit("and these end it all . . . "), "lang", F.lit('" - '), k, F.lit(" are words"))).otherwise(F.lit("nothing of the kind"))
    return D.locate_quotations(t("documents").select(k, quote.alias("quotation"), source.alias("source_text"))).select("doc_id", "how", "start_at", "end_at")


@query("SELECT lang, string_agg(doc_id || ' ' || n_chars, chr(10) ORDER BY doc_id) AS report FROM documents GROUP BY lang")
def report_text(t):
    from lexloom.operators.reports import report

    return report(t("documents"), "lang", F.col("doc_id"), F.concat_ws(" ", "doc_id", "n_chars"))
