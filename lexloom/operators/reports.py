"""Reports as text: Markdown, HTML and plain lists, each a column or an ordered aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import escape_html
from lexloom.operators.structured import QUOTES, SECTIONS, STATEMENT
from lexloom.operators.verification import priority

# What is advised for each overall state.
ADVICE = {
    "verified": "nothing to correct by the checks that were asked for; review by a person before it is relied on",
    "verified_with_qualification": "keep the qualification that is stated",
    "issue_found": "look at the evidence and correct or explain the issue",
    "manual_review_required": "settle the open check by hand",
    "not_checked": "no check that was asked for applies",
}


def lines(*parts: Column | str | None, sep: str = "\n") -> Column:
    """The parts that aren't null or empty, one a line."""
    given = [F.lit(p) if isinstance(p, str) else p for p in parts if p is not None]
    return F.array_join(F.filter(F.array(*given), lambda x: x.isNotNull() & (x != "")), sep)


def labelled(name: str, value: Column, code: bool = False) -> Column:
    """A list item with a bold label; null where there is no value."""
    shown = F.concat(F.lit("`"), value, F.lit("`")) if code else value
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"- **{name}:** "), shown))


def codes(ids: Column) -> Column:
    """Ids as code, separated by commas."""
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("`"), i, F.lit("`"))), ", ")


def report(df: DataFrame, by: str, order: Column, line: Column, name: str = "report", sep: str = "\n") -> DataFrame:
    """One text per group: its lines in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return df.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["l"]), sep).alias(name))


CHECKS = ("identity", "quotation", "pincite", "speaker", "proposition_support")


def finding(r: Column) -> Column:
    """One occurrence's section: struct(occ_id, raw_citation, overall_status, authority_type, kind, block_id, linked_occ_id, proposition,
    quotation, source_path, source_title, source_sha256, warnings, and for each check a struct(status, explanation, source_blocks))."""
    table = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    check = lambda name: F.when(
        r[name].isNotNull(),
        lines(F.concat(F.lit(f"- **{name.replace('_', ' ').capitalize()}:** "), r[name]["status"]), F.concat(F.lit("  - "), r[name]["explanation"]), F.when(F.size(r[name]["source_blocks"]) > 0, F.concat(F.lit("  - Opinion blocks: "), codes(r[name]["source_blocks"])))),
    )
    warned = F.when(F.size(r["warnings"]) > 0, F.concat(F.lit("### Warnings\n\n"), F.array_join(F.transform(r["warnings"], lambda w: F.concat(F.lit("- "), w)), "\n")))
    return lines(
        F.concat(F.lit("## "), r["occ_id"], F.lit(" — "), r["raw_citation"]), labelled("Overall status", r["overall_status"]), labelled("Advice", F.try_element_at(table, r["overall_status"])),
        F.concat(F.lit("- **Authority:** "), r["authority_type"], F.lit("; form: "), r["kind"]), labelled("Place in the draft", r["block_id"], True), labelled("Stands for", r["linked_occ_id"], True),
        labelled("Proposition", r["proposition"]), labelled("Quotation", r["quotation"]), labelled("Source", r["source_path"], True), labelled("Source title", r["source_title"]), labelled("Source SHA-256", r["source_sha256"], True),
        "### Checks", *map(check, CHECKS), warned, sep="\n\n",
    )


def verification_counts(df: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, and the eight counts of a verification (rows: authority_type, overall_status)."""
    case, state = F.col("authority_type") == "case", F.col("overall_status")
    is_ = lambda name: F.count_if(state == name)
    return df.groupBy(by).agg(
        F.count("*").alias("occurrences"), F.count_if(case).alias("case_occurrences"), F.count_if(~F.coalesce(case, F.lit(False))).alias("unsupported_occurrences"), is_("verified").alias("verified"),
        is_("verified_with_qualification").alias("qualified"), is_("issue_found").alias("issues"), is_("manual_review_required").alias("manual_review"), is_("not_checked").alias("not_checked"),
    )


def verification_report(findings: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, report of every document's findings (by, r: struct of finding()): counts first, then the findings, worst first."""
    rows = findings.select(by, "r", F.col("r.authority_type").alias("authority_type"), F.col("r.overall_status").alias("overall_status"))
    body = report(rows, by, F.struct(priority(F.col("overall_status")).alias("p"), F.col("r.occ_id").alias("i")), finding(F.col("r")), "_body", "\n\n")
    n = lambda c: F.col(c).cast("string")
    head = lines(
        "# Verification of authorities", "## Summary",
        F.concat(F.lit("Occurrences: "), n("occurrences"), F.lit("; cases: "), n("case_occurrences"), F.lit("; others: "), n("unsupported_occurrences"), F.lit(".")),
        F.concat(F.lit("Verified: "), n("verified"), F.lit("; qualified: "), n("qualified"), F.lit("; issues: "), n("issues"), F.lit("; manual review: "), n("manual_review"), F.lit("; not checked: "), n("not_checked"), F.lit(".")),
        "# Findings", F.col("_body"), "# Limits", "Only the checks that were asked for, against local sources. Later treatment was not checked.", sep="\n\n",
    )
    return verification_counts(rows, by).join(body, by).select(by, F.concat(head, F.lit("\n")).alias("report"))


def statements(section: Column) -> Column:
    """A section's statements as a list with their blocks; a note where there is none."""
    one = lambda s: F.concat(F.lit("- "), s["text"], F.lit(" ["), codes(s["source_blocks"]), F.lit("]"), F.when(s["confidence"] == "high", "").otherwise(F.concat(F.lit(" _("), s["confidence"], F.lit(")_"))))
    return F.when(F.size(F.coalesce(section, F.array().cast(STATEMENT))) > 0, F.array_join(F.transform(section, one), "\n")).otherwise("_Not established by the opinion._")


def summary_report(v: Column, source: Column, warnings: Column) -> Column:
    """A summary (struct of structured.SUMMARY) as Markdown. source: struct(path, case_key, raw_sha256, text_sha256)."""
    quote = lambda q: F.concat(F.lit("> "), q["text"], F.lit("\n> - "), q["speaker"], F.lit("; "), q["opinion_part"], F.lit("; "), codes(q["source_blocks"]))
    quotes = F.when(F.size(F.coalesce(v["key_quotes"], F.array().cast(QUOTES))) > 0, F.array_join(F.transform(v["key_quotes"], quote), "\n\n")).otherwise("_No quotation was found word for word._")
    i = v["case_identity"]
    sections = [F.concat(F.lit(f"## {s.replace('_', ' ').capitalize()}\n\n"), statements(v[s])) for s in SECTIONS]
    warned = F.when(F.size(warnings) > 0, F.concat(F.lit("## Warnings\n\n"), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), "\n")))
    known = lines(labelled("Court", i["court"]), labelled("Date", i["date"]), labelled("Docket", i["docket"]), labelled("Citations", F.array_join(i["citations"], ", ")), labelled("Case key", source["case_key"], True))
    return F.concat(
        lines(
            F.concat(F.lit("# "), F.coalesce(i["name"], source["case_key"], F.lit("Case summary"))), known, *sections, "## Key quotations", quotes, "## Later treatment", "Not checked.", "## Source",
            lines(labelled("Path", source["path"], True), labelled("SHA-256", source["raw_sha256"], True), labelled("Text SHA-256", source["text_sha256"], True)), warned, sep="\n\n",
        ),
        F.lit("\n"),
    )


def answer_section(number: Column, v: Column, source: Column, error: Column) -> Column:
    """One case's answer (struct of structured.ANSWER), or why it has none."""
    i = v["case_identity"]
    passage = lambda p: F.concat(F.lit("> "), p["quote"], F.lit("\n> - "), p["speaker"], F.lit("; "), p["opinion_part"], F.lit("; "), codes(p["source_blocks"]))
    name = F.coalesce(i["name"], source["case_key"], source["path"])
    good = lines(
        F.concat(F.lit("## "), number.cast("string"), F.lit(". "), name), labelled("Status", v["status"]), "### Answer", statements(v["answer"]),
        F.when(F.size(v["relevant_passages"]) > 0, F.concat(F.lit("### Passages\n\n"), F.array_join(F.transform(v["relevant_passages"], passage), "\n\n"))), "### Limits", statements(v["limitations"]),
        lines(labelled("Path", source["path"], True), labelled("SHA-256", source["raw_sha256"], True)), sep="\n\n",
    )
    bad = lines(F.concat(F.lit("## "), number.cast("string"), F.lit(". "), F.coalesce(source["case_key"], source["path"])), labelled("Error", error))
    return F.when(error.isNotNull(), bad).otherwise(good)


def answers_report(answers: DataFrame, question: str, by: str = "run_id") -> DataFrame:
    """by, report of a question put to several cases one by one (by, number, section, failed), in their order."""
    counts = answers.groupBy(by).agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"))
    body = report(answers, by, F.col("number"), F.col("section"), "_body", "\n\n")
    head = lines("# Answers case by case", f"**Question:** {question}", F.concat(F.lit("Cases: "), F.col("n").cast("string"), F.lit("; failed: "), F.col("bad").cast("string"), F.lit(". Each answer is from its case alone.")), F.col("_body"), sep="\n\n")
    return counts.join(body, by).select(by, F.concat(head, F.lit("\n")).alias("report"))


def case_line(number: Column, c: Column) -> Column:
    """A case record in a numbered list."""
    by = F.array_join(F.array_distinct(F.transform(c["sources"], lambda s: s["provider"])), ", ")
    links = F.array_join(F.transform(F.filter(c["sources"], lambda s: F.coalesce(s["url"], F.lit("")) != ""), lambda s: F.concat(F.lit("   "), s["provider"], F.lit(": "), s["url"])), "\n")
    where = F.concat_ws(" · ", F.nullif(c["court"], F.lit("")), F.coalesce(c["date_filed"], c["year"]))
    return lines(
        F.concat(number.cast("string"), F.lit(". **"), c["title"], F.lit("**")), F.when(F.size(c["citations"]) > 0, F.concat(F.lit("   Citations: "), F.array_join(c["citations"], ", "))), F.concat(F.lit("   Case key: "), c["canonical_key"]),
        F.when(where != "", F.concat(F.lit("   "), where)), F.concat(F.lit("   Providers: "), by), links, F.concat(F.lit("   "), F.coalesce(c["snippet"], F.lit("No snippet."))),
    )


def case_list(cases: DataFrame, by: str, number: str, record: str, heading: str = "Cases") -> DataFrame:
    """by, text: the cases of every group, numbered."""
    n = cases.groupBy(by).agg(F.count("*").cast("string").alias("_n"))
    body = report(cases, by, F.col(number), case_line(F.col(number), F.col(record)), "_body", "\n\n")
    return n.join(body, by).select(by, F.concat(F.lit(f"{heading} ("), F.col("_n"), F.lit("):\n\n"), F.col("_body")).alias("text"))


def _link(url: Column, name: Column) -> Column:
    return F.concat(F.lit('<a href="'), escape_html(url), F.lit('">'), escape_html(name), F.lit("</a>"))


def index_entry(number: Column, c: Column, selected: Column, saved: Column, error: Column) -> Column:
    """One case of an HTML index, with what became of its opinion: not selected, saved, failed or pending."""
    meta = F.concat_ws(" · ", F.nullif(F.array_join(c["citations"], ", "), F.lit("")), c["court"], F.coalesce(c["date_filed"], c["year"]))
    links = F.array_join(F.transform(F.filter(c["sources"], lambda s: F.coalesce(s["url"], F.lit("")) != ""), lambda s: _link(s["url"], s["provider"])), " · ")
    paragraph = lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit("<p>"), x, F.lit("</p>"))).otherwise("")
    state = F.when(~selected, "Not selected.").when(saved.isNotNull(), F.concat(F.lit("Saved: <code>"), escape_html(saved), F.lit("</code>"))).when(error.isNotNull(), F.concat(F.lit("Failed: "), escape_html(error))).otherwise("Pending.")
    heading = F.concat(F.lit("<h2>"), number.cast("string"), F.lit(". "), escape_html(c["title"]), F.lit("</h2>"))
    return F.concat(F.lit("<article>"), heading, paragraph(escape_html(meta)), paragraph(F.when(links == "", "No link.").otherwise(links)), paragraph(escape_html(c["snippet"])), paragraph(state), F.lit("</article>"))


def html_page(title: Column, body: Column) -> Column:
    return F.concat(F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), escape_html(title), F.lit("</title></head><body><h1>"), escape_html(title), F.lit("</h1>"), body, F.lit("</body></html>"))


def index_page(entries: DataFrame, by: str, title: str, number: str = "number", entry: str = "entry") -> DataFrame:
    """by, html of every group's entries in their order."""
    body = report(entries, by, F.col(number), F.col(entry), "_body")
    names = entries.groupBy(by).agg(F.min(title).alias("_title"))
    return body.join(names, by).select(by, html_page(F.col("_title"), F.col("_body")).alias("html"))


def selection_list(candidates: DataFrame, by: str = "handle") -> DataFrame:
    """by, html of the links to choose from (by, position, title, provider, url), each provider and URL once."""
    first = candidates.groupBy(by, "provider", "url").agg(F.min("position").alias("position"), F.min_by("title", "position").alias("title"))
    item = F.concat(F.lit("<li>"), _link(F.col("url"), F.col("title")), F.lit(" ("), escape_html(F.col("provider")), F.lit(")</li>"))
    listed = report(first, by, F.col("position"), item, "_body")
    return listed.select(by, html_page(F.concat(F.lit("Selection "), F.col(by)), F.concat(F.lit("<ol>"), F.col("_body"), F.lit("</ol>"))).alias("html"))


def search_text(o: Column, shown: int = 20) -> Column:
    """A search's outcome (status, phase, provider, query, pages, results: array of compact rows, unique, downloaded, failed, stop_reason, resume_page) with its first rows and the next offset."""
    n = F.size(o["results"])
    rest = F.struct(F.slice(o["results"], 1, shown).alias("results"), F.least(n, F.lit(shown)).alias("returned"), n.alias("total"), F.when(n > shown, shown).alias("next_offset"))
    return lines(
        F.concat_ws(" ", F.lit("Search"), o["status"], F.lit("during"), o["phase"], F.lit("with"), o["provider"]), F.concat(F.lit("Query: "), o["query"]),
        F.concat(F.lit("Pages: "), F.coalesce(F.nullif(F.array_join(F.transform(o["pages"], lambda p: p.cast("string")), ", "), F.lit("")), F.lit("none"))),
        F.concat(F.lit("Results: "), n.cast("string"), F.lit("; cases: "), o["unique"].cast("string")), F.concat(F.lit("Downloaded: "), o["downloaded"].cast("string"), F.lit("; failed: "), o["failed"].cast("string")),
        F.concat(F.lit("Stopped: "), o["stop_reason"]), F.concat(F.lit("Resume at page "), o["resume_page"].cast("string")), F.to_json(rest),
    )


def collection_text(o: Column) -> Column:
    """A collection's outcome (status, seed, run_id, raw_records, unique, selected, downloaded, failed, pages_to_search) with what to do next."""
    resume = F.concat(F.lit("resume run "), o["run_id"])
    following = (
        F.when(o["status"] == "paused", resume)
        .when((o["status"] == "incomplete") & (o["pages_to_search"] == -1), F.concat(F.lit("a provider stopped or was blocked; "), resume))
        .when((o["status"] == "incomplete") & (o["pages_to_search"] < 50), F.lit("resume with more pages, or without a limit"))
        .when(o["status"] == "incomplete", F.lit("resume without a limit, or narrow the filters"))
        .when(o["status"] == "partial_failure", F.concat(F.lit("some downloads failed; "), resume))
    )
    n = lambda f: o[f].cast("string")
    return lines(
        F.concat(F.lit("Collection "), o["status"], F.lit(" for "), o["seed"]), F.concat(F.lit("Run: "), o["run_id"]), F.concat(F.lit("Records: "), n("raw_records"), F.lit("; cases: "), n("unique")),
        F.concat(F.lit("Selected: "), n("selected"), F.lit("; saved: "), n("downloaded"), F.lit("; failed: "), n("failed")), F.concat(F.lit("Next: "), following),
    )


def direct_text(o: Column) -> Column:
    """A direct download's outcome (status, html, title, candidate_key, handle, saved_path, error)."""
    done = F.concat(F.lit("Downloaded "), o["title"], F.lit(" as "), o["candidate_key"], F.lit(" of "), o["handle"], F.lit(" to "), o["saved_path"])
    return F.when(o["status"] == "results", F.coalesce(o["html"], F.lit("No results."))).when(o["status"].isin("completed", "partial_failure"), done).otherwise(F.concat(F.lit("Not downloaded: "), o["error"]))
