"""Validation of structured responses: JSON shapes, references, evidence.

A response is a JSON text in a column. It is parsed once against its schema and checked by rules over the parsed struct; a row
keeps the names of all rules that it breaks, so that nothing is lost and no row stops a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sections and confidences of a summary, domains of an audit and of findings, checks, and ids of blocks.
SECTIONS = ("executive_summary", "procedural_posture", "material_facts", "issues", "rules", "holdings", "reasoning", "disposition", "separate_opinions", "limitations")
CONFIDENCES = ("high", "medium", "manual_review_required")
CATEGORIES = ("source_accuracy", "quote_or_attribution", "completeness", "holding_or_dicta", "reasoning")
SEVERITIES = ("critical", "high", "medium", "low")
ANSWERS = ("answered", "partially_answered", "not_addressed")
SPEAKER = ("verified", "wrong_speaker", "manual_review_required", "not_applicable", "source_unavailable", "not_checked")
PROPOSITION = ("supports", "supports_with_qualification", "does_not_support", "not_addressed", "holding_dicta_concern", "insufficient_context", "manual_review_required", "source_unavailable", "not_checked")
CHECKS = ("citation_identity", "quotation", "pincite", "speaker", "proposition_support")
BLOCK_ID = "^P[0-9]{5,}$"

STATEMENT = "array<struct<text:string,source_blocks:array<string>,confidence:string>>"
IDENTITY = "struct<name:string,court:string,date:string,docket:string,citations:array<string>>"
QUOTES = "array<struct<text:string,source_blocks:array<string>,speaker:string,opinion_part:string>>"
PASSAGES = "array<struct<quote:string,source_blocks:array<string>,speaker:string,opinion_part:string>>"
FINDINGS = "array<struct<category:string,severity:string,target:string,finding:string,source_blocks:array<string>,required_correction:string>>"
SUMMARY = f"struct<schema_version:int,treatment_status:string,case_identity:{IDENTITY},{','.join(f'{s}:{STATEMENT}' for s in SECTIONS)},key_quotes:{QUOTES}>"
AUDIT = f"struct<disagreements:array<string>,findings:{FINDINGS},required_corrections:array<string>>"
ANSWER = f"struct<schema_version:int,treatment_status:string,status:string,case_identity:{IDENTITY},answer:{STATEMENT},relevant_passages:{PASSAGES},limitations:{STATEMENT}>"
CONCLUSION = "struct<status:string,explanation:string,source_blocks:array<string>,speaker:string,opinion_part:string,evidence_quote:string>"
AUTHORITY = f"struct<schema_version:int,findings:array<struct<occurrence_id:string,speaker:{CONCLUSION},proposition_support:{CONCLUSION}>>>"


def embedded_json(c: Column) -> Column:
    """The JSON object in a response: all of it inside a fence, else from the first to the last brace."""
    fenced = F.regexp_extract(F.trim(c), r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.nullif(F.coalesce(F.nullif(fenced, F.lit("")), F.regexp_extract(c, r"(?s)(\{.*\})", 1)), F.lit(""))


def _missing(c: Column) -> Column:
    """No string, or one of blanks."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _blank(c: Column) -> Column:
    """A string of blanks; null is no error."""
    return F.coalesce(F.trim(c) == "", F.lit(False))


def _outside(c: Column, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(c.isin(*allowed), F.lit(False))


def _strings(a: Column, empty: bool = True) -> Column:
    """An array of strings that isn't one, has a blank string, or is empty where it may not be."""
    bad = a.isNull() | F.coalesce(F.exists(a, _missing), F.lit(False))
    return bad if empty else bad | (F.size(a) < 1)


def _names(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that are broken, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for test, name in rules)), lambda e: e.isNotNull())


def _lacks(a: Column, field: str) -> Column:
    """Whether any element's field is no string, or one of blanks."""
    return _any(a, lambda x: _missing(x[field]))


def _any(a: Column, test: Callable[[Column], Column]) -> Column:
    """Whether any element breaks a rule; a missing array breaks none of its elements' rules."""
    return F.coalesce(F.exists(a, test), F.lit(False))


def statement_errors(section: Column, block_ids: bool = True) -> Column:
    """Error names of one array of statements."""
    rules = [
        (section.isNull(), "missing"),
        (_any(section, lambda s: _missing(s["text"])), "empty_text"),
        (_any(section, lambda s: F.coalesce(F.size(s["source_blocks"]), F.lit(0)) < 1), "no_blocks"),
        (_any(section, lambda s: _outside(s["confidence"], CONFIDENCES)), "confidence"),
    ]
    if block_ids:
        rules.insert(3, (_any(section, lambda s: _any(s["source_blocks"], lambda b: ~F.coalesce(b.rlike(BLOCK_ID), F.lit(False)))), "block_id"))
    return _names(*rules)


def identity_errors(identity: Column) -> Column:
    return _names((identity.isNull(), "missing"), (identity.isNotNull() & _any(F.array(*(identity[f] for f in ("name", "court", "date", "docket"))), _blank), "empty_text"), (identity.isNotNull() & _strings(identity["citations"]), "citations"))


def quote_errors(quotes: Column, text: str = "text") -> Column:
    """Error names of an array of quotations or passages."""
    fields = (text, "speaker", "opinion_part")
    return _names((quotes.isNull(), "missing"), *((_lacks(quotes, f), f) for f in fields), (_any(quotes, lambda q: _strings(q["source_blocks"], empty=False)), "source_blocks"))


def _within(name: str, errors: Column) -> Column:
    return F.transform(errors, lambda e: F.concat(F.lit(f"{name}."), e))


def _parsed(c: Column, schema: str) -> tuple[Column, Column]:
    """The struct in a response, and whether it holds an object at all."""
    body = embedded_json(c)
    return F.from_json(body, schema), body.isNotNull() & F.coalesce(F.schema_of_json(F.lit("{}")).isNotNull(), F.lit(True)) & F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))


def _checked(c: Column, schema: str, rules: Callable[[Column], list[Column]]) -> Column:
    value, good = _parsed(c, schema)
    return F.struct(F.when(good, value).alias("value"), F.when(good, F.flatten(F.array(*rules(value)))).otherwise(F.array(F.lit("json"))).alias("errors"))


def case_summary(c: Column) -> Column:
    """struct(value, errors) of a summary's response."""

    def rules(v: Column) -> list[Column]:
        head = _names((_outside(v["schema_version"].cast("string"), ("1",)), "schema_version"), (_outside(v["treatment_status"], ("not_checked",)), "treatment_status"))
        return [head, _within("case_identity", identity_errors(v["case_identity"])), *(_within(s, statement_errors(v[s], block_ids=False)) for s in SECTIONS), _within("key_quotes", quote_errors(v["key_quotes"]))]

    return _checked(c, SUMMARY, rules)


def summary_audit(c: Column) -> Column:
    """struct(value, errors) of an audit's response."""

    def rules(v: Column) -> list[Column]:
        f = v["findings"]
        findings = _names(
            (f.isNull(), "missing"), (_any(f, lambda x: _outside(x["category"], CATEGORIES)), "category"), (_any(f, lambda x: _outside(x["severity"], SEVERITIES)), "severity"),
            *((_lacks(f, n), n) for n in ("target", "finding", "required_correction")), (_any(f, lambda x: _strings(x["source_blocks"])), "source_blocks"),
        )
        return [_within("findings", findings), _names((_strings(v["disagreements"]), "disagreements"), (_strings(v["required_corrections"]), "required_corrections"))]

    return _checked(c, AUDIT, rules)


def case_answer(c: Column) -> Column:
    """struct(value, errors) of an answer's response. What isn't addressed has no answer, and all else has one."""

    def rules(v: Column) -> list[Column]:
        n = F.coalesce(F.size(v["answer"]), F.lit(0))
        silent = v["status"] == "not_addressed"
        head = _names(
            (_outside(v["schema_version"].cast("string"), ("1",)), "schema_version"), (_outside(v["status"], ANSWERS), "status"), (_outside(v["treatment_status"], ("not_checked",)), "treatment_status"),
            (F.coalesce(silent & (n > 0), F.lit(False)), "answer_not_addressed"), (F.coalesce(~silent & (n < 1), F.lit(False)), "answer_required"),
        )
        return [
            head, _within("case_identity", identity_errors(v["case_identity"])), _within("answer", statement_errors(v["answer"], block_ids=False)),
            _within("relevant_passages", quote_errors(v["relevant_passages"], "quote")), _within("limitations", statement_errors(v["limitations"], block_ids=False)),
        ]

    return _checked(c, ANSWER, rules)


def conclusion_errors(x: Column, allowed: tuple[str, ...]) -> Column:
    """Error names of one conclusion; a missing one has none."""
    given = x.isNotNull()
    rules = ((given & _outside(x["status"], allowed), "status"), (given & _missing(x["explanation"]), "explanation"), (given & _strings(x["source_blocks"]), "source_blocks"))
    return _names(*rules, *((given & _blank(x[f]), f) for f in ("speaker", "opinion_part", "evidence_quote")))


def authority_findings(c: Column) -> Column:
    """struct(value, errors) of an authority analysis' response; an occurrence may stand in it once."""

    def rules(v: Column) -> list[Column]:
        f = v["findings"]
        ids = F.transform(f, lambda x: F.trim(x["occurrence_id"]))
        head = _names(
            (_outside(v["schema_version"].cast("string"), ("1",)), "schema_version"), (f.isNull(), "findings"), (_any(f, lambda x: _missing(x["occurrence_id"])), "occurrence_id"),
            (F.coalesce(F.size(F.array_distinct(ids)) < F.size(ids), F.lit(False)), "repeated"),
        )
        of = lambda field, allowed: _within(field, F.array_distinct(F.flatten(F.transform(F.coalesce(f, F.array().cast("array<struct<occurrence_id:string,speaker:" + CONCLUSION + ",proposition_support:" + CONCLUSION + ">>")), lambda x: conclusion_errors(x[field], allowed)))))
        return [head, of("speaker", SPEAKER), of("proposition_support", PROPOSITION)]

    return _checked(c, AUTHORITY, rules)


def references(value: Column) -> Column:
    """All block ids that a summary's sections and quotations name, each once."""
    named = [F.flatten(F.transform(F.coalesce(value[s], F.array().cast(t)), lambda x: F.coalesce(x["source_blocks"], F.array().cast("array<string>")))) for s, t in (*((s, STATEMENT) for s in SECTIONS), ("key_quotes", QUOTES))]
    return F.array_distinct(F.concat(*named))


def audit_references(value: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.coalesce(value["findings"], F.array().cast(FINDINGS)), lambda x: F.coalesce(x["source_blocks"], F.array().cast("array<string>")))))


def answer_references(value: Column) -> Column:
    parts = (("answer", STATEMENT), ("relevant_passages", PASSAGES), ("limitations", STATEMENT))
    return F.array_distinct(F.concat(*(F.flatten(F.transform(F.coalesce(value[n], F.array().cast(t)), lambda x: F.coalesce(x["source_blocks"], F.array().cast("array<string>")))) for n, t in parts)))


def known_block_ids(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block_ids: the ids of every document's blocks."""
    return blocks.groupBy(key).agg(F.collect_set("block_id").alias("block_ids"))


def unknown_references(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference isn't known."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def unknown_ids(ids: Column, known: Column) -> Column:
    return F.array_except(ids, known)


def supported_quotes(quotes: Column, blocks: Column, text: str = "text") -> Column:
    """The quotations (or passages) whose words stand in the blocks that they name. blocks: a map of block ids to texts."""
    from lexloom.functions.text import collapse

    held = lambda q: collapse(F.array_join(F.transform(q["source_blocks"], lambda b: F.coalesce(F.try_element_at(blocks, b), F.lit(""))), " "))
    return F.filter(quotes, lambda q: F.contains(held(q), collapse(q[text])))


def summary_warnings(value: Column, kept: Column) -> Column:
    """What a finished summary is warned of: quotations that were dropped, and sections that should not be empty."""
    n = F.size(F.coalesce(value["key_quotes"], F.array().cast(QUOTES))) - F.size(kept)
    none = lambda s: F.size(F.coalesce(value[s], F.array().cast(STATEMENT))) == 0
    return F.filter(F.array(F.when(n > 0, F.concat(n.cast("string"), F.lit(" quotations not found in their blocks were dropped"))), *(F.when(none(s), F.lit(f"no {s}")) for s in ("issues", "holdings", "disposition"))), lambda w: w.isNotNull())


def evidenced(status: Column, ids: Column, quote: Column, blocks: Column, conclusive: Column) -> Column:
    """status, or manual_review_required where a conclusion names unknown blocks or quotes what they don't hold.

    blocks: a map of block ids to texts. Inconclusive states need no evidence.
    """
    from lexloom.functions.text import fold_typography

    known = F.forall(ids, lambda b: F.map_contains_key(blocks, b))
    cited = F.array_join(F.transform(ids, lambda b: F.coalesce(F.try_element_at(blocks, b), F.lit(""))), " ")
    holds = known & quote.isNotNull() & (F.trim(quote) != "") & F.contains(fold_typography(cited), fold_typography(quote))
    return F.when(status.isNull(), "manual_review_required").when(conclusive & ~F.coalesce(holds, F.lit(False)), "manual_review_required").otherwise(status)


def speaker_state(x: Column, blocks: Column) -> Column:
    """A speaker conclusion's state after its evidence was looked up; that it doesn't apply is no answer to a quotation."""
    state = evidenced(x["status"], x["source_blocks"], x["evidence_quote"], blocks, x["status"] != "manual_review_required")
    return F.when(x["status"] == "not_applicable", "manual_review_required").otherwise(state)


def proposition_state(x: Column, blocks: Column) -> Column:
    return evidenced(x["status"], x["source_blocks"], x["evidence_quote"], blocks, ~x["status"].isin("manual_review_required", "insufficient_context"))


# The states of an artifact's review and of a matter, and what their ids are made of.
REVIEWS = ("unreviewed", "review_pending", "approved", "rejected", "superseded")
MATTERS = ("active",)
MATTER_ID = "^[a-z0-9](?:[a-z0-9-]{0,78}[a-z0-9])?$"
MOMENT = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"
ARTIFACT = "struct<schemaVersion:int,artifactId:string,matterId:string,artifactType:string,path:string,sha256:string,parentArtifactIds:array<string>,createdAt:string,createdBy:struct<tool:string,toolVersion:string,model:string>,reviewStatus:string>"
MATTER = "struct<schemaVersion:int,matterId:string,status:string,createdAt:string,updatedAt:string>"


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _unlike(c: Column, pattern: str) -> Column:
    return ~F.coalesce(c.rlike(pattern), F.lit(False))


def artifact_errors(a: Column) -> Column:
    """Error names of an artifact's record (a struct of ARTIFACT)."""
    parents = F.coalesce(a["parentArtifactIds"], F.array().cast("array<string>"))
    return _names(
        (_outside(a["schemaVersion"].cast("string"), ("1",)), "schemaVersion"), *((_empty(a[f]), f) for f in ("artifactId", "matterId", "artifactType", "path")), (_unlike(a["sha256"], "^[a-f0-9]{64}$"), "sha256"),
        (F.size(F.array_distinct(parents)) < F.size(parents), "parentArtifactIds"), (_unlike(a["createdAt"], MOMENT), "createdAt"), (a["createdBy"].isNull() | a["createdBy"]["tool"].isNull(), "createdBy"), (_outside(a["reviewStatus"], REVIEWS), "reviewStatus"),
    )


def matter_errors(m: Column) -> Column:
    """Error names of a matter's record (a struct of MATTER)."""
    times = ((_unlike(m[f], MOMENT), f) for f in ("createdAt", "updatedAt"))
    return _names((_outside(m["schemaVersion"].cast("string"), ("1",)), "schemaVersion"), (_unlike(m["matterId"], MATTER_ID), "matterId"), (_outside(m["status"], MATTERS), "status"), *times)
