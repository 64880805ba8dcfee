"""Unit rows for semantics that the supplied tables don't reach."""

from pyspark.sql import functions as F

from lexloom.functions import citations as C
from lexloom.functions import text as T
from lexloom.functions import urls as U
from lexloom.operators import citations as O
from lexloom.operators import documents as D
from lexloom.operators import journal as J
from lexloom.operators import structured as S
from lexloom.operators import verification as V


def value(spark, column, **inputs):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_entities_decode_one_layer(spark):
    assert value(spark, T.decode_entities(F.col("c")), c="&amp;#39; &amp;lt; &#39; &lt; &#x1F600; &nope;") == "&#39; &lt; ' < 😀 &nope;"


def test_page_labels_and_footnotes_go(spark):
    html = 'inn<a id="p" class="star page-label" href="#p12">*12</a>keeper<sup> <a id="fnref:7" href="#x">7</a> </sup> owes<a href=\'#top\' class=\'jumpback\'>^</a> care<sup>2</sup>'
    assert value(spark, T.opinion_html_to_text(F.col("c")), c=html) == "innkeeper owes care2"


def test_slug_folds_accents(spark):
    assert value(spark, T.slug(F.col("c")), c="Élan v. Ñandú!") == "elan-v-nandu"
    assert value(spark, T.slug(F.col("c")), c="…") == "case"


def test_citation_keys(spark):
    key = C.citation_key(F.col("c"))
    assert value(spark, key, c="384 U. S. 436") == value(spark, key, c="384 U.S. 436") == "384:us:436"
    assert value(spark, key, c="86 S. Ct. 1602;") == "86:sct:1602"
    strict = C.strict_citation_key(F.col("c"))
    assert value(spark, strict, c=" 0123 f. 3d 0456 ") == "123:f3d:456"
    assert value(spark, strict, c="100 Cal. App. 6th 5") == "100:calapp6th:5"
    for other in ("see 123 F.3d 456", "123 F.3d 456, 460", "12 Martian Rep. 9", "12345 F.3d 1"):
        assert value(spark, strict, c=other) is None
    assert value(spark, key, c="12 Martian Rep. 09, 14") == "12:martianrep:09" and value(spark, key, c="in 12 X 3") is None


def test_scholar_meta(spark):
    row = value(spark, C.scholar_meta(F.col("c")), c="384 US 436, 86 S. Ct. 1602 - Supreme Court 1966")
    assert (row["citations"], row["court"], row["year"]) == (["384 US 436", "86 S. Ct. 1602"], "Supreme Court", "1966")
    row = value(spark, C.scholar_meta(F.col("c")), c="410 US 113")
    assert (row["citations"], row["court"], row["year"]) == (["410 US 113"], None, None)


def test_opinion_urls(spark):
    valid = U.is_opinion_url(F.col("c"))
    assert value(spark, valid, c="https://scholar.google.com/scholar_case?case=123")
    assert value(spark, valid, c="https://www.courtlistener.com/opinion/123/example/")
    for bad in ("https://scholar.google.com/", "http://www.courtlistener.com/opinion/1/x/", "https://u:p@law.justia.com/cases/a", "https://example.com/opinion/1/", "not a url"):
        assert not value(spark, valid, c=bad)


def test_dates(spark):
    assert str(value(spark, U.displayed_date(F.col("c")), c="Apr 11, 2024")) == "2024-04-11"
    assert value(spark, U.iso_date(F.col("c")), c="2026-02-30") is None


def found(text, *fields):
    return [tuple(getattr(f, x) for x in fields) for f in O.occurrences_in(text)]


def test_occurrences_and_links(spark):
    text = "The rule is old; Able v. Baker Co., 7 U.S. 19, 23 n. 4 (1805), stated it. Under 11 U.S.C. § 362(a) a stay follows. Id. Ibid. at 9. Later cases kept it, 7 U.S. at *25; Carr v. Dunn agreed."
    docs = spark.createDataFrame([("d", text), ("e", "no digits here"), ("f", None)], "doc_id string, text string")
    rows = O.link_short_forms(O.occurrences(docs)).orderBy("seq").collect()
    assert sorted(map(tuple, O.occurrences(docs, link=True).collect()), key=str) == sorted(map(tuple, O.link_short_forms(O.occurrences(docs)).collect()), key=str)
    assert [(r["kind"], r["authority_type"], r["linked_seq"]) for r in rows] == [("full", "case", None), ("unsupported", "statute", None), ("id", "statute", 2), ("id", "statute", 3), ("short_form", "case", 1), ("name_only", "case", None)]
    first = rows[0]
    assert (first["case_name"], first["norm_citation"], first["pincite"], first["parenthetical"], first["cited_year"]) == ("Able v. Baker Co.", "7:us:19", "23 n. 4", "(1805)", "1805")
    assert (first["volume"], first["reporter"], first["first_page"]) == ("7", "U.S.", "19") and text[first["start_at"] : first["end_at"]] == first["raw_citation"]
    assert first["proposition"] == "The rule is old; Able v. Baker Co., 7 U.S. 19, 23 n. 4 (1805), stated it." and rows[5]["raw_citation"] == "Carr v. Dunn" and rows[0]["occ_id"] == "C0001"
    lone = spark.createDataFrame([("d", "Id. at 3. Id.")], "doc_id string, text string")
    assert [(r["authority_type"], r["linked_seq"]) for r in O.occurrences(lone, link=True).orderBy("seq").collect()] == [("case", None), ("case", 1)]
    assert [(r["authority_type"], r["linked_seq"]) for r in O.link_short_forms(O.occurrences(lone)).orderBy("seq").collect()] == [("case", None), ("case", 1)]


def test_tails_of_citations():
    assert found("In 8 F.2d 31, 17 S. Ct. 5 (1926).", "norm_citation", "pincite", "cited_year") == [("8:f2d:31", None, None), ("17:sct:5", None, "1926")]
    assert found("8 F. Supp. 31, at 40 n. 3 (D. Me. 1926, aff'd 1928)", "pincite", "cited_year") == [("40 n. 3", "1928")]
    assert found("8 F.2d 31, 40-42; x", "pincite") == [("40-42",)] and found("8 F.2d 31, 40 and more", "pincite") == [(None,)]
    assert found("9 Ohio St. 4d 12", "norm_citation") == [("9:ohiost4d:12",)]


def test_quotations_and_names_before():
    text = 'He wrote “a carrier\n must stop” and "a carrier answers for its servants". *Eve* v. Fox, 3 A.2d 4; Gil v. Ham, 5 A.2d 6.'
    assert found(text, "case_name", "quotation") == [("Eve v. Fox", "a carrier answers for its servants"), ("Gil v. Ham", "a carrier answers for its servants")]
    assert found("x" * 10 + ' "too far away from it" ' + "y " * 230 + "3 A.2d 4", "quotation") == [(None,)]
    # a name that a citation follows is no name of its own, one that it follows at a distance is
    assert [k for k, in found("Ira v. Jo, 1 P.2d 2.", "kind")] == ["full"]
    # what a name reaches back over is part of it, but for what stands before a semicolon or a line's end
    assert found("It is old. Ira v. Jo, 1 P.2d 2. See; Kim v. Li, 3 P.2d 4", "case_name") == [("It is old. Ira v. Jo",), ("Kim v. Li",)]


def test_overlapping_parts():
    assert D.parts_of([1000] * 7, 3000, 1000) == [(1, 3), (3, 5), (5, 7)]
    # a long overlap goes back to the part's own beginning: then there is none
    assert D.parts_of([100, 10, 100], 110, 60) == [(1, 2), (3, 3)]
    assert D.parts_of([500, 1, 1], 10, 5) == [(1, 1), (2, 3)] and D.parts_of([], 10, 5) == [] and D.parts_of([3, 3, 3], 6, 0) == [(1, 2), (3, 3)]
    import pytest

    for limit, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError, match="limit"):
            D.overlapping_parts(None, limit, overlap)


def test_names_in_columns_and_python(spark):
    import itertools

    from lexloom.functions import names

    given = ["Able v. Baker Co.", "BAKER v. Able", "In re Baker", "the", "State ex rel. Able v. Roe Corp.", "Able versus Baker", "Roe"]
    df = spark.createDataFrame(list(itertools.product(given, given)), "a string, b string")
    for r in df.select("a", "b", C.name_key(F.col("a")).alias("k"), C.names_compatible(F.col("a"), F.col("b")).alias("c")).collect():
        assert r["k"] == names.key(r["a"]) and r["c"] == names.compatible(r["a"], r["b"]), r


def test_folded_index_gives_places_back():
    text = " a\u00a0\u00ad “b”…\t— c "
    folded, at = T.folded_index(text)
    assert folded == 'a "b"... - c' and len(at) == len(folded)
    assert [text[i] for i in at] == ["a", "\u00a0", "“", "b", "”", "…", "…", "…", "\t", "—", " ", "c"]


def test_titles_and_folders(spark):
    row = value(spark, C.opinion_title(F.col("c")), c="Able v. Baker, Inc., 7 US 19 - Supreme Court 1805")
    assert tuple(row) == ("Able v. Baker, Inc.", "7 US 19", "Supreme Court", "1805")
    assert tuple(value(spark, C.opinion_title(F.col("c")), c="Able v. Baker")) == ("Able v. Baker", "", "", "")
    assert value(spark, T.folder_name(F.col("c")), c='Able: "v." Baker / Co. ..') == "Citations for Able- -v.- Baker - Co"
    assert value(spark, T.folder_name(F.col("c")), c=" ... ") == "Citations for Saved case"
    assert value(spark, T.fingerprint(F.col("c")), c='{"b": [1, {"d": 2, "c": 3}], "a": null}') == value(spark, T.fingerprint(F.col("c")), c='{"a":null,"b":[1,{"c":3,"d":2}]}')


def test_paths(spark):
    row = value(spark, U.justia_path(F.col("c")), c="new-york/court-of-appeals-unpublished/1987/a-1/")
    assert tuple(row) == ("New York Court of Appeals", "1987", "unpublished")
    assert tuple(value(spark, U.justia_path(F.col("c")), c="federal/x/2001/y")) == (None, "2001", None)
    inside = U.inside(F.col("c"), "/lib/")
    assert value(spark, inside, c="a/./b.md") == "/lib/a/b.md"
    for bad in ("../x", "/etc/x", "a/../../x", "https://x/y", ""):
        assert value(spark, inside, c=bad) is None
    assert value(spark, U.lookup_query(F.array(F.lit(" "), F.lit("7 U.S. 19")), F.lit("t"))) == '"7 U.S. 19"'
    assert value(spark, U.scholar_search_path(F.lit("duty & care"), F.lit(None), F.lit(None), F.lit(1990), F.lit(None))) == "/scholar?hl=en&as_sdt=2006&q=duty+%26+care&as_ylo=1990&num=20"
    path = U.courtlistener_search_path(F.lit("x"), F.lit(None), F.array(F.lit("ca9")), F.array(F.lit("Published")), F.lit("2001-02-03"), F.lit(None), F.lit(2))
    assert value(spark, path) == "/?q=x&type=o&court_ca9=on&stat_Published=on&filed_after=02%2F03%2F2001&page=2"
    handle = value(spark, U.selection_handle())
    assert len(handle) == 8 and set(handle) <= set(U.HANDLE_LETTERS)


def test_front_matter_and_identity(spark):
    from lexloom.sources import files as R

    md = "---\ncase:\n  title: Able v. Baker\n  citations: ['7 U.S. 19', ' ']\n  dateFiled: 1805-02-01\nsource:\n  provider: Scholar\n---\n\n Body \n"
    js = "# x\n```json\n{\"artifact_type\": \"case_summary\", \"case\": {\"canonicalKey\": \" k \"}}\n```"
    df = spark.createDataFrame([(1, md), (2, js), (3, "plain"), (4, "---\n[1]\n---\n"), (5, None)], "i int, c string").withColumn("j", R.metadata_json(F.col("c")))
    rows = {r["i"]: r for r in df.select("i", "j", R.front_matter(F.col("c")).alias("f"), R.metadata_fields(F.col("j")).alias("m"), R.metadata_provider(F.col("j")).alias("p"), R.is_summary(F.lit("a.md"), F.col("j")).alias("s")).collect()}
    assert rows[1]["f"]["body"] == "Body" and rows[1]["p"] == "scholar" and (rows[1]["m"]["title"], rows[1]["m"]["citations"], rows[1]["m"]["norm_citations"], rows[1]["m"]["year"]) == ("Able v. Baker", ["7 U.S. 19"], ["7:us:19"], "1805")
    assert rows[2]["s"] and rows[2]["m"]["case_key"] == "k" and not rows[1]["s"]
    assert rows[3]["j"] is None and rows[3]["f"]["body"] == "plain" and rows[4]["j"] is None and rows[5]["j"] is None
    named = value(spark, R.identity(F.lit(None).cast("string"), F.array(F.lit("SUPREME COURT"), F.lit("Able v. Baker Mills"), F.lit("7 U.S. 19"), F.lit("(1805)"))))
    assert named["norm_citations"] == ["7:us:19"]


def test_reading_a_library(spark, tmp_path):
    from lexloom.sources import files as R

    long = "The carrier must answer for its servants. " * 8
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.md").write_text(long)
    (tmp_path / "a.html").write_text(f"<html><body><div id='opinion'><p>{long}</p></div><div>menu</div></body></html>")
    (tmp_path / "a.md").write_text('## Machine-readable metadata\n```json\n{"case": {"title": "Able v. Baker", "canonicalKey": "able--1", "sources": [], "citations": ["7 U.S. 19"]}, "source": {"savedPath": "%s/a.html", "provider": "justia"}}\n```' % tmp_path)
    (tmp_path / "b.md").write_text("Roe v. Doe\n\n" + long)
    (tmp_path / "b.Summary.md").write_text(long)
    (tmp_path / "c.txt").write_text("short")
    files = R.read_files(spark, str(tmp_path))
    got = {r["path"].rpartition("/")[2]: r for r in R.load_opinions(files).collect()}
    assert {k: r["error"] for k, r in got.items()} == {"a.html": None, "a.md": "sidecar", "b.md": None, "b.Summary.md": "summary", "c.txt": "short"}
    assert got["a.html"]["text"].startswith("The carrier") and "menu" not in got["a.html"]["text"] and got["a.html"]["case_key"] == "able--1" and got["a.html"]["provider"] == "justia"
    scanned = R.descriptors(R.load_opinions(files))
    _, by_citation, by_name, coverage = R.authority_index(scanned.limit(0), scanned)
    assert [r["citation"] for r in by_citation.collect()] == ["7:us:19"]
    names = sorted(r["name"] for r in by_name.collect())
    assert len(names) == 2 and names[0] == "able v baker" and names[1].startswith("roe v doe")
    assert coverage.first()["indexed_sources"] == 2
    entries, warnings = R.library_records(files)
    assert [r["record"]["case"]["canonicalKey"] for r in entries.collect()] == ["able--1"] and warnings.count() == 0


def test_sinks_never_overwrite(spark, tmp_path):
    from lexloom.sources import sinks as W

    place = str(tmp_path / "o" / "x.md")
    put = lambda how, text: [tuple(r)[1:] for r in W.write(spark.createDataFrame([(place, text)], "path string, content string"), how).collect()]
    assert put(W.kept, "one") == [(place, "written")] and put(W.kept, "one") == [(place, "reused")] and put(W.kept, "two") == [(place, "exists")]
    assert put(W.versioned, "two") == [(place.replace("x.md", "x.2.md"), "written")] and put(W.versioned, "two")[0][1] == "reused"
    (path, outcome), = put(W.captured, "three")
    assert outcome == "written" and "--" in path and put(W.captured, "three") == [(path, "reused")] and put(W.captured, "one") == [(place, "reused")]
    assert put(W.replaced, "four") == [(place, "written")] and open(place).read() == "four"
    assert sorted(p.name for p in (tmp_path / "o").iterdir() if p.name.endswith(".tmp")) == []
    row = value(spark, W.missing_parts(W.document(F.lit("T"), F.array(F.struct(F.lit("H").alias("heading"), F.array(F.lit("a & b")).alias("paragraphs"))))))
    assert row == [] and value(spark, W.missing_parts(F.lit(b"x"))) == list(W.DOCUMENT_PARTS)
    assert value(spark, W.filled_template(F.lit("a {{ x }} b{{y}}"), F.create_map(F.lit("x"), F.lit("1")))) == "a 1 b"


def test_journals_are_appended_line_by_line(tmp_path):
    from lexloom.sources import sinks as W

    path = str(tmp_path / "j.jsonl")
    assert W.appended(path, b"{}")[1] == "written" and W.appended(path, b"{}")[1] == "reused" and W.appended(path, b"[1]")[1] == "written"
    with open(path, "ab") as f:
        f.write(b'{"half')
    assert W.appended(path, b"[2]")[1] == "written" and open(path).read() == "{}\n[1]\n[2]\n"
    (torn,) = tmp_path.glob("torn-append-*.txt")
    assert torn.read_bytes() == b'{"half'


def test_paths_of_one_file_or_folder(spark, tmp_path):
    import pytest

    from lexloom.sources import files as R

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("x")
    assert R.one_file(spark, str(tmp_path), "a/x.txt").count() == 1 and R.one_folder(spark, str(tmp_path), "a").count() == 1
    for f, path in ((R.one_file, "../x.txt"), (R.one_file, "https://x/y.txt"), (R.one_folder, ".."), (R.one_folder, "."), (R.one_folder, "ftp://x")):
        with pytest.raises(ValueError, match="must"):
            f(spark, str(tmp_path), path)
    with pytest.raises(FileNotFoundError):
        R.one_file(spark, str(tmp_path), "a")
    with pytest.raises(NotADirectoryError):
        R.one_folder(spark, str(tmp_path), "a/x.txt")
    assert value(spark, R.readable(F.lit("/lib/a/b.md"), "/lib")) == "/lib/a/b.md" and value(spark, R.readable(F.lit("/other/b.md"), "/lib")) is None


def test_model_calls_are_validated_once_more(spark):
    from lexloom.operators import models as P

    def model(system, user, tokens):
        if "boom" in user:
            raise RuntimeError("down")
        if "cut" in user and tokens < 20:
            return "{", "length"
        return ("good" if "refused" in user or "fine" in user or "cut" in user else "bad"), "stop"

    df = spark.createDataFrame([(i, ("s", u)) for i, u in enumerate(["fine", "odd", "boom", "cut", "w" * 4000])], "id int, prompt struct<system:string,user:string>")
    check = lambda text: None if text == "good" else "not good"
    rows = {r["id"]: r for r in P.call(df, model, check, 10, 100, 3000).collect()}
    assert [(rows[i]["text"], rows[i]["attempts"]) for i in (0, 1, 3)] == [("good", 1), ("good", 2), ("good", 2)]
    assert rows[2]["error"] == "RuntimeError: down" and "window" in rows[4]["error"]


def test_cursors(spark):
    s = J.new_state("courtlistener", F.lit("5"), F.lit(None), F.lit(None), F.lit(None))
    step = lambda n, end: J.courtlistener_step(s, F.lit(n), F.lit(end).cast("boolean"))["status"]
    assert [value(spark, step(*a)) for a in ((20, None), (3, None), (20, True), (3, False))] == ["running", "exhausted", "exhausted", "running"]
    assert value(spark, J.new_state("scholar", F.lit(None).cast("string"), F.lit(None), F.lit(None), F.lit(None)))["status"] == "failed"
    claims = spark.createDataFrame([("H", "u", "2024-01-02"), ("H", "u", "2024-01-03"), ("X", "u", "2024-01-02"), ("O", "u", "2024-01-20"), ("L", "v", "2024-01-02")], "handle string, link string, claimed_at string")
    made = spark.createDataFrame([("H", "2024-01-01", None, ["u"]), ("O", "2023-01-01", None, ["u"]), ("L", "2024-01-01", None, ["u"])], "handle string, created_at string, used_at string, links array<string>").withColumn("created_at", F.to_timestamp("created_at"))
    got = {(r["handle"], r["claimed_at"]): r["outcome"] for r in J.claim(made, claims, F.to_timestamp(F.lit("2024-01-04"))).collect()}
    assert list(map(got.get, [("H", "2024-01-02"), ("H", "2024-01-03"), ("X", "2024-01-02"), ("O", "2024-01-20"), ("L", "2024-01-02")])) == ["claimed", "used", "unknown", "expired", "not_offered"]


def test_journal_lines_end_with_a_newline(spark):
    import pytest

    files = spark.createDataFrame([("a", '{"x":1}\r\n\n{"x":2}\n{"x":'), ("b", '{"x":3}'), ("c", "oops\n")], "path string, content string")
    lines = J.committed_lines(files)
    got = sorted((r["path"], r["line_no"] or 0, r["line"], r["torn"]) for r in lines.collect())
    assert got == [("a", 1, '{"x":1}', '{"x":'), ("a", 3, '{"x":2}', '{"x":'), ("b", 0, None, '{"x":3}'), ("c", 1, "oops", None)]
    events = J.journal_events(lines, "x int")
    with pytest.raises(Exception, match="invalid committed JSON on line 1"):
        J.refuse_bad_lines(events).collect()
    assert [r["event"]["x"] for r in J.refuse_bad_lines(events.where("path <> 'c'")).orderBy("line_no").collect()] == [1, 2]


def test_page_end(spark):
    rows = [(1, 20, False), (49, 20, False), (1, 20, True), (1, 10, True), (50, 20, False), (50, 10, False)]
    df = spark.createDataFrame(rows, "p int, n int, h boolean")
    assert [r["v"] for r in df.select(J.page_reached_end(F.col("p"), F.col("n"), F.col("h")).alias("v")).collect()] == [True, True, False, False, False, True]


def test_status_lattice(spark):
    of = lambda *s: value(spark, V.overall(F.array(*map(F.lit, s))))
    assert of("not_checked", "not_applicable") == "not_checked"
    assert of("verified", "not_found") == "manual_review_required"
    assert of("verified", "not_found", "quote_mismatch") == "issue_found"
    assert of("verified", "holding_dicta_concern") == "verified_with_qualification"
    assert of(None, "not_checked") == "not_checked" and of(None, "verified") == "verified" and value(spark, V.overall(F.lit(None).cast("array<string>"))) == "not_checked"


def test_statements(spark):
    bad = '[{"text":" ","source_blocks":["X1"],"confidence":"sure"}]'
    assert value(spark, S.statement_errors(F.from_json(F.col("c"), S.STATEMENT)), c=bad) == ["empty_text", "block_id", "confidence"]
    assert value(spark, S.embedded_json(F.col("c")), c='Sure:\n```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'


def test_long_paragraphs_are_cut_whole(spark):
    text = ("word " * 900).strip()
    parts = D.split_long(text)
    assert " ".join(parts) == text and max(map(len, parts)) <= 1850
