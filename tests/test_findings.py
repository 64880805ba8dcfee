"""What a review of the queries found, on small rows and on copies with larger keys."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lexloom import plans
from lexloom.functions import citations as C
from lexloom.functions import markup as M
from lexloom.functions import text as T
from lexloom.operators import cards as K
from lexloom.operators import documents as D
from lexloom.operators import entities as E
from lexloom.operators import verification as V
from lexloom.operators.pairs import pairs_within
from lexloom.plans import records

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


def test_points_before_an_omission(spark):
    source = "The court below erred in law. Nobody objected to that. The judgment is therefore reversed today."
    for quote in ("The court below erred in law. ... The judgment is therefore reversed", "The court below erred in law. . . . The judgment is therefore reversed", "The court below erred in law [....] The judgment is therefore reversed"):
        row = spark.createDataFrame([(quote, source)], "quotation string, source_text string")
        assert row.select(V.omission_match(F.col("quotation"), F.col("source_text"))).first()[0], quote
        assert D.locate_quotations(row).first()["how"] == "omission", quote
    wrong = spark.createDataFrame([("The judgment is therefore reversed. ... The court below erred in law", source)], "q string, s string")
    assert not wrong.select(V.omission_match(F.col("q"), F.col("s"))).first()[0]


def test_volumes_of_more_digits(spark):
    c = F.col("c")
    df = spark.createDataFrame([(x,) for x in ("05999 F.3d 12", "012345 F.3d 0456", "00 F.3d 0", "12345678901234567890 F.3d 1")], "c string")
    assert [r[0] for r in df.select(C.any_volume_key(c)).collect()] == ["5999:f3d:12", "12345:f3d:456", "0:f3d:0", "12345678901234567890:f3d:1"]
    assert [r[0] for r in df.select(C.strict_citation_key(c)).collect()] == [None, None, "0:f3d:0", None]


@needs_tables
def test_citation_normalize_of_large_keys(spark, tmp_path):
    """Suppliers of six digits, as copies of the tables with shifted keys have."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (l_suppkey + 59995 AS l_suppkey) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = plans.QUERIES["citation_normalize"](spark, str(tmp_path))
    want = con.sql(plans.ORACLES["citation_normalize"])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_compatible_pairs_are_worked_out_by_class(spark):
    import itertools

    names = ["Able v. Baker", "ABLE v. Baker Co.", "Roe", None, "Baker Able Roe", "the"]
    rows = [(g, i, names[(i * 7 + g) % len(names)]) for g in (1, 2) for i in range(20)] + [(3, 0, "Roe"), (None, 1, "Roe"), (None, 2, "Roe")]
    df = spark.createDataFrame(rows, "g int, i int, n string")
    got = V.compatible_pairs(df, "g", "i", "n")
    sides = spark.createDataFrame([(p[1], q[1], p[2], q[2]) for p, q in itertools.combinations(rows, 2) if p[0] is not None and p[0] == q[0]], "a int, b int, p string, q string")
    want = sides.select("a", "b", C.names_compatible(F.col("p"), F.col("q")).alias("compatible"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_pairs_within_are_dealt_out(spark):
    """Every pair once, over many tasks though the table lies in one file and the group is one."""
    df = spark.range(300).select(F.lit(1).alias("g"), "id").coalesce(1)
    met = pairs_within(df, ["g"], "id", size=32)
    assert met.select(F.least("x.id", "y.id"), F.greatest("x.id", "y.id")).distinct().count() == met.count() == 300 * 299 // 2
    assert met.where(F.spark_partition_id() > 0).count() > 300 * 299 // 4


def test_pairs_of_one_name_are_dealt_out(spark):
    """A group of one name isn't left to one task, and each pair comes once."""
    df = spark.range(3000).select(F.lit(1).alias("g"), "id", F.lit("Able v. Baker").alias("n"))
    got = V.compatible_pairs(df, "g", "id", "n").withColumn("p", F.spark_partition_id())
    told = got.agg(F.count("*"), F.countDistinct("a", "b"), F.sum(F.when(F.col("compatible") & (F.col("a") < F.col("b")), 1)), F.countDistinct("p")).first()
    assert tuple(told[:3]) == (3000 * 2999 // 2,) * 3 and told[3] > 1


@needs_tables
def test_pairs_in_several_pieces_and_blocks(spark, tmp_path, monkeypatch):
    """Kinds in several blocks and rows in several pieces, lots and files: every pair once, with its own verdict."""
    from lexloom.operators import pairs

    monkeypatch.setattr(pairs, "LOT", 2)
    monkeypatch.setattr(pairs, "PIECE", 3)
    monkeypatch.setattr(pairs, "KINDS", 2)
    part = spark.read.parquet(f"{SF}/part.parquet").withColumns({"p_size": F.col("p_partkey") % 3 + 1, "p_type": F.lit("SMALL"), "p_brand": F.concat(F.lit("Brand#"), F.col("p_partkey") % 5)})
    part.where("p_partkey < 120").repartition(7).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("match_reasons", "name_compatible"):
        want = con.sql(plans.ORACLES[name])
        assert sorted(map(str, (tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_reasons_are_worked_out_by_kind(spark, tmp_path):
    """No pair of rows compares keys: those of their kinds have been, in what the tasks that list pairs join."""
    spark.createDataFrame([(i, "a b", "Brand#1", "SMALL", 2) for i in range(4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    plan = plans.QUERIES["match_reasons"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" not in plan[: plan.index("Join")]


@needs_tables
def test_names_are_folded_once_a_row(spark):
    """No name is folded by the tasks that look at pairs: beside the joins only what was worked out a row before."""
    plan = plans.QUERIES["name_compatible"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan[: plan.index("Join")]
    assert "regexp_replace" not in pairs and "contains" not in pairs.lower()


@needs_tables
def test_records_are_keyed_once_a_row(spark):
    """Pairs compare keys; titles and dockets aren't folded beside them."""
    plan = plans.QUERIES["match_reasons"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[: plan.index("Join")]


def test_match_keys_tell_what_records_do(spark):
    source = "struct<provider:string,provider_id:string,url:string>"
    r = f"struct<sources:array<{source}>,norm_citations:array<string>,docket_number:string,court:string,date_filed:string,title:string>"
    docket = ("No. 1-a", "Ct.", "2020-01-02", "The A v. B")
    rows = [
        (([("p", "1", "u")], ["1:us:1"], *docket), ([("p", "1", "")], [], None, None, None, None), "provider_identity"),
        (([("p", "", "u")], [], *docket), ([("q", "", "u")], [], *docket[:3], "A versus B"), "docket_court_date_title"),
        (([("p", "", ""), (None, "1", "u")], ["a", None], *docket[:3], None), ([("p", "", ""), (None, "1", "u")], ["b"], *docket[:3], None), None),
        (([("p", "x", "")], ["a", "b"], "", "", "2020", ""), ([("p", "y", "")], ["b"], "", "", "2020", ""), "reporter_citation"),
        (([("p", ":1", None)], None, "", "Ct.", "2020-01-02", "A"), ([("p:", "1", None)], None, "", "Ct.", "2020-01-02", "A"), None),
    ]
    df = spark.createDataFrame(rows, f"a {r}, b {r}, want string")
    for got in df.select("want", E.match_reason("a", "b").alias("ab"), E.match_reason("b", "a").alias("ba")).collect():
        assert got["ab"] == got["ba"] == got["want"]


def test_components_shuffle_no_key_twice(spark, monkeypatch):
    """Keys of rows are written as they are read, and those that stand in one row aren't joined."""
    plans_, keep = [], E.saved
    monkeypatch.setattr(E, "saved", lambda df, path=None: plans_.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, path))
    df = spark.createDataFrame([(1, ["a", "a", "x"]), (2, ["a", None]), (2, ["b"]), (3, ["b", "y"]), (4, ["z", "z"]), (5, None), (1, ["a"])], "item int, keys array<string>")
    assert sorted(map(tuple, E.components(df, "item", "keys").collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert "Aggregate" not in plans_[0] and "> 1" in plans_[1]


def test_only_links_of_names_are_contracted(spark, monkeypatch):
    """Items that share one key only aren't part of the graph that is contracted."""
    links, keep = [], E.contract
    monkeypatch.setattr(E, "contract", lambda edges, *more: links.append(edges.count()) or keep(edges, *more))
    df = spark.range(200).select("id", F.when(F.col("id") == 7, F.array(F.lit("k1"), F.lit("k2"))).otherwise(F.array(F.concat(F.lit("k"), F.col("id") % 5))).alias("keys"))
    got = dict(map(tuple, E.components(df, "id", "keys").collect()))
    assert got == {i: 1 if i % 5 in (1, 2) else i % 5 for i in range(200)} and links[0] <= 3


def test_entities_are_decoded_from_one_evaluation(spark):
    """What decode_entities() is given, and a card's title, stand once in the plan however often they are used."""
    df = spark.createDataFrame([("a &amp; b", "x"), (None, "x"), ("no &nope; &#233;", "x")], "c string, k string")
    out = df.select(T.decode_entities(F.upper("c")).alias("v"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert [r[0] for r in out.collect()] == ["A & B", None, "NO &NOPE; é"]


def test_long_pages_in_several_rows(spark):
    """Cards of a page that comes in rows have the positions that they have in the whole page."""
    card = lambda i: f'<div class="gs_r gs_or gs_scl"><h3 class="gs_rt"><a href="/scholar_case?case={i}">A v. B{i}</a></h3></div>'
    whole = spark.createDataFrame([(1, "".join(map(card, range(7))))], "page_id int, html string")
    rows = spark.createDataFrame([(1, b, "".join(map(card, range(b, min(b + 3, 7))))) for b in (0, 3, 6)], "page_id int, before int, html string")
    assert sorted(map(tuple, K.cards(rows, "scholar", before="before").collect()), key=str) == sorted(map(tuple, K.cards(whole, "scholar").collect()), key=str)


@needs_tables
def test_pages_of_parts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(records, "PART", 3)
    pages = records._court_pages(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"), 3).collect()
    assert max(r["html"].count("<article><h3>") for r in pages) == 3 and any(r["before"] for r in pages)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    for name in ("court_cards", "provider_normalize"):
        want = con.sql(plans.ORACLES[name])
        assert sorted(map(str, (tuple(r) for r in plans.QUERIES[name](spark, SF).select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


@needs_tables
def test_passages_are_cut_from_one_collapsed_text(spark):
    plan = plans.QUERIES["matching_passage"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") == 1
    df = spark.createDataFrame([("a  ver\n b",), ("none",), (None,), ("x" * 200 + " Ver " + "y" * 200,)], "c string")
    got = [r[0] for r in df.select(T.snippet(F.col("c"), ["ation", "ver"], 4)).collect()]
    assert got == ["a ver b"[:6] + "…", None, None, "…xxx Ver …"]


@needs_tables
def test_scopes_are_cut_out_once(spark):
    """A page's scope is tried and taken from one evaluation, and so is its text before entities are decoded."""
    df = spark.createDataFrame([("<article><p>a &amp; b</p></article>",), ("<p>none</p>",), (None,)], "html string")
    out = df.select(M.opinion_text(F.col("html"), "courtlistener").alias("v"))
    assert [r[0] for r in out.collect()] == ["a & b", "", ""]
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_a_machine_is_read_and_written_once_a_batch():
    """However many answers come ahead of their turn."""
    import json

    from lexloom.streaming import collections as K

    calls, kept = [], [None]

    class Value:
        def get(self):
            calls.append("get")
            return kept[0]

        def update(self, value):
            calls.append("update")
            kept[0] = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    given = lambda *answers: [("a", "courtlistener", json.dumps(a)) for a in answers]
    collector = K.RowCollector(K.Limits())
    collector.init(Handle())
    early = given(*({"event_id": f"courtlistener:page:{p}", "results": 20 if p < 100 else 3} for p in range(2, 101)))
    told = json.loads(next(collector.handleInputRows(("a", "courtlistener"), iter(early), None)).told)
    assert (told["status"], told["held"], calls) == ("new", 99, ["get", "update"])
    told = json.loads(next(collector.handleInputRows(("a", "courtlistener"), iter(given({"event_id": K.OPEN, "cited_by_id": "1"}, {"event_id": "courtlistener:page:1", "results": 20})), None)).told)
    assert (told["status"], told["pages_completed"], told["raw_results"], told["held"], len(calls)) == ("exhausted", 100, 1983, 0, 4)


def test_documents_of_one_file_are_read_for_citations_by_many_tasks(spark):
    from lexloom.operators import citations as O

    docs = spark.range(400).coalesce(1).selectExpr("id AS doc_id", "concat('Able v. Baker, ', id + 1, ' F.3d ', id) AS text")
    found = O.occurrences(docs)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert found.count() == 400 and found.where("start_at = 0 AND seq = 1").count() == 400


def test_places_of_citations_on_mixed_texts():
    from lexloom.operators.citations import occurrences_in

    text = "He said “the rule is settled law” in Able v. Baker, 12 F.3d 5, 7 n.3 (6th Cir. 1995). Id. at 9. See 42 U. S. C. § 1983; Local Court Rule 3.1; Fed. R. Civ. P. 56. Baker, 12 F.3d at\t6."
    assert [(f.kind, text[f.start_at : f.end_at]) for f in occurrences_in(text)] == [
        ("full", "Able v. Baker, 12 F.3d 5, 7 n.3 (6th Cir. 1995)"),
        ("id", "Id. at 9"),
        ("unsupported", "42 U. S. C. § 1983;".rstrip(";")),
        ("unsupported", "Local Court Rule 3.1"),
        ("unsupported", "Fed. R. Civ. P. 56."),
        ("short_form", "12 F.3d at\t6"),
    ]
