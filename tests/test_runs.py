"""Runs that go on: keyed state of collections, resumable searches, journals as a source, publication exactly once, growing components."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators.growing import GrowingComponents
from lexloom.operators.search_run import SearchRuns
from lexloom.sources import journal_source as J
from lexloom.sources.commits import Log, Published, create_once, names_in
from lexloom.streaming import collections as K

# Collections ----------------------------------------------------------------------------------------------------------


def machine(provider="courtlistener", max_pages=None, low=2000, high=2003, court="c", **limits):
    m = K.Machine(provider, K.Limits(page=2, last_offset=2, **limits))
    m.open("7", court, low, high, max_pages)
    return m


def test_machine_counts_pages_and_stops_at_its_limit():
    m = machine(max_pages=2)
    assert m.waits_for() == "courtlistener:page:1"
    m.take(2, None)
    m.take(2, None)
    assert (m.status, m.waits_for(), m.pages, m.raw) == ("capped", None, 2, 4)
    m.raise_limit(1)
    assert m.status == "capped"
    m.raise_limit(None)
    m.take(1, None)
    assert (m.status, m.waits_for(), m.past("courtlistener:page:9")) == ("exhausted", None, True)
    m = machine()
    m.take(1, False)  # fewer than a page, but the provider says that there is more
    m.take(2, True)
    assert (m.status, m.raw) == ("exhausted", 3)
    m = K.Machine("scholar", K.Limits())
    m.open(None, None, None, None, None)
    assert (m.status, m.waits_for(), m.error) == ("failed", None, "the seed has no id of scholar")


def test_machine_splits_by_court_then_by_years_and_can_be_stuck():
    m = machine("scholar", court=None, courts=("D. Mass.", "E.D. Pa."))
    for _ in range(2):
        m.take(2, None)
    assert [p[0] for p in m.parts] == ["root/court-1-d-mass", "root/court-2-e-d-pa"] and m.split == 1
    for _ in range(2):
        m.take(2, None)
    assert [p[0] for p in m.parts][:2] == ["root/court-1-d-mass/2000-2001", "root/court-1-d-mass/2002-2003"]
    assert m.past("scholar:root:offset:0") and not m.past("scholar:root/court-2-e-d-pa/2000-2001:offset:0")
    while m.waits_for():
        m.take(2, None)
    assert (m.status, m.final, m.error) == ("blocked", True, "partition can't be split: root/court-1-d-mass/2000-2001/2000-2000")
    m = machine("scholar")
    while m.waits_for():
        m.take(2 if m.parts[0][0] == "root" else 0, None)
    assert (m.status, m.done, m.split) == ("blocked", 2, 1) and "prove" in m.error
    assert machine("scholar", low=2005).status == "exhausted"
    saved = json.loads(machine("scholar").dump())
    assert K.Machine(limits=K.Limits(), **saved).waits_for() == "scholar:root:offset:0"


def answer(run, provider, event_id, results=None, failure=None, **opened):
    row = {"run_id": run, "provider": provider, "event_id": event_id, "results": results, "reached_end": None, "failure": failure, "cited_by_id": None, "court": None, "year_lo": None, "year_hi": None, "max_pages": None}
    return tuple((row | opened).values())


def test_collections_whatever_the_lots_and_restarts(spark, tmp_path):
    """Answers in any order, repeated, failed and cut off in the middle of a batch give the state of one run."""
    rng, rows = random.Random(4), []
    for run in ("a", "b", None):
        rows += [answer(run, "courtlistener", K.OPEN, cited_by_id="1"), answer(run, "scholar", K.OPEN, cited_by_id="1", court="x", year_lo=2000, year_hi=2003)]
        rows += [answer(run, "courtlistener", f"courtlistener:page:{p}", 20 if p < 5 else 3) for p in range(1, 6)]
        rows += [answer(run, "courtlistener", "courtlistener:page:2", 0, "transient"), answer(run, "courtlistener", "courtlistener:page:4", 0, "no such page"), answer(run, "courtlistener", "nonsense", 1)]
        rows += [answer(run, "scholar", "scholar:root:offset:0", 20), answer(run, "scholar", "scholar:root:offset:20", 7), answer(run, "scholar", "scholar:root/2000-2001:offset:0", 7)]
    rows += rows[:6]
    want = None
    for lots in (1, 3):
        rng.shuffle(rows)
        root, come = f"{tmp_path}/{lots}", f"{tmp_path}/come-{lots}"
        runs = K.Collections(spark, root)
        for k in range(lots):
            spark.createDataFrame(rows[k::lots], K.ANSWERS).write.mode("append").parquet(come)
            if k == 1:  # the sink fails after the states were moved; the batch is run again from the checkpoint
                with pytest.raises(Exception, match="cut off"):
                    _failing(runs, K.answers_of(spark, come))
            K.Collections(spark, root).run(K.answers_of(spark, come))
        got = sorted((r.run_id, r.provider, r.status, r.pages_completed, r.raw_results, r.held) for r in runs.states().collect())
        want = want or got
        assert got == want
    assert want == [(r, p, "exhausted", n, raw, 0) for r in "ab" for p, n, raw in (("courtlistener", 5, 83), ("scholar", 2, 27))]


def _failing(runs, answers):
    def fail(batch, number):
        batch.collect()
        raise RuntimeError("cut off")

    kind = "spark.sql.streaming.stateStore.providerClass"
    before = runs.spark.conf.get(kind)
    runs.spark.conf.set(kind, K.ROCKSDB)
    q = K.advance(answers, runs.limits).writeStream.outputMode("update").foreachBatch(fail).option("checkpointLocation", f"{runs.root}/checkpoint").trigger(availableNow=True).start()
    runs.spark.conf.set(kind, before)
    q.awaitTermination()


class Handle:
    """A state store in memory, as far as the processor uses it."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, []

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, *schemas):
        handle = self

        class Map:
            containsKey, getValue = handle.map.__contains__, handle.map.get
            updateValue, removeKey = handle.map.__setitem__, handle.map.__delitem__

            def iterator(self):
                return iter(list(handle.map.items()))

        return Map()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)


def test_timers_ask_again_and_then_block():
    import pandas as pd

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 100

    handle, collector = Handle(), K.Collector(K.Limits(retry_ms=5, tries=2))
    collector.init(handle)
    columns = [c.split()[0] for c in K.ANSWERS.split(", ")]
    give = lambda *rows: next(collector.handleInputRows(("a", "courtlistener"), iter([pd.DataFrame(list(rows), columns=columns)]), Clock())).iloc[0]
    state = give(answer("a", "courtlistener", K.OPEN, cited_by_id="1"), answer("a", "courtlistener", "courtlistener:page:1", 0, "transient"), answer("a", "courtlistener", "courtlistener:page:2", 3))
    assert (state.status, state.waits_for, state.held, handle.timers) == ("paused", "courtlistener:page:1", 1, [105])
    told = [next(collector.handleExpiredTimer(("a", "courtlistener"), Clock(), None)).iloc[0] for _ in range(2)]
    assert [(s.status, s.tries, s.waits_for) for s in told] == [("paused", 1, "courtlistener:page:1"), ("blocked", 2, "courtlistener:page:1")]
    assert handle.timers == [105, 105] and not list(collector.handleExpiredTimer(("a", "courtlistener"), Clock(), None))
    state = give(answer("a", "courtlistener", "courtlistener:page:1", 20))
    assert (state.status, state.raw_results, state.held, handle.map) == ("exhausted", 23, 0, {})


# Searches -------------------------------------------------------------------------------------------------------------


def test_searches_stop_and_go_on_after_any_step(spark, tmp_path):
    held = {("r", "a"): 7, ("r", "b"): 4, ("s", "a"): 0, ("s", "b"): 50, ("t", "a"): 3}
    rows = [(r, p, page, [f"{r}{p}{i}" for i in range(2 * page - 2, min(2 * page, n))]) for (r, p), n in held.items() for page in range(1, n // 2 + 2)]
    listed = spark.createDataFrame(rows, "run_id string, provider string, page int, records array<string>")
    asked_for = []

    def fetch(asked):
        asked_for.append(sorted((r.run_id, r.provider, r.page) for r in asked.collect()))
        failing = F.when((F.col("page") == 3) & (F.col("tries") == 0) & (F.col("run_id") == "s"), "transient")
        # a page without an answer counts as failed
        out = asked.join(listed, ["run_id", "provider", "page"], "left").where(~((F.col("run_id") == "t") & (F.col("tries") == 0)))
        return out.select("run_id", "provider", "page", F.lit(None).cast("boolean").alias("reached_end"), failing.alias("failure"), F.coalesce("records", F.array()).alias("records"))

    requests = spark.createDataFrame([("r", "a", 1, 9), ("r", "b", 1, 9), ("s", "a", 1, 9), ("s", "b", 1, 9), ("s", "b", 1, 9), ("t", "a", 1, 9), ("u", "a", 3, 2), (None, "a", 1, 1)], "run_id string, provider string, start_page int, end_page int")
    whole = SearchRuns(spark, fetch, "array<string>", f"{tmp_path}/whole", width=2, page_size=2)
    whole.start(requests)
    whole.run()
    assert {(r.run_id, r.provider, r.status) for r in whole.states().collect()} >= {("s", "b", "paused"), ("t", "a", "paused"), ("u", "a", "page_limit")}
    assert whole.resume() and whole.run() and not whole.resume()
    first, asked_for[:] = [x for step in asked_for for x in step], []
    cut = lambda: SearchRuns(spark, fetch, "array<string>", f"{tmp_path}/cut", width=2, page_size=2)
    cut().start(requests)
    cut().start(requests)
    while cut().run(max_steps=1) or cut().resume():
        pass
    # what a step wrote before it was cut off doesn't count
    listed.withColumn("failed", F.lit(False)).withColumn("ended", F.lit(True)).write.parquet(f"{tmp_path}/cut/pages/step-999")
    tables = lambda x: [sorted(map(str, f.collect())) for f in (x.states(), x.pages())]
    assert tables(cut()) == tables(whole)
    assert sorted(first) == sorted(x for step in asked_for for x in step)
    good = {(r.run_id, r.provider, r.page) for r in whole.pages().collect()}
    assert len([x for x in first if x in good]) == len(good) + 4  # two pages failed once, and two stood behind them in their step
    assert {(r.run_id, r.provider): (r.status, r.results) for r in whole.states().collect()} == {("r", "a"): ("exhausted", 7), ("r", "b"): ("exhausted", 4), ("s", "a"): ("exhausted", 0), ("s", "b"): ("page_limit", 18), ("t", "a"): ("exhausted", 3), ("u", "a"): ("page_limit", 0)}
    assert whole.resume(more_pages=20) and whole.run()
    assert {(r.run_id, r.provider): (r.status, r.results) for r in whole.states().collect()}[("s", "b")] == ("exhausted", 50)


# Journals -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_journal_by_ranges(spark, tmp_path, monkeypatch, split):
    rng = random.Random(split)
    lines = ["", "a", "é" * 40, "x\r", *("y" * rng.randrange(30) for _ in range(60))]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "one.jsonl").write_bytes("".join(x + "\n" for x in lines).encode() + b"torn")
    (tmp_path / "j" / "torn.jsonl").write_bytes(b"only a torn line")
    (tmp_path / "j" / "empty.jsonl").write_bytes(b"")
    (tmp_path / "j" / "_SUCCESS").write_bytes(b"hidden\n")
    monkeypatch.setattr(J, "CHUNK", 5)
    parts = J.JournalReader({"path": str(tmp_path / "j"), "splitBytes": str(split)}).partitions()
    got = [r for p in parts for b in J.read_range(p, J._arrow()) for r in b.to_pylist()]
    assert [r["line"] for r in sorted(got, key=lambda r: r["at"])] == [x.removesuffix("\r") for x in lines]
    assert all(p.end - p.begin <= split for p in parts)
    if split > 1:
        rows = J.numbered(J.read_journal(spark, str(tmp_path / "j"), splitBytes=str(split))).orderBy("line_no").collect()
        assert [(r.line_no, r.line) for r in rows] == [(i, x.removesuffix("\r")) for i, x in enumerate(lines, 1)]


def test_journal_as_a_stream(spark, tmp_path):
    file, seen = tmp_path / "j.jsonl", []

    def take():
        q = J.stream_journal(spark, str(file), splitBytes="8").writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.line for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    for text in ("a\nbb\ntor", "n\nlonger than a range\n", ""):
        with file.open("a") as f:
            f.write(text)
        take()
    assert [x for x in seen if x] == [["a", "bb"], ["longer than a range", "torn"]]


def test_no_journal(spark, tmp_path):
    assert J.read_journal(spark, str(tmp_path / "nothing")).collect() == []


# Publication ----------------------------------------------------------------------------------------------------------


def test_log_entries_are_written_once(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log")
    assert log.entries() == {} and log.next_number() == 0
    assert log.add(0, {"a": 1}) and not log.add(0, {"a": 2}) and log.add(1, {"b": 1})
    assert create_once(spark, f"{tmp_path}/log/0000000002.json", '{"torn": ')
    assert Log(spark, f"{tmp_path}/log").entries() == {0: {"a": 1}, 1: {"b": 1}} and log.next_number() == 3


def test_publication_exactly_once(spark, tmp_path):
    out = Published(spark, f"{tmp_path}/p")
    frame = lambda *rows: spark.createDataFrame(list(rows), "name string, content string")
    told = lambda df: sorted((r.name, r.version, r.outcome) for r in df.collect())
    assert told(out.publish(frame(("a", "1"), ("a", "1"), ("b", ""), (None, "x"), ("c", None)))) == [("a", 1, "created"), ("b", 1, "created")]
    assert told(out.publish(frame(("a", "1"), ("a", "2"), ("d", "4")))) == [("a", 1, "existing"), ("a", 2, "versioned"), ("d", 1, "created")]
    assert told(out.publish(frame(("a", "3"), ("e", "5")), versions=False)) == [("a", None, "refused"), ("e", 1, "created")]

    def fail():
        raise InterruptedError

    with pytest.raises(InterruptedError):
        out.publish(frame(("z", "never")), before_commit=fail)
    broken = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception, match="division"):
        out.publish(frame(("y", "never")).withColumn("content", broken("content")))
    # a second writer is first with the same name and another content
    raced = []
    race = lambda: raced or raced.append(told(Published(spark, out.root).publish(frame(("n", "theirs")))))
    assert told(out.publish(frame(("n", "mine")), before_commit=race)) == [("n", 2, "versioned")] and raced == [[("n", 1, "created")]]
    held = sorted((r.name, r.version, r.content) for r in out.contents().collect())
    assert held == [("a", 1, "1"), ("a", 2, "2"), ("b", 1, ""), ("d", 1, "4"), ("e", 1, "5"), ("n", 1, "theirs"), ("n", 2, "mine")]
    assert out.vacuum() >= 2 and sorted((r.name, r.version, r.content) for r in out.contents().collect()) == held and out.vacuum() == 0


# Components -----------------------------------------------------------------------------------------------------------


def brute_components(rows):
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, keys in rows:
        for k in keys or []:
            if i is not None and k is not None:
                a, b = sorted((find(i), find(first.setdefault(k, i))))
                parent[b] = a
    return sorted((i, find(i)) for i in parent)


def test_growing_components_equal_the_full_run(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, [f"k{rng.randrange(70)}" for _ in range(rng.randrange(3))]) for i in range(100)]
    rows += [(200, None), (201, [None, "k1"]), (None, ["k2"]), (3, ["k5"]), (4, ["new"]), (300, ["hot"])] + [(i, ["hot"]) for i in range(400, 430)]
    rng.shuffle(rows)
    grown = GrowingComponents(spark, f"{tmp_path}/c")
    schema = "item long, keys array<string>"
    assert grown.labels().collect() == []
    before = {}
    for k in range(4):
        grown.add(spark.createDataFrame(rows[k::4], schema))
        files = {str(p): p.stat().st_mtime_ns for d in ("items", "keys", "moves") for p in (tmp_path / "c" / d).rglob("*.parquet")}
        assert all(files[p] == t for p, t in before.items())  # nothing is written again
        before = files
        assert sorted(map(tuple, grown.labels().collect())) == brute_components([r for j in range(k + 1) for r in rows[j::4]])
    assert not [n for n in names_in(spark, f"{tmp_path}/c") if n.startswith("work")]


def shuffled(spark):
    """Bytes that the application has written to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_growing_components_shuffle_keys_few_times(spark, tmp_path):
    rng = random.Random(8)
    keys = [f"{rng.getrandbits(1 << 13):02048x}" for _ in range(600)]
    rows = [(i, [keys[i], keys[i // 3 * 3]]) for i in range(600)]
    grown = GrowingComponents(spark, f"{tmp_path}/c")
    for k in range(2):
        lot = spark.createDataFrame(rows[k::2], "item long, keys array<string>").coalesce(4).localCheckpoint()
        before = shuffled(spark)
        grown.add(lot)
        assert shuffled(spark) - before < 5 * sum(len(key) for _, of in rows[k::2] for key in set(of))
    assert sorted(map(tuple, grown.labels().collect())) == brute_components(rows)


def test_growing_components_with_stale_and_recurring_names(spark, tmp_path):
    lots = [
        [(10, ["a"]), (20, ["b"]), (30, ["c"]), (40, ["d"])],
        [(15, ["b", "c"]), (41, ["d", None, "d"])],  # 20 and 30 go into 15
        [(5, ["c"]), (30, []), (40, None), (50, ["e"])],  # 15 goes into 5, and 20 and 30 with it
        [(20, ["e"]), (2, ["d"]), (50, ["e"])],  # 20 comes again under its old name
        [(1, ["a", "e"]), (2, ["b"])],
    ]
    grown = GrowingComponents(spark, f"{tmp_path}/c")
    for k, lot in enumerate(lots):
        grown.add(spark.createDataFrame(lot, "item long, keys array<string>"))
        assert sorted(map(tuple, grown.labels().collect())) == brute_components([r for l in lots[: k + 1] for r in l])


# Pages and intervals --------------------------------------------------------------------------------------------------


def test_pages_by_key_are_the_whole_in_order(spark, tmp_path):
    from lexloom.operators.paging import PagedTable

    rng = random.Random(2)
    rows = [(None if rng.random() < 0.1 else rng.randrange(9), i) for i in range(157)]
    for keys, order in ((["-a", "i"], lambda r: (r[0] is None, -(r[0] or 0), r[1])), (["a", "-i"], lambda r: (r[0] is not None, r[0] or 0, -r[1]))):
        table = PagedTable(spark, keys, f"{tmp_path}/{keys[0]}")
        table.write(spark.createDataFrame(rows, "a int, i int"), 5)
        got, after, pages = [], None, 0
        while pages == 0 or after is not None:
            page, after = table.page(after, 40)
            got, pages = got + [tuple(r) for r in page], pages + 1
        assert got == sorted(rows, key=order) and pages == 4
    empty = PagedTable(spark, ["i"], f"{tmp_path}/empty")
    empty.write(spark.createDataFrame([], "a int, i int"))
    assert empty.page() == ([], None)


def test_interval_join_in_cells(spark):
    from lexloom.operators.verification import interval_join

    rng = random.Random(3)
    cut = lambda n, most: [(rng.choice([1, 1, 1, 2, None]), s, s + rng.choice([0, 1, 3, rng.randrange(most), -2])) for s in (rng.randrange(-50, 5000) for _ in range(n))]
    a, b = cut(400, 90) + [(1, 0, 5000), (1, None, 4)], cut(500, 700) + [(1, -10, 1 << 40), (2, 7, None)]
    got = interval_join(spark.createDataFrame(a, "doc_id int, s long, e long"), spark.createDataFrame(b, "doc_id int, start_at long, end_at long"))
    want = [(d, s, e, x, y) for d, s, e in a for k, x, y in b if d == k and None not in (d, s, e, x, y) and x < e and y > s]
    assert sorted(tuple(r[c] for c in ("doc_id", "s", "e", "start_at", "end_at")) for r in got.collect()) == sorted(want)
