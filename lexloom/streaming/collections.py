"""Collections of citing cases as keyed state: one state machine per collection and provider in Spark's state store.

Answers of providers arrive as a stream, in any order and more than once. A machine holds a cursor: the page (or the partition and
offset) that it waits for. What comes ahead of the cursor is held in the state until its turn, what was taken already is dropped,
and so the state after all answers doesn't depend on how they were dealt out to batches, nor on restarts. Every batch tells, for
the machines that it moved, their state and the answer they wait for next, which is what is to be fetched.

States: running; paused or blocked after a failed answer, until the same answer comes well; capped at a limit of pages, until a
higher one comes; exhausted; blocked for good where a partition at the provider's last offset can't be split, or where a split
collection ends, as parts don't prove the whole; failed without an id by which to ask. A timer asks again for what a paused
machine waits for, some times, and then blocks it.

Defined results: answers without a run, provider or event id are left out; those of a machine that was never opened are held. Of
several answers of one id that wait together a good one counts, else any. Opening a second time changes nothing, and a
higher limit that comes before the collection is opened is lost.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexloom.operators.journal import latest
from lexloom.session import shared_dir

ANSWERS = (
    "run_id string, provider string, event_id string, results int, reached_end boolean, failure string, cited_by_id string, court string, year_lo int, year_hi int, max_pages int"
)
STATES = (
    "run_id string, provider string, status string, waits_for string, pages_completed long, raw_results long, completed_partitions long, pending_partitions long, "
    "expanded_partitions long, partitioned boolean, held long, tries long, error string"
)
#: The columns of an answer that move a machine, and of a state.
TAKEN, TOLD = [c.split()[0] for c in ANSWERS.split(", ")[2:]], [c.split()[0] for c in STATES.split(", ")]
#: Event ids that open a collection and that raise its limit of pages.
OPEN, RESUME = "open", "resume"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")[:90] or "case"


def _number(x) -> int | None:
    return None if x is None else int(x)


def _given(x):
    """A cell of a frame, whose nulls may be NaN or NA."""
    return None if x is None or x is pd.NA or x != x else x


@dataclass(frozen=True)
class Limits:
    """What a provider shows, and how often a paused machine asks again."""

    page: int = 20
    last_offset: int = 980
    first_year: int = 1600
    last_year: int = 2100
    courts: tuple[str, ...] = ()
    retry_ms: int | None = None
    tries: int = 3


@dataclass
class Machine:
    """The state of one collection at one provider."""

    provider: str
    limits: Limits
    status: str = "new"
    next_page: int = 1
    pages: int = 0
    raw: int = 0
    done: int = 0
    split: int = 0
    tries: int = 0
    max_pages: int | None = None
    error: str | None = None
    final: bool = False
    #: Of Scholar: [id, court, first year, last year, offset], the one in work first.
    parts: list[list] = field(default_factory=list)

    def open(self, cited_by_id: str | None, court: str | None, low: int | None, high: int | None, max_pages: int | None) -> None:
        if self.status != "new":
            return
        self.max_pages = max_pages
        if cited_by_id is None:
            self.status, self.error, self.final = "failed", f"the seed has no id of {self.provider}", True
            return
        self.status = "running"
        if self.provider == "scholar":
            own = self.limits
            self.parts = [["root", court, own.first_year if low is None else low, own.last_year if high is None else high, 0]]
            self._settle()

    def raise_limit(self, max_pages: int | None) -> None:
        """A higher limit of pages (none: no limit) lets a capped machine go on."""
        if self.max_pages is None or (max_pages is not None and max_pages <= self.max_pages):
            return
        self.max_pages = max_pages
        if self.status == "capped":
            self.status, self.error = "running", None

    def waits_for(self) -> str | None:
        if self.final or self.status in ("new", "capped", "exhausted"):
            return None
        if self.provider != "scholar":
            return f"{self.provider}:page:{self.next_page}"
        return f"scholar:{self.parts[0][0]}:offset:{self.parts[0][4]}"

    def past(self, event_id: str) -> bool:
        """Whether an answer can't be waited for any more."""
        if self.status == "new":
            return False
        if self.final or self.status == "exhausted":
            return True
        head, _, place = event_id.rpartition(":")
        if not place.isdigit():
            return True
        if self.provider != "scholar":
            return head != f"{self.provider}:page" or int(place) < self.next_page
        name = head.removeprefix("scholar:").removesuffix(":offset")
        return not any(name == p[0] and int(place) >= p[4] or name.startswith(f"{p[0]}/") for p in self.parts)

    def fail(self, failure: str) -> None:
        self.status, self.error = ("paused" if failure == "transient" else "blocked"), failure

    def take(self, results: int, reached_end: bool | None) -> None:
        """The answer that it waits for."""
        self.status, self.error, self.tries = "running", None, 0
        self.raw, self.pages = self.raw + results, self.pages + 1
        full = results >= self.limits.page
        ended = not full if reached_end is None else reached_end
        if self.provider != "scholar":
            self.next_page += 1
            if ended:
                self.status = "exhausted"
        else:
            self._take_partition(full, ended)
        if self.status == "running" and self.max_pages is not None and self.pages >= self.max_pages:
            self.status, self.error = "capped", f"stopped at the limit of {self.max_pages} pages"

    def _take_partition(self, full: bool, ended: bool) -> None:
        part = self.parts[0]
        at_last = part[4] >= self.limits.last_offset
        if ended and not (at_last and full):
            self.parts.pop(0)
            self.done += 1
            self._settle()
        elif not at_last:
            part[4] += self.limits.page
        elif children := self._children(part):
            self.parts[:1] = children
            self.split += 1
            self._settle()
        else:
            self.status, self.final, self.error = "blocked", True, f"partition can't be split: {part[0]}"

    def _children(self, part: list) -> list[list]:
        name, court, low, high, _ = part
        if not court:
            return [[f"{name}/court-{i}-{_slug(c)}", c, low, high, 0] for i, c in enumerate(self.limits.courts, 1)]
        middle = (low + high) // 2
        return [[f"{name}/{a}-{b}", court, a, b, 0] for a, b in ((low, middle), (middle + 1, high))] if low < high else []

    def _settle(self) -> None:
        """Leaves out partitions without years, and ends where none is left."""
        while self.parts and self.parts[0][2] > self.parts[0][3]:
            self.parts.pop(0)
            self.done += 1
        if not self.parts:
            self.final = True
            self.status, self.error = ("blocked", "the parts of a split collection don't prove that it is complete") if self.split else ("exhausted", None)

    def dump(self) -> str:
        return json.dumps({k: v for k, v in vars(self).items() if k != "limits"})

    def row(self, run_id: str, held: int) -> tuple:
        return (run_id, self.provider, self.status, self.waits_for(), self.pages, self.raw, self.done, len(self.parts), self.split, self.split > 0, held, self.tries, self.error)


class RowCollector(StatefulProcessor):
    """Moves the machines of one key by its answers, which come as rows of one JSON text, as do the states that it tells.

    Calls of the state store pass through a socket each, so a machine is one value: it is read and written once a batch, together
    with what it holds, all of which a batch looks through anyway. Rows are read cell by cell, so that they have few.
    """

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "state string, held string")

    def _load(self, provider: str) -> tuple[Machine, dict[str, list]]:
        """The machine, and what came ahead of its turn: [results, reached_end, failure] by event id."""
        state, held = map(json.loads, self.machine.get() or (json.dumps({"provider": provider}), "{}"))
        return Machine(limits=self.limits, **state), held

    def _answers(self, rows) -> Iterator[tuple]:
        """What came, in the order of TAKEN."""
        for row in rows:
            answer = json.loads(row[2])
            yield tuple(map(answer.get, TAKEN))

    def _out(self, told: tuple):
        return Row(told=json.dumps(dict(zip(TOLD, told, strict=True))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        m, held = self._load(key[1])
        for event_id, results, reached_end, failure, cited_by_id, court, low, high, max_pages in self._answers(rows):
            if event_id == OPEN:
                m.open(cited_by_id, court, _number(low), _number(high), _number(max_pages))
            elif event_id == RESUME:
                m.raise_limit(_number(max_pages))
            elif not m.past(event_id):
                known = held.get(event_id)
                if known is None or known[2] is not None:
                    held[event_id] = [_number(results) or 0, None if reached_end is None else bool(reached_end), failure]
        while (wanted := m.waits_for()) and wanted in held:
            results, reached_end, failure = held.pop(wanted)
            if failure is not None:
                m.fail(failure)
                self._ask_again(m, timerValues)
                break
            m.take(results, reached_end)
        yield self._told(key, m, held)

    def _ask_again(self, m: Machine, timerValues) -> None:
        if self.limits.retry_ms is not None and m.status == "paused":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limits.retry_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        m, held = self._load(key[1])
        if m.status == "paused":
            m.tries += 1
            if m.tries >= self.limits.tries:
                m.status, m.error = "blocked", f"no good answer after {m.tries} tries"
            self._ask_again(m, timerValues)
            yield self._told(key, m, held)

    def _told(self, key, m: Machine, held: dict[str, list]):
        held = {event_id: answer for event_id, answer in held.items() if not m.past(event_id)}
        self.machine.update((m.dump(), json.dumps(held)))
        return self._out(m.row(key[0], len(held)))

    def close(self) -> None:
        pass


class Collector(RowCollector):
    """The same for answers that come as frames. A frame a key costs more than its answers, so that advance() takes rows."""

    def _answers(self, rows) -> Iterator[tuple]:
        for frame in rows:
            yield from zip(*(map(_given, frame[c].tolist()) for c in TAKEN), strict=True)

    def _out(self, told: tuple) -> pd.DataFrame:
        return pd.DataFrame([told], columns=TOLD)


def advance(answers: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The states that a stream of answers (ANSWERS) leads to: a row for every machine that a batch or a timer moved."""
    rows = answers.where("run_id IS NOT NULL AND provider IS NOT NULL AND event_id IS NOT NULL").select("run_id", "provider", F.to_json(F.struct(*TAKEN)).alias("answer"))
    timed = "ProcessingTime" if limits.retry_ms is not None else "None"
    told = rows.groupBy("run_id", "provider").transformWithState(RowCollector(limits), "told string", "Update", timed)
    return told.select(F.from_json("told", STATES, {"mode": "FAILFAST"}).alias("told")).select("told.*")


class Collections:
    """Collections below a shared folder: the checkpoint of their stream and the states that its batches told."""

    def __init__(self, spark: SparkSession, root: str | None = None, limits: Limits = Limits()) -> None:
        self.spark, self.limits = spark, limits
        self.root = root or f"{shared_dir(spark)}/lexloom-collections-{uuid.uuid4().hex}"

    def start(self, answers: DataFrame, **trigger):
        """The running stream. A batch that is run again after a failure writes its own folder again."""

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.root}/states/batch={number}")

        kind = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(kind)
        self.spark.conf.set(kind, ROCKSDB)  # the one that holds maps and timers; a stream keeps the settings that it starts with
        try:
            return advance(answers, self.limits).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{self.root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
        finally:
            self.spark.conf.set(kind, before)

    def run(self, answers: DataFrame) -> None:
        """Takes all answers that are there, from where the last run ended."""
        self.start(answers).awaitTermination()

    def states(self) -> DataFrame:
        """The last state of every machine."""
        told = self.spark.read.option("basePath", f"{self.root}/states").schema(f"{STATES}, batch long").parquet(f"{self.root}/states")
        columns = [c for c in told.columns if c not in ("run_id", "provider", "batch")]
        return latest(told, ["run_id", "provider"], F.col("batch"), columns)


def answers_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(ANSWERS).parquet(folder)
