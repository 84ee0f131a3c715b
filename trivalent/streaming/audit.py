"""The audit of checkpoints while they are written: what a run has said is state, and each event is judged as it comes.

A run's requests, segments, sources and inputs are entries of pages in the state store, packed. A micro-batch reads and
writes each page that it touches once, not each entry; a run has more pages as it grows, so a long run is no one value that is
read and written whole. The events of a run must come in order from one micro-batch to the next; within one they are put in order.
"""

from __future__ import annotations

import json
import zlib
from collections import namedtuple
from collections.abc import Iterator
from operator import attrgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trivalent.operators.audit import CALLS, FAILURES, OBSERVATIONS, PROVENANCE_FAILURE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAULTS = "run string, at long, fault string"
Pair = tuple[str | None, str | None]


class Notes:
    """What a run has said so far: (kind, key) to a pair of texts; here in memory."""

    def __init__(self) -> None:
        self.entries: dict[tuple[str, str | None], Pair] = {}

    def get(self, kind: str, key: str | None = None) -> Pair | None:
        return self.entries.get((kind, key))

    def put(self, kind: str, key: str | None = None, value: Pair = ("", "")) -> None:
        self.entries[kind, key] = value

    def first(self, kind: str, key: str | None = None, value: Pair = ("", "")) -> None:
        """Note it, unless it is noted."""
        if self.get(kind, key) is None:
            self.put(kind, key, value)


#: Entries that a page has on average before a run's pages are doubled.
PAGE = 4096


class StoredNotes(Notes):
    """Notes of one run in one micro-batch: its pages in the state store (a map from number to packed entries), of which head has how many they are and how many entries."""

    def __init__(self, head, store) -> None:
        self.head, self.store, self.pages, self.changed = head, store, {}, set()
        known = head.get()
        self.n_pages, self.size = known or (1, 0)
        if known is None:
            self.pages[0] = {}

    @staticmethod
    def _at(entry: tuple[str, str | None], n_pages: int) -> int:
        return zlib.crc32(json.dumps(entry).encode()) % n_pages if n_pages > 1 else 0

    def _page(self, at: int) -> dict[tuple[str, str | None], Pair]:
        if at not in self.pages:
            self.pages[at] = {(kind, key): (a, b) for kind, key, a, b in json.loads(zlib.decompress(self.store.getValue((at,))[0]))}
        return self.pages[at]

    def get(self, kind: str, key: str | None = None) -> Pair | None:
        return self._page(self._at((kind, key), self.n_pages)).get((kind, key))

    def put(self, kind: str, key: str | None = None, value: Pair = ("", "")) -> None:
        at = self._at((kind, key), self.n_pages)
        page = self._page(at)
        self.size += (kind, key) not in page
        page[kind, key] = value
        self.changed.add(at)

    def write(self) -> None:
        """Into the state store, what has changed; with more pages if they are full."""
        if not self.changed:
            return
        if self.size > PAGE * self.n_pages:
            entries = [x for at in range(self.n_pages) for x in self._page(at).items()]
            while self.size > PAGE * self.n_pages:
                self.n_pages *= 2
            self.pages = {at: {} for at in range(self.n_pages)}
            for entry, value in entries:
                self.pages[self._at(entry, self.n_pages)][entry] = value
            self.changed = set(self.pages)
        for at in self.changed:
            self.store.updateValue((at,), (zlib.compress(json.dumps([(*entry, *value) for entry, value in self.pages[at].items()]).encode(), 1),))
        self.head.update((self.n_pages, self.size))


def _request(e: Row, notes: Notes, add) -> None:
    """Judge and note dispatches, responses and failures, which belong to a request."""
    pair = (e.segment, e.case_id)
    sent = None if e.request is None else notes.get("dispatch", e.request)
    if e.type == "dispatch":
        add(e.planned_case is None or e.case_id != e.planned_case, "unplanned_dispatch")
        add(sent and sent != pair, "request_reused")
        add(e.protocol == "exact_input" and (not e.native or notes.get("asked", e.planned_sha)), "repeated_inference")
    else:
        add(sent != pair, "response_unmatched" if e.type == "response" else "failure_unmatched")
        add(e.type == "response" and notes.get("response", e.request), "second_response")
        add(e.type == "error" and e.issue == PROVENANCE_FAILURE, "provenance_failure")
    if e.type in CALLS and e.request is not None:
        notes.first(e.type, e.request, pair)


def _observation(e: Row, notes: Notes, add) -> None:
    live, planned = e.type == "observation", e.planned_case is not None
    add(not live and e.protocol == "live", "reuse_not_allowed")
    add(live and e.protocol == "derived", "live_not_allowed")
    add(not planned, "unplanned_observation")
    add(notes.get("observed", e.segment), "repeated_observation")
    add(planned and e.case_id != e.planned_case, "other_case")
    add(planned and e.sha != e.planned_sha, "other_input")
    add(e.config is None or e.config != e.run_config, "other_configuration")
    add(e.score is None or not 0 <= e.score <= 1, "invalid_score")
    if live:
        answer = None if e.request is None else notes.get("response", e.request)
        add(answer != (e.segment, e.case_id), "observation_unmatched")
        add(e.request is not None and notes.get("scored", e.request), "request_scored_twice")
        notes.first("scored", e.request)
        notes.first("origin", e.segment, (e.sha, e.case_id))
        notes.first("asked", e.planned_sha)
    else:
        origin = notes.get("origin", e.source)
        add(e.protocol == "exact_input" and (origin is None or e.sha is None or origin[0] != e.sha), "reuse_before_source")
    if planned and notes.get("observed", e.segment) is None:
        notes.put("count", None, (str(int((notes.get("count") or ("0",))[0]) + 1), ""))
    notes.first("observed", e.segment)


def judge(e: Row, notes: Notes) -> list[str]:
    """The faults of a run's next event, with its plan (PLAN); the notes know it afterwards."""
    found: list[str] = []

    def add(bad, fault: str) -> None:
        if bad:
            found.append(fault)

    add(notes.get("open") is None and e.type != "metadata", "no_metadata")
    add(notes.get("end") and e.type != "complete", "after_completion")
    add(e.type in (*CALLS, *FAILURES) and e.protocol == "derived", "call_not_allowed")
    notes.first("open")
    if e.type in (*CALLS, *FAILURES):
        _request(e, notes, add)
    elif e.type in OBSERVATIONS:
        _observation(e, notes, add)
    elif e.type == "complete":
        notes.first("end", None, notes.get("count") or ("0", ""))
        add(e.expected is None or e.n != e.expected or int(notes.get("end")[0]) != e.expected, "incomplete_completion")
    else:
        add(e.type != "metadata", "unsupported_event")
    return found


class Auditor(StatefulProcessor):
    """Rows have an event each, as JSON: of a row of many columns each column would be taken to Python for itself."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "pages long, entries long")
        self.store = handle.getMapState("pages", "page long", "entries binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = [json.loads(r.event) for r in rows]
        event = namedtuple("Event", rows[0])._make
        notes = StoredNotes(self.head, self.store)
        for e in sorted((event(r.values()) for r in rows), key=attrgetter("at")):
            e = e if e.score is None else e._replace(score=float(e.score))  # JSON names what is no number
            for fault in judge(e, notes):
                yield Row(run=key[0], at=e.at, fault=fault)
        notes.write()

    def close(self) -> None:
        pass


def faults(events: DataFrame) -> DataFrame:
    """(run, at, fault) of a stream of events with their plan, as `operators.audit.with_plan` joins it."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # maps are a matter of this store
    packed = events.select("run", F.to_json(F.struct(*[c for c in events.columns if c != "run"]), {"ignoreNullFields": "false"}).alias("event"))
    return packed.groupBy("run").transformWithState(statefulProcessor=Auditor(), outputStructType=T.StructType.fromDDL(FAULTS), outputMode="Append", timeMode="None")
