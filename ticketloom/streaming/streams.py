"""Structured Streaming versions of the ticket facts and the latest survey answer."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import REOPEN_HOURS


def latest_response_stream(answers: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Latest answer per ticket, for update mode. `responded_ts` is a TIMESTAMP.

    Answers are grouped by ticket and month of the answer, so that finished months can leave the
    state; readers take the maximum over the few rows of a ticket.
    """
    late = answers.withWatermark("responded_ts", lateness)
    month = F.window("responded_ts", "28 days")
    last = F.max(F.struct("responded_ts", "response_key", "satisfaction_bucket")).alias("l")
    return late.groupBy(month, "ticket_id").agg(last).select("ticket_id", "l.*")


TICKET_OUTPUT = (
    "session_id string, ai_first boolean, outcome string, reopen_lifetime long, reopen_within_7d int, ai_reply_count long, turn_count long")
REOPEN_US = REOPEN_HOURS * 3600 * 1_000_000


class Ticket:
    """Facts of one ticket, of fixed size, and the traces that can still decide the seven-day question.

    A trace is known by its place [turn, microseconds, id]. `best` is the highest place within seven
    days of the first one: the customer came back if it is above the deciding place. It only has to be
    looked for again among the kept places when another trace turns out to be the first.
    """

    FIELDS = ("first", "deciding", "decided_by_ai", "last", "last_ai", "ai_replies", "traces", "transfers", "closed", "again", "best", "due", "kept", "stored")
    __slots__ = (*FIELDS, "moved")

    def __init__(self, values=(None, None, None, None, None, 0, 0, 0, False, False, None, None, None, 0)):
        for name, value in zip(self.FIELDS, values):
            setattr(self, name, value)
        self.kept = self.kept or []
        self.moved = False

    def values(self) -> list:
        return [getattr(self, name) for name in self.FIELDS]

    def add(self, at: list, ai: bool, transfer: bool) -> None:
        if self.first is None or at < self.first:
            self.moved |= self.first is not None
            self.first = at
        if (ai or transfer) and (self.deciding is None or at < self.deciding):
            self.deciding, self.decided_by_ai = at, ai
        if self.last is None or at >= self.last:
            self.last, self.last_ai = at, ai
        self.ai_replies += ai
        self.traces += 1
        self.transfers += transfer
        if not self.closed or at[1] <= self.first[1] + REOPEN_US:
            self.kept.append(at)
            self.look_at([at])

    def look_at(self, places: Iterable[list]) -> None:
        start, end = self.first[1], self.first[1] + REOPEN_US
        for at in places:
            if start < at[1] <= end and (self.best is None or at > self.best):
                self.best = at

    def came_back(self) -> bool:
        """Whether a trace after the deciding one lies within seven days of the first."""
        return self.again or (self.deciding is not None and self.best is not None and self.best > self.deciding)

    def row(self, session_id) -> tuple:
        ai_first = self.deciding is not None and self.decided_by_ai
        outcome = "unclassified" if self.deciding is None else "direct_cs" if not ai_first else "ai_then_cs" if self.transfers else "ai_end_to_end"
        returns, again = (self.ai_replies - int(self.last_ai), int(self.came_back())) if ai_first else (None, None)
        return session_id, ai_first, outcome, returns, again, self.ai_replies, self.traces


class TicketState(StatefulProcessor):
    """Facts of tickets as their traces arrive.

    The key is a shard of tickets, since each call for a key costs far more than a row. A shard keeps its
    tickets in pages of about PAGE tickets, found by a hash of the id; twice as many pages are made when
    they are full, so a batch reads and writes the pages of its own tickets only, however many there are.
    Kept places of a ticket beyond KEPT are stored in rows of their own and not written again.

    A ticket is closed 168 hours after its first trace plus the allowed lateness. That drops its kept
    places only; the facts stay, so a customer who comes back later is still counted. The one event-time
    timer of a shard is that of its next ticket.
    """

    PAGE, KEPT = 128, 256

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # JSON: the number of tickets, and by page when its next ticket is due
        self.shape = handle.getValueState("shape", "index string")
        self.stored_pages = handle.getMapState("pages", "page int", "tickets string")
        self.stored_places = handle.getMapState("places", "session_id string, part int", "places string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        touched: dict = {}
        for batch in rows:
            for session_id, trace_id, turn, us, ai, transfer in zip(*[batch[c].tolist() for c in ("session_id", "trace_id", "turn", "us", "is_ai", "is_transfer")]):
                ticket = touched.get(session_id) or touched.setdefault(session_id, self._ticket(session_id))
                ticket.add([int(turn), int(us), trace_id], bool(ai), bool(transfer))
                if len(ticket.kept) >= self.KEPT:
                    self.stored_places.updateValue((session_id, ticket.stored), (json.dumps(ticket.kept),))
                    ticket.kept, ticket.stored = [], ticket.stored + 1
        for session_id, ticket in touched.items():
            if ticket.moved:
                self._look_again(session_id, ticket)
            if not ticket.closed:
                ticket.due = max((ticket.first[1] + REOPEN_US) // 1000, timerValues.getCurrentWatermarkInMs()) + 1
            self.changed.add(self._page(session_id))
        self._store()
        yield self._frame(touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open()
        now, closed = timerValues.getCurrentWatermarkInMs(), {}
        for page, due in enumerate(self.due):
            if due is not None and due <= now:
                for session_id, ticket in self._tickets(page).items():
                    if ticket.due is not None and ticket.due <= now:
                        closed[session_id] = ticket
                self.changed.add(page)
        for session_id, ticket in closed.items():
            for part in range(ticket.stored):
                self.stored_places.removeKey((session_id, part))
            ticket.again, ticket.closed = ticket.came_back(), True
            ticket.best, ticket.due, ticket.kept, ticket.stored = None, None, [], 0
        self._store()
        if closed:
            yield self._frame(closed)

    def _open(self) -> None:
        index = self.shape.get()
        self.count, self.due = json.loads(index[0]) if index else (0, [None])
        self.timer = min((d for d in self.due if d is not None), default=None)
        self.pages: dict = {}
        self.changed: set = set()

    def _page(self, session_id) -> int:
        return zlib.crc32((session_id or "").encode()) & (len(self.due) - 1)

    def _tickets(self, page: int) -> dict:
        if page not in self.pages:
            stored = self.stored_pages.getValue((page,))
            self.pages[page] = {session_id: Ticket(values) for session_id, values in json.loads(stored[0])} if stored else {}
        return self.pages[page]

    def _ticket(self, session_id) -> Ticket:
        tickets = self._tickets(self._page(session_id))
        if session_id not in tickets:
            tickets[session_id] = Ticket()
            self.count += 1
        return tickets[session_id]

    def _look_again(self, session_id, ticket: Ticket) -> None:
        ticket.best, ticket.moved = None, False
        ticket.look_at(ticket.kept)
        for part in range(ticket.stored):
            ticket.look_at(json.loads(self.stored_places.getValue((session_id, part))[0]))

    def _store(self) -> None:
        """Writes the changed pages and the index, and sets the timer of the next ticket."""
        if self.count > self.PAGE * len(self.due):
            every = [item for page in range(len(self.due)) for item in self._tickets(page).items()]
            while self.count > self.PAGE * len(self.due):
                self.due = self.due * 2
            self.pages, self.changed = {page: {} for page in range(len(self.due))}, set(range(len(self.due)))
            for session_id, ticket in every:
                self.pages[self._page(session_id)][session_id] = ticket
        for page in self.changed:
            tickets = self.pages[page]
            self.stored_pages.updateValue((page,), (json.dumps([[session_id, ticket.values()] for session_id, ticket in tickets.items()]),))
            self.due[page] = min((t.due for t in tickets.values() if t.due is not None), default=None)
        self.shape.update((json.dumps([self.count, self.due]),))
        due = min((d for d in self.due if d is not None), default=None)
        if due != self.timer:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

    def _frame(self, tickets: dict) -> pd.DataFrame:
        session_id, ai_first, outcome, returns, again, replies, traces = zip(*[ticket.row(session_id) for session_id, ticket in tickets.items()])
        return pd.DataFrame({
            "session_id": session_id, "ai_first": ai_first, "outcome": outcome, "reopen_lifetime": pd.array(returns, dtype="Int64"),
            "reopen_within_7d": pd.array(again, dtype="Int32"), "ai_reply_count": replies, "turn_count": traces})

    def close(self) -> None:
        pass


def ticket_state_stream(traces: DataFrame, lateness: str = "1 hour", shards: int = 1024) -> DataFrame:
    """Running ticket facts. Needs the RocksDB state store; `ts` is a TIMESTAMP. `shards` bounds the number
    of tasks and must stay as it is as long as the stream's checkpoint is used."""
    shard = F.pmod(F.xxhash64("session_id"), F.lit(shards)).alias("shard")
    rows = traces.select(shard, "session_id", "trace_id", "turn", "ts", F.unix_micros("ts").alias("us"), "is_ai", "is_transfer").withWatermark("ts", lateness)
    return rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=TicketState(), outputStructType=TICKET_OUTPUT, outputMode="Update", timeMode="EventTime")
