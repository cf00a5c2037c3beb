"""Keyed state with event-time timers: deletion requests with their confirmations, and jobs that expire."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from coursebank.functions import text as tx

c = F.col
MINUTE = 60_000_000  # microseconds, the unit of all times in state
SLOT_MS = 6 * 3_600_000
FLUSH = 100_000  # events of an arrival that are held at once
CONFIRM, UNNAMED, REQUEST = range(3)  # in the order of handling at one time; an unnamed request has no id

DELETIONS = "event_id long, email string, accepted boolean, created long, expires long, confirmed long"
JOBS = "job_id long, at long, seq long, percent int, phase string, done boolean, expired boolean"


def _up_to_ms(us: int) -> int:
    """The first millisecond at or after a time."""
    return -(-us // 1000)


class DeletionDesk(StatefulProcessor):
    """Requests and confirmations of one address in the order of their times, whatever order they arrive in.

    Events wait, in slots of time, until the watermark has passed them; a timer per slot then handles what is due in
    order, so memory holds one slot of one address. The rest of the state is the last accepted request and the open
    ones, which are read and written once a slot; a timer at the end of its life forgets an open request. So calls to
    the state follow slots, arrivals and accepted requests, not events.
    """

    def __init__(self, cooldown: int, ttl: int):
        self.cooldown, self.ttl = cooldown, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Parts of a slot hold three numbers an event: time, kind, and the request asked or confirmed.
        self.slots = handle.getMapState("slots", "slot long", "parts long, timer long")
        self.waiting = handle.getMapState("waiting", "slot long, part long", "events binary")
        self.last = handle.getValueState("last", "at long, request long, confirmed boolean")
        self.open = handle.getMapState("open", "request long", "at long")

    def _put(self, events: dict[int, array], known: dict[int, list]) -> None:
        """Add a part to each slot; ``known`` has parts, timer and registered timer of the slots met so far."""
        for slot, some in events.items():
            if slot not in known:
                old = self.slots.getValue((slot,))
                known[slot] = [old[0], old[1], old[1]] if old else [0, None, None]
            at = known[slot]
            self.waiting.updateValue((slot, at[0]), (some.tobytes(),))
            first = _up_to_ms(min(some[::3]))
            at[0], at[1] = at[0] + 1, first if at[1] is None else min(first, at[1])

    def _close_slots(self, known: dict[int, list]) -> None:
        for slot, (parts, timer, registered) in known.items():
            self.slots.updateValue((slot,), (parts, timer))
            if timer != registered:
                self.handle.registerTimer(timer)

    def _take(self, slot: int, parts: int) -> np.ndarray:
        """A slot's events in order, which leave the state."""
        flat = []
        for part in range(parts):
            flat.append(np.frombuffer(bytes(self.waiting.getValue((slot, part))[0]), np.int64))
            self.waiting.removeKey((slot, part))
        self.slots.removeKey((slot,))
        events = np.concatenate(flat).reshape(-1, 3)
        return events[np.lexsort(events.T[::-1])]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, n, known = {}, 0, {}
        for _, _, at, asks, event, request in rows:  # by place: names cost as much as all the rest
            if not asks and request is None:
                continue  # confirms nothing
            kind, of = (CONFIRM, request) if not asks else (UNNAMED, 0) if event is None else (REQUEST, event)
            held.setdefault(_up_to_ms(at) // SLOT_MS, array("q")).extend((at, kind, of))
            n += 1
            if n % FLUSH == 0:
                self._put(held, known)
                held = {}
        self._put(held, known)
        self._close_slots(known)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        time = expiredTimerInfo.getExpiryTimeInMs()
        slot = time // SLOT_MS
        held = self.slots.getValue((slot,))
        if not held or held[1] != time:
            # Timers come in order, so events up to this time, but maybe not up to the watermark, have been handled.
            self._forget(time * 1000)
            return
        events = self._take(slot, held[0])
        due = int(np.searchsorted(events[:, 0], now, "right"))
        yield from self._handle(key[0], events[:due].tolist())
        if due < len(events):
            known = {slot: [0, None, None]}
            self._put({slot: array("q", events[due:].ravel().tolist())}, known)
            self._close_slots(known)

    def _handle(self, email: str, due: list[list[int]]) -> Iterator[Row]:
        stored = {k[0]: v[0] for k, v in self.open.iterator()}
        live = {request: made for request, made in stored.items() if made + self.ttl >= due[0][0]}
        before = last = self.last.get() if self.last.exists() else None
        moment, confirmed_now = None, set()
        for at, kind, request in due:
            if at != moment:
                moment, confirmed_now = at, set()
            if kind == CONFIRM:
                made = live.get(request)
                if made is not None and at <= made + self.ttl:
                    last = self._confirmed(live, last, request)
                    yield self._accepted(email, request, made, at)
                confirmed_now.add(request)
                continue
            event = request if kind == REQUEST else None
            if last and not last[2] and last[0] >= at - self.cooldown:
                yield Row(event_id=event, email=email, accepted=False, created=at, expires=None, confirmed=None)
                continue
            last = (at, event, False)
            if event is None:  # no confirmation can name it
                yield self._accepted(email, event, at, None)
                continue
            live[event] = at
            if event in confirmed_now:
                last = self._confirmed(live, last, event)
                yield self._accepted(email, event, at, at)
            else:
                yield self._accepted(email, event, at, None)
        for request in stored.keys() - live.keys():
            self.open.removeKey((request,))
        for request, made in live.items():
            if stored.get(request) != made:
                self.open.updateValue((request,), (made,))
                self.handle.registerTimer(_up_to_ms(made + self.ttl) + 1)
        if last is not before:
            self.last.update(tuple(last))
            self.handle.registerTimer(_up_to_ms(last[0] + self.ttl) + 1)

    @staticmethod
    def _confirmed(live: dict[int, int], last: tuple | None, request: int) -> tuple | None:
        del live[request]
        return (last[0], request, True) if last and last[1] == request else last

    def _accepted(self, email: str, request: int | None, made: int, at: int | None) -> Row:
        return Row(event_id=request, email=email, accepted=True, created=made, expires=made + self.ttl, confirmed=at)

    def _forget(self, now: int) -> None:
        """Drop open requests whose life is over, and a last request that can refuse no other."""
        for request, (made,) in [(k[0], v) for k, v in self.open.iterator()]:
            if made + self.ttl < now:
                self.open.removeKey((request,))
        last = self.last.get() if self.last.exists() else None
        if last and last[0] + self.ttl < now:
            self.last.clear()

    def close(self) -> None:
        pass


def deletion_stream(events: DataFrame, cooldown: int = 15, ttl_hours: int = 48, delay: str = "1 hour") -> DataFrame:
    """Deletion requests and confirmations as a stream (event_id, ts, email, kind, request_id), in update mode.

    Gives the rows of the batch job ``ledger.deletion_requests`` for all events that the watermark has passed: first
    when a request is decided, again with ``confirmed_at`` when it is confirmed in time; ``latest_deletions`` keeps one
    row each. A confirmation carries the address of the request that it names. Confirmations come before requests of
    the same time. Requests without ``@`` in the address and rows without a time or address are left out, as are rows
    that arrive more than ``delay`` after later ones.
    """
    rows = events.withColumns({"email": F.lower(tx.strip(c("email"))), "ts": c("ts").cast("timestamp")})
    rows = rows.where(c("email").contains("@") & c("ts").isNotNull()).withWatermark("ts", delay)
    rows = rows.select("email", "ts", F.unix_micros("ts").alias("at"), F.when(c("kind") == "confirm", 0).otherwise(1).alias("kind"),
                       c("event_id").cast("long").alias("event_id"), c("request_id").cast("long").alias("request_id"))
    desk = DeletionDesk(cooldown * MINUTE, ttl_hours * 60 * MINUTE)
    out = rows.groupBy("email").transformWithState(desk, DELETIONS, "update", "eventTime")
    times = {"created": "created_at", "expires": "expires_at", "confirmed": "confirmed_at"}
    return out.select("event_id", "email", "accepted", *[F.timestamp_micros(k).alias(v) for k, v in times.items()])


def latest_deletions(updates: DataFrame) -> DataFrame:
    """One row per request from the updates of ``deletion_stream``: a confirmation completes the decision."""
    same = ("accepted", "created_at", "expires_at")
    return updates.groupBy("event_id", "email").agg(*[F.max(x).alias(x) for x in same], F.max("confirmed_at").alias("confirmed_at"))


class JobBoard(StatefulProcessor):
    """Latest progress of one job; a timer drops a finished job ``keep`` after its last report."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, seq long, percent int, phase string, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.latest.get() if self.latest.exists() else None
        best = old
        for r in rows:
            if best is None or (r.at, r.seq) > (best[0], best[1]):
                best = (r.at, r.seq, r.percent, r.phase, r.done)
        if best is old:
            return
        self.latest.update(tuple(best))
        if best[4]:
            # The first millisecond after the job's time is over.
            self.handle.registerTimer((best[0] + self.keep) // 1000 + 1)
        yield Row(job_id=key[0], at=best[0], seq=best[1], percent=best[2], phase=best[3], done=best[4], expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = self.latest.get() if self.latest.exists() else None
        if job and job[4] and job[0] + self.keep < timerValues.getCurrentWatermarkInMs() * 1000:
            self.latest.clear()
            yield Row(job_id=key[0], at=job[0], seq=job[1], percent=job[2], phase=job[3], done=True, expired=True)

    def close(self) -> None:
        pass


def job_board(events: DataFrame, keep: int = 10, delay: str = "1 hour") -> DataFrame:
    """Latest progress of each job (job_id, ts, seq, percent, phase, done) as a stream, in update mode.

    A finished job is dropped ``keep`` minutes after its last report, when the watermark has passed that time: it gives
    a row with ``expired`` and its state goes. Running jobs stay. A missing ``done`` means running; rows without a job,
    time or seq, and rows that arrive more than ``delay`` after later ones, are left out. ``shown_jobs`` gives the table.
    """
    rows = events.withColumn("ts", c("ts").cast("timestamp")).where("job_id IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL")
    rows = rows.withWatermark("ts", delay).select(
        c("job_id").cast("long").alias("job_id"), "ts", F.unix_micros("ts").alias("at"), c("seq").cast("long").alias("seq"),
        c("percent").cast("int").alias("percent"), "phase", F.coalesce("done", F.lit(False)).alias("done"))
    out = rows.groupBy("job_id").transformWithState(JobBoard(keep * MINUTE), JOBS, "update", "eventTime")
    return out.select("job_id", F.timestamp_micros("at").alias("ts"), "percent", "phase", "done", "expired")


def shown_jobs(updates: DataFrame) -> DataFrame:
    """Jobs on the board: the last update of each that has not expired. In a batch, updates come before expiry."""
    rest = ("ts", "percent", "phase", "done")
    last = updates.groupBy("job_id").agg(F.max_by(F.struct(*rest, "expired"), F.struct("batch_no", "expired")).alias("r"))
    return last.where(~c("r.expired")).select("job_id", *[f"r.{x}" for x in rest])
