"""Online scoring that gets past lost steps and forgets idle episodes.

Event time is the time at which an action was received. A step that is missing while later ones wait is
given up once the watermark is ``wait_ms`` behind the first of those; a mark says so, and scoring goes on
with the step that waits. The lost step may still come: it is reported as late and changes nothing.
An episode that receives nothing for ``idle_ms`` loses all its state, and an open one says so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from piitrace.streaming.online import HEAD, RESULT, EpisodeScorer, keyed_actions

#: A result row and what became of the step: applied, missing, late or expired.
TIMED_RESULT = RESULT + ", status STRING"
#: No time.
NEVER = -1


class TimedScorer(EpisodeScorer):
    """Applies the actions of one episode in step order, with an end to waiting."""

    def __init__(self, wait_ms: int, idle_ms: int):
        self.wait_ms, self.idle_ms = wait_ms, idle_ms

    #: Beside the numbers the steps given up, and the times of both timers.
    schema = HEAD + ", skipped STRING, gap BIGINT, idle BIGINT"
    names = (*EpisodeScorer.names, "skipped", "gap", "idle")
    start = (*EpisodeScorer.start, "[]", NEVER, NEVER)
    row = Row(*(x.split()[0] for x in TIMED_RESULT.split(", ")))

    def init(self, handle) -> None:
        super().init(handle)
        self.handle = handle

    # ------------------------------------------------------------ state

    def _fresh(self, kept: tuple) -> dict:
        head = super()._fresh(kept)
        self.skipped = set(json.loads(head["skipped"]))
        return head

    def _forget(self, head: dict) -> None:
        super()._forget(head)
        self.skipped = set()

    def _save(self, head: dict) -> None:
        head["skipped"] = "[]" if head["done"] else json.dumps(sorted(self.skipped))
        super()._save(head)

    def _set_timers(self, head: dict, gap: int, idle: int) -> None:
        """Both timers may be at one time, which the store keeps once."""
        old, new = {head["gap"], head["idle"]} - {NEVER}, {gap, idle} - {NEVER}
        for at in old - new:
            self.handle.deleteTimer(at)
        for at in new - old:
            self.handle.registerTimer(at)
        head["gap"], head["idle"] = gap, idle

    # ------------------------------------------------------------ steps

    def _applied(self, head: dict) -> list[tuple]:
        return [(*r, "applied") for r in self._go_on(head)]

    def _gap(self, head: dict) -> int:
        """When to give up the next step: never, if nothing waits behind it."""
        return NEVER if head["done"] or not self.waiting else self.waiting[min(self.waiting)] + self.wait_ms

    def _mark_row(self, head: dict, step: int, status: str) -> tuple:
        return (step, None, None, float(head["total"]), head["visible"], head["discovered"], head["redacted"],
                False, False, status)

    def _settle(self, head: dict, now: int) -> list[tuple]:
        """Gives up steps whose time has run out and applies what waits behind them."""
        out = self._applied(head)
        while NEVER < self._gap(head) <= now:
            for step in range(head["steps"] + 1, min(self.waiting)):
                self.skipped.add(step)
                out.append(self._mark_row(head, step, "missing"))
                head["steps"] = step
            out += self._applied(head)
        return out

    def _end(self, head: dict) -> list[tuple]:
        """Forgets the episode."""
        out = [] if head["done"] else [self._mark_row(head, head["steps"], "expired")]
        self._set_timers(head, NEVER, NEVER)
        self._forget(head)
        self.head.clear()
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Timers of a batch come after its rows; what is due by now comes first.
        head, now, out = self._load(), timerValues.getCurrentWatermarkInMs(), []
        if self.known:
            out += self._settle(head, now)
            if NEVER < head["idle"] <= now:
                out += self._end(head)
                head = self._fresh(self.start)
        latest = NEVER
        for step, part in sorted(self._by_step(rows).items()):
            times = [r["received_ms"] for r in part]
            latest = max(latest, *times)
            if head["done"]:
                continue
            if step > head["steps"]:
                if step not in self.waiting:
                    self._hold(step, part, min(times))
            elif step in self.skipped:
                self.skipped.remove(step)
                out.append(self._mark_row(head, step, "late"))
        out += self._settle(head, now)
        self._set_timers(head, self._gap(head), max(head["idle"], latest + self.idle_ms))
        self._save(head)
        for r in out:
            yield self.row(key[0], *r)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head, fired, out = self._load(), expiredTimerInfo.getExpiryTimeInMs(), []
        gap, idle = head["gap"], head["idle"]
        # The store has dropped the timer that fired.
        head["gap"], head["idle"] = (NEVER if at == fired else at for at in (gap, idle))
        if fired == gap:
            out += self._settle(head, timerValues.getCurrentWatermarkInMs())
        if fired == idle:
            out += self._end(head)
        elif fired == gap:
            self._set_timers(head, self._gap(head), idle)
            self._save(head)
        for r in out:
            yield self.row(key[0], *r)


def stream_score_timed(records: DataFrame, brings: DataFrame, facts: DataFrame, wait_ms: int, idle_ms: int,
                       delay: str = "10 minutes") -> DataFrame:
    """Scores a stream of action records with ``received_at`` (schema ``ACTION_RECORD`` and a TIMESTAMP).

    As ``stream_score``, with one more column ``status``. A record without an episode is a heartbeat: it
    only moves the watermark, which stays ``delay`` behind. Records older than the watermark are dropped.
    """
    timed = records.withWatermark("received_at", delay)
    joined = keyed_actions(timed, brings, facts, "received_at",
                           ["received_at", F.unix_millis("received_at").alias("received_ms")])
    return joined.groupBy("episode_id").transformWithState(
        TimedScorer(wait_ms, idle_ms), outputStructType=TIMED_RESULT, outputMode="append", timeMode="EventTime")
