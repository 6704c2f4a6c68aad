"""First sighting of each value in a stream, with state that ends."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from piitrace.operators import extract

SIGHTING = ("scenario_id BIGINT, value STRING, log_id BIGINT, pattern_id STRING, pii_type STRING, "
            "seen_us BIGINT")
SIGHTED = Row(*(x.split()[0] for x in SIGHTING.split(", ")))


class FirstSighting(StatefulProcessor):
    """Keeps the smallest sighting of a value, by event time, line, pattern and place in the line, and gives it out once the watermark has passed it, when
    no earlier one can come any more. Rows may arrive in any order within the watermark's delay. A
    value that was given out is remembered for ``keep_ms`` of event time and then forgotten; sightings
    that arrive before it is given out belong to it."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One state, so that a value is read and written in one call each; ``until_ms`` is 0 until it was given out.
        self.state = handle.getValueState("sighting", "seen_us BIGINT, log_id BIGINT, pattern_ord INT, match_ord INT, "
                                          "pattern_id STRING, pii_type STRING, until_ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.state.get()
        before, until = (None, 0) if kept is None else (tuple(kept)[:-1], kept[-1])
        given = before if before and not until and _due(before) <= timerValues.getCurrentWatermarkInMs() else None
        if given:
            self.handle.deleteTimer(_due(given))
            until = _due(given) + self.keep_ms
        best = before = None if until else before
        for r in rows:
            if r.seen_us >= until * 1000:
                found = (r.seen_us, r.log_id, r.pattern_ord, r.match_ord, r.pattern_id, r.pii_type)
                best = found if best is None else min(best, found)
        if best != before:
            if until and not given:
                self.handle.deleteTimer(until)
            elif before is not None:
                self.handle.deleteTimer(_due(before))
            self.state.update((*best, 0))
            self.handle.registerTimer(_due(best))
        elif given:
            self.state.update((*given, until))
            self.handle.registerTimer(until)
        if given:
            yield self._row(key, given)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *best, until = self.state.get()
        if until:
            self.state.clear()
            return
        until = _due(best) + self.keep_ms
        self.state.update((*best, until))
        self.handle.registerTimer(until)
        yield self._row(key, best)

    @staticmethod
    def _row(key, best) -> Row:
        return SIGHTED(key[0], key[1], best[1], best[4], best[5], best[0])

    def close(self) -> None:
        pass


def _due(best: tuple) -> int:
    """The first millisecond after a sighting."""
    return best[0] // 1000 + 1


def first_sightings(lines: DataFrame, delay: str = "1 day", keep_ms: int = 7 * 86_400_000,
                    profile: str = "demo") -> DataFrame:
    """Per (scenario, value) the first sighting by (event time, line, pattern, place in the line).

    It leaves when the watermark, ``delay`` behind the latest line, has passed it; any later line moves
    the watermark on, whether or not it holds a value. A value is seen anew ``keep_ms`` after its sighting.
    Needs the RocksDB state store, see ``streams.drain_stateful``.
    """
    c = F.col
    found = extract.line_matches(lines.withWatermark("ts", delay), "line", ("scenario_id", "log_id", "ts"), profile)
    rows = found.select("scenario_id", "value", F.unix_micros("ts").alias("seen_us"), "log_id",
                        c("pattern_ord").cast("int"), c("match_ord").cast("int"), "pattern_id", "pii_type", "ts")
    return rows.groupBy("scenario_id", "value").transformWithState(
        FirstSighting(keep_ms), outputStructType=SIGHTING, outputMode="append", timeMode="EventTime")
