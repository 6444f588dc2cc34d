"""When runs of a sync begin: on a schedule, on request, and not before a failed one's wait is over.

The state of a source is a few values; `apply` says what an event makes of them, `claim` whether a run begins
at a time, and `next_due` when it is worth looking again. The streaming operator keeps them by source and
sets a timer for that time, so a scheduled run needs no event.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Hours between runs, minutes to wait after a failure.
INTERVAL_HOURS, RETRY_MINUTES = 6, 15
MINUTE = 60_000_000
EVENTS = ("request", "done", "failed", "enable", "disable", "look")


@dataclass(frozen=True)
class Trigger:
    """Times are microseconds; null: never."""

    last_success: int | None = None
    retry_after: int | None = None
    running: bool = False
    requested: bool = False
    enabled: bool = True


def apply(state: Trigger, kind: str, at: int, retry_minutes: int = RETRY_MINUTES) -> Trigger:
    """A request waits for its run; an end that no run has had changes nothing; a success clears the wait, a failure sets it."""
    if kind not in EVENTS:
        raise ValueError(f"unknown event {kind}")
    if kind == "request":
        return replace(state, requested=True)
    if kind in ("enable", "disable"):
        return replace(state, enabled=kind == "enable")
    if kind == "look" or not state.running:
        return state
    if kind == "done":
        return replace(state, running=False, last_success=at, retry_after=None)
    return replace(state, running=False, retry_after=at + min(max(retry_minutes, 1), 1440) * MINUTE)


def claim(state: Trigger, at: int, interval_hours: int = INTERVAL_HOURS) -> tuple[Trigger, str | None]:
    """The state after a look at this time, and `manual` or `scheduled` if a run begins. A request overrides schedule, wait and switch, but no running run."""
    if state.running:
        return state, None
    waits = state.retry_after is not None and state.retry_after > at
    due = state.last_success is None or at >= state.last_success + interval_hours * 60 * MINUTE
    kind = "manual" if state.requested else "scheduled" if state.enabled and due and not waits else None
    return (replace(state, running=True, requested=False), kind) if kind else (state, None)


def next_due(state: Trigger, at: int, interval_hours: int = INTERVAL_HOURS) -> int | None:
    """When a run may begin by itself; null while one runs or the schedule is off."""
    if state.running or not state.enabled:
        return None
    due = at if state.last_success is None else state.last_success + interval_hours * 60 * MINUTE
    return max(at, due, state.retry_after or 0)


SCHEMA = "last_success long, retry_after long, running boolean, requested boolean, enabled boolean"


class Runs(StatefulProcessor):
    """Events of each source in order; a timer by the clock or the watermark looks again when a run is due."""

    def __init__(self, interval_hours: int, retry_minutes: int, timers: bool) -> None:
        self.interval_hours, self.retry_minutes, self.timers = interval_hours, retry_minutes, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", SCHEMA)

    def _kept(self, state: Trigger, at: int) -> None:
        self.state.update(astuple(state))
        if self.timers:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            if (due := next_due(state, at, self.interval_hours)) is not None:
                self.handle.registerTimer(due // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state = Trigger(*self.state.get()) if self.state.exists() else Trigger()
        begun, at = [], 0
        for row in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            at = int(row.at)
            state, kind = claim(apply(state, row.kind, at, self.retry_minutes), at, self.interval_hours)
            if kind:
                begun.append((key[0], at, kind))
        self._kept(state, at)
        yield pd.DataFrame(begun, columns=["source", "at", "trigger"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        state, kind = claim(Trigger(*self.state.get()) if self.state.exists() else Trigger(), at, self.interval_hours)
        self._kept(state, at)
        yield pd.DataFrame([(key[0], at, kind)] if kind else [], columns=["source", "at", "trigger"])

    def close(self) -> None:
        pass


def runs(events: DataFrame, interval_hours: int = INTERVAL_HOURS, retry_minutes: int = RETRY_MINUTES, timers: bool = False) -> DataFrame:
    """(source, at, trigger) of the runs that begin, of a stream of (source, at, seq, kind); a look follows each event.

    With `timers` a run that is due by the clock begins without an event.
    """
    kind = events.schema["source"].dataType.simpleString()
    return events.select("source", "at", "seq", "kind").groupBy("source").transformWithStateInPandas(
        Runs(interval_hours, retry_minutes, timers), f"source {kind}, at long, trigger string", "Update", "ProcessingTime" if timers else "None"
    )


def micros(at: dt.datetime) -> int:
    return int(at.timestamp()) * 1_000_000 + at.microsecond
