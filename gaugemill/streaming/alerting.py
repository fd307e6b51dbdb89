"""Alert rules evaluated as samples arrive, with the state of each series kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_US = 1_000_000
_OUT = "series string, at_us long, phase string, value double"
_STATE = "since long, fired boolean, last long, last_id long"


@dataclass(frozen=True)
class AlertRule:
    """A series alerts while its value is above ``above``: ``pending`` at once, ``firing`` from the first sample
    that comes ``hold`` seconds or more after. The sample that ends it gives ``resolved``, or ``inactive`` if it had
    not fired. Without a sample for ``stale`` seconds a series ends by itself, at that time and without a value."""

    above: float
    hold: int
    stale: int

    def __post_init__(self):
        if self.hold < 0 or self.stale <= 0:
            raise ValueError("hold must be at least 0 and stale above 0")


class Series:
    """The state of one series, and what a sample or silence changes in it."""

    def __init__(self, rule: AlertRule, since: int | None = None, fired: bool = False, last: int | None = None, last_id: int = 0):
        self.rule, self.since, self.fired, self.last, self.last_id = rule, since, fired, last, last_id

    def end(self, at: int, value: float | None) -> Iterator[tuple]:
        if self.since is not None:
            yield at, "resolved" if self.fired else "inactive", value
        self.since, self.fired = None, False

    def silent(self) -> Iterator[tuple]:
        yield from self.end(self.last + self.rule.stale * _US, None)

    def sample(self, at: int, row_id: int, value: float | None) -> Iterator[tuple]:
        if self.last is not None:
            if (at, row_id) <= (self.last, self.last_id):  # an older one: the gauge holds a later value
                return
            if at - self.last > self.rule.stale * _US:
                yield from self.silent()
        self.last, self.last_id = at, row_id
        if value is None or not value > self.rule.above:
            yield from self.end(at, value)
            return
        if self.since is None:
            self.since = at
            if self.rule.hold:
                yield at, "pending", value
        if not self.fired and at - self.since >= self.rule.hold * _US:
            self.fired = True
            yield at, "firing", value


def alert_transitions(samples: DataFrame, rule: AlertRule) -> DataFrame:
    """Changes of state of every series: ``series, moment, phase, value``.

    ``samples`` is a stream of ``series`` (string), ``ts`` (with a watermark), ``row_id`` (orders samples of one time)
    and ``value``; null is no alert. Samples of one series are taken in the order of time within a micro-batch; one that comes in a
    later batch than a younger one is passed over, as a gauge shows its last value. Only the state of live series is
    kept: the watermark ends silent ones. A series' samples go to one task, as each depends on those before.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.getOption
        series = Series(rule, *(None if pd.isna(x) else x for x in held)) if held else Series(rule)
        out: list[tuple] = []
        if state.hasTimedOut:
            out += series.silent()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["us", "row_id"])
            for at, row_id, value in zip(rows["us"].tolist(), rows["row_id"].tolist(), rows["value"].tolist(), strict=True):
                out += series.sample(at, row_id, None if pd.isna(value) else value)
            state.update((series.since, series.fired, series.last, series.last_id))
            ends = series.last // 1000 + rule.stale * 1000
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["series", "at_us", "phase", "value"])

    rows = samples.select("series", "ts", "row_id", "value", F.unix_micros("ts").alias("us"))
    found = rows.groupBy("series").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("series", F.timestamp_micros("at_us").alias("moment"), "phase", "value")
