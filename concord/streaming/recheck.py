"""Keys that differ while changes are under way: held until both sides have passed a fence, then looked at again.

A difference that is seen while one side still applies changes proves nothing. Such a suspect is kept as state
under its key, with the position that the source had when it was seen: the fence. Positions travel as event times,
and the stream's watermark is the least of what both sides have applied, so a timer set at the fence goes off when
both have passed it and not before. Then the key is due: it is looked at once more, and what differs still differs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from concord.session import durable
from concord.streaming.delta import verify_touched

#: The event time of suspects: never late, and as far on as pandas can tell.
NEVER_LATE = "2200-01-01"


def as_time(position: Column, step: int = 1) -> Column:
    """A position of a log as an event time, a millisecond for every ``step``; what is beyond a whole one is left out."""
    return F.timestamp_millis(F.floor(position / F.lit(step)).cast("long"))


class Suspects(StatefulProcessor):
    """Holds each key with its latest fence; when both sides have passed it, the key comes out once."""

    def __init__(self, step: int = 1):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "fence bigint, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fences = [int(x) for frame in rows for x in frame["fence"].dropna()]
        if not fences:  # a clock's rows
            return iter(())
        old = self.held.get() if self.held.exists() else (0, 0)
        fence = max([*fences, int(old[0])])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.held.update((fence, int(old[1]) + len(fences)))
        self.handle.registerTimer(-(-fence // self.step))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fence, seen = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"key": [key[0]], "fence": [int(fence)], "seen": [int(seen)]})

    def close(self) -> None:
        pass


def due(suspects: DataFrame, applied: list[DataFrame], step: int = 1) -> DataFrame:
    """key, fence, seen of each suspect (key, fence) whose fence all sides have passed.

    ``applied`` are streams of the positions that each side has applied (position). They alone move the watermark,
    which is the least of theirs, as is Spark's default. ``step`` positions are a millisecond: logs that count bytes
    take 1024 or more. The session needs RocksDB as its state store.
    """
    # a clock's rows have a key of their own, as rows that are filtered out would not move the watermark; a suspect
    # has no watermark and a time that is never late, as its fence may have been passed already
    clocks = [side.select(F.lit(f"\0{i}").alias("key"), F.lit(None).cast("long").alias("fence"), as_time(F.col("position"), step).alias("at")).withWatermark("at", "0 seconds") for i, side in enumerate(applied)]
    held = suspects.select(F.col("key").cast("string").alias("key"), F.col("fence").cast("long").alias("fence"), F.lit(NEVER_LATE).cast("timestamp").alias("at"))
    rows = reduce(DataFrame.union, [*clocks, held])
    return rows.groupBy("key").transformWithStateInPandas(Suspects(step), "key string, fence long, seen long", "append", "eventTime")


def settle(read_src: Callable[[], DataFrame], read_dst: Callable[[], DataFrame], key: str, found: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` of due keys: gives ``found`` each with its kind, or ``healed``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        src, dst = read_src(), read_dst()
        keys = durable(batch).select(F.col("key").cast(src.schema[key].dataType).alias(key), "fence")
        bad = verify_touched(src, dst, keys.select(key), [key])
        found(keys.join(bad, key, "left").select(key, "fence", F.coalesce("kind", F.lit("healed")).alias("kind")), batch_id)

    return run
