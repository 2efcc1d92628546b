"""Streams with arbitrary state by key: admission by budgets, and a bounded cache of responses."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Microseconds of a second, a minute and a day; the least wait of a refused request in seconds.
SECOND, MINUTE, DAY, LEAST_WAIT = 1_000_000, 60_000_000, 86_400_000_000, 0.1
#: Rows of a key that are Python's objects at once, and that are handed on together.
ROWS_HELD = 20_000


class Budget:
    """What is left of a key's minute and day, in microseconds of event time. A minute or a day begins anew with the first request after it is over."""

    def __init__(self, per_minute: int, per_day: int, at: int, state: tuple | None = None):
        self.per_minute, self.per_day = per_minute, per_day
        self.minute_left, self.day_left, self.minute_since, self.day_since = state or (per_minute, per_day, at, at)

    def ask(self, at: int) -> float:
        """0 if a request at this time is admitted, else the seconds to wait."""
        if at - self.minute_since >= MINUTE:
            self.minute_left, self.minute_since = self.per_minute, at
        if at - self.day_since >= DAY:
            self.day_left, self.day_since = self.per_day, at
        if self.day_left <= 0:
            return (DAY - (at - self.day_since)) / SECOND
        if self.minute_left <= 0:
            return max((MINUTE - (at - self.minute_since)) / SECOND, LEAST_WAIT)
        self.minute_left, self.day_left = self.minute_left - 1, self.day_left - 1
        return 0.0

    def state(self) -> tuple:
        return self.minute_left, self.day_left, self.minute_since, self.day_since

    def over(self) -> int:
        """From when on the state says nothing: both the minute and the day are over."""
        return max(self.minute_since + MINUTE, self.day_since + DAY)


def _sorted_rows(rows: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """(at, id, what) of a key's rows of a batch by time and id, in lists of up to ROWS_HELD. All are held as plain columns, as a few bytes
    besides the text, and only a list's rows are objects."""
    at, id, what = [], [], []
    for frame in rows:
        at.append(frame["at"].to_numpy(dtype=np.int64))
        id.append(frame["id"].to_numpy(dtype=np.int64))
        what.append(pa.array(frame["what"], pa.large_string()))
    at, id, what = np.concatenate(at), np.concatenate(id), pa.chunked_array(what, pa.large_string()).combine_chunks()
    order = np.lexsort((id, at))
    for k in range(0, len(order), ROWS_HELD):
        part = order[k : k + ROWS_HELD]
        yield list(zip(at[part].tolist(), id[part].tolist(), what.take(pa.array(part)).to_pylist(), strict=True))


class _Admission(StatefulProcessor):
    def __init__(self, per_minute: int, per_day: int):
        self.limits = per_minute, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "minute_left int, day_left int, minute_since long, day_since long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, budget = self.left.get() if self.left.exists() else None, None
        for asked in _sorted_rows(rows):
            budget, out = budget or Budget(*self.limits, asked[0][0], held and held[:4]), []
            for at, id, _ in asked:
                wait = budget.ask(at)
                out.append((key[0], id, wait == 0, wait, budget.minute_left, budget.day_left))
            yield pd.DataFrame(out, columns=["key", "id", "admitted", "wait", "minute_left", "day_left"])
        if held:
            self.handle.deleteTimer(held[4])
        timer = -(-budget.over() // 1000)  # milliseconds
        self.handle.registerTimer(timer)
        self.left.update((*budget.state(), timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A key whose minute and day are over is forgotten; it would begin anew anyway."""
        self.left.clear()
        return iter(())

    def close(self) -> None:
        pass


class Recent:
    """The `most` keys used last."""

    def __init__(self, most: int, held: list[str]):
        self.most, self.held = most, OrderedDict.fromkeys(held)

    def use(self, x: str) -> tuple[bool, str | None]:
        """Whether x was held, and what has to go for it."""
        hit = x in self.held
        self.held[x] = None
        self.held.move_to_end(x)
        return hit, self.held.popitem(last=False)[0] if len(self.held) > self.most else None


class _Cache(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.uses = handle.getMapState("uses", "what string", "turn long")
        self.turns = handle.getValueState("turns", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = {k[0]: v[0] for k, v in self.uses.iterator()} if self.uses.exists() else {}
        turn, touched = (self.turns.get()[0] if self.turns.exists() else 0), {}
        recent = Recent(self.most, sorted(stored, key=stored.get))
        for asked in _sorted_rows(rows):
            out = []
            for _, id, what in asked:
                hit, gone = recent.use(what)
                turn += 1
                touched[what] = turn
                touched.pop(gone, None)
                out.append((key[0], id, hit, gone))
            yield pd.DataFrame(out, columns=["key", "id", "hit", "evicted"])
        for x in stored.keys() - recent.held.keys():
            self.uses.removeKey((x,))
        for x in touched.keys() & recent.held.keys():
            self.uses.updateValue((x,), (touched[x],))
        self.turns.update((turn,))

    def close(self) -> None:
        pass


def _keyed(events: DataFrame, time: str, key: str, id_col: str, what: str | None) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), (F.col(what).cast("string") if what else F.lit("")).alias("what"), F.col(time).cast("timestamp").alias("_time"))


def admit(events: DataFrame, time: str, key: str, id_col: str, per_minute: int, per_day: int, late: str = "1 hour") -> DataFrame:
    """(key, id, admitted, wait, minute_left, day_left) of each request of a stream: whether its key's budgets of the minute and of the day admit it,
    else the seconds to wait; and what is left after it.

    Requests of a batch count in order of time, then id; batches in the order in which they come. A key's state is four numbers, dropped
    by a timer of event time when they say nothing any more. Rows without key, time or id are left out. Run it with streams.run_append(..., rocks=True).
    """
    x = _keyed(events, time, key, id_col, None).where("key IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL").withWatermark("_time", late)
    return x.groupBy("key").transformWithStateInPandas(_Admission(per_minute, per_day), "key string, id long, admitted boolean, wait double, minute_left int, day_left int", "Append", "EventTime")


def cached(events: DataFrame, time: str, key: str, id_col: str, what: str, most: int) -> DataFrame:
    """(key, id, hit, evicted) of each request of a stream: whether its `what` is among the `most` used last under its key, and what goes for it.

    The state of a key is a map of at most `most` entries to the turn of their last use; of a batch only what changed is written back. Order
    as in admit(). Rows without key, time, id or what are left out.
    """
    x = _keyed(events, time, key, id_col, what).where("key IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL AND what IS NOT NULL").drop("_time")
    return x.groupBy("key").transformWithStateInPandas(_Cache(most), "key string, id long, hit boolean, evicted string", "Append", "None")
