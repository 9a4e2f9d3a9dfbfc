"""Stateful streams in event order, on typed state and event-time timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[dict, dict], list[tuple]]
#: Rows of a block that waits, and the types of whole numbers.
BLOCK, WHOLE = 4096, ("tinyint", "smallint", "int", "bigint")


class InEventOrder(StatefulProcessor):
    """``step(own, row)`` over the rows of a key in event order, whatever the order of
    arrival, and what ``ring(own)`` tells when the event time ``due(own)`` passes.

    Rows wait in a list of blocks, one for each arrival at most (more, if it is large).
    A key has one timer for them, at the end of the short span of event time that its
    earliest waiting row lies in. When that passes, all rows that the watermark has
    passed are told in one go and what still waits is written back: a row is read again
    once per span until its time comes, however far the watermark jumps. What ``step``
    remembers is one row of typed columns (``own``, a DDL). A key without rows for
    ``forget_ms`` of event time leaves the state."""

    def __init__(self, keys: list[str], columns: list[tuple[str, str]], order: str, own: str, step: Step, out: list[str], span_ms: int, forget_ms: int,
                 due: Callable[[dict], float | None] | None, ring: Callable[[dict], list[tuple]] | None) -> None:
        self.keys, self.columns, self.order, self.step, self.out = keys, columns, order, step, out
        self.span, self.forget, self.due, self.ring = span_ms, forget_ms, due, ring
        self.own_schema = f"{own}, seen_ms long, forget_ms long, due_ms long"
        self.own_names = [c.strip().split(" ")[0] for c in self.own_schema.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<long>, " + ", ".join(f"`{n}` array<{t}>" for n, t in self.columns))
        self.own = handle.getValueState("own", self.own_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        columns: list[list] = [[] for _ in range(len(self.columns) + 1)]
        for pdf in rows:
            columns[0] += (pdf["event_at"].to_numpy().astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
            for values, (n, t) in zip(columns[1:], self.columns, strict=True):
                whole = t in WHOLE and pdf[n].dtype.kind == "f"  # whole numbers among nulls come as doubles
                values += [None if x is None or x != x else int(x) if whole else x for x in pdf[n].tolist()]
        self._wait(columns)
        return iter(())

    def _wait(self, columns: list[list], instead: bool = False) -> None:
        """Rows wait, beside those that do or instead of them."""
        n = len(columns[0])
        blocks = [tuple(values[at:at + BLOCK] for values in columns) for at in range(0, n, BLOCK)]
        if instead:
            self.waiting.put(blocks) if blocks else self.waiting.clear()
        elif blocks:
            self.waiting.appendList(blocks)
        if n:
            self.handle.registerTimer((min(columns[0]) // self.span + 1) * self.span)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        own = {n: v for n, v in zip(self.own_names, self.own.get() or (), strict=False) if v is not None}
        told: list[tuple] = []
        rows = [row for block in self.waiting.get() for row in zip(*block, strict=True)]
        ready = [row for row in rows if row[0] < mark]
        if not ready and not own:
            return iter(())
        if ready:
            left = [row for row in rows if row[0] >= mark]
            self._wait([list(c) for c in zip(*left, strict=True)] or [[]], instead=True)
            names = [n for n, _ in self.columns]
            at = 1 + names.index(self.order)
            for row in sorted(ready, key=lambda r: (r[0], r[at] is not None, r[at])):
                if (end := own.get("seen_ms", row[0]) + self.forget) <= row[0]:
                    self._alarm(own, end, told)
                    own = {}
                self._alarm(own, row[0], told)
                own["seen_ms"] = row[0]
                told += self.step(own, dict(zip(names, row[1:], strict=True)))
        last = own.get("seen_ms", mark) + self.forget
        self._alarm(own, min(mark, last), told)
        if last <= mark:
            self.own.clear()
        else:
            if self.due and (t := self.due(own)) is not None and own.get("due_ms") != (due := int(t * 1000) + 1):
                own["due_ms"] = due
                self.handle.registerTimer(due)
            if own.get("forget_ms", mark) <= mark:
                own["forget_ms"] = last
                self.handle.registerTimer(last)
            self.own.update(tuple(own.get(n) for n in self.own_names))
        return iter([self._table(key, told)] if told else ())

    def _alarm(self, own: dict, until_ms: int, told: list[tuple]) -> None:
        if self.due and (t := self.due(own)) is not None and t * 1000 < until_ms:
            told += self.ring(own)

    def _table(self, key: Any, told: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *t) for t in told], columns=[*self.keys, *self.out])

    def close(self) -> None:
        pass


def in_event_order(rows: DataFrame, keys: list[str], time: Column, order: str, late: str, late_s: float, forget_s: float, step: Step, own: str, out: str,
                   due: Callable[[dict], float | None] | None = None, ring: Callable[[dict], list[tuple]] | None = None) -> DataFrame:
    """``keys`` and the columns ``out`` of everything that ``step`` and ``ring`` tell.
    ``late`` is how far rows may come out of order, ``late_s`` the same in seconds.
    Needs a session whose state store is RocksDB (``run.to_end`` sees to it)."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    columns = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name not in (*keys, "time")]
    names = [c.strip().split(" ")[0] for c in out.split(",")]
    job = InEventOrder(keys, columns, order, own, step, names, max(1, int(late_s * 250)), int(forget_s * 1000), due, ring)
    marked = rows.withColumn("event_at", time).drop("time").withWatermark("event_at", late)
    return marked.groupBy(*keys).transformWithStateInPandas(job, f"{kinds}, {out}", "Append", "EventTime")
