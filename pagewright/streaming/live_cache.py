"""A shared preview cache over a stream: concurrent requests of a key share one decode, answers and failures are remembered.

The stream holds requests (number, key, ts) and outcomes of decodes (key, ts, ok, result; number null). State is kept by
key: nothing, asked for, or answered, and the numbers that wait for the answer. A key's first request leaves as a row that
asks for a decode; further ones wait; an outcome answers all that wait and those to come. A key that isn't used for a time
is forgotten by a timer, so state is bounded by the keys of that time, whereas the batch cache (`operators/cache.py`)
counts entries. Time is that of the stream: the timer is due when the watermark has passed. Each key's state stands alone, so the work spreads by key.

The session needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: number, key and what happens: decode (someone has to), hit, shared (answered by a decode that another one asked for).
SCHEMA = "number long, key string, what string, ok boolean, result string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 3_600_000
LATE = "10 minutes"


class LiveCache(StatefulProcessor):
    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", "asked boolean, ok boolean, result string")
        self.waiting = handle.getListState("waiting", "number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        held = self.answer.get() if self.answer.exists() else None  # asked, ok, result
        waiting = [n for (n,) in self.waiting.get()] if self.waiting.exists() else []
        # an outcome comes after the requests of its time, so that they share it
        found = pd.concat(list(rows))
        latest = found["ts"].max()
        for row in found.assign(last=lambda r: r["number"].isna()).sort_values(["ts", "last", "number"]).itertuples():
            if row.last:
                held = (False, bool(row.ok), row.result)
                out += [(n, key[0], "shared", *held[1:]) for n in waiting]
                waiting = []
            elif held is None:
                held = (True, None, None)
                out.append((int(row.number), key[0], "decode", None, None))
            elif held[0]:
                waiting.append(int(row.number))
            else:
                out.append((int(row.number), key[0], "hit", *held[1:]))
        self.answer.update(held)
        if waiting:
            self.waiting.put([(n,) for n in waiting])
        else:
            self.waiting.clear()
        due = int(latest.timestamp() * 1000) + self.idle_ms
        for old in list(self.handle.listTimers()):
            due = max(due, old)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=["number", "key", "what", "ok", "result"]).astype({"number": "Int64", "ok": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forgets the key; requests that still wait ask for a decode of their own."""
        waiting = [n for (n,) in self.waiting.get()] if self.waiting.exists() else []
        self.answer.clear()
        self.waiting.clear()
        yield pd.DataFrame([(n, key[0], "decode", None, None) for n in waiting], columns=["number", "key", "what", "ok", "result"]).astype({"number": "Int64", "ok": "boolean"})

    def close(self) -> None:
        pass


def answered(stream: DataFrame, idle_ms: int = IDLE_MS, late: str = LATE) -> DataFrame:
    """SCHEMA rows of a stream (number, key, ts, ok, result); rows later than `late` behind the newest are dropped. Requests without a key (missing files) are dropped here: they are
    never kept, so they need no state."""
    keyed = stream.where(F.col("key").isNotNull()).withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(LiveCache(idle_ms), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
