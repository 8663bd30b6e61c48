"""Fixed-window rate limiting whose windows open with a key's first request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limit_requests(requests: DataFrame, key: str, at: str, request: str, limit: int = 30, window_seconds: int = 60) -> DataFrame:
    """key, request and allowed of each request. A window opens at a key's first request and at the first one when it has
    ended; ``limit`` requests are allowed in it. Rows of a key and time follow the order of ``request``; a null time
    comes first and is refused. Keys are sorted within their partition and walked as a stream, so a key of any number
    of requests takes no memory."""
    rows = requests.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(request).alias("request"))
    kinds = f"key {rows.schema['key'].dataType.simpleString()}, request {rows.schema['request'].dataType.simpleString()}, allowed boolean"
    length = window_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = object()
        ends, used = 0, 0
        for b in batches:
            allowed = []
            for k, us in zip(b["key"].tolist(), b["us"].tolist()):
                if k != now:
                    now, ends, used = k, None, 0
                if us is None or us != us:
                    allowed.append(False)
                    continue
                if ends is None or us >= ends:
                    ends, used = us + length, 0
                allowed.append(used < limit)
                used += used < limit
            yield pd.DataFrame({"key": b["key"], "request": b["request"], "allowed": allowed})

    return rows.repartition("key").sortWithinPartitions("key", "us", "request").mapInPandas(run, kinds)


def limit_stream(requests: DataFrame, limit: int = 30, window_seconds: int = 60) -> DataFrame:
    """The same for a stream of key STRING, at TIMESTAMP, request STRING, with the open window of a key as its state;
    requests of one micro-batch are taken in the order of time, late ones count in the window that is open. The state of
    a key goes once the watermark (a window behind the latest request) is past its window."""
    length = window_seconds * 1_000_000

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ends, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "request"])
        out = []
        for at, request in zip(rows["at"], rows["request"]):
            us = at.value // 1000
            if ends is None or us >= ends:
                ends, used = us + length, 0
            out.append((key[0], request, used < limit))
            used += used < limit
        state.update((ends, used))
        state.setTimeoutTimestamp(max(ends // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "request", "allowed"])

    return requests.withWatermark("at", f"{window_seconds} seconds").groupBy("key").applyInPandasWithState(walk, "key string, request string, allowed boolean", "ends long, used int", "append", GroupStateTimeout.EventTimeTimeout)
