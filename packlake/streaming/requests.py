"""Latest-request-wins, on batches and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Kinds of rows in a stream of `current_results`.
REQUEST, SELECTION, RESULT = "request", "selection", "result"
#: Milliseconds after which a key that nothing was asked of is forgotten.
IDLE_MS = 24 * 3600 * 1000


def latest_wins(
    requests: DataFrame, results: DataFrame, selected: DataFrame, key: str = "key"
) -> DataFrame:
    """Results that still count: their request is the current one of the key and their path
    is the selected one.

    `requests` is `(key, request_id)`, `results` `(key, request_id, path)`, `selected`
    `(key, path)`. Both lookups are one row per key, made with map-side aggregation.
    """
    current = requests.groupBy(key).agg(F.max("request_id").alias("request_id"))
    return results.join(current, [key, "request_id"], "left_semi").join(
        selected.select(key, "path"), [key, "path"], "left_semi"
    )


def current_requests(requests: DataFrame, key: str = "key") -> DataFrame:
    """Current request per key with its columns. Works on batches and on streams (update mode);
    the state of a stream is one row per key."""
    others = [c for c in requests.columns if c not in (key, "request_id")]
    latest = F.max(F.struct("request_id", *others)).alias("latest")
    return requests.groupBy(key).agg(latest).select(
        key, "latest.request_id", *[F.col(f"latest.{c}") for c in others]
    )


class CurrentResults(StatefulProcessor):
    """Keeps the largest request and the selected path of a key, and lets the results through that are theirs."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.request = handle.getValueState("request", "request_id long", self.idle_ms)
        self.selected = handle.getValueState("selected", "path string, at long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        request = self.request.get()[0] if self.request.exists() else None
        path, at = self.selected.get() if self.selected.exists() else (None, None)
        known = (request, path, at)
        waiting: list[pd.DataFrame] = []
        for frame in rows:
            asked = frame.loc[frame["kind"] == REQUEST, "request_id"].max()
            if pd.notna(asked) and (request is None or asked > request):
                request = int(asked)
            chosen = frame[(frame["kind"] == SELECTION) & frame["request_id"].notna()]
            if len(chosen):
                last = chosen.loc[chosen["request_id"].idxmax()]
                if at is None or last["request_id"] >= at:
                    path, at = last["path"], int(last["request_id"])
            waiting.append(frame[frame["kind"] == RESULT])
            if request is not None:  # results of earlier requests cannot count any more
                waiting = [w for w in (w[w["request_id"] >= request] for w in waiting) if len(w)]
        if (request, path, at) != known:
            if request is not None:
                self.request.update((request,))
            if at is not None:
                self.selected.update((path, at))
        for frame in waiting:
            found = frame[(frame["request_id"] == request) & (frame["path"] == path)]
            if len(found):
                yield found.assign(key=key[0])[["key", "request_id", "path"]]

    def close(self) -> None:
        pass


def current_results(changes: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """The stream of results that count when they arrive: `(key, request_id, path)`, in append mode.

    `changes` is a stream `(key, kind, request_id, path)` of requests, selections and results. A result
    counts if its request is the largest of the key so far and its path the one selected last, where
    `request_id` numbers selections too. Within a batch, requests and selections come first: a result that
    arrives together with its replacement is late, and so is one that arrives after it. A result before its
    request has none to count for. Null numbers and paths never count. State is two small values for each
    key, forgotten when nothing changed them for `idle_ms`; it lives in the checkpoint.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # State that is forgotten by the clock asks for batches without data; a run over what is there would never end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    kind = changes.schema["key"].dataType.simpleString()
    return changes.select("key", "kind", "request_id", "path").groupBy("key").transformWithStateInPandas(
        statefulProcessor=CurrentResults(idle_ms),
        outputStructType=f"key {kind}, request_id long, path string",
        outputMode="Append",
        timeMode="ProcessingTime",
    )
