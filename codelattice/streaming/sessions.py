"""Stateful session history: the intent of a session after each call, in event-time order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codelattice.operators.sessions import HISTORY_CALLS, INTENT_TOOLS, RECENT_CALLS

STATE = "at array<bigint>, ids array<bigint>, names array<string>, tools array<string>, calls bigint, last bigint"
#: How long a call may be late, and how long after its last call a session is remembered.
LATENESS, IDLE_MS = "10 minutes", 24 * 3_600_000


def _intent(recent: list[str]) -> str:
    votes = {i: sum(t in tools for t in recent) for i, tools in INTENT_TOOLS.items()}
    best = max(votes, key=votes.get)
    return best if votes[best] else "exploring"


def _advance(idle_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ids, names, tools, calls, last = state.get if state.exists else ([], [], [], [], 0, 0)
        waiting = list(zip(at, ids, names, strict=True))
        if not state.hasTimedOut:
            for batch in batches:
                waiting += zip(batch["ms"].tolist(), batch["call_id"].tolist(), batch["tool"].tolist(), strict=True)
        watermark, tools, rows = state.getCurrentWatermarkMs(), list(tools), []
        waiting = sorted((w for w in waiting if w[0] >= last), key=lambda w: w[:2])
        due = [w for w in waiting if w[0] <= watermark]
        waiting = waiting[len(due):]
        for ms, call_id, tool in due:
            tools = (tools + [tool])[-HISTORY_CALLS:]
            calls, last = calls + 1, ms
            rows.append((key[0], call_id, tool, _intent(tools[-RECENT_CALLS:]), calls))
        if not waiting and watermark >= last + idle_ms:
            state.remove()
        else:
            state.update(([w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting], tools, calls, last))
            state.setTimeoutTimestamp(max(waiting[0][0] if waiting else last + idle_ms, watermark + 1))
        yield pd.DataFrame(rows, columns=["session_id", "call_id", "tool", "intent", "calls"])

    return step


def stream_intents(calls: DataFrame, lateness: str = LATENESS, idle_ms: int = IDLE_MS) -> DataFrame:
    """(session_id, ts, call_id, tool) stream to one intent row per call.

    A call waits until the watermark (the latest time seen less ``lateness``) passes it, so rows come
    in (ts, call_id) order whatever the order of arrival. Calls behind the watermark are late: Spark
    drops them, or this step does if a later call of their session has been answered. A session without calls for ``idle_ms`` of event time is forgotten.
    """
    kind = calls.schema["session_id"].dataType.simpleString()
    timed = calls.withWatermark("ts", lateness).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("session_id").applyInPandasWithState(
        _advance(idle_ms), f"session_id {kind}, call_id bigint, tool string, intent string, calls bigint", STATE,
        "append", GroupStateTimeout.EventTimeTimeout,
    )
