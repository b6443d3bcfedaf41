"""Pending rename previews that expire after their time to live, in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_MS = 600_000
LATENESS = "1 minute"
OUTPUT = "refactor_id string, status string"
STATE = "at array<bigint>, actions array<string>, since bigint, last bigint"


def _settle(ttl_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, actions, since, last = state.get if state.exists else ([], [], None, 0)
        waiting = list(zip(at, actions, strict=True))
        if not state.hasTimedOut:
            for batch in batches:
                waiting += zip(batch["ms"].tolist(), batch["action"].tolist(), strict=True)
        watermark, statuses = state.getCurrentWatermarkMs(), []
        # At one time a preview comes before its application.
        waiting = sorted((w for w in waiting if w[0] >= last), key=lambda w: (w[0], w[1] != "preview"))
        due = [w for w in waiting if w[0] <= watermark]
        waiting = waiting[len(due):]
        for ms, action in due:
            last = ms
            if since is not None and ms > since + ttl_ms:
                statuses.append("expired")
                since = None
            if action == "preview":
                statuses.append("pending")
                since = ms
            else:
                statuses.append("unknown" if since is None else "applied")
                since = None
        if since is not None and watermark > since + ttl_ms:
            statuses.append("expired")
            since = None
        if waiting or since is not None:
            state.update(([w[0] for w in waiting], [w[1] for w in waiting], since, last))
            ends = [w[0] for w in waiting[:1]] + ([since + ttl_ms + 1] if since is not None else [])
            state.setTimeoutTimestamp(max(min(ends), watermark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"refactor_id": [key[0]] * len(statuses), "status": statuses}, dtype=object)

    return step


def track_previews(actions: DataFrame, ttl_ms: int = TTL_MS, lateness: str = LATENESS) -> DataFrame:
    """(refactor_id, ts, action preview|apply) stream to status rows.

    Actions take effect in time order once the watermark has passed them; later ones are dropped as late.
    """
    timed = actions.withWatermark("ts", lateness).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("refactor_id").applyInPandasWithState(
        _settle(ttl_ms), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
