"""Session history: intent over the last calls and next-step suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.operators.lookup import top_per_key
from codelattice.operators.ordering import rolling_frame

# Tools that speak for an intent, in order of preference.
INTENT_TOOLS = {
    "reviewing": ("detect_changes", "get_review_context", "get_affected_flows", "get_impact_radius"),
    "debugging": ("query_graph", "get_flow", "semantic_search_nodes"),
    "refactoring": ("refactor", "find_dead_code", "suggest_refactorings"),
    "exploring": ("list_communities", "get_architecture_overview", "list_flows", "list_graph_stats"),
}
RECENT_CALLS, HISTORY_CALLS, MAX_HINTS = 10, 100, 3


def argmax_intent(counts: dict[str, Column]) -> Column:
    """Intent with the most votes, the earlier one on ties, exploring without any."""
    best = F.greatest(*counts.values())
    out = F.lit("exploring")
    for intent, votes in reversed(counts.items()):
        out = F.when(votes == best, intent).otherwise(out)
    return F.when(best == 0, "exploring").otherwise(out)


def session_intents(calls: DataFrame, bound: int | None = None) -> DataFrame:
    """Intent after every call of (session_id, ts, call_id, tool) over its last ten calls."""
    votes = {i: F.col("tool").isin(*tools).cast("int") for i, tools in INTENT_TOOLS.items()}
    more = {} if bound is None else {"bound": bound, "chunk": max(bound, RECENT_CALLS)}
    rolled = rolling_frame(calls, ["session_id"], ["ts", "call_id"], RECENT_CALLS, votes, **more)
    return rolled.select(
        "session_id", "call_id", "tool",
        argmax_intent({i: F.col(i) for i in INTENT_TOOLS}).alias("intent"),
    )


def next_steps(calls: DataFrame, workflow: DataFrame) -> DataFrame:
    """Up to three follow-up tools of each session's last call that it has not used lately.

    ``workflow``: tool, next_tool, place.
    """
    order = [F.desc("ts"), F.desc("call_id")]
    recent = top_per_key(calls.select("session_id", "ts", "call_id", "tool"), ["session_id"], order, HISTORY_CALLS)
    last = recent.groupBy("session_id").agg(F.max_by("tool", F.struct("ts", "call_id")).alias("tool"))
    used = recent.select("session_id", F.col("tool").alias("next_tool")).distinct()
    open_steps = last.join(workflow, "tool").join(used, ["session_id", "next_tool"], "left_anti")
    return top_per_key(open_steps, ["session_id"], [F.asc("place")], MAX_HINTS)
