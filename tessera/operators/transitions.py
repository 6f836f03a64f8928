"""State machines as transition tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Allowed moves of applications and reminders; status effects and note duty of review actions.
APPLICATION = {
    "saved": ["preparing", "withdrawn"],
    "preparing": ["saved", "ready_to_submit", "withdrawn"],
    "ready_to_submit": ["preparing", "submitted", "withdrawn"],
    "submitted": ["decision_received", "withdrawn"],
    "decision_received": ["accepted", "declined", "withdrawn"],
    "accepted": [],
    "declined": [],
    "withdrawn": [],
}
REMINDER = {"scheduled": ["snoozed", "cancelled"], "snoozed": ["scheduled", "cancelled"], "delivered": ["read", "snoozed"], "read": [], "cancelled": ["scheduled"], "failed": ["scheduled", "cancelled"]}
REVIEW = {
    "publish": ("officially_verified", "active", False),
    "resolve_conflict": ("officially_verified", "active", True),
    "hold_for_review": ("needs_review", "draft", True),
    "request_recheck": ("needs_review", "draft", True),
    "flag_conflict": ("conflicting_information", "draft", True),
    "expire": ("expired", "expired", True),
    "archive": ("archived", "archived", True),
}


def allowed(table: dict[str, list[str]], current: Column, target: Column) -> Column:
    """Whether a move is allowed; false for unknown states."""
    moves = F.create_map(*[x for state, to in table.items() for x in (F.lit(state), F.array(*[F.lit(t) for t in to]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(moves, current), target), F.lit(False))


def invalid_moves(events: DataFrame, key: str, order: list[str], state: str, table: dict[str, list[str]]) -> DataFrame:
    """Consecutive states of a key that the table does not allow; staying is allowed."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    moved = events.withColumn("previous_state", before).filter(F.col("previous_state").isNotNull() & (F.col("previous_state") != F.col(state)))
    return moved.filter(~allowed(table, F.col("previous_state"), F.col(state)))


def reviewed(requests: DataFrame) -> DataFrame:
    """Requests (action, notes) with outcome and the new source and catalogue status."""
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for a, v in REVIEW.items() for x in (a, str(v[i]).lower())]), F.col("action"))
    lacks = (pick(2) == "true") & (F.btrim(F.coalesce("notes", F.lit(""))) == "")
    outcome = F.when(pick(0).isNull(), "unsupported").when(lacks, "notes_required").otherwise("applied")
    return requests.withColumn("outcome", outcome).withColumns({"source_status": F.when(F.col("outcome") == "applied", pick(0)), "status": F.when(F.col("outcome") == "applied", pick(1))})
