"""Time-dependent states as column expressions. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days for which a verified source counts as fresh, and for which a verification counts as recent or to recheck.
FRESH_DAYS, RECENT_DAYS, RECHECK_DAYS, SOON_DAYS = 90, 90, 180, 14


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def window_state(now: Column, opening: Column, deadline: Column, rolling: Column, archived: Column) -> Column:
    """archived, then closed, upcoming, rolling, deadline_unknown, open: the first that holds."""
    return (
        F.when(archived, "archived")
        .when(deadline < now, "closed")
        .when(opening > now, "upcoming")
        .when(rolling, "rolling")
        .when(deadline.isNull(), "deadline_unknown")
        .otherwise("open")
    )


def window_rank(state: Column) -> Column:
    """Catalogue order of states: open and rolling first, then upcoming, unknown, closed, the rest."""
    return F.when(state.isin("open", "rolling"), 0).when(state == "upcoming", 1).when(state == "deadline_unknown", 2).when(state == "closed", 3).otherwise(4)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def is_fresh(verified: Column, now: Column, limit: int = FRESH_DAYS) -> Column:
    """A source never verified is not fresh."""
    return F.coalesce(verified >= now - days(limit), F.lit(False))


def verification_freshness(verified: Column, now: Column) -> Column:
    return F.when(verified.isNull(), "historical").when(verified >= now - days(RECENT_DAYS), "recent").when(verified >= now - days(RECHECK_DAYS), "recheck_recommended").otherwise("historical")


def urgency(deadline: Column, changed: Column, uncertain: Column, now: Column) -> Column:
    return (
        F.when(uncertain | deadline.isNull(), "uncertain")
        .when(changed, "changed")
        .when(deadline < now, "overdue")
        .when(deadline <= now + days(SOON_DAYS), "due_soon")
        .otherwise("upcoming")
    )


def deadline_projection(stored: Column, current: Column, confirmed: Column) -> Column:
    """uncertain without a confirmed current deadline, changed if it differs from the stored one, else known."""
    return F.when(current.isNull() | ~confirmed, "uncertain").when(stored.isNotNull() & (stored != current), "changed").otherwise("known")


def funding_class(policy: Column, components: Column, kind: Column) -> Column:
    """fully_funded with a policy and every component confirmed; partial if any is known or the kind is a part."""
    every = F.forall(components, lambda c: c == "confirmed")
    known = F.exists(components, lambda c: c != "unknown")
    return F.when(policy.isNotNull() & (policy != "") & every, "fully_funded").when(known | kind.isin("partial", "tuition_only", "stipend_only"), "partial").otherwise("unknown")


# Display texts of funding classes.
FUNDING_LABELS = {"fully_funded": "All tracked funding components confirmed", "partial": "Some funding components confirmed"}
FUNDING_OPEN = "Funding coverage requires verification"


def funding_label(kind: Column) -> Column:
    out = F.lit(FUNDING_OPEN)
    for name, label in FUNDING_LABELS.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


# Least scores of labels, and the label below them.
SCORE_LABELS = {80: "strong_match", 60: "possible_match", 40: "weak_match"}
SCORE_LOW = "low_match"


def score_label(score: Column) -> Column:
    out = F.lit(SCORE_LOW)
    for least, label in sorted(SCORE_LABELS.items()):
        out = F.when(score >= least, label).otherwise(out)
    return out


# Bands and display texts of score labels; the legacy states of the tracker.
FIT_BANDS = {
    "strong_match": "high_alignment",
    "possible_match": "moderate_alignment",
    "weak_match": "limited_alignment",
    "low_match": "low_alignment",
    "not_eligible": "known_eligibility_conflict",
}


def fit_band(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in FIT_BANDS.items() for x in pair]), label)


LEGACY_STATES = {
    "interested": "saved", "researching": "preparing", "preparing_documents": "preparing", "waiting_for_recommendation": "preparing", "ready_to_apply": "ready_to_submit",
    "submitted": "submitted", "interview_stage": "decision_received", "accepted": "accepted", "rejected": "declined", "withdrawn": "withdrawn", "expired": "withdrawn",
}


def half_even_percent(part: Column, whole: Column) -> Column:
    """round(100 * part / whole) with ties to even; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.bround(part.cast("double") * 100 / whole.cast("double"), 0).cast("long"))


def profile_gaps(recommended: dict[str, Column], cgpa: Column, percentage: Column, scale: Column) -> tuple[Column, Column]:
    """(missing fields, completeness in percent): the recommended fields and a grade slot, and one more for a scale where a CGPA is given."""
    empty = [F.when(c.isNull() | ((c == "unknown") if n == "english_test_status" else F.lit(False)), F.lit(n)) for n, c in recommended.items()]
    grade = F.when(cgpa.isNull() & percentage.isNull(), "cgpa_or_percentage").when(cgpa.isNotNull() & scale.isNull(), "grading_scale")
    missing = F.array_compact(F.array(*empty, grade))
    slots = F.lit(len(recommended) + 1) + F.when(cgpa.isNotNull(), 1).otherwise(0)
    return missing, half_even_percent(F.greatest(slots - F.size(missing), F.lit(0)), slots)


def slots_filled(slots: dict[str, Column], unknown: tuple[str, ...] = ()) -> Column:
    """Percent of a profile's slots that are neither null nor empty; those in `unknown` must not say so either."""
    filled = [F.coalesce(c != "", F.lit(False)) & ((c != "unknown") if n in unknown else F.lit(True)) for n, c in slots.items()]
    return half_even_percent(sum((F.when(x, 1).otherwise(0) for x in filled), F.lit(0)), F.lit(len(slots)))
