"""Row-level security: a policy per table, from owners down to what belongs to what they own."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parent:
    """A row that a row belongs to: the child's column, the parent's table and key; `optional` lets a null column pass."""

    column: str
    table: str
    key: str = "id"
    optional: bool = False


@dataclass(frozen=True)
class Policy:
    """A table's rows belong to the tenant in `owner`, to whom all of `parents` belong too, or that of the parents alone.

    `parent` and `on` (child, parent column) state a single parent.
    """

    owner: str | None = None
    parent: str | None = None
    on: tuple[str, str] | None = None
    parents: tuple[Parent, ...] = ()

    def all_parents(self) -> tuple[Parent, ...]:
        return (*self.parents, Parent(self.on[0], self.parent, self.on[1])) if self.parent else self.parents


# The policies of the student tables.
POLICIES = {
    **{t: Policy(owner="user_id") for t in (
        "student_profiles", "saved_opportunities", "application_notification_preferences", "assistant_conversations", "assistant_evidence_packets", "assistant_privacy_preferences",
        "document_assets", "community_preferences", "community_bookmarks", "community_blocks",
    )},
    "community_reports": Policy(owner="reporter_user_id"),
    "applications": Policy(owner="user_id", parents=(Parent("saved_opportunity_id", "saved_opportunities", optional=True),)),
    **{t: Policy(parents=(Parent("application_id", "applications"),)) for t in ("application_tasks", "application_reminders", "application_events", "application_documents")},
    "assistant_messages": Policy(parents=(Parent("conversation_id", "assistant_conversations"),)),
    "assistant_answers": Policy(owner="user_id", parents=(Parent("conversation_id", "assistant_conversations"), Parent("evidence_packet_id", "assistant_evidence_packets"))),
    "assistant_citations": Policy(parents=(Parent("answer_id", "assistant_answers"),)),
    "assistant_feedback": Policy(owner="user_id", parents=(Parent("answer_id", "assistant_answers"),)),
    "document_versions": Policy(owner="user_id", parents=(Parent("asset_id", "document_assets"),)),
    **{t: Policy(owner="user_id", parents=(Parent("version_id", "document_versions"),)) for t in ("document_extractions", "document_consents")},
    "document_analyses": Policy(owner="user_id", parents=(Parent("version_id", "document_versions"), Parent("consent_id", "document_consents"))),
    "document_feedback_items": Policy(parents=(Parent("analysis_id", "document_analyses"),)),
    "document_analysis_jobs": Policy(owner="user_id", parents=(Parent("version_id", "document_versions"), Parent("analysis_id", "document_analyses", optional=True))),
    "application_document_links": Policy(owner="user_id", parents=(Parent("application_document_id", "application_documents"), Parent("version_id", "document_versions"))),
    "match_evaluations": Policy(owner="user_id", parents=(Parent("profile_id", "student_profiles", optional=True),)),
    "match_evaluation_results": Policy(parents=(Parent("evaluation_id", "match_evaluations"),)),
    "match_rule_outcomes": Policy(parents=(Parent("evaluation_result_id", "match_evaluation_results"),)),
}


def order_of(policies: dict[str, Policy]) -> list[str]:
    """Tables with parents before children; a cycle is an error."""
    try:
        return list(TopologicalSorter({t: {p.table for p in policy.all_parents()} for t, policy in policies.items()}).static_order())
    except CycleError as e:
        raise ValueError(f"policies form a cycle: {' > '.join(e.args[1])}") from e


def owned(tables: dict[str, DataFrame], policies: dict[str, Policy]) -> dict[str, DataFrame]:
    """Each table with `_owner`, the one tenant that sees a row, null if none does: for all tenants at once.

    A parent's owners are worked out once and joined to every table below it by key, so a tenant's view is a filter
    and not a chain of joins of its own. Keys of parents are unique. Tables without a policy, or whose parents are not
    given, belong to nobody.
    """
    done: dict[str, DataFrame] = {}
    for name in (t for t in order_of(policies) if t in tables):
        policy, df = policies.get(name, Policy()), tables[name]
        owners, open_ = [], []
        for i, p in enumerate(policy.all_parents()):
            if p.table not in done:
                owners.append(F.lit(None))
                continue
            keys = done[p.table].filter(F.col("_owner").isNotNull() & F.col(p.key).isNotNull()).select(F.col(p.key).alias(f"_k{i}"), F.col("_owner").alias(f"_o{i}"))
            df = df.join(keys, F.col(p.column) == F.col(f"_k{i}"), "left")
            own = F.col(f"_o{i}")
            if p.optional:
                open_.append((F.col(p.column).isNull(), own))
            else:
                owners.append(own)
        first = F.col(policy.owner) if policy.owner else owners[0] if owners else F.lit(None)
        same = reduce(lambda a, b: a & b, [first == o for o in owners] + [null | (first == o) for null, o in open_], F.lit(True))
        done[name] = df.withColumn("_owner", F.when(same, first)).select(*tables[name].columns, "_owner")
    return done | {name: df.withColumn("_owner", F.lit(None)) for name, df in tables.items() if name not in done}


def secured(tables: dict[str, DataFrame], policies: dict[str, Policy], tenant, bypass: bool = False) -> dict[str, DataFrame]:
    """What one tenant sees of each table; a table without a policy shows nothing unless bypassed.

    A null tenant sees nothing. The tenant's filter is applied to owners first, so that only its keys are joined on.
    """
    if bypass:
        return dict(tables)
    order_of(policies)
    done: dict[str, DataFrame] = {}
    for name in [*(t for t in order_of(policies) if t in tables), *(t for t in tables if t not in policies)]:
        policy, df = policies.get(name), tables[name]
        if policy is None or tenant is None or not (policy.owner or policy.all_parents()):
            done[name] = df.filter(F.lit(False))
            continue
        df = df.filter(F.col(policy.owner) == F.lit(tenant)) if policy.owner else df
        for p in policy.all_parents():
            keys = done[p.table].select(F.col(p.key).alias("_owner_key")) if p.table in done else df.select(F.col(p.column).alias("_owner_key")).filter(F.lit(False))
            if p.optional:
                there = keys.distinct().withColumn("_there", F.lit(True))
                df = df.join(there, F.col(p.column) == F.col("_owner_key"), "left").filter(F.col("_there") | F.col(p.column).isNull()).drop("_owner_key", "_there")
            else:
                df = df.join(keys, F.col(p.column) == F.col("_owner_key"), "left_semi")
        done[name] = df
    return done
