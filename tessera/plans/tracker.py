"""The tracker's queries: orders as applications, their lines as tasks and reminders, parts as opportunities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracker
from .registry import ORDER_CLOCK, clock, query

APPLICATION = {
    "user_id": "o_custkey",
    "application_id": "o_orderkey",
    "lifecycle": "CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'P' THEN 'accepted' ELSE 'researching' END",
    "deadline": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END",
    "deadline_state": "CASE WHEN o_orderkey % 13 = 0 THEN 'uncertain' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'known' END",
}
TASK = {
    "application_id": "l_orderkey",
    "task_id": "l_partkey * 10 + l_linenumber",
    "status": "CASE WHEN l_returnflag = 'N' THEN 'todo' WHEN l_returnflag = 'A' AND l_quantity > 25 THEN 'blocked' WHEN l_returnflag = 'A' THEN 'in_progress' ELSE 'done' END",
    "due_at": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END",
    "priority": "CASE l_linenumber % 4 WHEN 0 THEN 'urgent' WHEN 1 THEN 'normal' WHEN 2 THEN 'low' ELSE 'high' END",
}
REMINDER = {
    "application_id": "l_orderkey",
    "reminder_id": "l_suppkey * 10 + l_linenumber",
    "status": "CASE l_linenumber % 3 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'snoozed' ELSE 'delivered' END",
    "scheduled_at": "l_shipdate",
}
_select = lambda expressions: ", ".join(f"{e} AS {n}" for n, e in expressions.items())
SOON_SQL = f"TIMESTAMP '{ORDER_CLOCK}' + INTERVAL 14 DAY"
APPLICATIONS_SQL = f"SELECT {_select(APPLICATION)} FROM orders"
DASHBOARD_SQL = f"""
WITH a AS ({APPLICATIONS_SQL}), t AS (SELECT {_select(TASK)} FROM lineitem), r AS (SELECT {_select(REMINDER)} FROM lineitem WHERE l_returnflag = 'R'),
o AS (SELECT t.*, user_id FROM t JOIN a USING (application_id) WHERE status IN ('todo', 'in_progress', 'blocked')),
f AS (SELECT *, application_id IN (SELECT application_id FROM o WHERE status = 'blocked') AS blocked FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY deadline ASC NULLS LAST, application_id) <= 100),
l AS (SELECT user_id, 'urgent_tasks' AS list, due_at AS at_, priority, task_id AS item_id FROM o WHERE due_at <= {SOON_SQL} AND status <> 'blocked' UNION ALL SELECT user_id, 'blocked_tasks', due_at, priority, task_id FROM o WHERE status = 'blocked'
UNION ALL SELECT user_id, 'blocked_applications', deadline, '', application_id FROM f WHERE blocked UNION ALL SELECT user_id, 'approaching_deadlines', deadline, '', application_id FROM f WHERE deadline <= {SOON_SQL}
UNION ALL SELECT user_id, 'submitted_applications', deadline, '', application_id FROM f WHERE lifecycle IN ('submitted', 'accepted') UNION ALL SELECT user_id, 'recently_changed_opportunities', deadline, '', application_id FROM f WHERE deadline_state <> 'known'
UNION ALL SELECT user_id, 'upcoming_reminders', scheduled_at, '', reminder_id FROM r JOIN a USING (application_id) WHERE status IN ('scheduled', 'snoozed'))
SELECT user_id, list, place, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, list ORDER BY at_ ASC NULLS LAST, priority DESC, item_id) AS place FROM l) p WHERE place <= 20"""


def tables(t):
    """(applications, tasks, reminders)."""
    of = lambda df, expressions: df.selectExpr(*[f"{e} AS {n}" for n, e in expressions.items()])
    return of(t.orders, APPLICATION), of(t.lineitem, TASK), of(t.lineitem.filter("l_returnflag = 'R'"), REMINDER)


@query("dashboard_lists", DASHBOARD_SQL)
def dashboard_lists(t):
    """Every student's seven lists, each with its first twenty items."""
    return tracker.dashboard(*tables(t), clock(ORDER_CLOCK))


# An application's opportunity is a part; its lines' next actions come from their evaluation.
DOCUMENTS = ["Transcript", " transcript ", "Referee letter", "TRANSCRIPT", "Passport copy"]
ACTIONS = ["Add your ielts to evaluate this requirement.", "Verify funding coverage from the official source.", "passport COPY", ""]
STARTER_SQL = f"""
WITH a AS (SELECT o_orderkey AS application_id, CASE WHEN o_orderkey % 13 = 0 THEN 'uncertain' ELSE 'known' END AS deadline_state, 1 + o_orderkey % (SELECT max(p_partkey) FROM part) AS p FROM orders),
j AS (SELECT a.*, p_size, p_partkey FROM a JOIN part ON p_partkey = p),
t AS (SELECT application_id, 0 AS g, i - 1 AS at_, CASE WHEN lower(d) LIKE '%referee%' THEN 'recommendation' ELSE 'document' END AS category, trim(d) AS title, 'normal' AS priority FROM (SELECT application_id, p_size, unnest(list_slice({DOCUMENTS}, 1, CAST(p_size % 6 AS BIGINT))) AS d, generate_subscripts(list_slice({DOCUMENTS}, 1, CAST(p_size % 6 AS BIGINT)), 1) AS i FROM j) d
UNION ALL SELECT application_id, 1, 0, 'test', '{tracker.TEST_TASK}', 'high' FROM j WHERE p_size % 3 = 0 OR p_size % 5 = 0 UNION ALL SELECT application_id, 2, 0, 'funding', '{tracker.FEE_TASK}', 'normal' FROM j WHERE p_size % 4 = 0
UNION ALL SELECT application_id, 3, 0, 'official_verification', '{tracker.DEADLINE_TASK}', 'high' FROM j WHERE deadline_state = 'uncertain'
UNION ALL SELECT l_orderkey, 4, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'official_verification' ELSE 'personal' END, trim(list_extract({ACTIONS}, CAST(l_linenumber % 4 + 1 AS BIGINT))), 'normal' FROM lineitem WHERE l_orderkey IN (SELECT application_id FROM a)),
k AS (SELECT * FROM t WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY application_id, category, lower(title) ORDER BY g, at_, title) = 1)
SELECT application_id, row_number() OVER (PARTITION BY application_id ORDER BY g, at_, category, title) AS place, category, title, priority FROM k"""


@query("starter_tasks", STARTER_SQL)
def starter_tasks(t):
    """The tasks that each application starts with, from its five sources."""
    last = t.part.agg(F.max("p_partkey").alias("last"))
    applications = t.orders.join(F.broadcast(last)).selectExpr("o_orderkey AS application_id", "CASE WHEN o_orderkey % 13 = 0 THEN 'uncertain' ELSE 'known' END AS deadline_state", "1 + o_orderkey % last AS opportunity_id")
    documents = F.slice(F.array(*map(F.lit, DOCUMENTS)), F.lit(1), (F.col("p_size") % 6).cast("int"))
    opportunities = t.part.select(
        F.col("p_partkey").alias("opportunity_id"), documents.alias("required_documents"), F.when(F.col("p_size") % 3 == 0, "IELTS").alias("english_language_requirement"), F.when(F.col("p_size") % 5 == 0, "GRE").alias("standardized_test_requirement"),
        F.when(F.col("p_size") % 4 == 0, "50 EUR").alias("application_fee_info"),
    )
    action = F.get(F.array(*map(F.lit, ACTIONS)), (F.col("l_linenumber") % 4).cast("int"))
    actions = t.lineitem.select(F.col("l_orderkey").alias("application_id"), F.col("l_linenumber").alias("place"), action.alias("action"), (F.col("l_returnflag") == "N").alias("sourced"))
    return tracker.starter_tasks(applications, opportunities, actions)
