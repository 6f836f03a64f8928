"""The application tracker: a student's dashboard and the tasks that a new application starts with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import casefolded, starter_category, trimmed
from ..functions.temporal import days
from .relational import dealt, parts_for, recent

# Lifecycles that count as submitted, states of tasks and reminders that are still open.
SUBMITTED = ["submitted", "decision_received", "accepted", "declined"]
OPEN_TASKS, WAITING = ["todo", "in_progress", "blocked"], ["scheduled", "snoozed"]
# Tasks that requirements of an opportunity lead to.
TEST_TASK, FEE_TASK, DEADLINE_TASK = "Confirm test requirement", "Confirm application fee or waiver", "Verify official application deadline"


def dashboard(applications: DataFrame, tasks: DataFrame, reminders: DataFrame, now: Column, most: int = 20, seen: int = 100, soon: int = 14) -> DataFrame:
    """user_id, list, place, item_id: the seven lists of each student, each cut to `most`.

    applications has user_id, application_id, lifecycle, deadline and deadline_state, of which a student's first `seen`
    by deadline count; tasks application_id, task_id, status, due_at and priority; reminders application_id,
    reminder_id, status and scheduled_at. Priorities sort as text, falling: urgent, normal, low, high. Dates that are
    null come last, deadlines that have passed are approaching too.
    """
    end = now + days(soon)
    # The three joins by application share the tasks of one stage, so their parts are of a bounded number of rows.
    parts = max(map(parts_for, (applications, tasks, reminders)))
    tasks, reminders = (dealt(df, "application_id", parts) for df in (tasks, reminders))
    by_deadline = [F.col("deadline").asc_nulls_last(), F.col("application_id")]
    own = recent(applications, ["user_id"], seen, *by_deadline)
    owners = dealt(applications.select("user_id", "application_id"), "application_id", parts)
    open_ = tasks.filter(F.col("status").isin(OPEN_TASKS))
    blocked = open_.filter("status = 'blocked'").select("application_id").distinct().withColumn("blocked", F.lit(True))
    own = own.join(blocked, "application_id", "left")
    on_task = {"urgent_tasks": (F.col("due_at") <= end) & (F.col("status") != "blocked"), "blocked_tasks": F.col("status") == "blocked"}
    on_application = {
        "blocked_applications": F.coalesce("blocked", F.lit(False)),
        "approaching_deadlines": F.col("deadline") <= end,
        "submitted_applications": F.col("lifecycle").isin(SUBMITTED),
        "recently_changed_opportunities": F.col("deadline_state") != "known",
    }
    waiting = reminders.filter(F.col("status").isin(WAITING)).withColumns({"due_at": F.col("scheduled_at"), "priority": F.lit("")})

    def listed(df: DataFrame, lists: dict[str, Column], item: str, at: str, priority: Column) -> DataFrame:
        names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in lists.items()]))
        return df.select("user_id", F.explode(names).alias("list"), F.col(at).alias("at"), priority.alias("priority"), F.col(item).alias("item_id"))

    lists = [
        listed(open_.join(owners, "application_id"), on_task, "task_id", "due_at", F.col("priority")),
        listed(own, on_application, "application_id", "deadline", F.lit("")),
        listed(waiting.join(owners, "application_id"), {"upcoming_reminders": F.lit(True)}, "reminder_id", "due_at", F.col("priority")),
    ]
    place = F.row_number().over(Window.partitionBy("user_id", "list").orderBy(F.col("at").asc_nulls_last(), F.desc("priority"), "item_id")).cast("long")
    return reduce(DataFrame.unionByName, lists).withColumn("place", place).filter(F.col("place") <= most).select("user_id", "list", "place", "item_id")


def starter_tasks(applications: DataFrame, opportunities: DataFrame, actions: DataFrame) -> DataFrame:
    """application_id, place, category, title, priority: the tasks that an application starts with, in order.

    From the opportunity's required documents, its tests, its fee, an uncertain deadline, and the next actions of the
    latest evaluation; the first of a category and title, white space at its ends and case aside, wins. applications
    has application_id, opportunity_id and deadline_state; opportunities opportunity_id, required_documents,
    english_language_requirement, standardized_test_requirement and application_fee_info; actions application_id,
    place, action and sourced (whether its rule names a source).
    """
    joined = applications.join(opportunities, "opportunity_id")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    task = lambda group, place, category, title, priority: F.struct(F.lit(group).alias("group"), place.cast("long").alias("place"), category.alias("category"), title.alias("title"), F.lit(priority).alias("priority"))
    one = lambda group, condition, category, title, priority: F.when(condition, task(group, F.lit(0), F.lit(category), F.lit(title), priority))
    documents = F.transform(F.coalesce("required_documents", F.array().cast("array<string>")), lambda name, i: task(0, i, starter_category(name), name, "normal"))
    rest = F.array_compact(F.array(
        one(1, given("english_language_requirement") | given("standardized_test_requirement"), "test", TEST_TASK, "high"), one(2, given("application_fee_info"), "funding", FEE_TASK, "normal"),
        one(3, F.col("deadline_state") == "uncertain", "official_verification", DEADLINE_TASK, "high"),
    ))
    own = joined.select("application_id", F.explode(F.concat(documents, rest)).alias("t"))
    category = F.when(F.col("sourced"), "official_verification").otherwise("personal")
    more = actions.join(applications.select("application_id"), "application_id", "left_semi").select("application_id", task(4, F.col("place"), category, F.col("action"), "normal").alias("t"))
    all_ = own.unionByName(more).select("application_id", "t.*").withColumn("title", trimmed(F.col("title"))).filter("title <> ''")
    first = Window.partitionBy("application_id", "category", casefolded(F.col("title"))).orderBy("group", "place", "title")
    kept = all_.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    order = Window.partitionBy("application_id").orderBy("group", "place", "category", "title")
    return kept.select("application_id", F.row_number().over(order).cast("long").alias("place"), "category", "title", "priority")
