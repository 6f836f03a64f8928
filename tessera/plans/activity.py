"""Applications, quotas, retention, audit and metrics over orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import temporal
from ..operators import audit, metrics, retention, transitions
from ..operators.export import nested_json
from ..operators.foreign_keys import SET_NULL, ForeignKey, deleted
from ..operators.relational import dealt, exists, insert_absent, page, parts_for, recent, top_one, update_sequence, updated_rows, upsert_keep, versioned_update
from ..sources.catalogue import shared_folder
from ..streaming import stateful
from .registry import EVENT_CLOCK, ORDER_CLOCK, clock, query



def today():
    return clock(ORDER_CLOCK)


def event_day():
    return clock(EVENT_CLOCK)


@query("next_reminders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-09-01 00:00:00' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def next_reminders(t):
    return page(t.orders.filter(F.col("o_orderdate") >= today()), [F.col("o_orderdate"), F.col("o_orderkey")], 20).select("o_orderkey", "o_orderdate")


@query("task_list", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderdate NULLS LAST, o_orderpriority DESC, o_orderkey LIMIT 25")
def task_list(t):
    return page(t.orders, [F.col("o_orderdate").asc_nulls_last(), F.desc("o_orderpriority"), F.col("o_orderkey")], 25).select("o_orderkey", "o_orderpriority")


@query(
    "task_funnel",
    "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'X') AS dismissed, "
    "round(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')), 0), 4) AS delivery_rate FROM orders",
)
def task_funnel(t):
    n = lambda *s: F.count_if(F.col("o_orderstatus").isin(*s))
    return t.orders.agg(n("O").alias("open"), n("F").alias("done"), n("P").alias("pending"), n("X").alias("dismissed"), F.round(F.try_divide(n("F"), n("F", "P")), 4).alias("delivery_rate"))


@query("status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_counts(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("overdue", "SELECT o_custkey, count(*) AS overdue FROM orders WHERE o_orderdate < TIMESTAMP '1998-09-01 00:00:00' AND o_orderstatus NOT IN ('F') GROUP BY 1")
def overdue(t):
    return t.orders.filter((F.col("o_orderdate") < today()) & ~F.col("o_orderstatus").isin("F")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("overdue"))


@query("private_progress", "SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_linestatus = 'O') AS outstanding FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def private_progress(t):
    own = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return own.groupBy("o_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("outstanding"))


@query("private_progress_all", "SELECT o_custkey, o_orderkey, count(l_orderkey) FILTER (WHERE l_linestatus = 'O') AS outstanding FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def private_progress_all(t):
    own = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return own.groupBy("o_custkey", "o_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("outstanding"))


MOVES = {"signup": ["view", "click"], "view": ["click", "purchase", "view"], "click": ["view", "purchase"], "purchase": ["view"], "error": []}
MOVES_SQL = ", ".join(f"('{a}', '{b}')" for a, to in MOVES.items() for b in to)


@query(
    "transition_audit",
    f"SELECT event_id, previous_state, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM events) t WHERE previous_state IS NOT NULL AND previous_state <> event_type AND (previous_state, event_type) NOT IN ({MOVES_SQL})",
)
def transition_audit(t):
    return transitions.invalid_moves(t.events, "user_id", ["ts", "event_id"], "event_type", MOVES).select("event_id", "previous_state", "event_type")


@query("legacy_states", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'O' THEN 'preparing' ELSE 'withdrawn' END AS state FROM orders")
def legacy_states(t):
    from ..functions.scalar import mapped

    old = F.when(F.col("o_orderstatus") == "F", "submitted").when(F.col("o_orderstatus") == "O", "researching").otherwise("expired")
    return t.orders.select("o_orderkey", mapped(old, temporal.LEGACY_STATES).alias("state"))


@query(
    "rolling_quota",
    "SELECT event_id, count(*) OVER d AS last_day, count(*) OVER m AS last_30_days FROM events WHERE event_type = 'view' WINDOW d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), m AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)",
)
def rolling_quota(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    last = lambda days: Window.partitionBy("user_id").orderBy(micros).rangeBetween(-days * 86_400_000_000, 0)
    return t.events.filter("event_type = 'view'").select("event_id", F.count(F.lit(1)).over(last(1)).alias("last_day"), F.count(F.lit(1)).over(last(30)).alias("last_30_days"))


@query("quota_now", "SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-19 00:00:00') AS last_day, count(*) AS last_30_days FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2023-12-21 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def quota_now(t):
    used = t.events.filter((F.col("event_type") == "click") & F.col("ts").between(event_day() - temporal.days(30), event_day()))
    return used.groupBy("user_id").agg(F.count_if(F.col("ts") >= event_day() - temporal.days(1)).alias("last_day"), F.count(F.lit(1)).alias("last_30_days"))


@query("seats", "SELECT count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) AS taken, count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) >= 500 AS full_house, coalesce(max(event_id), 0) + 1 AS next_id FROM events")
def seats(t):
    taken = F.count_if(F.col("event_type").isin("signup", "purchase"))
    return t.events.agg(taken.alias("taken"), (taken >= 500).alias("full_house"), (F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next_id"))


@query("retention_purge", "SELECT event_id FROM events WHERE NOT coalesce(ts <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AND event_type <> 'purchase', false)")
def retention_purge(t):
    return retention.purge(t.events, (F.col("ts") <= event_day() - temporal.days(7)) & (F.col("event_type") != "purchase")).select("event_id")


@query("retention_children", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderdate <= TIMESTAMP '1998-09-01 00:00:00' - INTERVAL 365 DAY) GROUP BY 1")
def retention_children(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    _, left = retention.purge_with_children(t.orders, {"lineitem": lines}, "o_orderkey", F.col("o_orderdate") <= today() - temporal.days(365))
    return left["lineitem"].groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))


@query("retention_unused", "SELECT p_partkey FROM part WHERE NOT (p_size > 25 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45))")
def retention_unused(t):
    uses = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return retention.purge_unused(t.part, uses, "p_partkey", F.col("p_size") > 25).select("p_partkey")


@query("retention_counts", "SELECT 'events' AS \"table\", count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-10 00:00:00') AS expired FROM events UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_orderdate <= TIMESTAMP '1996-01-01 00:00:00') FROM orders")
def retention_counts(t):
    return retention.counts({"events": (t.events, F.col("ts") <= clock("2024-01-10 00:00:00")), "orders": (t.orders, F.col("o_orderdate") <= clock("1996-01-01 00:00:00"))})


@query("token_reuse", "SELECT user_id, min(ts) AS reused_at, count(*) AS uses FROM (SELECT user_id, ts, min(ts) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS replaced FROM events) t WHERE ts > replaced GROUP BY 1")
def token_reuse(t):
    """A family (user) whose token is used after it was replaced (first purchase)."""
    replaced = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("replaced"))
    return t.events.join(replaced, "user_id").filter("ts > replaced").groupBy("user_id").agg(F.min("ts").alias("reused_at"), F.count(F.lit(1)).alias("uses"))


@query("latency_hist", "SELECT event_type, bucket, count(*) FILTER (WHERE b = bucket) AS n FROM (SELECT event_type, CASE WHEN value * 100 <= 50 THEN 'le_50' WHEN value * 100 <= 100 THEN 'le_100' WHEN value * 100 <= 250 THEN 'le_250' WHEN value * 100 <= 500 THEN 'le_500' WHEN value * 100 <= 1000 THEN 'le_1000' WHEN value * 100 <= 2500 THEN 'le_2500' WHEN value * 100 <= 5000 THEN 'le_5000' ELSE 'gt_5000' END AS b FROM events) e, (SELECT unnest(['le_50', 'le_100', 'le_250', 'le_500', 'le_1000', 'le_2500', 'le_5000', 'gt_5000']) AS bucket) l GROUP BY 1, 2")
def latency_hist(t):
    return metrics.histogram(t.events.withColumn("ms", F.col("value") * 100), "event_type", "ms")


@query(
    "latency_nearest_rank",
    "SELECT event_type, max(value) FILTER (WHERE place = round_even((n - 1) * 0.5, 0)) AS p50, max(value) FILTER (WHERE place = round_even((n - 1) * 0.95, 0)) AS p95, max(value) AS max, max(n) AS n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) t GROUP BY 1",
)
def latency_nearest_rank(t):
    return metrics.nearest_rank(t.events, "event_type", "value", [0.5, 0.95])


@query("job_last10", "SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) t WHERE r <= 10")
def job_last10(t):
    return recent(t.events, ["event_type"], 10, F.desc("ts"), F.desc("event_id")).select("event_type", "event_id", "ts")


@query("job_health", "SELECT event_type, max(ts) AS last_completed, max(ts) >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 MINUTE AS fresh, max_by(event_id, (ts, event_id)) AS last_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def job_health(t):
    done = t.events.filter(F.col("ts") <= event_day())
    fresh = F.max("ts") >= event_day() - F.make_dt_interval(mins=F.lit(5))
    return done.groupBy("event_type").agg(F.max("ts").alias("last_completed"), fresh.alias("fresh"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


@query("job_runs", "SELECT user_id, ts AS started, next_ts AS completed FROM (SELECT *, lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_type FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) t WHERE event_type = 'signup' AND next_type = 'purchase'")
def job_runs(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    paired = t.events.filter(F.col("event_type").isin("signup", "purchase")).withColumns({"completed": F.lead("ts").over(w), "next_type": F.lead("event_type").over(w)})
    return paired.filter("event_type = 'signup' AND next_type = 'purchase'").select("user_id", F.col("ts").alias("started"), "completed")


@query("queue_claim", "SELECT o_orderkey, 1 AS attempts FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def queue_claim(t):
    return page(t.orders.filter("o_orderstatus = 'O'"), [F.col("o_orderdate"), F.col("o_orderkey")], 1).select("o_orderkey", F.lit(1).alias("attempts"))


@query("reminder_dispatch", "SELECT o_orderkey, 'delivered' AS status FROM orders WHERE o_orderdate <= TIMESTAMP '1998-09-01 00:00:00' AND o_orderstatus IN ('O', 'F') AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def reminder_dispatch(t):
    opted_out = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    due = t.orders.filter((F.col("o_orderdate") <= today()) & F.col("o_orderstatus").isin("O", "F"))
    return due.join(opted_out, "o_custkey", "left_anti").select("o_orderkey", F.lit("delivered").alias("status"))


@query(
    "hash_chain_verify",
    "WITH RECURSIVE o AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), c AS (SELECT user_id, r, event_id, event_type, repeat('0', 64) AS p, sha256(repeat('0', 64) || '|' || event_id || '|' || event_type) AS h FROM o WHERE r = 1 "
    "UNION ALL SELECT o.user_id, o.r, o.event_id, o.event_type, c.h, sha256(c.h || '|' || o.event_id || '|' || o.event_type) FROM c JOIN o ON o.user_id = c.user_id AND o.r = c.r + 1), "
    "s AS (SELECT user_id, r, event_id, CASE WHEN event_id % 97 = 5 THEN 'forged' ELSE event_type END AS event_type, p, CASE WHEN event_id % 89 = 7 THEN sha256(h) ELSE h END AS h FROM c) "
    "SELECT user_id, event_id FROM (SELECT *, coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY r), repeat('0', 64)) AS before FROM s) t WHERE p <> before OR h <> sha256(p || '|' || event_id || '|' || event_type)",
)
def hash_chain_verify(t):
    """Broken entries of chains in which some entries and some hashes were changed after the fact."""
    chained = audit.build_chain(t.events.select("event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])
    forged = F.when(F.col("event_id") % 97 == 5, F.lit("forged")).otherwise(F.col("event_type"))
    rehashed = F.when(F.col("event_id") % 89 == 7, F.sha2("integrity_hash", 256)).otherwise(F.col("integrity_hash"))
    stored = chained.withColumns({"event_type": forged, "integrity_hash": rehashed})
    return audit.broken_links(stored, "user_id", ["ts", "event_id"], ["event_id", "event_type"]).select("user_id", "event_id")


@query("hash_chain_heads", "WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), c AS (SELECT user_id, r, sha256(repeat('0', 64) || '|' || event_id || '|' || event_type) AS h FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, sha256(c.h || '|' || o.event_id || '|' || o.event_type) FROM c JOIN o ON o.user_id = c.user_id AND o.r = c.r + 1) SELECT user_id, max_by(h, r) AS head, count(*) AS n FROM c GROUP BY 1")
def hash_chain_heads(t):
    chained = audit.build_chain(t.events.select("event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])
    return chained.groupBy("user_id").agg(F.max_by("integrity_hash", F.struct("ts", "event_id")).alias("head"), F.count(F.lit(1)).alias("n"))


@query("blocked_users", "SELECT DISTINCT other FROM (SELECT user_id % 50 AS other FROM events WHERE user_id % 7 = 3 AND event_type = 'error' UNION SELECT user_id FROM events WHERE user_id % 50 = 3 AND event_type = 'error') t")
def blocked_users(t):
    errors = t.events.filter("event_type = 'error'")
    out = errors.filter("user_id % 7 = 3").select((F.col("user_id") % 50).alias("other"))
    return out.union(errors.filter("user_id % 50 = 3").select("user_id")).distinct()


@query("get_or_create", "SELECT coalesce(s.s_nationkey, n.n_nationkey) AS nation_key, coalesce(s.name, n.n_name) AS name FROM (SELECT s_nationkey, min(s_name) AS name FROM supplier WHERE s_nationkey < 10 GROUP BY 1) s FULL JOIN nation n ON n.n_nationkey = s.s_nationkey")
def get_or_create(t):
    existing = t.supplier.filter("s_nationkey < 10").groupBy(F.col("s_nationkey").alias("nation_key")).agg(F.min("s_name").alias("name"))
    return upsert_keep(existing, t.nation.select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("name")), ["nation_key"], ["name"])


@query("insert_if_absent", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'click') t WHERE r = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 60)")
def insert_if_absent(t):
    new = insert_absent(t.events.filter("event_type = 'signup' AND value > 60").select("user_id"), t.events.filter("event_type = 'click'"), ["user_id"], F.col("ts"), F.col("event_id"))
    return new.select("user_id", "event_id")


@query("optimistic_update", "SELECT o_custkey, outcome, count(*) AS n FROM (SELECT o_custkey, CASE WHEN c_custkey IS NULL THEN 'not_found' WHEN o_orderkey % 3 = c_nationkey % 3 THEN 'updated' ELSE 'conflict' END AS outcome FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey > 20) t GROUP BY 1, 2")
def optimistic_update(t):
    stored = t.customer.filter("c_custkey > 20").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 3).cast("long").alias("version"), "c_name")
    updates = t.orders.select("o_custkey", (F.col("o_orderkey") % 3).alias("expected_version"), F.lit("new").alias("c_name"))
    return versioned_update(stored, updates, "o_custkey", ["c_name"]).groupBy("o_custkey", "outcome").agg(F.count(F.lit(1)).alias("n"))


# Updates of a customer by its orders, in their order; some name the version that they expect.
EXPECTED = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 4 + o_custkey % 2 END"
FIELDS = "CASE o_orderkey % 3 WHEN 0 THEN array('status') WHEN 1 THEN array('status', 'priority') ELSE array('priority') END"
STORED_SQL = "SELECT c_custkey AS o_custkey, CAST(c_nationkey % 3 AS BIGINT) AS version, c_mktsegment AS status, CAST(NULL AS VARCHAR) AS priority FROM customer WHERE c_custkey > 20"
SEQUENCE_SQL = f"""
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, {EXPECTED} AS expected, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
s AS ({STORED_SQL}), j AS (SELECT o.*, s.version AS stored FROM o LEFT JOIN s USING (o_custkey)),
c AS (SELECT o_custkey, r, o_orderkey, stored IS NOT NULL AND (expected IS NULL OR expected = stored) AS ok, stored + CASE WHEN expected IS NULL OR expected = stored THEN 1 ELSE 0 END AS version FROM j WHERE r = 1
UNION ALL SELECT j.o_custkey, j.r, j.o_orderkey, c.version IS NOT NULL AND (j.expected IS NULL OR j.expected = c.version), c.version + CASE WHEN j.expected IS NULL OR j.expected = c.version THEN 1 ELSE 0 END FROM c JOIN j ON j.o_custkey = c.o_custkey AND j.r = c.r + 1)"""


def _sequence(t):
    stored = t.customer.filter("c_custkey > 20").selectExpr("c_custkey AS o_custkey", "CAST(c_nationkey % 3 AS BIGINT) AS version", "c_mktsegment AS status", "CAST(NULL AS STRING) AS priority")
    updates = t.orders.selectExpr("o_custkey", "o_orderkey", "o_orderdate", f"{EXPECTED} AS expected_version", f"{FIELDS} AS fields_set", "o_orderstatus AS status", "o_orderpriority AS priority")
    return stored, update_sequence(stored, updates, "o_custkey", "o_orderdate", "o_orderkey")


@query("update_sequence", f"{SEQUENCE_SQL} SELECT o_custkey, o_orderkey, CASE WHEN version IS NULL THEN 'not_found' WHEN ok THEN 'updated' ELSE 'conflict' END AS outcome, version FROM c")
def updates_in_sequence(t):
    """Versioned updates of a key, each deciding on the version that the one before left."""
    return _sequence(t)[1].select("o_custkey", "o_orderkey", "outcome", "version")


LAST_SQL = "arg_max({v}, c.r) FILTER (WHERE ok AND c.o_orderkey % 3 <> {without})"


@query(
    "updated_rows",
    f"{SEQUENCE_SQL}, f AS (SELECT c.o_custkey, max(c.version) FILTER (WHERE ok) AS version, {LAST_SQL.format(v='o_orderstatus', without=2)} AS status, {LAST_SQL.format(v='o_orderpriority', without=0)} AS priority FROM c JOIN o USING (o_custkey, r) GROUP BY 1) "
    "SELECT s.o_custkey, coalesce(f.version, s.version) AS version, coalesce(f.status, s.status) AS status, f.priority FROM s LEFT JOIN f USING (o_custkey)",
)
def rows_after_updates(t):
    """The customers after those updates: each applies the fields that it names."""
    stored, decided = _sequence(t)
    return updated_rows(stored, decided, "o_custkey", ["status", "priority"], "o_orderdate", "o_orderkey")


# Keys of the tables; an order's parent is an order, as a reply's is a post.
EDGES = [
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey", SET_NULL), ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"), ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("orders", "o_parent", "orders", "o_orderkey"), ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), ForeignKey("lineitem", "l_partkey", "part", "p_partkey"), ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey", SET_NULL),
]
GONE_SQL = """
WITH RECURSIVE customers AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_acctbal < -900),
gone AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customers) UNION SELECT o.o_orderkey FROM orders o JOIN gone g ON o.o_orderkey // 3 = g.o_orderkey)"""


def _after_delete(t, lines=None):
    tables = {n: getattr(t, n) for n in ("nation", "supplier", "customer", "part")} | {"lineitem": t.lineitem if lines is None else lines}
    tables["orders"] = t.orders.withColumn("o_parent", F.expr("o_orderkey div 3"))
    if not t.spark.sparkContext.getCheckpointDir():
        t.spark.sparkContext.setCheckpointDir(shared_folder(t.spark))
    return deleted(tables, EDGES, {"nation": F.col("n_nationkey") == 3, "customer": F.col("c_acctbal") < -900, "part": F.col("p_size") == 50, "supplier": F.col("s_acctbal") < 0})


@query(
    "cascade_graph",
    f"{GONE_SQL} SELECT l_orderkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE l_suppkey END AS l_suppkey, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 50) GROUP BY 1, 2",
)
def cascade_graph(t):
    """Lines after nations, customers, parts and suppliers are deleted, through customers and chains of orders."""
    lines = dealt(t.lineitem, "l_orderkey", parts_for(t.lineitem))  # the join with orders and the grouping keep these parts
    return _after_delete(t, lines)["lineitem"].groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cascade_counts",
    f"{GONE_SQL} SELECT 'orders' AS \"table\", count(*) AS n, 0 AS nulls FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone) UNION ALL SELECT 'supplier', count(*), count(*) FILTER (WHERE s_nationkey = 3) FROM supplier WHERE s_acctbal >= 0 "
    "UNION ALL SELECT 'customer', count(*), 0 FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customers)",
)
def cascade_counts(t):
    """Rows that are left of each table, and keys that became null."""
    left = _after_delete(t)
    parts = [left[n].agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).cast("int").alias("nulls")).select(F.lit(n).alias("table"), "n", "nulls") for n, c in (("orders", "o_custkey"), ("supplier", "s_nationkey"), ("customer", "c_nationkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "rate_limiter",
    "WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), c AS (SELECT user_id, r, event_id, [t] AS times, true AS allowed, 0::BIGINT AS wait FROM o WHERE r = 1 "
    "UNION ALL SELECT user_id, r, event_id, CASE WHEN len(held) < 3 THEN list_append(held, t) ELSE held END, len(held) < 3, CASE WHEN len(held) < 3 THEN 0 ELSE greatest(1, (held[1] + 3600000000 - t) // 1000000) END "
    "FROM (SELECT o.*, list_filter(c.times, lambda x: x > o.t - 3600000000) AS held FROM c JOIN o ON o.user_id = c.user_id AND o.r = c.r + 1) j) SELECT user_id::VARCHAR AS key, event_id, allowed, wait AS retry_after FROM c",
)
def rate_limiter(t):
    """Sliding-window decisions per user: at most 3 requests an hour."""
    return stateful.sliding_limits(t.events.select(F.col("user_id").cast("string").alias("key"), "ts", "event_id"), 3, 3600)


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(t):
    counted = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("user_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE, true) AS gap FROM events) a) b GROUP BY user_id, session")
def user_sessions(t):
    counted = t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "export_account",
    "SELECT c_custkey, 0 AS section, 0 AS place, '{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\",\"orders\":[' AS fragment FROM customer "
    "UNION ALL SELECT o_custkey, 1, nth, CASE WHEN nth > 1 THEN ',' ELSE '' END || '{\"o_orderkey\":' || o_orderkey || '}' FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) o "
    "UNION ALL SELECT c_custkey, 2, 0, '],\"events\":[' FROM customer "
    "UNION ALL SELECT user_id, 3, nth, CASE WHEN nth > 1 THEN ',' ELSE '' END || '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) e "
    "UNION ALL SELECT c_custkey, 4, 0, ']}' FROM customer",
)
def export_account(t):
    """Everything of each account as nested JSON: its orders and its events, each in their order."""
    orders, events = t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.events.withColumnRenamed("user_id", "c_custkey")
    sections = {"orders": (orders, ["o_orderkey"], ["o_orderdate", "o_orderkey"]), "events": (events, ["event_id", "event_type"], ["ts", "event_id"])}
    return nested_json(t.customer, "c_custkey", ["c_custkey", "c_mktsegment"], sections)


@query("evidence_references", "SELECT l_orderkey, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)")
def evidence_references(t):
    own = t.part.filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(own, "l_partkey", "left_anti").select("l_orderkey", "l_partkey")


@query("owner_delete", "SELECT o_orderkey FROM orders WHERE o_custkey <> 7 AND o_custkey IN (SELECT c_custkey FROM customer)")
def owner_delete(t):
    return exists(t.orders.filter("o_custkey <> 7"), t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")
