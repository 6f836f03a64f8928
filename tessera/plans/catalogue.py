"""Catalogue search, evidence selection, data quality and import over orders and lineitem.

orders stand for opportunities (deadline o_orderdate), lineitem for their sources (l_returnflag N, A, R: verified,
to review, conflicting; l_linestatus O: official; l_shipdate: last verified).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, temporal
from ..operators import monitor, quality
from ..operators.export import nested_json
from ..operators.relational import any_of, by_alias, exists, flagged, like_anywhere, not_exists, page, page_info, top_one
from .registry import ORDER_CLOCK, clock, query



#: Aliases of a fee status, as stored: F none, O required, P unknown.
FEES = {"free": "F", "none": "F", "no": "F", "no-fee": "F", "paid": "O", "required": "O", "unknown": "P"}


def today():
    return clock(ORDER_CLOCK)


STATE_SQL = (
    "CASE WHEN o_orderstatus = 'P' THEN 'archived' WHEN o_orderdate < TIMESTAMP '1998-09-01 00:00:00' THEN 'closed' "
    "WHEN o_orderdate > TIMESTAMP '1999-09-01 00:00:00' THEN 'upcoming' ELSE 'open' END"
)
RANK_SQL = "CASE window_state WHEN 'open' THEN 0 WHEN 'upcoming' THEN 1 WHEN 'closed' THEN 3 ELSE 4 END"
PUBLIC_SQL = (
    "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_returnflag = 'N') "
    "AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_returnflag = 'R')"
)


def with_state(orders):
    later = clock("1999-09-01 00:00:00")
    upcoming = F.when(F.col("o_orderdate") > later, F.col("o_orderdate"))
    state = temporal.window_state(today(), upcoming, F.col("o_orderdate"), F.lit(False), F.col("o_orderstatus") == "P")
    return orders.withColumn("window_state", state)


def sources(t):
    return t.lineitem.filter("l_linestatus = 'O'").withColumnRenamed("l_orderkey", "o_orderkey")


def public(t):
    official = sources(t).select("o_orderkey", "l_returnflag")
    return not_exists(exists(t.orders, official.filter("l_returnflag = 'N'"), "o_orderkey"), official.filter("l_returnflag = 'R'"), "o_orderkey")


def ordered():
    return [temporal.window_rank(F.col("window_state")), F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")]


@query("catalogue_search", f"SELECT o_orderkey, window_state, o_orderpriority FROM (SELECT o.*, {STATE_SQL} AS window_state FROM orders o WHERE {PUBLIC_SQL}) t ORDER BY {RANK_SQL}, o_orderdate ASC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def catalogue_search(t):
    return page(with_state(public(t)), ordered(), limit=20, offset=40).select("o_orderkey", "window_state", "o_orderpriority")


@query("catalogue_count", f"SELECT count(DISTINCT o_orderkey) AS total FROM orders WHERE {PUBLIC_SQL}")
def catalogue_count(t):
    return public(t).agg(F.countDistinct("o_orderkey").alias("total"))


@query("catalogue_page_info", f"SELECT count(*) AS total, greatest(0, least(20, count(*) - 40)) AS count, 40 + greatest(0, least(20, count(*) - 40)) < count(*) AS has_next, true AS has_previous FROM orders WHERE {PUBLIC_SQL}")
def catalogue_page_info(t):
    return page_info(public(t), 20, 40)


@query("catalogue_all", f"SELECT o_orderkey, {STATE_SQL} AS window_state FROM orders WHERE {PUBLIC_SQL}")
def catalogue_all(t):
    return with_state(public(t)).select("o_orderkey", "window_state")


@query(
    "catalogue_open_now",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND (o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1998-09-01 00:00:00') AND EXISTS (SELECT 1 FROM lineitem "
    "WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_returnflag = 'N' AND l_shipdate >= TIMESTAMP '1998-09-01 00:00:00' - INTERVAL 90 DAY)",
)
def catalogue_open_now(t):
    fresh = sources(t).filter(temporal.is_fresh(F.col("l_shipdate"), today()) & (F.col("l_returnflag") == "N"))
    open_ = t.orders.filter((F.col("o_orderstatus") != "P") & (F.col("o_orderdate").isNull() | (F.col("o_orderdate") >= today())))
    return exists(open_, fresh, "o_orderkey").select("o_orderkey")


@query("catalogue_state_filter", f"SELECT window_state, count(*) AS n FROM (SELECT {STATE_SQL} AS window_state FROM orders) t WHERE window_state IN ('open', 'upcoming') GROUP BY 1")
def catalogue_state_filter(t):
    return with_state(t.orders).filter(F.col("window_state").isin("open", "upcoming")).groupBy("window_state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "catalogue_filters",
    "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE lower(c_name) LIKE '%cust_mer#%1_%' "
    "AND lower(c_mktsegment) = 'building' AND o_totalprice BETWEEN 1000 AND 200000 AND (o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '1999-01-01 00:00:00') AND o_orderstatus IN ('O', 'F') "
    "AND o_orderpriority NOT IN ('5-LOW')",
)
def catalogue_filters(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    kept = joined.filter(
        like_anywhere(F.col("c_name"), "cust_mer#%1_")
        & (F.lower("c_mktsegment") == "building")
        & F.col("o_totalprice").between(1000, 200000)
        & any_of(F.col("o_orderdate").isNull(), F.col("o_orderdate") <= clock("1999-01-01 00:00:00"))
        & F.col("o_orderstatus").isin("O", "F")
        & ~F.col("o_orderpriority").isin("5-LOW")
    )
    return kept.select("o_orderkey", "c_name", "n_name")


@query(
    "text_any_column",
    "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%#1_%' OR lower(p_type) LIKE '%steel%'",
)
def text_any_column(t):
    return t.part.filter(any_of(like_anywhere(F.col("p_name"), "ring"), like_anywhere(F.col("p_brand"), "#1_"), like_anywhere(F.col("p_type"), "steel"))).select("p_partkey")


@query(
    "structured_include_exclude",
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_brand IN ('Brand#1', 'Brand#2')) "
    "AND NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#3')",
)
def structured_include_exclude(t):
    values = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "p_brand")
    included = exists(t.orders, values.filter(F.col("p_brand").isin("Brand#1", "Brand#2")), "o_orderkey")
    return not_exists(included, values.filter("p_brand = 'Brand#3'"), "o_orderkey").select("o_orderkey")


@query("alias_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def alias_filter(t):
    return by_alias(t.orders, "o_orderstatus", " No-Fee ", FEES).select("o_orderkey")


@query("unknown_alias_filter", "SELECT count(*) AS n FROM orders WHERE false")
def unknown_alias_filter(t):
    return by_alias(t.orders, "o_orderstatus", "sometimes", FEES).agg(F.count(F.lit(1)).alias("n"))


@query(
    "admin_search_needs_review",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
)
def admin_search_needs_review(t):
    conflicting = t.lineitem.filter("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return flagged(t.orders, conflicting, ["o_orderkey"], "conflict").filter("o_orderstatus = 'P' OR conflict").select("o_orderkey", "o_orderdate")


BEST_SQL = (
    "SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, "
    "l_extendedprice, l_discount, l_tax) AS r FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N') t WHERE r = 1"
)


@query("best_source_per_order", BEST_SQL)
def best_source_per_order(t):
    verified = t.lineitem.filter("l_linestatus = 'O' AND l_returnflag = 'N'")
    order = [F.desc("l_shipdate"), *[F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]]
    return top_one(verified, ["l_orderkey"], *order).select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")


@query("evidence_selection", f"SELECT b.* FROM ({BEST_SQL}) b WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = b.l_orderkey AND l.l_linestatus = 'O' AND l.l_returnflag = 'R') AND b.l_shipdate >= TIMESTAMP '1998-09-01 00:00:00' - INTERVAL 90 DAY")
def evidence_selection(t):
    disqualified = t.lineitem.filter("l_linestatus = 'O' AND l_returnflag = 'R'")
    return not_exists(best_source_per_order(t), disqualified, "l_orderkey").filter(temporal.is_fresh(F.col("l_shipdate"), today()))


@query("latest_source", "SELECT l_orderkey, max(l_shipdate) AS latest, count(*) AS n_sources, bool_or(l_returnflag = 'R') AS disqualified, bool_and(l_linestatus = 'O') AS all_official FROM lineitem GROUP BY 1")
def latest_source(t):
    return t.lineitem.groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("latest"), F.count(F.lit(1)).alias("n_sources"), F.bool_or(F.col("l_returnflag") == "R").alias("disqualified"), F.bool_and(F.col("l_linestatus") == "O").alias("all_official")
    )


@query(
    "current_cycle",
    "SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag = 'A' AS archived FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'A', "
    "CASE WHEN l_returnflag = 'A' THEN NULL ELSE coalesce(l_shipdate, TIMESTAMP '9999-12-31 00:00:00') END DESC NULLS LAST, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) AS r FROM lineitem) t WHERE r = 1",
)
def current_cycle(t):
    archived = F.col("l_returnflag") == "A"
    deadline = F.when(~archived, F.coalesce("l_shipdate", clock("9999-12-31 00:00:00")))
    order = [archived, deadline.desc_nulls_last(), *[F.desc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]]
    return top_one(t.lineitem, ["l_orderkey"], *order).select("l_orderkey", F.col("l_linenumber"), "l_shipdate", archived.alias("archived"))


MONITORED = {
    "o_orderkey": "l_orderkey",
    "source_id": "l_partkey * 100000 + l_suppkey",
    "source_type": "CASE WHEN l_returnflag = 'A' THEN 'provider' ELSE 'official' END",
    "verification_status": "CASE WHEN l_linestatus = 'O' THEN 'officially_verified' ELSE 'needs_review' END",
    "last_updated_at": "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_shipdate + INTERVAL '20' DAY END",
    "last_verified_at": "l_shipdate",
}
MONITORED_SQL = ", ".join(f"{e} AS {n}" for n, e in MONITORED.items())


@query(
    "due_sources",
    f"SELECT o_orderkey, source_id, last_updated_at FROM (SELECT {MONITORED_SQL}, l_linenumber FROM lineitem) s WHERE source_type = 'official' AND verification_status = 'officially_verified' AND (last_updated_at IS NULL OR last_updated_at <= TIMESTAMP '1998-09-01 00:00:00' - INTERVAL 7 DAY "
    "OR last_verified_at <= TIMESTAMP '1998-09-01 00:00:00' - INTERVAL 90 DAY) AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ORDER BY last_updated_at NULLS FIRST, o_orderkey, source_id LIMIT 20",
)
def due_sources(t):
    found = t.lineitem.selectExpr(*[f"{e} AS {n}" for n, e in MONITORED.items()])
    due = monitor.due(found, t.orders.filter("o_orderstatus <> 'P'"), "o_orderkey", today())
    return page(due, [F.col("last_updated_at").asc_nulls_first(), F.col("o_orderkey"), F.col("source_id")], 20).select("o_orderkey", "source_id", "last_updated_at")


@query("lifecycle_reconcile", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND {STATE_SQL} = 'closed' THEN 'expired' ELSE o_orderstatus END AS status FROM orders")
def lifecycle_reconcile(t):
    expired = (F.col("o_orderstatus") == "O") & (F.col("window_state") == "closed")
    return with_state(t.orders).select("o_orderkey", F.when(expired, "expired").otherwise(F.col("o_orderstatus")).alias("status"))


@query("lifecycle_summary", f"SELECT count(*) AS checked, count(*) FILTER (WHERE o_orderstatus = 'O' AND {STATE_SQL} = 'closed') AS expired FROM orders")
def lifecycle_summary(t):
    return with_state(t.orders).agg(F.count(F.lit(1)).alias("checked"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("window_state") == "closed")).alias("expired"))


# Data quality: codes per source line and per order.
SOURCE_CHECKS = [
    ("source_requires_review", "high", "A source requires review", "l_returnflag = 'A'"),
    ("source_conflict", "high", "Sources conflict", "l_returnflag = 'R'"),
    ("source_never_verified", "medium", "A source was never verified", "l_shipdate IS NULL"),
    ("source_stale", "high", "A source is stale", "l_shipdate < TIMESTAMP '1998-06-03 00:00:00'"),
    ("source_hash_missing", "low", "A source has no hash", "l_tax = 0"),
]
ORDER_CHECKS = [
    ("official_source_missing", "high", "There is no source", "NOT has_source"),
    ("deadline_missing", "high", "The deadline is missing", "o_orderdate IS NULL"),
    ("required_documents_missing", "medium", "No documents are listed", "o_totalprice < 5000"),
    ("english_requirement_missing", "medium", "The language requirement is missing", "o_orderpriority = '4-NOT SPECIFIED'"),
    ("academic_requirement_missing", "medium", "The academic requirement is missing", "o_orderpriority IS NULL"),
    ("structured_eligibility_missing", "high", "There is no structured rule", "NOT has_rule"),
    ("unstructured_nationality", "high", "Nationality is not structured", "o_orderpriority LIKE '1%' AND NOT has_rule_a"),
    ("unstructured_field", "high", "Field is not structured", "o_orderpriority LIKE '2%' AND NOT has_rule_b"),
    ("unstructured_academic", "high", "Academic text is not structured", "o_orderpriority LIKE '3%' AND NOT has_rule_c"),
    ("unstructured_english", "high", "Language text is not structured", "o_orderpriority LIKE '5%' AND NOT has_rule_a"),
    ("funding_type_unknown", "medium", "The funding is unknown", "o_orderstatus = 'P'"),
    ("low_data_confidence", "medium", "Confidence is low", "o_totalprice > 400000"),
]
RULE_CHECK = ("eligibility_rule_evidence_missing", "high", "A rule lacks evidence", "NOT has_part OR p_size > 45")
FLAGS_SQL = {
    "has_source": "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "has_rule": "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')",
    "has_rule_a": "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_quantity < 15)",
    "has_rule_b": "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_quantity BETWEEN 15 AND 30)",
    "has_rule_c": "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_quantity > 30)",
}
ISSUES_SQL = " UNION ALL ".join(
    [f"SELECT '{c}' AS code, '{s}' AS severity, '{m}' AS message, l_orderkey AS o_orderkey, l_suppkey AS source_key FROM lineitem WHERE {w}" for c, s, m, w in SOURCE_CHECKS]
    + [f"SELECT '{c}', '{s}', '{m}', o_orderkey, NULL FROM (SELECT o.*, {', '.join(f'{e} AS {n}' for n, e in FLAGS_SQL.items())} FROM orders o) t WHERE {w}" for c, s, m, w in ORDER_CHECKS]
    + [f"SELECT '{RULE_CHECK[0]}', '{RULE_CHECK[1]}', '{RULE_CHECK[2]}', l_orderkey, l_suppkey FROM (SELECT l.*, p_size, p_partkey IS NOT NULL AS has_part FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey) t WHERE {RULE_CHECK[3]}"]
)


def all_issues(t):
    checks = lambda rows: [(c, s, m, F.expr(w)) for c, s, m, w in rows]
    lines = t.lineitem.join(t.part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("has_part", F.col("p_partkey").isNotNull())
    by_line = quality.issues(lines, checks([*SOURCE_CHECKS, RULE_CHECK]), F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("source_key"))
    official = F.col("l_linestatus") == "O"
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.lit(True).alias("has_source"),
        F.bool_or(official).alias("has_rule"),
        F.bool_or(official & (F.col("l_quantity") < 15)).alias("has_rule_a"),
        F.bool_or(official & F.col("l_quantity").between(15, 30)).alias("has_rule_b"),
        F.bool_or(official & (F.col("l_quantity") > 30)).alias("has_rule_c"),
    )
    orders = t.orders.join(flags, "o_orderkey", "left").na.fill(False, list(FLAGS_SQL))
    by_order = quality.issues(orders, checks(ORDER_CHECKS), F.col("o_orderkey"), F.lit(None).cast("long").alias("source_key"))
    return by_line.unionByName(by_order)


@query("quality_issues", ISSUES_SQL)
def quality_issues(t):
    return all_issues(t).select("code", "severity", "message", "o_orderkey", "source_key")


@query("quality_counts", f"SELECT severity, code, count(*) AS n FROM ({ISSUES_SQL}) i GROUP BY 1, 2")
def quality_counts(t):
    return quality.issue_counts(all_issues(t))


@query("review_queue", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM ({ISSUES_SQL}) i WHERE severity IN ('high', 'medium'))")
def review_queue(t):
    serious = all_issues(t).filter(F.col("severity").isin("high", "medium"))
    return exists(t.orders, serious, "o_orderkey").select("o_orderkey", "o_orderdate")


@query(
    "issue_page",
    f"SELECT o_orderkey, code, severity, source_key FROM ({ISSUES_SQL}) i ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o_orderkey, code, source_key NULLS FIRST LIMIT 50",
)
def issue_page(t):
    order = [temporal.severity_rank(F.col("severity")), F.col("o_orderkey"), F.col("code"), F.col("source_key").asc_nulls_first()]
    return page(all_issues(t), order, 50).select("o_orderkey", "code", "severity", "source_key")


@query("issues_by_order", f"SELECT o_orderkey, count(*) AS n_issues, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM ({ISSUES_SQL}) i GROUP BY 1")
def issues_by_order(t):
    return all_issues(t).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_issues"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


@query(
    "verification_freshness",
    "SELECT freshness, count(*) AS n FROM (SELECT CASE WHEN l_shipdate IS NULL THEN 'historical' WHEN l_shipdate >= TIMESTAMP '1998-09-01 00:00:00' - INTERVAL 90 DAY THEN 'recent' "
    "WHEN l_shipdate >= TIMESTAMP '1998-09-01 00:00:00' - INTERVAL 180 DAY THEN 'recheck_recommended' ELSE 'historical' END AS freshness FROM lineitem) t GROUP BY 1",
)
def verification_freshness(t):
    return t.lineitem.groupBy(temporal.verification_freshness(F.col("l_shipdate"), today()).alias("freshness")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "deadline_urgency",
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' OR o_orderdate IS NULL THEN 'uncertain' WHEN o_orderstatus = 'P' THEN 'changed' WHEN o_orderdate < TIMESTAMP '1998-09-01 00:00:00' THEN 'overdue' "
    "WHEN o_orderdate <= TIMESTAMP '1998-09-15 00:00:00' THEN 'due_soon' ELSE 'upcoming' END AS urgency FROM orders",
)
def deadline_urgency(t):
    return t.orders.select("o_orderkey", temporal.urgency(F.col("o_orderdate"), F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "5-LOW", today()).alias("urgency"))


@query(
    "deadline_projection",
    f"SELECT o_orderkey, CASE WHEN l_shipdate IS NULL OR o_orderstatus = 'P' THEN 'uncertain' WHEN o_orderdate IS NOT NULL AND o_orderdate <> l_shipdate THEN 'changed' ELSE 'known' END AS deadline_state FROM orders LEFT JOIN ({BEST_SQL}) b ON l_orderkey = o_orderkey",
)
def deadline_projection(t):
    joined = t.orders.join(best_source_per_order(t), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("o_orderkey", temporal.deadline_projection(F.col("o_orderdate"), F.col("l_shipdate"), F.col("o_orderstatus") != "P").alias("deadline_state"))


@query(
    "days_left",
    "SELECT o_orderkey, CAST(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-09-01 06:00:00')) / 86400000000.0) AS BIGINT) AS days, CASE WHEN ceil((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-09-01 06:00:00')) / 86400000000.0) < 0 THEN 'closed' "
    "WHEN ceil((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-09-01 06:00:00')) / 86400000000.0) <= 30 THEN CAST(CAST(ceil((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-09-01 06:00:00')) / 86400000000.0) AS BIGINT) AS VARCHAR) || ' days left' ELSE 'open' END AS label FROM orders",
)
def days_left(t):
    now = F.lit("1998-09-01 06:00:00").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", scalar.days_left(F.col("o_orderdate"), now).alias("days"), scalar.deadline_label(F.col("o_orderdate"), now).alias("label"))


FUNDING_SQL = (
    "CASE WHEN p_brand LIKE 'Brand#1%' AND p_size > 10 AND p_size > 20 AND p_retailprice > 950 THEN 'fully_funded' WHEN p_size > 10 OR p_size > 20 OR p_retailprice > 950 OR p_type = 'partial' THEN 'partial' ELSE 'unknown' END"
)


def with_funding(part):
    component = lambda c: F.when(c, "confirmed").otherwise("unknown")
    parts = F.array(component(F.col("p_size") > 10), component(F.col("p_size") > 20), component(F.col("p_retailprice") > 950))
    policy = F.when(F.col("p_brand").like("Brand#1%"), F.lit("policy"))
    return part.withColumn("funding", temporal.funding_class(policy, parts, F.col("p_type")))


@query("funding_class", f"SELECT p_partkey, {FUNDING_SQL} AS funding FROM part")
def funding_class(t):
    return with_funding(t.part).select("p_partkey", "funding")


@query(
    "display_labels",
    f"SELECT p_partkey, CASE funding WHEN 'fully_funded' THEN 'All tracked funding components confirmed' WHEN 'partial' THEN 'Some funding components confirmed' ELSE 'Funding coverage requires verification' END AS label, "
    f"concat_ws('; ', replace(funding, '_', ' '), CASE WHEN p_size > 20 THEN 'tuition: ' || p_type END, CASE WHEN p_size > 40 THEN 'travel mentioned' END) AS summary FROM (SELECT *, {FUNDING_SQL} AS funding FROM part) t",
)
def display_labels(t):
    summary = F.concat_ws("; ", F.translate("funding", "_", " "), F.when(F.col("p_size") > 20, F.concat(F.lit("tuition: "), "p_type")), F.when(F.col("p_size") > 40, "travel mentioned"))
    return with_funding(t.part).select("p_partkey", temporal.funding_label(F.col("funding")).alias("label"), summary.alias("summary"))


@query(
    "tier_complete",
    "SELECT o_orderkey, coalesce(n_types > 0 AND (o_orderpriority NOT LIKE '1%' OR has_n) AND (o_orderpriority NOT LIKE '2%' OR has_a), false) AS complete FROM orders LEFT JOIN "
    "(SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_types, bool_or(l_returnflag = 'N') AS has_n, bool_or(l_returnflag IN ('A', 'R')) AS has_a FROM lineitem GROUP BY 1) t ON l_orderkey = o_orderkey",
)
def tier_complete(t):
    types = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("types"))
    needs = lambda prefix, *any_type: ~F.col("o_orderpriority").like(f"{prefix}%") | F.arrays_overlap("types", F.array(*[F.lit(x) for x in any_type]))
    complete = (F.size("types") > 0) & needs("1", "N") & needs("2", "A", "R")
    return t.orders.join(types, "o_orderkey", "left").select("o_orderkey", F.coalesce(complete, F.lit(False)).alias("complete"))


OUTCOME_SQL = (
    "CASE WHEN n_chars < 20 OR lang = 'xx' THEN 'invalid' WHEN n_valid > 1 THEN 'duplicate_in_batch' WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = n_chars AND source = 'src1') THEN 'duplicate_existing' ELSE 'importable' END"
)
IMPORT_SQL = (
    f"SELECT doc_id, {OUTCOME_SQL} AS outcome FROM (SELECT *, count(*) FILTER (WHERE n_chars >= 20) OVER (PARTITION BY lower(lang), lower(source), n_chars ORDER BY doc_id) AS n_valid FROM documents) t"
)


def import_rows(t):
    """Per-row outcomes: invalid, repeated within the batch (first valid row wins), there already, or importable."""
    valid = (F.col("n_chars") >= 20) & (F.col("lang") != "xx")
    key = Window.partitionBy(F.lower("lang"), F.lower("source"), "n_chars").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    staged = t.documents.withColumn("n_valid", F.count_if(F.col("n_chars") >= 20).over(key))
    existing = t.customer.select(F.col("c_custkey").alias("n_chars"), F.lit("src1").alias("source"))
    staged = flagged(staged, existing, ["n_chars", "source"], "there")
    outcome = F.when(~valid, "invalid").when(F.col("n_valid") > 1, "duplicate_in_batch").when(F.col("there"), "duplicate_existing").otherwise("importable")
    return staged.select("doc_id", outcome.alias("outcome"))


@query("import_outcomes", IMPORT_SQL)
def import_outcomes(t):
    return import_rows(t)


@query("import_summary", f"SELECT count(*) AS rows, count(*) FILTER (WHERE outcome = 'importable') AS importable, count(*) FILTER (WHERE outcome = 'invalid') AS invalid, count(*) FILTER (WHERE outcome LIKE 'duplicate%') AS duplicates FROM ({IMPORT_SQL}) i")
def import_summary(t):
    o = F.col("outcome")
    return import_rows(t).agg(F.count(F.lit(1)).alias("rows"), F.count_if(o == "importable").alias("importable"), F.count_if(o == "invalid").alias("invalid"), F.count_if(o.startswith("duplicate")).alias("duplicates"))


@query("import_first_wins", "SELECT lang, source, min(doc_id) AS first_id, count(*) - 1 AS later FROM documents GROUP BY 1, 2")
def import_first_wins(t):
    return t.documents.groupBy("lang", "source").agg(F.min("doc_id").alias("first_id"), (F.count(F.lit(1)) - 1).alias("later"))


@query(
    "import_warnings",
    "SELECT doc_id, concat_ws('; ', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN text NOT LIKE '%' || chr(10) || '%' THEN 'one line' END, CASE WHEN source = 'src0' THEN 'unknown source' END) AS warnings FROM documents",
)
def import_warnings(t):
    checks = [(F.col("n_chars") < 200, "short"), (~F.contains("text", F.lit("\n")), "one line"), (F.col("source") == "src0", "unknown source")]
    return t.documents.select("doc_id", F.concat_ws("; ", *[F.when(c, m) for c, m in checks]).alias("warnings"))


@query(
    "canonical_identity_conflicts",
    "SELECT a.p_partkey, b.p_partkey AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size IS NOT DISTINCT FROM b.p_size AND a.p_partkey < b.p_partkey",
)
def canonical_identity_conflicts(t):
    """Every pair of parts that share their identity."""
    a, b = t.part.alias("a"), t.part.alias("b")
    on = F.expr("a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size <=> b.p_size AND a.p_partkey < b.p_partkey")
    return a.join(b, on).select("a.p_partkey", F.col("b.p_partkey").alias("other"))


LINES_SQL = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_shipdate, l_extendedprice) AS nth, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"


@query(
    "export_nested",
    "SELECT o_orderkey, 0 AS section, 0 AS place, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"lines\":[' AS fragment FROM orders "
    f"UNION ALL SELECT l_orderkey, 1, nth, CASE WHEN nth > 1 THEN ',' ELSE '' END || '{{\"l_linenumber\":' || l_linenumber || ',\"l_returnflag\":\"' || l_returnflag || '\"}}' FROM ({LINES_SQL}) l UNION ALL SELECT o_orderkey, 2, 0, ']}}' FROM orders",
)
def export_nested(t):
    """Orders with their lines as nested JSON, in fragments to be written one after the other."""
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate", "l_extendedprice"]
    return nested_json(t.orders, "o_orderkey", ["o_orderkey", "o_orderstatus"], {"lines": (lines, ["l_linenumber", "l_returnflag"], order)})


@query("tenant_view", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = l_orderkey AND c_nationkey = 3)")
def tenant_view(t):
    from ..operators.security import Policy, secured

    tables = {"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}
    policies = {"customer": Policy(owner="c_nationkey"), "orders": Policy(parent="customer", on=("o_custkey", "c_custkey")), "lineitem": Policy(parent="orders", on=("l_orderkey", "o_orderkey"))}
    return secured(tables, policies, 3)["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


OWNED_SQL = """
WITH l AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_suppkey END AS l_suppkey, l_partkey, l_linenumber FROM lineitem),
c AS (SELECT 'customer' AS "table", c_nationkey AS owner FROM customer), s AS (SELECT 'supplier', s_nationkey FROM supplier), o AS (SELECT 'orders', c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey),
li AS (SELECT 'lineitem', c_nationkey FROM l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey IS NULL OR s_nationkey = c_nationkey)
SELECT "table", owner, count(*) AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM s UNION ALL SELECT * FROM o UNION ALL SELECT * FROM li) t GROUP BY 1, 2"""


@query("tenant_owners", OWNED_SQL)
def tenant_owners(t):
    """How many rows of each table each tenant (nation) sees: lines need their order's, and where they name a supplier its, tenant."""
    from ..operators.security import Parent, Policy, owned

    lines = t.lineitem.withColumn("l_suppkey", F.when(F.col("l_linenumber") != 1, F.col("l_suppkey")))
    tables = {"lineitem": lines, "orders": t.orders, "customer": t.customer, "supplier": t.supplier}
    policies = {
        "customer": Policy(owner="c_nationkey"), "supplier": Policy(owner="s_nationkey"), "orders": Policy(parents=(Parent("o_custkey", "customer", "c_custkey"),)),
        "lineitem": Policy(parents=(Parent("l_orderkey", "orders", "o_orderkey"), Parent("l_suppkey", "supplier", "s_suppkey", optional=True))),
    }
    parts = [df.filter("_owner IS NOT NULL").select(F.lit(name).alias("table"), F.col("_owner").alias("owner")) for name, df in owned(tables, policies).items()]
    return reduce(DataFrame.unionByName, parts).groupBy("table", "owner").agg(F.count(F.lit(1)).alias("n"))
