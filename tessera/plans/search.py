"""The public search and its summaries: parts as opportunities, lines as their sources, rules by part.

Opportunities, sources and rules are stated once, as expressions that Spark and the oracle both read.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalogue
from ..operators.catalogue import AdminFilters, Filters
from .registry import ORDER_CLOCK, clock, query

NOW = f"TIMESTAMP '{ORDER_CLOCK}'"
DAY = "CASE WHEN {0} THEN NULL ELSE TIMESTAMP '1998-09-01 00:00:00' + INTERVAL '1' DAY * ({1}) END"
OPPORTUNITY = {
    "opportunity_id": "p_partkey",
    "name": "p_name",
    "provider_name": "p_brand",
    "country": "CASE p_partkey % 3 WHEN 0 THEN 'Germany' WHEN 1 THEN 'GERMANY' ELSE 'France' END",
    "degree_level": "CASE p_size % 3 WHEN 0 THEN 'masters' WHEN 1 THEN 'phd' ELSE 'bachelors' END",
    "status": "CASE WHEN p_partkey % 13 = 0 THEN 'draft' ELSE 'active' END",
    "funding_type": "CASE p_partkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'unknown' END",
    "funding_classification": "CASE p_partkey % 4 WHEN 0 THEN 'fully_funded' WHEN 1 THEN 'partial' ELSE 'unknown' END",
    "intake_year": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(2000 + p_size % 4 AS INT) END",
    "application_deadline": DAY.format("p_partkey % 11 = 0", "p_partkey % 400 - 100"),
    "deadline": DAY.format("p_partkey % 5 = 0", "p_partkey % 300 - 60"),
    "opening": DAY.format("p_size % 2 = 0", "p_size % 30 - 25"),
    "rolling": "p_partkey % 7 = 0",
    "archived": "p_partkey % 17 = 0",
    "application_fee_status": "CASE p_size % 4 WHEN 0 THEN 'not_required' WHEN 1 THEN 'required' WHEN 2 THEN 'waiver_available' ELSE 'unknown' END",
    "tuition_coverage": "CASE WHEN p_size > 30 THEN p_type END",
    "monthly_stipend_amount": "CASE WHEN p_partkey % 3 = 0 THEN p_size END",
    "monthly_stipend_currency": "CASE WHEN p_partkey % 6 = 0 THEN 'EUR' END",
    "accommodation_coverage": "CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 5 = 1 THEN '' END",
    "travel_allowance": "CASE WHEN p_partkey % 5 = 1 THEN 'Return FLIGHT' END",
    "health_insurance": "CAST(NULL AS VARCHAR(20))",
    "field_eligibility": "CASE WHEN p_partkey % 2 = 0 THEN 'Physics only' END",
    "nationality_eligibility": "CASE WHEN p_size % 3 = 0 THEN 'All' WHEN p_size % 3 = 1 THEN '' END",
    "minimum_academic_requirement": "CASE WHEN p_partkey % 10 = 3 THEN 'Good marks' END",
    "english_language_requirement": "CASE WHEN p_partkey % 4 = 2 THEN 'IELTS 7' END",
    "standardized_test_requirement": "CAST(NULL AS VARCHAR(20))",
}
SOURCE = {
    "opportunity_id": "l_partkey",
    "source_id": "l_orderkey * 10 + l_linenumber",
    "url": "'https://source.example/' || CAST(l_orderkey AS VARCHAR(20))",
    "source_type": "CASE WHEN l_returnflag = 'A' THEN 'provider' ELSE 'official' END",
    "verification_status": "CASE WHEN l_quantity > 49.5 AND l_discount > 0.08 THEN 'expired' WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'officially_verified' ELSE 'needs_review' END",
    "last_verified_at": "CASE WHEN l_linestatus = 'O' THEN l_shipdate END",
}
#: Rules: when a part has one, its type, operator and value key.
RULES = [
    ("p_partkey % 5 <> 4", "'field'", "CASE p_size % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'not_in' ELSE 'equals' END", "CASE p_partkey % 4 WHEN 0 THEN 'any-field' WHEN 1 THEN 'physics' WHEN 2 THEN 'law' ELSE 'fine-art' END"),
    ("p_partkey % 9 = 0", "'field'", "'not_in'", "'physics'"),
    ("p_size % 5 <> 3", "'nationality'", "CASE p_partkey % 3 WHEN 0 THEN 'not_in' ELSE 'in' END", "CASE p_size % 4 WHEN 0 THEN 'international' WHEN 1 THEN 'land-1' ELSE 'land-2' END"),
    ("p_partkey % 2 = 0", "CASE p_partkey % 3 WHEN 0 THEN 'ielts' WHEN 1 THEN 'toefl' ELSE 'english_test_status' END", "'in'", "CASE p_size % 2 WHEN 0 THEN 'taken' ELSE 'b2' END"),
    ("p_partkey % 3 = 1", "'cgpa'", "'gte'", "'3'"),
]


def _select(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in expressions.items())


def _days(count: int) -> datetime.datetime:
    return datetime.datetime.fromisoformat(ORDER_CLOCK) + datetime.timedelta(days=count)


def _at(count: int) -> str:
    return f"TIMESTAMP '{_days(count)}'"


def _rule_sql(kind: str, key: str, every: list[str]) -> str:
    keys = ", ".join(f"'{k}'" for k in [key, *every])
    own = f"SELECT 1 FROM rules r WHERE r.opportunity_id = o.opportunity_id AND rule_type = '{kind}'"
    return f"EXISTS ({own} AND operator IN ('equals', 'in') AND value_key IN ({keys})) AND NOT EXISTS ({own} AND operator = 'not_in' AND value_key = '{key}')"


VERIFIED_SQL = "SELECT 1 FROM sources s WHERE s.opportunity_id = o.opportunity_id AND source_type = 'official' AND verification_status = 'officially_verified'"
STATE_SQL = f"CASE WHEN archived THEN 'archived' WHEN deadline < {NOW} THEN 'closed' WHEN opening > {NOW} THEN 'upcoming' WHEN rolling THEN 'rolling' WHEN deadline IS NULL THEN 'deadline_unknown' ELSE 'open' END"
OPEN_SQL = f"NOT archived AND (rolling OR deadline IS NOT NULL) AND (opening IS NULL OR opening <= {NOW}) AND (deadline IS NULL OR deadline >= {NOW}) AND EXISTS ({VERIFIED_SQL} AND last_verified_at >= {_at(-90)})"
COVERED_SQL = "(" + " OR ".join(f"lower({c}) LIKE '%return fl_ght%'" for c in catalogue.COVERAGE_TEXTS) + ")"
#: Searches: their filters, and the same as SQL conditions.
SEARCHES = [
    (Filters(), "true"),
    (Filters(open_now=True), OPEN_SQL),
    (Filters(application_window_state="rolling"), f"{STATE_SQL} = 'rolling'"),
    (Filters(country="germany", degree_level="phd", application_fee=" Fee Required "), "lower(country) = 'germany' AND degree_level = 'phd' AND application_fee_status = 'required'"),
    (Filters(field="Physics", verified_after=_days(-200)), f"{_rule_sql('field', 'physics', catalogue.EVERY_FIELD)} AND EXISTS ({VERIFIED_SQL} AND last_verified_at >= {_at(-200)})"),
    (Filters(nationality="Land 1", intake_year=2002, funding_type="unknown"), f"{_rule_sql('nationality', 'land-1', catalogue.EVERY_NATIONALITY)} AND intake_year = 2002 AND funding_type = 'unknown'"),
    (Filters(deadline_after=_days(0), deadline_before=_days(90), english_requirement="IELTS"), f"application_deadline >= {_at(0)} AND application_deadline <= {_at(90)} AND EXISTS (SELECT 1 FROM rules r WHERE r.opportunity_id = o.opportunity_id AND rule_type = 'ielts')"),
    (Filters(funding_coverage=" Return Fl_ght ", english_requirement="B2"), f"{COVERED_SQL} AND EXISTS (SELECT 1 FROM rules r WHERE r.opportunity_id = o.opportunity_id AND rule_type IN ('duolingo', 'gre', 'ielts', 'toefl', 'english_test_status', 'gre_status') AND value_key = 'b2')"),
    (Filters(application_fee="sometimes"), "false"),
    (Filters(english_requirement="??"), "false"),
]
TABLES_SQL = (
    f"WITH opportunities AS (SELECT {_select(OPPORTUNITY)} FROM part), sources AS (SELECT {_select(SOURCE)} FROM lineitem), rules AS ("
    + " UNION ALL ".join(f"SELECT p_partkey AS opportunity_id, {kind} AS rule_type, {op} AS operator, {key} AS value_key FROM part WHERE {when}" for when, kind, op, key in RULES)
    + f"), shown AS (SELECT *, {STATE_SQL} AS state FROM opportunities o WHERE status = 'active' AND EXISTS ({VERIFIED_SQL}) AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.opportunity_id = o.opportunity_id AND source_type = 'official' AND verification_status IN ('expired', 'conflicting_information', 'archived')))"
)
RANK_SQL = "CASE WHEN state IN ('open', 'rolling') THEN 0 WHEN state = 'upcoming' THEN 1 WHEN state = 'deadline_unknown' THEN 2 WHEN state = 'closed' THEN 3 ELSE 4 END"
FOUND_SQL = " UNION ALL ".join(f"SELECT {i} AS search, opportunity_id, row_number() OVER (ORDER BY {RANK_SQL}, deadline ASC NULLS LAST, name, opportunity_id) AS place FROM shown o WHERE {condition}" for i, (_, condition) in enumerate(SEARCHES))


def tables(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(opportunities, sources, rules)."""
    columns = lambda expressions: [f"CAST({e} AS STRING) AS {n}" if "VARCHAR" in e and n != "url" else f"{e} AS {n}" for n, e in expressions.items()]
    rules = [t.part.filter(when).selectExpr("p_partkey AS opportunity_id", f"{kind} AS rule_type", f"{op} AS operator", f"{key} AS value_key") for when, kind, op, key in RULES]
    naive = lambda df, *names: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})
    return naive(t.part.selectExpr(*columns(OPPORTUNITY)), "application_deadline", "deadline", "opening"), t.lineitem.selectExpr(*columns(SOURCE)), reduce(DataFrame.unionByName, rules)


@query("public_search", f"{TABLES_SQL} SELECT search, opportunity_id, place FROM ({FOUND_SQL}) f WHERE place <= 100")
def public_search(t):
    """The first hundred results of ten searches, by none or several of the filters each."""
    o, s, r = tables(t)
    now = clock(ORDER_CLOCK)
    place = F.row_number().over(Window.partitionBy("search").orderBy(*catalogue.in_order(now))).cast("long")
    found = catalogue.searched(o, s, r, now, [f for f, _ in SEARCHES]).withColumn("place", place)
    return found.filter(F.col("place") <= 100).select("search", "opportunity_id", "place")


@query("public_search_totals", f"{TABLES_SQL} SELECT search, count(*) AS total FROM ({FOUND_SQL}) f GROUP BY 1")
def public_search_totals(t):
    """How many results each search has, for those that have any."""
    o, s, r = tables(t)
    found = catalogue.searched(o, s, r, clock(ORDER_CLOCK), [f for f, _ in SEARCHES])
    return found.groupBy("search").agg(F.count(F.lit(1)).alias("total"))


HAS_SQL = "EXISTS (SELECT 1 FROM sources s WHERE s.opportunity_id = o.opportunity_id AND verification_status {})"
#: Curators' searches: their filters, and the same as SQL conditions.
ADMIN_SEARCHES = [
    (AdminFilters(), "true"),
    (AdminFilters(needs_review=True, country="FRANCE", status="active"), f"lower(country) = 'france' AND status = 'active' AND (status = 'draft' OR {HAS_SQL.format(chr(61) + ' ' + repr('needs_review'))})"),
    (AdminFilters(needs_review=False, degree_level="phd", verification_status="expired"), f"degree_level = 'phd' AND {HAS_SQL.format(chr(61) + ' ' + repr('expired'))}"),
    (AdminFilters(provider_query=" brand#1_ ", search_query="PHYS%only", deadline_after=_days(-50), deadline_before=_days(200)), f"lower(provider_name) LIKE '%brand#1_%' AND lower(field_eligibility) LIKE '%phys%only%' AND application_deadline BETWEEN {_at(-50)} AND {_at(200)}"),
]
ADMIN_SQL = " UNION ALL ".join(f"SELECT {i} AS search, opportunity_id, row_number() OVER (ORDER BY created_at DESC, opportunity_id) AS place FROM (SELECT *, {NOW} - INTERVAL 1 HOUR * (opportunity_id % 90) AS created_at FROM opportunities) o WHERE {condition}" for i, (_, condition) in enumerate(ADMIN_SEARCHES))


@query("admin_search", f"{TABLES_SQL} SELECT search, opportunity_id, place FROM ({ADMIN_SQL}) f WHERE place <= 100")
def admin_search(t):
    """The newest hundred results of four curators' searches."""
    o, s, _ = tables(t)
    o = o.withColumns({"notes": F.lit(None).cast("string"), "created_at": clock(ORDER_CLOCK) - F.make_dt_interval(hours=(F.col("opportunity_id") % 90).cast("int"))})
    newest = [F.desc("created_at"), F.col("opportunity_id")]
    found = [catalogue.administered(o, s, f).orderBy(*newest).limit(100).select(F.lit(i).alias("search"), "opportunity_id", F.row_number().over(Window.orderBy(*newest)).cast("long").alias("place")) for i, (f, _) in enumerate(ADMIN_SEARCHES)]
    return reduce(DataFrame.unionByName, found)


BEST_SQL = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY opportunity_id ORDER BY CASE WHEN source_type = 'official' AND verification_status = 'officially_verified' THEN 0 WHEN source_type = 'official' THEN 1 ELSE 2 END, "
    "last_verified_at DESC NULLS LAST, source_id, url) AS nth FROM sources) b WHERE nth = 1"
)
COMPLETE_SQL = "len(types) > 0 AND " + " AND ".join(f"(coalesce({text}, '') = '' OR list_has_any(types, [{', '.join(repr(k) for k in kinds)}]))" for text, kinds in catalogue.DEPENDENCIES.items())
SUMMARY_SQL = (
    "concat_ws('; ', replace(funding_classification, '_', ' '), CASE WHEN tuition_coverage <> '' THEN 'tuition: ' || tuition_coverage END, CASE WHEN monthly_stipend_amount IS NOT NULL THEN 'stipend: ' || monthly_stipend_amount || ' ' || coalesce(monthly_stipend_currency, 'None') END, "
    "CASE WHEN accommodation_coverage <> '' THEN 'accommodation mentioned' END, CASE WHEN travel_allowance <> '' THEN 'travel mentioned' END)"
)


@query(
    "public_summaries",
    f"{TABLES_SQL}, typed AS (SELECT opportunity_id, list(DISTINCT rule_type) AS types FROM rules GROUP BY 1), best AS ({BEST_SQL}) SELECT opportunity_id, name, provider_name, country, degree_level, opening AS application_opening_date, deadline AS application_deadline, funding_type, "
    f"funding_classification, {SUMMARY_SQL} AS funding_summary, verification_status, last_verified_at, url AS official_source_url, state AS application_window_state, coalesce(last_verified_at >= {_at(-90)}, false) AS source_is_fresh, "
    f"CASE WHEN last_verified_at >= {_at(-90)} THEN 'recent' WHEN last_verified_at >= {_at(-180)} THEN 'recheck_recommended' ELSE 'historical' END AS verification_freshness, "
    "CASE funding_classification WHEN 'fully_funded' THEN 'All tracked funding components confirmed' WHEN 'partial' THEN 'Some funding components confirmed' ELSE 'Funding coverage requires verification' END AS funding_display_label, "
    f"CASE WHEN complete THEN 'decision_ready' ELSE 'informational_only' END AS catalogue_decision_tier, complete AS structured_eligibility_complete FROM (SELECT o.*, coalesce({COMPLETE_SQL}, false) AS complete FROM shown o LEFT JOIN typed USING (opportunity_id)) o JOIN best USING (opportunity_id)",
)
def public_summaries(t):
    """What the catalogue says of every public opportunity."""
    o, s, r = tables(t)
    now = clock(ORDER_CLOCK)
    return catalogue.summaries(catalogue.public(o, s, r, now), s, r, now)
