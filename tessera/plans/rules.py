"""The structured rule engine: customers as profiles, parts as opportunities with rules, candidates of the same degree.

Profiles, opportunities and rules are stated once, as expressions that Spark and the oracle both read.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from ..operators import classes, matching
from .registry import ORDER_CLOCK, clock, query

#: A customer's profile; values are text, as rules compare text or numbers written as text.
PROFILE = {
    "user_id": "c_custkey",
    "target_degree": "CASE WHEN c_nationkey % 8 = 7 THEN NULL ELSE lower(c_mktsegment) END",
    "nationality": "CASE WHEN c_nationkey % 6 = 5 THEN NULL WHEN c_nationkey % 6 = 4 THEN 'any' ELSE 'Land  ' || CAST(c_nationkey % 6 AS STRING) END",
    "cgpa": "CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(CAST(floor(c_acctbal / 2500) AS INT) AS STRING) || '.' || CAST(c_custkey % 10 AS STRING) END",
    "scale": "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 < 5 THEN 4 ELSE 5 END",
    "months": "CASE WHEN c_custkey % 9 = 0 THEN 'many' ELSE CAST(c_custkey % 40 AS STRING) END",
    "test_status": "CASE WHEN c_custkey % 3 = 0 THEN 'not_required' WHEN c_custkey % 3 = 1 THEN 'taken' ELSE 'planned' END",
    "study_mode": "CASE WHEN c_custkey % 4 = 0 THEN 'any' WHEN c_custkey % 4 = 1 THEN 'full_time' ELSE 'part_time' END",
    "field_one": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Field ' || CAST(c_custkey % 5 AS STRING) END",
    "field_two": "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'field ' || CAST(c_custkey % 7 AS STRING) END",
    "country_one": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Land ' || CAST(c_custkey % 6 AS STRING) END",
    "need": "CASE WHEN c_custkey % 5 < 2 THEN ' ' WHEN c_custkey % 5 = 2 THEN NULL ELSE 'yes' END",
}
#: A part as an opportunity.
OPPORTUNITY = {
    "opportunity_id": "p_partkey",
    "degree_level": "CASE p_size % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' WHEN 2 THEN 'household' WHEN 3 THEN 'furniture' ELSE 'automobile' END",
    "days": "CASE WHEN p_size % 11 = 10 THEN NULL ELSE p_size - 5 END",
    "window_state": "CASE p_partkey % 6 WHEN 0 THEN 'closed' WHEN 1 THEN 'deadline_unknown' WHEN 2 THEN 'archived' ELSE 'open' END",
    "country": "' land  ' || CAST(p_partkey % 6 AS STRING)",
    "funding": "CASE p_partkey % 3 WHEN 0 THEN 'fully_funded' WHEN 1 THEN 'partial' ELSE 'unknown' END",
    "rule_kind": "p_partkey % 9",
}
#: Rules by kind: type, operator, values, required, grading scale. Kind 8 has none.
RULES = [
    (0, "nationality", "in", ["land 1", "Land 2"], True, None),
    (0, "cgpa", "gte", ["2.5"], True, 4),
    (1, "nationality", "not_in", ["land 3", "any"], False, None),
    (1, "study_mode", "equals", ["full_time"], True, None),
    (2, "field", "in", ["field 1", "Field  3"], True, None),
    (3, "field", "not_in", ["field 2"], False, None),
    (3, "cgpa", "lte", ["2"], False, None),
    (4, "work_experience_months", "gte", ["12"], True, None),
    (4, "english_test_status", "equals", ["taken"], False, None),
    (5, "work_experience_months", "lte", ["24"], False, None),
    (5, "application_window", "in", ["open"], False, None),
    (6, "gre_status", "in", ["taken", "not_required"], False, None),
    (7, "target_degree", "equals", ["building"], False, None),
    (7, "residence", "equals", ["land 1"], True, None),
]
SQUEEZED = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
VALUES_SQL = {
    "nationality": "[nationality]", "cgpa": "[cgpa]", "study_mode": "[study_mode]", "field": "[field_one, field_two]", "work_experience_months": "[months]",
    "english_test_status": "[test_status]", "gre_status": "[test_status]", "target_degree": "[target_degree]", "application_window": "[window_state]", "residence": "[NULL::VARCHAR]",
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _columns(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in expressions.items())


def _rules_sql() -> str:
    rows = ", ".join(f"({k}, {i}, '{kind}', '{op}', {values}, {str(required).lower()}, {'NULL' if scale is None else scale})" for i, (k, kind, op, values, required, scale) in enumerate(RULES))
    return f"SELECT * FROM (VALUES {rows}) v(rule_kind, place, rule_type, operator, required_values, required, rule_scale)"


def _structured_sql() -> str:
    actual = "CASE rule_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VALUES_SQL.items()) + " END"
    clean, wanted = (f"[{SQUEEZED.format('x')} FOR x IN {c}]" for c in ("have", "required_values"))
    number = lambda x: f"TRY_CAST({x} AS DECIMAL(38, 10))"
    passed = (
        f"CASE operator WHEN 'in' THEN len([x FOR x IN {clean} IF x = 'any' OR list_contains({wanted}, x)]) > 0 WHEN 'not_in' THEN len([x FOR x IN {clean} IF list_contains({wanted}, x)]) = 0 "
        f"WHEN 'equals' THEN len([x FOR x IN {clean} IF x = 'any' OR x = {wanted}[1]]) > 0 "
        f"WHEN 'gte' THEN len([x FOR x IN {clean} IF coalesce({number('x')} >= {number(wanted + '[1]')}, false)]) > 0 ELSE len([x FOR x IN {clean} IF coalesce({number('x')} <= {number(wanted + '[1]')}, false)]) > 0 END"
    )
    base = f"SELECT p.*, r.place, r.rule_type, r.operator, r.required_values, r.required, r.rule_scale, [x FOR x IN {actual} IF x IS NOT NULL] AS have FROM candidates p JOIN rules r USING (rule_kind)"
    outcome = (
        "CASE WHEN rule_type = 'application_window' AND window_state = 'deadline_unknown' OR len(have) = 0 OR rule_type = 'cgpa' AND (scale IS NULL OR rule_scale IS NULL OR scale <> rule_scale) "
        "OR rule_type IN ('english_test_status', 'gre_status') AND list_contains(have, 'not_required') AND NOT passed THEN 'unknown' WHEN passed THEN 'satisfied' ELSE 'failed' END"
    )
    label = "replace(rule_type, '_', ' ')"
    title = "array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(replace(rule_type, '_', ' '), ' ')], ' ')"
    reasons = [
        ("rule_type = 'application_window' AND window_state = 'deadline_unknown'", _text(matching.WINDOW_UNKNOWN), _text(matching.STEP_WINDOW)),
        ("len(have) = 0", f"'Your ' || {label} || ' is missing, so this rule is unknown.'", f"'Add your ' || {label} || ' to evaluate this requirement.'"),
        ("rule_type = 'cgpa' AND (scale IS NULL OR rule_scale IS NULL)", _text(matching.SCALE_MISSING), _text(matching.STEP_SCALE)),
        ("rule_type = 'cgpa'", _text(matching.SCALES_DIFFER), _text(matching.STEP_SCALES)),
    ]
    unknown, step = (f"CASE {' '.join(f'WHEN {r[0]} THEN {r[k]}' for r in reasons)} ELSE {_text(last)} END" for k, last in ((1, matching.WAIVER), (2, matching.STEP_WAIVER)))
    message = f"CASE outcome WHEN 'unknown' THEN {unknown} WHEN 'satisfied' THEN {title} || ' requirement is satisfied.' ELSE {title} || ' requirement is not satisfied.' END"
    return (
        f"SELECT user_id, opportunity_id, place, {label} AS name, operator, 'eligibility' AS category, 15 AS weight, outcome, required AND outcome = 'failed' AS hard, {message} AS message, CASE WHEN outcome = 'unknown' THEN {step} END AS next_step "
        f"FROM (SELECT *, {outcome} AS outcome FROM (SELECT *, {passed} AS passed FROM ({base}) b) c) d"
    )


DEGREE_SQL = "CASE WHEN target_degree IS NULL THEN 'unknown' WHEN target_degree = degree_level THEN 'satisfied' ELSE 'failed' END"
LOCATION_SQL = f"CASE WHEN country_one IS NULL THEN 'unknown' WHEN {SQUEEZED.format('country_one')} = {SQUEEZED.format('country')} THEN 'satisfied' ELSE 'failed' END"
FUNDING_SQL = "CASE WHEN coalesce(trim(need), '') = '' THEN 'unknown' WHEN funding = 'fully_funded' THEN 'satisfied' WHEN funding = 'partial' THEN 'unknown' ELSE 'failed' END"


def _engine_sql() -> str:
    def own(place, name, category, weight, outcome, message, step="NULL", where="true"):
        return f"SELECT user_id, opportunity_id, {place}, '{name}', NULL, '{category}', {weight}, {outcome}, false, {message}, {step} FROM candidates WHERE {where}"

    degree = (
        f"CASE WHEN target_degree IS NULL THEN {_text(matching.DEGREE_MISSING)} WHEN target_degree = degree_level THEN 'Target degree matches: ' || degree_level || '.' "
        "ELSE 'Your target degree is ' || target_degree || ', but this opportunity is for ' || degree_level || '.' END"
    )
    deadline = (
        f"CASE WHEN days IS NULL THEN {_text(matching.DEADLINE_MISSING)} WHEN days < 0 THEN {_text(matching.DEADLINE_PASSED)} WHEN days <= 30 THEN 'Deadline is upcoming in ' || days || ' days.' "
        "ELSE 'Deadline is open with ' || days || ' days remaining.' END"
    )
    location = (
        f"CASE WHEN country_one IS NULL THEN {_text(matching.COUNTRIES_MISSING)} WHEN {SQUEEZED.format('country_one')} = {SQUEEZED.format('country')} "
        "THEN 'Opportunity country matches your preferences: ' || country || '.' ELSE country || ' is not in your preferred destination countries.' END"
    )
    needy = "coalesce(trim(need), '') = ''"
    funding = f"CASE WHEN {needy} THEN {_text(matching.NEED_MISSING)} WHEN funding = 'fully_funded' THEN {_text(matching.FUNDING_FULL)} WHEN funding = 'partial' THEN {_text(matching.FUNDING_PART)} ELSE {_text(matching.FUNDING_UNKNOWN)} END"
    fallback = [own(100, "degree", "eligibility", 20, DEGREE_SQL, degree, f"CASE WHEN target_degree IS NULL THEN {_text(matching.STEP_DEGREE)} END", "rule_kind = 8")]
    for i, n in enumerate(matching.UNSTRUCTURED):
        fallback.append(own(101 + i, n, "eligibility", 15, "'unknown'", _text(f"{n.title()} eligibility is not yet structured for this opportunity."), _text(matching.STEP_UNSTRUCTURED), "rule_kind = 8"))
    soon = f"CASE WHEN days IS NULL THEN {_text(matching.STEP_DEADLINE)} WHEN days BETWEEN 0 AND 30 THEN {_text(matching.STEP_SOON)} END"
    costs = f"CASE WHEN {needy} OR funding = 'fully_funded' THEN NULL WHEN funding = 'partial' THEN {_text(matching.STEP_COSTS)} ELSE {_text(matching.STEP_COVERAGE)} END"
    rest = [
        own(200, "deadline", "freshness", 10, "CASE WHEN days IS NULL THEN 'unknown' WHEN days < 0 THEN 'failed' ELSE 'satisfied' END", deadline, soon),
        own(201, "location", "preference", 10, LOCATION_SQL, location, f"CASE WHEN country_one IS NULL THEN {_text(matching.STEP_COUNTRIES)} END"),
        own(202, "funding", "preference", 5, FUNDING_SQL, funding, costs),
    ]
    joined = "SELECT * FROM profiles JOIN opportunities ON target_degree IS NULL OR target_degree = degree_level"
    return (
        f"WITH profiles AS (SELECT {_columns(PROFILE)} FROM customer), opportunities AS (SELECT {_columns(OPPORTUNITY)} FROM part), rules AS ({_rules_sql()}), candidates AS ({joined}), "
        f"results AS ({' UNION ALL '.join([_structured_sql(), *fallback, *rest])})"
    )


ENGINE_SQL = _engine_sql()
PAIR_SQL = """
SELECT r.user_id, r.opportunity_id, any_value(c.window_state) IN ('closed', 'archived') OR bool_or(hard) OR any_value(c.target_degree) <> any_value(c.degree_level) IS TRUE AS excluded, any_value(c.rule_kind) <> 8 AS structured,
       count(*) FILTER (WHERE outcome = 'unknown') AS n_unknown,
       CAST(round_even(coalesce(sum(weight) FILTER (WHERE category = 'eligibility' AND outcome = 'satisfied'), 0) * 100.0 / sum(weight) FILTER (WHERE category = 'eligibility'), 0) AS BIGINT) AS fit,
       CAST(round_even(coalesce(sum(weight) FILTER (WHERE category = 'preference' AND outcome = 'satisfied'), 0) * 100.0 / sum(weight) FILTER (WHERE category = 'preference' AND outcome <> 'unknown'), 0) AS BIGINT) AS preference_fit,
       CAST(round_even(count(*) FILTER (WHERE outcome <> 'unknown') * 100.0 / count(*), 0) AS BIGINT) AS completeness
FROM results r JOIN candidates c USING (user_id, opportunity_id) GROUP BY 1, 2
"""
SCORED_SQL = f"{ENGINE_SQL}, pairs AS ({PAIR_SQL}), scored AS (SELECT *, CASE WHEN excluded THEN 0 ELSE fit END AS score, CASE WHEN excluded THEN 'ineligible' WHEN NOT structured THEN 'unknown' WHEN n_unknown = 0 THEN 'potentially_eligible' ELSE 'requires_verification' END AS status FROM pairs)"


def profiles(t):
    p = t.customer.selectExpr(*[f"{e} AS {n}" for n, e in PROFILE.items()])
    fields = F.array_compact(F.array("field_one", "field_two"))
    kinds = {
        "nationality": F.col("nationality"), "cgpa": F.col("cgpa"), "study_mode": F.col("study_mode"), "field": fields, "work_experience_months": F.col("months"),
        "english_test_status": F.col("test_status"), "gre_status": F.col("test_status"), "target_degree": F.col("target_degree"), "residence": F.lit(None).cast("string"),
    }
    return p.withColumns({"profile_values": F.transform_values(matching.profile_values(**kinds), lambda _, v: matching.normal(v)), "preferred": F.array_compact(F.array("country_one"))})


def opportunities(t):
    o = t.part.selectExpr(*[f"{e} AS {n}" for n, e in OPPORTUNITY.items()])
    schema = "rule_kind long, rule_type string, operator string, required_values array<string>, required boolean, grading_scale int"
    rules = t.spark.createDataFrame([(k, *r) for k, *r in RULES], schema).coalesce(1).withColumn("required_values", matching.normal(F.col("required_values")))
    listed = rules.groupBy("rule_kind").agg(F.collect_list(F.struct("rule_type", "operator", "required_values", "required", "grading_scale")).alias("rules"))
    deadline = clock(ORDER_CLOCK) + F.make_dt_interval(F.col("days"))
    return o.join(F.broadcast(listed), "rule_kind", "left").withColumn("deadline", F.when(F.col("days").isNotNull(), deadline))


def classed(t):
    """(pairs of classes, members of profile classes, members of opportunity classes, opportunities)."""
    p, o = profiles(t), opportunities(t)
    p_members, p_classes = classes.profile_classes(p, o)
    o_members, o_classes = classes.opportunity_classes(o, clock(ORDER_CLOCK))
    return classes.evaluated_classes(p_classes, o_classes), p_members, o_members, o


PAIRS = "sum(profiles * opportunities)"


@query("rule_outcomes", f"{ENGINE_SQL} SELECT name, operator, outcome, hard, count(*) AS n FROM results GROUP BY 1, 2, 3, 4")
def rule_outcomes(t):
    """How often each rule, with each operator, has each outcome over all candidates."""
    operators = F.coalesce(F.transform("rules", lambda r: r.operator), F.array().cast("array<string>"))
    placed = classed(t)[0].select("profiles", "opportunities", operators.alias("operators"), F.posexplode("results").alias("at", "r"))
    return placed.groupBy(F.col("r.name").alias("name"), F.get("operators", F.col("at")).alias("operator"), F.col("r.outcome").alias("outcome"), F.col("r.hard").alias("hard")).agg(F.expr(PAIRS).alias("n"))


@query("rule_scores", f"{SCORED_SQL} SELECT status, score, preference_fit, completeness, count(*) AS n FROM scored GROUP BY 1, 2, 3, 4")
def rule_scores(t):
    return classed(t)[0].select("profiles", "opportunities", "s.*").groupBy("status", "score", "preference_fit", "completeness").agg(F.expr(PAIRS).alias("n"))


RANKED_SQL = f"{SCORED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, coalesce(preference_fit, -1) DESC, completeness DESC, opportunity_id) AS rank FROM scored)"


@query("rule_ranking", f"{RANKED_SQL} SELECT user_id, opportunity_id, score, rank FROM ranked WHERE rank <= 10")
def rule_ranking(t):
    pairs, p_members, o_members, _ = classed(t)
    return classes.ranked_by_classes(pairs, p_members, o_members, 10).select("user_id", "opportunity_id", "score", "rank")


@query(
    "hard_failures",
    f"{SCORED_SQL} SELECT (window_state IN ('closed', 'archived'))::INT + coalesce(target_degree <> degree_level, false)::INT + n_hard AS n_failures, count(*) AS n FROM candidates JOIN (SELECT user_id, opportunity_id, count(*) FILTER (WHERE hard) AS n_hard FROM results GROUP BY 1, 2) h USING (user_id, opportunity_id) GROUP BY 1",
)
def hard_failures(t):
    return classed(t)[0].groupBy(F.size("failures").cast("long").alias("n_failures")).agg(F.expr(PAIRS).alias("n"))


@query(
    "rule_explanations",
    f"{ENGINE_SQL} SELECT opportunity_id, count(*) FILTER (WHERE outcome = 'satisfied') AS satisfied, count(*) FILTER (WHERE outcome = 'failed') AS missing, count(*) FILTER (WHERE outcome = 'unknown') AS uncertain, count(DISTINCT user_id) AS profiles FROM results GROUP BY 1",
)
def rule_explanations(t):
    """How many messages of each kind an opportunity's candidates get."""
    pairs, _, o_members, _ = classed(t)
    counts = {"satisfied": "satisfied", "missing": "failed", "uncertain": "unknown"}
    sized = pairs.select("opportunity_class", "profiles", *[(F.size(matching.messages_of(F.col("results"), o)) * F.col("profiles")).alias(n) for n, o in counts.items()])
    of_class = sized.groupBy("opportunity_class").agg(*[F.sum(n).alias(n) for n in [*counts, "profiles"]])
    return o_members.join(of_class, "opportunity_class").select("opportunity_id", *counts, "profiles")


#: Results that are explained and stored for each profile.
SHOWN = 3


def shown(t):
    """The first results of each profile with what every rule said, the deadline in each opportunity's own words."""
    pairs, p_members, o_members, o = classed(t)
    return classes.with_deadlines(classes.ranked_by_classes(pairs, p_members, o_members, SHOWN, ["results"]), o, clock(ORDER_CLOCK))


@query(
    "rule_explanation_lists",
    f"{RANKED_SQL} SELECT user_id, opportunity_id, any_value(rank) AS rank, "
    + ", ".join(f"coalesce(string_agg(message, ' ' ORDER BY place) FILTER (WHERE outcome = '{o}'), '') AS {n}" for n, o in (("satisfied", "satisfied"), ("missing", "failed"), ("uncertain", "unknown")))
    + f", coalesce(string_agg(next_step, ' ' ORDER BY place), '') AS next_steps FROM ranked JOIN results USING (user_id, opportunity_id) WHERE rank <= {SHOWN} GROUP BY 1, 2",
)
def rule_explanation_lists(t):
    """What a user is told about each of the first results: met, missing and uncertain rules, and next steps, in rule order."""
    r = F.col("results")
    texts = {"satisfied": matching.messages_of(r, "satisfied"), "missing": matching.messages_of(r, "failed"), "uncertain": matching.messages_of(r, "unknown"), "next_steps": matching.next_steps(r)}
    return shown(t).select("user_id", "opportunity_id", "rank", *[F.array_join(c, " ").alias(n) for n, c in texts.items()])


FIELDS_SQL = "CASE name " + " ".join(f"WHEN '{n}' THEN '{','.join(f)}'" for n, f in matching.PROFILE_FIELDS.items()) + " ELSE '' END"
SNAPSHOT_SQL = "SELECT user_id, sha256('{\"degree\":' || coalesce('\"' || target_degree || '\"', 'null') || ',\"user\":' || user_id || '}') AS snapshot_hash FROM profiles"


@query(
    "stored_rule_outcomes",
    f"{RANKED_SQL} SELECT user_id, opportunity_id, rank, snapshot_hash, TIMESTAMP '{ORDER_CLOCK}' + INTERVAL 365 DAY AS expires_at, row_number() OVER (PARTITION BY user_id, opportunity_id ORDER BY place) - 1 AS place, name AS rule_name, outcome, "
    f"'match.' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') || '.' || outcome AS reason_code, {FIELDS_SQL} AS profile_fields, weight, CASE WHEN outcome = 'satisfied' THEN weight ELSE 0 END AS awarded_score, category, message, next_step "
    f"FROM ranked JOIN results USING (user_id, opportunity_id) JOIN ({SNAPSHOT_SQL}) n USING (user_id) WHERE rank <= {SHOWN}",
)
def stored_rule_outcomes(t):
    """The rule outcomes that an evaluation stores, under the hash of the profile's snapshot and with the evaluation's expiry."""
    snapshot = scalar.content_hash(scalar.canonical_json(degree=F.col("target_degree"), user=F.col("user_id")))
    hashes = profiles(t).select("user_id", snapshot.alias("snapshot_hash"))
    expires = (clock(ORDER_CLOCK) + F.make_dt_interval(F.lit(365))).alias("expires_at")
    return classes.stored_outcomes(shown(t).join(hashes, "user_id"), ["user_id", "opportunity_id", "rank", "snapshot_hash"]).withColumn("expires_at", expires)


@query(
    "evaluation_frames",
    "SELECT o_custkey, o_orderkey, sha256('{\"order\":' || o_orderkey || ',\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}') AS snapshot_hash, o_orderdate + INTERVAL 365 DAY AS expires_at, "
    "lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders",
)
def evaluation_frames(t):
    """An evaluation to store: the canonical snapshot's hash, its expiry after 365 days and the evaluation that it supersedes."""
    snapshot = scalar.canonical_json(order=F.col("o_orderkey"), priority=F.col("o_orderpriority"), status=F.col("o_orderstatus"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", scalar.content_hash(snapshot).alias("snapshot_hash"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(365))).alias("expires_at"), before.alias("supersedes"))
