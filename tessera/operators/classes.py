"""Matching many profiles with many opportunities by equivalence classes.

What rules cannot tell apart is one class: profiles whose values every rule treats alike, opportunities with equal
rules, country, funding, window and deadline outcome. The engine runs once for each pair of classes; counts multiply
with the members of both, and rankings go back to the profiles with the first members of each class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import reason_code, squeezed
from . import matching
from .relational import dealt, parts_for

#: Stands for every value that no rule names and no threshold tells from others; no rule can name it.
OTHER = "\x00other"
#: Values that mean something beyond what rules list.
MEANINGFUL = ["any", "not_required"]
#: Degree of profiles that ask for every degree.
EVERY = "*"


def _number(text: Column) -> Column:
    return text.try_cast("decimal(38,10)")


def rule_values(opportunities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rules in `rules` (normalized): (kind, token) that any names, and (kind, thresholds) of every kind."""
    rules = opportunities.select(F.explode("rules").alias("r")).select(F.col("r.rule_type").alias("kind"), "r.operator", "r.required_values").distinct()
    named = rules.select("kind", F.explode("required_values").alias("token")).distinct().withColumn("named", F.lit(True))
    limit = F.when(F.col("operator").isin("gte", "lte"), _number(F.get("required_values", F.lit(0))))
    return named, rules.groupBy("kind").agg(F.sort_array(F.collect_set(limit)).alias("thresholds"))


def _between(value: Column, thresholds: Column) -> Column:
    """A number that compares with every threshold as value does: the threshold itself, or one between its neighbours."""
    at = F.size(F.filter(thresholds, lambda t: t <= value))
    low, high = F.get(thresholds, at - 1), F.get(thresholds, at)
    inner = ((low + high) / 2).cast("decimal(38,10)")
    # Neighbours closer than the last digit leave no number between them: the value itself then stands for its place.
    inner = F.when((inner > low) & (inner < high), inner).otherwise(value)
    return F.when(low == value, value).when(low.isNull(), (high - 1).cast("decimal(38,10)")).when(high.isNull(), (low + 1).cast("decimal(38,10)")).otherwise(inner).cast("string")


def profile_classes(profiles: DataFrame, opportunities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, profile_class) of every profile, and a row for each class with what the engine needs and `profiles`.

    profiles has user_id, target_degree, profile_values (map of rule type to normalized values), scale, preferred and
    need. Values of rule types that no opportunity uses do not matter, of the others only how the rules treat them.
    """
    named, kinds = rule_values(opportunities)
    # Few files hold many profiles, whose values are many more rows: dealt before they are taken apart.
    spread = dealt(profiles.select("user_id", "profile_values"), "user_id", parts_for(profiles))
    entries = spread.select("user_id", F.explode("profile_values").alias("kind", "values")).select("user_id", "kind", F.explode("values").alias("token"))
    # Kinds of rules are a fixed few: broadcast, for as the streamed side they would expand all entries in the task that
    # holds them. The named values are broadcast behind the engine's check of their size, hot values split otherwise.
    placed = entries.join(F.broadcast(kinds), "kind").join(named, ["kind", "token"], "left")
    number = _number(F.col("token"))
    coarse = (
        F.when(F.col("named") | F.col("token").isin(*MEANINGFUL), F.col("token"))
        .when(number.isNotNull() & (F.size("thresholds") > 0), _between(number, F.col("thresholds")))
        .otherwise(OTHER)
    )
    gathered = placed.select("user_id", F.struct("kind", coarse.alias("token")).alias("e")).groupBy("user_id").agg(F.sort_array(F.collect_set("e")).alias("entries"))
    rest = profiles.select(
        "user_id", "target_degree", "scale", (F.coalesce(squeezed(F.col("need")), F.lit("")) != "").alias("in_need"),
        F.sort_array(F.array_distinct(F.transform(F.coalesce("preferred", F.array().cast("array<string>")), lambda c: squeezed(c)))).alias("preferred"),
    )
    whole = rest.join(gathered, "user_id", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<kind:string,token:string>>")))
    # The scale matters beside a CGPA only.
    whole = whole.withColumn("scale", F.when(F.exists("entries", lambda e: e.kind == "cgpa"), F.col("scale")))
    key = ["target_degree", "scale", "in_need", "preferred", "entries"]
    named_class = F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256).alias("profile_class")
    members = whole.select("user_id", named_class, *key)
    by_kind = F.transform(
        F.array_distinct(F.transform("entries", lambda e: e.kind)), lambda k: F.struct(k.alias("kind"), F.transform(F.filter("entries", lambda e: e.kind == k), lambda e: e.token).alias("values"))
    )
    classes = members.groupBy("profile_class").agg(F.count(F.lit(1)).alias("profiles"), *[F.any_value(c).alias(c) for c in key])
    need = F.when(F.col("in_need"), "stated")
    return members.select("user_id", "profile_class"), classes.select("profile_class", "profiles", "target_degree", "scale", need.alias("need"), "preferred", F.map_from_entries(by_kind).alias("profile_values"))


def opportunity_classes(opportunities: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(opportunity_id, opportunity_class) of every opportunity, and a row for each class with `opportunities`.

    opportunities has opportunity_id, degree_level, rules (null without any), window_state, deadline, country and
    funding. Of the deadline only its outcome matters to scores: its message belongs to the single opportunity.
    """
    outcome = matching.deadline_result(F.col("deadline"), now).outcome
    key = ["degree_level", "rules", "window_state", "deadline_outcome", "country", "funding"]
    whole = opportunities.withColumn("deadline_outcome", outcome)
    members = whole.select("opportunity_id", F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256).alias("opportunity_class"), *key)
    classes = members.groupBy("opportunity_class").agg(F.count(F.lit(1)).alias("opportunities"), *[F.any_value(c).alias(c) for c in key])
    return members.select("opportunity_id", "opportunity_class"), classes


def evaluated_classes(profiles: DataFrame, opportunities: DataFrame, splits: int = 16) -> DataFrame:
    """A row for each pair of classes that are candidates (equal degree, or a profile without one): results, failures, scores `s`.

    Takes the classes of the two functions above. Degrees are few, so each degree's profile classes are split into
    `splits` parts, each of which meets the degree's opportunity classes.
    """
    part = F.pmod(F.xxhash64("profile_class"), F.lit(splits))
    asking = profiles.withColumn("degree", F.coalesce("target_degree", F.lit(EVERY))).withColumn("part", part)
    offered = opportunities.withColumn("degree", F.explode(F.array("degree_level", F.lit(EVERY)))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))))
    pairs = asking.join(offered, ["degree", "part"]).drop("degree", "part")
    structured = F.col("rules").isNotNull()
    own = matching.structured_results(F.col("rules"), F.col("profile_values"), F.col("scale"), F.col("window_state"), normalized=True)
    deadline = matching.result("deadline", "freshness", 10, F.col("deadline_outcome"), F.lit(None).cast("string"))
    rest = F.array(deadline, matching.location_result(F.col("preferred"), F.col("country")), matching.funding_result(F.col("need"), F.col("funding")))
    eligible = F.when(structured, own).otherwise(matching.fallback_results(F.col("target_degree"), F.col("degree_level")))
    pairs = pairs.withColumn("results", F.concat(eligible, rest)).withColumn("structured", structured)
    pairs = pairs.withColumn("failures", matching.hard_failures(F.col("window_state"), F.col("target_degree"), F.col("degree_level"), F.col("results")))
    pairs = pairs.withColumn("s", matching.score_of(F.col("results"), F.col("structured"), F.size("failures") > 0))
    return pairs.select("profile_class", "opportunity_class", "profiles", "opportunities", "rules", "results", "failures", "s")


def ranked_by_classes(pairs: DataFrame, profile_members: DataFrame, opportunity_members: DataFrame, most: int, carry: list[str] | None = None) -> DataFrame:
    """user_id, opportunity_id, rank, the scores and the columns `carry` of pairs: the first `most` of every profile.

    Order: score, preference fit (none last), completeness, then opportunity_id. A class gives its first `most` members
    at most, and only classes that fewer than `most` opportunities of better classes precede are looked at.
    """
    carry = carry or []
    level = [F.col("s.score").desc(), F.coalesce("s.preference_fit", F.lit(-1)).desc(), F.col("s.completeness").desc()]
    of_class = Window.partitionBy("profile_class").orderBy(*level)
    # Sums up to a row include its ties; those of its own level are taken off again.
    own = Window.partitionBy("profile_class", "s.score", "s.preference_fit", "s.completeness")
    upto = F.sum(F.least("opportunities", F.lit(most))).over(of_class.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = upto - F.sum(F.least("opportunities", F.lit(most))).over(own)
    near = pairs.select("profile_class", "opportunity_class", "opportunities", "s", *carry).withColumn("_ahead", ahead).filter(F.col("_ahead") < most).drop("_ahead", "opportunities")
    first = opportunity_members.withColumn("_at", F.row_number().over(Window.partitionBy("opportunity_class").orderBy("opportunity_id"))).filter(F.col("_at") <= most).drop("_at")
    best = near.join(first, "opportunity_class").withColumn("rank", F.row_number().over(Window.partitionBy("profile_class").orderBy(*level, "opportunity_id")).cast("long")).filter(F.col("rank") <= most)
    return profile_members.join(best, "profile_class").select("user_id", "opportunity_id", "rank", "s.*", *carry)


def with_deadlines(ranked: DataFrame, opportunities: DataFrame, now: Column) -> DataFrame:
    """ranked (with `results` of classes) with each opportunity's own deadline result in place of its class's."""
    own = opportunities.select("opportunity_id", matching.deadline_result(F.col("deadline"), now).alias("_deadline"))
    placed = ranked.join(own, "opportunity_id")
    return placed.withColumn("results", F.transform("results", lambda r: F.when(r["name"] == "deadline", F.col("_deadline")).otherwise(r))).drop("_deadline")


def stored_outcomes(ranked: DataFrame, carry: list[str]) -> DataFrame:
    """A row for each rule of each ranked result, as an evaluation keeps it: place, name, outcome, reason code, comparison, texts."""
    placed = ranked.select(*carry, F.posexplode("results").alias("place", "r")).withColumn("place", F.col("place").cast("long"))
    awarded = F.when(F.col("r.outcome") == "satisfied", F.col("r.weight")).otherwise(0)
    return placed.select(
        *carry, "place", F.col("r.name").alias("rule_name"), F.col("r.outcome").alias("outcome"), reason_code(F.col("r.name"), F.col("r.outcome")).alias("reason_code"),
        F.array_join(matching.profile_fields(F.col("r.name")), ",").alias("profile_fields"), F.col("r.weight").alias("weight"), awarded.alias("awarded_score"), F.col("r.category").alias("category"),
        F.col("r.message").alias("message"), F.col("r.next_step").alias("next_step"),
    )
