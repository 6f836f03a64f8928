"""The public catalogue: which opportunities are shown, by any combination of filters, in which order, and as what."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, temporal
from .relational import any_of, exists, flagged, like_anywhere, not_exists, one_of_filters, top_one

# Value keys that include every nationality or field, aliases of fee states, English tests and rule types.
EVERY_NATIONALITY = "all-countries all-nationalities any-nationality citizens-of-all-countries foreign-citizens foreign-students international international-applicants international-students".split()
EVERY_FIELD = "all-disciplines all-fields any-discipline any-field any-programme any-program".split()
FEE_ALIASES = {
    "free": "not_required", "none": "not_required", "no": "not_required", "no-application-fee": "not_required", "no-fee": "not_required", "not-required": "not_required", "required": "required", "fee-required": "required",
    "waiver": "waiver_available", "waiver-available": "waiver_available", "fee-waiver": "waiver_available", "unknown": "unknown",
}
ENGLISH_TESTS = ["duolingo", "gre", "ielts", "toefl"]
ENGLISH_RULES = [*ENGLISH_TESTS, "english_test_status", "gre_status"]
WINDOW_STATES = ["upcoming", "open", "closed", "rolling", "deadline_unknown", "archived"]
#: Statuses of an official source that take an opportunity out of the catalogue.
DISQUALIFYING = ["expired", "conflicting_information", "archived"]
#: Columns that a funding filter searches.
COVERAGE_TEXTS = ["tuition_coverage", "accommodation_coverage", "travel_allowance", "health_insurance"]
#: Requirement texts and the rule types that give one its structure.
DEPENDENCIES = {
    "field_eligibility": ["field"], "nationality_eligibility": ["nationality"], "minimum_academic_requirement": ["cgpa", "percentage"],
    "english_language_requirement": ["english_test_status", "ielts", "toefl", "duolingo"], "standardized_test_requirement": ["gre"],
}


@dataclass(frozen=True)
class Filters:
    """What a search asks for; a filter that is None does not apply."""

    country: str | None = None
    degree_level: str | None = None
    funding_type: str | None = None
    field: str | None = None
    nationality: str | None = None
    intake_year: int | None = None
    deadline_after: datetime.datetime | None = None
    deadline_before: datetime.datetime | None = None
    funding_coverage: str | None = None
    application_fee: str | None = None
    english_requirement: str | None = None
    verified_after: datetime.datetime | None = None
    open_now: bool = False
    application_window_state: str | None = None

    def __post_init__(self):
        if self.application_window_state is not None and self.application_window_state not in WINDOW_STATES:
            raise ValueError("Application window state is not valid")
        one_of_filters(self.open_now or None, self.application_window_state, "Open-now and application-window-state filters cannot be combined")


def state_of(now: Column) -> Column:
    """The window's state from opening, deadline, rolling and archived."""
    return temporal.window_state(now, F.col("opening"), F.col("deadline"), F.col("rolling"), F.col("archived"))


def on_columns(f: Filters, now: Column) -> list[Column]:
    """What the filters ask of an opportunity's own columns."""
    asked = [F.col(c) == F.lit(v) for c, v in {"degree_level": f.degree_level, "funding_type": f.funding_type, "intake_year": f.intake_year}.items() if v is not None]
    if f.country is not None:
        asked.append(F.lower("country") == f.country.lower())
    if f.deadline_after is not None:
        asked.append(F.col("application_deadline") >= F.lit(f.deadline_after).cast("timestamp_ntz"))
    if f.deadline_before is not None:
        asked.append(F.col("application_deadline") <= F.lit(f.deadline_before).cast("timestamp_ntz"))
    if f.funding_coverage is not None:
        asked.append(any_of(*[like_anywhere(F.col(c), f.funding_coverage) for c in COVERAGE_TEXTS]))
    if f.application_fee is not None:
        stored = FEE_ALIASES.get(scalar.slug_of(f.application_fee))
        asked.append(F.lit(False) if stored is None else F.col("application_fee_status") == stored)
    if f.open_now:
        due = any_of(F.col("rolling"), F.col("deadline").isNotNull()) & any_of(F.col("opening").isNull(), F.col("opening") <= now) & any_of(F.col("deadline").isNull(), F.col("deadline") >= now)
        asked.append(~F.col("archived") & due)
    elif f.application_window_state is not None:
        asked.append(state_of(now) == f.application_window_state)
    return asked


def on_sources(f: Filters, now: Column) -> list[Column]:
    """What the filters ask of some verified official source each."""
    asked = [F.lit(True)] if f.verified_after is None else [F.col("last_verified_at") >= F.lit(f.verified_after).cast("timestamp_ntz")]
    return asked + ([temporal.is_fresh(F.col("last_verified_at"), now)] if f.open_now else [])


def on_rules(f: Filters) -> tuple[list[Column], list[Column]]:
    """(what some rule must be, each; what no rule may be)."""
    some, none = [], []
    for kind, value, every in (("field", f.field, EVERY_FIELD), ("nationality", f.nationality, EVERY_NATIONALITY)):
        if value is not None:
            key, own = scalar.slug_of(value), F.col("rule_type") == kind
            some.append(own & F.col("operator").isin("equals", "in") & F.col("value_key").isin(sorted({key, *every})) if key else F.lit(False))
            none.append(own & (F.col("operator") == "not_in") & (F.col("value_key") == key) if key else F.lit(False))
    if f.english_requirement is not None:
        key = scalar.slug_of(f.english_requirement)
        hit = F.col("rule_type") == key if key in ENGLISH_TESTS else F.col("rule_type").isin(ENGLISH_RULES) & (F.col("value_key") == key)
        some.append(hit if key else F.lit(False))
    return some, none


def searched(opportunities: DataFrame, sources: DataFrame, rules: DataFrame, now: Column, searches: list[Filters]) -> DataFrame:
    """The rows of public() for each of several searches, with `search`, its number: tables are read once for all.

    Sources and rules become a row of flags an opportunity, a flag for each thing that a search asks, so one join of
    each serves every search and no task works on several searches' joins at once.
    """
    flags: dict[str, list[Column]] = {"s": [], "r": []}

    def flag(table: str, asked: Column) -> Column:
        flags[table].append(F.coalesce(F.bool_or(asked), F.lit(False)).alias(f"_{table}{len(flags[table])}"))
        return F.col(f"_{table}{len(flags[table]) - 1}")

    official = F.col("source_type") == "official"
    verified = official & (F.col("verification_status") == "officially_verified")
    out = flag("s", official & F.col("verification_status").isin(DISQUALIFYING))
    shown, passing = flag("s", verified), []
    for f in searches:
        some, none = on_rules(f)
        asked = on_columns(f, now) + [flag("s", verified & c) for c in on_sources(f, now)]
        asked += [F.coalesce(flag("r", c), F.lit(False)) for c in some] + [~F.coalesce(flag("r", c), F.lit(False)) for c in none]
        passing.append(reduce(lambda a, b: a & b, asked))
    facts = sources.groupBy("opportunity_id").agg(*flags["s"]).filter(shown & ~out)
    o = opportunities.filter("status = 'active'").join(facts, "opportunity_id")
    if flags["r"]:
        o = o.join(rules.groupBy("opportunity_id").agg(*flags["r"]), "opportunity_id", "left")
    numbers = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(passing)]))
    return o.select(*opportunities.columns, F.explode(numbers).alias("search"))


def public(opportunities: DataFrame, sources: DataFrame, rules: DataFrame, now: Column, filters: Filters = Filters()) -> DataFrame:
    """Active opportunities with a verified official source and no disqualifying one, that every filter lets pass.

    sources has opportunity_id, source_type, verification_status and last_verified_at; rules opportunity_id, rule_type,
    operator and value_key, a row for each value. Existence is tested by semi and anti joins, so nothing multiplies;
    filters on columns reach the scan. A filter whose value has no key, such as `??`, finds nothing.
    """
    f, o = filters, opportunities.filter("status = 'active'")
    for asked in on_columns(f, now):
        o = o.filter(asked)
    official = sources.filter("source_type = 'official'")
    for asked in on_sources(f, now):
        o = exists(o, official.filter("verification_status = 'officially_verified'").filter(asked), "opportunity_id")
    o = not_exists(o, official.filter(F.col("verification_status").isin(DISQUALIFYING)), "opportunity_id")
    some, none = on_rules(f)
    for asked in some:
        o = exists(o, rules.filter(asked), "opportunity_id")
    for asked in none:
        o = not_exists(o, rules.filter(asked), "opportunity_id")
    return o


@dataclass(frozen=True)
class AdminFilters:
    """What a curator's search asks for; a filter that is None does not apply."""

    country: str | None = None
    degree_level: str | None = None
    status: str | None = None
    verification_status: str | None = None
    needs_review: bool | None = None
    provider_query: str | None = None
    search_query: str | None = None
    deadline_after: datetime.datetime | None = None
    deadline_before: datetime.datetime | None = None


#: Columns that a curator's search looks through, and statuses of a source that ask for a review.
SEARCHED = ["name", "field_eligibility", "nationality_eligibility", "notes"]
TO_REVIEW = ["unverified", "needs_review", "conflicting_information"]


def administered(opportunities: DataFrame, sources: DataFrame, filters: AdminFilters = AdminFilters()) -> DataFrame:
    """Opportunities of any status that every filter of a curator's search lets pass."""
    f, o = filters, opportunities
    for column, value in {"degree_level": f.degree_level, "status": f.status}.items():
        o = o if value is None else o.filter(F.col(column) == value)
    if f.country is not None:
        o = o.filter(F.lower("country") == f.country.lower())
    if f.deadline_after is not None:
        o = o.filter(F.col("application_deadline") >= F.lit(f.deadline_after).cast("timestamp_ntz"))
    if f.deadline_before is not None:
        o = o.filter(F.col("application_deadline") <= F.lit(f.deadline_before).cast("timestamp_ntz"))
    if f.provider_query is not None:
        o = o.filter(like_anywhere(F.col("provider_name"), f.provider_query))
    if f.search_query is not None:
        o = o.filter(any_of(*[like_anywhere(F.col(c), f.search_query) for c in SEARCHED]))
    if f.verification_status is not None:
        o = exists(o, sources.filter(F.col("verification_status") == f.verification_status), "opportunity_id")
    if f.needs_review:
        marked = flagged(o, sources.filter(F.col("verification_status").isin(TO_REVIEW)), ["opportunity_id"], "_to_review")
        o = marked.filter((F.col("status") == "draft") | F.col("_to_review")).drop("_to_review")
    return o


def in_order(now: Column) -> list[Column]:
    """Open windows first, then by deadline (none last), name and id."""
    return [temporal.window_rank(state_of(now)), F.col("deadline").asc_nulls_last(), F.col("name"), F.col("opportunity_id")]


def funding_summary() -> Column:
    """The funding class, what is stated of tuition and stipend, and what is mentioned, joined by `; `."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    stipend = F.when(F.col("monthly_stipend_amount").isNotNull(), F.concat(F.lit("stipend: "), F.col("monthly_stipend_amount").cast("string"), F.lit(" "), F.coalesce("monthly_stipend_currency", F.lit("None"))))
    return F.concat_ws(
        "; ", F.translate("funding_classification", "_", " "), F.when(given("tuition_coverage"), F.concat(F.lit("tuition: "), "tuition_coverage")), stipend,
        F.when(given("accommodation_coverage"), "accommodation mentioned"), F.when(given("travel_allowance"), "travel mentioned"),
    )


def complete(types: Column) -> Column:
    """Whether an opportunity's rule types (null without any) give structure to each of its requirement texts."""
    met = F.coalesce(F.size(types) > 0, F.lit(False))
    for text, kinds in DEPENDENCIES.items():
        met = met & ((F.coalesce(F.col(text), F.lit("")) == "") | F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, kinds))), F.lit(False)))
    return met


def summaries(opportunities: DataFrame, sources: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """The catalogue's summary of each opportunity with its best source: verified official ones first, the latest, the least id."""
    verified = (F.col("source_type") == "official") & (F.col("verification_status") == "officially_verified")
    best = top_one(sources, ["opportunity_id"], F.when(verified, 0).when(F.col("source_type") == "official", 1).otherwise(2), F.col("last_verified_at").desc_nulls_last(), F.col("source_id"))
    types = rules.groupBy("opportunity_id").agg(F.collect_set("rule_type").alias("types"))  # few: a set of rule types
    joined = opportunities.join(best, "opportunity_id").join(types, "opportunity_id", "left")
    structured = complete(F.col("types"))
    return joined.select(
        "opportunity_id", "name", "provider_name", "country", "degree_level", F.col("opening").alias("application_opening_date"), F.col("deadline").alias("application_deadline"), "funding_type", "funding_classification",
        funding_summary().alias("funding_summary"), "verification_status", "last_verified_at", F.col("url").alias("official_source_url"), state_of(now).alias("application_window_state"),
        temporal.is_fresh(F.col("last_verified_at"), now).alias("source_is_fresh"), temporal.verification_freshness(F.col("last_verified_at"), now).alias("verification_freshness"),
        temporal.funding_label(F.col("funding_classification")).alias("funding_display_label"), F.when(structured, "decision_ready").otherwise("informational_only").alias("catalogue_decision_tier"),
        structured.alias("structured_eligibility_complete"),
    )
