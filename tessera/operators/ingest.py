"""Batch import: validation messages, duplicates within the batch and against the catalogue, outcomes per row."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import is_sha256, slug, trimmed
from ..sources.readers import COMPONENTS

# Fixed values: (column, least, most) lengths of text fields, of lists, and the columns that hold web addresses.
LENGTHS = [
    ("name", 3, 255), ("provider_name", 2, 255), ("provider_canonical_id", 2, 120), ("programme_family_id", 2, 120), ("cycle_id", 2, 120), ("university_name", 2, 255), ("country", 2, 100),
    ("field_eligibility", 0, 2000), ("nationality_eligibility", 0, 2000), ("funding_policy", 20, 2000), ("tuition_coverage", 0, 2000), ("accommodation_coverage", 0, 2000), ("travel_allowance", 0, 2000),
    ("health_insurance", 0, 2000), ("application_fee_info", 0, 2000), ("english_language_requirement", 0, 2000), ("standardized_test_requirement", 0, 2000), ("minimum_academic_requirement", 0, 2000),
    ("application_method", 0, 1000), ("notes", 0, 8000), ("monthly_stipend_currency", 3, 3), ("source_title", 3, 255), ("source_excerpt", 20, 12000),
]
LISTS = [("required_documents", 30), ("eligibility_warnings", 30), ("eligibility_rules", 20)]
ADDRESSES = ["provider_website_url", "university_website_url", "application_url", "source_url"]
REQUIRED = ["name", "provider_name", "country", "degree_level"]
COVERAGE = ["confirmed", "partial", "not_covered", "unknown"]
CONFIDENCES = ["low", "medium", "high"]
# What columns of few values may hold; rule types by the kind of their values; operators.
CHOICES = {
    "degree_level": ["bachelors", "masters", "phd", "postdoc", "short_course"], "funding_type": ["full", "partial", "tuition_only", "stipend_only", "unknown"], **{c: COVERAGE for c in COMPONENTS},
    "application_fee_status": ["not_required", "required", "waiver_available", "unknown"], "status": ["draft", "active", "expired", "archived"], "data_confidence": CONFIDENCES,
    "source_type": ["official", "government", "university", "provider", "other"],
    "source_verification_status": ["unverified", "needs_review", "officially_verified", "expired", "conflicting_information", "archived"],
}
NUMERIC_RULES = ["cgpa", "percentage", "ielts", "toefl", "work_experience_months", "duolingo", "gre"]
CATEGORICAL_RULES = ["nationality", "residence", "target_degree", "field", "application_window", "study_mode", "intake_year", "current_education_level", "english_test_status", "gre_status"]
OPERATORS, SET_OPERATORS = ["equals", "in", "not_in", "gte", "lte"], ["in", "not_in"]


def _messages(df: DataFrame, checks: list[tuple[str, str, Column]]) -> Column:
    """Messages of failed checks; a check whose column is absent is skipped."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.lit(m)) for column, m, bad in checks if column in df.columns]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def rule_error(rule: Column) -> Column:
    """The first fault of a rule (rule_type, operator, value as JSON text, unit, grading_scale, confidence, curator_notes); null if none."""
    kind, operator, scale = rule.rule_type, rule.operator, rule.grading_scale.try_cast("double")
    shape = F.schema_of_variant(F.try_parse_json(rule.value))
    element = F.regexp_extract(shape, r"^(?:ARRAY<)?(\w+)", 1)
    is_list, is_set = shape.startswith("ARRAY"), operator.isin(SET_OPERATORS)
    empty = shape == "ARRAY<VOID>"
    number, text = element.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") | empty, (element == "STRING") | empty
    mixed = shape.rlike("^ARRAY<(VARIANT|BOOLEAN|ARRAY|OBJECT)") | shape.rlike("^(BOOLEAN|VOID|OBJECT)")
    return (
        F.when(~F.coalesce(kind.isin(NUMERIC_RULES + CATEGORICAL_RULES), F.lit(False)), "rule_type: Input should be a known rule type")
        .when(~F.coalesce(operator.isin(OPERATORS), F.lit(False)), "operator: Input should be a known operator")
        .when(shape.isNull(), "value: Field required")
        .when(F.length(rule.unit) > 64, "unit: Text must have at most 64 characters")
        .when(rule.grading_scale.isNotNull() & ~F.coalesce((scale > 0) & (scale <= 100), F.lit(False)), "grading_scale: Input should be above 0 and at most 100")
        .when(~F.coalesce(rule.confidence.isin(CONFIDENCES), rule.confidence.isNull()), "confidence: Input should be low, medium or high")
        .when(F.length(rule.curator_notes) > 2000, "curator_notes: Text must have at most 2000 characters")
        .when(kind.isin(CATEGORICAL_RULES) & ~operator.isin([*SET_OPERATORS, "equals"]), "Categorical eligibility rules support equals, in, and not_in only")
        .when(is_set & ~is_list, "IN and NOT_IN rules require a list value")
        .when(~is_set & is_list, "EQUALS, GTE, and LTE rules require a scalar value")
        .when(kind.isin(NUMERIC_RULES) & (mixed | ~number), "Numeric eligibility rules require numeric values")
        .when(~kind.isin(NUMERIC_RULES) & (mixed | ~text), "Categorical eligibility rules require text values")
        .when((kind == "cgpa") & rule.grading_scale.isNull(), "CGPA rules require a grading_scale")
    )


#: Categorical rule types whose values are texts to search by.
TEXTUAL_RULES = [k for k in CATEGORICAL_RULES if k != "intake_year"]


def value_keys(kind: Column, value: Column) -> Column:
    """Sorted distinct search keys of a rule's value (JSON text): of its texts, for textual rule types; empty for others."""
    parsed = F.try_parse_json(value)
    texts = F.when(F.schema_of_variant(parsed) == "STRING", F.array(F.try_variant_get(parsed, "$", "string"))).otherwise(F.try_variant_get(parsed, "$", "array<string>"))
    # Of a list, texts alone are values: numbers among them become texts of their figures and are told by their JSON.
    only = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.contains(value, F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)))
    keys = F.filter(F.transform(only, lambda x: slug(x)), lambda k: k != "")
    return F.when(kind.isin(TEXTUAL_RULES), F.array_sort(F.array_distinct(keys))).otherwise(F.array().cast("array<string>"))


def cycle_error(cycle: Column) -> Column:
    """The first fault of an application cycle (intake_year, application_opening_date, application_deadline, timezone); null if none."""
    zone = F.coalesce(trimmed(cycle.timezone), F.lit("UTC"))
    at = lambda c: c.try_cast("timestamp")
    return (
        F.when((cycle.intake_year < 2000) | (cycle.intake_year > 2100), "intake_year: Year must be 2000 to 2100")
        .when((F.length(cycle.timezone) < 1) | (F.length(cycle.timezone) > 64), "timezone: Text must have 1 to 64 characters")
        .when(~zone.isin(sorted(available_timezones())), "Timezone must be a valid IANA timezone")
        .when(at(cycle.application_deadline) < at(cycle.application_opening_date), "Application deadline cannot be before the opening date")
    )


def nested_errors(items: Column, name: str, fault) -> Column:
    """`name.place: fault` for each faulty item of a list, places from 0."""
    found = F.transform(F.coalesce(items, F.array()), lambda x, i: F.concat(F.lit(f"{name}."), i.cast("string"), F.lit(": "), fault(x)))
    return F.array_compact(found)


def validation_errors(df: DataFrame) -> Column:
    """Messages of every field rule that a row breaks, then those of its rules and cycles; absent columns are not checked."""
    nested = [nested_errors(F.col(c), c, fault) for c, fault in (("eligibility_rules", rule_error), ("application_cycles", cycle_error)) if c in df.columns and df.schema[c].dataType.typeName() == "array" and df.schema[c].dataType.elementType.typeName() == "struct"]
    return F.concat(_field_errors(df), *nested)


def _field_errors(df: DataFrame) -> Column:
    checks = [(c, f"{c}: Field required", F.col(c).isNull()) for c in REQUIRED if c in df.columns]
    for c, least, most in LENGTHS:
        if c in df.columns:
            size = F.length(trimmed(F.col(c)))
            checks.append((c, f"{c}: Text must have {least} to {most} characters", (size < least) | (size > most)))
    checks += [(c, f"{c}: List must have at most {most} items", F.size(c) > most) for c, most in LISTS if c in df.columns]
    checks += [(c, f"{c}: Input should be a valid URL", ~F.col(c).rlike(r"(?i)^https?://[^\s/?#]+\S*$")) for c in ADDRESSES if c in df.columns]
    checks += [(c, f"{c}: Input should be one of {', '.join(some)}", ~F.col(c).isin(some)) for c, some in CHOICES.items() if c in df.columns]
    if "monthly_stipend_amount" in df.columns:
        checks.append(("monthly_stipend_amount", "monthly_stipend_amount: Input should be greater than or equal to 0", F.col("monthly_stipend_amount").try_cast("double") < 0))
    if "source_hash" in df.columns:
        checks.append(("source_hash", "Content hash must be a lowercase SHA-256 hexadecimal digest", ~is_sha256(F.col("source_hash"))))
    if "intake_year" in df.columns:
        year = F.col("intake_year").try_cast("int")
        checks.append(("intake_year", "intake_year: Year must be 2000 to 2100", F.col("intake_year").isNotNull() & (year.isNull() | (year < 2000) | (year > 2100))))
    if {"application_opening_date", "application_deadline"} <= set(df.columns):
        at = lambda c: F.col(c).try_cast("timestamp")
        checks.append(("application_deadline", "Application deadline cannot be before the opening date", at("application_deadline") < at("application_opening_date")))
    if {"monthly_stipend_amount", "monthly_stipend_currency"} <= set(df.columns):
        checks.append(("monthly_stipend_amount", "Monthly stipend currency is required when amount is present", F.col("monthly_stipend_amount").isNotNull() & F.col("monthly_stipend_currency").isNull()))
    for c in ("required_documents", "eligibility_warnings"):
        if c in df.columns:
            checks.append((c, f"{c}: List items must not exceed 500 characters", F.exists(c, lambda x: F.length(trimmed(x)) > 500)))
    if "funding_type" in df.columns:
        confirmed = F.lit(True)
        for c in COMPONENTS:
            confirmed = confirmed & ((F.coalesce(F.col(c), F.lit("")) == "confirmed") if c in df.columns else F.lit(False))
        policy = F.col("funding_policy").isNotNull() if "funding_policy" in df.columns else F.lit(False)
        checks.append(("funding_type", "Full funding requires a documented policy and every component confirmed", (F.col("funding_type") == "full") & ~(policy & confirmed)))
    return _messages(df, checks)


def quality_warnings(df: DataFrame) -> Column:
    """Messages of what a valid row still lacks; an absent column is lacking."""
    of = lambda c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    checks = [
        (of("application_deadline").isNull(), "Missing application deadline"),
        (F.coalesce(of("funding_type"), F.lit("unknown")) == "unknown", "Funding type is unknown"),
        (F.coalesce(F.size(of("required_documents", "array<string>")), F.lit(0)) <= 0, "No required documents listed"),
        (of("english_language_requirement").isNull(), "English-language requirement is missing"),
        (of("minimum_academic_requirement").isNull(), "Minimum academic requirement is missing"),
        (F.coalesce(of("data_confidence"), F.lit("low")) == "low", "Data confidence is low; curator review is important"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(m)) for bad, m in checks]))


def duplicate_key(df: DataFrame) -> Column:
    """Lower-case provider, name, country and the intake year; null years agree."""
    clean = lambda c: F.lower(trimmed(F.coalesce(F.col(c), F.lit(""))))
    year = F.coalesce(F.col("intake_year").cast("string"), F.lit("")) if "intake_year" in df.columns else F.lit("")
    return F.struct(clean("provider_name").alias("provider"), clean("name").alias("name"), clean("country").alias("country"), year.alias("year"))


def outcomes(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """rows with outcome (invalid, duplicate, importable), errors and quality_warnings.

    Of the valid rows of one key, the first by row_number wins; a key that the catalogue has is a duplicate.
    """
    staged = rows.withColumns({"errors": validation_errors(rows), "quality_warnings": quality_warnings(rows), "_key": duplicate_key(rows)})
    valid = F.size("errors") == 0
    earlier = F.count_if(valid).over(Window.partitionBy("_key").orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1))
    keys = existing.select(duplicate_key(existing).alias("_key")).distinct().withColumn("_there", F.lit(True))
    joined = staged.withColumn("_earlier", earlier).join(keys, "_key", "left")
    outcome = F.when(~valid, "invalid").when((F.coalesce("_earlier", F.lit(0)) > 0) | F.coalesce("_there", F.lit(False)), "duplicate").otherwise("importable")
    return joined.withColumn("outcome", outcome).drop("_key", "_earlier", "_there")
