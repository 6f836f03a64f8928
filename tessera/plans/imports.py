"""Batch import through the ingest operators: documents stand for submitted rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..operators import ingest
from ..sources import readers
from ..sources.catalogue import Catalogue, shared_folder
from .registry import query

#: The submitted row of a document, as expressions that Spark and the oracle both read.
ROW = {
    "name": "CASE WHEN doc_id % 13 = 0 THEN ' x ' ELSE 'grant ' || CAST(n_chars % 60 AS STRING) END",
    "provider_name": "source",
    "country": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE upper(lang) END",
    "degree_level": "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'masters' END",
    "intake_year": "CASE WHEN doc_id % 11 = 0 THEN 1999 WHEN doc_id % 3 = 0 THEN NULL ELSE 2025 END",
    "funding_policy": "CASE WHEN doc_id % 23 = 0 THEN 'too short' END",
    "application_url": "CASE WHEN doc_id % 29 = 0 THEN 'ftp://x' ELSE 'https://a.example/apply' END",
    "monthly_stipend_amount": "CASE WHEN doc_id % 31 = 0 THEN -5 WHEN doc_id % 7 = 0 THEN 900 END",
    "monthly_stipend_currency": "CASE WHEN doc_id % 37 = 0 THEN 'EURO' WHEN doc_id % 14 = 0 THEN NULL ELSE 'EUR' END",
}
ERRORS = [
    ("country: Field required", "country IS NULL"),
    ("degree_level: Field required", "degree_level IS NULL"),
    ("name: Text must have 3 to 255 characters", "length(trim(name)) < 3"),
    ("funding_policy: Text must have 20 to 2000 characters", "length(trim(funding_policy)) < 20"),
    ("monthly_stipend_currency: Text must have 3 to 3 characters", "length(monthly_stipend_currency) <> 3"),
    ("application_url: Input should be a valid URL", "application_url LIKE 'ftp%'"),
    ("monthly_stipend_amount: Input should be greater than or equal to 0", "monthly_stipend_amount < 0"),
    ("intake_year: Year must be 2000 to 2100", "intake_year < 2000 OR intake_year > 2100"),
    ("Monthly stipend currency is required when amount is present", "monthly_stipend_amount IS NOT NULL AND monthly_stipend_currency IS NULL"),
]
ROWS_SQL = f"SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in ROW.items())} FROM documents"
VALID_SQL = " AND ".join(f"NOT coalesce({c}, false)" for _, c in ERRORS)
KEY_SQL = "lower(trim(coalesce(provider_name, ''))), lower(trim(coalesce(name, ''))), lower(trim(coalesce(country, ''))), coalesce(CAST(intake_year AS VARCHAR), '')"


def submitted(t):
    return t.documents.selectExpr("doc_id AS row_number", *[f"{e} AS {n}" for n, e in ROW.items()])


@query("batch_errors", " UNION ALL ".join(f"SELECT doc_id, '{m}' AS message FROM ({ROWS_SQL}) r WHERE {c}" for m, c in ERRORS))
def batch_errors(t):
    rows = submitted(t)
    return rows.select(F.col("row_number").alias("doc_id"), F.explode(ingest.validation_errors(rows)).alias("message"))


@query(
    "batch_import",
    f"WITH r AS ({ROWS_SQL}), v AS (SELECT *, {VALID_SQL} AS valid FROM r), k AS (SELECT doc_id, valid, ({KEY_SQL}) AS key FROM v), e AS (SELECT DISTINCT key FROM k WHERE doc_id % 50 = 1) "
    "SELECT doc_id, CASE WHEN NOT valid THEN 'invalid' WHEN coalesce(count(*) FILTER (WHERE valid) OVER (PARTITION BY key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 OR key IN (SELECT key FROM e) THEN 'duplicate' ELSE 'importable' END AS outcome FROM k",
)
def batch_import(t):
    """Outcomes of a batch: invalid, duplicate in the batch or of the catalogue (every fiftieth row is there), importable."""
    rows = submitted(t)
    return ingest.outcomes(rows, rows.filter("row_number % 50 = 1")).select(F.col("row_number").alias("doc_id"), "outcome")


SITE = "CASE WHEN doc_id % 5 = 0 THEN 'https://' || source || '.example/' || CAST(doc_id % 3 AS STRING) END"
LOADED_SQL = (
    f"WITH r AS (SELECT *, {VALID_SQL} AS valid, {SITE} AS site FROM ({ROWS_SQL.replace('FROM documents', ', source FROM documents')}) d), "
    f"k AS (SELECT *, row_number() OVER (PARTITION BY valid, {KEY_SQL} ORDER BY doc_id % 4, doc_id) AS nth FROM r), o AS (SELECT * FROM k WHERE valid AND nth = 1), "
    "p AS (SELECT lower(trim(provider_name)) AS provider, arg_min(site, (doc_id % 4) * 1000000000000 + doc_id) FILTER (WHERE site IS NOT NULL) AS website_url FROM o GROUP BY 1)"
)


@query("seed_load", f"{LOADED_SQL} SELECT doc_id, doc_id % 4 AS batch, sha256('name:' || provider) AS provider_id, p.website_url, 1 + doc_id % 3 AS n_sources FROM o JOIN p ON p.provider = lower(trim(o.provider_name))")
def seed_load(t):
    """The catalogue after four batches of submitted rows, of which one was stopped before its entry and one came twice."""
    catalogue = Catalogue(t.spark, f"{shared_folder(t.spark)}/catalogue-{uuid.uuid4().hex}")
    more = F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("row_number") % 3), lambda i: F.struct(F.concat(F.lit("https://a.example/"), i.cast("string")).alias("url"), F.lit("Official call").alias("title"), F.lit("Stated on the official page.").alias("relevant_excerpt")))
    rows = t.documents.selectExpr("doc_id AS row_number", *[f"{e} AS {n}" for n, e in ROW.items()], f"{SITE} AS provider_website_url").withColumn("sources", more)

    def stopped():
        raise InterruptedError

    for b in range(4):
        batch = rows.filter(F.col("row_number") % 4 == b)
        try:
            catalogue.load(batch, b, stopped if b == 1 else None)
        except InterruptedError:
            catalogue.load(batch, b)
        if b == 2:
            catalogue.load(batch, b)
    sources = catalogue.table("sources").groupBy("opportunity_id").agg(F.count(F.lit(1)).alias("n_sources"))
    found = catalogue.table("opportunities").join(catalogue.providers().select("provider_id", "website_url"), "provider_id").join(sources, "opportunity_id")
    return found.select(F.col("row_number").alias("doc_id"), "batch", "provider_id", "website_url", "n_sources")


#: A rule of a part as a curator may have typed it; values are JSON.
TYPED = {
    "rule_type": "CASE p_partkey % 6 WHEN 0 THEN 'cgpa' WHEN 1 THEN 'nationality' WHEN 2 THEN 'ielts' WHEN 3 THEN 'field' WHEN 4 THEN 'gre' ELSE 'astrology' END",
    "operator": "CASE p_size % 7 WHEN 0 THEN 'in' WHEN 1 THEN 'gte' WHEN 2 THEN 'equals' WHEN 3 THEN 'not_in' WHEN 4 THEN 'lte' WHEN 5 THEN 'equals' ELSE 'like' END",
    "value": "CASE p_partkey % 5 WHEN 0 THEN '[1, 2.5]' WHEN 1 THEN '3' WHEN 2 THEN '\"x\"' WHEN 3 THEN '[\"x\", \"y\"]' ELSE NULL END",
    "unit": "CASE WHEN p_partkey % 41 = 0 THEN repeat('u', 65) END",
    "grading_scale": "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 4 WHEN 2 THEN 101 ELSE 10 END",
    "confidence": "CASE WHEN p_partkey % 37 = 0 THEN 'sure' WHEN p_partkey % 2 = 0 THEN 'high' END",
    "curator_notes": "CASE WHEN p_partkey % 43 = 0 THEN repeat('n', 2001) END",
}
NUMERIC_SQL = "rule_type IN ('cgpa', 'ielts', 'gre')"
TYPED_SQL = (
    "CASE WHEN rule_type = 'astrology' THEN 'rule_type: Input should be a known rule type' WHEN operator = 'like' THEN 'operator: Input should be a known operator' WHEN value IS NULL THEN 'value: Field required' "
    "WHEN length(unit) > 64 THEN 'unit: Text must have at most 64 characters' WHEN grading_scale > 100 THEN 'grading_scale: Input should be above 0 and at most 100' WHEN confidence = 'sure' THEN 'confidence: Input should be low, medium or high' "
    f"WHEN length(curator_notes) > 2000 THEN 'curator_notes: Text must have at most 2000 characters' WHEN NOT {NUMERIC_SQL} AND operator IN ('gte', 'lte') THEN 'Categorical eligibility rules support equals, in, and not_in only' "
    "WHEN operator IN ('in', 'not_in') AND value NOT LIKE '[%' THEN 'IN and NOT_IN rules require a list value' WHEN operator NOT IN ('in', 'not_in') AND value LIKE '[%' THEN 'EQUALS, GTE, and LTE rules require a scalar value' "
    f"WHEN {NUMERIC_SQL} AND contains(value, 'x') THEN 'Numeric eligibility rules require numeric values' WHEN NOT {NUMERIC_SQL} AND NOT contains(value, 'x') THEN 'Categorical eligibility rules require text values' "
    "WHEN rule_type = 'cgpa' AND grading_scale IS NULL THEN 'CGPA rules require a grading_scale' END"
)


@query("batch_rule_errors", f"SELECT p_partkey, 'eligibility_rules.0: ' || fault AS message FROM (SELECT p_partkey, {TYPED_SQL} AS fault FROM (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in TYPED.items())} FROM part) r) f WHERE fault IS NOT NULL")
def batch_rule_errors(t):
    """The faults of each part's rule."""
    rule = F.struct(*[F.expr(e).alias(n) for n, e in TYPED.items()])
    rows = t.part.select("p_partkey", F.array(rule).alias("eligibility_rules"))
    return rows.select("p_partkey", F.explode(ingest.validation_errors(rows)).alias("message"))


@query("json_import_rows", "SELECT event_id, i AS row_number, CAST(json_extract(props, '$.k') AS BIGINT) + (i - 1) * 1000 AS k FROM events, (SELECT unnest([1, 2, 3]) AS i) n WHERE i <= 1 + event_id % 3")
def json_import_rows(t):
    """Each event's properties as an import of one to three JSON rows."""
    number = F.get_json_object("props", "$.k").cast("long")
    items = F.transform(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3), lambda i: F.concat(F.lit('{"k": '), (number + i * 1000).cast("string"), F.lit(', "other": []}')))
    texts = t.events.select("event_id", F.concat(F.lit(" ["), F.array_join(items, ", "), F.lit("]")).alias("body"))
    return readers.rows_of_json(texts, "body", T.StructType([T.StructField("k", T.LongType())]))


KEYED = {
    "rule_type": "CASE p_partkey % 5 WHEN 0 THEN 'nationality' WHEN 1 THEN 'cgpa' WHEN 2 THEN 'field' WHEN 3 THEN 'intake_year' ELSE 'study_mode' END",
    "value": "CASE p_size % 6 WHEN 0 THEN '[\"Land  1\", \"land 1\", 7]' WHEN 1 THEN '\"Full-Time!\"' WHEN 2 THEN '3.5' WHEN 3 THEN '[\"B\", \"a\", \"?\"]' WHEN 4 THEN NULL ELSE '[]' END",
}


@query(
    "rule_value_keys",
    f"SELECT p_partkey, unnest(CASE value WHEN '[\"Land  1\", \"land 1\", 7]' THEN ['land-1'] WHEN '\"Full-Time!\"' THEN ['full-time'] WHEN '[\"B\", \"a\", \"?\"]' THEN ['a', 'b'] ELSE [] END) AS value_key FROM (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in KEYED.items())} FROM part) r WHERE rule_type IN ('nationality', 'field', 'study_mode')",
)
def rule_value_keys(t):
    """The search keys of each part's rule, a row each."""
    keys = ingest.value_keys(F.expr(KEYED["rule_type"]), F.expr(KEYED["value"]))
    return t.part.select("p_partkey", F.explode(keys).alias("value_key"))


GIVEN = {
    "application_deadline": "CASE WHEN doc_id % 2 = 0 THEN '2025-01-01' END",
    "funding_type": "CASE WHEN doc_id % 3 = 0 THEN 'partial' WHEN doc_id % 3 = 1 THEN 'unknown' END",
    "english_language_requirement": "CASE WHEN doc_id % 5 = 0 THEN 'B2' END",
    "data_confidence": "CASE WHEN doc_id % 7 = 0 THEN 'high' WHEN doc_id % 7 = 1 THEN 'low' END",
}
LACKING_SQL = (
    "concat_ws('; ', CASE WHEN doc_id % 2 <> 0 THEN 'Missing application deadline' END, CASE WHEN doc_id % 3 <> 0 THEN 'Funding type is unknown' END, CASE WHEN doc_id % 4 <> 0 THEN 'No required documents listed' END, "
    "CASE WHEN doc_id % 5 <> 0 THEN 'English-language requirement is missing' END, 'Minimum academic requirement is missing', CASE WHEN doc_id % 7 <> 0 THEN 'Data confidence is low; curator review is important' END)"
)


@query("batch_warnings", f"SELECT doc_id, {LACKING_SQL} AS warnings FROM documents")
def batch_warnings(t):
    rows = t.documents.selectExpr("doc_id", *[f"{e} AS {n}" for n, e in GIVEN.items()]).withColumn("required_documents", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("cv"))).otherwise(F.array().cast("array<string>")))
    return rows.select("doc_id", F.array_join(ingest.quality_warnings(rows), "; ").alias("warnings"))


@query("cleaned_lists", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(CASE WHEN doc_id % 4 = 0 THEN ' a ;;' || source || ' ; ' ELSE lang || ';' || chr(9) || 'b' END, ';'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), '|') AS items FROM documents")
def cleaned_lists(t):
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" a ;;"), "source", F.lit(" ; "))).otherwise(F.concat("lang", F.lit(";\tb")))
    return t.documents.select("doc_id", F.array_join(scalar.cleaned(F.split(text, ";")), "|").alias("items"))
