"""File sources: seed JSON, JSON rows and CSV text, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import csv_header, csv_list, trimmed

# Names of CSV columns for parts of the source, list columns, funding components.
ALIASES = {
    "official_source_url": "url", "source_url": "url", "source_title": "title", "source_excerpt": "relevant_excerpt", "source_relevant_excerpt": "relevant_excerpt", "source_type": "source_type",
    "source_publication_date": "publication_date", "source_content_hash": "content_hash", "source_verification_status": "verification_status",
}
LISTS = ["required_documents", "eligibility_warnings"]
COMPONENTS = [f"{c}_coverage_status" for c in ("tuition", "stipend", "accommodation", "travel", "insurance", "fees")]
SOURCE_FIELDS = ["url", "title", "relevant_excerpt", "source_type", "publication_date", "content_hash", "verification_status"]
#: Rows of one import.
MOST_ROWS = 100


def seed_records(spark: SparkSession, paths: list[str], record: T.StructType) -> DataFrame:
    """The records of files {"records": [...]}, in one frame. A file without such a list is an error at reading."""
    schema = T.StructType([T.StructField("records", T.ArrayType(record))])
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    checked = F.when(F.col("records").isNull(), F.raise_error(F.lit("records must be a list"))).otherwise(F.col("records"))
    return files.select(F.explode(checked).alias("r")).select("r.*")


def rows_of_json(df: DataFrame, column: str, record: T.StructType, most: int = MOST_ROWS) -> DataFrame:
    """df's rows, one for each object of the JSON list in a column: row_number from 1 and the record's fields, without the column.

    A list that is no JSON, has none or over `most` objects, or holds something else, is an error when it is read.
    """
    parsed = F.from_json(column, T.ArrayType(record))
    # The variant's own parser takes nothing but whole JSON, and tells objects from other values.
    objects = F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("ARRAY<OBJECT"), F.lit(False))
    whole = F.when(objects & F.size(parsed).between(1, most), parsed)
    checked = F.coalesce(whole, F.raise_error(F.lit(f"an import is a list of 1 to {most} rows")))
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(checked).alias("_at", "_row")).select(*kept, (F.col("_at") + 1).cast("long").alias("row_number"), "_row.*")


def json_rows(spark: SparkSession, path: str, record: T.StructType, most: int = MOST_ROWS) -> DataFrame:
    """The rows of JSON files, each one import's list of at most `most` objects."""
    return rows_of_json(spark.read.text(path, wholetext=True), "value", record, most)


def csv_rows(spark: SparkSession, path: str, limit: int | None = MOST_ROWS) -> DataFrame:
    """Rows of a CSV file with a header as strings, with row_number from 2; empty rows are dropped.

    Header names are normalised; a blank or repeated one, no rows and more than `limit` rows are errors. limit=None
    reads a file of any size, whose rows are then numbered by place without gathering them.
    """
    raw = spark.read.option("header", False).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    placed = raw.withColumn("_at", F.monotonically_increasing_id())
    first = placed.orderBy("_at").first()
    if first is None:
        raise ValueError("the file has no header")
    names = [csv_header((v or "").lstrip("﻿")) for v in first[:-1]]
    if not all(names) or len(set(names)) != len(names):
        raise ValueError("header names must be given and unique")
    body = placed.filter(F.col("_at") != first["_at"]).toDF(*names, "_at")
    body = body.filter(F.exists(F.array(*[F.coalesce(trimmed(F.col(n)), F.lit("")) for n in names]), lambda v: v != ""))
    if limit is not None:
        count = body.limit(limit + 1).count()
        if not 1 <= count <= limit:
            raise ValueError(f"an import has 1 to {limit} rows")
    return body.select((F.col("_at") + 1).alias("row_number"), *names) if limit is not None else body.select(F.col("_at").alias("row_number"), *names)


def import_rows(rows: DataFrame) -> DataFrame:
    """CSV rows as nested import rows: trimmed cells made safe, lists split, source fields nested, warnings listed.

    A claim of full funding becomes unknown unless every component is confirmed. A source is built if any of its
    fields but the type is given; its type is official and its status needs_review by default.
    """
    plain = [c for c in rows.columns if c != "row_number"]
    text = {c: F.nullif(trimmed(F.col(c)), F.lit("")) for c in plain}
    risky = {c: F.substring(v, 1, 1).isin("=", "+", "-", "@") for c, v in text.items()}
    safe = {c: F.when(risky[c], F.concat(F.lit("'"), text[c])).otherwise(text[c]) for c in plain}
    sources: dict[str, Column] = {}
    for c in plain:
        if c in ALIASES:
            sources[ALIASES[c]] = F.coalesce(sources[ALIASES[c]], safe[c]) if ALIASES[c] in sources else safe[c]
    null = F.lit(None).cast("string")
    given = F.coalesce(*[sources.get(f, null) for f in SOURCE_FIELDS if f != "source_type"]).isNotNull()
    default = {"source_type": F.lit("official"), "verification_status": F.lit("needs_review")}
    nested = F.struct(*[(F.coalesce(sources.get(f, null), default[f]) if f in default else sources.get(f, null)).alias(f) for f in SOURCE_FIELDS])
    columns = {c: csv_list(safe[c]) if c in LISTS else safe[c] for c in plain if c not in ALIASES}
    warnings = [F.when(risky[c], F.lit(f"{c}: Formula-like value was neutralized")) for c in plain]
    if "funding_type" in columns:
        confirmed = F.lit(True)
        for c in COMPONENTS:
            confirmed = confirmed & (F.coalesce(columns.get(c, null), F.lit("")) == "confirmed")
        claim = (columns["funding_type"] == "full") & ~confirmed
        warnings.append(F.when(claim, F.lit("Imported full-funding claim was set to unknown until every component is verified")))
        columns["funding_type"] = F.when(claim, F.lit("unknown")).otherwise(columns["funding_type"])
    return rows.select("row_number", *[v.alias(c) for c, v in columns.items()], F.when(given, nested).alias("source"), F.array_compact(F.array(*warnings)).alias("warnings"))
