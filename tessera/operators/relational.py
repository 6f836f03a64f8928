"""Relational building blocks: existence, top one per group, paging, keyed writes as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def exists(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def not_exists(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def flagged(df: DataFrame, keys: DataFrame, on: list[str], flag: str) -> DataFrame:
    """df with a boolean column: whether its key occurs in `keys`. For existence tests under an OR."""
    marked = keys.select(*on).distinct().withColumn(flag, F.lit(True))
    return df.join(marked, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group; the order should be total, or ties fall either way."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def recent(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


#: Rows of a part of dealt().
PART_ROWS = 500_000


def parts_for(df: DataFrame, rows: int | None = None) -> int:
    """How many parts of about `rows` rows df makes, at least one for each task slot."""
    return max(-(-df.count() // (rows or PART_ROWS)), df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df dealt by a key into a fixed number of parts, which joins and groupings by the key keep.

    With parts_for() a part's rows, and the memory of the task that sorts them, do not grow with the table.
    """
    return df.repartition(parts, key)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: total, count on the page, has_next, has_previous."""
    total = F.count(F.lit(1))
    count = F.greatest(F.lit(0), F.least(F.lit(limit), total - offset)).cast("long")
    return df.agg(total.alias("total"), count.alias("count"), (offset + count < total).alias("has_next"), F.lit(offset > 0).alias("has_previous"))


def like_anywhere(column: Column, value: str) -> Column:
    """Case-insensitive LIKE with the value as it is: its % and _ are wildcards."""
    return F.lower(column).like(f"%{value.strip().lower()}%")


def by_alias(df: DataFrame, column: str, value: str, aliases: dict[str, str]) -> DataFrame:
    """Rows whose column has the value that an alias names, white space and case aside; none for an unknown alias."""
    stored = aliases.get(value.strip().lower())
    return df.filter(F.lit(False) if stored is None else F.col(column) == F.lit(stored))


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a primary key; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def numbered(rows: DataFrame, order: list[Column], most: int = 100) -> DataFrame:
    """A batch with row_number from 1; a batch has at most `most` rows, and more are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a batch has at most {most} rows")
    return rows.withColumn("row_number", F.row_number().over(Window.orderBy(*order)))


def updated_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """UPDATE ... SET ... WHERE: a null condition leaves a row as it is."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def nulled_where_gone(children_: DataFrame, parents: DataFrame, child: str, key: str) -> DataFrame:
    """ON DELETE SET NULL: a child's reference becomes null where no parent has it."""
    there = parents.select(F.col(key).alias("_there")).distinct()
    joined = children_.join(there, F.col(child) == F.col("_there"), "left")
    return joined.withColumn(child, F.col("_there")).drop("_there")


def one_of_filters(first, second, what: str) -> None:
    """Two filters that exclude each other: naming both is an error."""
    if first is not None and second is not None:
        raise ValueError(what)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def upsert_keep(existing: DataFrame, incoming: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """Get-or-create: existing rows stay and only fill nulls of `fill`; new keys are added once."""
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fill])
    new = top_one(new, keys, *[F.col(f"_new_{c}").asc_nulls_last() for c in fill])
    joined = existing.select(*keys, *fill).join(new, keys, "full")
    return joined.select(*keys, *[F.coalesce(c, f"_new_{c}").alias(c) for c in fill])


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The incoming rows to append: first of each key, keys not there yet. Running it again appends nothing."""
    return top_one(incoming, keys, *order).join(existing, keys, "left_anti")


def patched(existing: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """PATCH: columns named in the patch row's fields_set take its value, null too; version rises if any row came."""
    p = patches.select(key, "fields_set", *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = existing.join(p, key, "left")
    chosen = {c: F.when(F.array_contains("fields_set", c), F.col(f"_p_{c}")).otherwise(F.col(c)) for c in columns}
    version = F.col("version") + F.when(F.col("fields_set").isNotNull(), 1).otherwise(0)
    return joined.withColumns({**chosen, "version": version}).select(*existing.columns)


def versioned_update(existing: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each update with its outcome: updated, conflict (another version) or not_found; and the resulting values."""
    u = updates.select(key, F.col("expected_version"), *[F.col(c).alias(f"_u_{c}") for c in columns])
    joined = u.join(existing, key, "left")
    ok = F.col("version") == F.col("expected_version")
    outcome = F.when(F.col("version").isNull(), "not_found").when(ok, "updated").otherwise("conflict")
    return joined.select(key, outcome.alias("outcome"), *[F.when(ok, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.when(ok, F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def update_sequence(existing: DataFrame, updates: DataFrame, key: str, *order: str) -> DataFrame:
    """All updates with outcome (updated, conflict or not_found) and version, each seeing the version that the one before left.

    existing has key (unique) and version, updates has key, expected_version and the columns of a total `order`. An
    update without an expected version always applies. A key's updates are decided one after the other by definition:
    they stream in order through one task that holds a version and nothing else.
    """
    stored = existing.select(F.col(key).alias("_key"), F.col("version").cast("long").alias("_stored"))
    joined = updates.join(stored, F.col(key) == F.col("_key"), "left").drop("_key")
    schema = T.StructType([*joined.drop("_stored").schema.fields, T.StructField("outcome", T.StringType()), T.StructField("version", T.LongType())])
    arrow = to_arrow_schema(schema)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, version = object(), None
        for batch in batches:
            outcomes, versions = [], []
            for k, stored, expected in zip(batch[key].to_pylist(), batch["_stored"].to_pylist(), batch["expected_version"].to_pylist(), strict=True):
                if k is None or k != current:
                    current, version = k, stored
                if version is not None and expected in (None, version):
                    version += 1
                    outcomes.append("updated")
                else:
                    outcomes.append("not_found" if version is None else "conflict")
                versions.append(version)
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in arrow.names[:-2]], pa.array(outcomes, pa.string()), pa.array(versions, pa.int64())], names=arrow.names)

    return joined.repartition(key).sortWithinPartitions(key, *order).mapInArrow(decide, schema)


def updated_rows(existing: DataFrame, decided: DataFrame, key: str, columns: list[str], *order: str) -> DataFrame:
    """existing after the updates of update_sequence(): a column takes the value of the last one that applied and names it in fields_set."""
    at = F.struct(*order)
    last = lambda c: F.max_by(F.struct(F.col(c).alias("value")), F.when(F.array_contains("fields_set", c), at)).alias(f"_u_{c}")
    applied = decided.filter("outcome = 'updated'").groupBy(F.col(key).alias("_key")).agg(*[last(c) for c in columns], F.max("version").alias("_version"))
    joined = existing.join(applied, F.col(key) == F.col("_key"), "left")
    chosen = {c: F.when(F.col(f"_u_{c}").isNotNull(), F.col(f"_u_{c}.value")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns({**chosen, "version": F.coalesce("_version", "version")}).select(*existing.columns)


def without_where(df: DataFrame, condition: Column) -> DataFrame:
    """DELETE WHERE: rows for which the condition is null stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))
