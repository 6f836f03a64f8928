"""Hash-chained audit log: building and verifying chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST = "0" * 64


def entry_hash(previous: Column, *fields: Column) -> Column:
    """SHA-256 of the previous hash and the entry's fields; a null field counts as empty."""
    return F.sha2(F.concat_ws("|", previous, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def build_chain(df: DataFrame, chain: str, order: list[str], fields: list[str]) -> DataFrame:
    """df with previous_hash and integrity_hash. A chain is sequential, so its rows stream through one task, sorted;
    different chains run side by side, and a chain of any length needs the memory of one batch."""
    body = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    keyed = df.select("*", F.col(chain).cast("string").alias("_chain"), body.alias("_body"))
    kept = keyed.repartition("_chain").sortWithinPartitions("_chain", *order)
    schema = kept.drop("_chain", "_body").schema.add("previous_hash", "string").add("integrity_hash", "string")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = object(), FIRST
        for batch in batches:
            before, after = [], []
            for key, text in zip(batch["_chain"].to_pylist(), batch["_body"].to_pylist(), strict=True):
                if key != current:
                    current, last = key, FIRST
                before.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                after.append(last)
            table = pa.Table.from_batches([batch]).drop(["_chain", "_body"])
            table = table.append_column("previous_hash", pa.array(before, pa.string())).append_column("integrity_hash", pa.array(after, pa.string()))
            yield from table.to_batches()

    return kept.mapInArrow(linked, schema)


def broken_links(df: DataFrame, chain: str, order: list[str], fields: list[str]) -> DataFrame:
    """Rows whose link or hash is wrong. Only the stored previous hash is needed, so all rows check in parallel."""
    before = F.coalesce(F.lag("integrity_hash").over(Window.partitionBy(chain).orderBy(*order)), F.lit(FIRST))
    checked = df.withColumn("_before", before)
    wrong = (F.col("previous_hash") != F.col("_before")) | (F.col("integrity_hash") != entry_hash(F.col("previous_hash"), *[F.col(f) for f in fields]))
    return checked.filter(F.coalesce(wrong, F.lit(True))).drop("_before")
