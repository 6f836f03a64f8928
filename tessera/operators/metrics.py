"""Counters, latency histograms and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Upper bounds of the latency buckets in milliseconds.
BOUNDS = [50, 100, 250, 500, 1000, 2500, 5000]
LABELS = [f"le_{b}" for b in BOUNDS] + [f"gt_{BOUNDS[-1]}"]


def bucket(value: Column) -> Column:
    """The label of the least bound that a value does not pass; null for none, which no bucket counts."""
    out = F.lit(LABELS[-1])
    for b in reversed(BOUNDS):
        out = F.when(value <= b, f"le_{b}").otherwise(out)
    return F.when(value.isNotNull(), out)


def histogram(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, bucket, n) with a row for every bucket of every group, zero where empty."""
    counted = df.groupBy(by).agg(*[F.count_if(bucket(F.col(value)) == label).alias(label) for label in LABELS])
    return counted.select(by, F.explode(F.array(*[F.struct(F.lit(label).alias("bucket"), F.col(label).alias("n")) for label in LABELS])).alias("x")).select(by, "x.*")


def nearest_rank(df: DataFrame, by: str, value: str, shares: list[float], blocks: int = 64) -> DataFrame:
    """(by, share columns p50 and so on): the value at place round((n - 1) * share), ties to even, from 0.

    Equal values are counted first. A sketch of each group's quantiles cuts its values into blocks; places run on from
    block to block, so a group is ranked by as many tasks as it has blocks, and exactly, however rough the sketch.
    """
    counted = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = df.groupBy(by).agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 1000).alias("_cuts"))
    placed = counted.join(cuts, by).withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = placed.groupBy(by, "_block").agg(F.sum("_n").alias("_rows"))
    whole, ahead = Window.partitionBy(by), Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(by, "_block", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"), F.sum("_rows").over(whole).alias("_all"))
    inner = Window.partitionBy(by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(starts, [by, "_block"]).withColumn("_end", F.col("_start") + F.sum("_n").over(inner))
    # A value holds the places from _end - _n to _end - 1.
    place = lambda s: F.bround((F.col("_all") - 1) * F.lit(s), 0)
    at = lambda s: F.max(F.when((place(s) < F.col("_end")) & (place(s) >= F.col("_end") - F.col("_n")), F.col(value)))
    return ranked.groupBy(by).agg(*[at(s).alias(f"p{round(s * 100)}") for s in shares], F.max(value).alias("max"), F.sum("_n").alias("n"))


def job_totals(runs: DataFrame, job: str = "job") -> DataFrame:
    """Of each job's runs (started_at, completed_at, processed, error): processed and failed in all, the last run's error and the durations.

    A failed run has an error and processes nothing; the last error is null once a later run went through.
    """
    failed = F.col("error").isNotNull()
    duration = F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000).cast("long"))
    last = F.max_by(F.struct("error"), F.struct("completed_at", "started_at", F.coalesce("error", F.lit("")))).getField("error")
    return runs.groupBy(job).agg(
        F.sum(F.when(failed, 0).otherwise(F.greatest(F.col("processed"), F.lit(0)))).alias("processed"), F.count_if(failed).alias("failed"), last.alias("last_error"), F.sum(duration).alias("duration_ms"), F.max(duration).alias("longest_ms")
    )
