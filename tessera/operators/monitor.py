"""Source monitoring: stored against observed content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, temporal


def changes(stored: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Each observed source with its change: initialised (no stored hash), changed, unchanged, or failed (no hash seen).

    A change sends the source to review.
    """
    joined = observed.join(stored.select(key, "content_hash"), key, "left")
    change = F.when(F.col("observed_hash").isNull(), "failed").when(F.col("content_hash").isNull(), "initialised").when(F.col("content_hash") != F.col("observed_hash"), "changed").otherwise("unchanged")
    return joined.withColumn("change", change).withColumn("needs_review", F.col("change") == "changed")


def due(sources: DataFrame, active: DataFrame, key: str, now: Column, interval_days: int = 7, fresh_days: int = 90) -> DataFrame:
    """Verified official sources of active opportunities to look at: never looked at, not for `interval_days`, or verified over `fresh_days` ago.

    sources has key, source_type, verification_status, last_updated_at and last_verified_at; active has key.
    """
    long_ago = lambda c, n: F.col(c) <= now - temporal.days(n)
    waiting = F.col("last_updated_at").isNull() | long_ago("last_updated_at", interval_days) | long_ago("last_verified_at", fresh_days)
    own = sources.filter((F.col("source_type") == "official") & (F.col("verification_status") == "officially_verified") & waiting)
    return own.join(active.select(key), key, "left_semi")


def summary(found: DataFrame) -> DataFrame:
    """Of a run: candidates, those checked (not failed), and each change's number."""
    kinds = ("changed", "unchanged", "initialised", "failed")
    return found.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("change") != "failed").alias("checked"), *[F.count_if(F.col("change") == c).alias(c) for c in kinds])


def records(found: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """A record of each check that did not fail: status note, hashes, and the excerpt that a change captures."""
    at = F.col(url)
    note = (
        F.when(F.col("change") == "initialised", F.concat(F.lit("Automated source monitor recorded initial content hash from "), at, F.lit(".")))
        .when(F.col("change") == "changed", F.concat(F.lit("Automated source monitor detected changed content at "), at, F.lit(".")))
        .otherwise(F.concat(F.lit("Automated source monitor found no content-hash change at "), at, F.lit(".")))
    )
    seen = F.when(F.col("change") == "changed", scalar.excerpt(F.col(text)))
    return found.filter("change <> 'failed'").select(key, "change", note.alias("notes"), F.col("content_hash").alias("previous_hash"), F.col("observed_hash").alias("current_hash"), seen.alias("excerpt"))


def applied(sources: DataFrame, found: DataFrame, key: str, now) -> DataFrame:
    """Sources with the observed hash, status and check time of `found`; others stay."""
    seen = found.select(key, "observed_hash", "needs_review")
    joined = sources.join(seen, key, "left")
    return joined.select(
        *[c for c in sources.columns if c not in ("content_hash", "verification_status", "last_updated_at")],
        F.coalesce("observed_hash", "content_hash").alias("content_hash"),
        F.when(F.col("needs_review"), "needs_review").otherwise(F.col("verification_status")).alias("verification_status"),
        F.when(F.col("observed_hash").isNotNull(), now).otherwise(F.col("last_updated_at")).alias("last_updated_at"),
    )
