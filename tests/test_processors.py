"""Streams on transformWithState against the batch queries, on shuffled micro-batches with late rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import services
from tessera.streaming import processors, stateful

DATA = "/root/testdata/sf0.001"
KINDS = "CASE event_type WHEN 'signup' THEN 'reserve' WHEN 'purchase' THEN 'verify' ELSE 'use' END"
SCHEMA = "key string, ts timestamp, event_id long, kind string"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """(batch rows of a few users, folder of four files that deal them at random, with a last file that moves the watermark on)."""
    rows = spark.read.parquet(f"{DATA}/events.parquet").filter("user_id % 10 = 0").selectExpr("CAST(user_id AS STRING) AS key", "CAST(ts AS TIMESTAMP) AS ts", "event_id", f"{KINDS} AS kind")
    folder = tmp_path_factory.mktemp("events")
    for i in range(4):
        rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(str(folder))
    for i in range(2):
        spark.sql(f"SELECT '0' AS key, TIMESTAMP '2030-01-0{i + 1}' AS ts, {-i - 1}L AS event_id, 'end' AS kind").coalesce(1).write.mode("append").parquet(str(folder))
    return rows.cache(), str(folder)


def streamed(spark, folder, processor, name):
    for k, v in processors.ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        out = processors.processed(stream, processor, "60 days")
        query = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        return spark.table(name)
    finally:
        for k in processors.ROCKSDB:
            spark.conf.unset(k)


def test_limits_as_in_batch(spark, events):
    rows, folder = events
    got = {tuple(r) for r in streamed(spark, folder, processors.Limiter(2, 36_000), "tws_limits").filter("event_id >= 0").collect()}
    assert got == {tuple(r) for r in stateful.sliding_limits(rows, 2, 36_000).collect()} and {x[2] for x in got} == {True, False}


def test_token_families_as_in_batch(spark, events):
    rows, folder = events
    renamed = rows.withColumn("kind", F.when(F.col("kind") == "verify", "rotate").otherwise(F.col("kind")))
    target = folder + "-tokens"
    for i in range(3):
        renamed.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(target)
    for i in range(2):
        spark.sql(f"SELECT 'x' AS key, TIMESTAMP '2030-01-0{i + 1}' AS ts, {-i - 1}L AS event_id, 'end' AS kind").coalesce(1).write.mode("append").parquet(target)
    got = streamed(spark, target, processors.TokenFamily(), "tws_tokens").groupBy("key").agg(F.min("at"), F.count(F.lit(1)), F.count_if("revokes")).collect()
    rotated = renamed.filter("kind = 'rotate'").groupBy("key").agg(F.min("ts").alias("rotated"))
    want = renamed.join(rotated, "key").filter("ts > rotated").groupBy("key").agg(F.min(F.unix_micros("ts")), F.count(F.lit(1)), F.lit(1)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_seats_as_in_batch(spark, events):
    rows, folder = events
    changes = streamed(spark, folder, processors.Seat(12 * 3600, 3600), "tws_seats").filter("key <> '0'")
    clock = F.lit("2024-01-20 00:00:00").cast("timestamp")
    last = changes.filter(F.col("at") <= F.unix_micros(clock)).groupBy("key").agg(F.max_by("state", F.struct("at", F.expr("array_position(array('pending', 'reserved', 'redeemed', 'expired'), state)"))).alias("state"))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    invited = rows.filter("key <> '0'").groupBy("key").agg(first("reserve").alias("reserved"), first("verify").alias("verified"), F.min("ts").alias("start"))
    expires = F.col("start") + F.make_dt_interval(hours=(12 + F.col("key").cast("int") % 1000))
    want = invited.select("key", services.invitation_state(F.col("reserved"), F.col("verified"), expires, clock).alias("state"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in want.collect()}
    assert changes.filter("state = 'expired'").count() > 0


def test_a_quiet_family_is_forgotten(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1, "rotate"), ("a", "2024-01-01 00:00:10", 2, "use"), ("a", "2024-01-09 00:00:00", 3, "use"), ("b", "2030-01-01 00:00:00", 4, "use"), ("b", "2030-01-02 00:00:00", 5, "use")]
    for i in (1, 0, 2, 3, 4):
        spark.createDataFrame([rows[i]], "key string, ts string, event_id long, kind string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = streamed(spark, str(tmp_path / "in"), processors.TokenFamily(keep_seconds=3600), "tws_quiet").collect()
    assert [(r.key, r.event_id, r.revokes) for r in got] == [("a", 2, True)]
