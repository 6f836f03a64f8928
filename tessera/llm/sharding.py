"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash. Pass two permutes each bucket: its
records are put into a fixed order and take the places that `shuffle`, Spark's seeded Fisher-Yates (inside-out) shuffle,
draws for the bucket. Only the places are drawn as arrays; the records themselves are sorted, which spills. The buckets
in order are the shuffled data; shard i is the i-th of `num_shards` equal runs of it, so the record counts of two
shards differ by one at most and a bucket feeds few shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed, running_offsets, table, unpacked

#: Draws of places are dealt over at most this many tasks; bucket b is drawn in task b modulo their number.
DRAW_TASKS = 1 << 14


def shuffle_into_shards(
    df: DataFrame, num_shards: int = 16, seed: int = 17, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All of df's rows and columns, with `shard` (0 to num_shards - 1) and `slot` (gapless from 0 in a shard).

    A null text counts no bytes; null ids, empty texts and repeated rows are shuffled like any other row. The
    bucket depends on seed, id, text and the other columns, so copies of a text spread unless all their columns agree;
    rows that agree in all share a bucket, where they are streamed and never collected. An empty input gives no rows;
    fewer rows than shards leave shards empty. Input columns named `shard` or `slot` are replaced; columns of any type
    pass. Equal inputs and settings give equal results, however many partitions the session's shuffles have: a draw
    depends on the seed, the bucket and the number of buckets alone.
    """
    if num_shards < 1 or bucket_bytes < 1:
        raise ValueError("num_shards and bucket_bytes must be positive")
    of = F.col("record").getField
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    others = F.xxhash64(F.to_json(F.struct(*[of(c).alias(f"c{i}") for i, c in enumerate(rest)]))) if rest else F.lit(0).cast("long")
    size = F.coalesce(F.octet_length(of(text_col)), F.lit(0)) + F.lit(1)
    records = packed(df)
    rows, volume = records.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    buckets = max(1, math.ceil((volume or 0) / bucket_bytes))
    hashed = records.select(F.xxhash64(F.lit(seed), of(id_col), of(text_col)).alias("mix"), others.alias("others"), "record")
    scattered = hashed.withColumn("bucket", F.pmod(F.xxhash64("mix", "others"), F.lit(buckets)))
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    offsets = running_offsets(counts, "bucket", "rows")
    # A draw starts from the seed and its task's number, and goes on with the task's next bucket.
    tasks = min(buckets, DRAW_TASKS)
    drawing = offsets.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
    drawn = drawing.select("bucket", "offset", F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), F.lit(seed)).alias("places"))
    order = Window.partitionBy("bucket").orderBy("mix", "others")
    ordered = scattered.withColumn("at", F.row_number().over(order)).select("bucket", "at", "record")
    placed = ordered.join(drawn, "bucket").select("record", (F.col("offset") + F.get("places", F.col("at") - 1)).alias("place"))
    placed = placed.withColumn("shard", F.expr(f"int(place * {num_shards} div {max(rows, 1)})"))
    start = F.expr(f"(shard * bigint({rows}) + {num_shards - 1}) div {num_shards}")
    return unpacked(placed.withColumn("slot", F.col("place") - start), ["shard", "slot"])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shuffle_into_shards(table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op3_sharding": op3_sharding}
ORACLE_SQL: dict[str, str] = {}
