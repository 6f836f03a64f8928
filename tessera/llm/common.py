"""Helpers that the training-data operators share: reading tables, cutting lineage, prefix sums."""

from __future__ import annotations

import math
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of code points other than space and the ASCII controls tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, whose executors are the driver, may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Paths of the tables that written() has made, by the DataFrame that reads them.
_WRITTEN: WeakKeyDictionary = WeakKeyDictionary()


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Cut the lineage of df: write it as Parquet to the shared folder and read it back.

    The table goes when the application ends, or when a later one takes its place: `instead_of` names a table of
    written() that nothing reads any more once the new one stands, as in iterations.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, at = _hadoop(spark, path)
    system.deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    if instead_of is not None and (old := _WRITTEN.pop(instead_of, None)):
        system, at = _hadoop(spark, old)
        system.delete(at, True)
    return out


#: Bytes of rows that a task hands to Python at once; a longer row goes alone.
ARROW_BATCH, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session are bounded by bytes, unless it names a bound of its own.

    Else a batch is 10,000 rows or 64 MB, and a task holds it several times: as Arrow in the virtual machine and in the
    worker, as Python texts, and as what is made of them. Results do not depend on it.
    """
    if spark.conf.get(ARROW_BATCH, None) is None:
        spark.conf.set(ARROW_BATCH, str(ARROW_BYTES))


def sampled(df: DataFrame, by: Column, rows: int, total: int) -> DataFrame:
    """About `rows` of df's `total` rows, all where there are fewer, by a hash that does not depend on the layout.

    The share is cut before anything is gathered, so tasks send the driver what it asked for and no more; eleven
    standard deviations of room keep the number under `rows`.
    """
    if total <= rows:
        return df
    share = max(rows - 11 * math.sqrt(rows), rows / 2) / total
    return df.filter(F.pmod(by, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


#: A key is hot if it has more than this part of all rows; there are never more hot keys than this.
HOT_PARTS = 4096
#: Keys of up to this many rows are never hot, so that small tables need no broadcast.
HOT_LEAST = 1024


def spread_join(many: DataFrame, one: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """many joined to `one` (one row a key, with `count`, the rows that `many` has of the key): inner or left.

    Hot keys, those with more than a part in HOT_PARTS of the `total` rows and HOT_LEAST rows, are so few that their rows of `one` are
    broadcast; only the other rows of `many` are shuffled, so no task gets more than its share of one key. Without a hot
    key nothing is broadcast and the hot half of the plan goes, which spares the driver's memory.
    """
    limit = max(total // HOT_PARTS, HOT_LEAST)
    names = [c for c in one.columns if c != key]
    hot = one.filter(F.col(count) > limit).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    marked = many.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    settled = marked.filter("_hot IS NOT NULL").select(*many.columns, *[F.col(f"_hot_{c}").alias(c) for c in names])
    cold = marked.filter("_hot IS NULL").select(*many.columns).join(one.filter(F.col(count) <= limit), key, how)
    return settled.unionByName(cold.select(*many.columns, *names))


def split_keys(many: DataFrame, key: str, by: str, part: str, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """many with `part`, and (key, part) for every part of every key: keys of over `block` rows split by a hash of `by`.

    Joining the second table to one of a row a key copies that row for each part, so that no task of a join over
    (key, part) gets a crowd and nothing is broadcast. `many` is read several times, so it should be a table.
    """
    counts = written(many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("_n") / block).cast("int")
    left = spread_join(many, counts, key, "_n", total).withColumn(part, F.pmod(F.xxhash64(by), parts).cast("int")).drop("_n")
    return left, counts.select(key, F.explode(F.sequence(F.lit(0), parts - 1)).alias(part))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is a value, so the optimizer cannot copy it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def packed(df: DataFrame) -> DataFrame:
    """One struct column `record` with all of df's columns, so that no input name can clash with an added one."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"))


def unpacked(df: DataFrame, added: list[str]) -> DataFrame:
    """The reverse of packed(), with the columns `added`; they replace input columns of the same name."""
    kept = [f.name for f in df.schema["record"].dataType.fields if f.name.lower() not in {a.lower() for a in added}]
    return df.select(*[F.col("record").getField(c).alias(c) for c in kept], *added)


def running_offsets(counts: DataFrame, key: str, value: str, block: int = 1024) -> DataFrame:
    """For non-negative long keys: the sum of `value` over all smaller keys, as `offset`.

    Sums run in two levels, within blocks of keys and over the blocks, so one task sees the blocks only.
    """
    blocked = counts.withColumn("_block", F.floor(F.col(key) / block))
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_total"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.join(starts, "_block")
        .withColumn("offset", F.col("_start") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_block", "_start")
    )
