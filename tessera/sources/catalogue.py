"""A catalogue of tables in a shared folder, loaded exactly once per batch.

A batch writes its rows of every table under its own number and then enters the number in a ledger; readers see the
batches of the ledger only. A batch that is killed before its entry leaves folders that nobody reads and that its
rerun overwrites; a batch that is replayed after its entry does nothing. So all tables change at one moment, with no
more than the file system's creation of one file.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import trimmed
from ..operators import ingest


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="tessera-")


class Catalogue:
    """Tables `outcomes`, `opportunities`, `providers` and `sources` in `folder`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self) -> list[int]:
        """Numbers of the batches in the ledger, one a batch ever loaded."""
        system, path = self._at("_ledger")
        return sorted(int(f.getPath().getName()) for f in system.listStatus(path)) if system.exists(path) else []

    def _enter(self, batch_id: int) -> None:
        system, path = self._at("_ledger", str(batch_id))
        system.create(path, False).close()  # fails if another run of the batch was first

    def table(self, name: str) -> DataFrame | None:
        """A table's committed rows with the batch that brought them; None before the first batch."""
        system = self._at()[0]
        paths = [f"{self.folder}/{name}/{b}" for b in self.committed()]
        found = [p for p in paths if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p))]
        return self.spark.read.parquet(*found) if found else None

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        """Writes a batch's rows of some tables; they are seen once the batch is entered."""
        for name, df in tables.items():
            df.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/{name}/{batch_id}")

    def providers(self) -> DataFrame | None:
        """Each provider as its first batch made it, with the first address and canonical id that any batch gave it."""
        rows = self.table("providers")
        if rows is None:
            return None
        order = F.struct("batch", "row_number")
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
        return rows.groupBy("provider_id").agg(F.min_by("name", order).alias("name"), first("website_url"), first("canonical_id"))

    def load(self, rows: DataFrame, batch_id: int, then=None) -> bool:
        """Loads submitted rows as one batch: validates, skips duplicates, inserts the rest published. False if it was loaded before.

        For foreachBatch of a stream, whose checkpoint numbers its batches and may replay the last one. rows has
        row_number and the columns of an import; `sources`, an array of structs with url, title and relevant_excerpt,
        gives each record its first and additional sources. `then` is called between the writes and the ledger's entry.
        """
        if batch_id in self.committed():
            return False
        known = self.table("opportunities")
        staged = ingest.outcomes(rows, rows.limit(0) if known is None else known)
        # Written once: the other tables of the batch derive from the outcomes that it holds.
        self.write(batch_id, {"outcomes": staged})
        made = self.spark.read.parquet(f"{self.folder}/outcomes/{batch_id}").filter("outcome = 'importable'")
        made = made.withColumns({"opportunity_id": F.sha2(F.to_json(ingest.duplicate_key(made)), 256), "provider_id": provider_id(made)})
        optional = lambda c: F.col(c) if c in made.columns else F.lit(None).cast("string")
        providers = made.select("provider_id", "row_number", trimmed(F.col("provider_name")).alias("name"), optional("provider_website_url").alias("website_url"), optional("provider_canonical_id").alias("canonical_id"))
        opportunities = made.drop("errors", "outcome", "sources", "batch").withColumn("status", F.lit("active"))
        tables = {"opportunities": opportunities, "providers": providers}
        if "sources" in made.columns:
            listed = made.select("opportunity_id", F.posexplode("sources").alias("place", "s"))
            tables["sources"] = listed.select("opportunity_id", "place", "s.*", F.lit("officially_verified").alias("verification_status"))
        self.write(batch_id, tables)
        if then is not None:
            then()
        self._enter(batch_id)
        return True

    def summary(self) -> DataFrame | None:
        """Rows by outcome over all batches."""
        rows = self.table("outcomes")
        return None if rows is None else rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def provider_id(df: DataFrame) -> Column:
    """A provider's identity: its canonical id, or its name without case where it has none."""
    name = F.concat(F.lit("name:"), F.lower(trimmed(F.col("provider_name"))))
    return F.sha2(F.coalesce(F.concat(F.lit("id:"), F.col("provider_canonical_id")), name) if "provider_canonical_id" in df.columns else name, 256)
