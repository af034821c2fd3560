"""The document registry as a durable table: operations are applied in batches, each batch whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators.registry import STATE, registry_outcomes, registry_state
from lexloom.sources.tables import KeyedTable, stored

LOG = f"seq long, op string, {STATE}"


class RegistryStore:
    """Latest state of each document hash under a path. One writer at a time; readers see the state before or after a batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, KeyedTable(spark, path, "document_hash")

    def read(self) -> DataFrame:
        found = self.table.read()
        return self.spark.createDataFrame([], STATE) if found is None else found

    def get(self, document_hash: str) -> DataFrame:
        """The state of one document; no row if it is unknown. Only the bucket of its hash is read."""
        bucket = self.spark.range(1).select(self.table.bucket(F.lit(document_hash))).first()[0]
        found = self.table.read([bucket])
        found = self.spark.createDataFrame([], STATE) if found is None else found
        return found.where(F.col("document_hash") == document_hash)

    def tried(self, log: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What operations (seq from 0 up, op, document_hash, ...) in order of seq would do, and the states after them; nothing is changed."""
        names = [x.split()[0] for x in LOG.split(", ")]
        log = stored(log.select(*names), "operations")
        held = self.read().join(log.select("document_hash").distinct(), "document_hash", "left_semi")
        # what is there already comes as the operations that lead to it
        before = held.withColumn("op", F.lit("reserve")).withColumn("seq", F.lit(-2).cast("long")).unionByName(held.withColumn("op", F.lit("update")).withColumn("seq", F.lit(-1).cast("long")))
        whole = stored(before.select(*names).unionByName(log), "operations")
        return stored(registry_outcomes(whole).where("seq >= 0"), "outcomes"), registry_state(whole)

    def apply(self, log: DataFrame) -> DataFrame:
        """Applies operations and returns what each did. One writer; many writers go through `streaming.reserve`."""
        outcomes, state = self.tried(log)
        self.table.upsert(state)
        return outcomes

    def reserve(self, documents: DataFrame) -> DataFrame:
        """(document_hash, document_id, filename, ingestion_id) rows; returns them with outcome: inserted, reset or duplicate. Of equal hashes the least ingestion id is first."""
        order = F.row_number().over(Window.partitionBy("document_hash").orderBy("ingestion_id")).cast("long")
        log = documents.select("document_hash", "document_id", "filename", "ingestion_id", order.alias("seq"), F.lit("reserve").alias("op"), *[F.lit(None).cast(t).alias(c) for c, t in (("status", "string"), ("indexed_chunks", "int"), ("error", "string"))])
        return self.apply(log).join(log.select("document_hash", "seq", "ingestion_id"), ["document_hash", "seq"]).select("document_hash", "ingestion_id", "outcome")

    def update(self, log: DataFrame) -> DataFrame:
        """(document_hash, ingestion_id, step, status, indexed_chunks, error) rows, as the document job gives them; returns what each did."""
        rows = log.select("document_hash", "ingestion_id", F.col("step").cast("long").alias("seq"), F.lit("update").alias("op"), "status", F.col("indexed_chunks").cast("int").alias("indexed_chunks"), "error")
        return self.apply(rows.withColumn("document_id", F.lit(None).cast("string")).withColumn("filename", F.lit(None).cast("string")))
