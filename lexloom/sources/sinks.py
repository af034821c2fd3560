"""JSON lines, vector collections with upsert, event feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import point_id
from lexloom.operators.events import encode_sse
from lexloom.operators.registry import check_chunks
from lexloom.operators.vectors import dense_top_k, sparse_top_k
from lexloom.sources.tables import KeyedTable, stored


def write_jsonl(chunks: DataFrame, path: str) -> None:
    """One JSON object per line; null fields stay."""
    chunks.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


#: Hits that are broadcast to the points at most when their payloads are looked up.
BROADCAST_HITS = 500_000


class Collection:
    """Points (chunks with a dense and a sparse vector) under a path, by point id; the size of the dense vectors is fixed."""

    def __init__(self, spark: SparkSession, path: str, dense_size: int) -> None:
        self.spark, self.table = spark, KeyedTable(spark, path, "point_id")
        there = self.table.get("collection.json")
        if there is None:
            self.table.put("collection.json", {"dense_size": dense_size})
        elif there["dense_size"] != dense_size:
            raise ValueError(f"the collection has vectors of {there['dense_size']} values, not {dense_size}")
        self.dense_size = dense_size

    def read(self) -> DataFrame | None:
        return self.table.read()

    def upsert(self, chunks: DataFrame, ingestion_id: str | None, model: str) -> int:
        """Chunks with dense and sparse vectors; the same chunk of the same ingestion is overwritten. Returns their number.

        ingestion_id: that of all chunks; None takes it from their column of this name.
        """
        rows = chunks.withColumn("ingestion_id", F.lit(ingestion_id)) if ingestion_id is not None else chunks
        named = F.when(F.trim(F.coalesce("chunk_id", F.lit(""))) != "", F.concat("ingestion_id", F.lit(":"), "chunk_id"))
        bad = check_chunks(rows if ingestion_id is not None else rows.withColumn("chunk_id", named)).first()
        if bad["blank_ids"] or bad["blank_texts"] or bad["repeated_ids"]:
            raise ValueError(f"{bad['blank_ids']} blank ids, {bad['blank_texts']} blank texts, repeated ids {bad['examples']}")
        if n := chunks.where(F.coalesce(F.size("dense"), F.lit(0)) != self.dense_size).count():
            raise ValueError(f"{n} vectors of another size than {self.dense_size}")
        rows = rows.withColumn("embedding_model", F.lit(model)).withColumn("point_id", point_id(F.col("ingestion_id"), F.col("chunk_id")))
        self.table.upsert(rows)
        return rows.count()

    def search(self, name: str, queries: DataFrame, limit: int, *, digits: int | None = None) -> DataFrame:
        """(query_id, id, score, rank, payload): the best points of each query by one of their vectors.

        name: `dense`, queries (query_id, dense), or `sparse`, queries (query_id, sparse map of index to weight). Without
        points, or a limit above zero, there are no hits.
        """
        points = self.read()
        if points is None or limit <= 0:
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, score double, rank long, payload string")
        if name == "dense":
            hits = dense_top_k(points.select(F.col("point_id").alias("id"), "dense"), queries, limit, digits)
        else:
            terms = lambda m: [F.transform(F.map_keys(m), lambda k: k.cast("string")).alias("terms"), F.transform(F.map_values(m), lambda v: v.cast("double")).alias("tfs")]
            own = points.where("sparse is not null").select(F.col("point_id").alias("id"), *terms(F.col("sparse")))
            hits = sparse_top_k(own, queries.where("sparse is not null").select("query_id", *terms(F.col("sparse"))), points.count(), limit, digits)
        hits = stored(hits, "hits")
        payload = points.select(F.col("point_id").alias("id"), F.struct(*[c for c in points.columns if c not in ("dense", "sparse")]).alias("payload"))
        small = F.broadcast(hits) if hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS else hits
        return payload.join(small, "id").select("query_id", "id", "score", "rank", "payload")

    def scroll_parents(self, parents: DataFrame, limit: int = 128) -> DataFrame:
        """The first `limit` points by id of each parent (filename, pasal); none for a limit of 0."""
        own = self.read()
        if own is None or limit <= 0:
            return (own or self.spark.createDataFrame([], "filename string, pasal string, point_id string")).where("false")
        w = Window.partitionBy("filename", "pasal").orderBy("point_id")
        return own.join(parents.select("filename", "pasal").distinct(), ["filename", "pasal"], "left_semi").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")

    def scroll_parent(self, filename: str, pasal: str, limit: int = 128) -> DataFrame:
        """Points of one parent, by id; both conditions reach the scan."""
        own = self.read()
        if own is None or limit <= 0:
            return self.scroll_parents(self.spark.createDataFrame([], "filename string, pasal string"), 0)
        return own.where((F.col("filename") == filename) & (F.col("pasal") == pasal)).orderBy("point_id").limit(limit)


def sse_feed(events: DataFrame) -> DataFrame:
    """(job_id, seq, sse): events as text of a server-sent stream."""
    payload = [c for c in events.columns if c != "seq"]
    return events.select("job_id", "seq", encode_sse(F.col("type"), F.to_json(F.struct(*payload))).alias("sse"))


def job_status(events: DataFrame, job_id: str) -> DataFrame:
    """All events of a job in order; an unknown job has none."""
    return events.where(F.col("job_id") == job_id).orderBy("seq")
