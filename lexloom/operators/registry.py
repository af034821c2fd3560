"""Document registry: reservations and status updates folded to the latest state of each document hash.

The log is (seq, op, document_hash, document_id, filename, ingestion_id, status, indexed_chunks, error), op `reserve` or
`update`. A reserve inserts a new hash as queued; it resets a failed one with its own ingestion; any other state makes it
a duplicate. An update counts only for the current ingestion and overwrites status, chunks and error, also with null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What uploads of known documents are told.
DUPLICATE = ("Dokumen sudah pernah diinput (status: ", ", file: ", ")")
ALL_DUPLICATES = "Semua dokumen sudah pernah diinput"

STATE = "document_hash string, document_id string, filename string, ingestion_id string, status string, indexed_chunks int, error string"
OUTCOME = f"seq long, op string, outcome string, {STATE}"


def _fold(rows: pd.DataFrame, state: dict | None) -> tuple[list[tuple[int, str, str]], dict | None]:
    """What each operation does and the state after them; the state machine is sequential, so columns are walked side by side."""
    out, last = [], -1
    columns = [rows[c].tolist() for c in ("seq", "op", "ingestion_id", "status")]
    ingestion, status = (state["ingestion_id"], state["status"]) if state else (None, None)
    began, exists = -1, state is not None
    for i, (seq, op, own, told) in enumerate(zip(*columns, strict=True)):
        if op == "reserve":
            if exists and status != "failed":
                outcome = "duplicate"
            else:
                outcome = "reset" if exists else "inserted"
                began, last, exists, ingestion, status = i, -1, True, own, "queued"
        elif not exists or ingestion != own:
            outcome = "rejected"
        else:
            outcome, last, status = "updated", i, told
        out.append((int(seq), op, outcome))
    # the row that began the present ingestion and the last update that counted make the state
    if began >= 0:
        x = rows.iloc[began]
        state = {"document_hash": x["document_hash"], "document_id": x["document_id"], "filename": x["filename"], "ingestion_id": x["ingestion_id"], "status": "queued", "indexed_chunks": None, "error": None}
    if last >= 0:
        x = rows.iloc[last]
        state = state | {"status": x["status"], "indexed_chunks": None if pd.isna(x["indexed_chunks"]) else int(x["indexed_chunks"]), "error": x["error"]}
    return out, state


def _in_order(log: DataFrame) -> DataFrame:
    """Each hash's operations in one partition, by seq; they are folded as they stream by, so no group is held whole."""
    return log.repartition("document_hash").sortWithinPartitions("document_hash", "seq")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, pd.DataFrame]]:
    for batch in batches:
        for key, rows in batch.groupby("document_hash", sort=False, dropna=False):
            yield (None if pd.isna(key) else key), rows


def _outcome_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A frame for each batch: one for each hash would cost more than the fold."""
    last, state = object(), None
    for batch in batches:
        done = []
        for key, rows in _runs(iter([batch])):
            out, state = _fold(rows, state if key == last else None)
            last = key
            done += [(*x, key) for x in out]
        yield pd.DataFrame(done, columns=["seq", "op", "outcome", "document_hash"])


def registry_outcomes(log: DataFrame) -> DataFrame:
    """What each operation did: inserted, reset, duplicate, updated, rejected. In order of seq within each hash."""
    return _in_order(log).mapInPandas(_outcome_frames, "seq long, op string, outcome string, document_hash string")


def _state_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in STATE.split(", ")]
    last, state = object(), None
    for batch in batches:
        done = []
        for key, rows in _runs(iter([batch])):
            if key != last and state:
                done.append(state)
            _, state = _fold(rows, state if key == last else None)
            last = key
        yield pd.DataFrame(done, columns=names, dtype=object)
    if state:
        yield pd.DataFrame([state], columns=names, dtype=object)


def registry_state(log: DataFrame) -> DataFrame:
    """Latest state of each hash by the rules above."""
    return _in_order(log).mapInPandas(_state_frames, STATE)


def latest_state(log: DataFrame) -> DataFrame:
    """Latest state where a log holds one ingestion per reservation that took effect: built-in functions only.

    The last reserve after which a hash was new or failed is found from the status before each reserve.
    """
    w = Window.partitionBy("document_hash").orderBy("seq")
    before = F.last(F.when(F.col("op") == "update", F.col("status")).otherwise("queued"), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("__starts", (F.col("op") == "reserve") & F.coalesce(before == "failed", F.lit(True)))
    rows = rows.withColumn("__run", F.sum(F.col("__starts").cast("int")).over(w)).where((F.col("op") == "update") | F.col("__starts"))
    last = F.max_by(F.struct("status", "indexed_chunks", "error"), "seq")
    first = F.min_by(F.struct("document_id", "filename", "ingestion_id"), "seq")
    runs = rows.withColumn("status", F.when(F.col("op") == "reserve", "queued").otherwise(F.col("status"))).groupBy("document_hash", "__run").agg(first.alias("a"), last.alias("b"))
    return runs.groupBy("document_hash").agg(F.max_by(F.struct("a", "b"), "__run").alias("x")).select("document_hash", "x.a.*", "x.b.*")


def duplicates(uploads: DataFrame, registry: DataFrame) -> DataFrame:
    """Uploads with duplicate (their hash is known in a state other than failed), existing_status and, for duplicates, error."""
    known = registry.where("status <> 'failed'").groupBy(F.col("document_hash").alias("__hash")).agg(F.min(F.struct("status", "filename")).alias("__known"))
    rows = uploads.join(known, F.col("document_hash") == F.col("__hash"), "left")
    error = F.concat(F.lit(DUPLICATE[0]), F.col("__known.status"), F.lit(DUPLICATE[1]), F.coalesce(F.col("__known.filename"), F.lit("")), F.lit(DUPLICATE[2]))
    return rows.withColumn("duplicate", F.col("__known").isNotNull()).withColumn("existing_status", F.col("__known.status")).withColumn("error", F.when(F.col("duplicate"), error)).drop("__known", "__hash")


def upload_report(checked: DataFrame) -> DataFrame:
    """One row per job: accepted, rejected and duplicate files, the status code and, of a job of duplicates only, what is said.

    All duplicates: 409, with the file's own error if it is the only one; nothing accepted otherwise: 422; else 202.
    """
    failed = F.coalesce("failed", F.lit(False))
    rows = checked.groupBy("job_id").agg(F.count_if(~failed & ~F.col("duplicate")).alias("accepted"), F.count_if(failed).alias("rejected"), F.count_if(F.col("duplicate")).alias("duplicates"), F.every(F.col("duplicate")).alias("__all"), F.count(F.lit(1)).alias("__n"), F.min("error").alias("__error"))
    code = F.when(F.col("__all"), 409).when(F.col("accepted") == 0, 422).otherwise(202)
    said = F.when(F.col("__all"), F.when(F.col("__n") == 1, F.col("__error")).otherwise(ALL_DUPLICATES))
    return rows.select("job_id", "accepted", "rejected", "duplicates", code.alias("status_code"), said.alias("detail"))


def repeated(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, n, examples): keys that several rows have, and the three smallest ids of each. Groups are cut to three before they are gathered."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(id_col))).where("__n <= 3")
    examples = first.groupBy(key).agg(F.array_sort(F.collect_list(id_col)).alias("examples"))
    return counts.withColumnRenamed(key, "__key").join(examples, F.col("__key").eqNullSafe(F.col(key))).select(key, "n", "examples")


def check_chunks(chunks: DataFrame) -> DataFrame:
    """Blank ids, blank texts, repeated ids and the first three of these, for the checks before indexing."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    by_id = chunks.where(~blank(F.col("chunk_id"))).groupBy("chunk_id").count().where("count > 1")
    examples = by_id.orderBy("chunk_id").limit(3).agg(F.array_sort(F.collect_list("chunk_id")).alias("examples"))
    repeated = by_id.agg(F.count(F.lit(1)).alias("repeated_ids")).join(examples)
    return chunks.agg(F.count_if(blank(F.col("chunk_id"))).alias("blank_ids"), F.count_if(blank(F.col("text"))).alias("blank_texts")).join(repeated)


def index_batches(chunks: DataFrame, size: int = 8, by: str = "doc_id", order: str = "chunk_id") -> DataFrame:
    """(by, batch, n, indexed): batches of `size` chunks in order, and how many are indexed after each."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    rows = chunks.withColumn("batch", F.floor(n / size)).groupBy(by, "batch").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("indexed", F.sum("n").over(Window.partitionBy(by).orderBy("batch")))


def fold_batches(batches: Iterator[pd.DataFrame], state: dict | None) -> dict | None:
    """The state after more batches of one hash, for stateful streams.

    They come in no promised order, so a hash's rows of a micro-batch are put in order as a whole before they are folded.
    """
    held = list(batches)
    return _fold(pd.concat(held).sort_values("seq"), state)[1] if held else state
