"""The document job: pages to chunks to vectors to points, with events and registry entries. One document's failure leaves the others alone."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import percent
from lexloom.operators.segment import chunk_documents
from lexloom.sources.models import Embed
from lexloom.sources.sinks import Collection
from lexloom.sources.tables import stored

# What the events of each stage say.
MESSAGES = {
    "upload": "File diterima dan menunggu proses",
    "parsing": "Membaca PDF dan menjalankan OCR bila diperlukan",
    "embedding": "Membuat dense + sparse embedding di DeepInfra",
    "indexing": "Menyimpan vector dan metadata ke Qdrant",
    "completed": "Dokumen selesai diproses",
    "failed": "Pemrosesan dokumen gagal",
}
NO_CHUNKS = "Parsing PDF tidak menghasilkan chunk; periksa format heading Pasal atau hasil OCR"
JOB_DONE, JOB_PARTLY, JOB_FAILED = "Pemrosesan upload selesai", "Pemrosesan upload selesai, beberapa dokumen gagal", "Semua dokumen gagal diproses"

logger = logging.getLogger(__name__)


@dataclass
class JobResult:
    """outcomes: a row per document; events in order of (job_id, seq); log: registry updates; chunks: what was indexed."""

    outcomes: DataFrame
    events: DataFrame
    log: DataFrame
    chunks: DataFrame


def embed_batches(chunks: DataFrame, connect: Callable[[], Embed], *, batch: int = 8, dense_size: int | None = None) -> DataFrame:
    """chunks (doc_id, n, text, ...) with dense, sparse, error: each document's chunks in order of n, `batch` at a time.

    When a batch fails, or has vectors of another size than dense_size, the document's chunks from there on carry the error
    and are not tried; other documents go on. Chunks stream by, so that no document is held whole.
    """
    if batch <= 0:
        raise ValueError("the batch size must be above zero")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", dense array<double>, sparse map<int,double>, error string"
    more = [pa.field("dense", pa.list_(pa.float64())), pa.field("sparse", pa.map_(pa.int32(), pa.float64())), pa.field("error", pa.string())]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, doc, error, rest = connect(), object(), None, None

        def answer(texts: list[str | None]) -> list[tuple]:
            """(dense, sparse) of a batch; where it fails, `error` says why and stays for the document."""
            nonlocal error
            if error is None:
                try:
                    texts = [(x or "").strip() for x in texts]
                    if not all(texts):
                        raise ValueError("an empty chunk cannot be embedded")
                    got = embed(texts)
                    if len(got) != len(texts):
                        raise ValueError(f"{len(got)} embeddings for {len(texts)} texts")
                    if odd := [len(d) for d, _ in got if dense_size is not None and len(d) != dense_size]:
                        raise ValueError(f"a vector of {odd[0]} values where the collection has {dense_size}")
                    return [(d, None if s is None else [(int(k), float(v)) for k, v in s.items() if v]) for d, s in got]
                except Exception as failed:  # noqa: BLE001  one document's failure must not end the others
                    error = str(failed) or type(failed).__name__
            return [(None, None)] * len(texts)

        def work(rows: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
            """The rows of the whole batches with their vectors; the rows that may go on in the next part, unless it is the last."""
            nonlocal doc, error
            docs, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
            out, errors, a = [], [], 0
            while a < len(docs):
                b = a + 1
                while b < len(docs) and b - a < batch and docs[b] == docs[a]:
                    b += 1
                if b == len(docs) and b - a < batch and not last:
                    break
                if docs[a] != doc:
                    doc, error = docs[a], None
                out += answer(texts[a:b])
                errors += [error] * (b - a)
                a = b
            own = rows.slice(0, a)
            values = [[d for d, _ in out], [s for _, s in out], errors]
            return pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, values, [f.type for f in more])], schema=pa.schema([*own.schema, *more])), rows.slice(a)

        # vectors go out with the rows of a part, not with each batch: a batch is a few rows, and a message of its own costs more
        for part in parts:
            done, rest = work(part if rest is None else pa.Table.from_batches([rest, part]).combine_chunks().to_batches()[0], False) if len(part) else (None, rest)
            if done is not None and len(done):
                yield done
        if rest is not None and len(rest):
            yield work(rest, True)[0]

    return chunks.repartition("doc_id").sortWithinPartitions("doc_id", "n").mapInArrow(run, kind)


def unfit_documents(chunks: DataFrame) -> DataFrame:
    """(doc_id, unfit): documents of which a chunk has a blank id, or one that another has, and what is wrong."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    twice = chunks.where(~blank(F.col("chunk_id"))).groupBy("doc_id", "chunk_id").count().where("count > 1").groupBy("doc_id").agg(F.concat(F.lit("repeated chunk id "), F.min("chunk_id")).alias("twice"))
    blanks = chunks.groupBy("doc_id").agg(F.max(blank(F.col("chunk_id"))).alias("no_id"))
    said = F.when(F.col("no_id"), "a chunk without an id").otherwise(F.col("twice"))
    return blanks.join(twice, "doc_id", "left").select("doc_id", said.alias("unfit")).where("unfit IS NOT NULL")


def index_chunks(chunks: DataFrame, connect: Callable[[], Embed], collection: Collection | None, *, model: str = "embedding", batch: int = 8) -> DataFrame:
    """Embeds and stores chunks (doc_id, n, ingestion_id, chunk_id, text, ...); returns them with batch, error and indexed.

    What a document's batches before a failing one hold is stored, what comes after is not. A document that is unfit is not
    embedded at all. No document's failure touches another.
    """
    checked = stored(chunks.join(unfit_documents(chunks), "doc_id", "left"), "checked")
    done = embed_batches(checked.where("unfit IS NULL").drop("unfit"), connect, batch=batch, dense_size=collection.dense_size if collection is not None else None)
    done = stored(done.unionByName(checked.where("unfit IS NOT NULL").withColumnRenamed("unfit", "error"), allowMissingColumns=True), "embedded")
    if collection is not None:
        good = done.where("error is null").drop("n", "error")
        if good.limit(1).count():
            collection.upsert(good, None, model)
    return done.withColumn("batch", F.floor(F.col("n") / batch)).withColumn("indexed", F.col("error").isNull()).drop("dense", "sparse")


def _event(step: int, sub: Column, stage: Column | str, status: str, message: Column, **more: Column) -> list[Column]:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    kinds = {"chunks": "long", "indexed_chunks": "long", "progress_current": "long", "progress_total": "long", "progress_percent": "long", "progress_unit": "string", "extraction_mode": "string", "native_pages": "long", "ocr_pages": "long", "total_pages": "long", "error": "string"}
    rest = [(more[k].cast(t) if k in more else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()]
    return ["job_id", "position", F.lit(step).alias("step"), sub.cast("long").alias("sub"), F.lit("document_status").alias("type"), "filename", text(stage).alias("stage"), F.lit(status).alias("status"), message.alias("message"), *rest]


def process_documents(documents: DataFrame, pages: DataFrame, connect: Callable[[], Embed], collection: Collection | None = None, *, model: str = "embedding", batch: int = 8, ended: Callable[[DataFrame], DataFrame] | None = None) -> JobResult:
    """Processes the accepted documents of jobs.

    documents (job_id, position, doc_id, filename, document_hash, ingestion_id); pages (doc_id, filename, page_number, text,
    mode, error), where a page with an error is that of a file which could not be read. A document without chunks has
    failed, as has one whose reading or indexing did; the others go on. A job has failed if all its documents have.
    ended: the jobs that are over by these outcomes, as `job_ends` gives them, where a job's documents come in several calls.
    """
    good = pages.where("error is null")
    chunks = chunk_documents(good.select("doc_id", "filename", "page_number", "text"), ordered=True)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "k")) - 1
    broken = pages.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("read_error"))
    own = documents.select("doc_id", "ingestion_id").join(broken, "doc_id", "left_anti")
    chunks = stored(chunks.drop("filename").withColumn("n", order).drop("section", "k").join(own, "doc_id").join(documents.select("doc_id", "filename"), "doc_id"), "chunks")
    indexed = stored(index_chunks(chunks, connect, collection, model=model, batch=batch), "indexed")

    modes = good.groupBy("doc_id").agg(F.count_if(F.col("mode") == "native_text").alias("native_pages"), F.count_if(F.col("mode") == "full_ocr").alias("ocr_pages"))
    counts = indexed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("indexed").alias("indexed_chunks"), F.min("error").alias("index_error"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = documents.join(modes, "doc_id", "left").join(counts, "doc_id", "left").join(broken, "doc_id", "left")
    error = F.coalesce("read_error", F.when(F.col("chunks").isNull(), NO_CHUNKS), "index_error")
    out = out.select("job_id", "position", "doc_id", "filename", "document_hash", "ingestion_id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), zero("chunks"), zero("indexed_chunks"), zero("native_pages"), zero("ocr_pages"), error.alias("error"), F.col("read_error").isNotNull().alias("unread"))
    out = stored(out, "outcomes")
    return JobResult(out.drop("unread"), job_events(out, good, indexed, (ended or job_ends)(out)), registry_log(out), chunks)


def job_ends(outcomes: DataFrame) -> DataFrame:
    """(job_id, all, good, position): documents of each job, those that are completed, the place after the last."""
    return outcomes.groupBy("job_id").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("status") == "completed").alias("good"), (F.max("position") + 1).alias("position"))


def job_events(outcomes: DataFrame, pages: DataFrame, indexed: DataFrame, ended: DataFrame) -> DataFrame:
    """All events of the jobs, numbered by seq within a job: each document's in its turn, then the one that ends the job."""
    say = lambda stage: F.lit(MESSAGES[stage])
    no = F.lit(0)
    total_pages = F.col("native_pages") + F.col("ocr_pages")
    w = Window.partitionBy("doc_id").orderBy("page_number")
    numbered = pages.select("doc_id", "mode", F.row_number().over(w).alias("current"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("total"), F.count_if(F.col("mode") == "native_text").over(w).alias("native"), F.count_if(F.col("mode") == "full_ocr").over(w).alias("ocr"))
    doing = F.when(F.col("mode") == "full_ocr", "Full OCR").otherwise("Membaca native text")
    page_text = F.concat(doing, F.lit(" · halaman "), F.col("current").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" · Native "), F.col("native").cast("string"), F.lit(" · OCR "), F.col("ocr").cast("string"))
    progress = lambda unit, current, total: {"progress_current": current, "progress_total": total, "progress_percent": percent(current, total), "progress_unit": F.lit(unit)}
    read = outcomes.where(~F.col("unread"))
    found = read.where("chunks > 0")
    found_text = F.concat(say("parsing"), F.lit(" · "), F.col("chunks").cast("string"), F.lit(" chunk ditemukan · Native "), F.col("native_pages").cast("string"), F.lit(" halaman · OCR "), F.col("ocr_pages").cast("string"), F.lit(" halaman"))
    pages_of = {"native_pages": F.col("native_pages"), "ocr_pages": F.col("ocr_pages"), "total_pages": total_pages}
    ends = indexed.where("indexed").groupBy("doc_id", "batch").agg((F.max("n") + 1).alias("current")).join(outcomes.select("doc_id", "job_id", "position", "filename", F.col("chunks").alias("total")), "doc_id")
    batch_text = lambda stage: F.concat(say(stage), F.lit(" · "), F.col("current").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" chunk"))
    parts = [
        outcomes.select(*_event(1, no, "parsing", "processing", say("parsing"))),
        numbered.join(read.select("doc_id", "job_id", "position", "filename"), "doc_id").select(*_event(2, F.col("current"), "parsing", "processing", page_text, **progress("halaman", F.col("current"), F.col("total")), extraction_mode=F.col("mode"), native_pages=F.col("native"), ocr_pages=F.col("ocr"), total_pages=F.col("total"))),
        found.select(*_event(3, no, "parsing", "processing", found_text, chunks=F.col("chunks"), **pages_of)),
        *[ends.select(*_event(4, 2 * F.col("batch") + k, stage, "processing", batch_text(stage), **progress("chunk", F.col("current"), F.col("total")))) for k, stage in enumerate(("embedding", "indexing"))],
        outcomes.where("status = 'completed'").select(*_event(5, no, "completed", "completed", F.concat(say("completed"), F.lit(" · "), F.col("indexed_chunks").cast("string"), F.lit(" chunk masuk ke Qdrant")), chunks=F.col("chunks"), indexed_chunks=F.col("indexed_chunks"), **pages_of)),
        outcomes.where("status = 'failed'").select(*_event(5, no, "failed", "failed", F.concat(say("failed"), F.lit(": "), F.col("error")), error=F.col("error"))),
    ]
    jobs = ended.withColumn("filename", F.lit("-"))
    said = F.when(F.col("good") == F.col("all"), JOB_DONE).when(F.col("good") > 0, JOB_PARTLY).otherwise(JOB_FAILED)
    last = jobs.select(*_event(6, no, "job", "completed", said), "good").withColumns({"type": F.lit("job_status"), "status": F.when(F.col("good") > 0, "completed").otherwise("failed")}).drop("good")
    rows = functools.reduce(DataFrame.unionByName, [*parts, last])
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy("position", "step", "sub")).cast("long")).drop("position", "step", "sub")


def registry_log(outcomes: DataFrame) -> DataFrame:
    """(document_hash, ingestion_id, step, status, indexed_chunks, error): the updates of each document, in order of step."""
    began = outcomes.select("document_hash", "ingestion_id", F.lit(1).alias("step"), F.lit("processing").alias("status"), F.lit(None).cast("long").alias("indexed_chunks"), F.lit(None).cast("string").alias("error"))
    ended = outcomes.select("document_hash", "ingestion_id", F.lit(2).alias("step"), "status", F.when(F.col("status") == "completed", F.col("indexed_chunks")).alias("indexed_chunks"), "error")
    return began.unionByName(ended)


def best_effort(what: str, write: Callable[[], object]) -> bool:
    """Runs a write that the job does not depend on, such as the registry's; an error is logged and the job goes on."""
    try:
        write()
    except Exception:  # noqa: BLE001
        logger.exception("%s failed", what)
        return False
    return True
