"""Identifiers: slugs, name-based UUIDs, chunk ids, percentages and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["chunk_id", "document_id", "format_size", "is_pdf", "log_message", "page_label", "percent", "point_id", "rrf_term", "status_rollup", "uuid5"]

#: Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def document_id(filename: Column) -> Column:
    """Lower-case slug of a file name's stem; `document` if nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    slug = F.btrim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("document"))


def chunk_id(document: Column, pasal: Column, ayat: Column, part: Column) -> Column:
    return F.concat(document, F.lit("-pasal"), pasal, F.lit("-"), F.when(F.coalesce(ayat, F.lit("")) != "", F.concat(F.lit("ayat"), ayat)).otherwise("noayat"), F.lit("-part"), part.cast("string"))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID (SHA-1, version 5) as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def point_id(ingestion: Column, chunk: Column) -> Column:
    """Key of a stored vector: the same chunk of the same ingestion always has the same one."""
    return uuid5(F.concat(ingestion, F.lit(":"), chunk))


def is_pdf(name: Column) -> Column:
    return F.coalesce(F.lower(name).like("%.pdf"), F.lit(False))


def rrf_term(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def page_label(first: Column, last: Column) -> Column:
    """`p` or `p-q`; a missing page reads None."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    last = F.coalesce(last, first)
    return F.when(first.eqNullSafe(last), text(first)).otherwise(F.concat(text(first), F.lit("-"), text(last)))


def percent(current: Column, total: Column) -> Column:
    """Whole percent, halves to even; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(current / total * 100, 0)).cast("long")


def format_size(size: Column) -> Column:
    """`n KB` (at least 1) below a mebibyte, else `n.n MB`."""
    return F.when(size < 1048576, F.concat(F.greatest(F.lit(1), F.floor(size / 1024 + 0.5)).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", size / 1048576), F.lit(" MB")))


def log_message(job: Column, filename: Column, stage: Column, status: Column, message: Column) -> Column:
    return F.concat(F.lit("Document status | job_id="), job, F.lit(" filename="), filename, F.lit(" stage="), stage, F.lit(" status="), status, F.lit(" message="), message)


def status_rollup(pending: Column, failed: Column, completed: Column) -> Column:
    """State of a list of files from its counts."""
    return F.when(pending > 0, "processing").when(failed > 0, "error").when(completed > 0, "success").otherwise("idle")
