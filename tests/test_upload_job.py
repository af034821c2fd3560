"""An upload from files to points: verdicts, duplicates, failures, a second upload of what failed."""

from __future__ import annotations

from lexloom.jobs.upload import upload_job
from lexloom.operators.registry import ALL_DUPLICATES
from lexloom.sources.page_source import FormFeedFile
from lexloom.sources.registry_store import RegistryStore
from lexloom.sources.sinks import Collection

OPENER = f"{__name__}:open_file"


def open_file(path):
    if "broken" in path:
        raise OSError("no such format")
    return FormFeedFile(path)


def _embed():
    return lambda texts: [([1.0, 2.0], {1: 1.0}) for _ in texts]


def test_upload(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    law = "Pasal 1\n" + "isi pasal satu yang cukup panjang " * 20
    for name, text in {"a.pdf": law, "b copy.PDF": law, "c broken.pdf": "x", "d.txt": law, "e.pdf": f"{law}\fPasal 2\nisi pasal dua " + "kata " * 60}.items():
        (folder / name).write_text(text)
    store, points = RegistryStore(spark, f"{tmp_path}/registry"), Collection(spark, f"{tmp_path}/points", 2)
    take = lambda job: upload_job(spark, str(folder), OPENER, lambda: 1 / 0, _embed, store, points, job_id=job)
    first = take("job1")
    verdicts = {r["filename"]: (r["failed"], r["duplicate"], r["outcome"], r["error"]) for r in first.files.collect()}
    assert verdicts["a.pdf"] == (False, False, "inserted", None)
    assert verdicts["b copy.PDF"] == (False, True, "duplicate", "Dokumen sudah pernah diinput (status: queued, file: a.pdf)")
    assert verdicts["d.txt"] == (True, False, None, "not_a_pdf")
    assert first.report.select("accepted", "rejected", "duplicates", "status_code").first()[:] == (3, 1, 1, 202)
    ends = {r["filename"]: (r["status"], r["indexed_chunks"], r["error"]) for r in first.job.outcomes.collect()}
    assert ends == {"a.pdf": ("completed", 1, None), "c broken.pdf": ("failed", 0, "OSError: no such format"), "e.pdf": ("completed", 2, None)}
    assert {r["filename"]: r["status"] for r in store.read().collect()} == {"a.pdf": "completed", "c broken.pdf": "failed", "e.pdf": "completed"}
    assert points.read().count() == 3
    assert first.job.events.orderBy("seq").collect()[-1]["status"] == "completed"

    second = take("job2")  # only what failed is taken again
    assert {r["filename"]: r["outcome"] for r in second.files.collect()} == {"a.pdf": "duplicate", "b copy.PDF": "duplicate", "c broken.pdf": "reset", "d.txt": None, "e.pdf": "duplicate"}
    assert second.job.outcomes.count() == 1 and points.read().count() == 3

    (folder / "c broken.pdf").unlink()
    (folder / "d.txt").unlink()
    third = take("job3")
    assert third.job is None
    assert third.report.select("status_code", "detail").first()[:] == (409, ALL_DUPLICATES)
