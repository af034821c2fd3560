"""The log of questions: against SQL, reruns, awkward turns, and both command lines."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

from jobs import common, ingest_documents, queries, question_log
from tests.conftest import SMALL, same_rows

KIND = "conv_id long, turn long, role string, text string, question string"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_whole_table_twice(spark):
    same_rows(queries.job2_question_log(spark, SMALL), queries.ORACLES["job2_question_log"], SMALL)


def test_outcomes(spark, tmp_path):
    rows = [
        (1, 0, "user", " Apa isi  pasal 5 ayat (2)? "), (1, 1, "assistant", "<think>hm</think># **Begini** [1] dan [2], [1]"),
        (1, 2, "user", "Apa isi Pasal 5 AYAT 2?"), (2, 0, "user", "　\n"), (2, 1, "assistant", "ya"), (3, 0, "user", "x" * 2001), (3, 1, "user", None),
        (4, 0, "system", "s"), (4, 1, "user", "ﬁnal?"), (4, 2, "assistant", "<think>never closed"), (5, 0, "user", "Two"), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, None, "c"),
        (5, 0, "user", "Two"), (None, 0, "user", "no conversation"), (6, None, "user", "no turn"),
    ]
    spark.createDataFrame([(*r, "y") for r in rows], KIND).write.parquet(f"file://{tmp_path}/in")
    out = [sorted(map(str, question_log.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect())) for _ in range(2)]
    assert out[0] == out[1]
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert len(got) == 10
    by = {(r["conv_id"], r["turn"]): r for r in got}
    first = by[1, 0]
    assert (first["question"], first["outcome"], first["answer"], first["n_citations"]) == ("Apa isi Pasal 5 Ayat 2?", "answered", "Begini [1] dan [2], [1]", 2)
    assert first["search_text"].startswith("Apa isi Pasal 5 Ayat 2? ketentuan")
    assert (by[1, 2]["outcome"], by[1, 2]["times_asked"], by[1, 2]["first_conv"], by[1, 2]["first_turn"]) == ("unanswered", 2, 1, 0)
    assert {by[k]["outcome"] for k in ((2, 0), (3, 0), (3, 1))} == {"rejected"}
    assert by[2, 0]["times_asked"] is None and by[2, 0]["answer"] is None
    assert (by[4, 1]["question"], by[4, 1]["outcome"]) == ("final?", "unanswered")
    assert [(r["answer"], r["times_asked"]) for r in got if r["conv_id"] == 5] == [("a", 2)] * 2
    assert by[None, 0]["outcome"] == by[6, None]["outcome"] == "unanswered"


def test_no_turns(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"file://{tmp_path}/in")
    assert question_log.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").count() == 0


def test_config_files(spark, tmp_path):
    assert common.config(spark, f"file://{ROOT}/jobs/question_log.json", question_log.Config) == question_log.Config()
    assert common.config(spark, f"file://{ROOT}/jobs/ingest_documents.json", ingest_documents.Config) == ingest_documents.Config()
    (tmp_path / "c.json").write_text(json.dumps({"max_charz": 5}))
    with pytest.raises(ValueError, match="max_charz"):
        common.config(spark, f"file://{tmp_path}/c.json", ingest_documents.Config)


@pytest.mark.parametrize(("job", "table", "more"), [("question_log", "conversations", []), ("ingest_documents", "documents*", ["--checkpoint", "{}/checkpoint"])])
def test_command_lines(tmp_path, job, table, more):
    call = [sys.executable, "-m", f"jobs.{job}", "--source", f"{SMALL}/{table}.parquet", "--target", f"{tmp_path}/out", "--config", f"{ROOT}/jobs/{job}.json", "--shared", f"{tmp_path}/shared", *[m.format(tmp_path) for m in more]]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=600, env={**os.environ, "SPARK_LOCAL_IP": "127.0.0.1"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "wrote" in done.stderr
