"""The progress fold with state that ends: per job, files in a map, cleared some time after the job's last event.

Unlike `jobs.stream_progress`, whose state lives for ever, a job's state goes by a timer once it is over, rows of a job in a
micro-batch stream by in chunks however many they are, and the state can begin from a table of files as they stood. Needs
Spark's RocksDB state store, which `rocksdb` sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexloom.operators.events import KEPT, LAST

FOLDED = (
    "stage string, status string, message string, chunks int, indexed_chunks int, progress_current int, progress_total int, progress_percent double, progress_unit string, error string, "
    "native_pages int, ocr_pages int, total_pages int"
)
NAMES = [c.split()[0] for c in FOLDED.split(", ")]
OUTPUT = f"job_id string, filename string, {FOLDED}"
INITIAL = f"{OUTPUT}, seq long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for queries that are started within, and no micro-batches without events: a query with timers
    would run those for ever, also where it is to end when there is nothing new. Timers go off with the next events."""
    new = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _value(x, column: str):
    return None if pd.isna(x) else x if isinstance(x, str) else float(x) if column == "progress_percent" else int(x)


def deciding(rows: pd.DataFrame) -> pd.DataFrame:
    """Those of a file's rows that a fold of all of them rests on: the last one, and the last with each value that is kept."""
    rows = rows[rows["seq"].notna()]
    held = [rows["seq"], *(rows.loc[rows[c].notna(), "seq"] for c in KEPT)]
    return rows.loc[sorted({x.idxmax() for x in held if len(x)})]


class JobFold(StatefulProcessor):
    """State of a job: a map of its files, each with the values folded so far and the seq each came with, and the seq of its end."""

    def __init__(self, grace_ms: int) -> None:
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "filename string", ", ".join([FOLDED, *(f"{c}_seq long" for c in NAMES)]))
        self.end = handle.getValueState("end", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        touched, over = set(), False
        for chunk in rows:
            over |= bool(((chunk["type"] == "job_status") & chunk["status"].isin(["completed", "failed"])).any())
            own = chunk[(chunk["filename"] != "-") & (chunk["type"] != "job_status")]
            for name, part in own.groupby("filename", sort=False):
                state = list(self.files.getValue((name,))) if self.files.containsKey((name,)) else [None] * len(NAMES) + [-1] * len(NAMES)
                for x in deciding(part).itertuples():
                    for i, c in enumerate(NAMES):
                        v = _value(getattr(x, c), c)
                        if x.seq > state[len(NAMES) + i] and (c in LAST or v is not None):
                            state[i], state[len(NAMES) + i] = v, int(x.seq)
                self.files.updateValue((name,), tuple(state))
                touched.add(name)
        if over and not self.end.exists():
            self.end.update((1,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.grace_ms)
        for name in sorted(touched):
            yield pd.DataFrame([(key[0], name, *list(self.files.getValue((name,)))[: len(NAMES)])], columns=["job_id", "filename", *NAMES]).astype(object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.files.clear()
        self.end.clear()
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for x in initialState.itertuples():
            self.files.updateValue((x.filename,), tuple([*(_value(getattr(x, c), c) for c in NAMES), *([int(x.seq)] * len(NAMES))]))

    def close(self) -> None:
        pass


def stream_jobs(events: DataFrame, *, grace_ms: int = 60_000, initial: DataFrame | None = None) -> DataFrame:
    """fold_progress by (job_id, filename) as a stream (update mode): a row with the new state of each file that a batch touches.

    A job's state is cleared grace_ms after the micro-batch that has its end; an event that comes later begins anew.
    initial: files as they stood (INITIAL), seq that of the last event in them.
    """
    kinds = {"processor": JobFold(grace_ms), "schema": OUTPUT}
    grouped = events.groupBy("job_id")
    return grouped.transformWithStateInPandas(kinds["processor"], kinds["schema"], "Update", "ProcessingTime", initial.groupBy("job_id") if initial is not None else None)


def held(spark: SparkSession, checkpoint: str) -> int:
    """Files in the state of a stream that writes to this checkpoint."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "files").load()
    return rows.agg(F.count(F.lit(1))).first()[0]
