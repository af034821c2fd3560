"""Tables in the folder that driver and executors share, and tables of the latest row of each key."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


#: Bytes of files for each core up to which a table in few files is dealt out anew.
SMALL_PER_CORE = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than there are cores, dealt out over the cores; any other table as it is.

    A small file is one row group as a rule, which one task would read and work off alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_PER_CORE and len(df.inputFiles()) < cores else df


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session takes a temporary folder, and a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lexloom-"))
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a write of Spark's to this folder has come to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that it is made once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class KeyedTable:
    """The latest row of each key under a path, dealt into buckets by the key's hash.

    A write makes new versions of the buckets that it touches, then the manifest that names the versions in force: readers
    see the table before or after it, and a write that fails or runs again changes nothing else. What neither the new
    manifest nor the one before it names is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, *, buckets: int = 32) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def get(self, name: str) -> dict | None:
        """A small JSON file of the table."""
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, name: str, value: dict) -> None:
        stream = self._fs.create(self._at(f"_new-{name}"), True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        self._fs.delete(self._at(name), False)
        self._fs.rename(self._at(f"_new-{name}"), self._at(name))

    def version(self) -> int:
        """The number of the last write, 0 before the first."""
        if not self._fs.exists(self._at("")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(""))]
        return max([int(n[9:-5]) for n in names if n.startswith("manifest-")], default=0)

    def _manifest(self, version: int) -> dict:
        return self.get(f"manifest-{version}.json") or {"schema": None, "buckets": {}}

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None before the first write."""
        now = self._manifest(self.version())
        if now["schema"] is None:
            return None
        schema = StructType.fromJson(now["schema"])
        paths = [f"{self.path}/v{v}/bucket={b}" for b, v in now["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, key: Column) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, version: int | None = None) -> None:
        """rows (each key once) replace those of their keys. A version that has been written already is left as it is."""
        now = self.version()
        new = now + 1 if version is None else version
        if new <= now:
            return
        before = self._manifest(now)
        rows = stored(rows.withColumn("bucket", self.bucket(F.col(self.key))), "rows")
        touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())
        merged = rows
        if (old := self.read(touched)) is not None:
            kept = old.join(rows.select(self.key), self.key, "left_anti").withColumn("bucket", self.bucket(F.col(self.key)))
            merged = kept.unionByName(rows, allowMissingColumns=True)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{new}")
        schema = merged.drop("bucket").schema.jsonValue() if touched or before["schema"] is None else before["schema"]
        self.put(f"manifest-{new}.json", {"schema": schema, "buckets": before["buckets"] | {str(b): new for b in touched}})
        self._clean(now, new)

    def _clean(self, now: int, new: int) -> None:
        older = [v for v in range(now) if self._fs.exists(self._at(f"manifest-{v}.json"))]
        held = {(b, v) for n in (now, new) for b, v in self._manifest(n)["buckets"].items()}
        for n in older:
            for b, v in self._manifest(n)["buckets"].items():
                if (b, v) not in held:
                    self._fs.delete(self._at(f"v{v}/bucket={b}"), True)
            self._fs.delete(self._at(f"manifest-{n}.json"), False)
