"""What the operators of this subpackage share: table access and the shared folder."""

from __future__ import annotations

import ctypes
import functools
import posixpath
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.tables import spread

#: ASCII white space between words, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"


#: Rows of a table that are broadcast at most, and the bytes of its files (several times as many in memory).
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
#: Parts into which each key is dealt where a table is too large for that.
SALTS = 16

#: Folders of sessions that name none, by application.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, read by Spark; a small one is dealt out over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column taken has it, whatever its case."""
    taken, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """The column of this very name, whatever signs it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole(text: Column | str) -> Column:
    """A text with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session (all of it in one process) takes a temporary folder; on a cluster that is an error.
    """
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lexloom-"))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with the scheme of its file system, as executors without Spark's settings need it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}"))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", *, bound: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined with a table that has each combination of `keys` once; null keys meet null ones.

    A table of at most `bound` rows and BROADCAST_BYTES is broadcast. A larger one is repeated SALTS times and dealt out by key and salt,
    where the salt of a row is its place in its partition: a key that a third of all rows have is split SALTS times.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    salt, *own = unused([*rows.columns, *table.columns], "__salt", *[f"__{k}" for k in [*keys, "salt"]])
    if size <= BROADCAST_BYTES and table.limit(bound + 1).count() <= bound:
        small, more = F.broadcast(table), []
    else:
        small, more = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [salt]
        rows = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    names = dict(zip([*keys, *more], own, strict=False))
    small = small.withColumnsRenamed(names)
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{v}`")) for k, v in names.items()]
    out = rows.join(small, functools.reduce(lambda a, b: a & b, same), how)
    return out.drop(*names.values(), *more)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with a `row` number of their own each, written to the shared folder so that the numbers stay."""
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), name)


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine; the worker stays, and other stages run beside it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table made by `stored` which nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = posixpath.dirname(scratch(spark, "x")).split(":", 1)[-1].lstrip("/")
    for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
        if f"/{base}/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
