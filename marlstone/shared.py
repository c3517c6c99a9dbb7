"""Session plumbing: the shared folder, cut lineage, and collections that are checked for size."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only where it is unset (local tests) a temporary one is made."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; sweep() deletes it."""
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: what follows doesn't depend on executors that may be lost, and nothing is computed twice."""
    spark = df.sparkSession
    path = temporary(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables of cut() that nothing reads any more, as loops leave them behind."""
    for df in tables:
        path = getattr(df, "_cut", None)
        if path:
            system, p = fs(df.sparkSession, path)
            system.delete(p, True)
            _written[:] = [w for w in _written if w[1] != path]


def fs(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and the path for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def sweep() -> None:
    """Deletes the tables that cut() wrote. Runs at exit, and may be called when all results are written."""
    while _written:
        spark, path = _written.pop()
        try:
            system, p = fs(spark, path)
            system.delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


atexit.register(sweep)


def small(df: DataFrame, most: int) -> list | None:
    """The rows of df if there are at most so many, else None: the caller then takes its distributed way."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; timestamps without zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: other columns of the input can't clash with those an operator makes."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*(F.col(f"`{c}`") for c in columns))


#: Rows up to which a lookup side of narrow rows is broadcast; beyond it the join is a shuffle join that AQE may split.
LOOKUP_ROWS = 100_000


def lookup(df: DataFrame, most: int = LOOKUP_ROWS) -> DataFrame:
    """df, written once, with a broadcast hint if it has at most so many rows: counting it reads the written table's footers, not what it came from."""
    df = df if hasattr(df, "_cut") else cut(df, "lookup")
    return F.broadcast(df) if df.count() <= most else df
