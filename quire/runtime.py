"""Session helpers: tables, shipping the package to executors, parallelism, lineage cuts, checked broadcasts."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application.

    The archive is served by the driver; nothing is expected on the executors' machines.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    at = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"
    at.write_bytes(held.getvalue())
    sc.addPyFile(str(at))
    _SHIPPED.add(sc.applicationId)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Repartition an input that has fewer partitions than the application has cores.

    Large inputs come in many splits and pass through unshuffled; only a table stored in one or two
    row groups is dealt out, so that costly row-wise work isn't left to one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * per_core) if df.rdd.getNumPartitions() < cores else df


def _folder(spark: SparkSession) -> str:
    """Where written intermediate tables go: the shared folder that the session names in spark.checkpoint.dir.

    Only an application on a single machine may leave it unset; it then gets a temporary folder. Elsewhere
    such a folder would be lost with its machine, so its absence raises.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    named = held.get() if held.isDefined() else sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="quire-tables-"))
    return f"{named.rstrip('/')}/quire-{sc.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a compressed table to the shared folder and return that table, with no lineage before it.

    The files outlive any executor. release() deletes them once nothing reads them any more, clear() at the
    latest.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # the schema is given, so no file is opened for it and an empty table keeps it
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._quire_path = path
    return made


def release(*tables: DataFrame) -> None:
    """Delete tables made by cut(); nothing that is computed later may depend on them."""
    for d in tables:
        _delete(d.sparkSession, d._quire_path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of the application; results not yet computed may depend on them."""
    _delete(spark, _folder(spark))


def small(df: DataFrame, limit: int = 64 << 20, row_bytes: int = 64) -> DataFrame:
    """df with a broadcast hint if its counted rows, at row_bytes each, stay within limit; else as it is.

    df is counted, so it should be a table made by cut() or as cheap to read.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
