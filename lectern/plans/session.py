"""Session settings that the operators read."""

from __future__ import annotations

import atexit
import contextlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset in a local session, as in tests; unset on a cluster it is an error."""
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lectern-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


#: Tables of this application that are still in the shared folder.
_made: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.discard(path)


@atexit.register
def _clean() -> None:
    """At the end of the application its tables go, since what reads them ends with it."""
    spark = SparkSession.getActiveSession()
    for path in list(_made):
        with contextlib.suppress(Exception):
            _delete(spark, path)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def bucketed(df: DataFrame, key: str, name: str = "stage") -> DataFrame:
    """``written``, as a table bucketed by ``key``, so that joins and groups by the key need no exchange. ``df`` comes repartitioned by the key into ``tasks`` parts, else the buckets have many files."""
    spark = df.sparkSession
    own, n = f"{name}_{uuid.uuid4().hex}", tasks(spark)
    df.write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{own}").saveAsTable(own)
    out = spark.table(own)
    out.written_at = f"{shared_dir(spark)}/{own}"
    _made.add(out.written_at)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more, and let the driver forget the shuffles and broadcasts that made them."""
    for df in tables:
        _delete(df.sparkSession, df.written_at)
    if tables:
        forget(tables[0].sparkSession)


def forget(spark: SparkSession) -> None:
    """Let the driver forget shuffles and broadcasts that nothing needs any more, so that their files go."""
    # Spark's cleaner removes what the collector finds unreachable; a loop leaves much of it behind long before the heap is full.
    spark.sparkContext._jvm.System.gc()


_kept: dict[tuple, tuple] = {}


def kept(spark: SparkSession, name: tuple, make: Callable[[], tuple]) -> tuple:
    """What ``make`` gives - tables of ``written`` and ``bucketed`` among other things - made once in an application, and again if any of them is gone."""
    key = (spark.sparkContext.applicationId, *name)
    if key in _kept and all(_exists(spark, x.written_at) for x in _kept[key] if hasattr(x, "written_at")):
        return _kept[key]
    _kept[key] = make()
    return _kept[key]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def tasks(spark: SparkSession) -> int:
    """Reduce-side tasks to plan for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def put_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Write a file into the shared folder and return its path."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    return path.toString()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, wherever the driver has it from; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root, data = Path(__file__).resolve().parent.parent, io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(put_bytes(spark, data.getvalue(), f"package-{uuid.uuid4().hex}.zip"))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
