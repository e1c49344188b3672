"""Session helpers: a local session for tests, and the shared working folder of a job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: str | None = None
_made: list[str] = []


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session with the settings the library expects (UTC, Arrow, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("auditlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, else (local runs only) a temporary one.

    A session on several machines must set it; a machine-local folder would be invisible to other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="auditlake-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


def work_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh folder below the shared root. It is removed by :func:`release`, at the latest when the driver ends, unless ``keep``."""
    path = f"{shared_root(spark)}/auditlake/{name}-{uuid.uuid4().hex}"
    if not keep:
        if not _made:
            atexit.register(release, spark)
        _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the folders of :func:`work_dir` made so far; a session that lives long calls it when its results have been read."""
    while _made:
        remove(spark, _made.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system Spark knows; a session that is already gone is no error."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - at exit the gateway may be closed
        pass


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies directly below a folder; none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per session; operators that run Python on executors call it."""
    global _shipped
    if _shipped == spark.sparkContext.applicationId:
        return
    import auditlake

    here = Path(auditlake.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="auditlake-zip-")) / "auditlake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("auditlake") / p.relative_to(here))
    spark.sparkContext.addPyFile(str(target))
    _shipped = spark.sparkContext.applicationId


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows for costly per-row work, dealt out evenly whatever the splits of their files are: one exchange at every size.

    Into ``partitions``, or as many as adaptive execution finds right: ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` each, smaller
    ones (down to ``spark.sql.adaptive.coalescePartitions.minPartitionSize``) where there would be fewer than cores.
    """
    return df.repartition(partitions) if partitions else df.hint("rebalance")
