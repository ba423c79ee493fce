"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and local runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only where that setting is absent and the master is local (one machine), a
    temporary folder takes its place; on a cluster its absence is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"veilframe-{spark.sparkContext.applicationId}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back.

    Unlike checkpoint(), which computes its input twice, this runs the plan once; the
    table outlives any executor. The tables are deleted when the driver ends or by
    drop_written().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.parquet(path)


def written_path(df: DataFrame, name: str = "stage") -> str:
    """As written(), but gives the table's path, for readers other than Spark plans."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Have a folder of the shared directory deleted with the written tables."""
    _written.append((spark, path))


def drop_written() -> None:
    """Delete the tables of written(); results that still read them become invalid."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended already
            pass


atexit.register(drop_written)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, unless their PYTHONPATH has it already; once for each context."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_veilframe_shipped", False):
        return
    sc._veilframe_shipped = True
    folder_ = tempfile.mkdtemp(prefix="veilframe-code-")  # the driver's own; it is gone when the driver ends
    atexit.register(shutil.rmtree, folder_, ignore_errors=True)
    at = os.path.join(folder_, "veilframe.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in os.walk(os.path.join(home, "veilframe")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, home))
    sc.addPyFile(at)  # the driver serves it to the executors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
