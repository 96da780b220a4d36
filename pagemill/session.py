"""Session helpers: a test session, table loading, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Extra settings of a session that this library starts itself; a cluster's own session is left as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("pagemill")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g"} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable for the Python workers of all executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{p.relative_to(root)}"), p.read_bytes())
    spark.sparkContext.addPyFile(shared_file(spark, f"{root.name}.zip", data.getvalue()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` as the cluster names it. Only a local session, whose executors
    share the driver's disk, gets one of its own where that is unset; on a cluster the setting is needed."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_written: list[str] = []


def _remove(path: str) -> None:
    try:
        jvm = SparkContext._jvm  # the gateway outlives the session
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
    except Exception:  # the gateway may be gone already
        if path.startswith(("/", "file:")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def release(since: int = 0) -> None:
    """Delete the intermediate tables and files written since a mark; all at the end of the process."""
    while len(_written) > since:
        _remove(_written.pop())


atexit.register(release)


@contextmanager
def intermediate():
    """The tables that operators write inside the block are deleted at its end, when their results have been consumed."""
    mark = len(_written)
    try:
        yield
    finally:
        release(mark)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagemill-{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write bytes into the shared folder; returns the path. Executors open it there."""
    path = f"{shared_dir(spark)}/pagemill-{uuid.uuid4().hex[:12]}-{name}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(data)
    finally:
        out.close()
    _written.append(path)
    return path


def cores_hint(spark: SparkSession) -> int:
    """Tasks that can run at once, as far as the session tells."""
    return max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "8")) if spark.conf.get("spark.sql.shuffle.partitions", "8").isdigit() else 2)


def local_path(uri: str) -> str | None:
    """The path of a file: URI, or None where the file is not on a mounted file system."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") and os.path.exists(uri) else None
