"""Saved tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a local master gets a folder of its own; on a cluster that raises ValueError, as executors would not share it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tempora-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_made: list[list[str]] = []  # paths handed out inside the scratch blocks that are open


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder and this application's id."""
    path = f"{shared_dir(spark)}/tempora-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _made:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Whatever is saved inside is deleted at the end, but for the tables passed to the function that this gives."""
    made: list[str] = []
    _made.append(made)
    try:
        yield lambda *tables: [made.remove(t.saved_at) for t in tables]
    finally:
        _made.remove(made)
        for path in made:
            _delete(spark, path)


RELEASE_SHARE = 1 / 30  # of the time, at most, that releasing memory may take
_release = {"due": 0.0}


def _trim(spark: SparkSession) -> None:
    """The driver's C allocator gives freed memory back, where its JVM has a command for that.

    By reflection, as the class of the server of beans isn't open to callers.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    call = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() in ("invoke", "getMBeanInfo")}

    def on_beans(method: str, *args):
        packed = gateway.new_array(jvm.java.lang.Object, len(args))
        for i, a in enumerate(args):
            packed[i] = a
        return call[method].invoke(beans, packed)

    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    trim = "systemTrimNativeHeap"  # fixed value: the command's name
    if any(x.getName() == trim for x in on_beans("getMBeanInfo", commands).getOperations()):
        on_beans("invoke", commands, trim, None, None)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage and give what is free back to the system.

    A job of many saved tables leaves plans, broadcasts and shuffles behind that
    Spark drops only when the driver collects garbage, and until then the driver
    grows to its largest heap. Does nothing before ``RELEASE_SHARE`` allows it.
    """
    if (began := time.monotonic()) < _release["due"]:
        return
    spark.sparkContext._jvm.System.gc()
    _trim(spark)
    ended = time.monotonic()
    _release["due"] = ended + (ended - began) / RELEASE_SHARE


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet into the shared folder and read again: cuts lineage, survives lost executors.

    The write's shuffle files go when it ends, as nothing reads them again, so
    steps of a job don't add up on the executors' disks. Nor does the driver's
    garbage: see :func:`release`.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables as returned by :func:`saved` that nothing will read again, so that the steps of a job don't add up in the shared folder."""
    for t in tables:
        _delete(t.sparkSession, t.saved_at)


def _delete(spark: SparkSession, where: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(conf).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete every table this application saved; results that still read them become unreadable."""
    _delete(spark, f"{shared_dir(spark)}/tempora-{spark.sparkContext.applicationId}")
