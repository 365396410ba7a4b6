"""Results written to the folder that driver and executors share; rows dealt to as many tasks as they need."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def durable(df: DataFrame) -> DataFrame:
    """Write df under spark.checkpoint.dir and return a scan: a cut lineage that outlives executors.

    Where the session names no folder and runs on one machine, a temporary one is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="knotwork-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/knotwork-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    driver_trimmed(spark)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


def driver_trimmed(spark: SparkSession) -> bool:
    """Give the native memory that the driver has freed, JVM and Python, back to the system; whether the JVM could.

    The allocator keeps what compilers and hundreds of short-lived threads of many small
    queries leave in each of its arenas, beside the heap and without a bound of its own.
    A JVM without that command (before 17.0.9, or not on glibc) goes on as it is.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    # The server's own class is closed to callers; the interface's method is not.
    kinds = [jvm.java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    types, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, kind in enumerate(kinds):
        types[i] = kind
    with contextlib.suppress(Py4JError):
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", types)
        return "not available" not in invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args).lower()
    return False


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows in n partitions by the keys, where that is more than Spark would make."""
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
