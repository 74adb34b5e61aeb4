"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
from contextlib import suppress
from uuid import uuid4

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: what is set already, else `spark.checkpoint.dir`.

    Where neither is set, a local master gets a temporary folder; on a cluster that is an error, as executors would
    not see a folder of the driver's machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a table in the shared folder and read from there from then on.

    What was shuffled to compute it is not needed any more: on a cluster a collection on the driver lets Spark's cleaner
    drop it from the executors' disks at once, and what planning it took of the driver's memory is given back.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid4().hex}"
    df.write.parquet(folder)
    if not spark.sparkContext.master.startswith("local["):
        let_go(spark)
        spark._jvm.System.gc()
        give_back(spark)
    table = spark.read.schema(df.schema).parquet(folder)
    table.checkpoint_folder = folder
    return table


def let_go(spark: SparkSession) -> None:
    """Give Spark's listeners another event than the end of the last query.

    Each of their threads keeps the last event it took until the next one comes. The end of a query names its plan, and
    with it what was shuffled, which no collection would drop before the query after.
    """
    spark.sql("SET spark.app.id")
    with suppress(Py4JError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)


def discard(*tables: DataFrame) -> None:
    """Delete what `checkpointed` wrote for ``tables``, which nothing that is still to be computed may read.

    Tables that it did not write stay.
    """
    for table in tables:
        if (folder := getattr(table, "checkpoint_folder", None)) is not None:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession) -> str:
    """Give memory that the driver's Python and JVM have freed back to the system; returns what the JVM says of it.

    The C library keeps freed blocks between blocks in use, so without this a driver that has run some hundred
    queries holds far more than it uses. Where the C library or the JVM cannot do it, nothing happens.
    """
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    java = spark._jvm.java.lang
    try:
        commands = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # The server's own class is not open to Py4J, the interface is.
        methods = java.Class.forName("javax.management.MBeanServerConnection").getMethods()
        args = spark.sparkContext._gateway.new_array(java.Object, 4)
        args[0], args[1] = commands, "systemTrimNativeHeap"
        call = next(m for m in methods if m.getName() == "invoke")
        return str(call.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)).strip()
    except Py4JError:
        return ""
