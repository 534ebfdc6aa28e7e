"""What the operators share: cutting lineage in the cluster's shared folder, and reading columns safely.

Every operator picks the columns that it names and returns only columns of its own, so extra columns of the input, also such that
clash with the names of an output, are ignored.
"""

from __future__ import annotations

import ctypes
import gc
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these six.
WHITE = " \t\n\v\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or else the session's checkpoint folder, or one below the warehouse where neither is set:
    all three are folders that the whole cluster sees."""
    context = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir"):
        if not context.getCheckpointDir():
            context.setCheckpointDir(found)
        return found.rstrip("/")
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir().rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The same rows from the shared folder; losing executors doesn't lose them."""
    shared_dir(frame.sparkSession)
    out = frame.checkpoint()
    trim_driver(frame.sparkSession)
    return out


class Workspace:
    """Tables written to the shared folder under one name. They go when the JVM ends, or with drop()."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
        path, fs = self._fs()
        fs.deleteOnExit(path)
        trim_driver(spark)

    def _fs(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, frame: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        frame.write.option("compression", compression).parquet(f"{self.path}/{name}")
        trim_driver(self.spark)
        return self.load(name, frame)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        path, fs = self._fs(name)
        fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files and checkpoints of steps that nothing refers to any more, so that the next step has their disk.

    Spark does so when the driver's JVM happens to collect its garbage, which on a small heap may be much later.
    """
    for _ in range(2):  # Python lets go of its objects in the JVM first
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


#: Seconds between two calls of trim_driver() that do something, and when the last one did.
TRIM_EVERY, _trimmed = 2.0, -1e9


def trim_driver(spark: SparkSession) -> None:
    """Has the driver's JVM give the system what its allocator keeps of freed native memory.

    Each plan is compiled anew, on many threads, and each of these leaves its allocator's arena as large as it ever was: hundreds of MB
    outside the heap after some hundred plans, which no collection of garbage returns. A JVM without this command goes on without it.
    """
    global _trimmed
    if time.monotonic() - _trimmed < TRIM_EVERY:
        return
    _trimmed = time.monotonic()
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    # By the interface's method, as the server's own class isn't open to reflection.
    call = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    try:
        kinds, given = new_array(jvm.java.lang.Class, len(call)), new_array(jvm.java.lang.Object, len(call))
        for i, kind in enumerate(call):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = new_array(jvm.java.lang.Object, 1), new_array(jvm.java.lang.String, 1)
        given[2][0], given[3][0] = new_array(jvm.java.lang.String, 0), call[3]
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass


def return_memory() -> None:
    """In a Python worker: gives the system what the worker's allocators keep of freed memory. Workers go from operator to operator, and all
    that one ever held otherwise counts for those after it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(frame: DataFrame, name: str = "text") -> Column:
    """The column as text, null as empty."""
    return F.coalesce(frame[name].cast("string"), F.lit(""))


def maybe_among(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 22) -> DataFrame:
    """The rows whose key (a 64-bit hash) may be among those of `wanted`: all that are, and some others.

    A bitmap of 2**bits bits as a table of 2**(bits - 6) rows at most, whatever the size of `wanted`, so it can be broadcast. It saves
    shuffling most of the other rows until `wanted` has millions of keys; a join still has to follow.
    """
    place = F.pmod(F.col(key), F.lit(1 << bits))
    word, bit = F.shiftrightunsigned(place, 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = wanted.groupBy(word).agg(F.bit_or(bit).alias("__bits"))
    return rows.withColumn("__word", F.shiftrightunsigned(place, 6)).join(F.broadcast(bitmap), "__word").where(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")
