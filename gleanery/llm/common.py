"""What the operators share: tables in the cluster's shared folder, and vectorised text hashing.

Python code here runs on executors in ``mapInArrow`` / ``applyInArrow`` only; the
native operators (secrets, exact duplicates, personal data) use just ``read``,
``work_dir``, ``materialize`` and ``text_or_empty``.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="gleanery-")
    atexit.register(shutil.rmtree, path, True)
    return path


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; one of our own only where that is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or _own_dir()


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike a local checkpoint this survives the loss of executors, and later
    stages can prune its columns. The files go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/gleanery-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim(spark: SparkSession) -> str | None:
    """Has the driver's JVM give freed native memory back to the system, and tells what it says of that. Spark starts a thread
    for each exchange, and glibc keeps what hundreds of them have freed, some 150 MB beside the heap. A JVM without this
    command is left as it is: None."""
    try:
        jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
        given = new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's class is not open to Py4J; the interface's method is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Exception:  # not there, or not allowed
        return None


def let_go(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished frames that nothing refers to any more, rather than whenever the driver collects its garbage."""
    for _ in range(2):  # what the first round frees in Python, the second frees in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    trim(spark)


def buckets(docs: DataFrame, each: int, column: str = "text") -> int:
    """How many buckets of about ``each`` bytes of text the table fills; at least the session's shuffle partitions."""
    size = docs.select(F.sum(F.octet_length(column).cast("long"))).collect()[0][0] or 0
    return max(partitions(docs.sparkSession), -(-size // each))


def batch_bytes(spark: SparkSession, size: int) -> None:
    """From now on Spark hands Python workers batches of about ``size`` bytes: rows alone (10,000 by default) do not bound them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """``batch_bytes`` for what runs within."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    batch_bytes(spark, size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that when a text is all ASCII, and runs much faster than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def free(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
