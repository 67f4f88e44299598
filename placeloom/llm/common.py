"""Shared helpers of the training-data operators: tables, shared folders, folds, text folding."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a scale-factor folder with Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(F.col(col) if isinstance(col, str) else col, _UPPER, _UPPER.lower())


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; null ids count as fold of the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in one process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        current = sc._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='placeloom-')}"
        sc.setCheckpointDir(root)
    return root.rstrip("/")


#: While a table is written: shuffle files go with the write, and Arrow batches are of bounded size.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

#: Hadoop's local file system starts a process for each folder and file that it makes, a copy of the whole JVM until
#: it has begun; files of checksums and of success would be two more a table and one more a file.  Other stores
#: don't look at the first two.
_PLAIN_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}

#: Written tables after which the driver's garbage is collected; its free native memory goes back after each.
RELEASE_EVERY = 4
_writes = itertools.count(1)


def materialize(df: DataFrame, name: str, batch: int | None = None, few: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The written table cuts the lineage and survives lost executors; the shuffle files of the
    finished write are released at once where Spark has a setting for it.  ``batch``: rows that
    are read and written at once, where rows are large.  ``few``: rows of many tasks are small and
    are gathered into as few files as their size asks for.  What plans leave behind on the driver
    is released on the way, since an operator of many tables would gather it.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/placeloom/{name}-{uuid.uuid4().hex}"
    before = {}
    small = {} if batch is None else {"spark.sql.parquet.columnarReaderBatchSize": str(batch), "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    for setting, value in (_SETTINGS | small).items():
        try:
            before[setting] = spark.conf.get(setting)
        except Exception:  # an older Spark doesn't know the setting
            continue
        spark.conf.set(setting, value)
    try:
        (df.hint("rebalance") if few else df).write.options(**_PLAIN_FILES).parquet(path)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if next(_writes) % RELEASE_EVERY:
        _trim_native(spark)
    else:
        release(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no plan reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._written_to)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Keys that are joined by broadcast as too frequent for one task, and the rows that make them so.
HOT_KEYS, HOT_ROWS = 100_000, 1000


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], rows: int, how: str = "left") -> DataFrame:
    """``big`` (of ``rows`` rows) joined with a written table that has one row for each key and, in ``m``, the number of its rows in ``big``.

    The rows of a frequent key stay where they are: such keys are broadcast, ``HOT_KEYS`` at most;
    all others meet by an exchange.
    """
    least = max(HOT_ROWS, rows // HOT_KEYS)
    hot, cold = (small.where(rule).drop("m") for rule in (F.col("m") > least, F.col("m") <= least))
    met = big.join(F.broadcast(hot), keys)
    return met.unionByName(big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner free broadcasts and shuffles that no plan holds any more.

    The cleaner learns of them from the driver's garbage collections alone, which are rare where
    the plans are small; until then the copies stay on the driver and on every executor.
    """
    trim()
    spark._jvm.System.gc()
    _trim_native(spark)


def release_executors(spark: SparkSession) -> None:
    """Collect the executors' garbage, so that their heaps shrink to what they hold.

    A heap that a stage of much garbage has grown otherwise stays that large for a long time.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def _trim_native(spark: SparkSession) -> str:
    """Give what the native allocator of the driver's JVM holds free back to the system, where the JVM has a command for it; its answer.

    Plans of many exchanges run in hundreds of threads, and what these free stays in their arenas.
    """
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *values):
        out = new_array(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    lang, named = jvm.java.lang, jvm.java.lang.Class.forName
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    try:
        # by its interface: the server's own class is closed to reflection
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *map(named, kinds)))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        asked = array(lang.Object, commands, "systemTrimNativeHeap", array(lang.Object), array(lang.String))
        return str(invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), asked))
    except Py4JError:  # a JVM without it
        return ""


def trim() -> None:
    """Give the memory that a task of a Python worker has freed back to the system; workers are used again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
