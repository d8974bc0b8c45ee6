"""Session and shared-folder helpers.

The library never picks a machine-local folder when the cluster names one:
``shared_dir`` reads ``spark.checkpoint.dir`` (or the context's checkpoint
folder) and only falls back to a fresh temporary folder when neither is set,
which is the local/test case.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# What every query relies on: UTC wall clock, and of a key that a JSON object
# repeats, the last value.
QUERY_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **QUERY_CONF,
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "logloom") -> SparkSession:
    """A local session for tests and the bench (UTC, AQE on, no UI)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "16g")
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings every query relies on, and let Python workers
    import the library from the folder the driver has it from."""
    for key, value in QUERY_CONF.items():
        spark.conf.set(key, value)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Uses ``spark.checkpoint.dir`` when the cluster sets it; otherwise the
    context's checkpoint folder; otherwise, with a local master only (tests), a
    new temporary folder, registered as the checkpoint folder so
    ``checkpoint()`` works. A cluster without a shared folder is an error: its
    executors could not read what others wrote.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="logloom-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new, unused folder under the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex[:12]}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (works for any scheme)."""
    fs, jpath = _fs(spark, path)
    return bool(fs.exists(jpath))


# Target bytes of input per task / output file when sizing partition counts.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024


# Target bytes of stored rows per task that sorts their words: the words of a row
# take some twenty times the bytes of the row in compressed columns.
INDEX_PARTITION_BYTES = 8 * 1024 * 1024


# Sizes at or above this are Spark's "no statistics" default, not a size.
UNKNOWN_SIZE = 1 << 62


def estimated_bytes(df) -> int | None:
    """Bytes a DataFrame reads: the sum of Catalyst's size estimates of the
    plan's leaves (for file scans, the sizes already listed; no extra
    file-system calls). The leaves are used rather than the root because a
    join's estimate without statistics is the product of its inputs. ``None``
    when some leaf has no statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # Leaves without statistics report Spark's "unknown" default (Long.MaxValue).
    return None if any(x >= UNKNOWN_SIZE for x in sizes) else sum(sizes)


def partitions_for(spark: SparkSession, df, floor: int | None = None,
                   target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partitions so that each holds about ``target_bytes`` of the input, and at
    least ``floor`` (default: the cluster's parallelism). An input of unknown
    size keeps the number of partitions it arrives in, if that is larger."""
    if floor is None:
        floor = spark.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    wanted = df.rdd.getNumPartitions() if size is None else -(-size // target_bytes)
    return max(1, floor, wanted)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (none when it is missing), for any file system."""
    fs, jpath = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, jpath = _fs(spark, path)
    fs.create(jpath, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of this library's own tables."""
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, jsource = _fs(spark, source)
    _, jtarget = _fs(spark, target)
    fs.mkdirs(jtarget.getParent())
    if not fs.rename(jsource, jtarget):
        raise OSError(f"cannot rename {source} to {target}")


def list_times(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of last change in ms) of what is in a folder."""
    fs, jpath = _fs(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, whole."""
    fs, jpath = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Create a small file, complete from the moment it can be seen; ``False``
    if there is one of that name already. The rename that publishes it refuses
    an existing target, on any file system that has an atomic rename."""
    jvm = spark.sparkContext._jvm
    fs, jpath = _fs(spark, path)
    if fs.exists(jpath):
        return False
    draft = jvm.org.apache.hadoop.fs.Path(jpath.getParent(), f".draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(data)
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jpath.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(context.makeQualified(draft), context.makeQualified(jpath), no_overwrite)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def size_stamp(spark: SparkSession, path: str) -> str:
    """Sizes and times of a file, or of the files in a folder, so that a changed
    table is noticed on any file system."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return path
    parts = sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(jpath))
    return f"{path}:{','.join(parts)}"
