"""Write an intermediate result once and read it back.

A result that several passes need (statistics, then the rows they apply to) is stored
as Parquet below ``spark.checkpoint.dir``.  Lineage ends there, later passes read only
the columns they need, and a lost executor costs a re-read instead of a re-join.
"""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that removes the shuffle files of a query once it has ended; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_INNER: ContextVar[str] = ContextVar("folder of the innermost released() block", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; stops if the session names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return configured


def scratch_if_unset(spark: SparkSession) -> None:
    """For tests and trials in one process: name a temporary folder if the session names none.

    On any other master nothing is set, so that :func:`shared_dir` stops the job.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if context.master == "local" or context.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="tradeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir("file://" + folder)


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tradeloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """An unused path of this application in the shared folder."""
    return f"{_application_dir(spark)}{_INNER.get()}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Run ``df`` once, store it in the shared folder and return the stored table.

    What was shuffled on the way is removed, as the stored table takes its place.
    """
    spark = df.sparkSession
    path = new_path(spark)
    writer = df.write.option("compression", compression) if compression else df.write
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def compressed(df: DataFrame) -> DataFrame:
    """:func:`materialize` for large steps that are read once or twice: smaller files for some more time."""
    return materialize(df, "zstd")


def discard(*stored: DataFrame) -> None:
    """Delete what :func:`materialize` stored for these frames once a later result takes their place; frames built on them become invalid."""
    for df in stored:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Size of all files that a frame reads, from their listing; 0 if it reads none."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)) for file in df.inputFiles()]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


@contextmanager
def released(spark: SparkSession):
    """Delete on leaving what was materialised inside the block, also after an error.

    Frames of the block are lazy and read what was stored, so write or collect the result before the block ends.
    """
    token = _INNER.set(f"{_INNER.get()}/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        folder = _application_dir(spark) + _INNER.get()
        _INNER.reset(token)
        _delete(spark, folder)


def release(spark: SparkSession) -> None:
    """Delete everything this application materialised; frames built on it become invalid."""
    _delete(spark, _application_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
