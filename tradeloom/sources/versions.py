"""Tables replaced as a whole without a moment in which neither the old nor the new rows can be read.

Every write goes to a data folder of its own.  Only when it is whole, and has passed its checks, a commit file with
the next number is created, which names the folder; readers take the highest commit.  A job that fails leaves the last version in
place.  Creating a file that exists fails, so of two writers of one number the second stops.
"""

import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"
KEEP = 2  # versions that stay readable


class VersionConflict(RuntimeError):
    """Another writer committed this version first."""


def _system(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def _commits(spark: SparkSession, root: str) -> dict[int, str]:
    """Data folder of each committed version; a commit without a name was interrupted and does not count."""
    system, path = _system(spark, root)
    folder = path(f"{root}/{COMMITS}")
    if not system.exists(folder):
        return {}
    found = {}
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.isdigit() and status.getLen():
            stream = system.open(status.getPath())
            try:
                found[int(name)] = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
    return found


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions that can be read, oldest first."""
    return sorted(_commits(spark, root.rstrip("/")))


def _commit(spark: SparkSession, root: str, version: int, folder: str) -> None:
    system, path = _system(spark, root)
    target = path(f"{root}/{COMMITS}/{version:010d}")
    try:
        stream = system.create(target, False)
    except Py4JJavaError as error:
        if system.exists(target):
            raise VersionConflict(f"version {version} of {root} exists") from error
        raise
    stream.write(bytearray(folder.encode()))
    stream.close()


def replace(
    df: DataFrame, root: str, partition_by: Sequence[str] = (), metrics: Mapping[str, Column] | None = None,
    check: Callable[[dict], None] | None = None, keep: int = KEEP,
) -> dict:
    """Write ``df`` as the next version of the table at ``root`` and return what the writing job observed.

    ``rows`` is always counted; ``metrics`` adds aggregates.  They are taken by the job that writes, not by reading
    the table again.  ``check`` sees them before the commit and stops it by raising.  ``df`` may read the table it replaces.
    Of older versions ``keep - 1`` stay, so that running readers can finish.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    spark, root = df.sparkSession, root.rstrip("/")
    version = max(_commits(spark, root), default=0) + 1
    folder = f"data-{version:010d}-{uuid.uuid4().hex}"
    # above every shuffle of df, in the stage that writes
    observed = Observation()
    counted = df.observe(observed, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in (metrics or {}).items()))
    counted.write.partitionBy(*partition_by).parquet(f"{root}/{folder}")
    found = dict(observed.get)
    if check:
        check(found)
    _commit(spark, root, version, folder)
    _expire(spark, root, keep)
    return {"version": version, **found}


def _expire(spark: SparkSession, root: str, keep: int) -> None:
    """Delete commits but the last ``keep``, then data folders of versions that are not kept and came before the last."""
    system, path = _system(spark, root)
    commits = _commits(spark, root)
    kept = sorted(commits)[-keep:]
    for version in commits:
        if version not in kept:
            system.delete(path(f"{root}/{COMMITS}/{version:010d}"), False)
    live = {commits[v] for v in kept}
    for status in system.listStatus(path(root)):
        name = status.getPath().getName()
        if name.startswith("data-") and name not in live and int(name.split("-")[1]) <= kept[-1]:
            system.delete(status.getPath(), True)


def current_path(spark: SparkSession, root: str, version: int | None = None) -> str:
    """Folder of the last version, or of the given one."""
    root, commits = root.rstrip("/"), _commits(spark, root.rstrip("/"))
    if not commits or version is not None and version not in commits:
        raise FileNotFoundError(f"no version {'' if version is None else version} at {root}")
    return f"{root}/{commits[max(commits) if version is None else version]}"


def read(spark: SparkSession, root: str, version: int | None = None, schema=None) -> DataFrame:
    """The last version, or the given one while it is kept."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(current_path(spark, root, version))


def null_metrics(df: DataFrame) -> dict[str, Column]:
    """Metrics for :func:`replace`: ``nulls:<column>`` for every column."""
    return {f"nulls:{c}": F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns}


def null_report(spark: SparkSession, found: Mapping[str, int]) -> DataFrame:
    """What :func:`replace` returned with :func:`null_metrics`, as ``column_name``, ``non_null`` and ``nulls``."""
    names = [n for n in found if n.startswith("nulls:")]
    pairs = F.array(*(F.struct(F.lit(n.removeprefix("nulls:")).alias("column_name"), F.lit(found["rows"] - found[n]).cast("long").alias("non_null"),
                               F.lit(found[n]).cast("long").alias("nulls")) for n in names))
    return spark.range(1).select(F.inline(pairs))


def expect_rows(rows: int) -> Callable[[dict], None]:
    """Check for :func:`replace`: exactly so many rows."""
    def check(found: dict) -> None:
        if found["rows"] != rows:
            raise RuntimeError(f"{found['rows']} rows written, expected {rows}; the table stays as it was")
    return check
