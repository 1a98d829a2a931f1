"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task of a shuffle, on average.
TASK_ROWS = 200_000
#: Rows on one key that are too many for the task that would get them.
HEAVY_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is configured and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark, "_treelens_shared", None)
        if folder is None:
            folder = spark._treelens_shared = tempfile.mkdtemp(prefix="treelens-")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, which discard() deletes."""
    path = f"{shared_dir(spark)}/treelens-{name}-{uuid.uuid4().hex}"
    spark.__dict__.setdefault("_treelens_folders", []).append(path)
    return path


@contextmanager
def released(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Written (with the writer's options) and read back: cuts the lineage, survives lost executors, leaves no shuffle files."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with released(spark):
        df.write.options(**options).parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._treelens_folder = path
    return saved


def drop(*saved: DataFrame) -> None:
    """Deletes what ``save`` returned, once nothing is to be read from it any more."""
    for df in saved:
        df.sparkSession._treelens_folders.remove(df._treelens_folder)
        delete(df.sparkSession, df._treelens_folder)


def tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows, whatever number the session has for its shuffles: what one of them holds does not grow with the input."""
    return max(1, min(spark.sparkContext.defaultParallelism, rows // 10_000), -(-rows // TASK_ROWS))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by keys to ``tasks(rows)`` tasks; as it is where the session's own number does."""
    wanted = tasks(df.sparkSession, rows)
    return df.repartition(wanted, *keys) if wanted > df.sparkSession.sparkContext.defaultParallelism else df


def matched(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``left`` joined (left or inner) with ``right``, which has each key once, in tasks as small as ``spread`` makes them.

    Keys that very many rows of ``left`` share would all go to one task: their
    rows stay where they are, and the few rows of ``right`` that they need (one
    for HEAVY_ROWS of ``left`` at most) are broadcast.  Both sides are read more
    than once.
    """
    spark = left.sparkSession
    weights = left.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.collect_list(F.when((F.col("n") > HEAVY_ROWS) & F.col(key).isNotNull(), F.col(key))).alias("heavy"))
    with released(spark):
        load = weights.first()
    rows = max(load.rows, right.count())
    light = left
    if load.heavy:
        heavy = F.broadcast(spark.createDataFrame([(k,) for k in load.heavy], left.select(key).schema))
        light = left.join(heavy, key, "left_anti")
        many = left.join(heavy, key, "left_semi").join(F.broadcast(right.join(heavy, key, "left_semi")), key, how)
    joined = spread(light, rows, key).join(spread(right, rows, key), key, how)
    return joined.unionByName(many) if load.heavy else joined


def discard(spark: SparkSession) -> int:
    """Deletes what this session has saved, once no DataFrame that reads it is needed any more; the number of folders."""
    folders, spark._treelens_folders = spark.__dict__.get("_treelens_folders", []), []
    for folder in folders:
        delete(spark, folder)
    return len(folders)


def _open(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """A file or a folder with all that is in it; what is not there is fine."""
    found, system = _open(spark, path)
    system.delete(found, True)


def bytes_below(spark: SparkSession, path: str) -> int:
    found, system = _open(spark, path)
    return system.getContentSummary(found).getLength() if system.exists(found) else 0


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    found, system = _open(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(found)) if system.exists(found) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; None if it is not there."""
    found, system = _open(spark, path)
    if not system.exists(found):
        return None
    stream = system.open(found)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Writes a small file whole or not at all; without ``replace`` False, and no change, if it is there already.

    It is written beside its place and renamed, which file systems with an
    atomic rename (HDFS, local disks, mounted ones) let one writer do.
    """
    target, system = _open(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    chosen = spark.sparkContext._gateway.new_array(options, int(replace))
    if replace:
        chosen[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(target), chosen)
    except Py4JJavaError as e:
        system.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True
