"""Loops of DataFrame steps: lineage is cut in the folder that the session names."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


@functools.lru_cache(maxsize=4)
def own_folder(application: str) -> str:
    """A folder for one machine (tests), removed at the end."""
    folder = tempfile.mkdtemp(prefix="cladeflow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; on a cluster it must name one."""
    context = spark.sparkContext
    named = context.getConf().get(KEY) or spark.conf.get(KEY, None)
    if not named and not context.master.startswith("local"):
        raise ValueError(f"{KEY} must name a folder that all executors share")
    return (named or own_folder(context.applicationId)).rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: a loop's rounds would add up until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if not spark.conf.isModifiable(key):  # Spark before 4.1
        yield
        return
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder: computed once, and there if an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` gave and nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/step-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], sign: Callable[[DataFrame], tuple], rounds: int = 60) -> DataFrame:
    """Repeat ``step`` until ``sign`` (a small summary) stays the same."""
    state = cut(state)
    before = sign(state)
    for _ in range(rounds):
        last, state = state, cut(step(state))
        now = sign(state)
        discard(last)
        if now == before:
            return state
        before = now
    raise RuntimeError(f"not stable after {rounds} rounds")
