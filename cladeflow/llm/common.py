"""Shared plumbing: stable intermediate tables, connected components, worker caches."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


@functools.lru_cache(maxsize=4)
def own_dir(application: str) -> str:
    """A folder for one machine (tests), removed at the end."""
    folder = tempfile.mkdtemp(prefix="cladeflow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as the session names it; on a cluster it must name one."""
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not named and not context.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    return (named or own_dir(context.applicationId)).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    shared = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles() if shared in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for what is run inside: whole texts and vectors of 10,000 rows weigh too much at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_kept: dict = {}


def per_worker(make, *args):
    """What a Python worker keeps from task to task: one object, memos and all, until another is asked for; it is let go
    before the other is made."""
    if (make, args) not in _kept:
        _kept.clear()
        tidy()
        _kept[make, args] = make(*args)
    return _kept[make, args]


def unused() -> None:
    """What the allocators of a Python worker hold unused goes back to the system; costs milliseconds."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy() -> None:
    """``unused``, with what waits for the garbage collector."""
    import gc

    gc.collect()
    unused()


def released(rows: Iterable) -> Iterator:
    """``rows``, and then what is unused goes back: workers live on from stage to stage, and what one stage needed would
    add up with the next one's."""
    yield from rows
    tidy()


class Generations(dict):
    """A bounded memo: two generations of at most ``limit`` entries, the older one dropped whole.

    ``make`` fills a missing key.  Lookup is a plain dict lookup, so ``map(memo.__getitem__, keys)`` runs in C.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


def whole_groups(batches: Iterable, key: list[str]) -> Iterator:
    """From key-sorted pandas batches, frames that each hold whole groups only (all but the last key seen)."""
    import pandas as pd

    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        last = pdf[key].iloc[-1]
        same = (pdf[key] == last).all(axis=1).to_numpy()
        cut = len(pdf) - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield pdf.iloc[:cut]
        held = pdf.iloc[cut:]
    if held is not None and len(held):
        yield held


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``, component being the smallest id.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each one aggregation for the smallest
    neighbour and one join back.  Neighbourhoods are never gathered, so a hub costs no memory; the join back is on
    plain keys, which adaptive execution can split.  Only ids in some edge are returned.  Nulls are ignored.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    pairs = write_table(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("low"))
        return e.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))

    total = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    state = total(pairs)
    for _ in range(rounds):
        if not state[0]:
            break
        last, pairs = pairs, write_table(small(large(pairs).distinct()).where("a <> b").distinct(), "stars")
        now = total(pairs)
        discard(last)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


#: Columns of this prefix are the library's own; inputs don't have them.
MAY, ID = "_cladeflow_may", "_cladeflow_id"


def may_hold(rows: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """``rows`` with a boolean ``MAY``: false only for rows whose ``column`` is in no row of ``ids`` (one column ``id``).

    A bitmap of hashed ids, of at most ``bits`` bits whatever the input, is broadcast; so wide rows that surely don't
    join need not be shuffled.  Where the bitmap fills up, ``MAY`` is true for more rows; results stay the same.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    own = {n: f"_cladeflow_{n}" for n in ("slot", "page", "bit", "byte", "key", "bitmap")}
    at = ids.where("id is not null").select(slot(F.col("id").cast("long")).alias("slot"))
    pages = at.groupBy(F.bitmap_bucket_number("slot").alias(own["key"])).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(own["bitmap"]))
    placed = rows.withColumn(own["slot"], slot(F.col(column).cast("long")))
    placed = placed.withColumn(own["page"], F.bitmap_bucket_number(own["slot"])).withColumn(own["bit"], F.bitmap_bit_position(own["slot"]))
    marked = placed.join(F.broadcast(pages), F.col(own["page"]) == F.col(own["key"]), "left")
    byte = F.conv(F.hex(F.substring(F.col(own["bitmap"]), (F.col(own["bit"]) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr(f"shiftright({own['byte']}, cast({own['bit']} % 8 as int)) & 1")
    tested = marked.withColumn(own["byte"], byte).withColumn(MAY, F.coalesce((bit == 1) & F.col(column).isNotNull(), F.lit(False)))
    return tested.drop(*own.values())


def only(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``ids`` (column ``id``, distinct); only likely rows are shuffled."""
    likely = may_hold(rows, column, ids).where(MAY).drop(MAY)
    return likely.join(ids.select(F.col("id").alias(ID)), likely[column].cast("long") == F.col(ID), "left_semi")


def without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is not among ``ids``; nulls stay.  Rows that surely stay are not shuffled."""
    marked = may_hold(rows, column, ids)
    likely = marked.where(MAY).drop(MAY)
    stay = likely.join(ids.select(F.col("id").alias(ID)), likely[column].cast("long") == F.col(ID), "left_anti")
    return marked.where(f"not {MAY}").drop(MAY).unionByName(stay)
