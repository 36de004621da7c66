"""All pairs inside groups, up to connection: which members of a group hang together by a pairwise link.

Pairs are never emitted.  A task holds at most two blocks of a group and returns a spanning forest of the links it
finds.  A group of any size is dealt to blocks; each block also gets the group's smallest member, so that groups that
hang together through it are done in one linear pass.  Members not tied to it then meet every block, in chunks of a
block's size: no pair of the group goes unseen, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import released, whole_groups, write_table

#: Finds components of one group: payloads, sizes -> label of each row (the row number of its component's first row).
Labeler = Callable[[list[bytes], np.ndarray], np.ndarray]


def labels_of(mask: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    """Components of n rows, labelled by smallest row; ``mask(i)`` tells which rows link with row i.  Ends as soon as
    all rows hang together."""
    labels = np.arange(n)
    for i in range(n):
        if not labels.any():
            break
        joined = np.unique(labels[mask(i)])
        joined = np.unique(np.r_[joined, labels[i]])
        if len(joined) > 1:
            labels[np.isin(labels, joined)] = joined[0]
    return labels


def _run(labeler: Labeler):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["task"]):
            task, ids, center = pdf["task"].to_numpy(), pdf["id"].to_numpy(), pdf["center"].to_numpy()
            payload, size = pdf["payload"].tolist(), pdf["size"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
            roots, tied = ids.copy(), np.zeros(len(ids), bool)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                label = labeler(payload[lo:hi], size[lo:hi])
                roots[lo:hi] = ids[lo:hi][label]  # rows are sorted by id, so a label is the smallest id
                at = np.flatnonzero(ids[lo:hi] == center[lo:hi])
                if len(at):
                    tied[lo:hi] = label == label[at[0]]
            yield pd.DataFrame({"group": pdf["group"].to_numpy(), "id": ids, "root": roots, "tied": tied})

    return run


def closure(members: DataFrame, labeler: Labeler, block: int = 1024) -> DataFrame:
    """Links ``(a, b)`` that connect the members of each group as all its pairwise links do.

    ``members(group long, id long, payload binary, size long, n long, center long)`` is a written table; n is the
    group's number of rows and center its smallest id, both of two rows or more.
    """
    cols = ["group", "task", "id", "payload", "size", "center"]
    schema = "group long, id long, root long, tied boolean"

    def deal(df: DataFrame) -> DataFrame:
        return df.select(*cols).repartition("task").sortWithinPartitions("task", "id").mapInPandas(lambda batches: released(_run(labeler)(batches)), schema)

    small = deal(members.where(F.col("n") <= block).withColumn("task", F.col("group")))
    links = small.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    large = members.where(F.col("n") > block)
    if large.select("id").isEmpty():
        return links
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = large.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    centers = large.where("id = center").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).where(F.pmod(F.xxhash64("id"), blocks) != F.col("block"))
    first = write_table(deal(dealt.unionByName(centers).withColumn("task", F.xxhash64("group", "block"))), "blocks")
    links = links.union(first.where("id <> root").select("id", "root"))
    loose = first.where("not tied").select("group", "id").distinct()
    if loose.isEmpty():
        return links
    loose = dealt.join(loose, ["group", "id"])
    chunks = loose.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    loose = loose.join(chunks, "group").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int"))
    against = dealt.join(chunks, "group").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = loose.withColumn("own", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).where("block <> own")
    # a loose row is in its own block already
    both = against.select("group", "block", "chunk", "id", "payload", "size", "center").unionByName(spread.select("group", "block", "chunk", "id", "payload", "size", "center"))
    second = deal(both.withColumn("task", F.xxhash64("group", "block", "chunk")))
    return links.union(second.where("id <> root").select("id", "root"))
