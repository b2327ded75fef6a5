"""Links between items that share hash buckets, without ever listing all pairs of a group.

An item belongs to several buckets. A pair counts in exactly one of them: the smallest bucket that both share, so
each task can add up its own links and the sums over tasks count every pair once. Buckets over a size limit are cut
into blocks; every pair of blocks is a task of bounded size, so a hot bucket spreads over many tasks. Items have a
weight, by the memory they take, so that a block holds fewer of the large ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, join_hot, release, save, tidy

#: Weight of one block; a task holds two blocks at most.
BLOCK = 512
TASK = ["bucket", "bi", "bj"]
#: Buckets compared at once in pairs_of.
COLUMNS = 2048


def live_buckets(entries: DataFrame) -> DataFrame:
    """(bucket, item, weight) -> buckets of two or more members: (bucket, load), their weight."""
    return entries.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("weight").alias("load")).filter("members > 1").drop("members")


def leaves_of(live: DataFrame) -> DataFrame:
    """The buckets of each item, in order: (item, leaves). An item has a fixed number of buckets, so lists are bounded."""
    return live.groupBy("item").agg(F.array_sort(F.collect_set("bucket")).alias("leaves"))


def tasks_of(live: DataFrame) -> DataFrame:
    """(bucket, load, item) -> one row for each task that must see the item: (bucket, bi, bj, blk, item)."""
    blocks = F.ceil(F.col("load") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("item", "bucket"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return (
        live.select("bucket", "item", blocks.alias("blocks"), own.alias("blk"))
        .select("bucket", "item", "blk", other)
        .select("bucket", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "item")
    )


def pairs_of(bucket: int, bi: int, bj: int, blk: np.ndarray, leaves: pa.ChunkedArray) -> np.ndarray:
    """Of a task: matrix of the pairs (row before column) for which this bucket is the first that both share."""
    n = len(blk)
    ok = np.triu(np.ones((n, n), bool), 1) if bi == bj else (blk[:, None] == bi) & (blk[None, :] == bj)
    leaves = leaves.combine_chunks()
    flat = leaves.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), leaves.value_lengths().to_numpy(zero_copy_only=False))
    before = flat < bucket
    values, column, times = np.unique(flat[before], return_inverse=True, return_counts=True)
    # Only a bucket that two members share rules pairs out; the matrix is made some columns at a time.
    use, place = times[column] > 1, np.cumsum(times > 1) - 1
    column, owner = place[column[use]], owner[before][use]
    for lo in range(0, int((times > 1).sum()), COLUMNS):
        at = (column >= lo) & (column < lo + COLUMNS)
        seen = np.zeros((n, COLUMNS), np.float32)
        seen[owner[at], column[at] - lo] = 1
        ok &= (seen @ seen.T) == 0
    return ok


def totals_of(item: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """From links a-b (positions): items that have one, the weight of their partners, the least item reachable."""
    n = len(item)
    links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
    root = item.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            break
        root = new
    some = links > 0
    return item[some], links[some].astype(np.int64), root[some]


LINKS = pa.schema([("item", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def run_tasks(rows: DataFrame, work, schema: str) -> DataFrame:
    """Deal rows out by task and call work(key, table) -> RecordBatch or None for each. What comes back is little beside what
    the tasks read, so it is gathered into few parts before it is written."""

    def run(batches):
        for key, group in grouped(batches, TASK):
            if group.num_rows > 1 and (out := work(key, group)) is not None:
                yield out

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *TASK).sortWithinPartitions(*TASK).mapInArrow(tidy(run), schema).hint("rebalance")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(a, b) edges -> (item, component): least item reachable, by label propagation with pointer jumping.

    Only joins and minimum aggregates over rows in the shared folder: no component meets in one task or the driver.
    Items without an edge to another item get no row; an empty edge table gives an empty result.
    """
    edges = edges.filter("a <> b").select("a", "b")
    both = save(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    labels = save(labels.select("a", F.least("a", "m").alias("l"), "n"), f"{name}-labels")
    total = None
    while True:
        new = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if new == total:
            release(both)
            return labels.select(F.col("a").alias("item"), F.col("l").alias("component"))
        total = new
        # Items of many edges, and labels that many items have, go to all tasks.
        ends = labels.select(F.col("a").alias("b"), F.col("l").alias("lb"), "n")
        near = join_hot(both, ends, ["b"], "n", "inner").groupBy("a").agg(F.min("lb").alias("m"))
        step = save(labels.join(near, "a").select("a", F.least("l", "m").alias("l"), "n"), f"{name}-step")
        shares = step.groupBy("l").agg(F.count("*").alias("have"))
        up = step.select(F.col("a").alias("l"), F.col("l").alias("up")).join(shares, "l")
        fresh = save(join_hot(step, up, ["l"], "have").select("a", F.least("l", F.coalesce("up", "l")).alias("l"), "n"), f"{name}-labels")
        release(labels, step)
        labels = fresh


def resolved(rows: DataFrame, classes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """rows (id, key) with what links say of them: (id, key, item, least, n_links, component_id, chosen).

    classes: (item, key, least, size), one for each content, of a row number, the content's key, its least id (null if
    no row of it has one) and its rows. found: (item, links, root) of run_tasks(). A class is known by its number,
    never by an id, which may stand for several contents. component_id is the least id of the component, null if it
    has none. chosen: the class is its component's first by least id (nulls last), then key. Rows of null key, or of
    a key without a class, get null item and no link.
    """
    linked = components(found.select(F.col("item").alias("a"), F.col("root").alias("b")), name)
    links = found.groupBy("item").agg(F.sum("links").alias("links"))
    members = save(linked.join(classes.select("item", "key", "least"), "item"), f"{name}-members")
    firsts = members.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("first"), F.count("*").alias("n"))
    of = join_hot(members.select("item", "component"), save(firsts, f"{name}-firsts"), ["component"], "n").select("item", "first")
    totals = save(classes.join(links, "item", "left").join(of, "item", "left"), f"{name}-totals")
    out = join_hot(rows, totals, ["key"], "size")
    alone = F.col("first").isNull()
    return out.select(
        "id", "key", "item", "least",
        (F.coalesce("links", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.when(~alone, F.col("first.least")).when(F.col("item").isNotNull(), F.col("least")).otherwise(F.col("id")).alias("component_id"),
        (alone | (F.col("first.key") == F.col("key"))).alias("chosen"),
    )
