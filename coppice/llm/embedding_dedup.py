"""Embedding near-duplicates by cross-polytope hashing.

A vector is padded to a power of two and turned by three rounds of random signs and a fast Hadamard transform; its
hash is the signed axis nearest to the result. A table joins the hashes of several such rotations into one bucket.
Multiprobe: besides its own bucket a vector enters, in each table, the next best ones, by swapping the axis that costs
least. Vectors that share a bucket are verified by their cosine in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import LINKS, leaves_of, live_buckets, pairs_of, resolved, run_tasks, tasks_of, totals_of
from .common import join_hot, mix64, prepare, release, save

#: Tables for up to four rotations each; as many again for each rotation more, which finds a pair more seldom.
TABLES = 10
PROBES = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, in log2(d) steps."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotations_for(count: int, dim: int) -> int:
    """Rotations joined in a table, so that a bucket seldom holds two of count unrelated vectors, probes included."""
    return max(1, math.ceil(math.log(8 * max(count, 1)) / math.log(2 * dim)))


def buckets(x: np.ndarray, joined: int, tables: int | None = None, probes: int = PROBES) -> np.ndarray:
    """Unit vectors (n, d) -> (n, tables * (1 + probes)) bucket numbers. Vectors of different length never meet."""
    tables = tables or TABLES * max(1, joined - 3)
    n, d = x.shape
    wide = np.zeros((n, 1 << max(0, (d - 1).bit_length())))
    wide[:, :d] = x
    rows, out = np.arange(n), []
    for t in range(tables):
        best, cost, second = [], [], []
        for j in range(joined):
            turned = wide
            for k in range(3):
                rng = np.random.default_rng([d, t, j, k])
                turned = hadamard(turned * rng.choice([-1.0, 1.0], wide.shape[1]))
            size = np.abs(turned)
            first = size.argmax(1)
            top = size[rows, first]
            best.append(2 * first + (turned[rows, first] < 0))
            for _ in range(probes):
                size[rows, size.argmax(1)] = -1
                axis = size.argmax(1)
                second.append((j, 2 * axis + (turned[rows, axis] < 0)))
                cost.append(top - size[rows, axis])
        order = np.argsort(np.stack(cost, 1), axis=1, kind="stable")[:, :probes]
        digits = np.stack(best, 1)
        which, value = np.array([j for j, _ in second]), np.stack([v for _, v in second], 1)
        for p in range(-1, order.shape[1]):
            own = digits.copy()
            if p >= 0:
                own[rows, which[order[:, p]]] = value[rows, order[:, p]]
            code = np.full(n, d * 1000 + t, np.uint64)
            for j in range(joined):
                code = mix64(code + own[:, j].astype(np.uint64) + np.uint64(1))
            out.append(code)
    return np.stack(out, 1)


def _by_length(column: pa.Array):
    """(rows, unit vectors) of a list column, for each length that its vectors have."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = flat[starts[at, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def _entries(batches):
    for b in batches:
        items, counts = b.column("item").to_numpy(), b.column("alike").to_numpy()
        for at, x in _by_length(b.column("vector")):
            codes = buckets(x, rotations_for(int(counts[at[0]]), x.shape[1]))
            for own in codes.T:
                yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(items[at]), pa.array(np.ones(len(at), np.int32))], ["bucket", "item", "weight"])


def _verified(threshold: float):
    def work(key, t):
        ok = pairs_of(*key, t["blk"].to_numpy(), t["leaves"])
        near = np.zeros_like(ok)
        for at, x in _by_length(t["vector"].combine_chunks()):
            near[np.ix_(at, at)] = x @ x.T >= threshold
        a, b = np.nonzero(ok & near)
        if not len(a):
            return None
        return pa.record_batch([pa.array(v) for v in totals_of(t["item"].to_numpy(), t["size"].to_numpy(), a, b)], schema=LINKS)

    return work


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (least id reachable), kept
    (id = component_id).

    Null, empty and all-zero vectors and those with null or non-finite components link with nothing. Equal vectors
    always link. Vectors of different length never link. An id may stand for several vectors: each links on its own.
    Rows without an id link like others; component_id is null, and such rows are kept, where no row reached has an id.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(vector_col).cast("array<double>")
    fit = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    key = F.when(fit, F.md5(F.array_join(F.transform(v, lambda x: (x + 0.0).cast("string")), ",").cast("binary")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fit, v).alias("vector"), key.alias("key"))
    rows = save(rows, "vector-rows")
    # A class is one vector, under a number of its own.
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    classes = save(classes.withColumn("item", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "vector-classes")

    lengths = save(classes.groupBy("length").agg(F.count("*").alias("alike")), "vector-lengths")
    sized = join_hot(classes.select("item", "length", "vector"), lengths, ["length"], "alike", "inner").select("item", "vector", "alike")
    entries = save(sized.mapInArrow(_entries, "bucket long, item long, weight int").distinct(), "vector-entries")
    filled = save(live_buckets(entries), "vector-buckets")
    live = save(entries.join(filled, "bucket").select("bucket", "load", "item"), "vector-live")
    release(entries, filled)
    tasks = tasks_of(live).join(classes.select("item", "size", "vector").join(leaves_of(live), "item"), "item")
    found = save(run_tasks(tasks, _verified(threshold), "item long, links long, root long"), "vector-links")
    release(live)

    out = resolved(rows.select("id", "key"), classes.select("item", "key", "least", "size"), found, "vector")
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The query over embeddings in DuckDB's SQL, by comparing all pairs.
ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rn, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
fit AS (SELECT rn, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
edges AS (SELECT a.rn AS a, b.rn AS b FROM fit a JOIN fit b ON a.rn <> b.rn AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT rn AS a, rn AS b FROM v UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comps AS (SELECT r.a AS rn, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.rn = r.b GROUP BY 1),
links AS (SELECT a AS rn, count(*) AS n_links FROM edges GROUP BY 1)
SELECT v.vec_id, coalesce(l.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v LEFT JOIN links l USING (rn) JOIN comps c USING (rn)
"""
