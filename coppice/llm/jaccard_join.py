"""N-gram Jaccard join by chosen paths.

Every text becomes its set of hashed k-word shingles. A run of the join is a tree: at a node, each set picks BRANCH
positions of its minwise sketch (a position's value is a token of the set drawn with randomness that all sets share)
and goes down to the child named by position and value. Two sets of similarity s stay together over one choice with
probability s, so a run finds a pair with probability f, the fixed point of f = 1 - (1 - s f)^BRANCH; runs are repeated
until the target recall. All runs choose among the same positions, so the recall is that of a pair at the threshold over
the number of positions in which its sketches happen to agree. Nodes small enough are compared by brute force: sketch
estimate first, then the exact Jaccard value of the full shingle sets. Larger nodes are split further, and at the depth
limit cut into blocks, so no pair that shares a node is skipped.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import BLOCK, LINKS, leaves_of, live_buckets, pairs_of, resolved, run_tasks, tasks_of, totals_of
from .common import join_hot, mix64, prepare, release, save, tidy

#: Positions of the sketch; 32 bits each.
WIDTH = 64
BRANCH = 2
#: Levels taken before nodes are first counted, and the last level that splits.
DEPTH, LAST_DEPTH = 3, 7
#: Shingles of a set that weigh as much as a member does anyway.
UNIT = 4096
#: Nodes over this weight are split further.
LIMIT = 4 * BLOCK
#: Sketch estimates this far below the threshold rule a pair out: five standard deviations of 64 positions at 0.8.
SLACK = 0.25

WORD = re.compile(r"\w+")


def runs_for(threshold: float, recall: float) -> int:
    """Runs needed so that a pair at the threshold is found with the given probability."""
    agree = np.arange(WIDTH + 1)
    share = np.array([math.comb(WIDTH, k) * threshold**k * (1 - threshold) ** (WIDTH - k) for k in agree])
    found = np.ones(WIDTH + 1)
    for _ in range(LAST_DEPTH):
        found = 1 - (1 - agree / WIDTH * found) ** BRANCH
    return next((r for r in range(1, 64) if share @ (1 - found) ** r <= 1 - recall), 64)


class Shingles:
    """Hashed k-word shingles of lower-cased texts. Fewer than k words: one shingle of all words; no word: none."""

    def __init__(self, k: int = 5):
        self.k, self.known = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = WORD.findall((text or "").lower()), self.known
        if len(known) > 1_000_000:
            known.clear()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            ids = [known[w] for w in words]
        ids = np.array(ids, dtype=np.uint64)
        if not len(ids):
            return ids
        k = min(self.k, len(ids))
        with np.errstate(over="ignore"):
            h = np.full(len(ids) - k + 1, k, np.uint64)
            for j in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - k + 1 + j]
        return np.unique(mix64(h))


_odd = mix64(np.arange(1, WIDTH + 1)) | np.uint64(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Minwise sketch: for each position the least of one hash function over the set."""
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), 4096):
            out = np.minimum(out, ((shingles[lo : lo + 4096, None] * _odd) >> np.uint64(32)).min(0).astype(np.uint32))
    return out


def children(nodes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """nodes (n, m), sketches (n, WIDTH) -> (n, m * BRANCH) child nodes."""
    rows, out = np.arange(len(nodes))[:, None], []
    with np.errstate(over="ignore"):
        start, step = mix64(nodes), mix64(nodes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        for j in range(BRANCH):
            at = (start + np.uint64(j) * step) % np.uint64(WIDTH)
            value = sketches[rows, at.astype(np.int64)].astype(np.uint64)
            out.append(mix64(mix64(nodes + at + np.uint64(1)) ^ (value + (at << np.uint64(32)))))
    return np.concatenate(out, axis=1)


def _sketches_of(batch: pa.RecordBatch, column: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint32).reshape(-1, WIDTH)


def _entries(nodes: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    own = [pa.array(np.repeat(batch.column(c).to_numpy(), nodes.shape[1])) for c in ("item", "weight")]
    return pa.record_batch([pa.array(nodes.ravel().view(np.int64)), *own], ["bucket", "item", "weight"])


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """(id, text, key) -> (id, key, sketch, weight); sketch and key are null for texts without a word."""

    def run(batches):
        shingles = Shingles(k)
        for b in batches:
            out, weight = [], []
            for s in map(shingles, b.column("text").to_pylist()):
                out.append(sketch(s).tobytes() if len(s) else None)
                weight.append(1 + len(s) // UNIT)
            yield pa.record_batch([b.column("id"), b.column("key"), pa.array(out, pa.binary()), pa.array(weight, pa.int32())], ["id", "key", "sketch", "weight"])

    rows = docs.mapInArrow(tidy(run), "id long, key string, sketch binary, weight int")
    return rows.withColumn("key", F.when(F.col("sketch").isNotNull(), F.col("key")))


def _first_level(runs: int):
    def run(batches):
        for b in batches:
            sketches = _sketches_of(b)
            nodes = np.tile(mix64(np.arange(1, runs + 1) * 7919), (b.num_rows, 1))
            for _ in range(DEPTH):
                nodes = children(nodes, sketches)
            yield _entries(nodes, b)

    return run


def _next_level(batches):
    for b in batches:
        yield _entries(children(b.column("bucket").to_numpy().view(np.uint64)[:, None], _sketches_of(b)), b)


def _candidates(key, t: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    ok = pairs_of(*key, t["blk"].to_numpy(), t["leaves"])
    a, b = np.nonzero(ok)
    if not len(a):
        return a, b
    s, keep = _sketches_of(t), []
    for lo in range(0, len(a), 50_000):
        keep.append((s[a[lo : lo + 50_000]] == s[b[lo : lo + 50_000]]).mean(1) >= least)
    keep = np.concatenate(keep)
    return a[keep], b[keep]


def _needed(least: float):
    def work(key, t):
        used = np.unique(np.concatenate(_candidates(key, t, least)))
        return pa.table({k: t[k].take(pa.array(used)) for k in ("bucket", "bi", "bj", "blk", "item")}).combine_chunks().to_batches()[0] if len(used) else None

    return work


def _verified(least: float, threshold: float):
    def work(key, t):
        a, b = _candidates(key, t, least)
        if not len(a):
            return None
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        mark, linked = np.zeros(len(values), bool), np.zeros(len(a), bool)
        for i in np.unique(a):
            own = flat[ends[i] : ends[i + 1]]
            mark[own] = True
            for at in np.array_split(np.flatnonzero(a == i), 1 + (a == i).sum() // 64):
                partners = b[at]
                hits = mark[np.concatenate([flat[ends[j] : ends[j + 1]] for j in partners])] if len(partners) else mark[:0]
                if len(partners):
                    common = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(sizes[partners])[:-1]]), dtype=np.int64)
                    linked[at] = common >= threshold * (sizes[i] + sizes[partners] - common) - 1e-9
            mark[own] = False
        if not linked.any():
            return None
        out = totals_of(t["item"].to_numpy(), t["size"].to_numpy(), a[linked], b[linked])
        return pa.record_batch([pa.array(x) for x in out], schema=LINKS)

    return work


def _sets(k: int):
    def run(batches):
        shingles = Shingles(k)
        for b in batches:
            out = pa.array([shingles(x).tobytes() for x in b.column("text").to_pylist()], pa.binary())
            yield pa.record_batch([b.column("item"), b.column("size"), b.column("sketch"), b.column("leaves"), out], ["item", "size", "sketch", "leaves", "shingles"])

    return run


#: Stands for no id where rows are matched by id.
NO_ID = -(1 << 63)
ENTRIES = "bucket long, item long, weight int"


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.9995, with_key: bool = False) -> DataFrame:
    """One row per input row: id, class_id, n_links, component_id, kept (and text_key, the text's md5, if with_key).

    class_id: least id among rows of equal text. n_links: other rows whose shingle sets have Jaccard >= threshold,
    equal texts included. component_id: least id reachable over links. kept: the row stays for its component; these are
    the rows of the component's least id (nulls last) and, of the texts that have this id, the one of least md5.
    Null and wordless texts link with nothing, not even with each other, and are kept. Rows that repeat an id and text
    count one by one for n_links, and are kept or not together. An id may stand for several texts: they are told
    apart. Rows without an id link like others; ids that no row gives stay null. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = F.md5(text.cast("binary"))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), whole.alias("key"))
    rows = save(sketched(docs, k), "jaccard-rows")
    # A class is one text, under a number of its own; the sketch of any of its rows is that of all.
    facts = [F.min("id").alias("least"), F.count("*").alias("size"), F.max("weight").alias("weight"), F.min("sketch").alias("sketch")]
    classes = rows.filter("key is not null").groupBy("key").agg(*facts)
    classes = save(classes.withColumn("item", F.monotonically_increasing_id()), "jaccard-classes")

    entries = classes.select("item", "weight", "sketch").mapInArrow(tidy(_first_level(runs_for(threshold, recall))), ENTRIES)
    leaves, spent = None, []
    for depth in range(DEPTH, LAST_DEPTH + 1):
        entries = save(entries.distinct() if depth > DEPTH else entries, "jaccard-entries")
        nodes = save(live_buckets(entries), "jaccard-nodes")
        live = save(entries.join(nodes, "bucket").select("bucket", "load", "item"), "jaccard-live")
        release(entries, nodes)
        spent.append(live)
        done = live if depth == LAST_DEPTH else live.filter(F.col("load") <= LIMIT)
        leaves = done if leaves is None else leaves.union(done)
        large = live.filter(F.col("load") > LIMIT)
        if depth == LAST_DEPTH or large.isEmpty():
            break
        entries = large.select("bucket", "item").join(classes.select("item", "weight", "sketch"), "item").mapInArrow(tidy(_next_level), ENTRIES)
    lists = save(leaves_of(leaves), "jaccard-leaves")
    known = classes.select("item", "key", "least", "size", "sketch").join(lists, "item")

    tasks = tasks_of(leaves).join(known.select("item", "sketch", "leaves"), "item")
    needed = save(run_tasks(tasks, _needed(threshold - SLACK), "bucket long, bi int, bj int, blk int, item long"), "jaccard-needed")
    release(*spent)
    wanted = save(known.join(needed.select("item").distinct(), "item"), "jaccard-wanted")
    release(lists)
    # The text of one row of each class: of those of its least id.
    named = docs.withColumn("least", F.coalesce("id", F.lit(NO_ID))).select("key", "least", "text")
    texts = join_hot(named, wanted.withColumn("least", F.coalesce("least", F.lit(NO_ID))), ["key", "least"], "size", "inner").dropDuplicates(["item"])
    sets = texts.select("item", "size", "sketch", "leaves", "text").mapInArrow(tidy(_sets(k)), "item long, size long, sketch binary, leaves array<long>, shingles binary")
    sets = save(sets, "jaccard-sets")
    found = save(run_tasks(needed.join(sets, "item"), _verified(threshold - SLACK, threshold), "item long, links long, root long"), "jaccard-links")
    release(needed, wanted, sets)

    out = resolved(rows.select("id", "key"), classes.select("item", "key", "least", "size"), found, "jaccard")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("item").isNotNull(), F.col("least")).otherwise(F.col("id")).alias("class_id"),
        "n_links",
        "component_id",
        (F.col("item").isNull() | F.col("chosen") & F.col("id").eqNullSafe(F.col("least"))).alias("kept"),
        *([F.col("key").alias("text_key")] if with_key else []),
    )


#: The query over documents in DuckDB's SQL, by an inverted index over all shingles.
ORACLE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT text, min(doc_id) AS least, count(*) AS n, row_number() OVER (ORDER BY min(doc_id) NULLS LAST, md5(text)) AS item,
  regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM docs GROUP BY text),
sets AS (SELECT text, least, item, n, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
flat AS (SELECT item, n, len(s) AS size, unnest(s) AS v FROM sets),
pairs AS (SELECT a.item AS a, b.item AS b, any_value(a.n) AS na, any_value(b.n) AS nb FROM flat a JOIN flat b ON a.v = b.v AND a.item < b.item
  GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.size) + any_value(b.size) - count(*)) - 1e-9),
edges AS (SELECT a, b, nb AS n FROM pairs UNION ALL SELECT b, a, na FROM pairs),
links AS (SELECT a AS item, sum(n) AS links FROM edges GROUP BY 1),
reach AS (SELECT item AS a, item AS b FROM links UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comps AS (SELECT a AS item, min(b) AS first FROM reach GROUP BY 1)
SELECT d.doc_id, CASE WHEN len(s.s) = 0 THEN d.doc_id ELSE s.least END AS class_id,
  CASE WHEN len(s.s) = 0 THEN 0 ELSE coalesce(l.links, 0) + s.n - 1 END::BIGINT AS n_links,
  CASE WHEN len(s.s) = 0 THEN d.doc_id ELSE f.least END AS component_id,
  len(s.s) = 0 OR (s.item = f.item AND d.doc_id IS NOT DISTINCT FROM s.least) AS kept
FROM docs d JOIN sets s USING (text) LEFT JOIN links l ON l.item = s.item LEFT JOIN comps c ON c.item = s.item
JOIN sets f ON f.item = coalesce(c.first, s.item)
"""
