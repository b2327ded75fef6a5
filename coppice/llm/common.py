"""Helpers that the corpus operators share: tables, shared storage, hashing and grouped Arrow iteration."""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get these functions by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Bounds of one Arrow batch, so that a worker's memory holds however long the texts are (a single row may exceed them).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
#: Keys of more than one in so many rows are hot; there are no more of them than this.
HOT = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive, by rows and bytes. Settings the session has made stay."""
    given = spark.conf.getAll
    for name, value in BATCH.items():
        if name not in given:
            spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only in local mode (tests) may it be unset: a new temporary
    folder then serves."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="coppice-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session ended before the interpreter
        pass


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it again. Removed by release(), or when
    Python exits."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_as = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of save() that nothing will read any more."""
    for t in tables:
        _drop(t.sparkSession, t.saved_as)


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, how: str = "left") -> DataFrame:
    """rows joined with facts, which has one row for each value of the keys and in `size` how many of rows have it.

    No task gets all rows of a hot key: keys that more than one in HOT of all rows have, at most HOT of them, are
    broadcast. Rows with a null among the keys meet nothing, and are kept where `how` is left.
    """
    top, total = facts.agg(F.max(size), F.sum(size)).first()
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rest = rows.filter(whole)
    least = max(1000, (total or 0) // HOT)
    out = None
    if (top or 0) > least:
        hot = F.broadcast(facts.filter(F.col(size) > least))
        out = rest.join(hot, keys)
        rest = rest.join(hot.select(keys), keys, "left_anti")
        facts = facts.filter(F.col(size) <= least)
    cold = rest.join(facts.hint("merge"), keys, how)
    out = cold if out is None else cold.unionByName(out)
    if how == "left":
        out = out.unionByName(rows.filter(~whole), allowMissingColumns=True)
    return out


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def sample_labels(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(id, label int) of at most `most` labelled ids, drawn by hash, the same in every run: small enough to broadcast.
    Null ids and labels are left out; an id with several labels has the largest."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    rows = rows.groupBy("id").agg(F.max("label").alias("label"))
    share = 1.05 * most / max(1, rows.count())
    draw = F.xxhash64("id", F.lit(23))
    if share < 1:
        rows = rows.filter(F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30)))
    return rows.orderBy(F.pmod(draw, F.lit(1 << 30)), "id").limit(most)


def kept_in_worker(key: str, make):
    """make(), or what it gave before in this Python worker under the same key. A worker keeps the last key's object
    only, so that models are unpacked, and what they remember is learned, once a worker instead of once a task."""
    held = sys.modules.setdefault("_coppice_worker", types.ModuleType("_coppice_worker"))
    if getattr(held, "key", None) != key:
        held.key = held.value = None  # let the old object go before the new one is made
        held.value, held.key = make(), key
    return held.value


def tidy(run):
    """run, a function for mapInArrow, whose worker gives the memory that it freed back to the machine at the end of each
    task. Workers outlive their stage; what Arrow and the C library keep for later counts beside the next stage's needs."""

    def work(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return work


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(batches, keys: list[str]):
    """From Arrow batches sorted by keys: (key tuple, pyarrow Table) for each group, across batch borders."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for lo, hi in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            key = tuple(c[lo] for c in columns)
            if key != last and kept:
                yield last, pa.Table.from_batches(kept)
                kept = []
            last = key
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield last, pa.Table.from_batches(kept)
