"""The training matrix: binned rows in Arrow blocks, and one-pass jobs over them.

A block holds some thousand rows of one partition: the bins as bytes, feature by feature, and the label, weight and
other columns as doubles. A job is one mapInArrow over the cached blocks; what tasks send on are partial sums whose
size depends on nodes, features and bins, never on rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.binner import Binner

#: Rows of a block.
BLOCK_ROWS = 65_536
#: Partial sums up to this size in all go to the driver directly; larger ones are added up in a shuffle first.
DIRECT_BYTES = 64 << 20


class Block:
    """One block of rows: bins (features, rows), named columns, ids, and raw scores (outputs, rows) so far."""

    def __init__(self, n: int, bins: np.ndarray, columns: dict[str, np.ndarray], ids: np.ndarray, raw: np.ndarray):
        self.n, self.bins, self.columns, self.ids, self.raw = n, bins, columns, ids, raw


class Matrix:
    """Cached blocks. columns: names of the double columns that each block has beside its bins."""

    def __init__(self, blocks: DataFrame, binner: Binner, columns: list[str], outputs: int):
        self.blocks, self.binner, self.columns, self.outputs = blocks, binner, columns, outputs
        self.partitions = None
        self.borrowed = False

    @classmethod
    def build(cls, df: DataFrame, binner: Binner, columns: dict[str, object], id_col: str | None = None, outputs: int = 1, base=0.0, offset: str | None = None) -> Matrix:
        """columns: name -> Column of a double. base: first raw score of each output; offset: a column added to it.
        id_col: identifies rows for seeded sampling; without it all columns of the row are hashed."""
        binner.check(df)
        p, names = len(binner.features), list(columns)
        key = F.xxhash64(F.col(f"`{id_col}`")) if id_col else F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if not df.schema[c].dataType.simpleString().startswith("map")))
        rows = df.select(*(F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(binner.features)), *(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())), key.alias("id"))
        bases = np.broadcast_to(np.asarray(base, np.float64), (outputs,)).copy()
        at = names.index(offset) if offset else None

        def run(batches):
            for batch in _regrouped(batches):
                bins = binner.bins([batch.column(i) for i in range(p)])
                extra = np.array([batch.column(p + i).to_numpy(zero_copy_only=False) for i in range(len(names))], np.float64).reshape(len(names), -1)
                raw = np.repeat(bases[:, None], batch.num_rows, 1) + (extra[at] if at is not None else 0.0)
                ids = batch.column(p + len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.record_batch([pa.array([batch.num_rows], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (bins, extra, ids, raw))], ["n", "bins", "extra", "ids", "raw"])

        return cls(_kept(rows.mapInArrow(run, SCHEMA)), binner, names, outputs)

    def _reader(self):
        p, names, k = len(self.binner.features), self.columns, self.outputs

        def read(batches):
            for b in batches:
                for n, bins, extra, ids, raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    columns = np.frombuffer(extra).reshape(len(names), n)
                    yield Block(n, np.frombuffer(bins, np.uint8).reshape(p, n), dict(zip(names, columns, strict=True)), np.frombuffer(ids, np.int64), np.frombuffer(raw).reshape(k, n))

        return read

    def sums(self, work, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
        """Add up, over all blocks, the arrays that work(block) yields as (name, array); shapes gives their shapes."""
        read = self._reader()

        def run(batches):
            totals = {}
            for block in read(batches):
                for name, x in work(block):
                    totals[name] = totals[name] + x if name in totals else np.array(x, np.float64)
            if totals:
                yield pa.record_batch([pa.array(list(totals)), pa.array([np.ascontiguousarray(x).tobytes() for x in totals.values()], pa.binary())], ["name", "data"])

        if self.partitions is None:
            self.partitions = self.blocks.rdd.getNumPartitions()
        parts = self.blocks.mapInArrow(run, "name string, data binary")
        if 8 * sum(int(np.prod(s)) for s in shapes.values()) * self.partitions > DIRECT_BYTES:
            parts = _added(parts)
        got = parts.toArrow()
        out = {name: np.zeros(shape) for name, shape in shapes.items()}
        for name, data in zip(got["name"].to_pylist(), got["data"].to_pylist(), strict=True):
            out[name] += np.frombuffer(data).reshape(shapes[name])
        return out

    def advanced(self, change) -> Matrix:
        """A matrix whose raw scores are change(block); the old blocks are let go."""
        read = self._reader()

        def run(batches):
            for b in batches:
                for i, block in enumerate(read([b])):
                    raw = np.ascontiguousarray(change(block), np.float64)
                    yield pa.record_batch([*(b.column(j).slice(i, 1) for j in range(4)), pa.array([raw.tobytes()], pa.binary())], ["n", "bins", "extra", "ids", "raw"])

        blocks = _kept(self.blocks.mapInArrow(run, SCHEMA))
        blocks.count()
        self.release()
        out = Matrix(blocks, self.binner, self.columns, self.outputs)
        out.partitions = self.partitions
        return out

    def lent(self) -> Matrix:
        """The same blocks for another model, which does not let them go."""
        out = Matrix(self.blocks, self.binner, self.columns, self.outputs)
        out.partitions, out.borrowed = self.partitions, True
        return out

    def release(self) -> None:
        if not self.borrowed:
            self.blocks.unpersist()


SCHEMA = "n int, bins binary, extra binary, ids binary, raw binary"


def _kept(df: DataFrame) -> DataFrame:
    """Cached; where a shared checkpoint folder is set the lineage is cut too, so that lost blocks are read again
    instead of being built anew from all earlier rounds."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint().persist(StorageLevel.MEMORY_AND_DISK)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _regrouped(batches):
    """Arrow batches of up to BLOCK_ROWS rows."""
    kept, n = [], 0
    for b in batches:
        kept.append(b)
        n += b.num_rows
        if n >= BLOCK_ROWS:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _added(parts: DataFrame) -> DataFrame:
    def run(batches):
        totals = {}
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data)
                totals[name] = totals[name] + x if name in totals else x
        if totals:
            yield pa.record_batch([pa.array(list(totals)), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["name", "data"])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "name").mapInArrow(run, "name string, data binary")


def node_histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """(nodes, features, 256, 3) sums of g, h and rows; rows with node -1 are left out."""
    used = node >= 0
    if not used.all():
        bins, g, h, node = bins[:, used], g[used], h[used], node[used]
    out = np.zeros((nodes, len(bins), 256, 3))
    if len(node):
        base = node.astype(np.int64) * 256
        for f in range(len(bins)):
            at = base + bins[f]
            for k, x in enumerate((g, h, None)):
                out[:, f, :, k] = np.bincount(at, x, nodes * 256).reshape(nodes, 256)
    return out
