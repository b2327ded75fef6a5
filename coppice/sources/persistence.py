"""Model files: trees as a Parquet table, everything else as JSON beside it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.tree import ROW_SCHEMA, Tree

VERSION = 1


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def tree_table(spark: SparkSession, rounds: list[list[Tree]]) -> DataFrame:
    """(round, output, node, ...): one row a node. The size is that of the model, not of data."""
    rows = [(r, k, *row) for r, trees in enumerate(rounds) for k, t in enumerate(trees) for row in t.rows()]
    return spark.createDataFrame(rows, "round int, output int, " + ROW_SCHEMA)


def trees_of(table: DataFrame) -> list[list[Tree]]:
    found: dict[tuple[int, int], list] = {}
    for row in table.collect():
        found.setdefault((row[0], row[1]), []).append(tuple(row[2:]))
    rounds = 1 + max((r for r, _ in found), default=-1)
    return [[Tree.from_rows(found[r, k]) for k in sorted(k for q, k in found if q == r)] for r in range(rounds)]


def save_model(spark: SparkSession, path: str, meta: dict, rounds: list[list[Tree]], overwrite: bool = False) -> None:
    """Write a model to a folder any executor may reach; an existing one raises unless overwrite."""
    fs, p = _path(spark, path)
    if fs.exists(p):
        if not overwrite:
            raise FileExistsError(path)
        fs.delete(p, True)
    tree_table(spark, rounds).coalesce(1).write.parquet(f"{path}/trees")
    spark.createDataFrame([(json.dumps(meta | {"format": VERSION}),)], "meta string").coalesce(1).write.text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[dict, list[list[Tree]]]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("format", 0) > VERSION:
        raise ValueError(f"{path} has format {meta['format']}; this version reads up to {VERSION}")
    return meta, trees_of(spark.read.parquet(f"{path}/trees"))


def write_binned(df: DataFrame, binner, path: str, keep: list = ()) -> None:
    """A binned matrix as Parquet, with its bins' edges and categories beside it."""
    binner.transform(df, keep).write.parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(binner.to_dict(), default=str),)], "meta string").coalesce(1).write.text(f"{path}/binner")


def read_binned(spark: SparkSession, path: str):
    from .binner import Binner

    return spark.read.parquet(f"{path}/rows"), Binner.from_dict(json.loads(spark.read.text(f"{path}/binner").first()[0]))
