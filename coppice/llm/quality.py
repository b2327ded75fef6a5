"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed block by block with either dictionary. The difference of the two sizes, over the length of the text,
becomes a score by logistic calibration on labelled rows that the dictionaries did not see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import apply_logistic, fit_logistic
from .common import crc_mod, prepare, sample_labels

#: Bytes of a block, so that the dictionary counts all through a long text, and of a dictionary.
BLOCK, DICTIONARY = 1024, 112_640
LEVEL = 3
#: Bounds of the labelled sample: texts for each dictionary, whole ones, and their bytes in all; rows for the calibration.
SAMPLE, BYTES, CALIBRATION = 4000, 16 << 20, 20_000


def blocks_of(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or the samples themselves end to end where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes of a text under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.tools = []
        for raw in (good, bad):
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **options) if raw else zstandard.ZstdCompressor(level=LEVEL, **options))

    def difference(self, text: str | None) -> float:
        """By how many bytes for each one of the text the good dictionary compresses it better than the bad one."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return 0.0
        pieces = blocks_of(data)
        good, bad = (sum(len(t.compress(p)) for p in pieces) for t in self.tools)
        return (bad - good) / len(data)


def _scored(shared, names):
    def run(batches):
        good, bad, weights = shared.value
        sizes = Sizes(good, bad)
        for b in batches:
            x = np.array([sizes.difference(t) for t in b.column("_text").to_pylist()]).reshape(-1, 1)
            out = [b.column(n) for n in names]
            if weights is None:
                yield pa.record_batch([*out, pa.array(x[:, 0])], [*names, "difference"])
            else:
                yield pa.record_batch([*out, pa.array(apply_logistic(weights, x))], [*names, "score"])

    return run


def training_texts(texts: DataFrame, chosen: DataFrame) -> list[bytes]:
    """Whole texts of the chosen ids (one of each id), in the order of a hash, as long as they stay within BYTES together;
    a text that does not fit is passed over."""
    rows = texts.join(F.broadcast(chosen), "id").select("id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("id").agg(F.min(F.octet_length("text")).alias("n")).orderBy(F.xxhash64("id", F.lit(37)), "id").collect()
    taken, total = [], 0
    for r in sizes:
        if 0 < r["n"] and total + r["n"] <= BYTES:
            taken.append((r["id"], r["n"]))
            total += r["n"]
    if not taken:
        return []
    want = texts.sparkSession.createDataFrame(taken, "id long, n int")
    got = rows.join(F.broadcast(want), "id").filter(F.octet_length("text") == F.col("n")).groupBy("id").agg(F.min("text").alias("text")).toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    return [got["text"][int(i)].as_py().encode("utf-8", "surrogatepass") for i in order]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[bytes, bytes, dict]:
    """Dictionaries and calibration from bounded samples of labelled rows (id, label: 1 good, 0 bad); of an id that
    repeats one row takes part. With labels of one kind only, all scores are the smoothed share of good rows."""
    spark = docs.sparkSession
    prepare(spark)
    part = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(31)), F.lit(4))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    raw = []
    for kind in (1, 0):
        chosen = sample_labels(labels.filter((F.col(label_col) == kind) & (part > 0)), id_col, label_col, SAMPLE)
        raw.append(train_dictionary([p for t in training_texts(texts, chosen) for p in blocks_of(t)]))
    chosen = sample_labels(labels.filter(part == 0), id_col, label_col, CALIBRATION)
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", F.col("text").alias("_text"))
    found = rows.mapInArrow(_scored(spark.sparkContext.broadcast((*raw, None)), ["id", "label"]), "id long, label int, difference double")
    got = found.groupBy("id", "label").agg(F.max("difference").alias("difference")).toPandas().sort_values("id")
    return *raw, fit_logistic(got[["difference"]].to_numpy(), got["label"].to_numpy().astype(float))


def score_quality(docs: DataFrame, model: tuple[bytes, bytes, dict], keep: list, text_col: str = "text") -> DataFrame:
    """The columns `keep` (expressions) of each row, and score in 0..1 (higher: good text likelier).

    Null and empty texts get the score of no evidence. Texts are read whole. Rows that repeat an id or a text get a score
    each, equal ones for equal texts. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model), names), f"{fields}, score double")


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 4) == 2
