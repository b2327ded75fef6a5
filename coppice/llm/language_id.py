"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Texts become counts of hashed character n-grams, normalised to length one. One-versus-rest machines choose the family;
in a family, every pair of languages has its own machine and the language that wins most duels is predicted. All
machines are linear, so scoring a text takes one pass over its n-grams and one product with a weight table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, join_hot, prepare, release, save, tidy

#: Buckets of hashed n-grams, for n-grams of one to three characters.
SIZE, ORDERS = 1 << 12, (1, 2, 3)
#: Bound of the labelled sample: documents in all, dealt evenly to the languages. Each counts with its whole text.
SAMPLE = 2500
#: Families of closely related languages by ISO 639-1 code. Other languages are each their own family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "nb", "nn", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
    "cjk": ("ja", "ko", "zh"),
}
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.split("-")[0].lower() in members), lang)


def features(text: str) -> np.ndarray | None:
    """Normalised counts (SIZE floats) of a text's hashed n-grams; null if it is null or has no letter.

    Case is dropped; characters that are not letters count as one blank each run.
    """
    text = (text or "").lower()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(c)
    if not letter.any():
        return None
    c = np.where(letter, c, 32)
    c = np.concatenate([[32], c[(c != 32) | (np.roll(c, 1) != 32)], [32]]).astype(np.uint32)
    counts = np.zeros(SIZE)
    code = np.zeros(len(c), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            if len(c) < n:
                break
            code = code[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :] + np.uint32(n)
            if n in ORDERS:
                h = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77)
                counts += np.bincount(h >> np.uint32(20), minlength=SIZE)
    return counts / np.linalg.norm(counts)


_table = np.zeros(0, bool)


def _letters(c: np.ndarray) -> np.ndarray:
    global _table
    if not len(_table):
        _table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _table[c]


def train_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 20.0, epochs: int = 40, seed: int = 7) -> np.ndarray:
    """Linear support vector machine on the given rows of x, by dual coordinate descent; y is +1 or -1. Classes weigh
    the same in all. The last weight is the bias. x is read a row at a time and never copied."""
    n = len(rows)
    cap = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    a, w, bias = np.zeros(n), np.zeros(x.shape[1]), 0.0
    q = np.array([float(x[r] @ x[r]) + 1.0 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            row = x[rows[i]]
            g = y[i] * (row @ w + bias) - 1
            new = min(max(a[i] - g / q[i], 0.0), cap[i])
            if new != a[i]:
                w += ((new - a[i]) * y[i]) * row
                bias += (new - a[i]) * y[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


def train(x: np.ndarray, langs: list[str]) -> dict:
    """Weight table and layout of the machines, from feature rows and their languages."""
    langs = np.array(langs)
    names = sorted(set(langs))
    families = {f: [n for n in names if family_of(n) == f] for f in sorted({family_of(n) for n in names})}
    member = np.array([family_of(x) for x in langs])
    weights, kinds = [], []
    for f in families:
        if len(families) > 1:
            weights.append(train_svm(x, np.arange(len(x)), np.where(member == f, 1.0, -1.0)))
            kinds.append((f, None))
    for own in families.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                at = np.flatnonzero((langs == a) | (langs == b))
                weights.append(train_svm(x, at, np.where(langs[at] == a, 1.0, -1.0)))
                kinds.append((a, b))
    return {"families": families, "kinds": kinds, "weights": np.array(weights).reshape(len(weights), SIZE + 1)}


def predict(model: dict, x: np.ndarray | None) -> tuple[str, float]:
    """(language, score); without features or without anything learned: und and 0. Ties go to the first in order."""
    if x is None or not model["families"]:
        return UNKNOWN, 0.0
    margins = dict(zip(model["kinds"], (model["weights"][:, :-1] @ x + model["weights"][:, -1]).tolist(), strict=True))
    families = list(model["families"])
    family = max(families, key=lambda f: margins.get((f, None), 0.0))
    score = _sigmoid(margins[family, None]) if len(families) > 1 else 1.0
    own = model["families"][family]
    wins, least = dict.fromkeys(own, 0), dict.fromkeys(own, 1.0)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            m = margins[a, b]
            wins[a if m >= 0 else b] += 1
            for lang, side in ((a, m), (b, -m)):
                least[lang] = min(least[lang], _sigmoid(side))
    best = max(own, key=lambda n: (wins[n], least[n]))
    return best, min(score, least[best])


def _sigmoid(m: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(m, -20, 20))))


def sample(docs: DataFrame, text_col: str, lang_col: str, most: int = SAMPLE) -> tuple[np.ndarray, list[str]]:
    """Features and languages of at most `most` labelled texts, the same number at most of each language but one at least;
    the same ones in every run, in the same order. Of copies one takes part."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text", F.lit(11)))
    # Different texts are counted, as they are what is drawn: copies do not thin out a language.
    texts = save(rows.select("lang", "hash").distinct(), "language-texts")
    counts = save(texts.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    each = max(1, most // max(1, counts.count()))
    # A draw by hash leaves few of a frequent language; of these the least hashes are taken.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "hash"))
    draw = F.pmod(F.xxhash64("hash"), F.lit(1 << 40))
    near = join_hot(texts, counts, ["lang"], "n", "inner").withColumn("draw", draw).filter(F.col("draw") * F.col("n") < float(1 << 40) * (each + 6 * each**0.5 + 10))
    drawn = near.withColumn("place", place).filter(F.col("place") <= each).select("lang", "hash")

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("lang"), b.column("hash"), pa.array([None if v is None else v.astype(np.float32).tobytes() for v in x], pa.binary())], ["lang", "hash", "x"])

    chosen = rows.join(F.broadcast(drawn), ["lang", "hash"]).dropDuplicates(["lang", "hash"])  # at most `most` rows, or one a language
    got = chosen.select("lang", "hash", "text").mapInArrow(tidy(run), "lang string, hash long, x binary").filter("x is not null").toArrow()
    release(texts, counts)
    names, places = got["lang"].to_pylist(), got["hash"].to_pylist()
    x = np.zeros((len(names), SIZE), np.float32)
    for i, v in enumerate(got["x"]):
        x[i] = np.frombuffer(v.as_buffer(), np.float32)
    order = sorted(range(len(names)), key=lambda i: (names[i], places[i]))
    return x[order], [names[i] for i in order]


def identify_language(docs: DataFrame, model: dict, keep: list, text_col: str = "text") -> DataFrame:
    """The columns `keep` (expressions) of each row, with lang_pred and score in 0..1 (higher: surer).

    Null texts and those without a letter give und and 0. Any length is read whole. Rows that repeat an id or a text get
    a prediction each, equal ones for equal texts. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 32 kB a machine

    def run(batches):
        m = shared.value
        for b in batches:
            found = [predict(m, features(t)) for t in b.column("_text").to_pylist()]
            out = [b.column(n) for n in names] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.record_batch(out, [*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    prepare(docs.sparkSession)
    return train(*sample(docs, text_col, lang_col))


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 3) == 1
