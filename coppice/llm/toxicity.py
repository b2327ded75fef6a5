"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of the characters of its words. The highest order is counted per
class; the backoff below it is one model of continuation counts from the words of all documents, labelled or not, so a
rare expression gets nearly the same probability from both classes. An expression's evidence is the difference of its
toxic and ordinary log-likelihoods over its length. A document's score comes from such differences alone, of the whole
text and of its most toxic words, calibrated on labelled rows that the counts did not see.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calibration import apply_logistic, fit_logistic
from .common import crc_mod, kept_in_worker, mix64, prepare, sample_labels, save

#: Characters of the longest n-gram; absolute discount.
ORDER, DISCOUNT = 6, 0.75
#: Bound of the labelled rows the class models (four fifths) and the calibration (one fifth) are fitted on. The shared
#: backoff counts cover all documents.
SAMPLE = 100_000
#: Characters of the texts whose tokens are told apart at once (a longer text goes by itself).
CHUNK = 4 << 20
#: Characters of the different tokens that are scored at once (a longer token goes by itself).
SLICE = 1 << 19
#: Words longer than this are modelled by pieces of this length.
PIECE = 40
WORD = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"


def tokens_of(text: str | None) -> list[str]:
    """The text between blanks, lower-cased. A word never goes on over a blank, so a token's words are the text's."""
    return (text or "").lower().split()


def words_of(text: str | None) -> list[str]:
    return [w for t in tokens_of(text) for w in WORD.findall(t)]


def split_runs(texts: list[str | None]):
    """Runs of texts of about CHUNK characters, lower-cased, for Arrow to split at blanks. No letter is split at: whatever
    counts as a blank, the words are the same."""
    lo = size = 0
    for hi, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= CHUNK or hi == len(texts):
            yield pa.array([(t or "").lower() for t in texts[lo:hi]], pa.large_string())
            lo, size = hi, 0


def chunks(texts: list[str | None]):
    """The different tokens of each run of texts."""
    for run in split_runs(texts):
        yield pc.utf8_split_whitespace(run).flatten().unique().to_pylist()


def slices(tokens: list[str]):
    """The tokens in order, in lists of about SLICE characters."""
    upto = np.cumsum([len(t) for t in tokens])
    lo = 0
    while lo < len(tokens):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, "right")))
        yield tokens[lo:hi]
        lo = hi


def spelled(word: str) -> list[str]:
    """The marked pieces whose characters the models predict."""
    return [START + word[i : i + PIECE] + (END if i + PIECE >= len(word) else "") for i in range(0, len(word), PIECE)]


def grams(piece: str) -> list[str]:
    """For each character after the start mark, the n-gram of up to ORDER characters that ends with it."""
    short = [piece[: i + 1] for i in range(1, min(ORDER, len(piece)))]
    return short + [piece[i : i + ORDER] for i in range(1, len(piece) - ORDER + 1)]


def count_grams(docs: DataFrame) -> DataFrame:
    """(text, label: 0 or 1) -> (gram, toxic, ordinary): documents, per word, that hold it, by class."""

    def run(batches):
        tallies = Counter(), Counter()

        def flush():
            total: dict[str, list[int]] = {}
            for k, tally in enumerate(tallies):
                for word, n in tally.items():
                    for piece in spelled(word):
                        for g in grams(piece):
                            total.setdefault(g, [0, 0])[k] += n
                tally.clear()
            names = list(total)
            for lo in range(0, len(names), 20_000):
                part = names[lo : lo + 20_000]
                columns = np.array([total[g] for g in part], dtype=np.int64)
                yield pa.record_batch([pa.array(part), pa.array(columns[:, 1]), pa.array(columns[:, 0])], ["gram", "toxic", "ordinary"])

        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                tallies[bool(label)].update({w for t in set(tokens_of(text)) for w in WORD.findall(t)})
            if sum(map(len, tallies)) > 600_000:
                yield from flush()
        yield from flush()

    counts = docs.mapInArrow(run, "gram string, toxic long, ordinary long")
    return counts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def count_types(docs: DataFrame, histories: DataFrame) -> DataFrame:
    """(gram, types): of each n-gram below the highest order, the different characters that precede it in all words of
    docs (text). Only n-grams that continue one of histories (history), but all of those; with a history its own
    beginnings and endings must be there too."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(histories.toArrow()["history"].to_pylist()))

    def run(batches):
        known, met, seen, found = shared.value, set(), set(), set()

        def flush():
            names = list(found)
            for lo in range(0, len(names), 20_000):
                yield pa.record_batch([pa.array(names[lo : lo + 20_000], pa.string())], ["gram"])
            found.clear()

        for b in batches:
            for tokens in chunks(b.column("text").to_pylist()):
                tokens = set(tokens) - met
                met |= tokens
                new = {w for t in tokens for w in WORD.findall(t)} - seen
                seen |= new
                for word in new:
                    for piece in spelled(word):
                        # The longest one only: the others are its endings. None begins before the last one did.
                        start = 1
                        for i in range(1, len(piece)):
                            start = max(start, i - ORDER + 2)
                            while start < i and piece[start:i] not in known:
                                start += 1
                            found.add(piece[start - 1 : i + 1])
                if len(met) > 600_000:
                    met.clear()
                    seen.clear()
            if len(found) > 600_000:
                yield from flush()
        yield from flush()

    found = docs.select("text").mapInArrow(run, "gram string").distinct()
    endings = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda i: F.substring("gram", i, F.lit(ORDER)))
    kinds = found.select(F.explode(endings).alias("gram")).distinct()
    return kinds.groupBy(F.substring("gram", F.lit(2), F.lit(ORDER)).alias("gram")).agg(F.count("*").alias("types"))


def shared_backoff(types: DataFrame) -> DataFrame:
    """(gram, types) -> (gram, p): Model.shared of every n-gram."""
    gram = F.col("gram")
    among = Window.partitionBy(F.substring(gram, F.lit(1), F.length(gram) - 1))
    steps = types.select("gram", "types", F.sum("types").over(among).alias("follow"), F.count("*").over(among).alias("branch"))
    steps = save(steps.withColumn("n", F.length(gram)), "toxicity-steps")
    mixed = (F.greatest(F.col("types") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("branch") * F.col("back")) / F.col("follow")
    level = save(steps.filter("n = 1").withColumn("back", 1 / (F.col("branch") + 1000)).select("gram", mixed.alias("p")), "toxicity-shared")
    out = level
    for n in range(2, ORDER):
        below = level.select(F.col("gram").alias("suffix"), F.col("p").alias("back"))
        own = steps.filter(F.col("n") == n).withColumn("suffix", F.substring(gram, F.lit(2), F.lit(ORDER)))
        level = save(own.join(below, "suffix").select("gram", mixed.alias("p")), "toxicity-shared")
        out = out.union(level)
    return out


def gram_ratios(labelled: DataFrame, docs: DataFrame) -> DataFrame:
    """(gram, seen, ratio): Model.ratio of the n-grams that a class has counted (seen), and of those that no class has,
    by their history (not seen): the backoff then cancels out. A history not listed is one of ratio 0.

    labelled: (text, label), which the size of the result depends on; docs: (text), whose words all count in the backoff.
    """
    classes = ("toxic", "ordinary")
    gram = F.col("gram")
    counts = save(count_grams(labelled).withColumn("history", F.substring(gram, F.lit(1), F.length(gram) - 1)), "toxicity-grams")
    sums = [F.sum(c).alias(f"{c}_sum") for c in classes] + [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in classes]
    known = save(counts.groupBy("history").agg(*sums), "toxicity-histories")
    # The histories that the backoff of these n-grams passes through: inner parts that end before the last character.
    inner = F.transform(F.sequence(F.lit(2), F.length(gram)), lambda i: F.substring(gram, i, F.length(gram) - i))
    shared = shared_backoff(count_types(docs, counts.select(F.explode(inner).alias("history")).distinct()))

    def ratio(own, back):
        def p(c):
            mixed = (F.greatest(own(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{c}_kinds") * back) / F.col(f"{c}_sum")
            return F.when(F.col(f"{c}_sum") > 0, mixed).otherwise(back)

        return F.log(p("toxic") / p("ordinary"))

    rows = counts.join(known, "history").withColumn("suffix", F.substring(gram, F.lit(2), F.lit(ORDER)))
    rows = rows.join(shared.select(F.col("gram").alias("suffix"), F.col("p").alias("back")), "suffix")
    found = rows.select("gram", F.lit(True).alias("seen"), ratio(F.col, F.col("back")).alias("ratio"))
    return found.union(known.select("history", F.lit(False), ratio(lambda c: F.lit(0), F.lit(1.0))))


class Model:
    """The two classes' models over a shared backoff, in memory: what gram_ratios() computes by joins. Built from
    (gram, toxic, ordinary, seen) rows."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.own = ({}, {})
        self.sums = ({}, {})
        self.kinds = ({}, {})
        for g, toxic, ordinary, _ in rows:
            for k, n in enumerate((toxic, ordinary)):
                if n:
                    h = g[:-1]
                    self.own[k][g] = n
                    self.sums[k][h] = self.sums[k].get(h, 0) + n
                    self.kinds[k][h] = self.kinds[k].get(h, 0) + 1
        # Shared continuation counts: of each shorter n-gram, the different characters that precede it.
        level = {g for g, *_ in rows}
        self.types: dict[str, int] = {}
        self.follow: dict[str, int] = {}
        self.branch: dict[str, int] = {}
        while level:
            below: Counter = Counter(g[1:] for g in level if len(g) > 1)
            fresh = [g for g in below if g not in self.types]
            for g, n in below.items():
                self.types[g] = self.types.get(g, 0) + n
            level = set(fresh)
        for g, n in self.types.items():
            self.follow[g[:-1]] = self.follow.get(g[:-1], 0) + n
            self.branch[g[:-1]] = self.branch.get(g[:-1], 0) + 1
        self.floor = 1 / (self.branch.get("", 0) + 1000)

    def shared(self, g: str) -> float:
        p = self.floor
        for i in range(len(g) - 1, -1, -1):
            h = g[i:-1]
            total = self.follow.get(h)
            if not total:
                break
            p = max(self.types.get(g[i:], 0) - DISCOUNT, 0) / total + DISCOUNT * self.branch[h] / total * p
        return p

    def ratio(self, g: str) -> float:
        """Log-probability of the n-gram's last character under the toxic model less that under the ordinary one."""
        h = g[:-1]
        totals = [s.get(h) for s in self.sums]
        if totals == [None, None]:
            return 0.0  # neither class knows the history: both back off to the same probability
        back = self.shared(g[1:])
        p = [back if n is None else (max(self.own[k].get(g, 0) - DISCOUNT, 0) + DISCOUNT * self.kinds[k][h] * back) / n for k, n in enumerate(totals)]
        return math.log(p[0] / p[1])

    def evidence(self, word: str, known: dict[str, float]) -> float:
        """Log-likelihood of the word under the toxic model less that under the ordinary one, over its characters.
        known: keeps the ratios of n-grams."""
        total = length = 0
        for piece in spelled(word):
            length += len(piece) - 1
            for i in range(1, len(piece)):
                g = piece[max(0, i - ORDER + 1) : i + 1]
                r = known.get(g)
                if r is None:
                    r = known[g] = self.ratio(g)
                total += r
        return total / max(1, length)


FEATURES = 3


def document_features(each: np.ndarray, lengths: np.ndarray) -> list[float]:
    """From the evidence of each word and its length: log-likelihood under the toxic model less that under the ordinary one,
    over the length, of the whole text, of the word where it is greatest, and the mean of the three such words. 0 without
    a word."""
    if not len(each):
        return [0.0] * FEATURES
    top = np.partition(each, -3)[-3:] if len(each) > 3 else each
    return [float(each @ lengths / lengths.sum()), float(each.max()), float(top.mean())]


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point, whether words are made of it."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in WORD.finditer("".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _packed(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two whole numbers that stand for up to ORDER code points, 0 where there is none."""
    a, b = (sum((c.astype(np.uint64) << np.uint64(21 * i) for i, c in enumerate(part)), start=np.uint64(0)) for part in (columns[:3], columns[3:]))
    return a, b


class Ratios:
    """name -> ratio as a hash table of arrays, looked up many at once; 0 is given for names that are not there."""

    def __init__(self, ratios: dict[str, float]):
        n = len(ratios)
        names = np.zeros((n, ORDER), np.uint32)
        flat, lengths = _codes("".join(ratios)), np.fromiter(map(len, ratios), np.int64, n)
        rows, ends = np.repeat(np.arange(n), lengths), np.repeat(np.cumsum(lengths), lengths)
        names[rows, ends - 1 - np.arange(len(flat))] = flat  # the last character first
        self.a, self.b = _packed(list(names.T))
        self.values = np.fromiter(ratios.values(), np.float64, n)
        self.mask = np.uint64((1 << max(4, (4 * n).bit_length())) - 1)
        self.owner = np.full(int(self.mask) + 1, -1, np.int32)
        slot, todo = self._slots(self.a, self.b), np.arange(n)
        while len(todo):
            free = todo[self.owner[slot[todo]] < 0]
            self.owner[slot[free]] = free
            todo = todo[self.owner[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix64(a + b * np.uint64(0x9E3779B97F4A7C15)) & self.mask).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places of the names in values; -1 of those that are not there."""
        out, slot, todo = np.full(len(a), -1, np.int32), self._slots(a, b), np.arange(len(a))
        while len(todo):
            owner = self.owner[slot]
            there = owner >= 0
            owner, slot, todo = owner[there], slot[there], todo[there]
            same = (self.a[owner] == a[todo]) & (self.b[owner] == b[todo])
            out[todo[same]] = owner[same]
            todo, slot = todo[~same], (slot[~same] + 1) & int(self.mask)
        return out


class Evidence:
    """The evidence of words from the ratios of their n-grams.
    ratios: of n-grams that a class has counted, and by history of all others."""

    def __init__(self, ratios: tuple[dict[str, float], dict[str, float]]):
        self.own, self.other = map(Ratios, ratios)

    def __call__(self, words: list[str]) -> list[float]:
        return self.of_tokens(words)[1].tolist()

    def of_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of words of each token; evidence and length (its end counts as a character) of all these words."""
        flat = _codes("\n".join([*tokens, ""]))
        letter = _letters()[flat]
        starts = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
        lengths = np.flatnonzero(letter & ~np.append(letter[1:], False)) + 1 - starts
        counts = np.diff(np.searchsorted(starts, np.append(0, np.flatnonzero(flat == 10) + 1)))
        # The marked pieces of all words, one after another, and the place of each character in its piece.
        extra = -(-lengths // PIECE)  # a start mark a piece; one end mark a word
        sizes = lengths + extra + 1
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(word)) - np.repeat(ends - sizes, sizes)
        last = at == np.repeat(sizes, sizes) - 1
        place = np.where(last, np.repeat(lengths - (extra - 1) * PIECE + 1, sizes), at % (PIECE + 1))
        marked = np.zeros(len(word) + ORDER - 1, np.uint32)  # some blanks go before
        codes = marked[ORDER - 1 :]
        start = place == 0
        codes[start], codes[last] = ord(START), ord(END)
        codes[~(start | last)] = flat[letter]
        keep = np.flatnonzero(~start)
        columns = [np.where(place[keep] >= i, marked[ORDER - 1 - i + keep], 0) for i in range(ORDER)]
        found = self.own.find(*_packed(columns))
        each = np.zeros(len(keep))
        each[found >= 0] = self.own.values[found[found >= 0]]
        new = np.flatnonzero(found < 0)
        found = self.other.find(*_packed([*(c[new] for c in columns[1:]), np.zeros(len(new), np.uint32)]))
        each[new[found >= 0]] = self.other.values[found[found >= 0]]
        return counts, np.bincount(word[keep], each, len(sizes)) / (lengths + 1), lengths + 1

    def of_texts(self, texts: list[str | None]):
        """Evidence and length of the words of each text, one after another. A word met often is reckoned once for each
        run of texts of about CHUNK characters."""
        for run in split_runs(texts):
            split = pc.utf8_split_whitespace(run)
            found = split.flatten().dictionary_encode()
            tokens, index = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)
            parts = [self.of_tokens(part) for part in slices(tokens)]
            counts, each, lengths = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*parts, strict=True)) or [()] * 3))
            # From tokens to their words, which mostly is one.
            firsts, many = (np.cumsum(counts) - counts)[index], counts[index]
            upto = np.append(0, np.cumsum(many))
            words = np.repeat(firsts - upto[:-1], many) + np.arange(upto[-1])
            each, lengths = each[words], lengths[words]
            borders = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                yield each[lo:hi], lengths[lo:hi]

    def of_text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return next(self.of_texts([text]))


def collected(ratios: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """gram_ratios() as Evidence takes it."""
    out: tuple[dict[str, float], dict[str, float]] = {}, {}
    for b in ratios.toArrow().to_batches():
        for g, seen, r in zip(b.column("gram").to_pylist(), b.column("seen").to_pylist(), b.column("ratio").to_pylist(), strict=True):
            out[not seen][g] = r
    return out


def _scored(shared, weights, names):
    key = uuid.uuid4().hex

    def run(batches):
        evidence = kept_in_worker(key, lambda: Evidence(shared.value))
        for b in batches:
            rows = [document_features(*words) for words in evidence.of_texts(b.column("_text").to_pylist())]
            x = np.array(rows).reshape(-1, FEATURES)
            out = [b.column(n) for n in names]
            if weights is None:
                out.append(pa.array(list(x), pa.list_(pa.float64())))
                yield pa.record_batch(out, [*names, "features"])
            else:
                out.append(pa.array(apply_logistic(weights, x)))
                yield pa.record_batch(out, [*names, "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[tuple[dict, dict], dict]:
    """Class counts from four fifths of the sampled labels, shared counts from all documents; the calibration from the
    rest of the sample. Every row of a labelled id counts for the classes, and one of them for the calibration. Without
    labelled rows of both classes all scores are the smoothed share of toxic rows."""
    spark = docs.sparkSession
    prepare(spark)
    known = sample_labels(labels, id_col, label_col, SAMPLE)
    tune = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    labelled = every.join(F.broadcast(known.filter(~tune)), "id").select("text", "label")
    model = collected(gram_ratios(labelled, every))
    part = every.join(F.broadcast(known.filter(tune)), "id").select("id", "label", F.col("text").alias("_text"))
    shared = spark.sparkContext.broadcast(model)
    found = part.mapInArrow(_scored(shared, None, ["id", "label"]), "id long, label int, features array<double>")
    got = found.groupBy("id", "label").agg(F.max("features").alias("features")).toPandas().sort_values("id")
    x = np.array(got["features"].tolist()).reshape(-1, FEATURES)
    return model, fit_logistic(x, got["label"].to_numpy().astype(float))


def score_toxicity(docs: DataFrame, model: tuple[tuple[dict, dict], dict], keep: list, text_col: str = "text") -> DataFrame:
    """The columns `keep` (expressions) of each row, and score in 0..1.

    Null texts and those without a word get the score of no evidence. Texts are read whole. Rows that repeat an id or a
    text get a score each, equal ones for equal texts. No rows for an empty table.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = rows.columns[:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model[0]), model[1], names), f"{fields}, score double")


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 5) == 0
