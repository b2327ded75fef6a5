"""URL filters: explicit rules first, then segmented words of host and path under multinomial naive Bayes.

Concatenated names are split into words by a Viterbi search over a unigram model, whose counts come from the words of
all pages. Naive Bayes learns from the urls that a rule decides and judges those that none does. Neither model is cut or
gathered in one place: the words that lie within a run of letters are found by a join, each run is split on its own, and
token counts are joined to the runs that hold the tokens.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, prepare, release, save

#: The default rules: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words up to this length are looked up as parts of a run; longer ones by their first letters, then as a whole.
STEM = 24
RUN = r"\p{L}+|\p{Nd}+"
WORD = re.compile(r"[^\W\d_]+")


def plain_text(html: str | None) -> str:
    """The lower-cased page without scripts, styles and tags, in one pass: an opening without a closing is plain text."""
    text = (html or "").lower()
    out, at = [], 0
    gone = set()
    while True:
        lo = text.find("<", at)
        if lo < 0 or "<" in gone:
            out.append(text[at:])
            return " ".join(out)
        out.append(text[at:lo])
        hi = -1
        for tag in ("script", "style"):
            after = lo + 1 + len(tag)
            if tag not in gone and text.startswith(tag, lo + 1) and not (text[after : after + 1].isalnum() or text[after : after + 1] == "_"):
                hi = text.find(f"</{tag}>", after)
                if hi < 0:
                    gone.add(tag)  # nor does it close further on
                else:
                    hi += len(tag) + 2
        if hi < 0:
            hi = text.find(">", lo)
            if hi < 0:
                gone.add("<")
                at = lo
                continue
        at = hi + 1


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path then up to ? # or the end.
    Null, or without ://: both empty."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower()), F.regexp_extract(url, pattern, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for kind, name in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, p = name.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


class Segmenter:
    """Splits a run of letters into words: the best product of unigram probabilities, by Viterbi. An unknown word of n
    letters counts as 10 / 10^n occurrences; ties go to the longer last word."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """counts: of the words that the run holds, or more; total: of all words, their sum unless given."""
        self.total = math.log((sum(counts.values()) if total is None else total) + 1)
        self.log = {w: math.log(n) - self.total for w, n in counts.items()}
        self.lengths = sorted(set(map(len, counts)))

    def __call__(self, run: str) -> list[str]:
        """A stretch of unknown letters is one word: what it costs is the same however it starts, so the best of all its
        starts is carried along."""
        tenfold = math.log(10)
        best, back = [0.0], [0]
        top, first = -math.inf, 0  # best[start] + start * log 10, over the starts so far
        for end in range(1, len(run) + 1):
            if best[end - 1] + (end - 1) * tenfold > top:
                top, first = best[end - 1] + (end - 1) * tenfold, end - 1
            score, at = top - end * tenfold + tenfold - self.total, first
            for n in self.lengths:
                if n > end:
                    break
                p = self.log.get(run[end - n : end])
                if p is not None and best[end - n] + p >= score:
                    score, at = best[end - n] + p, end - n
            best.append(score)
            back.append(at)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): all words of the pages' texts."""

    def run(batches):
        tally: Counter = Counter()
        for b in batches:
            for html in b.column("html").to_pylist():
                tally.update(WORD.findall(plain_text(html)))
                if len(tally) > 500_000:
                    yield pa.record_batch([pa.array(list(tally)), pa.array(list(tally.values()), pa.int64())], ["word", "n"])
                    tally.clear()
        yield pa.record_batch([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])

    rows = pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def runs_of(side: str, text: Column) -> Column:
    """Array of (side, run): the runs of letters and of digits, lower-cased."""
    found = F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0))
    return F.transform(found, lambda r: F.struct(F.lit(side).alias("side"), r.alias("run")))


def words_within(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run) and (word, n) -> (run, words: array of (word, n)): those words that a run holds. Runs that hold none are left
    out."""
    long = words.filter(F.length("word") > STEM)
    starts = F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at")
    placed = runs.select("run", starts)
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(STEM), F.length("run") - F.col("at") + 1))).alias("size")
    parts = placed.select("run", "at", sizes).select("run", F.substring("run", F.col("at"), F.col("size")).alias("word")).distinct()
    held = parts.join(words.filter(F.length("word") <= STEM), "word").select("run", "word", "n")
    if not long.isEmpty():
        stems = placed.filter(F.length("run") - F.col("at") >= STEM).withColumn("stem", F.substring("run", F.col("at"), F.lit(STEM)))
        whole = stems.join(long.withColumn("stem", F.substring("word", 1, STEM)), "stem")
        whole = whole.filter(F.substring("run", F.col("at"), F.length("word")) == F.col("word"))
        held = held.union(whole.select("run", "word", "n").distinct())
    return held.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("words"))


def split_runs(runs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(run, times) -> (run, times, words): the segmented run. Digits are one word, which counts by its length."""
    letters = runs.filter(F.col("run").rlike(r"^\p{L}"))
    given = letters.join(words_within(letters.select("run"), words), "run", "left")

    def split(batches):
        for b in batches:
            out = []
            for run, found in zip(b.column("run").to_pylist(), b.column("words").to_pylist(), strict=True):
                out.append(Segmenter({w["word"]: w["n"] for w in found or []}, total)(run))
            yield pa.record_batch([b.column("run"), b.column("times"), pa.array(out, pa.list_(pa.string()))], ["run", "times", "words"])

    digits = runs.filter(~F.col("run").rlike(r"^\p{L}")).select("run", "times", F.array(F.concat(F.lit("#"), F.length("run").cast("string"))).alias("words"))
    return given.select("run", "times", "words").mapInArrow(split, "run string, times long, words array<string>").union(digits)


def token_ratios(ruled: DataFrame, split: DataFrame) -> tuple[DataFrame, float, float]:
    """Multinomial naive Bayes over (side, word), one added to each count: (side, word, ratio) of the tokens that ruled
    urls have, the ratio of any other token, and that of the classes. Ratios: log of block over allow.

    ruled: (verdict, runs: array of (side, run)); split: (run, words)."""
    kinds = ("block", "allow")
    urls = {r["verdict"]: r["count"] for r in ruled.groupBy("verdict").count().collect()}
    tally = ruled.select("verdict", F.explode("runs").alias("r")).select("verdict", "r.*").groupBy("side", "run")
    tally = tally.agg(*(F.count(F.when(F.col("verdict") == k, True)).alias(k) for k in kinds))
    tokens = tally.join(split, "run").select("side", F.explode("words").alias("word"), *kinds).groupBy("side", "word").agg(*(F.sum(k).alias(k) for k in kinds))
    tokens = save(tokens, "url-tokens")
    sums = tokens.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds)).first()
    size = {k: sums[k] + sums["n"] + 1 for k in kinds}  # one for all tokens that no ruled url has
    other = math.log(size["allow"] / size["block"])
    ratio = F.log((F.col("block") + 1) / (F.col("allow") + 1)) + other
    prior = math.log((urls.get("block", 0) + 1) / (urls.get("allow", 0) + 1))
    return tokens.select("side", "word", ratio.alias("ratio")), other, prior


def with_runs(pages: DataFrame, url_col: str, *keep: Column) -> DataFrame:
    """keep, host, path and runs (array of (side, run)) of each url."""
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    return rows.withColumn("runs", F.concat(runs_of("h", F.col("host")), runs_of("p", F.col("path"))))


def fit(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES) -> dict:
    """Word counts of all pages (words, a table, and their total) and naive Bayes from the urls that a rule decides
    (ratios, a table, the ratio of other tokens and that of the classes)."""
    prepare(pages.sparkSession)
    words = save(word_counts(pages, html_col), "url-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    verdict = matching_rule(F.col("host"), F.col("path"), rules)[1]
    ruled = save(with_runs(pages, url_col).select(verdict.alias("verdict"), "runs").filter("verdict is not null"), "url-ruled")
    runs = ruled.select(F.explode("runs").alias("r")).groupBy("r.run").agg(F.count("*").alias("times"))
    split = save(split_runs(runs, words, total), "url-known")
    ratios, other, prior = token_ratios(ruled, split.select("run", "words"))
    release(ruled, split)
    return {"words": words, "total": total, "ratios": ratios, "other": other, "prior": prior}


def filter_urls(pages: DataFrame, model: dict, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score (probability of block), words (of the host).

    A null url, or one without ://, has empty host and path and no rule; naive Bayes' prior then decides, as it does
    without letters and digits. Ties allow. Rows that repeat an id or a url are judged one by one, equal urls alike. Very
    long pages and runs are read whole. An empty table gives no rows.
    """
    prepare(pages.sparkSession)
    rows = save(with_runs(pages, url_col, F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")), "url-rows")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    placed = rows.select("row", F.posexplode("runs").alias("at", "r")).select("row", "at", "r.*")
    split = save(split_runs(placed.groupBy("run").agg(F.count("*").alias("times")), model["words"], model["total"]), "url-split")

    # What each run adds to the score, on its side; then the sum for each row. Frequent runs are broadcast.
    sides = placed.groupBy("side", "run").agg(F.count("*").alias("n")).join(split.select("run", "words"), "run")
    each = sides.select("side", "run", "n", "words", F.explode("words").alias("word")).join(model["ratios"], ["side", "word"], "left")
    each = each.groupBy("side", "run").agg(F.sum(F.coalesce("ratio", F.lit(model["other"]))).alias("z"), F.first("n").alias("n"), F.first("words").alias("words"))
    scored = join_hot(placed, save(each, "url-runs"), ["side", "run"], "n", "inner")
    text = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == "h", F.struct("at", "words")))), lambda w: w["words"])), " ")
    sums = scored.groupBy("row").agg(F.sum("z").alias("z"), text.alias("words"))
    z = F.least(F.lit(50.0), F.greatest(F.lit(-50.0), F.round(F.coalesce("z", F.lit(0.0)) + model["prior"], 9)))
    out = rows.join(sums, "row", "left").withColumn("score", 1 / (1 + F.exp(-z)))
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score", F.coalesce("words", F.lit("")).alias("words"))
