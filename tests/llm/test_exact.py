"""Operators against plain reckonings on small tables: repeated ids, Kneser-Ney by hand, sizes, naive Bayes, machines."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from coppice.llm import embedding_dedup, jaccard_join, language_id, mixing, pii, quality, sentencepiece, toxicity, url_filter
from coppice.llm.common import join_hot, tidy
from coppice.llm.embedding_dedup import buckets, rotations_for


def near(word, n=60):
    return " ".join([f"{word}{i}" for i in range(n)])


@pytest.fixture(scope="module")
def shared_ids(spark):
    """An id that stands for two texts, each with a near copy; rows without an id; a repeated row."""
    a, b = near("a"), near("b")
    rows = [(1, a, "s", 1), (1, b, "s", 2), (3, b + " more", "s", 3), (4, a + " more", "s", 4), (None, a + " else", "t", 5), (None, "alone without an id", "t", 6), (7, "twice", "t", 8), (7, "twice", "s", 9)]
    return spark.createDataFrame([(i, t, "en", s, n) for i, t, s, n in rows], corpus_pipeline_schema())


def corpus_pipeline_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_an_id_of_two_texts_loses_no_link(shared_ids):
    got = sorted(((r["doc_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in jaccard_join.ngram_jaccard_join(shared_ids).collect()), key=str)
    assert got == sorted([(-1, 0, None, True), (-1, 2, 1, False), (1, 1, 1, True), (1, 2, 1, True), (3, 1, 1, False), (4, 2, 1, False), (7, 1, 7, True), (7, 1, 7, True)], key=str)


def test_the_stage_keeps_one_row_of_each_group(spark, shared_ids):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    rows = sorted(((r["doc_id"] or -1, r["text"], r["source"]) for r in stage(spark, shared_ids, "").collect()))
    assert rows == sorted([(1, near("a"), "s"), (1, near("b"), "s"), (-1, "alone without an id", "t"), (7, "twice", "s")])
    # of near copies that all have one id, one text stays
    same = shared_ids.filter("doc_id is not null").withColumn("doc_id", F.lit(5).cast("long"))
    assert stage(spark, same, "").filter("text like 'a0 %'").count() == 1


def test_an_id_of_two_vectors_loses_no_link(spark):
    g = np.random.default_rng(0)
    a, b, c = g.normal(size=(3, 32))
    rows = [(1, a), (1, b), (3, b + 0.01), (4, a + 0.01), (None, a + 0.02), (None, c), (9, c * 2)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_near_duplicates(df).collect()), key=str)
    assert got == sorted([(-1, 1, 9, False), (-1, 2, 1, False), (1, 1, 1, True), (1, 2, 1, True), (3, 1, 1, False), (4, 2, 1, False), (9, 1, 9, True)], key=str)


def test_hot_keys_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr("coppice.llm.common.HOT", 3)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 2 else f"k{i}") for i in range(4000)], "i long, k string")
    facts = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = join_hot(rows, facts, ["k"], "n")
    assert got.count() == 4000 and got.filter("k = 'hot'").agg(F.min("n")).first()[0] == facts.filter("k = 'hot'").first()["n"]
    assert got.filter("n is null").count() == rows.filter("k is null").count()
    assert join_hot(rows, facts, ["k"], "n", "inner").count() == rows.filter("k is not null").count()


def test_hashes_find_pairs_at_the_threshold():
    g = np.random.default_rng(1)
    for d, count in ((64, 50_000), (128, 10**7)):
        x = g.normal(size=(500, d))
        z = g.normal(size=(500, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y, j = 0.951 * x + math.sqrt(1 - 0.951**2) * z, rotations_for(count, d)
        a, b = buckets(x, j), buckets(y, j)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.99


def kneser_ney(words_by_class, corpus, order, discount):
    """log P(toxic) - log P(ordinary) of a word over its length: counts by text, continuation counts by the corpus."""

    def grams(word):
        s = "\x02" + word + "\x03"
        return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]

    types = {}
    todo = {g for w in corpus for g in grams(w)}
    while todo:
        fresh = set()
        for g in todo:
            if len(g) > 1:
                if g[1:] not in types:
                    fresh.add(g[1:])
                types.setdefault(g[1:], set()).add(g[0])
        todo = fresh
    branch = {}
    for g in types:
        branch.setdefault(g[:-1], set()).add(g)

    def shared(g):
        if not branch.get(g[:-1]):
            return shared(g[1:]) if len(g) > 1 else 1 / (len(branch[""]) + 1000)
        total = sum(len(types[x]) for x in branch[g[:-1]])
        back = shared(g[1:]) if len(g) > 1 else 1 / (len(branch[""]) + 1000)
        return max(len(types.get(g, ())) - discount, 0) / total + discount * len(branch[g[:-1]]) / total * back

    def p(k, g):
        own = Counter(x for w, n in words_by_class[k].items() for x in grams(w) for _ in range(n))
        of = {x: n for x, n in own.items() if x[:-1] == g[:-1]}
        back = shared(g[1:]) if len(g) > 1 else 1.0
        return back if not of else max(of.get(g, 0) - discount, 0) / sum(of.values()) + discount * len(of) / sum(of.values()) * back

    return lambda word: sum(math.log(p(1, g) / p(0, g)) for g in grams(word)) / (len(word) + 1)


def test_toxicity_by_hand(spark):
    texts = [("bad word abc", 1), ("bad abd", 1), ("good word", 0), ("word abc goody", 0), ("only here abz", None)]
    by = {k: Counter(w for t, c in texts if c == k for w in set(t.split())) for k in (0, 1)}
    corpus = {w for t, _ in texts for w in t.split()}
    want = kneser_ney(by, corpus, toxicity.ORDER, toxicity.DISCOUNT)
    docs = spark.createDataFrame(texts, "text string, label int")
    evidence = toxicity.Evidence(toxicity.collected(toxicity.gram_ratios(docs.filter("label is not null"), docs)))
    for w in corpus:
        assert evidence([w])[0] == pytest.approx(want(w), abs=1e-9), w
    each, lengths = evidence.of_text("Bad, word! abc-abd 12")
    assert each.tolist() == pytest.approx([want(w) for w in ("bad", "word", "abc", "abd")]) and lengths.tolist() == [4, 5, 4, 4]
    mean, top, three = toxicity.document_features(each, lengths)
    assert mean == pytest.approx(each @ lengths / 17) and top == each.max() and three == pytest.approx(np.sort(each)[1:].mean())


def test_quality_sizes_by_plain_compression():
    good, bad = b"the cat sat on the mat and slept. " * 90, b"BUY NOW!!! $$$ click >>> " * 120
    raw = [quality.train_dictionary([good]), quality.train_dictionary([bad])]
    sizes = quality.Sizes(*raw)
    for text in ("the cat slept on the mat. " * 90, "BUY NOW $$$", "é" * 3000, "x"):
        data, total = text.encode(), []
        for d in raw:
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            total.append(sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)))
        assert sizes.difference(text) == pytest.approx((total[1] - total[0]) / len(data))
    assert sizes.difference("the cat sat on the mat") > 0 > sizes.difference("BUY NOW!!! click") and sizes.difference(None) == 0


def best_split(run, counts):
    """Every way to cut the run, by its score."""
    total = math.log(sum(counts.values()) + 1)

    def score(w):
        return math.log(counts[w]) - total if w in counts else math.log(10) - total - len(w) * math.log(10)

    options = []
    for mask in range(1 << (len(run) - 1)):
        cuts = [0, *(i + 1 for i in range(len(run) - 1) if mask >> i & 1), len(run)]
        options.append(sum(score(run[a:b]) for a, b in zip(cuts, cuts[1:])))
    return max(options), score


def test_url_words_and_bayes_by_hand(spark):
    counts = {"casino": 9, "win": 7, "the": 40, "we": 3, "ca": 2, "sinowin": 1}
    segment = url_filter.Segmenter(counts)
    rnd = random.Random(2)
    for _ in range(150):
        run = "".join(rnd.choice(["casino", "win", "the", "we", "x", "qz"]) for _ in range(3))[:11]
        top, score = best_split(run, counts)
        assert sum(map(score, segment(run))) == pytest.approx(top) and "".join(segment(run)) == run
    long = "abcdefghijklmnopqrstuvwxyz" * 2
    rows = [("http://a.org/win", f"casino win the {long}"), ("http://b.com/de/casino", "the the"), ("http://casinowin.net/thewin", long), (f"http://x{long}the.net/", ""), (None, None), ("http://b.com/de/", "win")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    words = Counter(w for _, h in rows for w in (h or "").split())
    split = url_filter.Segmenter(words)
    tokens = {}
    for i, (u, _) in enumerate(rows):
        host, _, path = (u or "://").split("://")[1].partition("/")
        tokens[i] = [(s, w if w.isalpha() else f"#{len(w)}") for s, t in (("h", host), ("p", path)) for r in re.findall(r"[a-z]+|\d+", t) for w in split(r)]
    n = {k: Counter(t for i in rows_ for t in tokens[i]) for k, rows_ in (("allow", [0]), ("block", [1, 5]))}
    size = len(set(n["allow"]) | set(n["block"])) + 1
    total = {k: sum(c.values()) + size for k, c in n.items()}
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, url_filter.fit(df)).collect()}
    assert got[2]["words"] == " ".join(["casino", "win", *split("net")]) and got[3]["words"].startswith(f"x {long} the ")
    for i in range(len(rows)):
        z = math.log(3 / 2) + sum(math.log((n["block"][t] + 1) / total["block"]) - math.log((n["allow"][t] + 1) / total["allow"]) for t in tokens[i])
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-7), i


def test_tags_are_read_in_one_pass():
    began = time.perf_counter()
    url_filter.plain_text("<script " * 200_000)
    url_filter.plain_text("<" * 1_000_000)
    assert time.perf_counter() - began < 1
    assert url_filter.plain_text("a<b>C</b><script>x < y</script>d<STYLE>q</style> e <i") .split() == ["a", "c", "d", "e", "<i"]


def test_machines_part_a_toy_set():
    x = np.zeros((40, language_id.SIZE), np.float32)
    langs = ["de" if i % 4 == 0 else "en" if i % 4 == 1 else "fr" if i % 4 == 2 else "es" for i in range(40)]
    for i, lang in enumerate(langs):
        x[i, {"de": 0, "en": 1, "fr": 2, "es": 3}[lang]] = 0.9
        x[i, 10 if lang in ("de", "en") else 11] = 0.4
    model = language_id.train(x, langs)
    assert set(model["families"]) == {"germanic", "romance"} and ("de", "en") in model["kinds"] and ("es", "fr") in model["kinds"]
    assert all(language_id.predict(model, x[i])[0] == langs[i] for i in range(40))
    w = language_id.train_svm(x, np.arange(40), np.where(np.array(langs) == "de", 1.0, -1.0))
    margins = (x @ w[:-1] + w[-1]) * np.where(np.array(langs) == "de", 1, -1)
    assert margins.min() > 0.9


def test_language_sample_repeats_bit_by_bit(spark):
    rows = [(f"text {i} " + "abcdefgh"[i % 8] * (i % 5 + 1), f"l{i % 300}") for i in range(3000)]
    df = spark.createDataFrame(rows, "text string, lang string")
    a, b = language_id.sample(df, "text", "lang", 100), language_id.sample(df.repartition(5), "text", "lang", 100)
    assert a[1] == b[1] and (a[0] == b[0]).all() and len(set(a[1])) == 300


def test_terms_by_brute_force(spark):
    rnd = random.Random(6)
    common = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(400):
        words = rnd.choices(common, k=15)
        if i < 12:
            words.insert(rnd.randrange(15), f"user{i % 4}@corp.com")
            words.insert(rnd.randrange(15), f"Nick{i % 4}")
        if i % 100 == 50:
            words.append("nick3")
        rows.append((i, " ".join(words)))
    rows += [(500 + i, rows[1][1].replace("word5", "word6") + " tail") for i in range(2)] + [(600, None), (601, "")]
    texts = {t or "" for _, t in rows}
    held = {}
    for t in texts:
        for e in set(re.findall(r"user\d@corp\.com", t)):
            held.setdefault(e, set()).add(t)
    terms_of = {t: set(re.findall(r"\w{3,}", re.sub(r"user\d@corp\.com", " ", t).lower())) for t in texts}
    seen = {w: {t for t in texts if w in set(re.findall(r"[^\W_]{3,}", t.lower()))} for w in set().union(*terms_of.values())}
    want = set()
    for e, own in held.items():
        for w in seen:
            both = [t for t in own if w in terms_of[t]]
            share = len(both) / len(seen[w])
            if len(both) > 1 and share >= pii.SHARE and math.log2(share / (len(own) / len(texts))) >= pii.BITS:
                want.add(w)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = {s["value"].lower() for r in pii.find_pii(df).collect() for s in r["spans"] if s["kind"] == 4}
    assert got == want == {f"nick{i}" for i in range(3)}  # nick3 stands alone too often


def test_near_copies_reveal_nothing(spark):
    base = [f"unique{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :], "mail amy@corp.com"])) for i in range(6)] + [(100 + i, f"other text number{i} of the corpus") for i in range(600)]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.filter("exists(spans, s -> s.kind = 4)").count() == 0


def test_viterbi_with_bytes_and_marks():
    pieces = [("▁", -3.0), ("a", -2.0), ("ab", -2.5), ("▁a", -3.5), ("bab", -5.0)]
    model = {"pieces": [(i, p, s) for i, (p, s) in enumerate(pieces)], "bytes": {v: 100 + v for v in range(256)}, "unknown": 99}
    codec = sentencepiece.Codec(model)
    table = {p: s for p, s in pieces}

    def top(text):
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max([best[end - n] + table[text[end - n : end]] for n in (1, 2, 3) if n <= end and text[end - n : end] in table] + [best[end - 1] + codec.worst]))
        return best[-1]

    rnd = random.Random(9)
    for _ in range(300):
        text = "".join(rnd.choice("abcé▁") for _ in range(rnd.randint(1, 14)))
        ids, total, at = codec.viterbi(text), 0.0, 0
        while at < len(ids):
            if ids[at] < 99:
                total, at = total + table[pieces[ids[at]][0]], at + 1
            else:  # a character in byte pieces
                total, at = total + codec.worst, at + (1 if ids[at] - 100 < 128 else 3 if ids[at] - 100 >= 224 else 2)
        assert total == pytest.approx(top(text)), text
        assert codec.decode(codec.encode(text)) == text


def test_rows_that_are_drawn_alike(spark):
    rows = [(1, "one two three")] * 3000 + [(2, "four five")] * 10 + [(None, "six")] * 500
    df = spark.createDataFrame([(i, t, "a" if i else "b") for i, t in rows], "doc_id long, text string, source string")
    first, second = (sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in mixing.mix_sources(df).collect()) for _ in range(2))
    assert first == second and len(first) == 3510
    target = {r["source_size"]: r["target"] for r in mixing.mix_sources(df).collect()}
    for size, want in target.items():
        assert abs(sum(t for i, _, t in first if (i == 0) == (size == 500)) - want) <= 0.5
    stage = dict(corpus_pipeline.STAGES)["source_mixture"]
    out = stage(spark, df.withColumns({"lang": F.lit("en"), "n_chars": F.lit(1).cast("long")}), "")
    assert abs(out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] - sum(t for *_, t in first)) <= 2


def test_every_stage_takes_a_very_long_text(spark):
    long = " ".join(f"word{i % 5000}" for i in range(150_000))
    df = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long + " end", "en", "a", 1), (3, "short text of words", "en", "b", 1)], corpus_pipeline_schema())
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [1, 3]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, "").count() >= 2, name


def test_toxicity_of_many_texts_by_single_lookups():
    """Words told apart and looked up by arrays, as by regular expression and one n-gram at a time; equal ones are equal."""
    draw = random.Random(3)
    letters = "abcdeioust" + "éüñßﬁİ" + "中文字" + "𐐀𐐨" + "²½٣_-1 . \x1c\x85  \n"
    texts = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 5, 39, 40, 41, 80, 81, 300]))) for _ in range(600)]
    texts += [None, "", "idiot" * 30, "x" * 40, "12 _ 3"]
    names = sorted({g for t in texts[:300] for w in toxicity.words_of(t) for p in toxicity.spelled(w) for g in toxicity.grams(p)})
    own = {g: draw.uniform(-2, 2) for g in names if draw.random() < 0.7}
    other = {h: draw.uniform(-2, 2) for h in sorted({g[:-1] for g in names}) if draw.random() < 0.7}

    def one(word):
        total = sum((own[g] if g in own else other.get(g[:-1], 0.0)) for p in toxicity.spelled(word) for g in toxicity.grams(p))
        return total / (len(word) + 1)

    evidence = toxicity.Evidence((own, other))
    found = list(evidence.of_texts(texts))
    assert len(found) == len(texts) and list(evidence.of_texts([])) == []
    for text, (each, lengths) in zip(texts, found, strict=True):
        words = toxicity.words_of(text)
        assert lengths.tolist() == [len(w) + 1 for w in words]
        assert each.tolist() == pytest.approx([one(w) for w in words], abs=1e-12)
    none = toxicity.Evidence(({}, {}))
    assert none(["word", "x"]) == [0.0, 0.0]


def held_mb() -> float:
    """MB of this process without mapped files."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(line.split()[1]) for line in f if line.startswith(("Pss_Anon", "Pss_Shmem"))) / 1024


def test_workers_give_freed_memory_back():
    """What a worker holds between stages is what it remembers, not what Arrow and the C library kept for later."""

    def run(batches):
        for _ in batches:
            rows = [pa.array(np.arange(k % 4000 + 1)) for k in range(20_000)]
            out = pa.record_batch([pa.array([x.nbytes for x in rows])], ["n"])
            del rows
            yield out

    before = held_mb()
    assert sum(b.num_rows for b in tidy(run)([1, 2])) == 40_000
    assert held_mb() < before + 60
    work = tidy(run)([1, 2])
    next(work)
    work.close()  # a task that ends early
    assert held_mb() < before + 60
