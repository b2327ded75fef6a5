"""The corpus operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import embedding_dedup, jaccard_join, language_id, media, mixing, pii, quality, sentencepiece, toxicity, url_filter
from coppice.llm.buckets import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with the names that operators use inside.
CLASHES = ["id", "key", "item", "size", "label", "_text", "spans", "features", "bucket", "block", "_found", "range"]


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, one of no letters, a very long one, repeated rows, a null id and a null source."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "  12 %%", None), (4, long, "b"), (5, "one two three four five six", "b"), (5, "one two three four five six", "b"), (None, "a null id text here", "b"), (6, "x" * 50_000, "c")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [(1, "x", "a")]).filter("doc_id < 0")


def test_jaccard_join_against_all_pairs(spark):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, base = [], []
    for i in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(3, 120)) if i % 3 or not base else list(rnd.choice(base))
        if not i % 3 and len(words) > 20:
            words[rnd.randrange(len(words))] = "changed"
        base.append(words)
        rows.append((i, " ".join(words), "a"))
    rows += [(100, rows[7][1], "a"), (101, "!!", "a"), (102, "!!", "a"), (103, None, "a")]
    got = {r["doc_id"]: r for r in jaccard_join.ngram_jaccard_join(documents(spark, rows)).collect()}
    shingles = jaccard_join.Shingles()
    sets = {i: set(shingles(t).tolist()) for i, t, _ in rows}
    near = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(n) for i, n in near.items()}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (i == min(seen))
    assert got[100]["class_id"] == 7


def test_large_nodes_lose_no_pair(spark, monkeypatch):
    """Nodes beyond the limits are split, then cut into blocks: all links of one large group are counted."""
    monkeypatch.setattr(jaccard_join, "LIMIT", 20)
    monkeypatch.setattr(jaccard_join, "LAST_DEPTH", 4)
    monkeypatch.setattr("coppice.llm.buckets.BLOCK", 8)
    text = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(50):
        words = list(text)
        words[i * 4] = f"new{i}"
        rows.append((i, " ".join(words), "a"))
    got = jaccard_join.ngram_jaccard_join(documents(spark, rows)).collect()
    assert {r["n_links"] for r in got} == {49} and {r["component_id"] for r in got} == {0}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in components(edges, "test").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 24))
    x[200:] = x[:100] + r.normal(size=(100, 24)) * 0.05 * r.uniform(0, 4, (100, 1))
    x[50] = x[60]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 24), (402, [float("nan")] * 24), (403, []), (404, [1.0, None]), (405, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("item", F.lit(1)).withColumn("key", F.lit(1))
    got = {q["vec_id"]: q for q in embedding_dedup.embedding_near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(300, dtype=bool)
    links = np.array([got[i]["n_links"] for i in range(300)])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.99 * near.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(400, 406))
    h = embedding_dedup.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


def brute_pii(text):
    text, out = text or "", []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if (True, k == 1 and all(int(v) <= 255 for v in m[0].split(".")), 14 <= len(digits) <= 19 and luhn, 10 <= len(digits) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_against_brute_force(spark):
    rnd = random.Random(3)
    texts = ["", None, "a@b.c_d@e.f", "x@y.z@q.w", "é𝒳 a.b@c-d.e. 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255", "+1 (555) 123-4567 .", "4111 1111 1111 1111 5", "5 4111-1111-1111-1111", "+1-+2 333 444 5555 66", "1" * 3000, "a.b" * 3000 + "@c.d", "@" * 2000]
    for alphabet in ("a1.2@+- (%)4_é", "41 -", "41 -.()+"):
        texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 100))) for _ in range(300)]
    df = documents(spark, [(i, t, "a") for i, t in enumerate(texts)])
    for r in pii.pii_report(df).collect():
        want = brute_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
        assert r["n_email"] == want.count("email:") and r["n_phone"] == want.count("phone:")


def test_revealing_terms_are_removed(spark):
    rows = [(i, f"line{i} zorbly sits near bob@corp.com all day number{i}", "a") for i in range(6)]
    rows += [(10 + i, f"Zorbly alone {i}", "a") for i in range(2)] + [(100 + i, f"common sits near words all day {i}", "a") for i in range(500)]
    copies = [(900 + i, "copied text beside amy@corp.com stays whole", "a") for i in range(50)]
    out = {r["id"]: r for r in pii.find_pii(documents(spark, rows + copies), with_text=True).collect()}
    assert out[0]["text"] == "line0 [TERM] sits near [EMAIL] all day number0"
    assert out[10]["text"] == "[TERM] alone 0" and out[10]["base"] == []
    assert out[100]["text"] == rows[8][1] and out[900]["text"] == "copied text beside [EMAIL] stays whole"


def test_copies_do_not_hide_a_revealing_term(spark):
    rows = [(i, f"line{i} zorbly sits near bob@corp.com all day number{i}", "a") for i in range(6)]
    rows += [(50 + i, rows[0][1], "a") for i in range(50)] + [(200 + i, f"common sits near words all day {i}", "a") for i in range(900)]
    out = {r["id"]: r for r in pii.find_pii(documents(spark, rows), with_text=True).collect()}
    assert out[0]["text"] == out[60]["text"] == "line0 [TERM] sits near [EMAIL] all day number0"


def test_terms_within_the_entity_are_removed(spark):
    rows = [(i, f"line{i} smith wrote from alice.smith@corp.com and joe@corp.com on number{i}", "a") for i in range(6)]
    rows += [(200 + i, f"common wrote from words and on {i}", "a") for i in range(900)]
    out = {r["id"]: r for r in pii.find_pii(documents(spark, rows), with_text=True).collect()}
    assert out[0]["text"] == "line0 [TERM] wrote from [EMAIL] and [EMAIL] on number0"
    plain = pii.with_plain(pii.with_base_spans(documents(spark, [(1, "é to +1.2.3.4.5.6.7.8.9.10@x.yz now", "a")]))).first()
    assert plain["_plain"] == "é to" + " " * 28 + "now"


def test_overlapping_spans_are_generalised_once(spark):
    df = documents(spark, [(1, "to +1.2.3.4.5.6.7.8.9.10@x.yz now", "a")])
    text = pii.find_pii(df, with_text=True).first()["text"]
    assert text.startswith("to [") and text.endswith(" now") and "x.yz" not in text


def test_mixing_budgets(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randint(0, 40), "abcd"[min(3, i // 10)]) for i in range(200)] + [(900, "tiny", None), (901, None, "e")]
    df = documents(spark, rows)
    a, b = (sorted(mixing.mix_sources(df).collect(), key=lambda r: r["doc_id"]) for _ in range(2))
    assert a == b
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    per, target = {}, {}
    for r, (i, _, s) in zip(a, rows):
        assert r["size"] == sizes[i] and r["taken"] <= 3 * r["size"]
        per[s] = per.get(s, 0) + r["taken"]
        target[s] = r["target"]
    total = sum(sizes.values())
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(per[s] - target[s]) <= 0.5 for s in per)
    source = {s: sum(sizes[i] for i, _, q in rows if q == s) for s in per}
    assert all(target[s] <= 3 * source[s] + 1e-9 for s in per)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    free = [(target[s] / (i % 3 + 1)) for i, s in enumerate(order) if target[s] < 3 * source[s] - 1e-9]
    assert max(free) - min(free) < 1e-6 * max(free)
    mixed = mixing.apply_mix(df, mixing.mix_sources(df))
    assert mixed.columns == df.columns
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(per.values())


def test_sentencepiece_is_optimal_and_exact(spark, odd):
    pieces = [(i, p, s) for i, (p, s) in enumerate([("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -2.5), ("▁a", -3.5), ("bab", -5.0), ("aba", -1.5)])]
    codec = sentencepiece.Codec({"pieces": pieces, "bytes": {v: 100 + v for v in range(256)}, "unknown": 99})
    table = {p: s for _, p, s in pieces}

    def best(text):
        top = [0.0]
        for end in range(1, len(text) + 1):
            options = [top[end - n] + table[text[end - n : end]] for n in range(1, 4) if n <= end and text[end - n : end] in table]
            top.append(max([*options, top[end - 1] + codec.worst]))
        return top[-1]

    scores = {i: s for i, _, s in pieces}
    rnd = random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choice("ab c▁") for _ in range(rnd.randint(0, 15)))
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        if "▁" not in text and "c" not in text and text:
            assert sum(scores[i] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁")))
    rows = sentencepiece.encode_documents(odd, [odd["doc_id"]], digests=True).collect()
    assert all(r["exact"] for r in rows) and len(rows) == 8
    ids = sentencepiece.encode_documents(odd, [odd["doc_id"]])
    texts = sorted(r["text"] for r in sentencepiece.decode_documents(ids, [ids["doc_id"]]).collect())
    assert texts == sorted(r["text"] or "" for r in odd.collect())


def test_media_round_trip_and_alignment(spark, odd):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in media.media_documents(odd).collect():
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-16:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    page = "<p>one</p><figure><img src='sha256:aa' alt='old'><figcaption>new <b>caption</b></figcaption></figure><script>no</script>two<img src='b.png' alt='plain'><p>three"
    items = media.parse_items(page)
    assert [(i["position"], i["kind"], i["text"]) for i in items] == [(0, "text", "one"), (1, "image", "new caption"), (2, "text", "two"), (3, "image", "plain"), (4, "text", "three")]
    assert items[1]["digest"] == "aa" and media.parse_items(None) == [] and media.parse_items("<p") is not None
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("aa", b"payload")], "digest string, media binary")
    rows = media.resolve(media.sequences(pages, "page_id", "html"), store).orderBy("position").collect()
    assert [bytes(r["media"]) if r["media"] else None for r in rows] == [None, b"payload", None, None, None]
    with pytest.raises(ValueError):
        media.decode_media(media.encode_media(b" " * 192)[:-20] + b"0" * 20)


def held_out_accuracy(scored, label, threshold):
    rows = scored.filter(f"held_out and {label} is not null").select((F.col("score") >= threshold).cast("int").alias("p"), label).collect()
    return sum(r["p"] == r[label] for r in rows) / len(rows)


def test_learned_operators_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    keep = [docs["doc_id"]]
    tox = toxicity.score_toxicity(docs, toxicity.fit(docs, labels.filter(~toxicity.held_out())), [*keep, toxicity.held_out().alias("held_out")])
    assert held_out_accuracy(tox.join(labels, "doc_id", "left"), "toxic", 0.5) > 0.85
    good = quality.score_quality(docs, quality.fit(docs, labels.filter(~quality.held_out())), [*keep, quality.held_out().alias("held_out")])
    assert held_out_accuracy(good.join(labels, "doc_id", "left"), "quality", 0.7) > 0.9
    lang = language_id.identify_language(docs, language_id.fit(docs.filter(~language_id.held_out())), [*keep, docs["lang"], language_id.held_out().alias("held_out")])
    assert lang.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_kneser_ney_prefers_toxic_words():
    rows = {}
    for word, toxic, ordinary in (("idiot", 30, 0), ("ideal", 10, 60), ("the", 50, 500), ("then", 10, 90)):
        for piece in toxicity.spelled(word):
            for g in toxicity.grams(piece):
                t, o = rows.get(g, (0, 0))
                rows[g] = (t + toxic, o + ordinary)
    model = toxicity.Model([(g, t, o, t + o) for g, (t, o) in rows.items()])
    e = {w: model.evidence(w, {}) for w in ("idiot", "ideal", "the", "zzz")}
    assert e["idiot"] > 0.4 > e["ideal"] and abs(e["the"]) < 0.4
    # both classes share the backoff, so the probabilities of what may follow a history add up to at most one
    assert sum(model.shared("id" + c) for c in "abcdefghijklmnopqrstuvwxyz") <= 1 + 1e-9


def test_toxic_ratios_count_every_word_of_the_corpus(spark):
    """Words seen once, in no labelled row, take part in the backoff: the joins agree with the model in memory."""
    rnd = random.Random(8)
    texts = [(" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9))) for _ in range(12)) + (" idiot" if i % 2 else ""), i % 2 if i < 60 else None) for i in range(120)]
    texts += [("x" * 100, 1), ("unique once idiom", None), (None, 0)]
    rows = {}
    for text, label in texts:
        for word in set(toxicity.words_of(text)):
            for piece in toxicity.spelled(word):
                for g in toxicity.grams(piece):
                    t, o, n = rows.get(g, (0, 0, 0))
                    rows[g] = (t + (label == 1), o + (label == 0), n + 1)
    model = toxicity.Model([(g, *r) for g, r in rows.items()])
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    evidence = toxicity.Evidence(toxicity.collected(toxicity.gram_ratios(docs.filter("label is not null"), docs)))
    words = {w for text, _ in texts for w in toxicity.words_of(text)} | {"unseen", "idiots"}
    assert evidence(["idiot"])[0] > 0.3
    for w in words:
        assert evidence([w])[0] == pytest.approx(model.evidence(w, {}), abs=1e-9), w


def test_url_rules_segments_and_bayes(spark):
    urls = ["https://a.org/x", "http://A.Example.ORG/es/1?q", "https://example.org/en/12", "http://x.com/fr/", "http://x.com/frx", "ftp://com/de/1#f", "no url", None, "://", "http://a.org", "x://y://z/p", "http://notorg/x"]
    df = spark.createDataFrame([(i, u, f"<p>casino win the {i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("score", F.lit(1)).withColumn("host", F.lit(1))

    def brute(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(n, v) for v, n in url_filter.RULES if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith(n[n.index("/") :])]
        return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))

    out = {r["page_id"]: r for r in url_filter.filter_urls(df, url_filter.fit(df)).collect()}
    for i, u in enumerate(urls):
        host, path, (rule, verdict) = brute(u)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule), u
        assert out[i]["verdict"] == verdict if verdict else out[i]["verdict"] in ("allow", "block")
    segment = url_filter.Segmenter({"casino": 50, "win": 50, "the": 500})
    assert segment("casinowin") == ["casino", "win"] and segment("thexq") == ["the", "xq"] and segment("") == []


def test_language_sample_is_not_thinned_by_copies(spark):
    rows = [(f"text {'abcdefghij'[i % 10] * (i // 10 + 1)}", "en") for i in range(100)] + [("one copied text", "en")] * 9900 + [(f"{i}", "en") for i in range(5000)]
    x, langs = language_id.sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 60)
    assert len(langs) > 40


def test_odd_rows_keep_a_result_each(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    keep = [odd["doc_id"]]
    results = {
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit(d, labels), [d["doc_id"]]),
        "quality": lambda d: quality.score_quality(d, quality.fit(d, labels), [d["doc_id"]]),
        "pii": pii.pii_report,
        "jaccard": jaccard_join.ngram_jaccard_join,
        "mix": mixing.mix_sources,
        "language": lambda d: language_id.identify_language(d, language_id.fit(d), [d["doc_id"]]),
    }
    assert keep
    for name, f in results.items():
        assert f(odd).count() == 8, name
        assert f(empty).count() == 0, name
    assert media.media_documents(empty).count() == 0
    assert sentencepiece.encode_documents(empty, [empty["doc_id"]]).count() == 0
    assert embedding_dedup.embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(pages, url_filter.fit(pages)).count() == 0
    und = {r["doc_id"]: r["lang_pred"] for r in results["language"](odd).collect()}
    assert [und[i] for i in (1, 2, 3)] == ["und"] * 3
