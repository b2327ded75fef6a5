"""Personal data: exact base patterns, then information-theoretic sanitisation; DataFrame functions only.

Base spans of four kinds come from regular expressions. Corpus co-occurrence then estimates which terms reveal a
protected entity (the value of a base span): over whole texts, each different text counting once, a term's disclosure is
the share of the texts with it that hold the entity, and its information is log2 of that share over the share of all
texts that hold the entity. Texts must bear the term out on their own: near copies of one text are no evidence, so the
texts that hold both must share little (see INDEPENDENT). Terms over all three thresholds are spans of the kind `term`,
wherever they occur.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns, tightened so that no match needs a second try: possessive, and anchored where a run of the first
#: class begins (or the last match ended). Runs of other lengths than a card's 14 to 19 digits never match as one.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_octet = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
IP = rf"^{_octet}(?:\.{_octet}){{3}}$"
TERM = r"[\p{L}\p{N}]{3,}+"
#: Thresholds: share of the term's texts, bits of information.
SHARE, BITS = 0.5, 5.0
#: Least effective number of texts with term and entity: one over the chance that two of them, drawn with repetition,
#: agree in a minwise value of their words. k unrelated texts count as k, any number of near copies as hardly more than 1.
INDEPENDENT = 1.5
#: Minwise values of a text, over which that chance is averaged.
MINS = 8
#: What a span is generalised to. A term is removed down to this mark.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def with_prefixes(df: DataFrame, values: str, name: str, fold) -> DataFrame:
    """df with a column: fold from 0 of all values before each one of an array column, in blocks of about the square
    root of their number, so that a text with many matches does not take quadratic time. fold: addition or maximum."""
    v, step = F.col(values), F.col("_step")

    def total(x):
        return F.aggregate(x, F.lit(0), fold)

    df = df.withColumn("_step", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")))
    df = df.withColumn("_blocks", F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda b: total(F.slice(v, b * step + 1, step)))))
    df = df.withColumn("_starts", F.transform("_blocks", lambda _, i: total(F.slice("_blocks", F.lit(1), i))))
    at = lambda i: F.floor(i / step).cast("int")
    out = F.transform(v, lambda _, i: fold(F.get("_starts", at(i)), total(F.slice(v, at(i) * step + 1, i % step))))
    return df.withColumn(name, out).drop("_step", "_blocks", "_starts")


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def with_matches(df: DataFrame, name: str, pattern: Column, holds: Column, kind: int) -> DataFrame:
    """df with a column of (start, kind, end, value), in code points, of the leftmost non-overlapping matches in its
    column text; empty unless holds. Each step is a column of its own, so that nothing is matched or summed twice."""
    text = F.col("text")
    df = df.withColumn("_found", F.when(holds, F.regexp_extract_all(text, pattern, F.lit(0))))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(text, pattern, -1)))
    df = df.withColumn("_steps", F.zip_with(F.slice("_gaps", F.lit(1), F.size("_found")), "_found", lambda g, m: F.length(g) + F.length(m)))
    df = with_prefixes(df, "_steps", "_before", lambda a, v: a + v)
    df = df.withColumn("_ends", F.zip_with("_before", "_steps", lambda a, b: a + b))
    spans = F.zip_with("_ends", "_found", lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value")))
    df = df.withColumn(name, F.coalesce(F.when(F.size("_found") > 0, spans), F.array().cast(SPANS)))
    return df.drop("_found", "_gaps", "_steps", "_before", "_ends")


def luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    digits = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 10 == 0


def with_base_spans(df: DataFrame) -> DataFrame:
    """df (with a column text) and its column spans: the valid base spans of all kinds, by start, then kind."""
    text = F.col("text")
    holds = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        "phone": F.contains(text, F.lit("+")),
    }
    for k in KINDS[:-1]:
        df = with_matches(df, f"_{k}", F.lit(PATTERNS[k]), holds[k], KINDS.index(k))

    def digits(v):
        return F.length(F.regexp_replace(v, "[^0-9]", ""))

    valid = [
        F.col("_email"),
        F.filter("_ip", lambda s: s["value"].rlike(IP)),
        F.filter("_card", lambda s: luhn(s["value"])),
        F.filter("_phone", lambda s: digits(s["value"]).between(10, 15)),
    ]
    return df.withColumn("spans", F.array_sort(F.concat(*valid))).drop(*(f"_{k}" for k in KINDS[:-1]))


def with_plain(df: DataFrame) -> DataFrame:
    """df with _plain: its text, with as many blanks in the place of each span, so that no piece of one is a word."""
    text, spans = F.col("text"), F.col("spans")
    df = df.withColumn("_all_ends", F.transform(spans, lambda s: s["end"]))
    df = with_prefixes(df, "_all_ends", "_reach", lambda a, v: F.greatest(a, v))

    def piece(s, e):
        between = F.substring(text, e + 1, F.greatest(F.lit(0), s["start"] - e))
        return F.concat(between, F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], e))))

    whole = F.concat(F.array_join(F.zip_with(spans, "_reach", piece), ""), F.substring(text, F.array_max("_all_ends") + 1, F.length(text)))
    return df.withColumn("_plain", F.when(F.size(spans) == 0, text).otherwise(whole)).drop("_all_ends", "_reach")


def entities() -> Column:
    """The different values of a row's spans, lower-cased."""
    return F.array_distinct(F.transform("spans", lambda s: F.lower(s["value"])))


def revealing_terms(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """(term): those over the disclosure thresholds. facts: (text_key, entities) of every row of the corpus; rows: its
    (text_key, text, plain), where plain is the text without its spans. All counts are of different texts."""
    total = max(1, facts.select("text_key").distinct().count())
    held = facts.filter(F.size("entities") > 0).dropDuplicates(["text_key"]).select("text_key", F.explode("entities").alias("entity"))
    # An entity of one text has no second one to bear it out; one of too many cannot reach the bits.
    holders = held.groupBy("entity").agg(F.count("*").alias("holders")).filter((F.col("holders") > 1) & (F.col("holders") <= total / 2**BITS))
    held = save(held.join(holders, "entity"), "pii-held")
    empty = held.select(F.col("entity").alias("term")).limit(0)
    if held.isEmpty():
        return empty
    # Terms of the texts that hold such an entity, in two of these or more. The share then rules out common words.
    beside = rows.join(small(held.select("text_key").distinct()), "text_key", "left_semi").dropDuplicates(["text_key"])
    words = save(words_of(beside, F.col("plain"), "text_key").distinct(), "pii-words")
    most = words.groupBy("term").agg(F.count("*").alias("beside")).filter("beside > 1")
    terms = save(most, "pii-terms-beside")

    def counted(texts, terms):
        """terms with their number of texts, if it lets them reach the share and the bits with some entity."""
        found = words_of(texts, F.col("text"), "text_key").join(small(terms), "term").groupBy("term", "text_key").agg(F.max("beside").alias("beside"))
        found = found.groupBy("term").agg(F.count("*").alias("documents"), F.max("beside").alias("beside"))
        return found, (F.col("beside") >= SHARE * F.col("documents")) & (F.col("documents") <= total / 2**BITS / SHARE)

    # A term has at least the texts that a part of the corpus shows: too many there are too many in all. So common words
    # are ruled out before those of the whole corpus are dealt out by term.
    part, rare = counted(rows.filter(F.pmod(F.xxhash64("text_key"), F.lit(16)) == 0), terms)
    terms = save(terms.join(part.filter(~rare).select("term"), "term", "left_anti"), "pii-terms-rare")
    seen, rare = counted(rows, terms)
    seen = save(seen.filter(rare), "pii-seen")
    pairs = words.join(small(seen.select("term", "documents")), "term").join(held, "text_key")
    found = pairs.groupBy("term", "entity").agg(F.count("*").alias("texts"), F.max("documents").alias("documents"), F.max("holders").alias("holders"))
    share = F.least(F.lit(1.0), F.col("texts") / F.col("documents"))
    bits = F.log2(share / (F.col("holders") / F.lit(total)))
    found = save(found.filter((F.col("texts") > 1) & (share >= SHARE) & (bits >= BITS)), "pii-pairs")
    if found.isEmpty():
        return empty
    # Are the texts of a pair near copies of each other? By the minwise values that they share.
    mins = F.array(*(F.min(F.xxhash64("term", F.lit(j))) for j in range(MINS)))
    values = words.groupBy("text_key").agg(mins.alias("mins"))
    each = pairs.join(small(found.select("term", "entity")), ["term", "entity"], "left_semi").select("term", "entity", "text_key")
    each = each.join(values, "text_key").select("term", "entity", F.posexplode("mins").alias("j", "value"))
    agree = each.groupBy("term", "entity", "j", "value").agg(F.count("*").alias("n")).groupBy("term", "entity", "j").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("agree"))
    return agree.groupBy("term", "entity").agg(F.avg("agree").alias("agree")).filter(F.col("agree") <= 1 / INDEPENDENT).select("term").distinct()


#: Characters in all that a table may have to be broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 16 << 20


def small(table: DataFrame) -> DataFrame:
    """table (saved, or cheap to run), to be broadcast if its values are counted to be few and short enough."""
    sizes = table.select(sum((F.length(F.to_json(F.struct(c))) for c in table.columns), F.lit(0)).alias("n"))
    return F.broadcast(table) if (sizes.agg(F.sum("n")).first()[0] or 0) <= MOST_BROADCAST else table


def words_of(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """keep, then the terms of a row's text, lower-cased; some may repeat."""
    found = rows.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("term"))
    return found.withColumn("term", F.lower("term"))


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_key, text) -> (text_key, found): spans of the terms, in order, of each different text that has any."""
    few = small(terms)
    keys = save(words_of(rows, F.col("text"), "text_key").join(few, "term", "left_semi").select("text_key").distinct(), "pii-keys")
    texts = rows.join(small(keys), "text_key", "left_semi").dropDuplicates(["text_key"])
    # Words have their places by running sums of the lengths of words and of what stands between them.
    steps = texts.select("text_key", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("_found"), F.split("text", TERM, -1).alias("_gaps"))
    steps = steps.select("text_key", F.posexplode(F.arrays_zip("_gaps", "_found")).alias("_at", "_step")).filter("_step._found is not null")
    upto = Window.partitionBy("text_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("_step._gaps") + F.length("_step._found")).over(upto).cast("int")
    words = steps.select("text_key", end.alias("end"), F.col("_step._found").alias("value"))
    span = F.struct((F.col("end") - F.length("value")).alias("start"), F.lit(KINDS.index("term")).alias("kind"), "end", "value")
    words = words.select("text_key", span.alias("w"))
    hits = words.withColumn("term", F.lower("w.value")).join(few, "term", "left_semi")
    return hits.groupBy("text_key").agg(F.array_sort(F.collect_list("w")).alias("found"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: id (or the columns of keep), base and spans (arrays of start, kind, end, value; code
    points, end exclusive), and text with every span generalised if with_text.

    Null text counts as empty and has no span. Spans are ordered by start, then kind; a term that touches a base span is
    none. Where spans overlap, the text shows the mark of the first and drops the rest of the others. Rows that repeat an
    id or a text get a result each, equal ones for equal texts. An empty table gives no rows.
    """
    kept = [F.col(c).alias(f"_{c}") for c in keep if c != text_col] if keep else [F.col(id_col).alias("id")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*kept, text.alias("text"), F.md5(text.cast("binary")).alias("text_key"))
    names = rows.columns[:-2]
    found = with_base_spans(rows)
    facts = save(found.select(*([] if with_text else names), "text_key", "spans", entities().alias("entities")), "pii-facts")
    plain = with_plain(found).withColumnRenamed("_plain", "plain")
    terms = save(revealing_terms(facts, plain.select("text_key", "text", "plain")), "pii-terms")
    if terms.isEmpty():
        out = (found if with_text else facts).withColumn("base", F.col("spans"))
    else:
        of = save(term_spans(rows.select("text_key", "text"), terms), "pii-of")
        out = (found if with_text else facts).join(small(of), "text_key", "left")
        clear = F.filter("found", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
        out = out.withColumn("base", F.col("spans")).withColumn("spans", F.array_sort(F.concat("spans", F.coalesce(clear, F.array().cast(SPANS)))))
    shown = [F.col(n).alias(n.removeprefix("_")) for n in names]
    if not with_text:
        return out.select(*shown, "base", "spans")
    return with_generalised(out).select(*shown, "base", "spans", F.col("_new").alias("text"))


def with_generalised(df: DataFrame) -> DataFrame:
    """df with _new: its text, with its spans replaced by the marks of their kinds."""
    marks = F.array(*(F.lit(MARKS[k]) for k in KINDS))
    text, spans = F.col("text"), F.col("spans")
    df = df.withColumn("_all_ends", F.transform(spans, lambda s: s["end"]))
    # The furthest end of the spans before each one: what lies between it and the start is kept.
    df = with_prefixes(df, "_all_ends", "_reach", lambda a, v: F.greatest(a, v))
    pieces = F.zip_with(spans, "_reach", lambda s, e: F.when(s["start"] >= e, F.concat(F.substring(text, e + 1, s["start"] - e), marks[s["kind"]])).otherwise(""))
    whole = F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max("_all_ends") + 1, F.length(text)))
    return df.withColumn("_new", F.when(F.size(spans) == 0, text).otherwise(whole)).drop("_all_ends", "_reach")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_pii() as counts and digests: id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    found = find_pii(docs, id_col, text_col)
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:-1]]
    term = count_of(F.col("spans"), "term").alias("n_term")
    return found.select(F.col("id").alias(id_col), *counts, term, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
