"""Secret scans with built-in functions only.

Known formats: a regular expression's matches and the pieces between them (a split) give every match's offset in
code points. Unknown formats: a candidate is a run of key characters; a window slides over it, and the Shannon entropy
of the window follows from counts that each step changes by one character in and one out. A candidate's class (hex, mixed)
sets the window and the entropy that a secret has at least; the span reaches from its first to its last such window.
Spans of known formats, words of a path (three letters or more, up to a slash) and placeholders are cut out of a candidate, and each piece that
is left is a candidate of its own, unless it is a number, words or dates as a whole; a piece shorter than a window has none.

Defined cases: a null or empty text has no spans (an empty array); equal rows get equal spans; an empty table gives an
empty table; other columns pass through (see `aside` for names that clash). Texts are scanned whole, in time in proportion to their length and matches
(arrays and strings are put together in blocks).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import aside, let, running, spliced

#: Known formats (kind, pattern, group whose length counts, its least length), in the order in which spans of equal start are listed.
FORMATS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Classes of candidates (name, pattern of the whole candidate, its alphabet, window, least entropy in bits); the first that fits counts.
CLASSES = [
    ("hex", r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 20, 2.8),
    ("mixed", r"^[A-Za-z0-9+/_=-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 20, 3.6),
]
#: Candidates that are no secrets: numbers, words without digits, dates and dashed words, paths, placeholders.
ALLOWED = [r"^[0-9_=+/-]+$", r"^[A-Za-z_=+/-]+$", r"^[a-z]+([-_/][a-z]+)*[-_/]?[0-9]{0,8}$", r"^/", r"/[a-z]+/", r"(?i)example|placeholder|sample|dummy|x{6}"]

#: Of these, patterns of whole candidates hold for whole pieces; the others name parts, which are cut out: words of a path, placeholders.
WHOLE = r"^\^.*\$$"
PARTS = r"(?<![^/])[A-Z]?[a-z]{3,}(?=/)|(?i:example|placeholder|sample|dummy|x{6,})"
LEAST = 20


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs (start, end, match); code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:int,end:int,match:string>>"

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda p: F.length(p["before"]) + F.length(p["match"])), lambda a, b: a + b, F.lit(0), "int")
        start = lambda p, at: at + F.length(p["before"])
        return F.zip_with(pairs, before, lambda p, at: F.struct(start(p, at).alias("start"), (start(p, at) + F.length(p["match"])).alias("end"), p["match"].alias("match")))

    def paired(m: Column) -> Column:
        pairs = F.zip_with(F.split(text, pattern, -1), m, lambda a, x: F.struct(F.coalesce(a, F.lit("")).alias("before"), x.alias("match")))
        return F.when(F.size(m) > 0, let(F.filter(pairs, lambda p: p["match"].isNotNull()), placed).cast(kind)).otherwise(F.array().cast(kind))

    return let(matches, paired)


def pieces(c: Column) -> Column:
    """What is left of a candidate outside named parts, where that is at least LEAST long; as structs (start, end, match)."""
    kind = "array<struct<start:int,end:int,match:string>>"

    def around(named: Column) -> Column:
        last = F.struct(F.length(c["match"]).alias("start"), F.length(c["match"]).alias("end"))
        cuts = F.concat(F.transform(named, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.array(last))
        gaps = F.zip_with(cuts, F.concat(F.array(F.lit(0)), F.transform(named, lambda s: s["end"])), lambda s, at: F.struct(at.alias("at"), (s["start"] - at).alias("n")))
        return F.transform(F.filter(gaps, lambda g: g["n"] >= LEAST), lambda g: F.struct((c["start"] + g["at"]).alias("start"), (c["start"] + g["at"] + g["n"]).alias("end"), F.substring(c["match"], g["at"] + 1, g["n"]).alias("match")))

    return let(found(c["match"], PARTS), around).cast(kind)


def entropic(word: Column, alphabet: str, window: int, least: float) -> Column:
    """First and last window start (from 0) whose entropy is at least `least`; first is -1 if none."""
    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def step(codes: Column, s: Column, i: Column) -> Column:
        into, out = codes[i - 1], F.when(i > window, F.get(codes, i - window - 1)).otherwise(F.lit(0))
        before_in, before_out = F.get(s["counts"], into - 1), F.get(s["counts"], out - 1)
        gain = F.when(into == out, 0.0).otherwise(weight(before_in + 1) - weight(before_in) + F.when(out > 0, weight(before_out - 1) - weight(before_out)).otherwise(0.0))
        total = s["total"] + gain
        good = (i >= window) & (F.lit(window).cast("double") * (F.log2(F.lit(float(window))) - F.lit(least)) + 1e-9 >= total)
        return F.struct(
            F.transform(s["counts"], lambda c, k: c + F.when(k == into - 1, 1).otherwise(0) - F.when(k == out - 1, 1).otherwise(0)).alias("counts"),
            total.alias("total"),
            F.when(good & (s["first"] < 0), i - window).otherwise(s["first"]).alias("first"),
            F.when(good, i - window).otherwise(s["last"]).alias("last"),
        )

    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    places = F.transform(F.split(word, ""), lambda x: F.instr(F.lit(alphabet), x))
    return let(places, lambda codes: F.aggregate(F.sequence(F.lit(1), F.length(word)), zero, lambda s, i: step(codes, s, i), lambda s: F.struct(s["first"], s["last"])))


def scanned(docs: DataFrame, text_col: str = "text", formats=FORMATS, classes=CLASSES, allowed=ALLOWED) -> DataFrame:  # noqa: ANN001
    """All columns of docs, and tw_known (spans of known formats) and tw_spans (all): arrays of (start, order, end, kind), by start, then kind as listed."""
    added = ["tw_known", "tw_spans"]
    docs, (text_col,) = aside(docs, added, text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(plain.columns[docs.columns.index(text_col)]), F.lit(""))
    span = lambda start, order, end, kind: F.struct(start.cast("int").alias("start"), F.lit(order).alias("order"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))

    def listed(order: int, kind: str, pattern: str, group: int, least: int) -> Column:
        secret = lambda m: F.regexp_extract(m["match"], pattern, group) if group else m["match"]
        return F.transform(F.filter(found(text, pattern), lambda m: F.length(secret(m)) >= least), lambda m: span(m["start"], order, m["end"], kind))

    # one step for each: the analyzer resolves nested lambdas level by level, and stops at a hundred
    out, each = plain, [f"known{order}" for order in range(len(formats))]
    for name, (order, told) in zip(each, enumerate(formats), strict=True):
        out = out.withColumn(name, listed(order, *told))
    out = out.withColumn("known", F.array_sort(F.concat(*each)))
    # known spans become blanks of their length, which are no key characters: what is left beside them is a candidate of its own
    blank = spliced(text, F.col("known"), lambda n, _: F.repeat(F.lit(" "), F.greatest(n, F.lit(0))))
    out = out.withColumn("blank", blank).withColumn("runs", found(F.col("blank"), CANDIDATE))
    out = out.withColumn("candidates", F.flatten(F.transform("runs", pieces)))
    whole = [p for p in allowed if re.match(WHOLE, p)]
    out = out.withColumn("candidates", F.filter("candidates", lambda c: ~_any([c["match"].rlike(p) for p in whole])))

    def reach(word: Column, alphabet: str, window: int, least: float) -> Column:
        return let(entropic(word, alphabet, window, least), lambda r: F.struct(r["first"].alias("first"), (r["last"] + window).alias("last")))

    def judged(c: Column) -> Column:
        result = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        for _, pattern, alphabet, window, least in reversed(classes):
            result = F.when(c["match"].rlike(pattern), reach(c["match"], alphabet, window, least)).otherwise(result)
        return F.struct(c["start"].alias("at"), result.alias("run"))

    hits = F.filter(F.transform("candidates", judged), lambda x: x["run"]["first"] >= 0)
    more = F.transform(hits, lambda x: span(x["at"] + x["run"]["first"], len(formats), x["at"] + x["run"]["last"], "entropy"))
    out = out.withColumn("more", F.when(F.size("candidates") > 0, more).otherwise(F.filter(F.col("known"), lambda s: F.lit(False))))
    return out.select(*plain.columns, "known", F.array_sort(F.concat("known", "more"))).toDF(*docs.columns, *added)


def _any(tests: list[Column]) -> Column:
    result = F.lit(False)
    for t in tests:
        result = result | t
    return result


def redacted(scans: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The text with each run of overlapping or touching spans replaced by the mask; a null text stays null."""
    return scans.withColumn(text_col, spliced(F.col(text_col), F.col("tw_spans"), lambda _, fresh: F.when(fresh, F.lit(mask)).otherwise(F.lit(""))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("tw_known", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("tw_known")), 256).alias("base_sha256"), joined(F.col("tw_spans")).alias("spans"))
