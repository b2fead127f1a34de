"""URL filters with built-in functions only.

Each distinct url becomes the expressions host suffix + path prefix that a rule could name: suffixes of the host at a dot, of as many labels as some
rule has, with path prefixes of a length that some rule has. Expressions meet rules by an equi-join on PREFIX hex digits of their
SHA-256 digest; the full digest confirms. Of the rules that fit, the longest (host and path) wins; of equally long ones the one with
the longer host, then block before allow. Distinct urls are judged once, so that a url of a third of all rows is no hot key there; the verdicts
return to rows by a join that adaptive execution can split, and null urls are dealt by their row's id.

Defined cases: a null url, or one without ://, has an empty host and path, no rule, and the verdict of `otherwise`. Rules may repeat.
An empty rule table leaves every row to `otherwise`; an empty table of pages gives an empty table. Other columns of pages pass through (see `aside` for names that clash).
Lengths and label counts of rules are collected to the driver if they are at most MAX_LENGTHS distinct numbers; beyond that every length up to the
longest is tried. Spark broadcasts the rules only below its own size limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import aside, let

PREFIX, MAX_LENGTHS = 8, 4096

#: The rules of the query (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def split(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def sizes(known: DataFrame, size: Column, longest: Column) -> Column:
    """The sizes that rules have, up to `longest`: as a list, if they are at most MAX_LENGTHS; else all numbers up to the greatest."""
    told = sorted(r[0] for r in known.select(size.alias("n")).distinct().limit(MAX_LENGTHS + 1).collect())
    if len(told) <= MAX_LENGTHS:
        return F.filter(F.array(*map(F.lit, told or [0])), lambda n: n <= longest)
    return F.sequence(F.lit(0), F.least(F.lit(known.agg(F.max(size)).first()[0]), longest))


def judged(spark: SparkSession, pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """All columns of pages, and tw_host, tw_path, tw_rule (host + path, null without one), tw_verdict. rules: verdict, host, path."""
    added = ["tw_host", "tw_path", "tw_rule", "tw_verdict"]
    pages, (url_col,) = aside(pages, added, url_col)
    plain = pages.toDF(*[f"c{i}" for i in range(len(pages.columns))])
    url = F.col(plain.columns[pages.columns.index(url_col)])
    known = rules.where("host is not null and path is not null").select("verdict", "host", "path").distinct().withColumn("digest", F.sha2(F.concat("host", F.lit("\n"), "path"), 256))
    urls = plain.where(url.isNotNull()).select(url.alias("url")).distinct()
    urls = urls.withColumns(dict(zip(("u_host", "u_path"), split(F.col("url")), strict=True))).where("u_host <> ''").withColumn("labels", F.split("u_host", r"\."))
    suffixes = F.transform(sizes(known, F.size(F.split("host", r"\.")), F.size("labels")), lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), "."))
    prefixes = F.transform(sizes(known, F.length("path"), F.length("u_path")), lambda n: F.substring("u_path", F.lit(1), n))
    pairs = let(prefixes, lambda own: F.flatten(F.transform(suffixes, lambda h: F.transform(own, lambda p: F.sha2(F.concat(h, F.lit("\n"), p), 256)))))
    expressions = urls.select("url", F.explode(pairs).alias("u_digest")).withColumn("u_key", F.substring("u_digest", 1, PREFIX))
    met = expressions.join(known.withColumn("key", F.substring("digest", 1, PREFIX)), F.col("u_key") == F.col("key")).where(F.col("u_digest") == F.col("digest"))
    order = F.struct(F.length(F.concat("host", "path")), F.length("host"), F.when(F.col("verdict") == "block", 1).otherwise(0))
    best = met.groupBy("url").agg(F.max(F.struct(order.alias("o"), F.concat("host", "path").alias("rule"), "verdict")).alias("best"))
    own = plain.withColumn("key", F.coalesce(url, F.concat(F.lit("\n"), F.monotonically_increasing_id().cast("string"))))
    out = own.join(best, F.col("key") == F.col("url"), "left")
    return out.select(*plain.columns, *split(url), F.col("best.rule"), F.coalesce("best.verdict", F.lit(otherwise))).toDF(*pages.columns, *added)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = judged(spark, pages, spark.createDataFrame(RULES, "verdict string, host string, path string"))
    return found.select("page_id", F.col("tw_host").alias("host"), F.col("tw_path").alias("path"), F.col("tw_rule").alias("rule"), F.col("tw_verdict").alias("verdict"))


OP10_SQL = r"""
with p as (select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(verdict, rhost, rpath) as (values ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
m as (select h.page_id, h.host, h.path, rhost || rpath as rule, verdict,
             row_number() over (partition by h.page_id order by length(rhost || rpath) desc nulls last) as k
      from h left join r on (h.host = rhost or h.host like '%.' || rhost) and starts_with(h.path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1
"""
