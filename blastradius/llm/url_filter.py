"""URL filters: given host/path rules first, mined association rules for the rest. DataFrame functions only.

Spark's FP-growth mines token combinations of labelled URLs whose consequent is the label bad; rules below the given
confidence, gain or support go, and of rules that contain one another only the shortest stays. Every rule stands in
an inverted index under its rarest token; a URL's tokens look their rules up there, and a rule matches if the URL
has all of its tokens.

Tokens that the same labelled URLs have are mined as one item, and each of them stands for it in a URL (column
`alike`), as if there were a rule for every choice among them. Tokens that are rules alone, and tokens of all labelled
URLs, are in no shortest rule of several tokens and aren't combined.

Mining and matching see all tokens of every URL; mining drops those too rare in bad URLs to be part of a rule.
Null url, or one without ://, has empty host and path, no tokens, and is
allowed. Repeated rows, also with equal page_id, are judged each. URLs with contradicting labels count by the mean.
Without labels of both kinds there are no mined rules. Other columns are ignored. Empty input: no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stash

BAD = "=bad"
RULES = "tokens array<string>, anchor string, confidence double, lift double, support double, alike array<struct<token string, stands string>>"


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: host endings, host words, scheme, path words, extension, query names."""
    h, p = host(url), path(url)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    endings = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -F.least(i, F.size(labels)), i), ".")))
    kinds = [
        F.when(F.size(labels) > 0, endings).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(F.split(h, r"[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x)),
        F.array(F.concat(F.lit("s:"), lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        F.transform(F.filter(F.split(F.regexp_replace(p, r"[0-9]+", "0"), r"[/._-]"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)=?[^&]*"), 1), lambda x: F.concat(F.lit("q:"), x)),
    ]
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.array_distinct(F.concat(*kinds))).otherwise(F.array().cast("array<string>"))


def indexed(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("anchor"), F.col("tokens").alias("__need"))


def match(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """url, __need: which rules' tokens each distinct url of rows(url, tokens) has all of, or tokens alike."""
    names = F.broadcast(rules.select(F.explode("alike").alias("__x")).select("__x.token", "__x.stands").distinct())  # frequent tokens only
    has = rows.select("url", F.explode("tokens").alias("token")).join(names, "token").groupBy("url").agg(F.collect_set("stands").alias("__has"))
    found = has.select("url", "__has", F.explode("__has").alias("anchor")).join(indexed(rules), "anchor")
    return found.where(F.size(F.array_except("__need", "__has")) == 0).select("url", "__need")


def gain(share: float, times: float) -> float:
    """The least confidence that counts as a gain over the share of bad URLs: bad is that many times as frequent, or
    good that many times as rare. The latter is below 1 at any share."""
    return min(share * times, 1 - (1 - share) / times)


def mine(labelled: DataFrame, min_support: float = 0.001, min_rows: int = 10, min_confidence: float = 0.5, min_lift: float = 1.5) -> DataFrame:
    """labelled(url, bad 0..1) -> rules(tokens, anchor, confidence, lift, support, alike)."""
    spark = labelled.sparkSession
    per = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.avg("bad").alias("bad"))
    sets = per.select(tokens(F.col("url")).alias("tokens"), (F.col("bad") >= 0.5).alias("bad"), F.xxhash64("url").alias("h1"), F.xxhash64("url", F.lit(1)).alias("h2"))
    sets = stash(sets.where("size(tokens) > 0"), "url-items")
    counts = sets.agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad")).first()
    if not counts["n"] or counts["bad"] in (0, counts["n"]):
        return spark.createDataFrame([], RULES)
    least = min(1.0, max(min_support, min_rows / counts["n"]))
    share = counts["bad"] / counts["n"]
    enough = F.col("confidence") >= max(min_confidence, gain(share, min_lift))
    # a rule for bad with this support needs tokens that often in bad URLs: others can't be part of one
    each = sets.select(F.explode("tokens").alias("t"), F.col("bad").cast("int").alias("bad"), "h1", "h2")
    each = each.groupBy("t").agg(F.sum("bad").alias("c"), F.count("*").alias("all"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")).where(F.col("c") >= math.ceil(least * counts["n"]))
    # tokens of the same rows are one item, named by the first of them
    classes = each.groupBy("c", "all", "h1", "h2").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    classes = stash(classes.select(F.element_at("ts", 1).alias("t"), "ts", "c", "all", (F.col("c") / F.col("all")).alias("confidence")), "url-tokens")
    single = classes.where(enough).select(F.array("t").alias("tokens"), "confidence", (F.col("confidence") / share).alias("lift"), (F.col("c") / counts["n"]).alias("support"))
    # a token that is a rule is in no other shortest rule, and one that every URL has adds nothing to one
    open_ = F.broadcast(classes.where(~enough & (F.col("all") < counts["n"])).select("t", F.col("t").alias("item")))
    rows = sets.select("h1", "h2", "bad", F.explode("tokens").alias("t")).join(open_, "t", "left").groupBy("h1", "h2", "bad").agg(F.collect_list("item").alias("items"))
    items = rows.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence, numPartitions=parts).fit(items.repartition(parts))
    several = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.size("antecedent") > 1) & enough)
    rules = stash(single.unionByName(several.select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support")), "url-rules")
    # the rarest token of a rule among the labelled URLs, and what stands for its tokens
    known = rules.select("tokens", F.explode("tokens").alias("t")).join(classes.select("t", "ts", "all"), "t")
    stands = F.transform("ts", lambda x: F.struct(x.alias("token"), F.col("t").alias("stands")))
    known = known.groupBy("tokens").agg(F.min(F.struct("all", "t"))["t"].alias("anchor"), F.flatten(F.collect_list(stands)).alias("alike"))
    rules = stash(rules.join(known, "tokens").select("tokens", "anchor", "confidence", "lift", "support", "alike"), "url-anchored")
    # a rule that holds another rule's tokens and more says nothing new
    longer = match(rules.select(F.array_join("tokens", "\n").alias("url"), "tokens"), rules).where(F.array_join("__need", "\n") != F.col("url")).select(F.col("url").alias("__u")).distinct()
    return rules.join(longer, F.array_join("tokens", "\n") == F.col("__u"), "left_anti")


def given_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Of (verdict, host, path) rules the longest that fits: as host + path, and its verdict; else null."""
    rule = verdict = F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp)
        rule, verdict = F.when(fits, F.lit(rh + rp)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, given: list[tuple[str, str, str]], mined: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether a mined rule matches)."""
    rows = pages.select("page_id", "url")
    found = match(rows.where("url is not null").select("url").distinct().select("url", tokens(F.col("url")).alias("tokens")), mined).select("url").distinct()
    hit = found.select(F.col("url").alias("__url"), F.lit(True).alias("__mined"))
    rows = rows.join(hit, F.col("url") == F.col("__url"), "left").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.coalesce("__mined", F.lit(False)).alias("mined"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), given)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined")


#: DuckDB: the given rules, and mined rules of one token or of two. Longer ones it has not; on the given tables there are
#: none of any length, and the tests hold mining against an enumeration.
ORACLE = r"""
WITH u AS (SELECT page_id, url, contains(coalesce(url, ''), '://') AS whole, CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
t AS (SELECT DISTINCT url, unnest(list_concat(
  CASE WHEN replace(host, '.', '') = '' THEN [] ELSE list_transform(range(1, len(list_filter(string_split(host, '.'), lambda x: x <> '')) + 1), lambda i: 'h:' || array_to_string(list_filter(string_split(host, '.'), lambda x: x <> '')[-i:], '.')) END,
  list_transform(list_filter(regexp_split_to_array(host, '[.-]'), lambda x: x <> ''), lambda x: 'w:' || x),
  ['s:' || translate(regexp_extract(url, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')],
  list_transform(list_filter(regexp_split_to_array(regexp_replace(path, '[0-9]+', '0', 'g'), '[/._-]'), lambda x: x <> ''), lambda x: 'p:' || x),
  list_transform(regexp_extract_all(regexp_extract(url, '(?s)\?([^#]*)', 1), '([^&=]+)=?[^&]*', 1), lambda x: 'q:' || x))) AS token FROM u WHERE whole),
l AS (SELECT doc_id, 1 - avg(quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
b AS (SELECT url, avg(bad) >= 0.5 AS bad FROM (SELECT url, bad FROM (SELECT url, try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)(\.[a-z]+)?/?([?#]|$)', 1) AS BIGINT) AS doc_id FROM pages) JOIN l USING (doc_id)) GROUP BY 1),
n AS (SELECT n, ceil(least(1.0::DOUBLE, greatest(0.001::DOUBLE, 10.0::DOUBLE / n)) * n) AS needed, greatest(0.5::DOUBLE, least(share * 1.5, 1 - (1 - share) / 1.5)) AS sure FROM (SELECT count(*) AS n, count(*) FILTER (bad)::DOUBLE / count(*) AS share, count(*) FILTER (bad) AS m FROM b) WHERE m > 0 AND m < n),
f AS (SELECT token, count(*) FILTER (bad) AS c, count(*) AS every FROM t JOIN b USING (url) GROUP BY 1 HAVING count(*) FILTER (bad) >= (SELECT needed FROM n)),
r1 AS (SELECT token FROM f WHERE c / every >= (SELECT sure FROM n)),
o AS (SELECT url, token, bad FROM t JOIN b USING (url) WHERE token IN (SELECT token FROM f WHERE c / every < (SELECT sure FROM n) AND every < (SELECT n FROM n))),
r2 AS (SELECT x.token AS one, y.token AS two FROM o x JOIN o y ON x.url = y.url AND x.token < y.token GROUP BY 1, 2 HAVING count(*) FILTER (x.bad) >= (SELECT needed FROM n) AND count(*) FILTER (x.bad) / count(*) >= (SELECT sure FROM n)),
hit AS (SELECT DISTINCT url FROM t WHERE token IN (SELECT token FROM r1) UNION SELECT DISTINCT x.url FROM r2 JOIN t x ON x.token = one JOIN t y ON y.token = two AND y.url = x.url),
g AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) v(verdict, host, path))
SELECT page_id, u.host, u.path, rule, coalesce(given, CASE WHEN hit.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, hit.url IS NOT NULL AS mined
FROM (SELECT u.*, (SELECT arg_max(g.host || g.path, len(g.host || g.path)) FROM g WHERE (u.host = g.host OR ends_with(u.host, '.' || g.host)) AND starts_with(u.path, g.path)) AS rule,
  (SELECT arg_max(g.verdict, len(g.host || g.path)) FROM g WHERE (u.host = g.host OR ends_with(u.host, '.' || g.host)) AND starts_with(u.path, g.path)) AS given FROM u) u LEFT JOIN hit ON hit.url = u.url
"""
