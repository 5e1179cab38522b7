"""Operator 4, URL filters: a blocked Bloom filter before an exact hash join (DataFrame functions only).

Base rules and listed urls are entries (host, path) that fit their host and all its subdomains.  A rule fits the url as it
stands, where the url's path starts with the rule's.  The list holds canonical urls, and the url's canonical form is
asked: without user, port, dots at the end of the host, doubled slashes, ``/./`` and a last slash; a listed path fits
itself and what lies below it, so a url has one possible key a border of its path and host, as deep as the list goes.
Distinct hosts and path heads of the urls give their possible keys; the filter (64-bit blocks, 4 bits a key, in packed
arrays of blocks) lets few of those through, and an exact join on the key removes false hits.  Base rules decide
first, the longest one wins; else a listed url is blocked.  The registered query lists every twentieth page's url
beside three hosts.

Defined results: null urls and those without ``://`` have empty host and path, and no entry fits them; every
row is judged, repeated or not; of equally long fitting rules the one that sorts first wins; a listed url without
host is none; an empty table or an empty list is no error.  ``url_verdicts`` keeps all other columns; an input column named host, path, rule or
verdict is kept as host_in and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_bounded, scratch

#: Rules as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The list where none is given; a url of the list and all below it are blocked where no rule fits.
LISTED = ["http://spam-farm.example.com/", "http://spam-farm.example.net/", "http://spam-farm.example.org/"]
#: The registered query lists the urls of pages whose id this divides, too.
EVERY = 20
#: Blocks that travel together in one row of the filter (32 kB).
SEGMENT = 4096
BITS_PER_KEY, HASHES = 16, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def mask_of(key: Column) -> Column:
    """The bits that a key sets in its block."""
    h = F.xxhash64(key, F.lit(17))
    mask = F.lit(0).cast("long")
    for i in range(HASHES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """segment, words: the filter's 64-bit blocks, ``SEGMENT`` of them in one array."""
    set_ = entries.select(block_of(F.col("key"), blocks).alias("block"), mask_of(F.col("key")).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))
    every = entries.sparkSession.range(blocks).select(F.col("id").alias("block")).join(set_, "block", "left")
    word = F.struct("block", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return every.groupBy(F.floor(F.col("block") / SEGMENT).alias("segment")).agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["word"]).alias("words"))


def passed_by(probes: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The probes (with ``key``) whose bits are all set."""
    asked = probes.withColumn("__vg_block", block_of(F.col("key"), blocks)).withColumn("segment", F.floor(F.col("__vg_block") / SEGMENT)).withColumn("__vg_mask", mask_of(F.col("key")))
    met = join_bounded(asked, filter_, "segment", "inner", 8 * min(blocks, SEGMENT), -(-blocks // SEGMENT))
    word = F.element_at("words", (F.col("__vg_block") % SEGMENT + 1).cast("int"))
    return met.where(word.bitwiseAND(F.col("__vg_mask")) == F.col("__vg_mask")).select(*probes.columns)


def canonical_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")


def canonical_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/[.](?=/|\z)", ""), "/{2,}", "/"), r"/\z", "")


def entries_of(spark: SparkSession, rules=RULES, listed: list[str] | DataFrame = LISTED) -> DataFrame:
    """verdict (allow, block or listed), host, path.  ``listed``: urls, as a list or as a table with a column url."""
    base = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    urls = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(x,) for x in listed], "url string")
    return base.unionByName(urls.where(F.col("url").contains("://")).select(F.lit("listed").alias("verdict"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))


def url_verdicts(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """All rows with host, path, rule and verdict.  ``entries``: as of ``entries_of``."""
    listed = F.col("verdict") == "listed"
    plain = entries.withColumns({"__vg_host": canonical_host(F.col("host")), "__vg_path": canonical_path(F.col("path"))}).where(~listed | (F.col("__vg_host") != ""))
    # a rule's key and a canonical url's never meet, as no host has a blank before it
    key = F.when(listed, F.concat(F.lit(" "), key_of(F.col("__vg_host"), F.col("__vg_path")))).otherwise(key_of(F.col("host"), F.col("path")))
    labels = F.size(F.split(F.when(listed, F.col("__vg_host")).otherwise(F.col("host")), r"\."))
    keys = scratch(plain.select("verdict", key.alias("key"), F.length("path").alias("long"), labels.alias("labels"), F.size(F.split("__vg_path", "/")).alias("deep")).distinct(), "entries")
    n = keys.count()
    blocks = max(1, n * BITS_PER_KEY // 64)
    # distinct lengths of the rules' paths, not paths; and how far the list goes
    lengths = sorted(r.long for r in keys.where(~listed).select("long").distinct().collect())
    most = keys.agg(*(F.coalesce(F.max(x), F.lit(0)).alias(name) for name, x in (("rule", F.when(~listed, F.col("labels"))), ("listed", F.when(listed, F.col("labels"))), ("deep", F.when(listed, F.col("deep")))))).first()
    taken = pages.columns
    for name in ("host", "path", "rule", "verdict"):
        if name in taken:
            free = name + "_in"
            while free in taken:
                free += "_in"
            pages, taken, url = pages.withColumnRenamed(name, free), [free if c == name else c for c in taken], free if url == name else url
    here = F.col(url)
    parsed = pages.withColumns({"__vg_host": host_of(here), "__vg_path": path_of(here)})
    parsed = parsed.withColumns({"__vg_rule_head": F.substring("__vg_path", 1, max(lengths, default=0)), "__vg_listed_head": F.substring_index(canonical_path(F.col("__vg_path")), "/", most.deep)})
    place = ["__vg_host", "__vg_rule_head", "__vg_listed_head"]
    asked = parsed.where("__vg_host <> ''").select(*place).distinct()

    def suffixes(host: Column, most: int) -> Column:
        """The host and those above it, of at most ``most`` labels."""
        parts = F.split(host, r"\.")
        return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, most)))), lambda i: F.array_join(F.slice(parts, -i, i), "."))

    # the key keeps the border between host and path, as the host has no slash and a path starts with one or is empty
    steps = F.split(F.col(place[2]), "/")
    borders = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda m: m <= F.length(place[1])), lambda m: F.substring(F.col(place[1]), F.lit(1), m))
    under = lambda hosts, paths, mark: F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda x: F.concat(F.lit(mark), key_of(h, x)))))
    both = F.concat(under(suffixes(F.col(place[0]), most.rule), heads, ""), under(suffixes(canonical_host(F.col(place[0])), most.listed), borders, " "))
    probes = asked.select(*place, F.explode(both).alias("key"))
    exact = join_bounded(passed_by(probes, bloom(keys, blocks), blocks), keys.select("key", "verdict"), "key", "inner", 256, n)
    rank = F.struct(F.length("key"), F.when(F.col("verdict") == "allow", 0).otherwise(1))
    rule = F.max_by(F.struct("key", "verdict"), F.when(~listed, rank))
    found = scratch(exact.groupBy(*place).agg(rule.alias("__vg_rule"), F.bool_or(listed).alias("__vg_listed")), "verdicts")
    # a host with very many rows is split by the adaptive join, as the side of the verdicts has one row for it
    joined = join_bounded(parsed, found, place, "left", 768)
    verdict = F.coalesce(F.col("__vg_rule.verdict"), F.when(F.col("__vg_listed"), "block"), F.lit("allow"))
    return joined.select(*taken, F.col("__vg_host").alias("host"), F.col("__vg_path").alias("path"), F.col("__vg_rule.key").alias("rule"), verdict.alias("verdict"))


def op4(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    hosts = spark.createDataFrame([(x,) for x in LISTED], "url string")
    listed = pages.where(F.col("page_id") % EVERY == 0).select("url").unionByName(hosts)
    return url_verdicts(pages.select("page_id", "url"), entries_of(spark, listed=listed)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (
  SELECT page_id,
    translate(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
q AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM p),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM q),
c AS (SELECT *,
    regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\z', ''), '\.+\z', '') AS plain,
    regexp_replace(regexp_replace(path, '/([.]?/)+', '/', 'g'), '/[.]?\z', '') AS clean FROM r),
l AS (
  SELECT plain || clean AS entry FROM c WHERE page_id % 20 = 0 AND plain <> ''
  UNION SELECT unnest(['spam-farm.example.com', 'spam-farm.example.net', 'spam-farm.example.org'])),
d AS (SELECT DISTINCT plain, clean, string_split(plain, '.') AS labels, string_split(clean, '/') AS steps FROM c WHERE host <> ''),
h AS (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM d),
b AS (SELECT *, unnest(range(1, len(steps) + 1)) AS j FROM h),
f AS (SELECT DISTINCT plain, clean FROM b JOIN l ON entry = array_to_string(labels[i:], '.') || array_to_string(steps[1:j], '/'))
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN f.plain IS NOT NULL AND host <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN f USING (plain, clean)
"""
