"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Main path: DataFrame functions only.

A list has entries (host, path, verdict, kind). A `rule` or `site` entry fits its host and all subdomains where the
URL's path starts with the entry's path; a `page` entry fits only that host and path. Keys are `host` + `path`.
The filter is an array of 64-bit blocks: a key's hash picks one block and four bits in it. Its hits are few and go to the exact
join once for each URL.

Defined cases: a null URL or one without `://` has an empty host and path and no entry fits it; repeated pages are
judged each; an empty list allows everything; columns other than page_id and url play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, maybe_broadcast, table

#: The rules of the registered query (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Listed sites of the registered query, blocked where no rule fits: each family under each of the domains.
FAMILIES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SITES = tuple((f"{f}.example.{d}", "/") for f in FAMILIES for d in ("com", "net", "org"))
#: Listed pages of the registered query, made by rule: so many, on so many hosts.
PAGES, HOSTS = 200_000, 1_000
#: Bits of filter an entry gets, and bits set for each key.
BITS, PROBES = 16, 4
#: Blocks up to which the filter is one array (8 MB); a longer list is joined by block instead.
MAX_BLOCKS = 1 << 20


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty for null or without `://`."""
    part = lambda k: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(part(1), upper, upper.lower()), F.lit("")), F.coalesce(part(2), F.lit(""))


def entries(spark: SparkSession, rules=RULES, sites=SITES) -> DataFrame:
    rows = [(h, p, v, "rule") for h, p, v in rules] + [(h, p, "block", "site") for h, p in sites]
    return spark.createDataFrame(rows, "host string, path string, verdict string, kind string")


def listed_pages(spark: SparkSession, n: int = PAGES, hosts: int = HOSTS) -> DataFrame:
    """Entries of kind `page`: n canonical URLs, every second one a numbered page of one host, the others of many hosts."""
    k = F.col("id")
    host = F.when(k % 2 == 0, "tionble.example.org").otherwise(F.concat(F.lit("site"), k % hosts, F.lit(".example.org")))
    return spark.range(n).select(host.alias("host"), F.concat(F.lit("/de/"), k).alias("path"), F.lit("block").alias("verdict"), F.lit("page").alias("kind"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(PROBES)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block, word: the blocks of the filter that have a bit set."""
    key = F.concat("host", "path")
    return listed.select(_block(key, blocks).alias("block"), _mask(key).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def candidates(pages: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (page_id, url) with host and path; and the filter's hits: url, host, path, k (host h and path q of a key), each once."""
    n = listed.count()
    blocks = max(1, -(-n * BITS // 64))
    host, path = canonical(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    # lengths of listed paths; one small row
    lens = listed.where("kind <> 'page'").agg(F.array_sort(F.collect_set(F.length("path"))).alias("lens"))
    d = p.withColumn("lens", lens.scalar())
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.filter("lens", lambda x: x <= F.length("path")), lambda x: F.substring(F.col("path"), F.lit(1), x))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda q: F.struct(h.alias("h"), q.alias("q")))))
    own = F.array(F.struct(F.col("host").alias("h"), F.col("path").alias("q")))
    d = d.where("url is not null").select("url", "host", "path", F.array_distinct(F.concat(keys, own)).alias("keys"))
    if blocks <= MAX_BLOCKS:
        words = bloom(listed, blocks)
        spread = listed.sparkSession.range(blocks).select(F.col("id").alias("block")).join(words, "block", "left")
        array = spread.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("word", F.lit(0)).alias("word")))), lambda x: x.getField("word")).alias("a"))
        d = d.withColumn("filter", array.scalar())

        def passes(k):
            key = F.concat(k.getField("h"), k.getField("q"))
            return F.get("filter", _block(key, blocks).cast("int")).bitwiseAND(_mask(key)) == _mask(key)

        hits = d.select("url", "host", "path", F.explode(F.filter("keys", passes)).alias("k"))
    else:
        k = d.select("url", "host", "path", F.explode("keys").alias("k")).withColumn("key", F.concat("k.h", "k.q"))
        k = k.withColumn("block", _block(F.col("key"), blocks))
        hits = k.join(bloom(listed, blocks), "block").where(F.col("word").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).drop("block", "word", "key")
    return p, hits.distinct()


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, url, host, path, entry (key of the longest fitting entry), kind, verdict (null where none fits)."""
    listed = listed.select("host", "path", "verdict", "kind").where("host is not null and path is not null")
    p, hits = candidates(pages, listed)
    e = listed.select(F.col("host").alias("e_host"), F.col("path").alias("e_path"), "verdict", "kind")
    e = F.broadcast(e) if bounded(e) else e
    same = (F.col("k.h") == F.col("e_host")) & (F.col("k.q") == F.col("e_path"))
    fits = (F.col("kind") != "page") | ((F.col("e_host") == F.col("host")) & (F.col("e_path") == F.col("path")))
    j = hits.join(e, same).where(fits)
    # a rule comes before a listed site or page; of rules the longest wins
    best = F.max(F.struct((F.col("kind") == "rule").alias("is_rule"), F.length(F.concat("e_host", "e_path")).alias("n"), F.concat("e_host", "e_path").alias("entry"), "kind", "verdict"))
    found = j.groupBy(F.col("url").alias("f_url")).agg(best.alias("b"))
    # a page without a hit, and every null url, is dealt to no task by its url
    found = cut(found, "found")
    out = p.where("url is not null").join(maybe_broadcast(found), p.url == F.col("f_url"), "left").select("page_id", "url", "host", "path", "b.entry", "b.kind", "b.verdict")
    none = [F.lit(None).cast("string").alias(c) for c in ("entry", "kind", "verdict")]
    return out.unionByName(p.where("url is null").select("page_id", "url", "host", "path", *none))


def false_positives(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: n_hits of the filter and n_false of them, which no entry has and the exact join removes."""
    hits = candidates(pages, listed)[1]
    e = listed.select(F.col("host").alias("e_host"), F.col("path").alias("e_path"), F.lit(True).alias("known")).distinct()
    j = hits.join(e, (F.col("k.h") == F.col("e_host")) & (F.col("k.q") == F.col("e_path")), "left")
    return j.agg(F.count("*").alias("n_hits"), F.count_if(F.col("known").isNull()).alias("n_false"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), entries(spark).unionByName(listed_pages(spark))).select(
        "page_id", "host", "path", F.when(F.col("kind") == "rule", F.col("entry")).alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h0,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
q AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
e(eh, ep, ev, is_rule) AS (VALUES ('com', '/', 'allow', 1), ('example.com', '/en/', 'block', 1), ('www.example.com', '/en/', 'allow', 1),
  ('net', '/es/', 'block', 1), ('net', '/fr/', 'block', 1)),
s AS (SELECT f || '.example.' || d AS eh, '/' AS ep, 'block' AS ev, 0 AS is_rule
      FROM (VALUES ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) x(f), (VALUES ('com'), ('net'), ('org')) y(d)),
l AS (SELECT CASE WHEN k % 2 = 0 THEN 'tionble.example.org' ELSE 'site' || (k % 1000) || '.example.org' END AS lh, '/de/' || k AS lp FROM range(200000) r(k)),
m AS (SELECT page_id, host, path, arg_max({'r': eh || ep, 'v': ev, 'k': is_rule}, is_rule * 1000 + length(eh || ep)) AS b
      FROM q LEFT JOIN (FROM e UNION ALL FROM s) e ON (host = eh OR ends_with(host, '.' || eh)) AND starts_with(path, ep) GROUP BY page_id, host, path)
SELECT page_id, host, path, CASE WHEN b.k = 1 THEN b.r END AS rule, coalesce(b.v, CASE WHEN lh IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN l ON host = lh AND path = lp
"""
