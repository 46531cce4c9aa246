"""Operator 12: verdicts on URLs by rules, and by a list of canonical URLs behind a blocked Bloom filter.

A URL's rule is the longest of those that fit its host and path.  URLs
without a rule are looked up in the list: a blocked Bloom filter of the
list (blocks of eight 64-bit words, a bit of each word for a URL) passes possible hits, and an exact hash
join of those alone with the list removes false positives.  Only the filter is broadcast: it has at
most MOST_BLOCKS rows of 72 bytes however long the list is, and a list that outgrows it
passes more false positives, which the join removes.  The rest of the URLs is never shuffled.
Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.llm._shared import table, written

WORDS = 8
#: bits of the filter for each URL of the list, while it has room
BITS_PER_URL = 20
MOST_BLOCKS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict on a host with all its subdomains, where the path starts as given."""

    verdict: str
    host: str
    path: str = "/"


#: The rules of the query, as its contract gives them.
RULES = (Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    """What follows the first ://, up to /, ?, # or the end, with A-Z in lower case; empty without ://, or of a null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """A URL's form in the list: without scheme, www., default port, fragment, utm_ parameters and closing slashes, other parameters sorted; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*[^?#]*\?([^#]*)", 1)
    asked = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))))
    return F.when(host != "", F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(F.lit(""))))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct<rule,verdict> of the longest rule that fits (of equally long ones the first in order of its text, block before allow), null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path, -len(r.verdict), r.verdict), reverse=True):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _place(canon: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canon), F.lit(blocks))


def _bit(canon: Column, word: int) -> Column:
    """One bit of the word, by six bits of a second hash."""
    return F.shiftrightunsigned(F.xxhash64(canon, F.lit(1)), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter of listed(canon), a row for each block that isn't empty; partial filters are joined bit by bit."""
    bits = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("canon"), i))).alias(f"w{i}") for i in range(WORDS)]
    return listed.groupBy(_place(F.col("canon"), blocks).alias("block")).agg(*bits)


def passing(rows: DataFrame, filters: DataFrame, blocks: int) -> DataFrame:
    """rows(canon, ..) with _maybe: whether the filter has all eight bits of canon; a null canon passes never."""
    held = rows.withColumn("_block", _place(F.col("canon"), blocks)).join(F.broadcast(filters), F.col("_block") == F.col("block"), "left")
    hit = F.col("block").isNotNull() & F.col("canon").isNotNull()
    for i in range(WORDS):
        hit = hit & (F.call_function("shiftright", F.col(f"w{i}"), _bit(F.col("canon"), i)).bitwiseAND(F.lit(1)) == 1)
    return held.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_block", "block", *[f"w{i}" for i in range(WORDS)])


def judge(df: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, listed boolean) for each row of df.

    verdict is that of the longest rule that fits; without one, `block` if the URL's canonical form is one of
    those of listed, else `allow`.  listed is null where a rule decides.  A null URL, or one without ://, has an
    empty host and path, no rule and is not in the list.  Null ids and repeated rows are rows like any other; of the list,
    nulls, URLs without a host and repetitions have no effect.  Other columns are ignored.
    """
    known = written(listed.select(canonical(F.col(list_col).cast("string")).alias("canon")).where("canon is not null").distinct(), "listed")
    blocks = max(1, min(MOST_BLOCKS, -(-known.count() * BITS_PER_URL // (64 * WORDS))))
    url = F.col(url_col).cast("string")
    rows = df.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    rows = rows.withColumn("_ruled", ruled(F.col("host"), F.col("path"), rules)).select(F.col(id_col), "host", "path", F.col("_ruled.rule").alias("rule"), F.col("_ruled.verdict").alias("verdict"), F.when(F.col("_ruled").isNull(), F.col("canon")).alias("canon"))
    tried = passing(rows, bloom(known, blocks), blocks)
    out = [F.col(id_col), "host", "path", "rule"]
    clear = tried.where("not _maybe").select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.lit(False)).alias("listed"))
    # both sides are plain exchanges, so that adaptive execution can split a URL that many rows have
    hits = tried.where("_maybe").join(known.withColumnRenamed("canon", "_canon").hint("shuffle_merge"), F.col("canon") == F.col("_canon"), "left")
    exact = hits.select(*out, F.when(F.col("_canon").isNotNull(), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), F.col("_canon").isNotNull().alias("listed"))
    return clear.unionByName(exact)


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the URLs of pages whose document (the number in the path) is labelled toxic."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})", 1).try_cast("long")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("_number"))
    listed = pages.select("url", number.alias("_number")).distinct().join(toxic, "_number", "left_semi")
    return judge(pages.select("page_id", "url"), listed)
