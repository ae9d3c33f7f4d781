"""URL filters: rules by host suffix and path prefix, then a list of canonical URLs behind a blocked Bloom filter."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import may_be_in
from .common import cut, table

#: (verdict, host, path) of the fixed rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(s) -> F.Column:
    return F.translate(s, UPPER, UPPER.lower())


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) after the first :// up to / ? # or the end; path from there up to ? # or the end.

    Null, and a text without ://, give two empty strings.
    """
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def canonical(host, path) -> F.Column:
    """The form of a URL in lists: host without www., m. or a port, path without a last slash, .html or index."""
    h = F.regexp_replace(host, r"^(?:www|m)\.|:\d+$", "")
    return F.concat(h, F.regexp_replace(path, r"(?:/index)?(?:\.html?)?/*$", ""))


def rule_for(host, path, rules) -> F.Column:
    """The longest rule (host and path together; then the later one) that fits, as (rule, verdict); else null."""
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(k).alias("k"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for k, (v, h, p) in enumerate(rules)
    ]
    return F.greatest(*fits) if len(fits) > 1 else reduce(lambda a, _: a, fits)


def in_list(urls: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """The distinct values of urls.url that listed.url has, both canonical.

    Possible hits are those whose bits are all set in the Bloom filter (false positives happen, false negatives do
    not); an exact join with the list follows and decides. The filter is sized by the list's count, up to a fixed size, and
    is the only thing sent to every executor; the list itself is joined by hash, however long it is. Nulls are in no list.
    """
    distinct = urls.select(url).where(F.col(url).isNotNull()).distinct()
    known = cut(listed.select(url).where(F.col(url).isNotNull()).distinct())
    return may_be_in(distinct, url, known, url).join(known, url, "left_semi")


def url_filter(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict for each row of pages.

    The rule that fits decides; without one the verdict is block if the canonical URL is in listed (column url), else
    allow. Null and malformed URLs have empty host and path and are allowed. Repeated rows stay; an empty list blocks
    nothing.
    """
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    judged = parts.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    ruled = judged.where("_rule is not null").select("_key", "host", "path", "_rule.rule", "_rule.verdict")
    rest = judged.where("_rule is null").withColumn("url", canonical(F.col("host"), F.col("path")))
    # Malformed URLs, all of them empty, are in no list and would be one key of the join.
    named = rest.where("url <> ''")
    hits = in_list(named, listed.select("url")).withColumn("_hit", F.lit(True))
    open_ = named.join(hits, "url", "left").unionByName(rest.where("url = ''").withColumn("_hit", F.lit(None).cast("boolean"))).select(
        "_key",
        "host",
        "path",
        F.lit(None).cast("string").alias("rule"),
        F.when(F.col("_hit"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
    return ruled.unionByName(open_).withColumnRenamed("_key", key)


#: Names of hosts known for spam, under any domain; runs of symbols that a page's HTML has as junk, and how many of them.
SPAM_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "spam-farm")
JUNK, JUNK_RUNS = r"[*#%$]{3}", 20


def spam_list(pages: DataFrame, url: str = "url", html: str = "html", names=SPAM_NAMES) -> DataFrame:
    """Canonical URLs that are not wanted, a list that grows with the crawl: of all pages whose HTML is junk, and of all
    pages on hosts one of whose labels is in names. Other forms of such a URL are then found by the list alone. Null HTML
    is no junk."""
    host, path = host_and_path(F.col(url))
    junk = F.regexp_count(F.coalesce(F.col(html), F.lit("")), F.lit(JUNK)) >= JUNK_RUNS
    seen = pages.select(host.alias("host"), path.alias("path"), junk.alias("junk"))
    named = F.arrays_overlap(F.split("host", "[.]"), F.array(*map(F.lit, names)))
    return seen.where(F.col("junk") | named).select(canonical(F.col("host"), F.col("path")).alias("url")).distinct()


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter(pages, spam_list(pages))
