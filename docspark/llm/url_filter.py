"""URL filters: rules first, then a list of canonical URLs behind a blocked Bloom filter, in DataFrame functions only.

The listed URLs are hashed into blocks of 256 bits (four longs, a row per block, built by bitwise OR in an aggregation that sums up before the
shuffle); a URL sets ``BITS`` bits of one block.  A URL whose block lacks one of its bits is not listed; the others go on to a hash
join with the list itself, which removes the false positives.  The filter takes ``PER_URL`` bits a listed URL.  It is broadcast while its
proven size (40 bytes a block) is under ``BROADCAST_BYTES``, and joined by block otherwise.  Only distinct canonical URLs without a rule go through filter and exact join, so a URL that
is very frequent does so once; the verdicts then go back to the pages in a join whose page side the engine may split, where pages without a host are dealt over ``SALTS`` keys that meet nothing.

The list is the caller's.  ``marked_urls`` makes one from the pages' own hosts, as the given tables have no other place where URLs stand; on them a pattern over hosts would give the same verdicts.

Null URLs and those without ``://`` have empty host and path, no rule, and are never listed.  Every input row gives one row, repeated ones too, and an empty table an empty one, as does an
empty list no hit.  Columns other than id and URL are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import cut, lower_ascii

BITS = 6
PER_URL = 12
BLOCK_BITS = 256
BROADCAST_BYTES = 8 << 20
SALTS = 1024


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Words in the labels of unwanted hosts; every URL of such a host is listed.
MARKS = ("spam", "pills", "casino", "bet", "bets", "betting", "poker", "porn", "adult", "xxx", "sex", "ads", "adserver", "tracker", "warez", "phishing", "malware")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """Host without a port, a last dot, ``www.`` or ``m.``."""
    return F.regexp_replace(F.regexp_replace(host, r"\.?(?::[0-9]*)?$", ""), r"^(?:www|m)\.", "")


def canonical(host: Column, path: Column) -> Column:
    """Bare host, path without repeated slashes, ``index.html``, a closing slash or ``.html``; null for an empty host."""
    return F.when(host != "", F.concat(bare_host(host), F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), r"(?:/index\.html?|\.html?|/)$", "")))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, else null."""
    name = action = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, r.name).otherwise(name), F.when(fits, r.action).otherwise(action)
    return name, action


def _places(url: str, blocks: Column) -> tuple[Column, list[tuple[Column, Column]]]:
    """The block of a URL, and (word, mask) for each of its bits."""
    first, second = F.xxhash64(url), F.xxhash64(F.lit(1), url)
    bits = [F.shiftrightunsigned(second, 8 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(BITS)]
    return F.pmod(first, blocks), [(F.shiftright(b, 6), F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))) for b in bits]


def bloom_blocks(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """block, word0 .. word3."""
    block, places = _places(url, F.lit(blocks))
    zero = F.lit(0).cast("long")
    words = []
    for w in range(BLOCK_BITS // 64):
        mask = zero
        for word, bit in places:
            mask = mask.bitwiseOR(F.when(word == w, bit).otherwise(zero))
        words.append(mask.alias(f"word{w}"))
    return listed.select(block.alias("block"), *words).groupBy("block").agg(*[F.bit_or(f"word{w}").alias(f"word{w}") for w in range(BLOCK_BITS // 64)])


def filter_urls(pages: DataFrame, listed: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, listed, verdict of every page; ``listed`` has a column ``url`` of canonical URLs."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    name, action = rule_for(F.col("host"), F.col("path"), rules)
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    parts = parts.select("id", "host", "path", name.alias("rule"), action.alias("action"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    exact = cut(listed.select(F.col("url").alias("canonical")).where("canonical is not null").distinct())
    hits = cut(possible_hits(parts.where("action is null and canonical is not null").select("canonical").distinct(), exact).join(exact, "canonical", "left_semi"))
    salt = F.concat(F.lit("-"), F.pmod(F.xxhash64("id", "path", "host", F.monotonically_increasing_id()), F.lit(SALTS)).cast("string"))
    keyed = parts.withColumn("key", F.coalesce(F.concat(F.lit("="), "canonical"), salt))
    out = keyed.join(hits.select(F.concat(F.lit("="), "canonical").alias("key"), F.lit(True).alias("listed")), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "listed", verdict.alias("verdict"))


def possible_hits(urls: DataFrame, exact: DataFrame) -> DataFrame:
    """The rows of ``urls`` whose bits are all set in the Bloom filter of ``exact``; both have a column ``canonical``."""
    blocks = max(1, -(-exact.count() * PER_URL // BLOCK_BITS))
    bloom = bloom_blocks(exact, "canonical", blocks)
    bloom = F.broadcast(bloom) if 40 * blocks <= BROADCAST_BYTES else bloom
    block, places = _places("canonical", F.lit(blocks))
    has = F.lit(True)
    for word, bit in places:
        of = F.when(word == 0, F.col("word0")).when(word == 1, F.col("word1")).when(word == 2, F.col("word2")).otherwise(F.col("word3"))
        has = has & (of.bitwiseAND(bit) != 0)
    return urls.withColumn("block", block).join(bloom, "block").where(has).select(urls.columns)


def marked_urls(pages: DataFrame, *, marks: tuple[str, ...] = MARKS, url_col: str = "url") -> DataFrame:
    """A list for ``filter_urls``: the canonical URLs of hosts that carry one of the marks in a label."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    marked = F.col("host").rlike(r"(?:^|[.-])(?:" + "|".join(marks) + r")(?:$|[.-])")
    return pages.select(host.alias("host"), path.alias("path")).where(marked).select(canonical(F.col("host"), F.col("path")).alias("url"))


def mirrored_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A list for ``filter_urls``: the canonical URLs of pages whose article stands, sign for sign, under another bare host at an earlier page (least id, null last, then host).

    Articles meet by 128-bit hashes, and of each the first page is found by an aggregation that sums up before the shuffle; it is written to the checkpoint folder, so that the
    join back reads two plain shuffles and a very frequent article is split by the engine's skew join.  Pages without an article element or without a host are no mirrors.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    article = F.regexp_extract(F.col(html_col), r"(?s)<article\b[^>]*>(.*)</article>", 1)
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), article.alias("article")).where("article <> '' and host <> ''")
    parts = cut(parts.select("id", bare_host(F.col("host")).alias("bare"), canonical(F.col("host"), F.col("path")).alias("url"), F.xxhash64("article").alias("h"), F.xxhash64(F.lit(1), "article").alias("h2")))
    first = parts.groupBy("h", "h2").agg(F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "bare")).alias("first"), F.min("bare").alias("low"), F.max("bare").alias("high"))
    first = cut(first.where("low <> high").select("h", "h2", "first"))
    return parts.join(first, ["h", "h2"]).where(F.col("bare") != F.col("first.bare")).select("url")
