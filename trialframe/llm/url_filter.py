"""URL filtering: rules on host and path, and a list of canonical URLs behind a blocked Bloom filter.

All bits of a URL lie in one 512-bit block of the filter, so a test reads eight longs. The number of blocks follows the
length of the list, about 50 URLs to a block. Up to `MOST_BLOCKS` the filter is sent to the tasks as one value (8 MB at most,
for some six million URLs); a longer one stays a table of blocks, which are joined to the rows by their number. It passes
possible hits. Only those are joined to the list, which removes false positives. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

LEAST_BLOCKS, MOST_BLOCKS = 1 << 6, 1 << 17  # 512 bits each
KEYS_A_BLOCK = 50
PROBES = 6
_LONGS = 8

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", ""))


def host_of(url: Column) -> Column:
    """Up to the first of / ? #, with A-Z in lower case; empty without `://`."""
    raw = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "(?s)^[^/?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or #."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "(?s)^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without www., and path without an index page, `.html` or a slash at its end; no scheme, query or fragment."""
    short = F.regexp_replace(path, "(/index)?(\\.html?)?/*$", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, "^www\\.", ""), short))


def blocks_for(keys: int) -> int:
    """The least power of two of blocks that have at most `KEYS_A_BLOCK` keys on average."""
    return max(LEAST_BLOCKS, 1 << max(0, -(-keys // KEYS_A_BLOCK) - 1).bit_length())


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bits of a key: places 0 to 511 within its block."""
    bits = F.xxhash64(F.lit("bits"), key)
    return [F.shiftrightunsigned(bits, 9 * k).bitwiseAND(F.lit(511)).cast("int") for k in range(PROBES)]


def bloom_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, longs): the eight longs of each block that has a key; built by partial aggregation."""
    key = F.col(column)
    places = keys.filter(key.isNotNull()).select(_block(key, blocks).alias("block"), F.explode(F.array(*_bits(key))).alias("bit"))
    mask = F.expr("shiftleft(1L, bit & 63)")
    longs = [F.coalesce(F.bit_or(F.when(F.shiftright("bit", 6) == k, mask)), F.lit(0).cast("long")) for k in range(_LONGS)]
    return places.groupBy("block").agg(F.array(*longs).alias("longs"))


def _hit(key: Column, long_at) -> Column:
    hit = F.lit(True)
    for bit in _bits(key):
        hit = hit & (F.call_function("bit_get", long_at(F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1)
    return key.isNotNull() & F.coalesce(hit, F.lit(False))


def with_possible(rows: DataFrame, column: str, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """`rows` with `possible`: whether the filter may contain the column; false for a null."""
    key = F.col(column)
    if blocks > MOST_BLOCKS:
        table = filter_blocks.select(F.col("block").alias("_block"), F.col("longs").alias("_longs"))
        joined = rows.withColumn("_at", _block(key, blocks)).join(table, F.col("_at") == F.col("_block"), "left")
        return joined.withColumn("possible", _hit(key, lambda k: F.get("_longs", k))).drop("_at", "_block", "_longs")
    flat = [0] * (blocks * _LONGS)
    for row in filter_blocks.collect():  # at most MOST_BLOCKS rows
        flat[row["block"] * _LONGS : (row["block"] + 1) * _LONGS] = row["longs"]
    longs = rows.sparkSession.createDataFrame([(flat,)], "longs array<bigint>").scalar()
    return rows.withColumn("possible", _hit(key, lambda k: F.get(longs, _block(key, blocks) * _LONGS + k)))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; of equally long ones the first."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, outcome in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return name, verdict


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The keys, host, path, canonical URL, rule, `listed` and verdict of every row of `pages` (url).

    The longest fitting rule decides; elsewhere a URL is blocked if its canonical form is in `listed`
    (column `canonical`; nulls and repeats do no harm). A null url, or one without `://`, has an empty host and
    path and is allowed. Repeated rows repeat; an empty list blocks nothing; other columns are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(*keys, host.alias("host"), path.alias("path"))
    rule, outcome = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", canonical(F.col("host"), F.col("path")).alias("canonical"), rule.alias("rule"), outcome.alias("outcome"))
    blocks = blocks_for(listed.count())
    possible = with_possible(rows, "canonical", bloom_filter(listed, "canonical", blocks), blocks)
    # written once, without the pages' text: both branches below read it
    possible = staged(possible.withColumn("possible", F.col("possible") & F.col("rule").isNull()))
    # a key that only possible hits have: all other rows get null, which joins nothing and is dealt nowhere
    exact = listed.select(F.col("canonical").alias("hit")).filter("hit IS NOT NULL").distinct()
    passed = possible.filter("possible").join(exact, F.col("canonical") == F.col("hit"), "left")
    done = possible.filter(~F.col("possible")).withColumn("hit", F.lit(None).cast("string")).unionByName(passed)
    return done.select(
        *keys, "host", "path", "canonical", "rule",
        F.col("hit").isNotNull().alias("listed"),
        F.coalesce("outcome", F.when(F.col("hit").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )


def repeated_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs that several different URLs of the table share: the list used where none is given."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("url", canonical(host, path).alias("canonical")).filter("canonical IS NOT NULL")
    return staged(named.groupBy("canonical").agg(F.min("url").alias("a"), F.max("url").alias("b")).filter("a < b").select("canonical"))
