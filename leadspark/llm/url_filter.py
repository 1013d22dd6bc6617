"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

Column functions and joins alone. The filter has a fixed number of 256-bit
blocks, so what is broadcast has the same bound for any list; a list too long
for it only sends more rows to the exact join, which decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rule syntax.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LANES = 4
_SEED = 7


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What stands between the first :// and the path, query or fragment, in lower case; '' without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host and path without slashes at its end; scheme, query and fragment make no difference. '' without a host."""
    return F.when(host == "", "").otherwise(F.concat(host, F.regexp_replace(path, "/+$", "")))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def _longest(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, NULL if none does (same length: the longer host)."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: (len(rule.text), len(rule.host), rule.verdict)):
        found = F.when(_fits(rule, host, path), F.lit(value(rule))).otherwise(found)
    return found


def _masks(url: Column) -> list[Column]:
    """Two bits in each of a block's four numbers."""
    bits = F.xxhash64(url, F.lit(_SEED))

    def bit(i: int) -> Column:
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63))
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))

    return [bit(2 * lane).bitwiseOR(bit(2 * lane + 1)) for lane in range(_LANES)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def bloom_blocks(urls: DataFrame, blocks: int, column: str = "canonical") -> DataFrame:
    """The filter of ``urls``: at most ``blocks`` rows of a block number and its four 64-bit parts."""
    url = F.col(column)
    masked = urls.select(
        _block(url, blocks).alias("_block"), *[m.alias(f"_mask{i}") for i, m in enumerate(_masks(url))]
    )
    return masked.groupBy("_block").agg(*[F.bit_or(f"_mask{i}").alias(f"_bits{i}") for i in range(_LANES)])


def bloom_hit(rows: DataFrame, filter_: DataFrame, blocks: int, column: str) -> DataFrame:
    """The rows whose ``column`` may be in the filter of :func:`bloom_blocks`."""
    met = rows.withColumn("_block", _block(F.col(column), blocks)).join(filter_, "_block")
    for lane, mask in enumerate(_masks(F.col(column))):
        met = met.where(F.col(f"_bits{lane}").bitwiseAND(mask) == mask)
    return met


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    blocks: int = 65_536,
) -> DataFrame:
    """A verdict for every page: the longest rule's, else block if its canonical URL is listed, else allow.

    ``listed`` has a column ``canonical`` (see :func:`canonical_url`); repeated,
    empty and NULL entries make no difference. ``blocks`` blocks of 32 bytes are
    broadcast (2 MB as set; made for a million listed URLs). Returns id, host,
    path, rule (NULL if none fits) and verdict, one row per row of ``pages``. A
    URL that is NULL or has no :// has an empty host and path, fits no rule and
    is on no list. Repeated rows stay; other columns are not read; no pages give
    no rows, and an empty list blocks nothing.
    """
    wanted = listed.select("canonical").where(F.col("canonical") != "").distinct()
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    parts = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    parts = parts.select("id", host.alias("host"), path.alias("path"))
    judged = parts.select(
        "*",
        _longest(rules, F.col("host"), F.col("path"), lambda rule: rule.text).alias("rule"),
        _longest(rules, F.col("host"), F.col("path"), lambda rule: rule.verdict).alias("ruled"),
        canonical_url(F.col("host"), F.col("path")).alias("canonical"),
    )
    asked = judged.select("*", _block(F.col("canonical"), blocks).alias("_block"))
    probed = asked.join(F.broadcast(bloom_blocks(wanted, blocks)), "_block", "left")
    hit = F.lit(True)
    for lane, mask in enumerate(_masks(F.col("canonical"))):
        hit = hit & F.coalesce(F.col(f"_bits{lane}").bitwiseAND(mask) == mask, F.lit(False))
    possible = F.col("ruled").isNull() & (F.col("canonical") != "") & hit
    columns = ["id", "host", "path", "rule", "ruled", "canonical"]
    maybe = probed.where(possible).select(*columns)
    clear = probed.where(~possible).select(*columns)
    exact = wanted.select(F.col("canonical").alias("_listed")).hint("shuffle_hash")
    found = maybe.join(exact, F.col("canonical") == F.col("_listed"), "left")
    found = found.withColumn("verdict", F.when(F.col("_listed").isNotNull(), "block").otherwise("allow"))
    others = clear.withColumn("verdict", F.coalesce("ruled", F.lit("allow")))
    columns = [F.col("id").alias(id_col), "host", "path", "rule", "verdict"]
    return found.select(*columns).unionByName(others.select(*columns))
