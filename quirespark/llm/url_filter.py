"""URL filters: ordered host and path rules, and a Bloom filter cascade for listed keys.

A cascade answers exactly whether a key of a known universe is listed: level 1 holds the listed keys, level 2 the
universe's keys that level 1 takes for listed by mistake, level 3 the listed keys that level 2 takes, and so on
until no mistake is left. Small filters are sent to the executors as literals, so no query over urls needs a join.
With more than SHARD listed keys, keys are dealt over shards by hash and each shard has a cascade of its own, a row of
arrays; a row of a query meets its shard's filters, never the list, through a hash join with that table, broadcast up
to SENT bytes. All of it is DataFrame expressions.

Edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed unless the
empty host is listed; repeated urls give repeated rows, null ids stay null; an empty list gives a cascade without
levels, an empty table no rows; urls of any length are judged whole; other columns never matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The contract's rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Listed keys of a shard, of which one alone goes as literals, and bytes of filters that are broadcast.
SHARD, SENT = 1 << 17, 64 << 20
MAX_LEVELS = 40
WORD = 63  # bits used of each long


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Verdict and name of the longest rule that fits, else nulls. Rules are few: one CASE, longest first."""
    verdict = name = None
    for kind, own, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
        name = F.when(fits, own + start) if name is None else name.when(fits, own + start)
    return (verdict, name) if verdict is not None else (F.lit(None).cast("string"),) * 2


@dataclass
class Bloom:
    """A level: bits of each shard's filter in longs of WORD bits, as literals or in the column `bits<level>`."""

    level: int
    bits: int
    hashes: int
    longs: list[int] | None = field(default=None, repr=False)

    @property
    def column(self) -> str:
        return f"bits{self.level}"

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(k)), F.lit(self.bits)).cast("int") for k in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        table = F.col(self.column) if self.longs is None else F.split(F.lit(",".join(map(str, self.longs))), ",").cast("array<bigint>")  # folded to one literal
        found = F.lit(True)
        for p in self.positions(key):
            word = F.element_at(table, (F.floor(p / WORD) + 1).cast("int"))
            found &= F.getbit(word, p % WORD) == 1
        return found


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards)).cast("int")


def fit_level(keys: DataFrame, count: int, level: int, rate: float, shards: int) -> tuple[Bloom, DataFrame]:
    """A level of the keys (key, shard), and its table (shard, bits). Executors OR their bits per long."""
    each = -(-count // shards) * (1 if shards == 1 else 1.05)  # shards differ a little in size
    bits = max(WORD, math.ceil(-each * math.log(rate) / math.log(2) ** 2))
    made = Bloom(level, bits, max(1, round(bits / each * math.log(2))))
    spots = keys.select("shard", F.explode(F.array(*made.positions(F.col("key")))).alias("p"))
    zeros = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(bits / WORD) - 1)))
    empty = keys.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), zeros.alias("w"), F.lit(0).cast("long").alias("v"))
    words = spots.select("shard", F.floor(F.col("p") / WORD).cast("int").alias("w"), F.expr(f"shiftleft(1L, p % {WORD})").alias("v")).union(empty)
    words = words.groupBy("shard", "w").agg(F.bit_or("v").alias("v"))
    table = words.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias(made.column))
    return made, stored(table, "cascade")


@dataclass
class Cascade:
    """Levels of filters; a key is listed if the first level that rejects it has an even number."""

    levels: list[Bloom]
    shards: int = 1
    table: DataFrame | None = None

    def holds(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(~level.holds(key), F.lit(level.level % 2 == 0)).otherwise(answer)
        return answer

    def mark(self, rows: DataFrame, key: str, name: str = "listed") -> DataFrame:
        """The rows with whether their key is listed."""
        if self.table is None:
            return rows.withColumn(name, self.holds(F.col(key)))
        size = sum(8 * -(-x.bits // WORD) for x in self.levels) * self.shards
        table = F.broadcast(self.table) if size <= SENT else self.table.hint("shuffle_hash")
        met = rows.withColumn("shard", shard_of(F.col(key), self.shards)).join(table, "shard")
        return met.select(*[F.col(f"`{c}`") for c in rows.columns], self.holds(F.col(key)).alias(name))


def fit_cascade(universe: DataFrame, per_shard: int = SHARD) -> Cascade:
    """The cascade of a universe (key string, listed boolean), keys distinct.

    Each level keeps about as many mistakes as half the keys it holds, so the levels shrink geometrically, and each is
    fitted to the stored keys that all levels so far took for their own. The driver holds the literals of one shard.
    """
    sizes = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    own, other, flag = sizes.get(True, 0), sizes.get(False, 0), True
    shards = max(1, -(-own // per_shard))
    made = Cascade([], shards)
    left = universe.select("key", "listed", shard_of(F.col("key"), shards).alias("shard"))
    while own:
        rate = min(0.5, max(1e-6, own / (2 * other))) if other else 0.5
        level, table = fit_level(left.where(F.col("listed") == flag).select("key", "shard"), own, len(made.levels) + 1, rate, shards)
        if shards == 1:
            level.longs = table.first()[level.column]
        else:
            made.table = table if made.table is None else made.table.join(table, "shard")
        made.levels.append(level)
        if len(made.levels) > MAX_LEVELS:
            raise ValueError("the cascade does not end; are the keys distinct?")
        # what the level takes: its own keys and its mistakes; only the mistakes and the keys they are told from go on
        step = left if shards == 1 else left.join(table, "shard")
        left = stored(step.where(level.holds(F.col("key"))).select("key", "listed", "shard"), "cascade-keys")
        taken = left.where(F.col("listed") != flag).count() if other else 0
        own, other, flag = taken, own, not flag
    if made.table is not None:
        made.table = stored(made.table, "cascade-table")
    return made


def listed_hosts(pages: DataFrame, rules=RULES) -> DataFrame:
    """The corpus's complete universe of hosts; listed are those of which rules block a page and allow none.

    So pages that no rule fits take over the verdict that the rules have of their host.
    """
    host, path = url_parts(F.col("url"))
    verdict, _ = match_rules(F.col("key"), F.col("path"), rules)
    keyed = pages.select(host.alias("key"), path.alias("path"))
    some = lambda kind: F.coalesce(F.max(verdict == kind), F.lit(False))
    return keyed.groupBy("key").agg((some("block") & ~some("allow")).alias("listed"))


def filter_urls(pages: DataFrame, rules=RULES, per_shard: int = SHARD) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, and listed: whether its host is listed."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    cascade = fit_cascade(stored(listed_hosts(pages, rules), "hosts"), per_shard)
    rows = cascade.mark(rows, "host")
    verdict, name = match_rules(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")
