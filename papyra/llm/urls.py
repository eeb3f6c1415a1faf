"""URL filters by a cascade of Bloom filters, in DataFrame functions only.

A list of keys (a host, or a host followed by the start of a path) is encoded as alternating Bloom filters over
the corpus's complete key universe: level 1 holds the listed keys, level 2 the universe's keys that wrongly pass
level 1, level 3 the listed keys that pass level 2, and so on until nothing passes wrongly. A key of that universe
is listed exactly if the first level that it fails is even, so a URL is judged without any join. Level 1 is sized
so that about as many keys pass wrongly as are listed; all levels together are then bounded by the list, not by
the corpus. They travel as literals in the plan.

A rule fits a host and its subdomains where the URL's path starts with the rule's; of those that fit, the longest
(host plus path) wins. Where none fits, a URL is blocked exactly if its host, or a parent of it, is a listed host.
URLs that are null or have no ``://`` have an empty host and path: no rule, verdict "allow". Rows map one to one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.store import cut

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hosts that are blocked with all their subdomains where no rule says otherwise.
LISTED_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets") for top in ("com", "net", "org"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 4
#: Words of one filter; a longer list is cut into parts by hash.
MAX_WORDS = 1 << 21


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


class Level:
    """One Bloom filter: 64-bit words, and the seed of its hashes."""

    def __init__(self, words: Sequence[int], seed: int):
        self.words, self.seed, self.bits = list(words), seed, 64 * len(words)

    def positions(self, key: Column) -> list[Column]:
        return _positions(key, self.seed, self.bits)

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for p in self.positions(key):
            out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
        return out


def _positions(key: Column, seed: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * HASHES + i), key), F.lit(bits)) for i in range(HASHES)]


def bloom(keys: DataFrame, n: int, seed: int, per_key: float = 10) -> Level:
    """A filter of the column ``key`` of keys, which has about n rows, with so many bits a key."""
    words = max(16, 1 << math.ceil(math.log2(max(1.0, n * per_key / 64))))
    p = F.explode(F.array(*_positions(F.col("key"), seed, 64 * words))).alias("p")
    # bit 63 wraps to the sign; bit_or is partial on the map side
    got = keys.select(p).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("b")).collect()
    out = [0] * words
    for r in got:
        out[r.w] = r.b
    return Level(out, seed)


class Cascade:
    """Exact membership of the keys of a universe in a list, cut into parts by hash so that no filter outgrows MAX_WORDS."""

    def __init__(self, parts: list[list[Level]]):
        self.parts = parts

    def has(self, key: Column) -> Column:
        found = F.lit(False)
        for g, levels in enumerate(self.parts):
            out = F.lit(len(levels) % 2 == 1)
            for i, level in reversed(list(enumerate(levels))):
                out = F.when(level.passes(key), out).otherwise(F.lit(i % 2 == 1))
            found = out if len(self.parts) == 1 else F.when(_part(key, len(self.parts)) == g, out).otherwise(found)
        return found

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame, universe_rows: int) -> Cascade:
        """listed and universe: column ``key``; universe may repeat keys."""
        inside = listed.where("key is not null").distinct()
        n = inside.count()
        if not n:
            return Cascade([[]])
        wrong = min(1e-3, max(n, 1000) / max(1, universe_rows))
        per_key = max(10.0, HASHES / -math.log(1 - wrong ** (1 / HASHES)))
        parts = math.ceil(n * per_key / 64 / (MAX_WORDS / 2))
        of = lambda df, g: df if parts == 1 else df.where(_part(F.col("key"), parts) == g)
        return Cascade([Cascade._levels(of(inside, g), of(universe, g), per_key) for g in range(parts)])

    @staticmethod
    def _levels(inside: DataFrame, universe: DataFrame, per_key: float) -> list[Level]:
        n = inside.count()
        if not n:
            return []
        levels = [bloom(inside, n, 1, per_key)]
        outside = cut(universe.where(levels[0].passes(F.col("key"))).distinct().join(inside, "key", "left_anti"), "cascade")
        sides = [outside, inside]
        while m := sides[0].count():
            levels.append(bloom(sides[0], m, len(levels) + 1))
            sides = [sides[1].where(levels[-1].passes(F.col("key"))), sides[0]]
        return levels


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def _literals(spark: SparkSession, values: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")).alias("key"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed_hosts: Sequence[str] = LISTED_HOSTS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages."""
    spark = pages.sparkSession
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def keys(shapes) -> list[Column]:
        """The host's last labels and the path's first characters, so many of each as a shape says."""
        last = lambda c: F.substring_index("host", ".", -c)
        return [F.when((F.col("host") != "") & (F.length("path") >= p), F.concat(last(c), F.substring("path", 1, p))) for c, p in shapes]

    shape = lambda host, path: (host.count(".") + 1, len(path))
    lists = {a: ([h + p for b, h, p in rules if a == b], sorted({shape(h, p) for b, h, p in rules if a == b})) for a in ("allow", "block")}
    lists["host"] = (list(listed_hosts), sorted({shape(h, "") for h in listed_hosts}))
    rows = base.count()
    found = {}
    for name, (texts, shapes) in lists.items():
        universe = base.select(F.explode(F.array(*keys(shapes)) if shapes else F.array().cast("array<string>")).alias("key")).where("key is not null")
        found[name] = Cascade.build(_literals(spark, texts), universe, rows * max(1, len(shapes)))

    hits = [F.when(found[a].has(k), F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit(a).alias("verdict"))) for a in ("allow", "block") for k in keys(lists[a][1])]
    hosts = [F.when(found["host"].has(k), F.lit(True)) for k in keys(lists["host"][1])]
    best = F.array_max(F.array_compact(F.array(*hits))) if hits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    listed = F.coalesce(*hosts, F.lit(False)) if hosts else F.lit(False)
    out = base.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.when(listed, "block").otherwise("allow")).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle() -> str:
    """The five rules are written out by hand, longest first, so that the SQL doesn't depend on RULES."""
    listed = " or ".join(f"host = '{h}' or host like '%.{h}'" for h in LISTED_HOSTS)
    return f"""
with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as r from pages),
split as (select page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') as host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
fit as (select *, host = 'example.org' or host like '%.example.org' as example_org, host = 'org' or host like '%.org' as org, host = 'com' or host like '%.com' as com from split)
select page_id, host, path,
  case when example_org and starts_with(path, '/en/1') then 'example.org/en/1'
    when example_org and starts_with(path, '/es/') then 'example.org/es/'
    when com and starts_with(path, '/fr/') then 'com/fr/'
    when com and starts_with(path, '/de/') then 'com/de/'
    when org and starts_with(path, '/') then 'org/' end as rule,
  case when example_org and starts_with(path, '/en/1') then 'block'
    when example_org and starts_with(path, '/es/') then 'block'
    when com and starts_with(path, '/fr/') then 'allow'
    when com and starts_with(path, '/de/') then 'block'
    when org and starts_with(path, '/') then 'allow'
    when {listed} then 'block' else 'allow' end as verdict from fit"""
