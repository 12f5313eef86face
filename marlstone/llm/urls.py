"""URL filters: exact list membership by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 those keys of the corpus that level 1
takes for listed by mistake, level 3 the listed keys that level 2 takes for
mistakes, and so on until a level makes no mistake.  The corpus's keys are the
complete universe, so a key is listed exactly if the first level that denies it
is an even one.  Membership tests are look-ups in the scan, without a join; only
building a level compares its few candidates with the list.

A level's bits are one row of a checkpointed table, which Spark reads once as a
scalar subquery; they are never in the plan's text.  Level 1 takes about 1.44 *
log2(universe / listed) bits a listed key, so about as many keys pass it by
mistake as are listed, and the further levels shrink.  A list whose filter would
pass ``MAX_FILTER_BITS`` (32 MB; some ten million keys) is an error, not another
method: such lists are split by a hash of the key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh

#: Fixed seeds: two 64-bit hashes give all probes of a level (double hashing).
SEED_A, SEED_B = 0x51, 0xB7
MAX_FILTER_BITS = 1 << 28
#: Tags that keep the lists apart in one cascade.
BLOCK, ALLOW, HOST = "b", "a", "h"


class Level:
    """One Bloom filter, its words in a table of one row."""

    def __init__(self, keys: DataFrame, number: int, bits: int, probes: int):
        self.number, self.bits, self.probes = number, bits, probes
        at = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("at"))
        zeros = keys.sparkSession.range(-(-bits // 64)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
        some = at.select(F.expr("at div 64").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("v"))
        words = zeros.union(some).groupBy("w").agg(F.bit_or("v").alias("v"))
        table = checkpointed(words.agg(F.sort_array(F.collect_list(F.struct("w", "v"))).alias("x")).select(F.transform("x", lambda r: r["v"]).alias("x")))
        self.words = table.scalar()

    def _places(self, key: Column) -> list[Column]:
        a, b = (F.xxhash64(F.lit(seed + self.number), key) for seed in (SEED_A, SEED_B))
        # Shifts keep the sums inside 64 bits, whatever the probe.
        return [F.pmod(F.shiftright(a, 8) + F.shiftright(b, 8) * F.lit(i), F.lit(self.bits).cast("long")) for i in range(self.probes)]

    def passes(self, key: Column) -> Column:
        out = F.lit(True)
        for p in self._places(key):
            out = out & (F.getbit(F.get(self.words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
        return out


class Cascade:
    """Exact membership of ``listed`` for every key of ``universe`` (DataFrames of distinct strings ``key``, read several times)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_filter_bits: int = MAX_FILTER_BITS):
        self.levels: list[Level] = []
        n, seen = listed.count(), universe.count()
        if not n:
            return
        share = min(0.5, max(1e-9, 0.7 * n / max(seen, 1)))
        probes = max(1, round(-math.log2(share)))
        bits = max(64, math.ceil(n * probes / math.log(2)))
        inside, outside = listed, universe
        for number in range(64):
            if bits > max_filter_bits:
                raise ValueError(f"a filter of {bits} bits passes the bound of {max_filter_bits}; split the list by a hash of its keys")
            self.levels.append(level := Level(inside, number, bits, probes))
            # Those of the other side that pass by mistake: about as many as are listed at first, then an eighth of the last time.
            wrong = outside.where(level.passes(F.col("key")))
            wrong = checkpointed(wrong if number else wrong.join(listed, "key", "left_anti"))
            m = wrong.count()
            if m == 0:
                return
            inside, outside = wrong, inside
            probes, bits = 3, max(64, math.ceil(m * 3 / math.log(2)))
        raise RuntimeError("the cascade doesn't end; two keys share every hash")

    def contains(self, key: Column) -> Column:
        """True or false for every key of the universe; false for null."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[n].passes(key), F.lit(n % 2 == 1)).otherwise(out)
        return F.coalesce(key.isNotNull() & out, F.lit(False))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without ``://`` or for null; A-Z of the host are lower-cased."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed_hosts: list[str] | DataFrame, url: str = "url", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    ``rules`` are (verdict, "host/path-prefix"); ``listed_hosts`` (names, or a
    DataFrame of one column) block a host and its subdomains where no rule fits.
    The rule with the longest text wins, and of two equally long ones the
    allowing.  A null, empty or schemeless url has host and path "", no rule,
    and is allowed; urls of any length are judged whole.  Repeated rows are
    judged alike; empty tables give none; other columns pass through, whatever
    their names, and columns of the names added here are replaced.

    Candidate keys of a url are its host's suffixes and path prefixes of the
    shapes (labels, length) that listed keys have.  One cascade holds all lists,
    and one pass over the pages finds its universe.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    hosts = spark.createDataFrame([(h,) for h in listed_hosts], "key string") if isinstance(listed_hosts, list) else listed_hosts.toDF("key")
    texts = sorted({(ALLOW if v == "allow" else BLOCK) + r for v, r in rules})
    keys = hosts.where("key is not null").select(F.concat(F.lit(HOST), "key").alias("key"))
    if texts:
        keys = keys.union(spark.createDataFrame([(t,) for t in texts], "key string"))
    keys = checkpointed(keys.distinct())
    # Host names have few labels, so these are few numbers.
    labels = [r.n for r in keys.where(F.col("key").startswith(HOST)).select((F.length("key") - F.length(F.replace("key", F.lit("."), F.lit(""))) + 1).alias("n")).distinct().collect()]
    shapes = sorted({(t[0], t[1:].partition("/")[0].count(".") + 1, len(t[1:].partition("/")[2]) + 1) for t in texts})

    def candidate(tag: str, k: int, n: int) -> Column:
        fits = (F.size(F.split(host, "\\.")) >= k) & (F.length(path) >= n)
        return F.when(fits, F.concat(F.lit(tag), F.substring_index(host, ".", -k), F.substring(path, 1, n)))

    of_rules = [(tag, candidate(tag, k, n)) for tag, k, n in shapes]
    of_hosts = [candidate(HOST, k, 0) for k in sorted(labels)]
    out = pages.drop("host", "path", "rule", "verdict")
    if not of_rules and not of_hosts:
        return out.withColumns({"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    universe = pages.select(F.explode(F.array(*[c for _, c in of_rules], *of_hosts)).alias("key")).where("key is not null").distinct()
    cascade = Cascade(keys, checkpointed(universe), max_filter_bits)
    found = [F.when(cascade.contains(c), F.struct(F.length(c).alias("n"), F.lit(tag == ALLOW).alias("allow"), F.substring(c, 2, 1 << 30).alias("rule"))) for tag, c in of_rules]
    best = fresh(out, "best")
    listed = F.lit(False)
    for c in of_hosts:
        listed = listed | cascade.contains(c)
    best_of = F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("struct<n:int,allow:boolean,rule:string>")
    verdict = F.when(F.col(best).isNotNull(), F.when(F.col(best)["allow"], "allow").otherwise("block")).when(listed, "block").otherwise("allow")
    return out.withColumn(best, best_of).withColumns({"host": host, "path": path, "rule": F.col(best)["rule"], "verdict": verdict}).drop(best)
