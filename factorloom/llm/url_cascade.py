"""URL filters: host and path rules, and exact list membership by a cascade of Bloom filters.

Level 1 encodes the listed keys. Level 2 encodes the false positives of level 1 among all other keys of the corpus,
level 3 the listed keys that level 2 holds by mistake, and so on until a level has no false positive. For every key
of that universe the alternating levels give the exact answer, so the rows of the table need no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import ascii_lower
from factorloom.plans.runtime import stage


@dataclass(frozen=True)
class Level:
    """One Bloom filter: `bits` positions in 64-bit words, `hashes` positions a key; seed tells levels apart."""

    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def positions(self, key: str) -> list[str]:
        return [f"pmod(xxhash64({key}, {self.seed * 64 + j}), {self.bits}L)" for j in range(self.hashes)]

    def holds(self, key: str) -> str:
        # One literal after constant folding, whatever its size.
        words = f"cast(split('{','.join(map(str, self.words))}', ',') AS array<bigint>)"
        tests = [f"shiftrightunsigned(get({words}, cast({p} div 64 AS int)), cast({p} % 64 AS int)) & 1L = 1L"
                 for p in self.positions(key)]
        return " AND ".join(f"({t})" for t in tests)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = 1 << 22, max_levels: int = 64) -> list[Level]:
    """The levels for `listed` (key) within `universe` (key); nulls and repeated keys do not count. Only bit words
    reach the driver: their number is set by the listed keys, and more than `max_bits` in a level raises, as the
    levels travel with the plan. An empty list gives no level."""
    inside = stage(listed.select("key").filter("key IS NOT NULL").distinct(), "listed")
    outside = stage(universe.select("key").filter("key IS NOT NULL").distinct().join(inside, "key", "left_anti"), "others")
    levels: list[Level] = []
    n_in, n_out = inside.count(), outside.count()
    while n_in:
        if len(levels) == max_levels:
            raise RuntimeError(f"the cascade still has false positives after {max_levels} levels")
        rate = min(0.5, math.sqrt(0.5) * n_in / max(1, n_out)) if not levels else 0.5
        hashes = max(1, math.ceil(math.log2(1 / rate)))
        bits = max(64, math.ceil(n_in * hashes / math.log(2)))
        if bits > max_bits:
            raise ValueError(f"{n_in} keys need {bits} bits; max_bits is {max_bits}: join with the list instead")
        empty = Level(len(levels) + 1, bits, hashes, ())
        at = inside.selectExpr(f"explode(array({', '.join(empty.positions('key'))})) AS p")
        found = at.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("b"))
        words = [0] * -(-bits // 64)
        for row in found.collect():
            words[row["w"]] = row["b"]
        level = Level(empty.seed, bits, hashes, tuple(words))
        levels.append(level)
        inside, outside = stage(outside.filter(level.holds("key")), "false-positives"), inside
        n_in, n_out = inside.count(), n_in
    return levels


def listed_in(levels: list[Level], key: str) -> str:
    """SQL condition: is this key of the universe listed? `key` is a column or lambda variable."""
    condition = "false"
    for level in reversed(levels):
        condition = f"(({level.holds(key)}) AND NOT {condition})"
    return condition


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1))


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _suffixes(labels: int) -> str:
    """SQL: the host's parent domains and itself, up to so many labels."""
    return (f"transform(sequence(1, least(size(split(host, '[.]')), {labels})), "
            "n -> array_join(slice(split(host, '[.]'), -n, n), '.'))")


def judge(pages: DataFrame, rules: list[tuple[str, str]], blocked: DataFrame, url: str = "url",
          id_col: str = "page_id") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row; other columns are not read.

    `rules` are (rule, verdict), a rule being a host, a slash and a path prefix. It fits its host and all subdomains;
    of those that fit, the longest decides. Without a fitting rule the url is blocked if its host or a parent domain
    is a key of `blocked` (key), else allowed. Null and malformed urls have an empty host and path and are allowed.
    """
    parts = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"))
    depth = blocked.filter("key IS NOT NULL").agg(F.max(F.size(F.split("key", "[.]")))).first()[0] or 1
    keys = parts.select("host").distinct().select(F.explode(F.expr(_suffixes(depth))).alias("key"))
    levels = build_cascade(blocked, keys)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    listed = F.expr(f"exists({_suffixes(depth)}, k -> {listed_in(levels, 'k')})")
    return parts.select(id_col, "host", "path", rule.alias("rule"),
                        F.coalesce(verdict, F.when(listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
