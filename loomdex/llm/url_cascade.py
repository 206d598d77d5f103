"""URL rules looked up in a cascade of Bloom filters: exact answers, no join with the pages.

Level 0 encodes the listed keys. Level 1 encodes those keys of the corpus that level 0 wrongly
holds, level 2 the listed keys that level 1 wrongly holds, and so on until a level errs
for nobody. As the levels are built over the corpus's complete key universe, walking down
to the first level that says no gives exact membership for every key of the corpus.

A key is host + path prefix. A page's candidate keys are those suffixes of its host and prefixes of its path whose
numbers of labels and characters occur together in a rule, so a long host costs no more than a short one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.literals import literal_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64 bits a word, ``hashes`` probes, salted by ``salt``."""

    words: tuple[int, ...]
    hashes: int
    salt: int

    def holds(self, key: Column) -> Column:
        bits = len(self.words) * 64
        # one string in the plan, folded into one array before any row is read
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        test = F.lit(True)
        for i in range(self.hashes):
            at = position(key, self.salt, i, bits)
            test = test & _bit(F.element_at(table, (F.shiftright(at, 6) + 1).cast("int")), at)
        return test


def _bit(word: Column, at: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def position(key: Column, salt: int, i: int, bits: int) -> Column:
    """Bit of probe ``i``; pure JVM hashing."""
    return F.pmod(F.xxhash64(F.lit(salt), F.lit(i), key), F.lit(bits)).cast("long")


def build_level(keys: DataFrame, column: str, count: int, salt: int, bits_a_key: int, hashes: int) -> Level:
    """Bits are or-ed word by word in a distributed aggregation; the driver gets the words only."""
    n_words = max(1, -(-count * bits_a_key // 64))
    at = F.explode(F.array(*[position(F.col(column), salt, i, n_words * 64) for i in range(hashes)]))
    words = (
        keys.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("x"))
    )
    table = [0] * n_words
    for r in words.collect():  # of a list of rules that the driver holds anyway, or of fewer keys
        table[r["w"]] = r["x"]
    return Level(tuple(table), hashes, salt)


def build_cascade(listed: DataFrame, universe: DataFrame, bits_a_key: int = 4, hashes: int = 2, salt: int = 11) -> list[Level]:
    """Levels over two tables with a column ``k``. ``universe`` may hold listed keys too.

    The first filter's rate of errors is the one that makes the cascade smallest: the list's size over that of the
    rest of the universe, divided by the root of two. Later filters have ``bits_a_key`` bits a key.
    """
    inside = listed.select("k").where("k is not null").distinct().cache()
    outside = universe.select("k").where("k is not null").distinct().join(inside, "k", "left_anti")
    levels: list[Level] = []
    here, there = inside, outside
    n = here.count()
    sure = max(1.0, math.log2(max(1, outside.count()) / max(1, n)) + 0.5)  # bits of certainty that the first filter needs
    first = max(bits_a_key, math.ceil(1.44 * sure)), max(hashes, round(sure))
    while n or not levels:
        level = build_level(here, "k", n, salt + len(levels), *((bits_a_key, hashes) if levels else first))
        levels.append(level)
        # those on the other side for whom this level is wrong are the next level's keys
        here, there = there.where(level.holds(F.col("k"))), here
        n = here.count()
    inside.unpersist()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Exact for keys of the universe: false where an even level says no, true where an odd one does."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        answer = F.when(~levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(answer)
    return answer


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z lower-cased. Path: on to ? or #. Else both empty."""
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(u, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of keys: for each (labels, length) of the rules, the host's last labels and the path's first characters, where it has so many."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))

    def key(labels: int, length: int) -> Column:
        fits = (dots + 1 >= labels) & (F.length(path) >= length)
        return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))

    return F.array_compact(F.array(*[F.nullif(key(n, m), F.lit("")) for n, m in shapes]))


def judge_urls(pages: DataFrame, rules=RULES, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    The longest fitting rule (host and path together) decides; without one the verdict
    is ``otherwise`` and rule is null. Null urls and urls without ``://`` have empty host and path, so no
    rule. Repeated pages are judged alike; empty tables give an empty result.
    """
    spark = pages.sparkSession
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules}) or [(1, 0)]
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("c", candidates(F.col("host"), F.col("path"), shapes))
    # only urls are read here; the distinct keys are pre-aggregated in each task
    universe = keyed.select(F.explode("c").alias("k")).distinct().cache()
    levels = {}
    for verdict in ("block", "allow"):
        own = [(h + p,) for h, p, v in rules if v == verdict]
        levels[verdict] = build_cascade(literal_table(spark, own, k="string"), universe)
    universe.unpersist()
    tagged = F.transform("c", lambda x: F.struct(
        F.length(x).alias("len"), x.alias("k"),
        F.when(member(levels["block"], x), F.lit("block")).when(member(levels["allow"], x), F.lit("allow")).alias("v"),
    ))
    best = F.array_max(F.filter(tagged, lambda x: x["v"].isNotNull()))
    return keyed.withColumn("b", best).select(
        "page_id", "host", "path", F.col("b.k").alias("rule"), F.coalesce(F.col("b.v"), F.lit(otherwise)).alias("verdict")
    )


ORACLE = """
WITH p AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), q AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h0, r FROM p
), s AS (
  SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') AS path FROM q
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)
"""
