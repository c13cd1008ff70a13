"""URL filter: exact rule look-up through a cascade of Bloom filters, without joins.

Rules and listed host names are keys. Level 0 of the cascade encodes the listed keys; level 1 the keys of the corpus
that level 0 takes for listed by mistake; level 2 the listed keys that level 1 takes for mistakes, and so on until no
mistake is left. Over the keys of the corpus the answer is exact. The filters are literals of bounded size in the plan:
level 0 gets so many bits a key that it mistakes no more keys than are listed, however many the corpus has, and keys
that need more than one filter's bits are dealt by hash over several cascades.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.session import staged


@dataclass(frozen=True)
class Cascade:
    """Bits of each level, with the number of bits and of hash functions."""

    levels: tuple[tuple[int, int, bytes], ...] = ()

    def listed(self, key: Column) -> Column:
        """Whether a key of the corpus is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.passes(key, i), answer).otherwise(F.lit(i % 2 == 1))
        return answer

    def passes(self, key: Column, level: int) -> Column:
        m, k, bits = self.levels[level]
        data = F.unhex(F.lit(bits.hex()))

        def is_set(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring(data, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1

        return reduce(lambda a, b: a & b, [is_set(p) for p in positions(key, level, m, k)])


@dataclass(frozen=True)
class UrlRules:
    """`block` and `allow` hold host and path prefix in one string (`net/de/`); `labels` are blocked host labels."""

    block: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    bits_per_key: int = 8
    max_bits: int = field(default=1 << 23)


@dataclass(frozen=True)
class Dealt:
    """Cascades for keys dealt by hash."""

    parts: tuple[Cascade, ...]

    def listed(self, key: Column) -> Column:
        at = part_of(key, len(self.parts))
        return reduce(lambda rest, i: F.when(at == i, self.parts[i].listed(key)).otherwise(rest), range(len(self.parts)), F.lit(False))


class TooManyBits(ValueError):
    """The keys of one filter need more than its bits."""


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))


def positions(key: Column, level: int, m: int, k: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(m)) for i in range(k)]


def _bits(keys: DataFrame, level: int, n: int, per_key: int, max_bits: int) -> tuple[int, int, bytes]:
    """The filter of `n` keys. Its bytes are or-ed in Spark; at most `max_bits / 8` rows reach the driver."""
    m, k = max(64, -(-n * per_key // 8) * 8), max(1, round(per_key * 0.69))
    if m > max_bits:
        raise TooManyBits(f"{n} keys need more than {max_bits} bits")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level, m, k))).alias("at"))
    byte = F.floor(F.col("at") / 8).alias("byte")
    found = at.groupBy(byte).agg(F.bit_or(F.pow(F.lit(2), F.col("at") % 8).cast("int")).alias("bits")).collect()
    out = bytearray(m // 8)
    for row in found:
        out[row["byte"]] = row["bits"]
    return m, k, bytes(out)


def build_cascade(listed: DataFrame, universe: DataFrame, per_key: int = 8, max_bits: int = 1 << 23) -> Cascade | Dealt:
    """What tells listed keys from all other keys of the universe. Both frames hold a column `key`.

    Nulls are no keys, repeated keys count once, an empty list gives a cascade that lists nothing. The universe is
    scanned once to count its keys, and once for each part; what passes level 0 by mistake is stored, and all further
    levels look at that and at the list. `per_key` is the least number of bits a key. Parts are doubled until each
    filter has at most `max_bits`.
    """
    inside = staged(listed.where("key IS NOT NULL").distinct(), "listed")
    n = inside.count()
    if not n:
        return Cascade()
    known = universe.where("key IS NOT NULL")
    distinct = known.agg(F.approx_count_distinct("key")).first()[0]
    first = max(per_key, ceil(log2(max(2, distinct / n)) / 0.69))
    parts = ceil(n * first / max_bits)
    while True:
        try:
            if parts == 1:
                return _cascade(inside, known, first, per_key, max_bits)
            at = part_of(F.col("key"), parts)
            return Dealt(tuple(_cascade(inside.where(at == i), known.where(at == i), first, per_key, max_bits) for i in range(parts)))
        except TooManyBits:
            if parts > 2 * n:
                raise
            parts *= 2


def _cascade(inside: DataFrame, universe: DataFrame, first: int, per_key: int, max_bits: int) -> Cascade:
    n = inside.count()
    if not n:
        return Cascade()
    cascade = Cascade((_bits(inside, 0, n, first, max_bits),))
    wrong = universe.where(cascade.passes(F.col("key"), 0)).select("key", F.lit(0).alias("is_listed"))
    both = wrong.union(inside.select("key", F.lit(1).alias("is_listed")))
    outside = staged(both.groupBy("key").agg(F.max("is_listed").alias("is_listed")).where("is_listed = 0").select("key"), "mistakes")
    sides = [inside, outside]
    for level in range(1, 64):
        encoded = sides[level % 2]
        n = encoded.count()
        if not n:
            return cascade
        cascade = Cascade((*cascade.levels, _bits(encoded, level, n, per_key, max_bits)))
        other = sides[(level + 1) % 2]
        sides[(level + 1) % 2] = staged(other.where(cascade.passes(F.col("key"), level)), "mistakes")
    raise RuntimeError(f"the cascade does not end for {inside.sparkSession.sparkContext.appName}: raise bits_per_key")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without `://`. Only A-Z is lower-cased."""
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _shape(rule: str) -> tuple[int, int]:
    """How many host labels and how many characters of the path a rule looks at."""
    host, slash, path = rule.partition("/")
    return host.count(".") + 1, len(slash + path)


def _candidates(host: Column, path: Column, rules: UrlRules) -> list[Column]:
    """Every key of the shapes that rules have; the number of shapes is bounded by the list, not by the corpus."""
    shapes = sorted({_shape(r) for r in (*rules.block, *rules.allow)})
    return [F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, length)) for n, length in shapes]


def judge_urls(urls: DataFrame, rules: UrlRules, url: str = "url") -> DataFrame:
    """All columns of `urls` and host, path, rule (the longest that fits, or null) and verdict (`allow` or `block`).

    A rule fits its host and all subdomains if the path starts with the rule's. Without a rule, a URL is blocked if a
    label of its host is listed. Equal block and allow rules block. A null URL, or one without `://`, has an empty host
    and path and is allowed. Repeated rows are judged each for itself; own columns named like the four are replaced.
    """
    spark: SparkSession = urls.sparkSession
    host, path = url_parts(F.col(url))
    parted = urls.withColumns({"host": host, "path": path})
    keys = _candidates(F.col("host"), F.col("path"), rules)
    tagged = [F.concat(F.lit(f"{action} "), key) for action in ("allow", "block") for key in keys]
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("label "), x))
    universe = parted.select(F.explode(F.concat(F.array(*tagged), labels) if tagged else labels).alias("key"))
    listed = [*(f"block {r}" for r in rules.block), *(f"allow {r}" for r in rules.allow), *(f"label {x}" for x in rules.labels)]
    inside = spark.range(1).select(F.explode(F.array(*map(F.lit, listed)) if listed else F.expr("CAST(array() AS array<string>)")).alias("key"))
    cascade = build_cascade(inside, universe, rules.bits_per_key, rules.max_bits)
    fits = [
        F.when(cascade.listed(F.concat(F.lit(f"{action} "), key)), F.struct(F.length(key).alias("n"), F.lit(action).alias("action"), key.alias("rule")))
        for action in ("allow", "block") for key in keys
    ]
    best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,action:string,rule:string>")
    by_label = F.when(F.exists(labels, cascade.listed), "block").otherwise("allow")
    return parted.withColumn("rule", best["rule"]).withColumn("verdict", F.coalesce(best["action"], by_label))
