"""URL filters by a cascade of Bloom filters that is exact over the corpus's own keys.

A rule is a host and the start of a path, like ``example.net/en/``; it fits its host and all
subdomains. A url's keys are its host's endings and its path's starts of the lengths that rules have.
The distinct keys of all urls are the universe. The first level of a cascade encodes the listed keys,
the second the keys of the universe that pass the first without being listed, the third the listed
keys that pass the second, and so on until a level lets nothing false through. Every key of the
universe is then decided exactly by the first level that does not hold it, with no join: the levels
are a few arrays, looked up in plain expressions.

The first level is sized so that about as many unlisted keys pass it as there are listed ones, and
later levels halve that, so the cascade's size follows the rules and not the corpus. Its bits are
counted before use; beyond ``MAX_BITS`` an error says so and nothing is judged by halves.

A url that is null or has no ``://`` has an empty host and path and no rule. Where no rule fits, the
key is not listed and the verdict is allow. Rules with equal text count once, block before allow.
Repeated rows are judged alike; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.llm.common import stored

MAX_BITS = 1 << 26
LATER_BITS_PER_KEY = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)://(.*)$", 1))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def keys(host: Column, path: Column, lengths: Iterable[int], labels: Iterable[int]) -> Column:
    """All keys under which a rule could fit: the endings of the host with as many labels as rules
    have, times the starts of the path of their lengths."""
    present = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    endings = F.array(*[F.when(present >= n, F.substring_index(host, ".", -n)) for n in sorted(labels)])
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths)])
    whole = F.flatten(F.transform(endings, lambda e: F.transform(starts, lambda s: F.concat(e, s))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_compact(whole))


def _positions(key: Column, level: int, hashes: int, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level * 64 + h)), F.lit(bits)) for h in range(hashes)])


def _holds(key: Column, level: dict) -> Column:
    """Whether a level's filter has all bits of a key set."""
    if not level["words"]:
        return F.lit(False)
    words = F.lit(level["words"])
    found = F.lit(True)
    for h in range(level["hashes"]):
        at = F.pmod(F.xxhash64(key, F.lit(level["number"] * 64 + h)), F.lit(level["bits"]))
        word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
        moved = F.call_function("shiftrightunsigned", word, (at % 64).cast("int"))
        found = found & (moved.bitwiseAND(F.lit(1)) == 1)
    return found


def _level(members: DataFrame, number: int, hashes: int, bits: int) -> dict:
    """The filter of a set of keys: bits set by grouping, at most one row per word of 64 bits."""
    at = members.select(F.explode(_positions(F.col("key"), number, hashes, bits)).alias("at"))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    rows = at.groupBy(F.floor(F.col("at") / 64).alias("i")).agg(F.bit_or(word).alias("w")).collect()
    words = [0] * (-(-bits // 64))
    for r in rows:
        words[r["i"]] = r["w"]
    return {"number": number, "hashes": hashes, "bits": bits, "words": words if rows else []}


def cascade(universe: DataFrame, listed: list[str], max_bits: int = MAX_BITS) -> list[dict]:
    """Levels that decide every ``key`` of the universe exactly."""
    spark = universe.sparkSession
    n = max(1, len(listed))
    universe = universe.select("key").distinct()
    present = F.col("key").isin(listed) if len(listed) <= 1000 else None
    names = spark.createDataFrame([(x,) for x in listed], "key string")
    if present is None:
        inside = stored(universe.join(names, "key", "left_semi"))
        outside = stored(universe.join(names, "key", "left_anti"))
    else:
        inside, outside = stored(universe.filter(present)), stored(universe.filter(~present))
    ratio = max(2.0, outside.count() / n)
    per_key = max(4.0, log2(ratio) / log(2))
    levels: list[dict] = []
    members, others = inside, outside
    while True:
        size = members.count()
        if not size:
            break
        bits = max(64, ceil(size * (per_key if not levels else LATER_BITS_PER_KEY)))
        if bits > max_bits:
            raise ValueError(f"a level of {bits} bits exceeds {max_bits}; list fewer keys or raise max_bits")
        hashes = max(1, min(16, round(bits / size * log(2))))
        levels.append(_level(members, len(levels), hashes, bits))
        members, others = stored(others.filter(_holds(F.col("key"), levels[-1]))), members
    return levels


def listed(key: Column, levels: list[dict]) -> Column:
    """Exact membership: the first level that does not hold the key decides; odd levels mean no."""
    result = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        result = F.when(_holds(key, levels[i]), result).otherwise(F.lit(i % 2 == 1))
    return result


def judge(pages: DataFrame, block: Iterable[str], allow: Iterable[str], max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row; the longest rule that fits decides."""
    block = sorted(set(block))
    allow = sorted(set(allow) - set(block))
    lengths = {len(rule) - rule.index("/") for rule in [*block, *allow]}
    labels = {rule[: rule.index("/")].count(".") + 1 for rule in [*block, *allow]}
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    offered = split.withColumn("_keys", keys(F.col("host"), F.col("path"), lengths, labels))
    universe = stored(offered.select(F.explode("_keys").alias("key")).distinct())
    blocked, allowed = cascade(universe, block, max_bits), cascade(universe, allow, max_bits)

    def longest(levels: list[dict]) -> Column:
        fit = F.filter("_keys", lambda k: listed(k, levels))
        return F.array_max(F.transform(fit, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))

    found = offered.withColumn("_block", longest(blocked)).withColumn("_allow", longest(allowed))
    by_block = F.coalesce(F.col("_block.n"), F.lit(0)) >= F.coalesce(F.col("_allow.n"), F.lit(0))
    rule = F.when(by_block, F.col("_block.rule")).otherwise(F.col("_allow.rule"))
    verdict = F.when(by_block & F.col("_block").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


RULES = {"block": ["net/", "example.com/de/"], "allow": ["example.net/en/", "org/fr/"]}

SQL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
    VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
           ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fitting AS (
    SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
           row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS place
    FROM parts p LEFT JOIN rules r
      ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE place = 1
"""
