"""URL filters by Bloom filter cascades, native.

A cascade holds a set of listed keys exactly with respect to a universe of keys: level 0 is a Bloom filter of the listed
keys, level 1 of the universe's keys that pass level 0 though not listed, level 2 of the listed keys that pass level 1,
and so on until no false positive is left.  A key is listed if the first level that rejects it is an odd one.  The
universe here is every key that any URL of the corpus can be asked about, so the answer is exact for the corpus.
Levels are one-row tables read as uncorrelated scalar subqueries: no joins, no Python, no driver-side copy.

Size: level 0 takes ``len(listed) * log2(universe / listed) * 1.44`` bits, the levels below together less; the listed
keys bound it, the corpus only by the logarithm.  A filter has at most ``MAX_BITS``; longer lists are divided by hash into several
cascades, and the table of judged rows is written between them, so that no more than one division is in memory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, column, table, whole_row

#: Bits of one filter; more listed keys are divided by their hashes into cascades of their own, applied one after the other.
MAX_BITS = 1 << 26
MAX_LEVELS = 48


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed_keys(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, cls) of ``host/path`` strings with their classes, without leaving the JVM."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("key"), F.lit("").alias("cls"))
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(c).alias("cls")) for k, c in rules])
    return spark.range(1).select(F.inline(rows))


def positions(key: str, level: int, k: int, m: int) -> str:
    """SQL for the k bit positions of a key: double hashing on the halves of one 64-bit hash, no overflow under ANSI."""
    h = f"xxhash64({key}, {level})"
    return f"transform(sequence(0, {k - 1}), i -> pmod(shiftrightunsigned({h}, 33) + cast(i as bigint) * (({h} & 2147483647L) | 1L), {m}L))"


def passes(bits: str, key: str, level: int, k: int, m: int) -> str:
    return f"forall({positions(key, level, k, m)}, p -> shiftrightunsigned(get({bits}, cast(shiftright(p, 6) as int)), cast(p & 63L as int)) & 1L = 1L)"


def bloom(keys: DataFrame, level: int, k: int, m: int) -> DataFrame:
    """One row, one array of 64-bit words."""
    spark = keys.sparkSession
    set_bits = keys.select(F.explode(F.expr(positions("key", level, k, m))).alias("p")).select(F.expr("shiftright(p, 6)").alias("w"), F.expr("shiftleft(1L, cast(p & 63L as int))").alias("b"))
    words = spark.range(m // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = words.union(set_bits).groupBy("w").agg(F.bit_or("b").alias("b"))
    return words.agg(F.expr("transform(sort_array(collect_list(struct(w, b))), x -> x.b)").alias("bits"))


def first_hashes(n: int, universe_bound: int) -> int:
    """Hashes of level 0: so that about as many keys pass falsely as are listed."""
    return max(2, math.ceil(math.log2(max(2.0, universe_bound / (0.7 * n)))))


class Cascade:
    """Exact membership of ``listed`` (key) among ``universe`` (key) and the listed keys themselves."""

    def __init__(self, work: Workspace, universe: DataFrame, listed: DataFrame, universe_bound: int):
        self.work, self.levels = work, []
        listed = work.write(listed.select("key").distinct())
        n = listed.count()
        if not n:
            return
        self.add(listed, n, first_hashes(n, universe_bound))
        # Of the universe only what passes level 0 is kept: about as many keys as are listed.
        seen = self.passing(universe.select("key"), 0).withColumn("is_listed", F.lit(False)).union(listed.withColumn("is_listed", F.lit(True)))
        both = work.write(seen.groupBy("key").agg(F.max("is_listed").alias("is_listed")))
        encoded, others = both.where("is_listed").select("key"), both.where("not is_listed").select("key")
        while n := others.count():
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError("the cascade does not end: two keys share their hashes")
            self.add(others, n, 2)
            encoded, others = others, self.passing(encoded, len(self.levels) - 1)

    def add(self, keys: DataFrame, n: int, k: int) -> None:
        m = -(-max(64, math.ceil(n * k / math.log(2))) // 64) * 64
        self.levels.append((self.work.write(bloom(keys, len(self.levels), k, m)), k, m))

    def passing(self, keys: DataFrame, level: int) -> DataFrame:
        bits, k, m = self.levels[level]
        return keys.withColumn("bits", bits.scalar()).where(F.expr(passes("bits", "key", level, k, m))).select("key")

    def attach(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """The frame with the levels as columns, and SQL of the membership of a lambda variable ``c``."""
        sql = "true" if len(self.levels) % 2 else "false"
        for i in reversed(range(len(self.levels))):
            bits, k, m = self.levels[i]
            df = df.withColumn(f"{name}_{i}", bits.scalar())
            sql = f"if({passes(f'{name}_{i}', 'c', i, k, m)}, {sql}, {'true' if i % 2 else 'false'})"
        return df, sql


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", rank: tuple[str, ...] = ("allow", "block"), max_bits: int = MAX_BITS) -> DataFrame:
    """(row, host, path, rule, listed, verdict) of every row; ``row`` is the whole input row as a struct, whatever its names.

    rules: (key, cls); a key is a host followed by a path prefix and fits its host and all subdomains.  The classes in
    ``rank`` decide by the longest key, for one key in several classes by the later one in ``rank``; other classes are block lists
    that apply where no rule fits (``listed``: their longest key that fits).  ``default`` is the verdict of the rest, of null
    and malformed urls too.  Null and empty keys are no rules; repeated rules and rows change nothing for others; empty tables are fine.
    """
    work = Workspace(pages.sparkSession, "url_filter")
    cls = F.array_position(F.array(*[F.lit(c) for c in rank]), F.col("cls")) - 1
    rules = work.write(rules.where("key is not null and key != ''").select("key", F.when(cls >= 0, cls).otherwise(len(rank)).cast("int").alias("cls")).distinct())
    # Suffixes of the host by their number of labels, and for each the lengths of path prefixes that occur in the rules.
    shapes: dict[int, list[int]] = {}
    for k, n in rules.select(F.expr("size(split(substring_index(key, '/', 1), '[.]'))").alias("k"), F.expr("length(key) - length(substring_index(key, '/', 1))").alias("n")).distinct().collect():
        shapes.setdefault(k, []).append(n)
    host, path = split_url(column(url))
    judged = pages.select(whole_row(pages).alias("row"), host.alias("host"), path.alias("path"))
    keys = [f"transform(filter(array({', '.join(map(str, sorted(ns)))}), n -> n <= length(path)), n -> concat(substring_index(host, '.', -{k}), left(path, n)))" for k, ns in sorted(shapes.items())]
    judged = judged.withColumn("keys", F.expr(f"array_distinct(concat({', '.join(keys)}))" if keys else "cast(array() as array<string>)"))
    asked = judged.select(F.explode("keys").alias("key"))
    bound = pages.count() * sum(map(len, shapes.values()))
    counts = dict(rules.groupBy("cls").count().collect())
    none = "cast(null as struct<n: int, key: string, cls: int>)"
    judged = judged.withColumns({"rule": F.expr(none), "listed": F.expr(none)})
    for i in sorted(counts):
        into, listed = ("rule" if i < len(rank) else "listed"), rules.where(F.col("cls") == i)
        parts = max(1, math.ceil(counts[i] * first_hashes(counts[i], bound) / math.log(2) / max_bits))
        for p in range(parts):
            mine = f"pmod(xxhash64(%s, 'part'), {parts}) = {p}"
            one = parts == 1
            found, sql = Cascade(work, asked if one else asked.where(mine % "key"), listed if one else listed.where(mine % "key"), bound).attach(judged, f"bits{i}")
            hits = f"transform(filter(keys, c -> {'' if one else mine % 'c' + ' and '}{sql}), c -> struct(length(c) as n, c as key, {i} as cls))"
            judged = found.withColumn(into, F.greatest(into, F.expr(f"array_max({hits})"))).select(judged.columns)
            if not one:
                judged = work.write(judged)
    names = F.array(*[F.lit(c) for c in rank])
    verdict = F.coalesce(F.get(names, F.col("rule.cls")), F.when(F.col("listed").isNotNull(), "block"), F.lit(default))
    return judged.select("row", "host", "path", F.col("rule.key").alias("rule"), F.col("listed.key").alias("listed"), verdict.alias("verdict"))


# Fixed values of the query's contract.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: The method's own block list is made of the corpus's hosts that have one of these words, between dots and dashes.
SPAM_WORDS = ["adult", "ads", "bet", "bets", "betting", "casino", "cialis", "clickbait", "crack", "escort", "forex", "gambling", "jackpot", "keygen", "lottery", "payday", "pharma", "phishing", "pills", "poker", "popunder", "porn", "replica", "sex", "slots", "spam", "torrent", "tracker", "track", "viagra", "warez", "xxx"]


def spam_hosts(pages: DataFrame, url: str = "url", words: list[str] = SPAM_WORDS) -> DataFrame:
    """(key, cls) of the distinct hosts that have a word of spam: a block list that grows with the corpus."""
    host, _ = split_url(column(url))
    return pages.select(host.alias("key")).where(F.arrays_overlap(F.split("key", "[.-]"), F.array(*[F.lit(w) for w in words]))).distinct().select("key", F.lit("spam").alias("cls"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, listed_keys(spark, RULES).union(spam_hosts(pages))).select("row.page_id", "host", "path", "rule", "verdict")


ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {', '.join(f"('{k.split('/')[0]}', '/{k.split('/', 1)[1]}', '{k}', '{c}')" for k, c in RULES)}) AS t(h, pre, rule, cls)),
m AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(cls, length(rule)) AS cls FROM p, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY host, path)
SELECT p.page_id, host, path, rule, coalesce(cls, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), {SPAM_WORDS}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (host, path)
"""
