"""Sharding by histogram sort.

Documents are ordered by (crc32 of the text, doc_id, row), so that equal texts stand together.  The boundaries of the
shards are found by counting, exactly and over all partitions, the bytes and rows below candidate boundaries: each round
divides the interval that still holds a boundary into finer probes, until the bytes below a probe are within the
tolerance of the boundary's share, or the interval is a single row.  A boundary stays between two checksums, and
so keeps groups of equal texts whole, unless a group is larger than the tolerance allows.  Then rows move once.

Texts are read once; the rounds run on a table of four numbers a row.  The driver sees a bounded histogram:
65536 probes in the first round, then at most 256 probes for each open boundary.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, column, table

#: Key digits, from the most significant one: (column, shift, bits).
DIGITS = [("k0", 16, 16), ("k0", 8, 8), ("k0", 0, 8), *[("k1", s, 8) for s in range(56, -1, -8)], *[("k2", s, 8) for s in range(56, -1, -8)]]


def digit(i: int) -> Column:
    name, shift, bits = DIGITS[i]
    return F.expr(f"shiftrightunsigned({name}, {shift}) & {(1 << bits) - 1}L")


def splitters(keys: DataFrame, parts: int, per_shard: int, tolerance: float) -> list[dict]:
    """The boundaries below parts 1, 2, ...: key prefix (digits so far), bytes and rows below, best first found exact."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    found = [{"goal": total[0] * p / parts, "prefix": (), "bytes": 0, "rows": 0, "open": bool(total[1]), "shard": p % per_shard == 0} for p in range(1, parts)]
    for s in found:
        s["at"] = (s["prefix"], s["bytes"], s["rows"])  # the best probe: the boundary lies before the keys from this prefix on
    for depth in range(len(DIGITS)):
        prefixes = sorted({s["prefix"] for s in found if s["open"]})
        if not prefixes:
            break
        below = [digit(i).alias(f"d{i}") for i in range(depth + 1)]
        rows = keys.select(*below, "size")
        if depth:
            spark = keys.sparkSession
            wanted = spark.createDataFrame([list(p) for p in prefixes], ", ".join(f"d{i} long" for i in range(depth)))
            rows = rows.join(F.broadcast(wanted), [f"d{i}" for i in range(depth)])  # at most a row for each boundary
        names = [f"d{i}" for i in range(depth + 1)]
        counts: dict[tuple, list] = {}
        for r in rows.groupBy(*names).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(tuple(r[:depth]), []).append((r[depth], r["b"], r["n"]))
        for part in counts.values():
            part.sort()
        for s in found:
            if not s["open"]:
                continue
            part = counts[s["prefix"]]
            ends = [s["bytes"] + x for x in accumulate(p[1] for p in part)]
            j = min(bisect.bisect_left(ends, s["goal"]), len(part) - 1)
            rows_before = s["rows"] + sum(p[2] for p in part[:j])
            bytes_before = ends[j] - part[j][1]
            # Probes at both ends of the interval that holds the goal.
            for b, n, d in ((bytes_before, rows_before, part[j][0]), (ends[j], rows_before + part[j][2], part[j][0] + 1)):
                if abs(b - s["goal"]) < abs(s["at"][1] - s["goal"]):
                    s["at"] = (s["prefix"] + (d,), b, n)
            s["prefix"], s["bytes"], s["rows"] = s["prefix"] + (part[j][0],), bytes_before, rows_before
            s["open"] = part[j][2] > 1 and not (depth >= 2 and abs(s["at"][1] - s["goal"]) <= tolerance)
    return found


def histogram_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", per_shard: int = 8, tolerance: float = 0.005) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row, by the law of near-equal bytes.

    Size: UTF-8 bytes of the text (null: none) plus 8.  ``tolerance``: as a share of a shard, how far a boundary may be
    off its place in order to stay between different checksums.  Each shard is written by ``per_shard`` tasks, whose
    offsets come from the histograms.  A null doc_id sorts first; repeated rows are told apart by their place.
    """
    work = Workspace(docs.sparkSession, "sharding")
    body = F.coalesce(column(text), F.lit(""))
    keys = docs.select(column(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    lowest = F.lit(-(1 << 63)).cast("long")
    # k1: doc_id with its sign bit turned, so that unsigned digits keep the order.
    keys = work.write(keys.withColumns({"k0": F.col("text_crc32"), "k1": F.coalesce(F.col("doc_id"), lowest).bitwiseXOR(lowest), "k2": F.monotonically_increasing_id()}))
    parts = shards * per_shard
    total = keys.agg(F.sum("size")).first()[0] or 0
    found = splitters(keys, parts, per_shard, tolerance * total / shards)
    bounds, starts = [], [0]
    for s in found:
        prefix, _, below = s["at"]
        if bounds and below < starts[-1]:
            prefix, below = bounds[-1], starts[-1]
        bounds.append(prefix)
        starts.append(below)

    def before(prefix: tuple) -> Column:
        """Whether a row's key lies below a boundary."""
        out = F.lit(False)
        for i in reversed(range(len(prefix))):
            d = digit(i)
            out = (d < F.lit(prefix[i])) | ((d == F.lit(prefix[i])) & out)
        return out

    def place(lo: int, hi: int) -> Column:
        """Binary search among the boundaries, as nested conditions."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(before(bounds[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    from pyspark.sql import Window

    first = [starts[(p // per_shard) * per_shard] for p in range(parts)]
    offsets = F.array(*[F.lit(starts[p] - first[p]).cast("long") for p in range(parts)])
    ranked = keys.withColumn("part", place(0, parts - 1)).withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("k0", "k1", "k2")))
    return ranked.select("doc_id", "size", "text_crc32", F.expr(f"part div {per_shard}").cast("int").alias("shard"), (F.get(offsets, F.col("part")) + F.col("rank") - 1).cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
