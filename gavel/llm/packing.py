"""Best-fit packing with conflicts.

Documents are packed into bins (training contexts) of ``capacity`` words, longest first.  Open bins are kept in the order
of their residual capacity, each with a bitmap of the sources and one of the duplicate clusters that it holds.  A document's
search starts at the successor of its size, the tightest bin that it fits into, and goes on to the next larger residual until a
bin shares neither its source nor its duplicate cluster; if there is none, it opens a bin.

A text longer than a bin fills bins of its own; only its remainder is packed.  Documents are dealt by a hash into groups
of bounded size, packed side by side: conflicts only concern documents of one bin, so nothing is lost but the ends of each
group's last bins.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, column, table, word_count

CAPACITY, GROUP_ROWS = 2048, 4096


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each document; bins are numbered in the order in which they are opened.  Sizes: 1 ... capacity."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    seen, twice = set(), {}
    for c in clusters:
        if c in seen:
            twice.setdefault(c, 1 << len(twice))
        seen.add(c)
    out, residual = [0] * len(sizes), []  # residual: (capacity left, bin), sorted
    source_map, cluster_map = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s, c = source_bit[sources[i]], twice.get(clusters[i], 0)
        for at in range(bisect_left(residual, (sizes[i], -1)), len(residual)):
            left, b = residual[at]
            if not (source_map[b] & s or cluster_map[b] & c):
                del residual[at]
                break
        else:
            left, b = capacity, len(source_map)
            source_map.append(0)
            cluster_map.append(0)
        source_map[b] |= s
        cluster_map[b] |= c
        out[i] = b
        if left > sizes[i]:
            insort(residual, (left - sizes[i], b))
    return out


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster", "row_no"], na_position="first", kind="stable").reset_index(drop=True)
        whole = [max(0, math.ceil(n / capacity) - 1) for n in pdf["size"]]
        rest = [n - w * capacity for n, w in zip(pdf["size"], whole)]
        some = [i for i, n in enumerate(rest) if n > 0]
        source = pdf["source"].astype(object).where(pdf["source"].notna(), None).tolist()
        bins = pack([rest[i] for i in some], [source[i] for i in some], [pdf["cluster"][i] for i in some], capacity)
        fill: dict[int, list[int]] = {}
        rows = []
        for i, b in zip(some, bins):
            place = fill.setdefault(b, [0, 0])
            rows.append((i, whole[i], b, place[0], place[1], rest[i]))
            place[0], place[1] = place[0] + 1, place[1] + rest[i]
        following = len(fill)
        for i, w in enumerate(whole):
            for piece in range(w):
                rows.append((i, piece, following, 0, 0, capacity))
                following += 1
        at = [r[0] for r in rows]
        out = pd.DataFrame({n: [r[k] for r in rows] for k, n in enumerate(("i", "piece", "bin", "position", "offset", "n_words"))})
        return pd.DataFrame({"row_no": pdf["row_no"].to_numpy()[at], "doc_id": pdf["doc_id"].iloc[at].to_numpy(), "grp": pdf["grp"].to_numpy()[at], "source": [source[i] for i in at], "cluster": pdf["cluster"].to_numpy()[at], "piece": out["piece"].to_numpy(), "bin_no": out["bin"].to_numpy(), "position": out["position"].to_numpy(), "start_word": out["offset"].to_numpy(), "n_words": out["n_words"].to_numpy()})

    return run


def best_fit(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster=None) -> DataFrame:
    """(doc_id, piece, bin_id, position, start_word, n_words, source, cluster): where each piece of each text lies.

    ``cluster``: a column that names the duplicate cluster; by default a hash of the text with A-Z lower-cased (two
    texts that share it only avoid each other).  Texts without words, null ones too, take no place and have no row; a
    null source is a source; repeated rows are pieces of one cluster.  bin_id is group * 2**32 + the bin's number there.
    """
    work = Workspace(docs.sparkSession, "packing")
    key = F.xxhash64(ascii_lower(column(text))) if cluster is None else cluster.cast("long")
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(source).cast("string").alias("source"), F.coalesce(key, F.lit(0)).alias("cluster"), word_count(column(text)).alias("size")).where("size > 0")
    rows = work.write(rows.withColumn("row_no", F.monotonically_increasing_id()))
    groups = max(1, round(rows.count() / group_rows))
    # Dealt by row, not by source or cluster: no group is larger than the others.
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(groups)).cast("long")).withColumn("size", F.col("size").cast("long"))
    schema = "row_no long, doc_id long, grp long, source string, cluster long, piece long, bin_no long, position long, start_word long, n_words long"
    packed = dealt.groupBy("grp").applyInPandas(_pack_group(capacity), schema)
    return packed.select("doc_id", "piece", F.expr("grp * 4294967296L + bin_no").alias("bin_id"), "position", "start_word", "n_words", "source", "cluster")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
