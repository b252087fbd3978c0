"""N-gram Jaccard join by prefix trees.

Documents are sets of word shingles.  Equal sets are collapsed first.  A global order puts rare shingles first, so two sets
over the threshold share one of their first ``n - ceil(t n) + 1`` shingles: candidates meet in the groups of such a shingle.  Each
family's whole sets are stored, in one order, in a trie; a set is matched by one traversal that shares partial overlaps between
all sets with a common beginning and prunes subtrees whose remaining lengths cannot reach the needed overlap.  Links are
verified exactly; since the result is connected components, subtrees already connected to the set are pruned too.

The order needs frequencies only for the shingles it ranks first.  So only a fixed region of the hash space is counted
(``1.75 (1 - t)`` of it), ranked by (frequency, hash); shingles outside follow by hash.  A set shorter of region shingles than
its prefix adds the next ones.  Sets whose prefix holds no shared shingle are linked with nothing and are never read again.

Skew: equal sets count once.  Frequencies come from an aggregate with map-side combining, and are joined back by a merge whose
other side has one row for each shingle, so that adaptive execution can split a shingle of any number of sets; nothing is ever
gathered by shingle.  Groups that share sets form families, and a set is searched once in its family.  A large family is searched in blocks that share random pivots; where that leaves a shingle's group in more
than one component, what lies outside the group's largest component is searched against the whole group: no link is lost and no
cap is set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, LOWER, UPPER, WordHasher, Workspace, column, mix, shingle_set, table, whole_row

BLOCK, BLOCK_TOKENS, PIVOTS = 512, 1 << 20, 24
#: Ids are broadcast up to so many, about 32 MB; beyond, the tables are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    with np.errstate(over="ignore"):
        a = mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
        b = mix(s * np.uint64(0x9FB21C651E98DF25) + np.uint64(len(s))).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _first_tokens(width: int, num: int, den: int, region: int):
    """Per document: n, digest, how many the prefix lacks of the region's shingles (or, below 0, has too many), first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            n, a, b, slack, tokens = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(hasher((text.as_py() or b"").translate(FOLD)), width)
                prefix = len(s) + num * len(s) // -den + 1 if len(s) else 0  # n - ceil(t n) + 1
                inside = int(np.searchsorted(s, np.uint64(region)))
                da, db = _digest(s)
                n.append(len(s))
                a.append(da)
                b.append(db)
                slack.append(prefix - inside)
                tokens.append(s[: max(inside, prefix)].view(np.int64))
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(t) for t in tokens]))), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(slack, pa.int32()), lists], names=["doc_id", "n", "a", "b", "slack", "tokens"])

    return run


def _whole_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(hasher((text.as_py() or b"").translate(FOLD)), width)
                a, b = _digest(s)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([b], pa.int64()), pa.array([len(s)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s.view(np.int64)))], names=["a", "b", "n", "items"])

    return run


class Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


class Level(NamedTuple):
    """The trie's nodes at one distance from the root, by arrays."""

    parent: np.ndarray  # place in the level above
    pool: np.ndarray  # items on the edges to the nodes, edge after edge
    start: np.ndarray  # of each edge in the pool
    depth: np.ndarray  # items from the root to the end of the edge
    last: np.ndarray  # last item of the edge
    least: np.ndarray  # sizes of the sets below
    most: np.ndarray
    ends: list[tuple[int, int]]  # (node, set) of the sets that end at a node of this level


def grow(sets: list[np.ndarray]) -> list[Level]:
    """The compressed prefix tree of sets of ascending items, level by level."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
    depth, parent, one, ends = [0], [-1], [-1], []
    stack, before = [0], None
    for i in order:
        s = sets[i]
        common = 0
        if before is not None:
            k = min(len(before), len(s))
            differ = np.flatnonzero(before[:k] != s[:k])
            common = int(differ[0]) if len(differ) else k
        popped = -1
        while depth[stack[-1]] > common:
            popped = stack.pop()
        if depth[stack[-1]] < common:  # split the edge to the node left last
            depth.append(common)
            parent.append(stack[-1])
            one.append(i)
            parent[popped] = len(depth) - 1
            stack.append(len(depth) - 1)
        if len(s) > common:
            depth.append(len(s))
            parent.append(stack[-1])
            one.append(i)
            stack.append(len(depth) - 1)
        ends.append((stack[-1], i))
        before = s
    n = len(depth)
    least, most, level = [1 << 60] * n, [0] * n, [-1] * n
    for node, i in ends:
        least[node] = most[node] = len(sets[i])
    by_depth = sorted(range(1, n), key=depth.__getitem__)
    for v in reversed(by_depth):
        u = parent[v]
        least[u], most[u] = min(least[u], least[v]), max(most[u], most[v])
    rows: list[list[int]] = []
    place = [0] * n
    for v in by_depth:
        level[v] = level[parent[v]] + 1
        if level[v] == len(rows):
            rows.append([])
        place[v] = len(rows[level[v]])
        rows[level[v]].append(v)
    out = []
    for nodes in rows:
        edges = [sets[one[v]][depth[parent[v]] : depth[v]] for v in nodes]
        start = np.concatenate(([0], np.cumsum([len(e) for e in edges])[:-1])).astype(np.int64)
        pick = lambda x: np.array([x[v] for v in nodes], np.int64)  # noqa: B023, E731
        out.append(Level(np.array([place[parent[v]] for v in nodes]), np.concatenate(edges), start, pick(depth), np.array([e[-1] for e in edges]), pick(least), pick(most), []))
    for node, i in ends:
        out[level[node]].ends.append((place[node], i))
    return out


def matches(tree: list[Level], queries: list[np.ndarray], vocabulary: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """(query, set) of every pair over the threshold.

    One walk down the tree for a batch of queries: each node's overlap is its parent's and its edge's; a subtree goes on for a
    query only while what is left of the query and of the subtree's longest set can still reach the overlap that its
    shortest set needs.
    """
    batch = int(np.clip((1 << 23) // max(1, vocabulary, *(len(x.pool) for x in tree)), 1, 64))
    for at in range(0, len(queries), batch):
        part = queries[at : at + batch]
        inside = np.zeros((len(part), vocabulary), np.uint8)
        for q, x in enumerate(part):
            inside[q, x] = 1
        size = np.array([len(x) for x in part], np.int64)[:, None]
        overlap, alive = np.zeros((len(part), 1), np.int64), np.ones((len(part), 1), bool)
        for level in tree:
            alive = alive[:, level.parent] & (level.most * den >= num * size) & (level.least * num <= den * size)
            some = np.flatnonzero(alive.any(0))
            if not len(some):
                break
            overlap = overlap[:, level.parent] + np.add.reduceat(inside[:, level.pool], level.start, axis=1, dtype=np.int32)
            passed = np.stack([np.searchsorted(x, level.last, "right") for x in part])
            rest = np.minimum(size - passed, level.most - level.depth)
            # overlap o of sizes n, m is enough if (num + den) * o >= num * (n + m)
            alive &= (overlap + rest) * (num + den) >= num * (size + np.maximum(level.least, -(-num * size // den)))
            if level.ends:
                node = np.array([e[0] for e in level.ends])
                fits = alive[:, node] & (overlap[:, node] * (num + den) >= num * (size + level.depth[node]))
                for q, e in zip(*np.nonzero(fits)):
                    yield at + int(q), level.ends[int(e)][1]


def link(sets: list[np.ndarray], num: int, den: int, visiting: list[bool] | None = None) -> list[int]:
    """Component of each set (the least index in it).  With ``visiting``, only pairs of a visiting and another set count."""
    forest = Forest(len(sets))
    guests = [i for i in range(len(sets)) if visiting is None or visiting[i]]
    hosts = [i for i in range(len(sets)) if visiting is None or not visiting[i]]
    if not guests or not hosts:
        return forest.up
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int32)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.int32)  # frequent items first: long shared beginnings
    stops = np.cumsum([len(s) for s in sets])
    ranked = [np.sort(x) for x in np.split(rank[back], stops[:-1])]
    for q, i in matches(grow([ranked[i] for i in hosts]), [ranked[i] for i in guests], len(count), num, den):
        forest.join(guests[q], hosts[i])
    return [forest.find(i) for i in range(len(sets))]


def _link_group(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["uid"].to_numpy()
        visiting = pdf["visiting"].tolist() if "visiting" in pdf.columns else None
        found = link([np.asarray(x, np.int64) for x in pdf["items"]], num, den, visiting)
        rows = [(ids[i], ids[c]) for i, c in enumerate(found) if ids[i] != ids[c]]
        return pd.DataFrame({"u": [r[0] for r in rows], "v": [r[1] for r in rows]}, dtype="int64")

    return run


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(uid, label) of each node of (u, v): the least node connected to it; by minima over neighbours and pointer jumping."""
    both = work.write(edges.union(edges.select("v", "u")).distinct())
    labels = work.write(both.groupBy(F.col("u").alias("uid")).agg(F.min("v").alias("near")).select("uid", F.least("uid", "near").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("uid", "v"), "v").groupBy(F.col("u").alias("uid")).agg(F.min("label").alias("near"))
        moved = labels.withColumnRenamed("label", "was").join(near, "uid").select("uid", "was", F.least("was", "near").alias("to"))
        jump = labels.select(F.col("uid").alias("to"), F.col("label").alias("root"))
        following = work.write(moved.join(jump, "to").select("uid", F.least("to", "root").alias("label"), "was"))
        work.drop(labels)
        changed = not following.where("label != was").isEmpty()
        labels = following.select("uid", "label")
        labels.stored_at = following.stored_at
        if not changed:
            work.drop(both)
            return labels


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Two documents link if ``den * intersection >= num * union`` of their sets: the distinct shingles of ``width`` words (A-Z
    lower-cased, divided by ASCII white space); with fewer words, the whole sequence as one; without words, or a null text, empty
    and linked with nothing.  component_id is the smallest doc_id connected by links (null ids are larger than any).
    Shingles are compared by 64-bit, equal sets by 128-bit hashes.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "jaccard")
    region = min(1 << 63, int(1.75 * (1 - num / den) * (1 << 64)) + 1)
    body = F.coalesce(column(text), F.lit("")).cast("binary")
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), body.alias("body"))
    sets = rows.mapInArrow(_first_tokens(width, num, den, region), "doc_id long, n int, a long, b long, slack int, tokens array<long>")
    sets = work.write(sets.withColumn("uid", F.monotonically_increasing_id()))
    # One of equal sets goes on, under the smallest doc_id and the smallest uid, which may be of two rows.
    reps = work.write(sets.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("doc_id"), F.min("uid").alias("uid")))
    once = work.write(sets.select("uid", "slack", "tokens").join(reps.select("uid"), "uid", "left_semi"))
    tokens = once.select(F.explode("tokens").alias("token"), "uid", "slack")
    kept = prefix_tokens(tokens, region, work)
    work.drop(once)
    sets = work.write_over(sets, sets.drop("tokens", "slack"))
    labels = search(docs, reps, kept, width, num, den, doc_id, body, work)
    own = reps.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    heads = work.write(own.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    named = work.write(own.join(heads, "label").select("a", "b", "n", "component_id"))
    work.drop_all_but(named, sets)
    # A hot set's rows meet a single row here, read from a table: adaptive execution can split them.
    out = sets.select("doc_id", "a", "b", "n").join(named, ["a", "b", "n"], "left")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out.workspace = work
    return out


def prefix_tokens(tokens: DataFrame, region: int, work: Workspace) -> DataFrame:
    """(uid, token) for the shared shingles in each set's prefix."""
    freq = work.write(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"))
    # Both sides grow with the corpus: a merge at any size.
    shared = tokens.join(freq.hint("merge"), "token")
    inside = (F.col("token") >= 0) & (F.col("token") < region) if region < (1 << 63) else F.col("token") >= 0
    shared = shared.select("uid", "slack", F.struct(F.when(inside, F.col("freq")).otherwise(F.lit(1 << 60)).alias("freq"), "token").alias("t"))
    lists = shared.groupBy("uid", "slack").agg(F.sort_array(F.collect_list("t")).alias("ts"))  # at most a document's own
    keep = F.when(F.col("slack") > 0, F.size("ts")).otherwise(F.greatest(F.lit(0), F.size("ts") + F.col("slack")))
    kept = work.write(lists.withColumn("ts", F.slice("ts", F.lit(1), keep)).where("size(ts) > 0").select("uid", F.explode("ts.token").alias("token")))
    work.drop(freq)
    return kept


def search(docs: DataFrame, reps: DataFrame, kept: DataFrame, width: int, num: int, den: int, doc_id: str, body, work: Workspace) -> DataFrame:
    """(uid, label) of the sets that are linked with another."""
    # A shingle's group is divided by size classes: only sets of one class or of neighbouring ones can be linked, so a set
    # stands in two, as two nodes.  Keys are hashes: a collision only makes a group larger.
    at = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * (1 + 1e-9) if num < den else 1e-9))
    kept = kept.join(reps.select("uid", "n"), "uid").select("uid", "token", F.explode(F.array(at, at + 1)).alias("class"))
    kept = work.write(kept.select(F.xxhash64("token", "class").alias("token"), (F.col("uid") * 2 + F.pmod("class", F.lit(2))).alias("node")))
    sizes = kept.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where("size > 1")
    groups = work.write(kept.join(sizes, "token"))
    work.drop(kept)
    # Families: what shared shingles connect.  Links are inside families only, and most families are small.
    family = components(groups.where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v")), work)
    family = family.select(F.col("uid").alias("node"), F.expr("shiftright(uid, 1)").alias("uid"), F.col("label").alias("family"))
    members = work.write(family.join(reps, "uid"))
    wanted = members.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_none")).distinct()
    if members.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    key = column(doc_id).cast("long")
    texts = docs.select(F.coalesce(key, F.lit(-1)).alias("_id"), key.isNull().alias("_none"), body.alias("_body")).join(wanted, ["_id", "_none"], "left_semi").select("_body")
    whole = texts.mapInArrow(_whole_sets(width), "a long, b long, n int, items array<long>")
    whole = work.write(whole.join(members.select("a", "b", "n", "uid").distinct(), ["a", "b", "n"]).select("uid", "n", "items").dropDuplicates(["uid"]))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks")
    sized = work.write(members.groupBy("family").agg(F.count(F.lit(1)).alias("size"), blocks))
    placed = members.select("family", "uid").join(sized, "family")
    # A large family is searched in blocks that share a few random sets: enough to connect them if it is one component.
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("uid"), F.col("size")) < PIVOTS)
    own = F.expr("cast(pmod(xxhash64(uid, 0), blocks) as int)")
    placed = placed.select("family", "uid", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block"))
    edges = work.write(placed.join(whole, "uid").groupBy("family", "block").applyInPandas(_link_group(num, den), "u long, v long").distinct())
    labels = components(edges, work)
    large = sized.where("blocks > 1").select("family")
    if large.isEmpty():
        return labels
    # In large families, groups that still have several components: what is outside a group's largest component visits every
    # block of the group.  A group is all sets with a shingle, or the family itself where that makes fewer pairs.
    ours = groups.select("token", "node", "size").join(members.select("node", "uid", "family", "n"), "node").drop("node").join(large, "family", "left_semi").join(labels, "uid", "left")
    ours = work.write(ours.withColumn("label", F.coalesce("label", "uid")))
    dense = ours.groupBy("family").agg(F.sum("size").alias("pairs")).join(sized.where("blocks > 1"), "family").where("pairs >= size * size").select("family")
    dense = work.write(dense)
    rest = ours.join(dense, "family", "left_anti").select(F.lit(False).alias("whole"), F.col("token").alias("grp"), "uid", "n", "label")
    rest = work.write(rest.unionByName(ours.join(dense, "family").select(F.lit(True).alias("whole"), F.col("family").alias("grp"), "uid", "n", "label").distinct()))
    main = rest.groupBy("whole", "grp", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    main = main.groupBy("whole", "grp").agg(F.max(F.struct("k", "label")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("outside", F.col("k") - F.col("main.k")).where("outside > 0")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("n") / BLOCK_TOKENS)).cast("int").alias("blocks")
    # As many visitors in a task as sets that they visit.
    main = work.write(main.select("whole", "grp", F.col("main.label").alias("main"), blocks, F.greatest(F.ceil(F.col("outside") / BLOCK), F.ceil(F.col("n") * F.col("outside") / F.col("k") / BLOCK_TOKENS)).cast("int").alias("out_blocks")))
    if main.isEmpty():
        return labels
    rest = rest.join(main, ["whole", "grp"]).withColumn("block", F.expr("cast(pmod(xxhash64(uid, 0), blocks) as int)")).withColumn("out", F.expr("cast(pmod(xxhash64(uid, 1), out_blocks) as int)"))
    at_home = rest.select("whole", "grp", "uid", F.lit(False).alias("visiting"), "block", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("out"))
    guests = rest.where("label != main").select("whole", "grp", "uid", F.lit(True).alias("visiting"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "out")
    more = at_home.unionByName(guests).join(whole, "uid").groupBy("whole", "grp", "block", "out").applyInPandas(_link_group(num, den), "u long, v long")
    return components(edges.union(work.write(more.distinct())), work)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM d),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, len(x)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM s LEFT JOIN m ON a = doc_id
"""


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of one document of each component, with all their columns as they are.

    The document with the smallest doc_id stays, a null doc_id only if the component has no other; documents without words, or
    with a null text, are components of their own and stay.  Rows that share a doc_id go only together: they stay if one of
    them does.  An empty table gives one.
    """
    work = Workspace(docs.sparkSession, "jaccard")
    judged = jaccard_components(docs, doc_id=doc_id, **options)
    gone = work.write(judged.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("not stays").select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none")))
    judged.workspace.drop_all_but()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    key = column(doc_id).cast("long")
    rows = docs.select(whole_row(docs).alias("row"), F.coalesce(key, F.lit(-1)).alias("id"), key.isNull().alias("none"))
    return rows.join(gone, ["id", "none"], "left_anti").select("row.*")
