"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by successive bytes: level i groups the still open documents by (group so far, next WIDTHS[i] bytes),
counts each group with map-side combining, and joins the counts back.  A group of one document is finished; so is a
group whose digit is shorter than its width, because all of its texts have ended and equal each other.  The digits
widen, as common beginnings get rarer the longer they are; a text moves only while its document still shares
everything before the digit with another.  No digest decides anything.

Skew: a group of copies is one row for each map task in the count, and one side of an equality join whose other side
has a single row for it, read from a table, so that adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Workspace, ascii_lower, column, table, whole_row

#: Bytes that each level looks at; the last one repeats.
WIDTHS = (48, 1024, 16384, 262144, 4194304)
#: Shared beginnings and ids are broadcast up to so many bytes as rows in memory; beyond, the tables are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: A row in memory besides its texts.
ROW_BYTES = 64


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal if identical after lower-casing A-Z; null counts as empty.  The row with the largest doc_id of a group
    stays; a null doc_id is smaller than any other; of repeated rows with that doc_id exactly one stays.
    """
    work = Workspace(docs.sparkSession, "exact_dedup")
    body = F.encode(ascii_lower(F.coalesce("text", F.lit(""))), "UTF-8")
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    digit = F.substring(body, 1, widths[0])
    shared = work.write(rows.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit", F.monotonically_increasing_id().alias("gid")))
    # Whole texts cross the network in this join only if shared beginnings are too many to broadcast.
    size = shared.agg(F.coalesce(F.sum(F.octet_length("digit") + ROW_BYTES), F.lit(0))).first()[0]
    heads = F.broadcast(shared) if size <= BROADCAST_BYTES else shared
    level = rows.withColumn("digit", digit).withColumn("text_sha256", F.sha2(body, 256)).join(heads, "digit", "left").drop("digit")
    # Of documents that share their beginning with none, only the digest that is reported goes on.
    level = work.write(level.withColumn("text", F.when(F.col("gid").isNotNull(), F.col("text"))).withColumn("uid", F.monotonically_increasing_id()))
    work.drop(shared)
    out = ["doc_id", "uid", "name", "keep_id", "group_size", "text_sha256"]
    done = level.where("gid is null").withColumns({"name": F.col("uid"), "keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}).select(out)
    at, i = widths[0], 1
    while not (open_rows := level.where("gid is not null")).isEmpty():
        w = widths[min(i, len(widths) - 1)]
        open_rows = open_rows.withColumn("digit", F.substring(body, at + 1, w))
        # The largest uid names a group; maxima of numbers are kept in hash tables, whatever the digit's length.
        groups = work.write(open_rows.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), F.max("uid").alias("name")))
        ended = (F.length("digit") < w) | (F.col("group_size") == 1)
        joined = open_rows.select("gid", "digit", "doc_id", "uid", "text", "text_sha256").join(groups, ["gid", "digit"]).withColumn("gid", F.when(~ended, F.col("name")))
        level = work.write(joined.withColumn("text", F.when(F.col("gid").isNotNull(), F.col("text"))).drop("digit"))
        work.drop(groups)
        done, at, i = done.unionByName(level.where("gid is null").select(out)), at + w, i + 1
    largest = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    twice = work.write(done.where(largest & (F.col("group_size") > 1)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("uid").alias("stays")).where("n > 1").select("name", "stays"))
    kept = largest
    if not twice.isEmpty():  # rows that repeat the largest doc_id of a group: one stays
        done, kept = done.join(twice, "name", "left"), largest & (F.coalesce("stays", "uid") == F.col("uid"))
    done = done.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    done.workspace = work
    return done


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns as they are: one for each distinct text.

    As in ``exact_dedup``, the largest doc_id of equal texts stays, null counts as an empty text, a null doc_id is smaller than
    any.  Of rows that repeat doc_id and text too, the one whose columns hash smallest stays; an empty table gives one.
    """
    work = Workspace(docs.sparkSession, "exact_dedup")
    found = exact_dedup(docs, doc_id, text)
    named = (F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none"))
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("every")).where("not every")
    gone = work.write(ids.select(*named, F.col("some").alias("some")))
    doubt = gone.where("some").drop("some")
    key = column(doc_id).cast("long")
    rows = docs.select(whole_row(docs).alias("row"), F.coalesce(key, F.lit(-1)).alias("id"), key.isNull().alias("none"), column(text).alias("text"))
    wrap = F.broadcast if gone.count() * ROW_BYTES <= BROADCAST_BYTES else lambda df: df
    sure = rows.join(wrap(gone.drop("some")), ["id", "none"], "left_anti").select("row.*")
    if doubt.isEmpty():
        found.workspace.drop_all_but()
        return sure
    # Rows that repeat a doc_id of which some stay and some go: told apart by their texts, then by their other columns.
    stay = work.write(found.where("kept").select(*named, F.col("text_sha256").alias("digest")).join(doubt, ["id", "none"], "left_semi"))
    found.workspace.drop_all_but()
    rest = rows.join(wrap(doubt), ["id", "none"], "left_semi").withColumn("digest", F.sha2(F.encode(ascii_lower(F.coalesce("text", F.lit(""))), "UTF-8"), 256))
    rest = rest.join(stay, ["id", "none", "digest"], "left_semi").groupBy("id", "none", "digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return sure.unionByName(rest.select("row.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t
"""
