"""Mixing sources to target weights, native.

The words of each source are laid end to end and cut into fixed-length blocks.  The mix is a row of slots, one block
each, grouped into output shards.  Each slot draws a source at random by the sources' shares of the slots, so that the counts of
sources in a shard are a multinomial draw.  Over all shards a source's draws miss its quota by about their square root; so
that targets are met, draws beyond a quota, evenly spread over its shards, go to the sources that fell short.  A draw's rank in its
source passes through the source's own pseudorandom permutation of block indices, one pass after the other, so that no
block is taken twice before all are taken once.  Slots and documents' blocks are then joined by (source, block index).

Words are laid out inside buckets of a source (``BUCKET_ROWS`` documents on average, more where that makes over ``BUCKETS``), so that
a source of any size is ranked by many tasks; a bucket's last block may be short.  Buckets that repeated rows crowd are divided by
row.  Slots find their source by cells of the range of draws, not by a search of all sources.  Permutations are swap-or-not
shuffles: exact bijections of any number of indices, computed for each row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, column, table, whole_row, word_count

BLOCK, BUCKET_ROWS, BUCKETS, ROUNDS = 64, 2048, 1 << 16, 16
#: Slots of a shard; more where that makes over ``SHARDS`` of them.
SHARD_SLOTS, SHARDS = 1024, 1 << 16
#: Draws are whole numbers below ``UNIT``, divided into ``CELLS`` cells, or four for each source.
UNIT, CELLS = 1 << 48, 1 << 12


def permuted(index: str, n: str, salt: str, rounds: int = ROUNDS) -> Column:
    """SQL of a pseudorandom permutation of 0 ... n - 1 at an index: a swap-or-not shuffle keyed by ``salt``."""
    partner = f"pmod(pmod(xxhash64({salt}, r), {n}) - x, {n})"
    step = f"if((xxhash64({salt}, r, greatest(x, {partner})) & 1L) = 1L, {partner}, x)"
    return F.expr(f"aggregate(sequence(1, {rounds}), cast({index} as bigint), (x, r) -> {step})")


def targets(sizes: DataFrame, factor: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """(source, rank, source_size, target) of (source, source_size): weights repeat over the sources in code point order,
    null last; targets share ``factor`` of all sizes by weight, at most ``most`` times each source's own size.

    A source is full if its cap per weight is below what is left per weight once all with a smaller ratio are full; the
    first that isn't full fixes the level of the rest.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0.0), F.sum("source_size").over(everything) * factor - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    ranked = ranked.withColumn("level", level).withColumn("at", F.row_number().over(order))
    free = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("at", "level"))
    ranked = ranked.withColumn("free", F.min(free).over(everything))
    capped = F.col("free").isNull() | (F.col("at") < F.col("free.at"))
    return ranked.select("source", "rank", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("free.level") * F.col("weight")).cast("double").alias("target"))


def rounded(taken: DataFrame, seed: int) -> DataFrame:
    """With ``copies``: taken / size, rounded up or down so that its mean is the quotient itself.

    The fractions of a bucket are laid end to end by size from a pseudorandom start below 1; a document that reaches a whole
    number is rounded up.  So a bucket's words differ from what was taken by less than two of its largest document.
    """
    before = Window.partitionBy("rank", "bucket").orderBy("size", "rn").rowsBetween(Window.unboundedPreceding, -1)
    fraction = F.expr("(taken % size) / cast(size as double)")
    laid = taken.withColumn("before", F.coalesce(F.sum(fraction).over(before), F.lit(0.0)))
    start = F.expr(f"pmod(xxhash64({seed}, 'copies', rank, bucket), 1048576) / 1048576D")
    up = F.floor(F.col("before") + fraction + start) - F.floor(F.col("before") + start)
    return laid.withColumn("copies", (F.expr("taken div size") + up).cast("int"))


def spanned(rows: DataFrame, at: str, spans: DataFrame, width: int) -> DataFrame:
    """Each row with the columns of the one span, lo <= at < hi, that it lies in: an equality join by cells of ``width``."""
    cells = spans.where("lo < hi").withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    return rows.withColumn("cell", F.expr(f"{at} div {width}")).join(cells, "cell").where(f"{at} >= lo and {at} < hi").drop("cell")


def deal(quota: DataFrame, total: int, seed: int, work: Workspace) -> DataFrame:
    """(shard, slot, rank, blocks, draw) of each of ``total`` slots, from (rank, blocks, slots): shards' counts of sources are
    multinomial draws but for what is moved in order that each source has as many draws as ``slots`` says."""
    spark, sources = quota.sparkSession, quota.count()
    cells = max(CELLS, 4 * sources)
    stop = F.sum("slots").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    bound = lambda x: (x.cast("double") / max(1, total) * UNIT).cast("long")
    spans = work.write(quota.withColumn("stop", stop).select("rank", bound(F.col("stop") - F.col("slots")).alias("lo"), bound(F.col("stop")).alias("hi")))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id div {max(SHARD_SLOTS, -(-total // SHARDS))}").alias("shard"), F.expr(f"pmod(xxhash64({seed}, 'draw', id), {UNIT}L)").alias("at"))
    drawn = work.write(spanned(slots, "at", spans, -(-UNIT // cells)).select("shard", "slot", "rank"))
    counts = work.write(drawn.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts_before = counts.select("shard", "rank", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # Surplus and want of each source, laid end to end.
    settled = quota.join(counts.groupBy("rank").agg(F.sum("n").alias("drawn")), "rank", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    settled = settled.withColumns({"surplus": F.greatest(F.lit(0), F.col("drawn") - F.col("slots")), "want": F.greatest(F.lit(0), F.col("slots") - F.col("drawn"))})
    sofar = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    settled = work.write(settled.withColumns({"surplus_from": F.sum("surplus").over(sofar) - F.col("surplus"), "hi": F.sum("want").over(sofar)}).withColumn("lo", F.col("hi") - F.col("want")))
    moved = settled.agg(F.coalesce(F.sum("surplus"), F.lit(0))).first()[0]
    numbered = drawn.withColumn("rn", F.row_number().over(Window.partitionBy("shard", "rank").orderBy("slot")) - 1)
    numbered = numbered.join(counts_before, ["shard", "rank"]).join(settled.drop("lo", "hi", "want"), "rank").withColumn("draw", F.col("before") + F.col("rn"))
    # Of ``drawn`` draws ``surplus`` go, evenly spread: those at which draw * surplus / drawn passes a whole number.
    numbered = numbered.withColumns({"gone": F.expr("draw * surplus div drawn"), "goes": F.expr("(draw + 1) * surplus div drawn > draw * surplus div drawn")})
    stay = numbered.where("not goes").select("shard", "slot", "rank", "blocks", (F.col("draw") - F.col("gone")).alias("draw"))
    if not moved:
        return stay
    go = numbered.where("goes").select("shard", "slot", (F.col("surplus_from") + F.col("gone")).alias("at"))
    go = spanned(go, "at", settled.select("rank", "blocks", "drawn", "lo", "hi"), -(-moved // cells))
    return stay.unionByName(go.select("shard", "slot", "rank", "blocks", F.expr("drawn + at - lo").alias("draw")))


def mix(docs: DataFrame, factor: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, seed: int = 7, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with what the mix takes of each, output slots).

    Documents: doc_id, size, source, source_size, target, taken; with ``carry`` the whole row too, as struct ``row``, and
    ``copies``, how often it stands in the mix if only whole documents may; rows without copies are left out then.
    Slots: shard, slot, rank, index, source: which block of which source (``rank``: its place by code point) stands where.
    Null texts and texts without words have size 0 and are never taken; a null source is a source; repeated rows count as rows of
    their own.  Reruns agree, but for which of over 16384 rows that repeat doc_id and text is taken.
    """
    work = Workspace(docs.sparkSession, "mixing")
    size = word_count(column(text))
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(source).alias("source"), size.alias("size"), F.xxhash64(column(text)).alias("tie"), F.monotonically_increasing_id().alias("uid"), *([whole_row(docs).alias("row")] if carry else []))
    whole = work.write(rows)
    rows = whole.drop("row")
    stats = work.write(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    plan = targets(stats.select("source", "source_size"), factor, weights, most)
    plan = work.write(plan.join(stats.select(F.col("source").alias("s"), F.expr(f"least({BUCKETS}, greatest(1, n div {BUCKET_ROWS}))").alias("buckets"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    # Lay the words out; sources are few, so this join needs no shuffle unless there are very many of them.
    laid = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    laid = laid.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("tie")), F.col("buckets")))
    crowded = laid.groupBy("rank", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    crowded = work.write(crowded.where(f"rows > 8 * greatest({BUCKET_ROWS}, n div buckets)").select("rank", "bucket", F.expr(f"rows div {BUCKET_ROWS}").alias("parts")))
    if not crowded.isEmpty():
        laid = laid.join(crowded, ["rank", "bucket"], "left").withColumn("bucket", F.col("bucket") + F.coalesce(F.pmod(F.xxhash64("uid"), F.col("parts")), F.lit(0)) * BUCKETS)
    own = Window.partitionBy("rank", "bucket").orderBy("doc_id", "tie", "uid")
    laid = laid.select("doc_id", "source", "size", "uid", "rank", "source_size", "target", "bucket", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("end"), F.row_number().over(own).alias("rn"))
    laid = work.write(laid)
    # Blocks of each bucket, numbered through the source.
    buckets = laid.groupBy("rank", "bucket").agg(F.max("end").alias("words")).withColumn("blocks", F.expr(f"(words + {block - 1}) div {block}"))
    buckets = buckets.withColumn("first", F.sum("blocks").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks"))
    buckets = work.write(buckets)
    quota = plan.join(buckets.groupBy("rank").agg(F.sum("blocks").alias("blocks")), "rank").where("blocks > 0")
    # As many slots as hold the target at the source's mean block.
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), (F.col("blocks") * most).cast("long"))
    quota = work.write(quota.select("source", "rank", "blocks", slots.alias("slots")))
    total = quota.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    dealt = deal(quota.drop("source"), total, seed, work).withColumn("pass", F.expr("draw div blocks"))
    slots = work.write(dealt.select("shard", "slot", "rank", permuted("draw % blocks", "blocks", f"{seed}, rank, pass").alias("index")))
    # Join blocks by index: each document's part of each of its blocks, times how often the mix takes that block.
    times = slots.groupBy("rank", "index").agg(F.count(F.lit(1)).alias("times"))
    touched = laid.where("size > 0").join(buckets.select("rank", "bucket", "first"), ["rank", "bucket"]).select("rank", "bucket", "rn", "end", "size", "first", F.explode(F.expr(f"sequence((end - size) div {block}, (end - 1) div {block})")).alias("b"))
    overlap = F.expr(f"least(end, (b + 1) * {block}) - greatest(end - size, b * {block})")
    taken = touched.select("rank", "bucket", "rn", (F.col("first") + F.col("b")).alias("index"), overlap.alias("part")).join(times, ["rank", "index"]).groupBy("rank", "bucket", "rn").agg(F.sum(F.col("part") * F.col("times")).alias("taken"))
    out = laid.join(taken, ["rank", "bucket", "rn"], "left")
    if carry:  # whole rows move once, and only those that the mix takes
        out = whole.select("uid", "row").join(rounded(out.where("taken > 0"), seed).where("copies > 0"), "uid")
    out = out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *(["row", "copies"] if carry else []))
    return out, slots.join(quota.select("rank", "source"), "rank")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows as often as the mix takes them, with all their columns as they are: never, once or up to ``most`` times.

    A document's words in the mix over its own words, rounded up or down without bias: each source's words come near its
    target.  Documents without words, null texts too, are never taken; repeated rows are rows of their own; an empty table gives one.
    """
    out, _ = mix(docs, carry=True, **options)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
