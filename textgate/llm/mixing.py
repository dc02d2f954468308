"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Documents of a source are put in a shuffled order (a hash of the id); a document's virtual finish time is the number of
its source's tokens up to and with it, divided by the source's target. All documents are ranged by finish time and the
queue is cut where the total budget is reached; as finish times are relative to targets, every source has then served
its target to within one document. A source whose target exceeds its size goes through the queue a second time.

Targets: the budget is SHARE of all tokens, split by weight; a source's target stops at CAP times its size, and what is
over is shared by weight among the others until none is above (water filling, found from prefix sums over sources).

Running sums never gather a source in one task: they are taken per (source, leading hash digits) and joined with offsets
from a table of those buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Hexadecimal digits of the shuffle hash that make a bucket (16 ** DIGITS buckets a source).
DIGITS = 2
#: Finish times fall into so many ranges.
RANGES = 4096


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of (source, source_size): one row per source, sources in code point order, null last,
    with weights repeating. A source without tokens has target 0."""
    everything = Window.partitionBy(F.lit(0))  # a row per source
    place = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int")))
    # Sources reach their cap in the order of cap / weight; with the first i capped, the level is what is left over the other weights.
    weighed = weighed.withColumn("full", F.lit(float(cap)) * F.col("source_size")).withColumn("at", F.col("full") / F.col("w"))
    before = Window.partitionBy(F.lit(0)).orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.lit(share) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("level", level)
    lowest = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", F.col("source").isNull().alias("last"), "source", "level"))).over(everything)["level"]
    return levelled.withColumn("stop", lowest).select("source", "source_size", F.when(F.col("stop").isNull(), F.col("full")).otherwise(F.least("full", F.col("w") * F.col("stop"))).alias("target"))


def shuffle_hash() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("#"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and _key (the shuffle hash of id and text): all that the queue needs of the text."""
    return docs.select("doc_id", "source", n_words().alias("size"), shuffle_hash().alias("_key"))


def queue(rows: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """rows of sized() with source_size, target and _served: the source's tokens up to and with the row, first pass."""
    rows = rows.withColumn("_bucket", F.substring("_key", 1, DIGITS))
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    goals = targets(buckets.groupBy("source").agg(F.sum("_sum").cast("bigint").alias("source_size")), share, cap)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    b, g = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).alias("b"), goals.alias("g")
    t = b.join(g, F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "b._bucket", "b._before", "g.source_size", "g.target").alias("t")
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("_own", F.sum("size").over(within)).alias("d")
    joined = d.join(t, F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d._bucket") == F.col("t._bucket")))
    return joined.select("d.doc_id", "d.source", "d.size", "d._key", "t.source_size", "t.target", (F.col("t._before") + F.col("d._own")).alias("_served"))


def mix(docs: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, times, source and _key of each row of docs.

    times: how often the mix takes the row (0 to cap); taken = size * times. Rows without words are never taken. Null
    sources are a source of their own; equal rows queue one after the other; extra columns are ignored. Reruns agree.
    """
    rows = written(sized(docs), "mix-sizes")  # the text is read once; from here on rows are narrow
    q = queue(rows, share, cap)
    passes = q.where(F.col("size") > 0).withColumn("_pass", F.explode(F.array(*[F.lit(i) for i in range(cap)])))
    finish = (F.col("_served") + F.col("_pass") * F.col("source_size")) / F.col("target")
    timed = passes.where(F.col("target") > 0).withColumn("_finish", finish)
    # Ranged by finish time (from 0 to infinity): the tokens of each range give its offset; rows are ordered inside a range.
    ranged = timed.withColumn("_range", F.floor(F.col("_finish") / (F.col("_finish") + 1) * RANGES).cast("int"))
    heights = ranged.groupBy("_range").agg(F.sum("size").alias("_sum"))  # RANGES + 1 rows at most
    running = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = heights.select("_range", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_below"))
    budget = rows.agg((F.lit(share) * F.coalesce(F.sum("size"), F.lit(0))).alias("_budget"))  # one row
    edges = below.crossJoin(F.broadcast(budget))
    inside = Window.partitionBy("_range").orderBy("_finish", F.col("source").asc_nulls_last(), "_key", "doc_id", "_served", "_pass").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_upto", F.sum("size").over(inside)).join(F.broadcast(edges), "_range")
    served = placed.withColumn("_in", (F.col("_below") + F.col("_upto") <= F.col("_budget")).cast("bigint"))
    names = ["doc_id", "source", "size", "_key", "source_size", "target", "_served"]
    times = served.groupBy(*names).agg(F.sum("_in").alias("times"))
    never = q.where((F.col("size") == 0) | (F.col("target") <= 0)).select(*names, F.lit(0).cast("bigint").alias("times"))
    return times.unionByName(never).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "source", "_key")


def mixed(docs: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: rows of docs with all their columns, whatever their names, each as often as the mix takes it. Rows of equal id,
    source and text share what is taken of them evenly. Empty tables and tables without words give an empty table."""
    taken = mix(docs, share, cap).groupBy("doc_id", "source", "_key").agg(F.sum("times").alias("_times"), F.count("*").alias("_copies")).where("_times > 0")
    d, t = docs.select("doc_id", "source", shuffle_hash().alias("_key"), F.struct(*docs.columns).alias("row")).alias("d"), taken.alias("t")
    joined = d.join(t, (F.col("d._key") == F.col("t._key")) & F.col("d.source").eqNullSafe(F.col("t.source")) & F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")))
    flat = joined.select("d.*", "t._times", "t._copies")
    single = flat.where("_copies = 1").select("row", F.col("_times").alias("_n"))
    place = F.row_number().over(Window.partitionBy("_key", "doc_id", "source").orderBy(F.xxhash64("row")))
    many = flat.where("_copies > 1").withColumn("_place", place)
    many = many.select("row", (F.floor(F.col("_times") / F.col("_copies")) + (F.col("_place") <= F.col("_times") % F.col("_copies")).cast("bigint")).alias("_n"))
    return single.unionByName(many).where("_n > 0").withColumn("_again", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).select("row.*")
