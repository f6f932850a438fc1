"""Operator 8: mixing sources to target weights by weighted fair queueing.

Every document's copies wait in the queue of their source, in an order shuffled
by a hash of the doc_id; a copy's virtual finish time is its source's words up
to and with it, all earlier rounds included, divided by the source's target.
All copies are served by finish time until the budget (the words of all
sources) is spent.  DataFrame and SQL functions only.

A source is cut into buckets by the hash, so a source that holds most rows is
many groups; its running sums come from bucket sums.  The copies are sorted by
one range sort over finish times and truncated where the budget ends: the sums
of the ranges tell in which range that is.

Null texts have size 0 and are never taken; a null source is one source, last
in order; repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.storage import cut_lineage, drop

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 3


def _targets(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``source, source_size, target`` with the excess over ROUNDS times a source's size shared again by weight.

    Sources stop in the order of cap/weight; with the first k stopped, the
    others get ``weight * (total - caps) / weights left``, and k is the least
    number for which none of the others is above its cap.
    """
    one = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(one.orderBy(F.col("source").isNull(), "source"))
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", cycle.cast("long")).withColumn("cap", F.col("source_size") * ROUNDS)
    order = one.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(one),
            "caps": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "left": F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "place": F.row_number().over(order),
        }
    )
    fits = F.col("cap") * F.col("left") >= F.col("weight") * (F.col("total") - F.col("caps"))
    s = s.withColumn("settled", F.min(F.when(fits, F.struct("place", "total", "caps", "left"))).over(one))
    share = F.col("weight").cast("double") * (F.col("settled.total") - F.col("settled.caps")).cast("double") / F.col("settled.left").cast("double")
    target = F.when(F.col("place") < F.col("settled.place"), F.col("cap").cast("double")).otherwise(share)
    return s.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def fair_queue(docs: DataFrame, columns: list[str], weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", rows_per_bucket: int = 256) -> DataFrame:
    """``columns`` of each row with ``size, source_size, target, upto`` (words of its source up to its end) and ``place``, its order among equals."""
    lead = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(*[F.col(x).alias(f"c_{x}") for x in columns], F.col("doc_id").alias("id"), F.col("source"), lead.alias("place"), size.alias("size"))
    sizes = cut_lineage(base, "mix-sizes")
    buckets = max(1, -(-sizes.count() // rows_per_bucket))
    spread = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long")
    base = sizes.withColumn("bucket", spread)
    sums = cut_lineage(base.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    targets = _targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    starts = starts.alias("a").join(targets.alias("b"), F.expr("a.source <=> b.source"))
    starts = starts.select("a.source", "bucket", "before", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("inside", F.sum("size").over(inside))
    joined = rows.alias("r").join(starts.alias("s"), F.expr("r.source <=> s.source and r.bucket = s.bucket"))
    queue = joined.select(*[f"c_{x}" for x in columns], "place", "id", "size", "source_size", "target", (F.col("before") + F.col("inside")).alias("upto"))
    queue = cut_lineage(queue, "mix-queue")
    drop(sizes, sums)
    return queue


def _finish(turn: int) -> Column:
    """Virtual finish time of a copy in round ``turn``."""
    return (F.col("source_size") * turn + F.col("upto")).cast("double") / F.col("target")


def serving_order(queue: DataFrame) -> DataFrame:
    """``v, place, id, size, part``: every copy in the order in which it is served.

    One global sort by finish time: Spark deals ranges of (finish time, place,
    id), which are balanced by sampling, and each range is sorted by itself.
    ``part`` numbers the ranges.
    """
    turns = F.explode(F.array(*[_finish(k) for k in range(ROUNDS)]))
    copies = queue.where("size > 0").select("place", "id", "size", turns.alias("v"))
    order = ["v", "place", "id", "size"]
    ranged = copies.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("v", "place", "id", "size", F.spark_partition_id().alias("part"))


def _cut(queue: DataFrame, budget: int) -> tuple[float, str, int] | None:
    """Finish time, place and id of the last copy served; None if every copy is.

    The sums of the sorted ranges, one row each, tell in which of them the
    budget ends; only that range is added up copy by copy.
    """
    served = cut_lineage(serving_order(queue), "mix-order")
    sums = served.groupBy("part").agg(F.sum("size").alias("words")).orderBy("part").collect()  # a row for each range
    spent, last = 0, None
    for x in sums:
        if spent + x.words >= budget:
            last = x.part
            break
        spent += x.words
    if last is None or (x is sums[-1] and spent + x.words == budget):
        drop(served)
        return None
    run = Window.partitionBy("part").orderBy("v", "place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = served.where(F.col("part") == last).withColumn("spent", F.sum("size").over(run)).where(F.col("spent") >= budget - spent)
    found = ends.orderBy("spent", "v", "place", "id").select("v", "place", "id").first()
    drop(served)
    return tuple(found)


def mix_sources(docs: DataFrame, columns: list[str] | None = None, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """``columns`` (``doc_id`` if not given) of each row with ``size, source_size, target, copies, taken``."""
    names = ["doc_id"] if columns is None else columns
    queue = fair_queue(docs, names, weights, seed)
    budget = queue.agg(F.sum("size")).first()[0] or 0
    cut = _cut(queue, budget)
    served = F.lit(0)
    for k in range(ROUNDS):
        v = _finish(k)
        if cut is None:
            inside = F.lit(True)
        else:
            at, place, doc = cut
            tie = (F.col("place") < place) | ((F.col("place") == place) & (F.lit(True) if doc is None else F.coalesce(F.col("id") <= doc, F.lit(True))))
            inside = (v < at) | ((v == at) & tie)
        served = served + F.coalesce(inside, F.lit(False)).cast("long")
    copies = F.when(F.col("size") > 0, served).otherwise(F.lit(0)).cast("long")
    out = queue.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col(f"c_{x}").alias(x) for x in names], "size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, each row as often as the mix takes it.

    The mix works on keys; texts are shuffled once, to meet their number of
    copies.  Rows that are equal in all columns share what they get.
    """
    every = [F.col(x) for x in docs.columns]
    key = ["__mix_a", "__mix_b"]
    keyed = docs.withColumns({key[0]: F.xxhash64(*every), key[1]: F.hash(*every)})
    taken = mix_sources(keyed, columns=key, **options).groupBy(*key).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    met = keyed.join(taken, key).withColumn("__no", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    times = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__no") <= F.col("__copies") % F.col("__rows")).cast("long")
    met = met.withColumn("__times", times.cast("int")).where("__times > 0")
    return met.withColumn("__again", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).select(*docs.columns)
