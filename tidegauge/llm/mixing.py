"""Sources mixed to target weights by weighted fair queueing, in DataFrame operations only.

Every shuffled document has a virtual finish time: the words of its source up to and with it,
divided by the source's target. All documents are sorted by that time and the sort is cut where
the words reach the total budget. A source of which more than one pass is needed queues its
documents again, each pass a source size later.
"""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidegauge.session import persist_plan

WEIGHTS = (1, 2, 3)              # of the sources by name, repeating
MOST = 3                         # passes over a source
SEED = "mix-1"
PART_ROWS = 1 << 20              # documents of a part of the shuffled order, about
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources, total):
    """Words wanted of each source: ``source``, ``size`` to ``source_size``, ``target``.

    Weights repeat over the sources by code point, null last. Shares of the total fill up
    like water: with sources by limit over weight, the level is found where the rest, shared
    by weight, no longer exceeds the next limit.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", (MOST * F.col("size")).cast("double"))
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(total)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level)
    found = rows.where("level <= ratio").orderBy("ratio", F.col("source").isNull(), "source").select("level").first()
    share = F.col("weight") * F.lit(found[0]) if found else F.col("most")
    return rows.select("source", F.col("size").alias("source_size"), F.least(F.col("most"), share).alias("target"))


def mix_sources(docs, carry=()):
    """How much of every document the mix takes: doc_id, size, source_size, target, taken.

    ``docs`` has ``doc_id``, ``text``, ``source``; other columns are ignored. A size is the
    number of words, 0 for null and blank texts, which are never taken. Null is a source of its
    own. ``taken`` is the size times the passes that draw the document. Ties in the shuffled
    order, a hash of the id, go by id and size, so reruns agree; rows that repeat a doc_id
    count each; ``carry`` names columns that tell them apart, returned as well. An empty table gives an empty result.

    The queues of all sources are one global range sort; a part starts where the sums of its
    source's parts before it end. A part is cut on the whole order, at last on a number of the
    row, so a source, an id or a null id with a third of all rows is spread over many parts.
    """
    spark = docs.sparkSession
    sized = persist_plan(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", *carry,
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(SEED))).alias("turn")))
    known = persist_plan(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    total, rows = known.agg(F.sum("size"), F.sum("rows")).first()
    wanted = persist_plan(targets(known.drop("rows"), total or 0))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // PART_ROWS))
    order = ["turn", "doc_id", "size", *carry, "_nth"]
    numbered = sized.withColumn("_nth", F.monotonically_increasing_id())             # of written rows, so the same again
    cut = persist_plan(numbered.repartitionByRange(parts, "source", *order)).withColumn("part", F.spark_partition_id())
    sums = cut.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = persist_plan(sums.select("source", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
                          .join(wanted.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name"))
    inside = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("upto", F.sum("size").over(inside))
    same = F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.part") == F.col("r.part"))
    queued = persist_plan(cut.alias("l").join(starts.alias("r"), same).select(
        *carry, "doc_id", "size", "source_size", "target", (F.col("r.start") + F.col("upto")).alias("end")))
    passes = F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("pass")
    finish = F.try_divide((F.col("pass") * F.col("source_size") + F.col("end")).cast("double"), F.col("target"))
    times = queued.where("size > 0").select("size", "source_size", "target", "end", passes).select("size", finish.alias("finish"))
    limit = _cut(times.where("finish is not null"), total or 0, parts)
    drawn = sum((F.when(F.try_divide((F.lit(k) * F.col("source_size") + F.col("end")).cast("double"), F.col("target")) <= F.lit(limit), 1).otherwise(0)
                 for k in range(MOST)), F.lit(0))
    return queued.select(*carry, "doc_id", "size", "source_size", "target", (F.col("size") * drawn).cast("long").alias("taken"))


def _cut(times, budget, parts):
    """The latest finish time with which all words up to it stay within the budget.

    Times are sorted globally by ranges; whole parts are taken up to the one that crosses the
    budget, and within it the times up to the crossing. Documents of the same time go or stay
    together.
    """
    words = times.groupBy("finish").agg(F.sum("size").alias("words"))
    ranged = persist_plan(words.repartitionByRange(parts, "finish")).withColumn("part", F.spark_partition_id())
    limit = before = 0
    for r in ranged.groupBy("part").agg(F.sum("words").alias("words"), F.max("finish").alias("last")).orderBy("part").collect():
        if before + r.words > budget:                           # one row a part comes here
            upto = F.sum("words").over(Window.partitionBy("part").orderBy("finish").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            fits = ranged.where(F.col("part") == r.part).withColumn("upto", upto).where(F.col("upto") + F.lit(before) <= F.lit(budget))
            return float(max(limit, fits.agg(F.coalesce(F.max("finish"), F.lit(0.0))).first()[0]))
        before, limit = before + r.words, r.last
    return float(limit)
