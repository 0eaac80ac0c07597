"""Mixing sources to target weights by systematic sampling.

Every source has a target in words; a document of the source is expected
``target / source size`` times.  The expected copies are summed up along the
source, shortest texts first, one random offset per source is added, and a
document is taken once for each whole number that its stretch of the sum
crosses.  Neighbours in this order have about the same size, so the words
taken come within about one longest text of the target, and no document is
taken more often than its expectation rounded up.

The sums are exact (expectations are fixed-point numbers), so they do not
depend on how rows are spread over tasks, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.llm.tables import stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most that a source gives, in multiples of its size.
SHARE, MOST = 1.5, 2
#: Fractions of a copy are counted in units of 2^-24.
UNIT = 1 << 24


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for (source, size) rows; one row per source.

    A source is full at ``most`` times its size.  What it cannot take goes to
    the others by weight: in the order of size per weight, a source is full if
    the level reached by all before it lies above its own.
    """
    # one row per source from here on
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = by_source.select("source", "source_size", weight.cast("long").alias("weight"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("source_size") * most
    levels = weighed.select(
        "*", (F.sum("source_size").over(every) * share).alias("budget"),
        F.coalesce(F.sum(full).over(before), F.lit(0)).alias("given"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"))
    is_full = (F.col("budget") - F.col("given")) * F.col("weight") >= full * F.col("open")
    marked = levels.select("source", "source_size", "weight", "budget", is_full.alias("is_full"))
    taken = F.coalesce(F.sum(F.when(F.col("is_full"), full)).over(every), F.lit(0))
    rest = F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(every)
    level = (F.col("budget") - taken) * F.col("weight") / rest
    return marked.select("source", "source_size", F.when(F.col("is_full"), full.cast("double")).otherwise(level).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """Units of one random offset per source, below one copy."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))).cast("binary"))
    return F.conv(F.left(digest, F.lit(6)), 16, 10).cast("long")


def systematic(rows: DataFrame, units: str, within: str, order: list[str], seed: str) -> DataFrame:
    """``rows`` with ``copies``: times that a stretch of ``units`` crosses a whole number.

    The sums run along each ``within`` in ``order``.  Rows are dealt out by
    range over all keys, so that a source with most of the rows is spread over
    tasks; a task adds up its rows, and the totals of the tasks before it (one
    row per task and source) are its start.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(within).asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in order]]
    # written once, so that the ranges are the same for both passes and after a lost task
    # equal rows are told apart by their place, so that they spread over ranges, too
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = stored(numbered.repartitionByRange(parts, *keys, F.col("_row")).withColumn("_part", F.spark_partition_id()).drop("_row"), "dealt")
    totals = dealt.groupBy("_part", within).agg(F.sum(units).alias("_total"))
    earlier = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.col(within).alias("_within"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    here = Window.partitionBy("_part", within).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("_sum", F.sum(units).over(here))
    joined = summed.alias("a").join(starts.alias("b"), F.expr(f"a._part = b._part and a.{within} <=> b._within"))
    end = F.col("_start") + F.col("_sum") + offset(F.col(within), seed)
    copies = F.expr(f"_end div {UNIT} - (_end - {units}) div {UNIT}")
    return joined.select("a.*", "_start").withColumn("_end", end).withColumn("copies", copies).drop("_part", "_sum", "_start", "_end")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per row of ``docs`` (doc_id, text, source).

    Null and blank texts have size 0 and are taken at their source's rate, at
    no words; a source without words has target 0 and none of its rows is
    taken.  A null source is a source of its own.  Repeated rows count each.
    """
    sizes = stored(docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size")), "sizes")
    goals = targets(sizes, weights, share, most)
    rows = sizes.alias("d").join(goals.alias("g"), F.expr("d.source <=> g.source")).select("d.doc_id", "d.source", "d.size", "g.source_size", "g.target")
    units = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    return systematic(rows.withColumn("units", units), "units", "source", ["size", "doc_id"], seed).drop("units")
