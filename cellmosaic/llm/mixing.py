"""Mixing sources to target weights.

Sizes are summed per source.  Sources in code point order, null last, have the
given weights in turn and share ``share`` times all sizes; no target is above
``cap`` times its source's size, and what is cut off is shared again by weight.
A source's rate is its target over its size.  Each document is emitted
floor(rate) times and once more if a hash of its doc_id and a seed falls below
the fraction.

Null and empty texts have size 0.  Rows that share a doc_id draw alike.  Empty
tables give empty results.  A null source is a source of its own.  Very long
texts are counted whole, in generated code.  Columns of ``docs`` may have any
names; ``mix`` returns them all, ``mix_report`` none but doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmosaic.llm.common import WORD, Shared, fresh

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from ``sized`` (source, size).

    One row a source from here on.  In ascending order of cap over weight, the
    sources that reach their cap come first, so two running sums settle all.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weighed = sources.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).alias("weight"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.select("*", (left / heavy).alias("level"))
    capped = level.select("*", (F.lit(cap) * F.col("source_size") <= F.col("level") * F.col("weight")).alias("capped"))
    # Of tied sources only the first has no uncapped one before it.
    first = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("none"), "source", "level"))).over(everything)
    settled = capped.select("*", first["level"].alias("free"))
    return settled.select("source", "source_size", F.when(F.col("capped"), F.lit(cap) * F.col("source_size")).otherwise(F.col("free") * F.col("weight")).alias("target"))


def draw(seed: str = SEED) -> Column:
    """A number in [0, 1) from doc_id and the seed, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def rates(sizes: DataFrame, **settings) -> DataFrame:
    """``sizes`` (doc_id, source, size) with source_size, target and copies."""
    goal = targets(sizes, **settings).withColumnRenamed("source", "of")
    both = sizes.join(goal, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return both.select("*", (whole + (draw() < rate - whole).cast("long")).cast("long").alias("copies"))


def mix_report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row; texts are read once."""
    sizes = Shared(docs.sparkSession, "mixing").put(sized(docs))
    return rates(sizes, **settings).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows with a rate of 0 are gone.

    Only sizes are shuffled: the rates come back by source, one row each.
    """
    sizes = Shared(docs.sparkSession, "mixing").put(sized(docs).select("source", "size"))
    of, rate, copy = fresh(docs.columns, "mix_of", "mix_rate", "mix_copy")
    goal = targets(sizes, **settings).select(F.col("source").alias(of), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    both = docs.join(goal, docs["source"].eqNullSafe(goal[of]))
    whole = F.floor(rate)
    copies = (whole + (draw() < F.col(rate) - whole).cast("long")).cast("int")
    return both.where(copies > 0).select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies)).alias(copy)).drop(copy)
