"""Mixing sources to target weights, with DataFrame functions alone.

Sizes (words) are summed a source; the sources in code-point order, null last, take the weights in turn and share
`factor` times all sizes by weight. A target stops at `most` times its source's size and what it can't take is shared
again by weight, until none is above: the level L where sum(min(weight * L, most * size)) reaches the whole is found from
prefix sums over the sources in the order of their filling points. A source's repetition rate is target / size; each
document is taken floor(rate) times and once more if its seeded hash falls below the fraction.

Defined results: a null text or one without words has size 0, so no words of it are taken, but `mixed` repeats its row by
its source's rate like any other; a source whose documents are all empty has target 0 and rate 0; null is
a source of its own; rows alike in id and text hash alike, so they are taken alike. The hash is that of the id and the
text, so it doesn't depend on partitions, order or earlier runs. Columns of the input that clash with the operator's own
are kept by `mixed` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.llm._common import WORD, with_positions, written

SEED = 20_240_611
WEIGHTS = (3, 1, 2)
FACTOR = 1.5
MOST = 2.0
#: So many sources' targets at most go to every task.
BROADCAST_ROWS = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _chance(seed: int) -> Column:
    """A number in [0, 1) from the seeded MD5 of id and text: its first 13 hex digits."""
    told = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """(source, source_size long, target double) of (source, source_size) with one row a source. No task sees all sources."""
    sources = with_positions(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("long")
    full = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("point", F.col("cap") / F.col("weight"))
    ranked = with_positions(full, [F.col("point"), F.col("place")], "rank")
    # prefix sums over the filling order: within runs of 1024 ranks, then over the runs
    run = F.floor(F.col("rank") / 1024)
    runs = ranked.groupBy(run.alias("run")).agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    within = Window.partitionBy("run").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    prefixed = (
        ranked.withColumn("run", run)
        .join(runs, "run")
        .withColumn("size_before", F.col("s0") + F.coalesce(F.sum("source_size").over(within), F.lit(0)))
        .withColumn("weight_before", F.col("w0") + F.coalesce(F.sum("weight").over(within), F.lit(0)))
    )
    whole = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (F.lit(factor) * F.col("all_size") - F.lit(most) * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before"))
    found = prefixed.crossJoin(F.broadcast(whole)).withColumn("level", level)  # whole: one row
    # the first source in the filling order that stays below its cap sets the level for all after it
    bar = found.agg(F.min(F.when(F.col("level") < F.col("point"), F.struct("rank", "level"))).alias("bar"))
    capped = F.col("bar").isNull() | (F.col("rank") < F.col("bar.rank"))
    target = F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.col("bar.level"))
    return found.crossJoin(F.broadcast(bar)).select("source", "source_size", target.alias("target"))  # bar: one row


def _hinted(goals: DataFrame) -> DataFrame:
    """goals as a table, broadcast if it has few rows; beyond, the join shuffles and adaptive execution splits hot sources."""
    table = written(goals, "goals")
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies long, taken long) for every row of docs (doc_id, text, source)."""
    sized = written(docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), _chance(seed).alias("_chance")), "sizes", "snappy")  # so that texts are read once
    return _taken(sized, weights, factor, most).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _taken(sized: DataFrame, weights: tuple[int, ...], factor: float, most: float) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    goals = targets(sizes, weights, factor, most).withColumnRenamed("source", "_source")
    joined = sized.join(_hinted(goals), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return joined.withColumn("copies", (F.floor(rate) + (F.col("_chance") < rate - F.floor(rate)).cast("long")).cast("long"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: float = MOST, seed: int = SEED) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; columns unchanged whatever their names. Texts stay in place: rates come back by source, hashes are recomputed."""
    sizes = docs.groupBy(F.col("source").alias("source")).agg(F.sum(n_words(F.col("text"))).cast("long").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = _hinted(targets(sizes, weights, factor, most).select("source", rate.alias("rate")))
    # the input's columns stay in one struct, so that none of their names can clash
    rows = docs.alias("d").select(F.struct("d.*").alias("row"), F.col("d.source").alias("source"), _chance(seed).alias("chance")).alias("r")
    joined = rows.join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("row", "rate", "chance")
    copies = (F.floor("rate") + (F.col("chance") < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    taken = joined.select("row", copies.alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
