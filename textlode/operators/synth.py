"""Mixed documents of known spans, made from two classes of labelled texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlode.operators.windows import merged, tokens
from textlode.plans.dialect import Spark

RATIOS = (0.0, 0.15, 0.3, 0.5, 0.7, 0.85, 1.0)


def blocks(df: DataFrame, words: int = 60) -> DataFrame:
    """Return (label, block): runs of ``words`` words of each text (text, label 0/1), those of half the length or more."""
    d = Spark()
    cut = F.expr(d.bind(tokens(d, "coalesce(text, '')"), d.each(d.steps(f"{d.size('v')} - 1", words), f"slice(v, x + 1, {words})")))
    return df.select("label", F.explode_outer(cut).alias("block")).filter(F.size("block") >= words // 2)


def corpus(df: DataFrame, ratios: Sequence[float] = RATIOS, per_ratio: int = 3, words: int = 60, total_words: int = 900, seed: int = 0) -> DataFrame:
    """Return (mixed_id, ratio, text, machine_spans, total_words, label) from labelled texts (text, label: 0 human, 1 machine).

    Each document draws its plan and its blocks by hashes of the seed. A pool
    smaller than what is asked is gone through again. Only the blocks that are
    drawn, a bounded number, are gathered. The label is by share of machine
    words: up to 0.02 human, from 0.98 ai, else ai_assisted.
    """
    spark = df.sparkSession
    n_blocks = max(1, total_words // words)
    plan = [(k, float(r), seed + k) for k, r in enumerate(r for r in ratios for _ in range(per_ratio))]
    docs = spark.createDataFrame(plan, "mixed_id int, ratio double, seed int").withColumn("m", F.bround(F.col("ratio") * n_blocks).cast("int"))
    slots = docs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    by_plan = Window.partitionBy("mixed_id").orderBy(F.xxhash64("seed", "i"), "i")
    slots = slots.withColumn("kind", (F.row_number().over(by_plan) <= F.col("m")).cast("int"))
    turn = Window.partitionBy("mixed_id", "kind").orderBy("i")
    slots = slots.withColumn("turn", F.row_number().over(turn) - 1)
    # a bounded pool: as many blocks of each class as a document and its draws can use
    pool_size = n_blocks * len(plan)
    pools = None
    for kind in (0, 1):
        own = blocks(df, words).filter(F.col("label") == kind).withColumn("order", F.xxhash64(F.lit(seed), F.array_join("block", " "))).orderBy("order").limit(pool_size)
        own = own.withColumn("at", F.row_number().over(Window.orderBy("order", F.array_join("block", " "))) - 1).select(F.lit(kind).alias("kind"), "at", "block")
        pools = own if pools is None else pools.union(own)
    sizes = pools.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    if sizes.count() < 2:
        raise ValueError("blocks of both classes are needed")
    drawn = slots.join(F.broadcast(sizes), "kind").withColumn("at", F.pmod(F.col("turn") + F.pmod(F.xxhash64("seed", "kind"), F.col("size")), F.col("size")).cast("int"))
    rows = drawn.join(pools, ["kind", "at"]).groupBy("mixed_id", "ratio").agg(F.array_sort(F.collect_list(F.struct("i", "kind", "block"))).alias("b"))
    ends = "transform(b, (x, k) -> aggregate(slice(b, 1, k + 1), 0, (a, y) -> a + size(y.block)))"
    rows = rows.withColumn("ends", F.expr(ends)).withColumn("spans", F.expr("transform(filter(transform(b, (x, k) -> struct(x.kind as kind, ends[k] - size(x.block) as start, ends[k] as `end`)), s -> s.kind = 1), s -> struct(s.start as start, s.`end` as `end`))"))
    rows = rows.withColumn("machine_spans", merged("spans")).withColumn("total_words", F.element_at("ends", -1))
    share = F.expr("aggregate(machine_spans, 0, (a, s) -> a + s.`end` - s.start)") / F.greatest("total_words", F.lit(1))
    label = F.when(share <= 0.02, "human").when(share >= 0.98, "ai").otherwise("ai_assisted")
    return rows.select("mixed_id", "ratio", F.expr("array_join(flatten(transform(b, x -> x.block)), ' ')").alias("text"), "machine_spans", "total_words", label.alias("label"))
