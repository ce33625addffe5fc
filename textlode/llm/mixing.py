"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies that each of its
documents should have. Its whole part is given to all with certainty. For the
rest, documents are ranked by their random odds over their inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the sample is the head of that order, cut
where the words come nearest to what is left of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.llm._common import SPACE, cut

#: No document is taken more often.
MOST = 3


def words(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    trimmed = F.regexp_replace(text, f"^[{SPACE}]+", "")
    parts = F.size(F.split(trimmed, f"[{SPACE}]+"))
    ends = F.when(trimmed.rlike(f"[{SPACE}]\\z"), 1).otherwise(0)
    return F.when(F.length(trimmed) > 0, parts - ends).otherwise(0).cast("long")


def mark(text: str = "text") -> Column:
    """A whole number that stands for the text beside the id in the draw; a null text is an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def draw(seed: int, *columns: str) -> Column:
    """A number over 0 and under 1 from the seed and the columns, the same in every run and engine."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Return (source, source_size, target) for (source, source_size): ``weights`` repeat by code point, null last.

    Targets share the whole size by weight and stop at MOST times a source's
    size; the excess goes to the others by weight. Sources fill up in the order
    of their cap over their weight, so one pass over them, a row each, settles
    how many are full. Sources without words get 0.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("w", turn).withColumn("cap", F.lit(float(MOST)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    by_fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, onward = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    stepped = w.withColumn("level", level)
    # the level at the first source that does not fill up
    settled = stepped.withColumn("settled", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(whole)["level"])
    return settled.select("source", "source_size", F.coalesce(F.least("cap", F.col("settled") * F.col("w")), F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7, bins: int = 4096) -> DataFrame:
    """Return (doc_id, source, size, source_size, target, copies): one row per row of ``docs``.

    Sizes are words; a null text has none, and documents without words are
    taken as often as their order says, which costs nothing. A null source is a
    source of its own. The draw depends on seed, id and text, so that reruns
    agree and rows that repeat are taken or left together. Other columns are ignored.

    The head of a source's order is found from sums over ``bins`` equal bins of
    the draw; only the bin in which the target falls is ranked row by row, so
    that a source of any size is no single task.
    """
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), words().alias("size"), mark().alias("mark"))
    own = cut(own.withColumn("u", draw(seed, "doc_id", "mark")).withColumn("bin", F.floor(F.col("u") * bins).cast("int")), "sizes")
    by = ["name", "unnamed"]
    binned = cut(own.groupBy(*by, "bin").agg(F.sum("size").alias("words")), "bins")
    source = F.when(~F.col("unnamed"), F.col("name"))
    sized = binned.groupBy(*by).agg(F.sum("words").alias("source_size")).withColumn("source", source)
    goal = targets(sized.select("source", "source_size"), weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12).cast("int")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    goal = cut(goal.withColumn("share", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)).withColumn("name", F.coalesce("source", F.lit(""))).withColumn("unnamed", F.col("source").isNull()), "targets")

    # odds are equal within a source, so that the order by random over inclusion odds is the order of the bins
    up_to = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = binned.withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0))).join(goal.select(*by, "rest"), by)
    cut_bin = edges.filter(F.col("before") <= F.col("rest")).groupBy(*by).agg(F.max(F.struct("bin", "before")).alias("at")).select(*by, F.col("at.bin").alias("cut_bin"), F.col("at.before").alias("before"))
    goal = cut(goal.join(cut_bin, by, "left"), "cuts")

    found = own.join(F.broadcast(goal) if goal.count() <= 100_000 else goal, by)
    odds = (F.col("u") / (1 - F.col("u"))) / F.when(F.col("share") > 0, F.col("share") / (1 - F.least("share", F.lit(1 - 1e-12)))).otherwise(1e-300)
    edge = found.filter(F.col("bin") == F.col("cut_bin")).withColumn("order", odds)
    in_order = Window.partitionBy(*by).orderBy("order", "doc_id", "mark")
    summed = edge.withColumn("to", F.col("before") + F.sum("size").over(in_order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("to") - F.col("size"))
    # the cut that comes nearest: a document whose middle lies before the target is in
    last = summed.filter((F.col("from") + F.col("to")) / 2 <= F.col("rest")).groupBy(*by).agg(F.max(F.struct("order", "doc_id", "mark")).alias("last"))
    last = goal.select(*by).join(last, by, "left")
    found = found.withColumn("order", odds).join(F.broadcast(last) if goal.count() <= 100_000 else last, by)
    inside = F.when(F.col("share") <= 0, False).when(F.col("bin") < F.col("cut_bin"), True).when(F.col("bin") > F.col("cut_bin"), False)
    inside = inside.otherwise(F.coalesce(F.struct("order", "doc_id", "mark") <= F.col("last"), F.lit(False)))
    return found.select("doc_id", F.when(~F.col("unnamed"), F.col("name")).alias("source"), "size", "mark", "source_size", "target", F.least(F.col("whole") + inside.cast("int"), F.lit(MOST)).alias("copies"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    taken = mix(docs, weights, seed).filter("copies > 0").select("doc_id", "mark", F.col("source").alias("s"), "copies").distinct()
    marked = docs.withColumn("__mark", mark())
    joined = marked.join(taken, marked["doc_id"].eqNullSafe(taken["doc_id"]) & (marked["__mark"] == taken["mark"]) & marked["source"].eqNullSafe(taken["s"]))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*(marked[f"`{c}`"] for c in docs.columns))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB, over the same tables.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT AS mark FROM documents
), u AS (
  SELECT *, (('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'null') || '|' || mark), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM u GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 3::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, cap / w AS full_at,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), g AS (
  SELECT source, source_size, least(cap, (SELECT arg_min(level, full_at) FILTER (level <= full_at) FROM l) * w) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM g
), o AS (
  SELECT u.*, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, mark) AS up_to FROM u
)
SELECT doc_id, size, source_size, target,
  (size * least(3, whole + (target - whole * source_size > 0 AND up_to - size / 2 <= target - whole * source_size)::INT))::BIGINT AS taken
FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source
"""
