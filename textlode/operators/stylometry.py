"""Function-word profiles, Burrows's Delta, nearest centroids and authorship verification.

Profiles stay sparse: a row for each document and function word that it uses. A
word that a document lacks has the rate 0, whose share in a distance is the same
for every document, so distances are a base plus what the used words change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.functions import lexicon as lx
from textlode.operators.signals import parse
from textlode.plans.dialect import Spark, spark_frame

SD_FLOOR = 1e-4


def profile(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Return (key, word, rate): the rates of the function words that a document uses."""
    parsed = spark_frame(df.select(key, "text"), [*parse(Spark())[:2], {"words": Spark().find_all("prose", "[A-Za-z][A-Za-z'’-]*")}])
    used = parsed.select(key, F.size("words").alias("n"), F.explode("words").alias("w")).select(key, "n", F.lower("w").alias("word")).filter(F.col("word").isin(lx.FUNCTION_WORDS))
    return used.groupBy(key, "n", "word").agg(F.count(F.lit(1)).alias("c")).select(key, "word", (F.col("c") / F.col("n")).alias("rate"))


def punctuation(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Return (key, kind, mark, rate): marks over characters, and pairs of neighbouring marks over all pairs."""
    parsed = spark_frame(df.select(key, "text"), parse(Spark())[:2])
    marks = "[" + "".join("\\" + c for c in lx.STYLE_MARKS) + "]"
    seq = F.regexp_extract_all("prose", F.lit(marks), F.lit(0))
    seen = parsed.select(key, F.greatest(F.length("prose"), F.lit(1)).alias("n"), seq.alias("m"))
    one = seen.select(key, F.lit("mark").alias("kind"), "n", F.explode("m").alias("mark"))
    pairs = "transform(if(size(m) < 2, cast(array() as array<int>), sequence(0, greatest(size(m) - 2, 0))), i -> concat(m[i], m[i + 1]))"
    two = seen.select(key, F.lit("pair").alias("kind"), F.greatest(F.size("m") - 1, F.lit(1)).alias("n"), F.explode(F.expr(pairs)).alias("mark"))
    return one.union(two).groupBy(key, "kind", "mark", "n").agg(F.count(F.lit(1)).alias("c")).select(key, "kind", "mark", (F.col("c") / F.col("n")).alias("rate"))


def fit(profiles: DataFrame, documents: int) -> DataFrame:
    """Return (word, mean, sd, active): a row for each of the function words, over ``documents`` documents, those without the word included.

    The model has as many rows as there are function words, whatever the corpus.
    """
    if documents < 1:
        raise ValueError("at least one document is needed")
    words = profiles.sparkSession.createDataFrame([(w,) for w in lx.FUNCTION_WORDS], "word string")
    sums = profiles.groupBy("word").agg(F.sum("rate").alias("s"), F.sum(F.col("rate") * F.col("rate")).alias("q"))
    n = F.lit(float(documents))
    mean = F.coalesce(F.col("s"), F.lit(0.0)) / n
    spread = F.greatest(F.coalesce(F.col("q"), F.lit(0.0)) - n * mean * mean, F.lit(0.0))
    sd = F.sqrt(spread / (documents - 1)) if documents > 1 else F.lit(0.0)
    return words.join(sums, "word", "left").select("word", mean.alias("mean"), sd.alias("sd")).withColumn("active", F.col("sd") >= SD_FLOOR)


def centroid(profiles: DataFrame, model: DataFrame, documents: int) -> DataFrame:
    """Return (word, z): the mean z-score of a class of ``documents`` documents, for active words."""
    sums = profiles.groupBy("word").agg(F.sum("rate").alias("s"))
    return model.filter("active").join(sums, "word", "left").select("word", ((F.coalesce("s", F.lit(0.0)) / float(max(documents, 1)) - F.col("mean")) / F.col("sd")).alias("z"))


def distance(profiles: DataFrame, keys: DataFrame, model: DataFrame, centre: DataFrame, key: str = "doc_id", out: str = "delta") -> DataFrame:
    """Return (key, out) for every row of ``keys``: the mean absolute difference of z-scores to a centroid, 0 without active words."""
    zero = -F.col("mean") / F.col("sd")
    table = model.filter("active").join(centre, "word").select("word", "mean", "sd", "z", F.abs(zero - F.col("z")).alias("absent"))
    base = table.agg(F.coalesce(F.sum("absent"), F.lit(0.0)).alias("base"), F.count(F.lit(1)).alias("n"))
    change = F.abs((F.col("rate") - F.col("mean")) / F.col("sd") - F.col("z")) - F.col("absent")
    # the model has a row for each function word at most, the base is one row
    moved = profiles.join(F.broadcast(table), "word").groupBy(key).agg(F.sum(change).alias("moved"))
    joined = keys.select(key).join(moved, key, "left").crossJoin(F.broadcast(base))
    return joined.select(key, F.when(F.col("n") > 0, (F.col("base") + F.coalesce("moved", F.lit(0.0))) / F.col("n")).otherwise(0.0).alias(out))


def delta(profiles: DataFrame, model: DataFrame, left: DataFrame, key: str = "doc_id") -> DataFrame:
    """Return (a, b, delta) for stated pairs (a, b) of keys: mean absolute difference of z-scores; symmetric."""
    table = F.broadcast(model.filter("active"))
    z = profiles.join(table, "word").select(key, "word", (F.col("rate") / F.col("sd")).alias("v"))
    one = left.join(z.withColumnsRenamed({key: "a", "v": "va"}), "a", "left").select("a", "b", "word", F.col("va").alias("v"))
    two = left.join(z.withColumnsRenamed({key: "b", "v": "vb"}), "b", "left").select("a", "b", "word", (-F.col("vb")).alias("v"))
    sums = one.union(two).groupBy("a", "b", "word").agg(F.sum("v").alias("v")).groupBy("a", "b").agg(F.coalesce(F.sum(F.abs("v")), F.lit(0.0)).alias("s"))
    n = model.filter("active").agg(F.count(F.lit(1)).alias("n"))
    return sums.crossJoin(F.broadcast(n)).select("a", "b", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("delta"))


def nearest_centroid(df: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """Return (key, margin, delta_human, delta_machine) for all rows of ``df``, fitted on those with a label (0 human, 1 machine).

    A positive margin is nearer to class 1.
    """
    profiles = profile(df, key).persist()
    marked = df.select(key).join(labels.select(key, F.col(label).alias("__label")), key)
    counts = {r[0]: r[1] for r in marked.groupBy("__label").count().collect()}
    known = profiles.join(marked, key)
    model = fit(known, sum(counts.values())).persist()
    sides = {c: distance(profiles, df, model, centroid(known.filter(F.col("__label") == c), model, counts.get(c, 0)), key, name) for c, name in ((0, "delta_human"), (1, "delta_machine"))}
    return sides[0].join(sides[1], key).select(key, (F.col("delta_human") - F.col("delta_machine")).alias("margin"), "delta_human", "delta_machine")


def verify_authorship(df: DataFrame, key: str = "doc_id", role: str = "role") -> DataFrame:
    """One row for each candidate of ``df``, whose role is candidate, reference or background.

    Delta to the author's centroid, mean and deviation of the background's, the
    share of the background that is strictly nearer, and whether under half is.
    All candidates are fitted together. Without background: NaN and null.
    """
    roles = df.select(key, role)
    counts = {r[0]: r[1] for r in roles.groupBy(role).count().collect()}
    if not counts.get("reference"):
        raise ValueError("at least one reference document is needed")
    profiles = profile(df, key).persist()
    model = fit(profiles, sum(counts.values())).persist()
    refs = profiles.join(roles.filter(F.col(role) == "reference").select(key), key)
    deltas = distance(profiles, df, model, centroid(refs, model, counts["reference"]), key).join(roles, key)
    others = deltas.filter(F.col(role) == "background").select(F.col("delta").alias("d"))
    nan = F.lit(float("nan"))
    stats = others.agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    cand = deltas.filter(F.col(role) == "candidate").select(key, F.col("delta").alias("delta_to_author"))
    # nearer background counts by a running count over all deltas, not by pairs
    from textlode.operators.metrics import running

    marked = cand.select(F.col("delta_to_author").alias("v"), F.lit(0).alias("c"), F.lit(1).alias("kind"), key).unionByName(others.select(F.col("d").alias("v"), F.lit(1).alias("c"), F.lit(0).alias("kind")), allowMissingColumns=True)
    below = running(marked.groupBy("v").agg(F.sum("c").alias("c"), F.max("kind").alias("k")), ["v"], ["c"]).select("v", F.col("before_c").alias("below"))
    n = counts.get("background", 0)
    out = cand.join(below, cand["delta_to_author"] == below["v"]).drop("v").crossJoin(F.broadcast(stats))
    share = F.col("below") / float(n) if n else nan
    return out.select(key, "delta_to_author", F.coalesce("m", nan).alias("background_mean"), F.coalesce("s", nan).alias("background_sd"), share.alias("percentile_among_others"), (share < 0.5 if n else F.lit(None).cast("boolean")).alias("consistent_with_author"))
