"""Weights fitted to labelled features, and what they are worth outside the fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlode.operators import metrics, reading
from textlode.operators.scoring import measure
from textlode.operators.signals import LAYERS
from textlode.sources.tables import settled

FEATURES = [f"{k}.{n}" for k in LAYERS for n in LAYERS[k]]
#: Rows up to which every fold is descended on its own; beyond, folds follow the path of all rows (``_followed``).
MOST_ROWS = 1_000
#: Numbers of a matrix up to which the driver holds it; larger ones stay in blocks on the executors.
MOST_CELLS = 16_000_000
#: Epochs from one curvature to the next; between them it is taken as straight.
_STEP = 10


def features(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Return (key, one column of log-odds for each signal): a signal that a text lacks is 0."""
    found = df.select(key, reading.report(F.col("text")).alias("__report"))
    return found.select(key, *(F.col("__report.logodds")[i].alias(f) for i, f in enumerate(FEATURES)))


def fit(rows: DataFrame, names: list[str] | None = None, label: str = "label", l2: float = 0.01) -> tuple[dict[str, float], float]:
    """Logistic regression with a penalty on the weights but not the bias: (weights, bias), the optimum that descent approaches."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = names or FEATURES
    safe = [f"f{i}" for i in range(len(names))]
    table = rows.select(*(F.col(f"`{n}`").alias(s) for n, s in zip(names, safe, strict=True)), F.col(label).cast("double").alias("label"))
    if table.isEmpty():
        raise ValueError("no rows to fit")
    vectors = VectorAssembler(inputCols=safe, outputCol="features").transform(table)
    model = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10).fit(vectors)
    return dict(zip(names, model.coefficients.toArray().tolist(), strict=True)), float(model.intercept)


def apply(rows: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """Add ``score``: the fitted probability."""
    z = F.lit(bias)
    for name, w in weights.items():
        z = z + F.lit(w) * F.col(f"`{name}`")
    return rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z)))))


def save(weights: dict[str, float], bias: float, spark, path: str) -> None:
    rows = [("(bias)", bias), *weights.items()]
    spark.createDataFrame(rows, "name string, weight double").coalesce(1).write.mode("overwrite").json(path)


def load(spark, path: str) -> tuple[dict[str, float], float]:
    rows = {r["name"]: r["weight"] for r in spark.read.schema("name string, weight double").json(path).collect()}
    bias = rows.pop("(bias)")
    return rows, bias


def _descend(x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.05, l2: float = 0.01) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent from zero."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        err = 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - y
        b -= rate * err.mean()
        w -= rate * (x.T @ err / len(y) + l2 * w)
    return w, b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(features and a column of ones, labels) of the batch's columns after the key: label, then features."""
    y, *x = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[1:])
    return np.column_stack([*x, np.ones(len(y))]), y


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, curved: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Summed gradients of the loss for models w (a row each), and their curvatures on demand."""
    p = _sigmoid(x @ w.T)
    h = np.stack([(x * (q * (1 - q))[:, None]).T @ x for q in p.T]) if curved else None
    return (p - y[:, None]).T @ x, h


class _Path:
    """The descents from zero over all rows: for each epoch the models, their mean gradients, and curvatures every _STEP epochs."""

    def __init__(self, masks: np.ndarray, n: int, epochs: int, sums, rate: float = 0.05, l2: float = 0.01):
        self.masks, self.n, self.rate, self.epochs = masks, n, rate, epochs
        self.penalty = np.full(masks.shape[1], l2)
        self.penalty[-1] = 0
        w = np.zeros(masks.shape)
        self.w, self.g, self.h = [], [], []
        for t in range(epochs + 1):
            curved = t % _STEP == 0 or t == epochs
            g, h = sums(w, curved)
            g = g / n * masks
            if curved:
                self.h.append(h / n * masks[:, :, None] * masks[:, None, :])
            self.w.append(w)
            self.g.append(g)
            w = w - rate * (g + self.penalty * w)

    def curvature(self, t: int, model: int) -> np.ndarray:
        k, part = divmod(t, _STEP)
        last = min((k + 1) * _STEP, self.epochs)
        share = part / (last - k * _STEP) if part else 0.0
        return self.h[k][model] if not part else (1 - share) * self.h[k][model] + share * self.h[k + 1][model]

    def followed(self, x: np.ndarray, y: np.ndarray, model: int) -> np.ndarray:
        """The score of each row by the descent that leaves it out.

        Without a row the gradient is that of all rows less its own, at weights
        near those of all rows: the former is taken to the first order around
        the path, the row's own exactly.
        """
        n, x = self.n, x * self.masks[model]
        v = np.zeros_like(x)
        for t in range(self.epochs):
            own = (_sigmoid(np.einsum("ij,ij->i", x, v)) - y)[:, None] * x
            others = (n * (self.g[t][model] + (v - self.w[t][model]) @ self.curvature(t, model)) - own) / (n - 1)
            v -= self.rate * (others + self.penalty * v)
        return _sigmoid(np.einsum("ij,ij->i", x, v))


def _out_of_sample(rows: DataFrame, key: str, label: str, names: list[str], masks: np.ndarray, epochs: int) -> DataFrame:
    """Return (key, label, model, score): each row scored by models (rows of ``masks`` over the features and the bias) fitted without it."""
    spark = rows.sparkSession
    # plain names: mapInArrow takes a dot in a column's name for a field
    table = rows.select(F.col(f"`{key}`"), F.col(f"`{label}`").cast("int").alias("label"), *(F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(names)))
    # every later pass must see the same rows
    table = settled(table)
    counts = {r[0]: r[1] for r in table.groupBy("label").count().collect()}
    n, ones = sum(counts.values()), counts.get(1, 0)
    kind = f"`{key}` {dict(table.dtypes)[key]}, label int, model int, score double"
    alone = {v for v in (0, 1) if {0: n - ones, 1: ones}[v] == 1}

    def scored(batch: pa.RecordBatch, by) -> Iterator[pa.RecordBatch]:
        x, y = _matrix(batch)
        one_class = ones in (0, n)
        for model in range(len(masks)):
            scores = np.full(len(y), 0.5) if one_class else by(x, y, model)
            scores[np.isin(y, list(alone))] = 0.5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(y), model, np.int32)), pa.array(scores)], names=[key, "label", "model", "score"])

    if n <= MOST_ROWS:
        whole = table.toArrow().combine_chunks().to_batches()
        all_x, all_y = _matrix(whole[0]) if whole else (np.zeros((0, len(names) + 1)), np.zeros(0))
        # sums differ by the order of the rows, which Spark leaves open
        order = np.lexsort((*all_x.T, all_y))
        all_x, all_y = all_x[order], all_y[order]

        def refitted(x: np.ndarray, y: np.ndarray, model: int) -> np.ndarray:
            out = []
            for row, own in zip(x, y, strict=True):
                rest = np.ones(len(all_y), bool)
                rest[np.flatnonzero((all_x == row).all(1) & (all_y == own))[0]] = False
                w, b = _descend(all_x[rest, :-1] * masks[model, :-1], all_y[rest], epochs)
                out.append(_sigmoid(row[:-1] * masks[model, :-1] @ w + b))
            return np.array(out)

        by = refitted
        parts = min(max(1, n), 4 * spark.sparkContext.defaultParallelism)
    else:
        sums = _driver_sums(table) if n * (len(names) + 1) <= MOST_CELLS else _block_sums(table)
        path = spark.sparkContext.broadcast(_Path(masks, n, epochs, sums))

        def by(x: np.ndarray, y: np.ndarray, model: int) -> np.ndarray:
            return path.value.followed(x, y, model)

        parts = min(-(-n // 500), max(4 * spark.sparkContext.defaultParallelism, -(-n // 20_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                yield from scored(batch.slice(a, 2_000), by)

    return table.repartition(parts).mapInArrow(run, kind)


def _driver_sums(table: DataFrame):
    batches = [_matrix(b) for b in table.toArrow().to_batches() if b.num_rows]
    x, y = np.concatenate([b[0] for b in batches]), np.concatenate([b[1] for b in batches])
    return lambda w, curved: _sums(x, y, w, curved)


def _block_sums(table: DataFrame):
    """Sums by one pass over blocks of rows for each epoch; a lost block is read again from its table."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch)
            yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), pa.array([np.column_stack([x, y]).tobytes()], pa.binary())], names=["n", "data"])

    def opened(row) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(row["data"]).reshape(row["n"], -1)
        return both[:, :-1], both[:, -1]

    n_blocks = max(1, table.count() * len(table.columns) // 2_000_000)
    blocks = settled(table.coalesce(n_blocks).mapInArrow(block, "n int, data binary")).rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(w: np.ndarray, curved: bool):
        add = lambda a, b: (a[0] + b[0], a[1] + b[1] if curved else None)
        return blocks.map(lambda b: _sums(*b, w, curved)).treeReduce(add)

    return sums


def leave_one_out(rows: DataFrame, key: str = "doc_id", label: str = "label", names: list[str] | None = None, epochs: int = 1500) -> DataFrame:
    """Return (key, label, score): each row scored by a model fitted without it; 0.5 where the rest is of one class.

    Up to MOST_ROWS rows every fold is descended on its own. With more, the
    descent over all rows is followed with each row's share taken out: the work
    grows with the rows instead of their square, and scores differ by the order
    of 1 / rows squared.
    """
    names = names or FEATURES
    return _out_of_sample(rows, key, label, names, np.ones((1, len(names) + 1)), epochs).drop("model")


def ablate(rows: DataFrame, key: str = "doc_id", label: str = "label", names: list[str] | None = None, epochs: int = 800) -> DataFrame:
    """Return (signal, auroc_without, auroc_cost, logloss_without, logloss_cost, margin_without), dearest first.

    A signal is left out by a column of zeros, whose weight never leaves zero.
    """
    names = names or FEATURES
    spark = rows.sparkSession
    # the last model leaves no signal out
    masks = np.vstack([1 - np.eye(len(names), len(names) + 1), np.ones((1, len(names) + 1))])
    scores = settled(_out_of_sample(rows, key, label, names, masks, epochs))
    found = {r["model"]: r for r in _summaries(scores).collect()}
    base = found[len(names)]
    out = [(names[j], r.auroc, base.auroc - r.auroc, r.loss, r.loss - base.loss, r.margin) for j, r in sorted(found.items()) if j < len(names)]
    return spark.createDataFrame(sorted(out, key=lambda r: -r[4]), "signal string, auroc_without double, auroc_cost double, logloss_without double, logloss_cost double, margin_without double")


def _summaries(scores: DataFrame) -> DataFrame:
    """Return (model, auroc, loss, margin), a row for each model."""
    nan = F.lit(float("nan"))
    one, zero = F.col("label") == 1, F.col("label") == 0
    p = F.least(F.greatest("score", F.lit(1e-12)), F.lit(1 - 1e-12))
    c = scores.groupBy("model", "score").agg(F.count(F.when(one, 1)).alias("pos"), F.count(F.when(zero, 1)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("model").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = F.sum("pos") * F.sum("neg")
    areas = c.withColumn("below", below).groupBy("model").agg(F.when(pairs > 0, F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)) / pairs).otherwise(nan).alias("auroc"))
    rest = scores.groupBy("model").agg(F.avg(-F.when(one, F.log(p)).otherwise(F.log(1 - p))).alias("loss"), F.coalesce(F.min(F.when(one, F.col("score"))) - F.max(F.when(zero, F.col("score"))), nan).alias("margin"))
    return areas.join(rest, "model")


def _table(scores: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positives and negatives at each distinct score, in order of the scores."""
    c = metrics._counts(scores, "score", "label").toPandas().sort_values("score")
    return c["pos"].to_numpy(np.int64), c["neg"].to_numpy(np.int64)


def _counted_auroc(pos: np.ndarray, neg: np.ndarray) -> float:
    p, n = int(pos.sum()), int(neg.sum())
    if not p or not n:
        return float("nan")
    return float((pos.astype(float) * (2.0 * (np.cumsum(neg) - neg) + neg)).sum() / 2 / (float(p) * n))


def _replicates(spark, n: int, draw) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"v": [draw(int(i)) for i in batch["id"]]})

    return spark.range(0, n, numPartitions=4 * spark.sparkContext.defaultParallelism).mapInPandas(run, "v double").toPandas()["v"].to_numpy()


def bootstrap_auroc(scores: DataFrame, n: int = 2000, seed: int = 0) -> dict[str, float]:
    """Mean and percentile interval of the AUROC over resamples of (score, label); those of one class are left out.

    A resample is drawn as the counts of its distinct (score, label).
    """
    pos, neg = _table(scores)
    both = np.concatenate([pos, neg])
    k = int(both.sum())

    def draw(i: int) -> float:
        if not k:
            return float("nan")
        taken = np.random.default_rng([seed, i]).multinomial(k, both / k)
        return _counted_auroc(taken[: len(pos)], taken[len(pos) :])

    v = _replicates(scores.sparkSession, n, draw)
    v = np.sort(v[~np.isnan(v)])
    if not len(v):
        return {"mean": float("nan"), "lo95": float("nan"), "hi95": float("nan"), "usable": 0}
    return {"mean": float(v.mean()), "lo95": float(v[int(0.025 * len(v))]), "hi95": float(v[min(int(0.975 * len(v)), len(v) - 1)]), "usable": len(v)}


def permutation_test(scores: DataFrame, n: int = 10_000, seed: int = 0) -> dict[str, float]:
    """How often shuffled labels reach the observed AUROC, and the least p that so many labels allow.

    Shuffled labels are drawn as the number of positives at each distinct score.
    """
    import math

    pos, neg = _table(scores)
    both = pos + neg
    observed = _counted_auroc(pos, neg)
    k, ones = int(both.sum()), int(pos.sum())

    def draw(i: int) -> float:
        taken = np.random.default_rng([seed, i]).multivariate_hypergeometric(both, ones, method="count" if k <= 1_000_000 else "marginals")
        return _counted_auroc(taken, both - taken)

    hits = int((_replicates(scores.sparkSession, n, draw) >= observed).sum())
    # beyond the range of a float the least p is 0
    ways = math.lgamma(k + 1) - math.lgamma(ones + 1) - math.lgamma(k - ones + 1)
    return {"observed_auroc": observed, "p_value": (hits + 1) / (n + 1), "min_achievable_p": 1.0 / math.comb(k, ones) if ways < 700 else 0.0}


def report(df: DataFrame, key: str = "doc_id", label: str = "label", refit: bool = True) -> dict[str, dict[str, float]]:
    """Metrics of the given weights, and of weights refitted without each text; rows are kept apart by key."""
    rows = features(df, key).join(df.select(key, F.col(label).alias("label")), key).persist()
    plain = measure(df.select(key, "text", F.col(label).alias("label")), signals_too=False).select(key, "label", F.col("probability").alias("score"))
    out = {"given": _block(plain)}
    if refit:
        out["refitted"] = _block(leave_one_out(rows, key))
        out["gap"] = {"auroc": out["given"]["auroc"] - out["refitted"]["auroc"]}
    return out


def _block(scores: DataFrame) -> dict[str, float]:
    scores = scores.persist()
    points = metrics.roc_points(scores).persist()
    out = metrics.auroc(scores).first().asDict() | metrics.losses(scores).first().asDict() | metrics.ece(scores).first().asDict() | metrics.confusion(scores).first().asDict()
    out |= {"fpr_at_tpr_90": metrics.fpr_at_tpr(points, 0.9).first()["fpr"], "tpr_at_fpr_05": metrics.tpr_at_fpr(points, 0.05).first()["tpr"]}
    return out
