"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a table of additions by bin, learned by boosting that cycles
through the features with shallow trees; then the pairs that explain most of
what is left get tables over two features, learned the same way. A text's score
is the logistic function of the sum of the additions of its bins.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm._common import held_out, tidy

FEATURES = (
    "log_bytes log_words log_lines word_length upper digits ascii_marks bars bangs other_marks non_ascii sentence_ends commas "
    "distinct top_word twins repeated_lines short_words long_words line_words symbol_words"
).split()

_CLASS = np.zeros((8, 256))
for _row, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*<>@^_~=+/\\{}[]", b"|", b"!", b"\"'()-;:", b".?", b",")):
    _CLASS[_row, list(_bytes)] = 1
_SYMBOLS = frozenset("#$%&*<>|!@^_~=+")


def describe(text: str) -> list[float]:
    """The features of a whole text; language and source are not among them."""
    data = text.encode()
    n = len(data)
    words = text.split()
    if not words:
        return [math.log1p(n)] + [0.0] * (len(FEATURES) - 1)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    upper, digits, marks, bars, bangs, others, ends, commas = (_CLASS @ counts).tolist()
    k = len(words)
    of = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = n - counts[0x20] - counts[0x0A]
    lengths = Counter(map(len, words))
    return [
        math.log1p(n),
        math.log1p(k),
        math.log1p(len(lines)),
        letters / k,
        upper / letters,
        digits / letters,
        marks / k,
        bars / k,
        bangs / k,
        others / k,
        float(counts[128:].sum()) / n,
        ends / k,
        commas / k,
        len(of) / k,
        max(of.values()) / k,
        sum(map(operator.eq, words, words[1:])) / k,
        1 - len(set(lines)) / len(lines),
        sum(v for c, v in lengths.items() if c <= 3) / k,
        sum(v for c, v in lengths.items() if c > 12) / k,
        math.log1p(k / len(lines)),
        sum(v for w, v in of.items() if w[-1] in _SYMBOLS) / k,
    ]


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]  # of each feature, inner edges of its bins
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), dtype=int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> int | None:
    """The edge that gains most; None if none gains. least: of the sum of h on a side."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = 0
    best = int(np.argmax(gain)) if len(gain) else 0
    return best + 1 if len(gain) and gain[best] > 1e-9 else None


def _shallow(g: np.ndarray, h: np.ndarray, ridge: float, least: float, leaves: int = 3) -> np.ndarray:
    """A tree over one feature's bins: the additions of its leaves by bin."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        edges = [(a, b, _split(g[a:b], h[a:b], ridge, least)) for a, b in parts]
        good = [(a, b, a + s) for a, b, s in edges if s]
        if not good:
            break
        a, b, s = max(good, key=lambda p: h[p[0] : p[1]].sum())
        parts.remove((a, b))
        parts += [(a, s), (s, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _crossed(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The cross of one edge on each side that gains most on a grid of two features: gain, additions by cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quarters = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    quarters.append((cg[-1, -1] - sum(q[0] for q in quarters), ch[-1, -1] - sum(q[1] for q in quarters)))
    gain = sum(np.where(y >= least, x**2 / (y + ridge), 0.0) for x, y in quarters) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    out = np.zeros_like(g)
    if not gain.size:
        return 0.0, out
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    for k, (rows, columns) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        x, y = (np.broadcast_to(q, gain.shape)[i, j] for q in quarters[k])
        out[rows, columns] = x / (y + ridge) if y >= least else 0.0
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, ridge: float = 2.0, least: float = 2.0) -> Model:
    """Learn from features and 0/1 labels. One class, or no rows, gives a constant."""
    n, m = x.shape
    mean = (y.sum() + 1) / (n + 2)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    model = Model(math.log(mean / (1 - mean)), cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    if n == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(n, model.base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(m):
            if not len(cuts[j]):
                continue
            g, h = residuals()
            step = rate * _shallow(np.bincount(b[:, j], g, len(cuts[j]) + 1), np.bincount(b[:, j], h, len(cuts[j]) + 1), ridge, least)
            model.tables[j] += step
            total += step[b[:, j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(cuts[i]) + 1, len(cuts[j]) + 1
        cell = b[:, i] * shape[1] + b[:, j]
        g, h = residuals()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_crossed(*grid(i, j), ridge, least)[0], i, j) for i in range(m) for j in range(i) if len(cuts[i]) and len(cuts[j])), reverse=True)
    chosen = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    model.pairs = [(i, j, np.zeros((len(cuts[i]) + 1, len(cuts[j]) + 1))) for i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _crossed(*grid(i, j), ridge, least)[1]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([describe(t or "") for t in texts.to_pylist()], dtype=float).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 20_000, **options) -> Model:
    """Fit on labelled documents that are not held out: at most ``rows`` of them, those whose draw is lowest.

    Rows without an id or a label are left out, an id that is labelled twice
    counts with its larger label. The sample is bounded, so it may be broadcast,
    and its features, not its texts, go to the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    schema = "label int, x array<double>"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(_matrix(batch.column(0))), pa.list_(pa.float64()))], names=["label", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "__label")
    found = joined.mapInArrow(run, schema).toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = np.array(found.column("label").to_pylist(), dtype=float)
    order = np.lexsort((*x.T, y))  # the same model whatever the order of the rows
    return fit(x[order], y[order], **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Return the rows of ``docs`` with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    A null text counts as empty. Columns named score or predicted are replaced.
    """
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.scores(_matrix(texts)))

    udf = F.arrow_udf(run, "double")
    return docs.select(*columns, udf("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
