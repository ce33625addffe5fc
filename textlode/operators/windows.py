"""Scores of windows of words, the share that is flagged, and the spans that carry it."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.operators import reading
from textlode.operators.reading import LEAST_WORDS
from textlode.plans.dialect import Spark

FRACTION = (250, 125)
TRIAGE = (200, 50)


def tokens(d: Spark, x: str) -> str:
    """Words between white space."""
    return d.keep(d.split(x, r"[\s]+"), "x <> ''")


def starts(d: Spark, window: int, stride: int, tail: bool) -> str:
    """Word offsets of the windows of ``n`` words; with ``tail``, of one more that ends with the text."""
    last = f"greatest(n - {window}, 0)"
    found = d.steps(last, stride)
    if tail:
        extra = f"case when {last} % {stride} <> 0 then {last} end"
        joined = "list_append" if d.name == "duckdb" else "array_append"
        found = d.keep(f"{joined}({found}, {extra})", "x is not null")
    return found


def windows(df: DataFrame, window: int, stride: int, tail: bool, text: str = "text", spread: int | None = None) -> DataFrame:
    """One row for each window of ``df``'s rows: its columns less the text, start, end and text (words joined by one space).

    Texts under 40 words have none. ``spread`` deals the windows over that many
    partitions, as long texts have many.
    """
    d = Spark()
    rest = [c for c in df.columns if c != text]
    counted = df.select(*rest, F.expr(tokens(d, f"coalesce({text}, '')")).alias("__ws")).withColumn("n", F.size("__ws")).filter(F.col("n") >= LEAST_WORDS)
    # the words of all windows of a text are cut in one place, so that the list of words is not copied to each row
    cut = F.expr(d.bind("__ws", d.each(starts(d, window, stride, tail), f"struct(x as start, least(x + {window}, n) as `end`, array_join(slice(v, x + 1, {window}), ' ') as text)")))
    out = counted.select(*rest, "n", F.explode_outer(cut).alias("__w")).select(*rest, "n", "__w.start", "__w.end", F.col("__w.text").alias(text))
    return out.repartition(spread) if spread else out


_SPANS = "array<struct<start:int,end:int,probability:double>>"


def _offsets(n: int, window: int, stride: int, tail: bool) -> list[int]:
    """Where the windows of a text of n words begin; none under 40 words."""
    if n < LEAST_WORDS:
        return []
    last = max(n - window, 0)
    return [*range(0, last + 1, stride), *([last] if tail and last % stride else [])]


def _scored(words: list[str], window: int, stride: int, tail: bool) -> list[tuple[int, int, float]]:
    return [(k, min(k + window, len(words)), reading.probability(" ".join(words[k : k + window]))) for k in _offsets(len(words), window, stride, tail)]


def window_scores(df: DataFrame, window: int, stride: int, tail: bool, text: str = "text") -> DataFrame:
    """One row for each window of ``df``'s rows: its columns less the text, n, start, end and probability. One pass, no shuffle."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]

    def run(x: str | None) -> dict:
        words = (x or "").split()
        return {"n": len(words), "w": _scored(words, window, stride, tail)}

    found = df.select(*rest, reading.per_text(run, f"struct<n:int,w:{_SPANS}>", F.col(text)).alias("__w"))
    return found.select(*rest, F.col("__w.n").alias("n"), F.explode("__w.w").alias("__x")).select(*rest, "n", "__x.start", "__x.end", "__x.probability")


def fraction(df: DataFrame, key: str = "doc_id", window: int = FRACTION[0], stride: int = FRACTION[1], threshold: float = 0.5) -> DataFrame:
    """Return (key, fraction_ai, window_scores): share of windows at or over the threshold; 0 and none for short texts.

    Words after the last whole stride are not scored.
    """

    def run(x: str | None) -> dict:
        scores = [p for _, _, p in _scored((x or "").split(), window, stride, False)]
        return {"f": sum(p >= threshold for p in scores) / len(scores) if scores else 0.0, "w": scores}

    found = df.select(key, reading.per_text(run, "struct<f:double,w:array<double>>", F.col("text")).alias("__f"))
    return found.select(key, F.col("__f.f").alias("fraction_ai"), F.col("__f.w").alias("window_scores"))


def _machine_spans(windows: list[tuple[int, int, float]], window: int, stride: int, threshold: float) -> list[tuple[int, int]]:
    """Runs of words whose mean over the windows that cover them is at or over the threshold.

    Words between two neighbouring ends or starts of windows share their
    windows, so the work is by such cells; a cell looks at the few windows that
    start within a window's length before it.
    """
    cuts = sorted({c for s, e, _ in windows for c in (s, e)})
    near = -(-window // stride) + 1
    out: list[tuple[int, int]] = []
    for a, b in pairwise(cuts):
        first = max(a // stride - near, 0)
        around = windows[first : first + near + 2]
        if len(windows) > first + near + 2:
            around = [*around, windows[-1]]
        over = [p for s, e, p in around if s <= a < e]
        if over and reading._total(over) / len(over) >= threshold:
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def triage(df: DataFrame, key: str = "doc_id", window: int = TRIAGE[0], stride: int = TRIAGE[1], threshold: float = 0.5) -> DataFrame:
    """Return (key, word_count, prediction, fraction_ai, fraction_assisted, machine_spans, windows, note).

    A word's score is the mean of the windows that cover it; spans are runs of
    words at or over the threshold. Each text is read once, in one narrow projection.
    """

    def run(x: str | None) -> dict:
        words = (x or "").split()
        found = _scored(words, window, stride, True)
        share = sum(p >= threshold for _, _, p in found) / len(found) if found else 0.0
        return {"n": len(words), "f": share, "s": _machine_spans(found, window, stride, threshold), "w": found}

    kind = f"struct<n:int,f:double,s:array<struct<start:int,end:int>>,w:{_SPANS}>"
    out = df.select(key, reading.per_text(run, kind, F.col("text")).alias("t")).select(key, "t.*")
    kinds = F.when(F.col("f") <= 0.02, "human").when(F.col("f") >= 0.90, "ai").otherwise("ai_assisted")
    mixed = kinds == "ai_assisted"
    note = F.when(F.col("n") < LEAST_WORDS, "too short to judge").otherwise("")
    return out.select(key, F.col("n").alias("word_count"), kinds.alias("prediction"), F.when(~mixed, F.col("f")).otherwise(0.0).alias("fraction_ai"), F.when(mixed, F.col("f")).otherwise(0.0).alias("fraction_assisted"), F.col("s").alias("machine_spans"), F.col("w").alias("windows"), note.alias("note"))


def merged(spans: str) -> F.Column:
    """Intervals sorted and united where one starts at or before the end of those before it."""
    keep = "(a, s) -> if(size(a) > 0 and s.start <= a[size(a) - 1].`end`, concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start as start, greatest(a[size(a) - 1].`end`, s.`end`) as `end`))), concat(a, array(s)))"
    return F.expr(f"aggregate(array_sort({spans}), cast(array() as array<struct<start:int,end:int>>), {keep})")


def word_labels(spans: str, n: str) -> F.Column:
    """0 or 1 for each of n words."""
    return F.expr(f"transform(if({n} < 1, cast(array() as array<int>), sequence(0, greatest({n}, 1) - 1)), i -> if(exists({spans}, s -> s.start <= i and i < s.`end`), 1, 0))")


def excerpts(text: str, spans: str, limit: int = 3, words: int = 24) -> F.Column:
    d = Spark()
    ws = tokens(d, f"coalesce({text}, '')")
    return F.expr(f"transform(array({ws}), ws -> transform(slice({spans}, 1, {limit}), s -> concat(array_join(slice(ws, s.start + 1, least(s.`end` - s.start, {words})), ' '), ' ...')))[0]")


def span_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row of precision, recall, f1, iou, accuracy and counts over rows of one word each (0/1 columns); undefined: NaN."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.agg(*(F.count(F.when(x, 1)).alias(k) for k, x in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))))
    return ratios(c)


def ratios(c: DataFrame) -> DataFrame:
    nan = F.lit(float("nan"))
    c = c.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(nan))
    c = c.withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(nan))
    ok = ~F.isnan("precision") & ~F.isnan("recall") & (F.col("precision") + F.col("recall") > 0)
    c = c.withColumn("f1", F.when(ok, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(nan))
    some = F.col("tp") + F.col("fp") + F.col("fn")
    n = some + F.col("tn")
    return c.withColumn("iou", F.when(some > 0, F.col("tp") / some).otherwise(nan)).withColumn("accuracy", F.when(n > 0, (F.col("tp") + F.col("tn")) / n).otherwise(nan))


def segments(df: DataFrame, key: str = "doc_id", window: int = 3) -> DataFrame:
    """Return (key, seg_no, chunk, probability): runs of paragraphs, scored on their own; those under 25 words are left out."""

    def run(x: str | None) -> list[tuple[int, str, float]]:
        paras = reading.paragraphs(x)
        size = max(1, min(window, max(len(paras) // 2, 1)))
        chunks = ["\n\n".join(paras[i : i + size]) for i in range(len(paras) - size + 1)]
        return [(i, c, reading.probability(c)) for i, c in enumerate(chunks) if len(c.split()) >= 25]

    found = df.select(key, reading.per_text(run, "array<struct<seg_no:int,chunk:string,probability:double>>", F.col("text")).alias("__s"))
    return found.select(key, F.explode("__s").alias("__x")).select(key, "__x.*")
