"""From signals to a probability, a verdict and a confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.functions import lexicon as lx
from textlode.operators import reading, signals
from textlode.operators.reading import LEAST_WORDS, RELIABLE_WORDS
from textlode.operators.signals import LAYERS
from textlode.plans.dialect import Spark, Stage, spark_frame


def score_stages(d: Spark, prompt_layer: bool = True) -> list[Stage]:
    """word count, log-odds, probability, verdict and confidence from the signals' columns."""
    layers = [k for k in LAYERS if prompt_layer or k != "prompt"]
    sums = {f"sum_{k}": "cast(0 as double)" + "".join(f" + {lx.LAYER_WEIGHTS[k]} * {n}__lo" for n in LAYERS[k]) for k in layers}
    names = [n for k in layers for n in LAYERS[k]]
    shrink = f"(case when wc >= {RELIABLE_WORDS} then cast(1 as double) when wc <= {LEAST_WORDS} then cast(0.35 as double) else 0.35 + 0.65 * (cast(wc - {LEAST_WORDS} as double) / {RELIABLE_WORDS - LEAST_WORDS}) end)"
    level = "(case when active >= 6 and wc >= 600 then 'high' when active >= 3 then 'medium' else 'low' end)"
    bands = " ".join(f"when probability >= {t} then {d.text(name)}" for t, name in lx.BANDS)
    return [
        sums | {"active": " + ".join(f"(case when abs({n}__lo) > 0.1 then 1 else 0 end)" for n in names)},
        {"total_logodds": f"{lx.BASE_LOGODDS} + ({' + '.join(sums)}) * {shrink}"},
        {"p_raw": "1 / (1 + exp(-greatest(cast(-60 as double), least(cast(60 as double), total_logodds))))"},
        {
            "probability": f"case when wc < {LEAST_WORDS} then cast(0.5 as double) else p_raw end",
            "confidence": f"case when wc < {LEAST_WORDS} then 'none' when wc < {RELIABLE_WORDS} or abs(p_raw - 0.5) < 0.15 then 'low' when abs(p_raw - 0.5) < 0.25 and {level} = 'high' then 'medium' else {level} end",
        },
        {"verdict": f"case when confidence = 'none' then 'insufficient text' {bands} end"},
    ]


def all_stages(d: Spark, prompt_layer: bool = True, burrows: str | None = None, text: str = "text") -> list[Stage]:
    """Every stage from the text to the verdict; ``burrows`` is a margin column for the stylometry layer, absent: neutral."""
    layers = [k for k in signals.BUILDERS if prompt_layer or k != "prompt"]
    return [*signals.stages(d, layers, text), burrows_stage(burrows), *score_stages(d, prompt_layer)]


def burrows_stage(margin: str | None) -> Stage:
    m = f"coalesce({margin}, cast(0 as double))" if margin else "cast(0 as double)"
    lo = f"case when wc < 200 then cast(0 as double) else greatest(cast(-1.2 as double), least(cast(1.2 as double), {m} * 3.0)) * least(cast(wc as double) / 400, cast(1 as double)) end"
    return {"burrows_delta__lo": lo, "burrows_delta__d": f"case when wc < 200 then cast(0 as double) else {m} end"}


def _settled(column: F.Column | str) -> F.Column:
    """The column, behind a condition that always holds but that the optimizer may not move.

    A filter or a generator over a scored column would otherwise be pushed below
    the stages, each time with all of their expressions written out in it.
    """
    return F.when(F.rand(0) >= -F.length("raw"), F.col(column) if isinstance(column, str) else column)


REPORT = ["word_count", "total_logodds", "probability", "verdict", "confidence"]


def score(df: DataFrame, text: str = "text", prompt_layer: bool = True, burrows: str | None = None, signals_too: bool = True) -> DataFrame:
    """Add the report to each row: REPORT, layer_totals (map) and, on demand, signals and notes.

    A null text is an empty one. All is one narrow projection: no shuffle, no
    Python, so it runs on a stream as well. ``signals`` is an array of (name,
    layer, logodds, detail, direction); the code layer is in it only for texts
    that look like code. ``measure`` gives the same in an eighth of the time.
    """
    work = df.withColumn("__text", F.col(text))
    own = [c for c in df.columns if c not in (*REPORT, "layer_totals", "signals", "notes")]
    base = work.select(F.struct(*(F.col(c) for c in own)).alias("__row"), F.col("__text"), *([F.col(burrows).alias("__margin")] if burrows else []))
    found = spark_frame(base, all_stages(Spark(), prompt_layer, "__margin" if burrows else None, "__text"))
    layers = [k for k in LAYERS if prompt_layer or k != "prompt"]
    totals = F.create_map(*(x for k in layers for x in (F.lit(k), F.col(f"sum_{k}"))))
    columns = [F.col(f"__row.{c}").alias(c) for c in own]
    columns += [_settled("wc").alias("word_count"), *(_settled(c).alias(c) for c in REPORT[1:]), _settled(totals).alias("layer_totals")]
    if signals_too:
        columns += [_settled(signal_array(layers)).alias("signals"), _settled(notes(F.col("wc"), F.col("injection_surface__d") if prompt_layer else None)).alias("notes")]
    return found.select(*columns)


def measure(df: DataFrame, text: str = "text", prompt_layer: bool = True, burrows: str | None = None, signals_too: bool = True) -> DataFrame:
    """The columns that ``score`` adds, read by Arrow workers in one pass over each text: a narrow projection too."""
    own = [c for c in df.columns if c not in (*REPORT, "layer_totals", "signals", "notes")]
    quoted = [F.col(f"`{c}`") for c in own]
    found = df.select(*quoted, reading.report(F.col(f"`{text}`"), prompt_layer, F.col(f"`{burrows}`") if burrows else None, signals_too).alias("__report"))
    layers = [k for k in LAYERS if prompt_layer or k != "prompt"]
    totals = F.create_map(*(x for i, k in enumerate(layers) for x in (F.lit(k), F.col("__report.sums")[i])))
    columns = [*quoted, *(F.col(f"__report.{c}").alias(c) for c in REPORT), totals.alias("layer_totals")]
    if signals_too:
        at = {n: i for i, (_, n) in enumerate((k, n) for k in layers for n in LAYERS[k])}
        found_at = lambda kind: lambda n: F.col(f"__report.{kind}")[at[n]]
        columns.append(signal_array(layers, found_at("logodds"), found_at("details"), F.col("__report.is_code")).alias("signals"))
        injected = found_at("details")("injection_surface") if prompt_layer else None
        columns.append(notes(F.col("__report.word_count"), injected).alias("notes"))
    return found.select(*columns)


def signal_array(layers: list[str], logodds=lambda n: F.col(f"{n}__lo"), detail=lambda n: F.col(f"{n}__d"), is_code: F.Column | None = None) -> F.Column:
    def one(layer: str, name: str) -> F.Column:
        lo = logodds(name)
        way = F.when(lo > 0.05, "machine").when(lo < -0.05, "human").otherwise("neutral")
        return F.struct(F.lit(f"{layer}.{name}").alias("name"), F.lit(layer).alias("layer"), lo.alias("logodds"), detail(name).alias("detail"), way.alias("direction"))

    plain = F.array(*(one(k, n) for k in layers for n in LAYERS[k] if k != "code"))
    if "code" not in layers:
        return plain
    return F.when(F.col("is_code") if is_code is None else is_code, F.concat(plain, F.array(*(one("code", n) for n in LAYERS["code"])))).otherwise(plain)


def notes(wc: F.Column, injected: F.Column | None) -> F.Column:
    short = F.when(wc < LEAST_WORDS, F.format_string("Only %d words: far too short to judge.", wc))
    short = short.when(wc < RELIABLE_WORDS, F.format_string(f"Only %d words; {RELIABLE_WORDS} or more are needed for a reliable result.", wc))
    found = [short]
    if injected is not None:
        found.append(F.when(injected > 0, F.format_string("Possible prompt injection, %d places.", injected.cast("int"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def top_signals(column: str = "signals", least: float = 0.01) -> F.Column:
    """Signals by falling size of their log-odds; those of ``least`` or less are left out. Ties keep the signals' order."""
    strong = f"filter(transform({column}, (s, i) -> struct(s as s, i as i)), x -> abs(x.s.logodds) > {least})"
    order = "(a, b) -> case when abs(a.s.logodds) > abs(b.s.logodds) then -1 when abs(a.s.logodds) < abs(b.s.logodds) then 1 else a.i - b.i end"
    return F.expr(f"transform(array_sort({strong}, {order}), x -> x.s)")


def machine_evidence(column: str = "signals") -> F.Column:
    return F.filter(top_signals(column), lambda s: s["logodds"] > 0)


def human_evidence(column: str = "signals") -> F.Column:
    return F.filter(top_signals(column), lambda s: s["logodds"] < 0)


def signal_rows(df: DataFrame, *ids: str) -> DataFrame:
    """One row for each signal of a scored frame."""
    return df.select(*ids, F.explode_outer("signals").alias("s")).select(*ids, "s.*")


def attribution_stages(d: Spark) -> list[Stage]:
    """A raw score for each model profile: phrases, patterns and characters."""
    out: Stage = {}
    for k, (phrases, patterns, chars) in enumerate(lx.PROFILES.values()):
        parts = [f"(length(low) - length(replace(low, {d.text(p)}, ''))) / {len(p)}" for p in phrases]
        for pattern, least in patterns:
            n = f"cast({d.count('raw', pattern, lines=True)} as double)"
            parts.append(f"(case when {n} >= {least} then 0.7 * least({n} / {least}, cast(3 as double)) else 0 end)")
        parts += [f"(case when {d.occurrences('raw', c)} > 0 then 1.5 else 0 end)" for c in chars]
        out[f"model{k}"] = f"round(cast({' + '.join(parts)} as double), 2)"
    return [*signals.parse(d)[:2], {"low": "lower(prose)"}, out]


def attribute(df: DataFrame) -> DataFrame:
    """Add ``attribution``: (model, score) of the profiles with a score over 0, best first."""
    found = spark_frame(df.withColumn("__row", F.struct(*df.columns)), attribution_stages(Spark()))
    models = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"model{k}").alias("score"), F.lit(k).alias("k")) for k, m in enumerate(lx.PROFILES)))
    by = F.array_sort(F.filter(models, lambda x: x["score"] > 0), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["k"] - b["k"]))
    return found.select("__row.*", _settled(F.transform(by, lambda x: F.struct(x["model"].alias("model"), x["score"].alias("score")))).alias("attribution"))
