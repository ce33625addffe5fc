"""Queries of the evidence engine, by name, with the SQL that gives the same rows.

Signals are expressions with a Spark and a DuckDB spelling, see dialect.py; the
SQL of windows, spans, profiles and metrics is written on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions import lexicon as lx
from textlode.operators import metrics, reading, scoring, signals, stylometry, windows
from textlode.plans import probe
from textlode.plans.dialect import Duck, Spark, duck_query

QUERIES: dict = {}
SQL: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over the cores when the input has fewer splits than there are: the work on a row far outweighs its move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, "doc_id") if len(df.inputFiles()) < cores else df


def probed(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.expr(probe.probed(Spark())))


_PROBED = f"SELECT doc_id, {probe.probed(Duck())} AS text FROM documents"
_RAW = "SELECT doc_id, text FROM documents"


def _rounded(name: str) -> str:
    return f"round({name}, 6)"


def _layer_query(layer: str):
    names = [f"{n}__{x}" for n in signals.LAYERS[layer] for x in ("lo", "d")]
    label = {n: n.replace("__lo", "_logodds").replace("__d", "_detail") for n in names}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def found(text: str | None) -> list[float]:
            return [x for pair in reading.layer(layer, reading.Reading(text)) for x in pair]

        docs = probed(documents(spark, sf_dir).select("doc_id", "text"))
        values = docs.select("doc_id", reading.per_text(found, "array<double>", F.col("text")).alias("v"))
        return values.select("doc_id", *(F.round(F.col("v")[i], 6).alias(label[n]) for i, n in enumerate(names)))

    sql = duck_query(_PROBED, signals.stages(Duck(), [layer]), "doc_id, " + ", ".join(f"{_rounded(n)} AS {label[n]}" for n in names))
    return run, sql


for _layer in signals.BUILDERS:
    QUERIES[f"{_layer}_signals"], SQL[f"{_layer}_signals"] = _layer_query(_layer)


# --- parsing ---------------------------------------------------------------


def parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def found(text: str | None) -> tuple:
        r = reading.Reading(text)
        return r.wc, len(r.sentences), len(r.paras), r.ident_rate, "|".join(r.sentences)

    docs = probed(documents(spark, sf_dir).select("doc_id", "text"))
    kind = "struct<n_words:int,n_sentences:int,n_paragraphs:int,identifier_rate:double,sentences:string>"
    rows = docs.select("doc_id", reading.per_text(found, kind, F.col("text")).alias("p")).select("doc_id", "p.*")
    return rows.select("doc_id", "n_words", "n_sentences", "n_paragraphs", F.round("identifier_rate", 6).alias("identifier_rate"), F.md5("sentences").alias("sentences_md5"))


QUERIES["parse_counts"] = parse_counts
SQL["parse_counts"] = duck_query(_PROBED, signals.parse(Duck()), "doc_id, wc::INT AS n_words, len(sentences)::INT AS n_sentences, len(paras)::INT AS n_paragraphs, round(ident_rate, 6) AS identifier_rate, md5(array_to_string(sentences, '|')) AS sentences_md5")


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(signals.WORD), F.lit(0))).alias("w"))
    return words.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


QUERIES["word_tokens"] = word_tokens
SQL["word_tokens"] = f"SELECT lower(w) AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, {Duck.text(signals.WORD)})) AS w FROM documents) GROUP BY 1"


# --- scores ----------------------------------------------------------------


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.measure(probed(documents(spark, sf_dir).select("doc_id", "text")), signals_too=False)
    return found.select("doc_id", F.col("word_count").alias("word_count"), F.round("total_logodds", 6).alias("total_logodds"), F.round("probability", 6).alias("probability"), "verdict", "confidence")


QUERIES["score_documents"] = score_documents
_SCORED = "doc_id, wc::INT AS word_count, round(total_logodds, 6) AS total_logodds, round(probability, 6) AS probability, verdict, confidence"
SQL["score_documents"] = duck_query(_PROBED, scoring.all_stages(Duck()), _SCORED)


def score_without_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.measure(probed(documents(spark, sf_dir).select("doc_id", "text")), prompt_layer=False, signals_too=False)
    return found.select("doc_id", F.round("total_logodds", 6).alias("total_logodds"), F.round("probability", 6).alias("probability"), "verdict", "confidence")


QUERIES["score_without_prompts"] = score_without_prompts
SQL["score_without_prompts"] = duck_query(_PROBED, scoring.all_stages(Duck(), prompt_layer=False), "doc_id, round(total_logodds, 6) AS total_logodds, round(probability, 6) AS probability, verdict, confidence")


def layer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.measure(probed(documents(spark, sf_dir).select("doc_id", "text")), signals_too=False)
    return found.select("doc_id", F.explode_outer("layer_totals").alias("layer", "total")).select("doc_id", "layer", F.round("total", 6).alias("total"))


QUERIES["layer_totals"] = layer_totals
SQL["layer_totals"] = "SELECT doc_id, layer, round(total, 6) AS total FROM (" + duck_query(_PROBED, scoring.all_stages(Duck()), "doc_id, " + ", ".join(f"sum_{k} AS {k}" for k in signals.LAYERS)) + f") UNPIVOT (total FOR layer IN ({', '.join(signals.LAYERS)}))"


def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals that say something, ranked within their document."""
    found = scoring.measure(probed(documents(spark, sf_dir).select("doc_id", "text"))).select("doc_id", F.posexplode_outer(scoring.top_signals()).alias("rank", "s")).filter("rank is not null")
    return found.select("doc_id", "rank", F.col("s.name").alias("name"), F.round("s.logodds", 6).alias("logodds"), F.col("s.direction").alias("direction"))


QUERIES["top_signals"] = top_signals
_LONG = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, '{k}.{n}' AS name, {n}__lo AS lo FROM s" for i, (k, n) in enumerate((k, n) for k in [*(x for x in signals.LAYERS if x != "code"), "code"] for n in signals.LAYERS[k]))
SQL["top_signals"] = (
    "WITH s AS (" + duck_query(_PROBED, scoring.all_stages(Duck()), "*") + f"), l AS ({_LONG}) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY abs(lo) DESC, i) - 1)::INT AS rank, name, round(lo, 6) AS logodds, CASE WHEN lo > 0.05 THEN 'machine' WHEN lo < -0.05 THEN 'human' ELSE 'neutral' END AS direction FROM l WHERE abs(lo) > 0.01"
)


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.attribute(probed(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select("doc_id", F.posexplode_outer("attribution").alias("rank", "a")).filter("rank is not null").select("doc_id", "rank", "a.model", "a.score")


QUERIES["attribution"] = attribution
SQL["attribution"] = (
    "WITH s AS (" + duck_query(_PROBED, scoring.attribution_stages(Duck()), "*") + "), l AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{m}' AS model, model{k} AS score FROM s WHERE model{k} > 0" for k, m in enumerate(lx.PROFILES))
    + ") SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) - 1)::INT AS rank, model, score FROM l"
)


# --- windows ---------------------------------------------------------------


def _duck_windows(source: str, window: int, stride: int, tail: bool) -> str:
    d = Duck()
    ws = f"SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {windows.tokens(d, 'text')} AS ws FROM ({source})) WHERE len(ws) >= 40"
    return f"SELECT doc_id, n, start, least(start + {window}, n) AS stop, array_to_string(ws[start + 1 : start + {window}], ' ') AS text FROM (SELECT doc_id, ws, n, unnest({windows.starts(d, window, stride, tail)}) AS start FROM ({ws}))"


def _duck_window_scores(tail: bool) -> str:
    window, stride = windows.TRIAGE if tail else windows.FRACTION
    return duck_query(_duck_windows(_PROBED, window, stride, tail), scoring.all_stages(Duck()), "doc_id, n, start, stop, probability")


def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.window_scores(probed(documents(spark, sf_dir).select("doc_id", "text")), *windows.FRACTION, tail=False)
    return found.select("doc_id", F.col("start").cast("long").alias("start_word"), F.col("end").cast("long").alias("end_word"), F.round("probability", 6).alias("probability"))


QUERIES["window_scores"] = window_scores
SQL["window_scores"] = f"SELECT doc_id, start::BIGINT AS start_word, stop::BIGINT AS end_word, round(probability, 6) AS probability FROM ({_duck_window_scores(False)})"


def fraction_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.fraction(probed(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select("doc_id", F.round("fraction_ai", 6).alias("fraction_ai"), F.size("window_scores").alias("n_windows"))


QUERIES["fraction_flagged"] = fraction_flagged
SQL["fraction_flagged"] = f"SELECT d.doc_id, round(coalesce(f, 0), 6) AS fraction_ai, coalesce(n, 0)::INT AS n_windows FROM documents d LEFT JOIN (SELECT doc_id, avg((probability >= 0.5)::INT) AS f, count(*) AS n FROM ({_duck_window_scores(False)}) GROUP BY doc_id) USING (doc_id)"


def triage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.triage(probed(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select("doc_id", F.col("word_count").alias("n_words"), "prediction", F.round("fraction_ai", 6).alias("fraction_ai"), F.round("fraction_assisted", 6).alias("fraction_assisted"), F.size("windows").alias("n_windows"), F.size("machine_spans").alias("n_spans"))


_TRIAGED = "WITH w AS (" + _duck_window_scores(True) + "), c AS (SELECT doc_id, avg((probability >= 0.5)::INT) AS f, count(*) AS n FROM w GROUP BY doc_id), m AS (SELECT doc_id, i, avg(probability) >= 0.5 AS hot FROM (SELECT doc_id, unnest(range(start, stop)) AS i, probability FROM w) GROUP BY doc_id, i), g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m WHERE hot), spans AS (SELECT doc_id, min(i)::INT AS start_word, (max(i) + 1)::INT AS end_word FROM g GROUP BY doc_id, island)"
QUERIES["triage_classes"] = triage_classes
SQL["triage_classes"] = (
    _TRIAGED + f", a AS (SELECT doc_id, len({windows.tokens(Duck(), 'text')})::INT AS n_words FROM ({_PROBED})), k AS (SELECT a.doc_id, n_words, coalesce(f, 0) AS f, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (doc_id)) "
    "SELECT doc_id, n_words, CASE WHEN f <= 0.02 THEN 'human' WHEN f >= 0.90 THEN 'ai' ELSE 'ai_assisted' END AS prediction, round(CASE WHEN f <= 0.02 OR f >= 0.90 THEN f ELSE 0 END, 6) AS fraction_ai, round(CASE WHEN f <= 0.02 OR f >= 0.90 THEN 0 ELSE f END, 6) AS fraction_assisted, n::INT AS n_windows, coalesce((SELECT count(*) FROM spans WHERE spans.doc_id = k.doc_id), 0)::INT AS n_spans FROM k"
)


def machine_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.triage(probed(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select("doc_id", F.explode("machine_spans").alias("s")).select("doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"))


QUERIES["machine_spans"] = machine_spans
SQL["machine_spans"] = _TRIAGED + " SELECT doc_id, start_word, end_word FROM spans"


def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.segments(probed(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select("doc_id", "seg_no", F.md5("chunk").alias("chunk_md5"), F.round("probability", 6).alias("probability"))


QUERIES["segment_scores"] = segment_scores
_SEGMENTS = (
    "SELECT doc_id, i AS seg_no, array_to_string(paras[i + 1 : i + w], chr(10) || chr(10)) AS text FROM (SELECT doc_id, paras, w, unnest(range(0, len(paras) - w + 1)) AS i FROM (SELECT doc_id, paras, greatest(1, least(3, greatest(len(paras) // 2, 1))) AS w FROM ("
    + duck_query(_PROBED, signals.parse(Duck())[:3], "doc_id, paras") + ") WHERE len(paras) > 0))"
)
_LONG_SEGMENTS = f"SELECT * FROM ({_SEGMENTS}) WHERE {Duck().count('text', '[^' + chr(92) + 's]+')} >= 25"
SQL["segment_scores"] = f"SELECT doc_id, seg_no::INT AS seg_no, md5(text) AS chunk_md5, round(probability, 6) AS probability FROM ({duck_query(_LONG_SEGMENTS, scoring.all_stages(Duck()), 'doc_id, seg_no, text, probability')})"


# --- stylometry ------------------------------------------------------------


def function_word_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stylometry.profile(documents(spark, sf_dir)).select("doc_id", "word", F.round("rate", 9).alias("rate"))


_IN = "(" + ", ".join(f"'{w}'" for w in lx.FUNCTION_WORDS) + ")"
_PROFILE = rf"SELECT doc_id, w AS word, count(*) / max(n) AS rate FROM (SELECT doc_id, len(ws) AS n, lower(unnest(ws)) AS w FROM (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '(?s)```.*?```', chr(10), 'g'), {Duck.text(signals.WORD)}) AS ws FROM documents)) WHERE w IN {_IN} GROUP BY doc_id, w"
QUERIES["function_word_profile"] = function_word_profile
SQL["function_word_profile"] = f"SELECT doc_id, word, round(rate, 9) AS rate FROM ({_PROFILE})"


def delta_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = stylometry.fit(stylometry.profile(docs), docs.count())
    return model.select("word", F.round("mean", 9).alias("mean"), F.round("sd", 7).alias("sd"), "active")


_WORDS = "SELECT unnest([" + ", ".join(f"'{w}'" for w in lx.FUNCTION_WORDS) + "]) AS word"
_DENSE = "SELECT d.doc_id, w.word, coalesce(p.rate, 0) AS rate FROM {docs} d CROSS JOIN w LEFT JOIN p ON p.doc_id = d.doc_id AND p.word = w.word"
QUERIES["delta_model"] = delta_model
SQL["delta_model"] = f"WITH p AS ({_PROFILE}), w AS ({_WORDS}) SELECT word, round(avg(rate), 9) AS mean, round(stddev_samp(rate), 7) AS sd, stddev_samp(rate) >= 1e-4 AS active FROM ({_DENSE.format(docs='documents')}) GROUP BY word"


def burrows_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of all documents to the centroids of two labelled classes (the labels say nothing of authorship; they test the method)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    found = stylometry.nearest_centroid(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return found.select("doc_id", F.round("margin", 6).alias("margin"), F.round("delta_human", 6).alias("delta_human"), F.round("delta_machine", 6).alias("delta_machine"))


QUERIES["burrows_delta"] = burrows_delta
SQL["burrows_delta"] = (
    f"WITH p AS ({_PROFILE}), w AS ({_WORDS}), k AS (SELECT documents.doc_id, quality FROM documents JOIN labels USING (doc_id)), t AS (SELECT f.*, quality FROM ({_DENSE.format(docs='k')}) f JOIN k USING (doc_id)), "
    "m AS (SELECT word, avg(rate) AS mean, stddev_samp(rate) AS sd FROM t GROUP BY word HAVING stddev_samp(rate) >= 1e-4), c AS (SELECT m.word, mean, sd, avg((rate - mean) / sd) FILTER (quality = 0) AS h, avg((rate - mean) / sd) FILTER (quality = 1) AS a FROM t JOIN m USING (word) GROUP BY m.word, mean, sd), "
    f"a AS ({_DENSE.format(docs='documents')}), r AS (SELECT doc_id, avg(abs((rate - mean) / sd - h)) AS dh, avg(abs((rate - mean) / sd - c.a)) AS dm FROM a JOIN c USING (word) GROUP BY doc_id) "
    "SELECT doc_id, round(dh - dm, 6) AS margin, round(dh, 6) AS delta_human, round(dm, 6) AS delta_machine FROM r"
)


# --- metrics ---------------------------------------------------------------


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, label): probabilities beside labels that test the arithmetic of the metrics."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    # the labels come first: texts without one are not scored
    docs = documents(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id")
    return scoring.measure(docs, signals_too=False).select("doc_id", F.round("probability", 4).alias("score"), "label")


_LABELLED = f"WITH l AS (SELECT s.doc_id, round(probability, 4) AS score, quality AS label FROM ({duck_query(_RAW, scoring.all_stages(Duck()), 'doc_id, probability')}) s JOIN labels USING (doc_id))"


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(labelled_scores(spark, sf_dir)).select(F.round("auroc", 9).alias("auroc"))


QUERIES["auroc"] = auroc
SQL["auroc"] = _LABELLED + " SELECT round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 9) AS auroc FROM l a, l b WHERE a.label = 1 AND b.label = 0"


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_points(labelled_scores(spark, sf_dir)).filter("threshold < 2").select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), "threshold")


QUERIES["roc_points"] = roc_points
SQL["roc_points"] = _LABELLED + ", t AS (SELECT DISTINCT score AS threshold FROM l) SELECT round(count(*) FILTER (score >= threshold AND label = 0) / count(*) FILTER (label = 0), 9) AS fpr, round(count(*) FILTER (score >= threshold AND label = 1) / count(*) FILTER (label = 1), 9) AS tpr, threshold FROM l, t GROUP BY threshold"


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metrics.roc_points(labelled_scores(spark, sf_dir)).persist()
    a = metrics.fpr_at_tpr(points, 0.9).select(F.lit("fpr_at_tpr_90").alias("metric"), F.round("fpr", 9).alias("value"), "threshold")
    return a.union(metrics.tpr_at_fpr(points, 0.5).select(F.lit("tpr_at_fpr_50"), F.round("tpr", 9), "threshold"))


QUERIES["operating_points"] = operating_points
_POINTS = SQL["roc_points"].replace("SELECT round(count(*)", "r AS (SELECT round(count(*)", 1).replace(" r AS", ", r AS", 1) + ")"
SQL["operating_points"] = _POINTS + " (SELECT 'fpr_at_tpr_90' AS metric, fpr AS value, threshold FROM r WHERE tpr >= 0.9 ORDER BY fpr, threshold DESC LIMIT 1) UNION ALL (SELECT 'tpr_at_fpr_50', tpr, threshold FROM r WHERE fpr <= 0.5 ORDER BY tpr DESC, threshold DESC LIMIT 1)"


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.confusion(labelled_scores(spark, sf_dir), 0.6)
    return found.select("tp", "fp", "tn", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


QUERIES["confusion"] = confusion
SQL["confusion"] = _LABELLED + ", c AS (SELECT count(*) FILTER (score >= 0.6 AND label = 1) AS tp, count(*) FILTER (score >= 0.6 AND label = 0) AS fp, count(*) FILTER (score < 0.6 AND label = 0) AS tn, count(*) FILTER (score < 0.6 AND label = 1) AS fn FROM l) SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy FROM c"


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = labelled_scores(spark, sf_dir).persist()
    found = metrics.losses(scores).crossJoin(metrics.ece(scores))
    return found.select(*(F.round(c, 7).alias(c) for c in ("log_loss", "brier", "margin", "ece")), "n")


QUERIES["losses"] = losses
SQL["losses"] = (
    _LABELLED + ", b AS (SELECT count(*) AS k, abs(avg(score) - avg(label)) AS gap FROM l GROUP BY least(floor(score * 10), 9)) "
    "SELECT round(avg(CASE WHEN label = 1 THEN -ln(least(greatest(score, 1e-12), 1 - 1e-12)) ELSE -ln(1 - least(greatest(score, 1e-12), 1 - 1e-12)) END), 7) AS log_loss, round(avg((score - label) ** 2), 7) AS brier, round(min(score) FILTER (label = 1) - max(score) FILTER (label = 0), 7) AS margin, (SELECT round(sum(k * gap) / sum(k), 7) FROM b) AS ece, count(*) AS n FROM l"
)
