"""Queries of perturbation, synthesis, calibration and model-backed signals; SQL where the operator has no random numbers and no fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.operators import calibrate, models, perturb, scoring, signals, stylometry, synth
from textlode.plans.dialect import Duck, duck_query
from textlode.plans.registry import _PROBED, QUERIES, SQL, documents, probed, spread


def _attack_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = probed(documents(spark, sf_dir).select("doc_id", "text"))
        attack = next(a for a in perturb.ATTACKS if a.name == name)
        return docs.select("doc_id", F.md5(attack.column()).alias("text_md5"))

    return run


for _name in ("neutralise_register", "contractions", "strip_markup", "cluster_identifiers"):
    QUERIES[f"attack_{_name}"] = _attack_query(_name)
    _body = perturb.duck_attack(_name)
    SQL[f"attack_{_name}"] = f"SELECT doc_id, md5({_body}) AS text_md5 FROM ({_PROBED})"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probed(documents(spark, sf_dir).select("doc_id", "text"))


def attack_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.single_effects(_docs(spark, sf_dir))


def hardening_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.hardening_corpus(_docs(spark, sf_dir))


def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.robustness(_docs(spark, sf_dir))


def distance_to_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.distance_to_threshold(_docs(spark, sf_dir))


def mixed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return synth.corpus(documents(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return documents(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id")


def signal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calibrate.features(_docs(spark, sf_dir))
    return found.select("doc_id", *(F.round(F.col(f"`{n}`"), 6).alias(n.replace(".", "_")) for n in calibrate.FEATURES))


QUERIES["signal_features"] = signal_features
SQL["signal_features"] = duck_query(_PROBED, [*signals.stages(Duck()), scoring.burrows_stage(None)], "doc_id, " + ", ".join(f"round({n}__lo, 6) AS {k}_{n}" for k in signals.LAYERS for n in signals.LAYERS[k]))


def fitted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _labelled(spark, sf_dir)
    rows = calibrate.features(docs).join(docs.select("doc_id", "label"), "doc_id").persist()
    weights, bias = calibrate.fit(rows)
    return calibrate.apply(rows, weights, bias).select("doc_id", "label", "score")


def held_out_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _labelled(spark, sf_dir)
    rows = calibrate.features(docs).join(docs.select("doc_id", "label"), "doc_id")
    return calibrate.leave_one_out(rows)


def score_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _labelled(spark, sf_dir)
    scores = scoring.measure(docs, signals_too=False).select(F.col("probability").alias("score"), "label").persist()
    found = {f"bootstrap_{k}": float(v) for k, v in calibrate.bootstrap_auroc(scores).items()} | {f"permutation_{k}": float(v) for k, v in calibrate.permutation_test(scores).items()}
    return spark.createDataFrame(sorted(found.items()), "metric string, value double")


def rewriting_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewriting signal with contractions in place of a model's rewriting."""
    docs = _docs(spark, sf_dir)
    attack = next(a for a in perturb.ATTACKS if a.name == "neutralise_register")
    found = models.rewriting_signal(docs.withColumn("rewrites", F.array(attack.column())))
    return found.select("doc_id", "rewrite_ratio", "rewrite_logodds")


def punctuation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stylometry.punctuation(_docs(spark, sf_dir)).select("doc_id", "kind", "mark", F.round("rate", 9).alias("rate"))


_PROSE = "regexp_replace(coalesce(text, ''), '(?s)```.*?```', chr(10), 'g')"
_MARKS = f"list_filter(string_split({_PROSE}, ''), lambda c: c <> '' AND contains('.,;:!?-()' || chr(34) || chr(39), c))"
SQL["punctuation_profile"] = (
    f"WITH p AS (SELECT doc_id, greatest(length({_PROSE}), 1) AS n, {_MARKS} AS m FROM ({_PROBED})), "
    "a AS (SELECT doc_id, 'mark' AS kind, n, unnest(m) AS mark FROM p), b AS (SELECT doc_id, 'pair' AS kind, greatest(len(m) - 1, 1) AS n, m[i] || m[i + 1] AS mark FROM (SELECT doc_id, m, unnest(range(1, len(m))) AS i FROM p)) "
    "SELECT doc_id, kind, mark, round(count(*) / n, 9) AS rate FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id, kind, mark, n"
)


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of one source against another's as reference: source src0 is the author, src1 asks, the rest is background."""
    docs = documents(spark, sf_dir)
    role = F.when(F.col("source") == "src0", "reference").when(F.col("source") == "src1", "candidate").otherwise("background")
    return stylometry.verify_authorship(docs.select("doc_id", "text", role.alias("role")))


def score_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    found = scoring.measure(turns, signals_too=False)
    return found.select("conv_id", "turn", F.round("total_logodds", 6).alias("total_logodds"), F.round("probability", 6).alias("probability"), "verdict")


def spread_turns(df: DataFrame) -> DataFrame:
    return spread(df.withColumn("doc_id", F.col("conv_id"))).drop("doc_id")


SQL["score_conversations"] = duck_query("SELECT conv_id, turn, text FROM conversations", scoring.all_stages(Duck()), "conv_id, turn, round(total_logodds, 6) AS total_logodds, round(probability, 6) AS probability, verdict")

for _q in (attack_effects, hardening_corpus, robustness, distance_to_threshold, mixed_corpus, fitted_scores, held_out_scores, score_uncertainty, rewriting_distance, punctuation_profile, authorship, score_conversations):
    QUERIES[_q.__name__] = _q
