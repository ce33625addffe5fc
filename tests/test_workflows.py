"""Perturbation, synthesis, calibration, model-backed signals, sources, streams and the registered queries."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlode.operators import calibrate, models, perturb, scoring, synth, windows
from textlode.plans.dialect import Spark
from textlode.plans.probe import probed
from textlode.sources import tables
from textlode.streaming import scores as stream


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").withColumn("text", F.expr(probed(Spark()))).select("doc_id", "text").limit(42).cache()


TEXT = "We delve into the intricate realm. It is not here, and there is more. That is all.\n\n- `one` thing\n# Head\n\nFileReader UnitParser TimeSlot go. Plain words follow.\n\nLast part, it does not end."


def apply(spark, name, text, seed=0):
    attack = next(a for a in perturb.ATTACKS if a.name == name)
    return spark.createDataFrame([(text,)], "text string").select(attack.column(seed=seed)).first()[0]


def test_attacks(spark):
    assert apply(spark, "neutralise_register", "We delve into the Intricate realm;  robust") == "We look at the complex area; solid"
    assert apply(spark, "contractions", TEXT).count("'") == 4
    assert "`" not in apply(spark, "strip_markup", TEXT) and "# Head" not in apply(spark, "strip_markup", TEXT)
    assert apply(spark, "cluster_identifiers", TEXT).endswith("Plain words follow.")
    assert apply(spark, "questions", TEXT) != TEXT and apply(spark, "questions", "one paragraph") == "one paragraph"
    for a in perturb.ATTACKS:
        assert apply(spark, a.name, TEXT) == apply(spark, a.name, TEXT)
        assert apply(spark, a.name, None) is None and apply(spark, a.name, "") == ""


def test_white_space_in_plain_words():
    for space in ("  ", " \t", "\n\n", "\r\n", "\u00a0\u00a0", "\u2003 ", "\x1c\x1d"):
        assert perturb.in_plain_words(f"one{space}two three", None) == "one two three"
    assert perturb.in_plain_words("one\ntwo\u00a0three four", None) == "one\ntwo\u00a0three four"


def test_attack_measures(spark, docs):
    rows = perturb.single_effects(docs).collect()
    assert len(rows) == 9 * docs.count() and all(r["drop"] == pytest.approx(r.baseline - r.score_after) for r in rows)
    assert perturb.hardening_corpus(docs).filter("label not like 'machine_attacked_%'").count() == 0
    few = docs.limit(6)
    for r in perturb.robustness(few).collect():
        assert len(r.trajectory) == 10 and r.trajectory[0].score == r.baseline and r.final_score == r.trajectory[-1].score
        under = [t.step for t in r.trajectory if t.step and t.score < 0.5]
        assert r.attack_cost == (under[0] if under else None) and r.survived == (not under)
    for r in perturb.distance_to_threshold(few, rounds=2).collect():
        assert r.final_score <= r.original_score and len(r.steps) <= 2 and all(s.score_after < s.score_before for s in r.steps)
        assert len({s.attack for s in r.steps}) == len(r.steps)


def test_words_changed(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "a"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(perturb.words_changed("a", "b")).collect()] == [2, 1, 0]


def test_synthesis(spark):
    rows = [(" ".join(f"h{i}w{k}" for k in range(130)), 0) for i in range(8)] + [(" ".join(f"m{i}w{k}" for k in range(130)), 1) for i in range(8)]
    df = spark.createDataFrame(rows, "text string, label int")
    found = synth.corpus(df, total_words=600).collect()
    again = {r.mixed_id: r.text for r in synth.corpus(df.repartition(3), total_words=600).collect()}
    assert len(found) == 21
    for r in found:
        words = r.text.split()
        assert len(words) == r.total_words == 600 and again[r.mixed_id] == r.text
        inside = {i for s in r.machine_spans for i in range(s.start, s.end)}
        assert inside == {i for i, w in enumerate(words) if w[0] == "m"} and len(inside) == 60 * round(10 * r.ratio)
        assert r.label == ("human" if r.ratio == 0 else "ai" if r.ratio == 1 else "ai_assisted")
    with pytest.raises(ValueError):
        synth.corpus(df.filter("label = 0"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(40):
        y = i % 2
        data.append((i, float(y) + rng.gauss(0, 0.6), rng.gauss(0, 1), y))
    return spark.createDataFrame(data, "doc_id long, a double, b double, label int")


def test_fit_reaches_the_descent(spark, rows, tmp_path):
    weights, bias = calibrate.fit(rows, ["a", "b"])
    table = rows.toPandas()
    w, b = calibrate._descend(table[["a", "b"]].to_numpy(), table["label"].to_numpy(float), 20000)
    assert np.allclose([weights["a"], weights["b"], bias], [*w, b], atol=1e-3) and weights["a"] > abs(weights["b"])
    calibrate.save(weights, bias, spark, str(tmp_path / "w"))
    again, again_bias = calibrate.load(spark, str(tmp_path / "w"))
    assert again == weights and again_bias == bias
    assert calibrate.apply(rows, weights, bias).filter("score > 0 and score < 1").count() == 40
    with pytest.raises(ValueError):
        calibrate.fit(rows.limit(0), ["a"])


def test_out_of_sample(spark, rows):
    loo = calibrate.leave_one_out(rows, names=["a", "b"], epochs=300).collect()
    assert len(loo) == 40 and len({r.score for r in loo}) > 20
    table = calibrate.ablate(rows, names=["a", "b"], epochs=200).collect()
    assert table[0].signal == "a" and table[0].logloss_cost > 0 > table[1].logloss_cost - 0.05
    one = calibrate.leave_one_out(rows.limit(2), names=["a"], epochs=10).collect()
    assert {r.score for r in one} == {0.5}
    dotted = calibrate.leave_one_out(rows.withColumnsRenamed({"a": "x.a", "b": "x.b"}), names=["x.a", "x.b"], epochs=300).collect()
    assert {(r.doc_id, r.score) for r in dotted} == {(r.doc_id, r.score) for r in loo}


def test_out_of_sample_in_any_order(spark, rows):
    one, other = (calibrate.leave_one_out(r, names=["a", "b"], epochs=300).collect() for r in (rows.coalesce(1).sortWithinPartitions("a"), rows.coalesce(1).sortWithinPartitions(F.desc("b"))))
    assert {(r.doc_id, r.score) for r in one} == {(r.doc_id, r.score) for r in other}


def test_uncertainty(spark):
    df = spark.createDataFrame([(k / 10, int(k >= 5)) for k in range(10)], "score double, label int")
    boot = calibrate.bootstrap_auroc(df, 200)
    assert boot["mean"] == boot["lo95"] == boot["hi95"] == 1 and boot["usable"] > 150 and boot == calibrate.bootstrap_auroc(df.repartition(3), 200)
    test = calibrate.permutation_test(df, 400)
    assert test["observed_auroc"] == 1 and test["min_achievable_p"] == 1 / math.comb(10, 5) and 1 / 401 <= test["p_value"] < 0.05


def test_features_fill_missing_signals(spark, docs):
    found = calibrate.features(docs)
    assert found.columns == ["doc_id", *calibrate.FEATURES] and found.filter(" and ".join(f"`{c}` is not null" for c in found.columns)).count() == docs.count()


def test_models(spark):
    df = spark.createDataFrame([("a b c d", "a x c"), ("", ""), ("", "a"), ("Same words", "same words")], "a string, b string")
    assert [r[0] for r in df.select(models.edit_ratio("a", "b")).collect()] == [0.5, 0.0, 1.0, 0.0]
    text = "word other thing " * 30
    out = models.rewriting_signal(models.rewritten(spark.createDataFrame([(text,), ("short",)], "text string"), lambda t: t.replace(models.PROMPT, "")), 1).collect()
    assert out[0].rewrite_ratio == 0 and out[0].rewrite_logodds == pytest.approx(1.5) and out[1].rewrite_logodds == 0
    with pytest.raises(ValueError):
        models.rewritten(df, str, rounds=0)
    with pytest.raises(models.ModelUnavailable):
        models.perplexity_ratio(df)
    scored = models.perplexity_ratio(spark.createDataFrame([("x",)], "text string"), lambda texts: [0.8] * len(texts))
    assert scored.select(models.ratio_signal()).first()[0] == pytest.approx((models.LOW_FPR - 0.8) * 12)


def test_files_and_reports(spark, tmp_path):
    for kind, n in (("human", 60), ("machine", 70)):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "one.txt").write_text("plain words here " * n)
        (tmp_path / kind / "short.txt").write_text("too short")
    both = tables.labelled(spark, str(tmp_path / "human"), str(tmp_path / "machine"))
    assert sorted(r.label for r in both.collect()) == [0, 1]
    scored = scoring.score(both).cache()
    tables.write_reports(scored, str(tmp_path / "out"))
    values = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(values) == 2 and {"probability", "verdict", "signals", "layer_totals"} <= set(values[0]) and len(values[0]["signals"]) == 39
    assert "confidence" in tables.text_report(scored).first().report
    assert tables.over(scored, 0.0) and not tables.over(scored, 1.1)
    assert tables.read_centroids(spark, str(tmp_path / "missing.json")) is None
    (tmp_path / "c.json").write_text(json.dumps({"means": {"the": 0.05, "of": 0.02}, "sds": {"the": 0.01, "of": 0.0}, "active": ["the"], "human_centroid": {"the": 0.5}, "machine_centroid": {"the": -0.5}}))
    model, human, machine = tables.read_centroids(spark, str(tmp_path / "c.json"))
    assert model.filter("active").count() == 1 and human.first().z == 0.5 and machine.first().z == -0.5


def test_stream_scores_as_a_batch(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    scored = stream.score_stream(spark, str(tmp_path / "in"), "doc_id long, text string")
    stream.write_stream(scored, str(tmp_path / "out"), str(tmp_path / "ckpt")).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    found = {r.doc_id: r.probability for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {r.doc_id: r.probability for r in scoring.score(docs, signals_too=False).collect()}


def test_scoring_does_not_shuffle(spark, docs):
    plan = scoring.score(spark.range(3).selectExpr("id as doc_id", "'a b' as text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_fraction_and_tail(spark, docs):
    for r in windows.fraction(docs.limit(20)).collect():
        assert r.fraction_ai == pytest.approx(sum(p >= 0.5 for p in r.window_scores) / len(r.window_scores) if r.window_scores else 0)


def test_registered_queries(spark, small):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 40
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["attack_cluster_identifiers", "parse_counts", "structural_signals", "discourse_signals", "top_signals"])
def test_letters_beyond_ascii_bound_words_as_in_sql(spark, tmp_path, name):
    import duckdb

    from textlode.plans import more, registry  # noqa: F401

    plain = "in the yard we sat and spoke of many small things that had been there for years and went home late at night"
    inside = f"{plain} äFileReader éUnitParser ßTimeSlot"
    named = f"{plain} FileReader UnitParser TimeSlot file_names time_slots"
    dispersed = "\n\n".join([named, plain, inside, plain, named, inside])
    broken = "Nobody knew what they had said about chllía\nBefore that day it was all quiet.\n" * 12 + "Was it so?\n" * 3
    spark.createDataFrame([(27, dispersed), (41, broken)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    mine = sorted(str(tuple(map(str, r))) for r in got.collect())
    theirs = sorted(str(tuple(map(str, r))) for r in con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.SQL[name]})").fetchall())
    assert mine == theirs


def test_queries_against_their_sql(spark, small):
    import duckdb

    from textlode.plans import more, registry  # noqa: F401

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    for name in ("parse_counts", "score_documents", "layer_totals", "top_signals", "attribution", "window_scores", "machine_spans", "segment_scores", "function_word_profile", "burrows_delta", "attack_neutralise_register", "punctuation_profile", "confusion", "roc_points"):
        got = registry.QUERIES[name](spark, small)
        columns = sorted(got.columns)
        mine = sorted(str(tuple(map(clean, r))) for r in got.select(columns).collect())
        theirs = sorted(str(tuple(map(clean, r))) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall())
        assert mine == theirs, name


def test_registered_search_runs_the_operators_rounds(monkeypatch):
    import inspect

    from textlode.plans import more

    monkeypatch.setattr(more, "_docs", lambda spark, sf_dir: None)
    seen = {}
    known = inspect.signature(perturb.distance_to_threshold)
    monkeypatch.setattr(perturb, "distance_to_threshold", lambda *a, **k: seen.update((b := known.bind(*a, **k)).arguments) or b.apply_defaults() or seen.update(b.arguments))
    more.distance_to_threshold(None, "")
    assert seen["rounds"] == 12


def test_uncertainty_has_no_row_bound(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "MOST_ROWS", 5)
    df = spark.range(3000).selectExpr("cast(id % 40 as double) as score", "cast(id % 7 < 2 as int) as label")
    pairs = [(r.score, r.label) for r in df.collect()]
    test, boot = calibrate.permutation_test(df, 50), calibrate.bootstrap_auroc(df, 50)
    pos, neg = ([s for s, y in pairs if y == k] for k in (1, 0))
    assert test["observed_auroc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    assert test["min_achievable_p"] == 0 and boot["lo95"] < test["observed_auroc"] < boot["hi95"] and boot["usable"] == 50


def test_registered_evaluations_use_the_operators_defaults(spark, monkeypatch):
    from textlode.plans import more

    calls = {}
    df = spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, label int")
    monkeypatch.setattr(more, "_labelled", lambda spark, sf_dir: df)
    monkeypatch.setattr(calibrate, "leave_one_out", lambda rows, **k: calls.update(loo=k))
    for name in ("bootstrap_auroc", "permutation_test"):
        monkeypatch.setattr(calibrate, name, lambda *a, name=name, **k: calls.update({name: (a[1:], k)}) or {"x": 0.0})
    more.held_out_scores(spark, ""), more.score_uncertainty(spark, "")
    assert calls == {"loo": {}, "bootstrap_auroc": ((), {}), "permutation_test": ((), {})}
