"""Signals against plain versions and hand-made cases, the scoring contract, windows, stylometry and metrics."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import plain
from textlode.functions import lexicon as lx
from textlode.operators import metrics, reading, scoring, signals, stylometry, windows
from textlode.plans.dialect import Spark, spark_frame
from textlode.plans.probe import SUFFIXES, probed

FILLER = "the garden was quiet and the people walked slowly along a river that nobody had named "


def texts(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")


def signal(spark, layer, name, items):
    """(log-odds, detail) of one signal for each text."""
    found = spark_frame(texts(spark, items), signals.stages(Spark(), [layer])).select("doc_id", f"{name}__lo", f"{name}__d").collect()
    return [(r[1], r[2]) for r in sorted(found)]


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").withColumn("text", F.expr(probed(Spark()))).select("doc_id", "text").cache()


def test_sentences(spark, docs):
    cases = ["Dr. Smith met J. R. Brown at approx. 3. It rained.", "a\n\nb", "Title\nThe text goes on here\nAnd ends", "one two three,\nFour five", "He said \"no.\" Then he left!  Why?", "no.\nYes it is", "", "x", "etc. and so on… Then\n- item one two\n- item two three", *SUFFIXES]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, c) for i, c in enumerate(cases)]
    found = spark_frame(spark.createDataFrame(rows, "doc_id long, text string"), signals.parse(Spark())).select("doc_id", "prose", "sentences").collect()
    assert {r.doc_id: r.sentences for r in found} == {r.doc_id: plain.sentences(r.prose) for r in found}


def test_words_are_ascii_and_code_is_cut(spark):
    found = spark_frame(texts(spark, ["né well-known don’t 3x", "a ```code here``` b", None, "p\n \n\nq"]), signals.parse(Spark())).select("doc_id", "words", "paras").collect()
    by = {r.doc_id: r for r in found}
    assert by[0].words == ["n", "well-known", "don’t", "x"] and by[1].words == ["a", "b"] and by[2].words == [] and by[3].paras == ["p", "q"]


@pytest.mark.parametrize("text,n", [("ugh", 1), ("throughput is thoughtful", 0), ("edit: yes", 1), ("Whatever. ", 1), ("whatever remains", 0), ("so it goes. Right, then", 1), ("or whatever works", 1), ("MY BOSS", 1)])
def test_human_markers_bind_at_words(spark, text, n):
    assert signal(spark, "lexical", "human_markers", [text])[0][1] == n


def test_tiers(spark):
    (lo, detail), (leak, hits) = signal(spark, "lexical", "tier1_register", ["delve delved Delves " + "x " * 97])[0], signal(spark, "lexical", "tier4_assistant_leakage", ["Certainly! As an AI language model, I"])[0]
    assert detail == 2 and lo == pytest.approx(plain.sat((2 + 20) / 2, 2.5, 2.2))
    assert hits == 2 and leak == pytest.approx(plain.sat(2, 1.0, 3.2))


def test_forensics(spark):
    assert signal(spark, "forensics", "invisible_chars", ["a​b​", "﻿a"]) == [(pytest.approx(plain.sat(2, 1, 1.8)), 2), (0, 0)]
    assert signal(spark, "forensics", "exotic_spaces", ["a b"])[0] == (pytest.approx(plain.sat(1, 2, 1.2) + 0.8), 1)
    assert signal(spark, "forensics", "smart_quotes", ["“a” 'b", "“a”", "'a'"]) == [(pytest.approx((0.4 + 0.9 * 0.5) * plain.sat(1, 5, 1)), 2), (pytest.approx(plain.sat(2, 4, 0.9)), 2), (0, 0)]
    lo, d = signal(spark, "forensics", "markdown_density", ["# a\n- b\n1. c\n**bold**"])[0]
    assert d == pytest.approx(4 * 100 / 4) and lo == pytest.approx(plain.sat(100, 6, 1) + 0.45)
    clean, slip = signal(spark, "forensics", "typo_absence", [(FILLER * 30).strip(), FILLER * 30 + "teh"])
    assert clean == (pytest.approx(0.2 + 0.7 * min((16 * 30 - 300) / 900, 1)), 0) and slip[0] < 0


def test_gates(spark):
    short, long = FILLER * 9 + "a " * 5, FILLER * 9 + "a " * 6  # 149 and 150 words
    assert signal(spark, "syntax", "template_repetition", [short])[0] == (0, 0) and signal(spark, "syntax", "template_repetition", [long])[0][1] > 0
    assert signal(spark, "stance", "authorial_absence", ["word " * 179, "word " * 180])[0][0] == 0
    assert signal(spark, "stance", "authorial_absence", ["word " * 180])[0][0] == pytest.approx(0.5)


def test_statistics(spark):
    rng = random.Random(1)
    items = [". ".join(" ".join("abc" for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 40))) + "." for _ in range(20)]
    for text, (lo, d) in zip(items, signal(spark, "statistical", "burstiness", items), strict=True):
        lengths = [n for n in (len(plain.WORD.findall(s)) for s in plain.sentences(text)) if n]
        if len(lengths) < 6:
            assert (lo, d) == (0, 0)
            continue
        cv = plain.spread(lengths) / (sum(lengths) / len(lengths))
        assert d == pytest.approx(cv) and lo == pytest.approx(max(-2, min(2, (0.52 - cv) * 5)) * min(len(lengths) / 25, 1))
    words = [[rng.choice("abcdefg") for _ in range(n)] for n in (119, 120, 300)]
    for w, (_, d) in zip(words, signal(spark, "statistical", "ngram_repetition", [" ".join(x) for x in words]), strict=True):
        grams = Counter(zip(*(w[i:] for i in range(4)), strict=False))
        assert d == pytest.approx(sum(c for c in grams.values() if c > 1) / (len(w) - 3) if len(w) >= 120 else 0)
    for w, (_, d) in zip(words, signal(spark, "statistical", "lexical_diversity", [" ".join(x) for x in words]), strict=True):
        ratios = [len(set(w[i : i + 50])) / 50 for i in range(0, len(w) - 49, 10)]
        assert d == pytest.approx(sum(ratios) / len(ratios))


def test_template_share_is_invariant_to_vocabulary(spark):
    rng = random.Random(2)
    nouns = [f"{a}{b}" for a in "bcdfgl" for b in ("ar", "on", "ist", "ump", "able")]
    fixed = " ".join(f"the {rng.choice(nouns)} of the {rng.choice(nouns)} was in the {rng.choice(nouns)}" for _ in range(40))
    free = " ".join(rng.choice([rng.choice(nouns), *"the of in was is it by at on for and or if so do".split(), "Name", "NOT"]) for _ in range(400))
    a, b = signal(spark, "syntax", "template_repetition", [fixed, free])
    assert a[1] > 80 > 30 > b[1]


def test_code_gate_and_signals(spark):
    code = SUFFIXES[11]
    found = {n: signal(spark, "code", n, [code, FILLER * 5]) for n in signals.LAYERS["code"]}
    assert all(v[1] == (0, 0) for v in found.values())
    assert found["appended_demo"][0][0] == 0.35 and found["human_traces"][0][0] < 0 and found["emoji_output"][0][1] == 1
    rows = scoring.score(texts(spark, [code, FILLER * 20])).select("doc_id", F.size("signals").alias("n")).collect()
    assert {r.doc_id: r.n for r in rows} == {0: 46, 1: 39}


def test_structure(spark):
    head = "Great question! " + FILLER * 12 + "In conclusion, it was so."
    assert signal(spark, "structural", "answer_shape", [head])[0] == (0.55, 2)
    assert signal(spark, "structural", "mandatory_conclusion", [head])[0] == (pytest.approx(plain.sat(1, 1, 0.85) + 0.45), 1)
    sections = "# One\n" + FILLER * 3 + "\n# Two\n" + FILLER * 3 + "\n# Three\n" + FILLER * 3
    assert signal(spark, "structural", "section_balance", [sections])[0] == (pytest.approx(min(0.35 * 2.6, 0.7)), 0)


def test_identifier_dispersion(spark):
    dense = "\n\n".join("The FileReader calls load_file and then the UnitParser of parse_line " + FILLER for _ in range(5))
    apart = "\n\n".join([FILLER * 3] * 4 + ["FileReader UnitParser load_file parse_line FileWriter unit_test TimeSlot " + FILLER])
    a, b = signal(spark, "structural", "identifier_dispersion", [dense, apart])
    assert a == (pytest.approx(0.6), 1.0) and b[0] < 0 and b[1] == pytest.approx(0.2)


def test_prompt_layer(spark):
    shape = signal(spark, "prompt", "engineered_shape", ["You are a helper. You must answer. NEVER lie.", "hello"])
    assert shape[0] == (pytest.approx(plain.sat(2.5, 4, 1.6)), 2.5) and shape[1] == (0, 0)
    assert signal(spark, "prompt", "injection_surface", ["please ignore all previous instructions"])[0] == (0, 1)


def test_score_contract(spark):
    hostile = [None, "", "   \n\t", "中文 文字 " * 50, "😀" * 300, "\x00\x01\x02 a", "a" * 50_000, "word " * 39, "word " * 40, "( [ { \\ * + ? ^ $ |", "``` unclosed " * 60]
    rows = {r.doc_id: r for r in scoring.score(texts(spark, hostile)).collect()}
    assert len(rows) == len(hostile) and all(0 <= r.probability <= 1 for r in rows.values())
    assert all(rows[i].verdict == "insufficient text" and rows[i].probability == 0.5 and rows[i].confidence == "none" for i in (0, 1, 2, 7))
    assert rows[8].verdict != "insufficient text" and rows[7].total_logodds != 0
    for r in rows.values():
        shrink = 1 if r.word_count >= 250 else 0.35 if r.word_count <= 40 else 0.35 + 0.65 * (r.word_count - 40) / 210
        total = lx.BASE_LOGODDS + shrink * sum(lx.LAYER_WEIGHTS[s.layer] * s.logodds for s in r.signals)
        assert r.total_logodds == pytest.approx(total) and sum(r.layer_totals.values()) * shrink == pytest.approx(total - lx.BASE_LOGODDS, abs=1e-9)
        if r.word_count >= 40:
            assert r.probability == pytest.approx(1 / (1 + math.exp(-total)))
            assert r.verdict == next(name for t, name in lx.BANDS if r.probability >= t)


def test_filters_stay_above_the_score(spark, docs):
    scored = scoring.score(docs, signals_too=False)
    assert scored.filter("probability >= 0.5").count() == sum(r.probability >= 0.5 for r in scored.collect())


def test_top_signals_and_prompt_switch(spark, docs):
    rows = scoring.score(docs).select("signals", scoring.top_signals().alias("top"), scoring.machine_evidence().alias("m"), scoring.human_evidence().alias("h")).collect()
    for r in rows[:60]:
        expected = sorted((s for s in r.signals if abs(s.logodds) > 0.01), key=lambda s: -abs(s.logodds))
        assert r.top == expected and r.m == [s for s in expected if s.logodds > 0] and r.h == [s for s in expected if s.logodds < 0]
    without = scoring.score(docs, prompt_layer=False).select(F.explode_outer("signals").alias("s")).select("s.layer").distinct().collect()
    assert "prompt" not in {r.layer for r in without}


def test_attribution(spark):
    rows = scoring.attribute(texts(spark, ["Certainly! I hope this helps! Great question!", "To be fair, that said, To be fair, yes", "nothing"])).collect()
    by = {r.doc_id: [(a.model, a.score) for a in r.attribution] for r in rows}
    assert by[0][0] == ("ChatGPT", 3.0) and by[1][0][0] == "Claude" and by[2] == []


def test_windows(spark):
    items = ["w " * n for n in (39, 40, 249, 250, 251, 374, 375, 376, 1000)]
    found = Counter()
    for r in windows.windows(texts(spark, items), 250, 125, tail=False).select("doc_id", "start", "end").collect():
        found[r.doc_id] += 1
        n = len(items[r.doc_id].split())
        assert r.start % 125 == 0 and r.end == min(r.start + 250, n)
    assert [found[i] for i in range(len(items))] == [0, 1, 1, 1, 1, 1, 2, 2, 7]
    tails = {r.doc_id: (r.s, r.e) for r in windows.windows(texts(spark, items), 200, 50, tail=True).groupBy("doc_id").agg(F.max("start").alias("s"), F.max("end").alias("e")).collect()}
    assert tails[5] == (174, 374) and tails[1] == (0, 40) and tails[3] == (50, 250)


def test_triage_spans(spark, docs):
    for r in windows.triage(docs.limit(80)).collect():
        acc = [[0.0, 0] for _ in range(r.word_count)]
        for w in r.windows:
            for i in range(w.start, w.end):
                acc[i][0] += w.probability
                acc[i][1] += 1
        hot = [n > 0 and p / n >= 0.5 for p, n in acc]
        spans, start = [], None
        for i, h in enumerate([*hot, False]):
            if h and start is None:
                start = i
            elif not h and start is not None:
                spans.append((start, i))
                start = None
        assert [(s.start, s.end) for s in r.machine_spans] == spans
        share = sum(w.probability >= 0.5 for w in r.windows) / len(r.windows) if r.windows else 0
        assert r.prediction == ("human" if share <= 0.02 else "ai" if share >= 0.9 else "ai_assisted") and r.fraction_ai + r.fraction_assisted == pytest.approx(share)


def test_spans_and_labels(spark):
    df = spark.createDataFrame([([(5, 9), (0, 3), (3, 4), (20, 22)], 10, "a b c d e f g h")], "s array<struct<start:int,end:int>>, n int, text string")
    r = df.select(windows.merged("s").alias("m"), windows.word_labels("s", "n").alias("l"), windows.excerpts("text", "s", 2).alias("x")).first()
    assert [tuple(x) for x in r.m] == [(0, 4), (5, 9), (20, 22)] and r.l == [1, 1, 1, 1, 0, 1, 1, 1, 1, 0] and r.x == ["f g h ...", "a b c ..."]
    m = windows.span_metrics(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "t int, p int"), "t", "p").first()
    assert (m.precision, m.recall, m.f1, m.iou, m.accuracy) == (0.5, 0.5, 0.5, pytest.approx(1 / 3), 0.5)
    none = windows.span_metrics(spark.createDataFrame([(0, 0)], "t int, p int"), "t", "p").first()
    assert math.isnan(none.precision) and math.isnan(none.f1) and none.accuracy == 1


def test_segments(spark):
    text = "\n\n".join([FILLER * 3] * 7 + ["short"])
    rows = sorted((r.seg_no, r.chunk) for r in windows.segments(texts(spark, [text, "a\n\nb", ""])).collect())
    assert [n for n, _ in rows] == [0, 1, 2, 3, 4, 5] and rows[5][1].endswith("short")


def test_delta_is_symmetric_and_zero_to_itself(spark, docs):
    p = stylometry.profile(docs).cache()
    model = stylometry.fit(p, docs.count()).cache()
    pairs = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (3, 4), (4, 3)], "a long, b long")
    d = {(r.a, r.b): r.delta for r in stylometry.delta(p, model, pairs).collect()}
    assert d[0, 1] == pytest.approx(d[1, 0]) and d[2, 2] == pytest.approx(0) and d[3, 4] == pytest.approx(d[4, 3]) and d[0, 1] > 0
    with pytest.raises(ValueError):
        stylometry.fit(p, 0)


def test_verification(spark):
    mine, other = "the the of of and and to to in in a a is is ", "i you we my me us it that this be was not have had "
    rows = [(i, mine * 30 + "word " * i, "reference") for i in range(4)] + [(10 + i, other * 30 + "word " * i, "background") for i in range(6)] + [(99, mine * 31, "candidate")]
    df = spark.createDataFrame(rows, "doc_id long, text string, role string")
    r = stylometry.verify_authorship(df).first()
    assert r.percentile_among_others == 0 and r.consistent_with_author and r.delta_to_author < r.background_mean
    alone = stylometry.verify_authorship(df.filter("role <> 'background'")).first()
    assert math.isnan(alone.percentile_among_others) and alone.consistent_with_author is None
    with pytest.raises(ValueError):
        stylometry.verify_authorship(df.filter("role <> 'reference'"))


def pairs(spark, items):
    return spark.createDataFrame(items, "score double, label int")


def test_metrics_by_hand(spark):
    scores = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.2, 0), (0.5, 1)]
    df = pairs(spark, scores)
    wins = sum(1.0 if a > b else 0.5 if a == b else 0 for a, x in scores if x for b, y in scores if not y)
    assert metrics.auroc(df).first()[0] == pytest.approx(wins / 9)
    assert math.isnan(metrics.auroc(pairs(spark, [(0.5, 1)])).first()[0])
    points = sorted((r.threshold, r.fpr, r.tpr) for r in metrics.roc_points(df).collect())
    assert points[-1] == (math.inf, 0, 0) and points[0] == (0.2, 1, 1) and (0.7, pytest.approx(2 / 3), pytest.approx(2 / 3)) in points
    assert metrics.fpr_at_tpr(metrics.roc_points(df), 1.0).first()[0] == pytest.approx(2 / 3)
    assert tuple(metrics.tpr_at_fpr(metrics.roc_points(df), 0.0).first()) == (pytest.approx(1 / 3), 0.9)
    c = metrics.confusion(df, 0.7).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (2, 2, 1, 1) and c.accuracy == 0.5
    loss = metrics.losses(df).first()
    assert loss.brier == pytest.approx(sum((s - y) ** 2 for s, y in scores) / 6) and loss.margin == pytest.approx(0.5 - 0.8)
    assert loss.log_loss == pytest.approx(-sum(math.log(s if y else 1 - s) for s, y in scores) / 6)
    assert metrics.ece(pairs(spark, [(1.0, 1), (0.95, 0), (0.05, 0)])).first()[0] == pytest.approx((2 * abs(0.975 - 0.5) + 0.05) / 3)
    assert metrics.auroc(pairs(spark, [(0.5, 1), (0.5, 0)])).first()[0] == 0.5


def test_running_sums(spark):
    rng = random.Random(3)
    values = sorted({rng.random() for _ in range(300)})
    df = spark.createDataFrame([(v, 1) for v in values], "v double, c int").repartition(5)
    assert sorted((r.v, r.before_c) for r in metrics.running(df, ["v"], ["c"]).collect()) == [(v, i) for i, v in enumerate(values)]


def test_a_changed_text_is_read_where_it_changed():
    text = "\n".join(f"Part {k} was long, wide, and tall. It isn't  the FileName of my_file {k}, dont say i think so. Sure, \nfine ... " for k in range(40))
    first = reading.Reading(text)
    known = len(reading._PIECES)
    second = reading.Reading(text.replace("Part 7 was", "Part 7 is"))
    assert first.wc == second.wc == len(re.findall(reading.WORD, text)) and len(reading._PIECES) == known + 1
    words = [w.lower() for w in re.findall(reading.WORD, text)]
    grams = Counter(zip(words, words[1:], words[2:], words[3:]))
    found = reading.statistical(first)
    assert found[3][1] == sum(c for c in grams.values() if c > 1) / (len(words) - 3)
    assert found[2][1] == reading._mean([len(set(words[k : k + 50])) / 50 for k in range(0, len(words) - 49, 10)])
    assert reading.forensics(first)[6][1] == first.per_1k(sum(p.count(first, text) for p in reading._IRREGULAR))
    assert first.named == 80 and reading.lexical(first)[5][1] == first.per_1k(len(reading._TRIAD(first.low)))
    assert reading.stance(first)[1][1] == first.per_1k(max(Counter(w for w in words if len(w) > 3).values()))


def test_counts_by_piece_are_those_of_the_text():
    rng = random.Random(4)
    lines = [x for s in SUFFIXES for x in s.split("\n")]
    for k in range(60):
        text = "\n".join(rng.choices(lines, k=25)) + " it's\n own your\tcode. i went,\nand went... bold, brave,  and clear!! " * (k % 3)
        r = reading.Reading(text)
        for kind in (*reading._TIERS.values(), reading._TRANSITIONS, reading._HEDGES, reading._CASUAL, reading._PERSON):
            assert r.found[kind] == kind.count(r)
        for kind in (reading._META, reading._NEEDED, reading._PROMPT):
            assert r.found[kind] == kind.count(r, r.low)
        assert r.found[reading._CONTRACTED] == len(reading._CONTRACTED.compiled.findall(r.low)) and r.found[reading._SHOUTED] == len(reading._SHOUTED.compiled.findall(r.prose))
        if r.prose is text:
            found = reading.forensics(r)
            assert found[5][1] == sum(len(p.compiled.findall(text)) for p in reading._MARKDOWN) * 100 / r.per
            assert r.wc < 300 or found[6][1] == r.per_1k(sum(len(p.compiled.findall(text)) for p in reading._IRREGULAR))
        words = [w.lower() for w in re.findall(reading.WORD, r.prose)]
        before, rank = reading._ranked(r.table[0])
        assert [(b, words[b]) if b >= 0 else None for b in before] == [next(((j, w) for j in range(i - 1, -1, -1) if words[j] == w), None) for i, w in enumerate(words)]
        assert len(set(zip(rank.tolist(), words, strict=True))) == len(set(words))
        for width, step in ((50, 10), (196, 100)):
            if len(words) >= width:
                assert reading._different(before, width, step) == [len(set(words[i : i + width])) for i in range(0, len(words) - width + 1, step)]


def test_a_changed_text_is_counted_where_it_changed(monkeypatch):
    text = "\n".join(f"Part {k} was not just long, wide, and tall, but I think it's moreover fine. You must say so in part {k}; perhaps we delve." for k in range(40))
    reading.probability(text)
    seen = []
    monkeypatch.setattr(reading, "_LOCAL", {k: (lambda x, *a, f=f: seen.append(x) or f(x, *a)) for k, f in reading._LOCAL.items()})
    again = reading.probability(text.replace("Part 7 was", "Part 7 is"))
    assert {x.text for x in seen} == {text.split("\n")[7].replace("was", "is").split(". ")[0] + ". "} and 0 < again < 1


def test_words_of_one_text_keep_their_numbers(monkeypatch):
    reading._PIECES.clear()
    monkeypatch.setattr(reading._PIECES, "known", reading._Words())
    first = reading.Reading("one two one three")
    reading._PIECES.clear()
    reading._PIECES.known = reading._Words()
    second = reading.Reading("three two two four")
    assert second.ranked[1].tolist() == [0, 1, 1, 2] and first.ranked[1].tolist() == [0, 1, 0, 2]


def test_words_of_a_known_piece_are_not_counted_again(monkeypatch):
    r = reading.Reading("Oak trees grew there. Elm trees, ash trees, did not. \nThe end came")
    monkeypatch.setattr(reading, "_WORDS", None)
    assert [reading._n_words(x) for x in ("Oak trees grew there.", "Elm trees, ash trees, did not.", "The end came")] == [4, 6, 3] and r.wc == 13
