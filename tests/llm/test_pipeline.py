"""The pipeline against a plain version of each stage."""

import re
from collections import Counter, defaultdict

import regex

import corpus_pipeline
from tests.llm.test_operators import plain_components, plain_fingerprint, plain_removals
from textlode.llm import language, mixing, packing


def plain_mix(spark, rows):
    """(row, copies): whole copies, then the head of the order by draw, cut nearest to the target."""
    sizes = {r["doc_id"]: len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w]) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    total = [(s, sum(sizes[r["doc_id"]] for r in v)) for s, v in by.items()]
    goal = {r.source: r.target for r in mixing.targets(spark.createDataFrame(total, "source string, source_size long")).collect()}
    draws = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").select("doc_id", mixing.mark().alias("mark")).withColumn("u", mixing.draw(7, "doc_id", "mark"))
    u = {r.doc_id: r.u for r in draws.collect()}
    out = Counter()
    for source, size in total:
        whole = int(goal[source] / size + 1e-12) if size else 0
        left, to = goal[source] - whole * size, 0
        for r in sorted(by[source], key=lambda r: u[r["doc_id"]]):
            n = sizes[r["doc_id"]]
            inside = left > 0 and to + n / 2 <= left
            out[r["doc_id"]] = whole + inside
            to += n
    return out


def test_stages(spark, small):
    given = spark.read.parquet(f"{small}/documents.parquet")
    columns = given.columns
    rows = [r.asDict() for r in given.collect()]
    frame = lambda rows: spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], given.schema)
    dictionaries = language.learn(given)
    (compressors, thorough), letter = (language._compressors(dictionaries, n) for n in (6, 12)), regex.compile(r"\p{L}").search
    stages = dict(corpus_pipeline.STAGES)

    expected = [r for r in rows if not language.judge(r["text"], compressors, thorough, dictionaries, letter, 1e-4)[2]]
    found = stages["language"](spark, given, small)
    key = lambda rows: Counter(tuple(r[c] for c in columns) for r in rows)
    assert found.columns == columns and key(found.collect()) == key(expected) and len(expected) > 0.98 * len(rows)

    gone, kept = plain_removals([(r["doc_id"], r["text"]) for r in expected]), []
    for r in expected:
        lines = r["text"].split("\n")
        left = [x for k, x in enumerate(lines) if (r["doc_id"], k) not in gone]
        if len(left) == len(lines) or any(len(set(x.encode().lower().split())) >= 5 for x in left):
            kept.append(r if len(left) == len(lines) else r | {"text": "\n".join(left), "n_chars": len("\n".join(left))})
    found = stages["lines"](spark, frame(expected), small)
    assert found.columns == columns and key(found.collect()) == key(kept) and len(kept) < len(expected)

    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in kept}
    root = plain_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    first = [r for r in kept if root[r["doc_id"]] == r["doc_id"]]
    found = stages["near_duplicates"](spark, frame(kept), small)
    assert found.columns == columns and key(found.collect()) == key(first)

    copies = plain_mix(spark, first)
    mixed = [r for r in first for _ in range(copies[r["doc_id"]])]
    found = stages["mix"](spark, frame(first), small)
    assert found.columns == columns and key(found.collect()) == key(mixed)

    whole = corpus_pipeline.run(spark, small).collect()
    pieces = packing.cut_pieces(frame(mixed), ids=False).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == Counter(map(tuple, pieces))
    bins = defaultdict(list)
    for r in whole:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_stages_take_odd_tables(spark, small):
    from tests.llm.test_operators import frame, odd_rows

    for rows in ([], odd_rows()):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, small)
            assert name == "pack" or found.columns == docs.columns
            found.count()


def test_near_copies_of_five_word_similarity_go(spark, small):
    """Against all pairs; fingerprints of many of them differ in more than 2 bits."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    given = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in given.collect()}
    base = [f"w{i}" for i in range(60)]
    made = [" ".join(base), " ".join(base[:30] + ["x"] + base[31:]), " ".join(base[:58]), "a b c d", "A b  c d", "a b c d e", "", None]
    texts |= {10**6 + i: t for i, t in enumerate(made)}
    sets = {i: shingles(t) for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert any((prints[a] ^ prints[b]).bit_count() > 2 for a, b in pairs)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, small)
    assert sorted(r.doc_id for r in found.collect()) == sorted(set(texts) - {b for _, b in pairs})


def test_texts_that_bitmaps_rule_out_are_not_read_again(spark, monkeypatch):
    """2 and 3 are half alike, in their rarest runs too: a candidate whose words need no shuffle."""
    from textlode.llm import line_dedup

    rows, write = {}, line_dedup.cut

    def noted(df, name="cut"):
        found = write(df, name)
        rows.setdefault(name, []).append((found.distinct().count(), dict(found.dtypes)))
        return found

    monkeypatch.setattr(line_dedup, "cut", noted)
    p, q, r = (" ".join(f"{x}{i}" for i in range(400)) for x in "pqr")
    docs = spark.createDataFrame([(1, f"{p} {q}"), (2, f"{p} {r}"), (3, f"{q} {r}"), (4, f"{p} {q} y")], "doc_id long, text string")
    assert sorted(r.doc_id for r in line_dedup.without_copies(docs).collect()) == [1, 2, 3]
    assert rows["candidates"][0][0] == 2 and [n for n, _ in rows["whole"]] == [2] and rows["whole"][0][1]["words"] == "binary"
    assert "prefix" not in rows["keys"][0][1]


def test_wide_bitmaps_differ_in_no_more_bits_than_sets_in_words():
    import numpy as np

    from textlode.llm import line_dedup

    rng = np.random.default_rng(3)
    for n, m, same in ((300, 300, 0), (300, 1100, 250), (5000, 5200, 4900), (400, 400, 400)):
        h = rng.integers(0, 1 << 44, n + m - same, dtype=np.uint64)
        a, b = h[:n], h[n - same :]
        apart = line_dedup._wide_apart(line_dedup._wide_bitmap(a), line_dedup._wide_bitmap(b))
        assert apart <= n + m - 2 * same and (same or apart > 100)


def test_tables_of_counts_are_scattered_in_few_bytes(spark):
    import numpy as np

    from textlode.llm import line_dedup

    table = np.random.default_rng(5).poisson(0.3, 1 << 16).astype(np.uint32)
    table[:3] = 0, 70000, 1 << 31
    batch = line_dedup._scattered(table)
    assert sum(len(x) for x in batch.column(1).to_pylist()) == len(table) // 8
    parts = spark.createDataFrame([tuple(r.values()) for r in batch.to_pylist()] * 2, line_dedup._SPARSE)
    found = line_dedup._gathered(parts, len(table), np.uint32, np.maximum, lambda t: t)
    assert (found == table).all()
