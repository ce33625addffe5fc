"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textlode.llm import components, exact_dedup, html_text, language, line_dedup, line_frequency, mixing, packing, quality, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, u double, kept boolean, line int, fp long, words string"
LONG = " ".join(f"word{i % 977} w{i}" for i in range(30_000))


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 0.5, True, 3, 4, "x") for r in rows], SCHEMA)


def odd_rows():
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one", "en", "a"), (4, "two words\there", "en", None), (None, "no id at all here now", "en", "b"), (6, LONG, "en", "b")]
    rows += [(7, "same text of some five words\nand more", "en", "a")] * 2 + [(8, "same text of some five words\nand more", "en", "a"), (9, "same  text of some five\x0bwords and more", "fr", "a")]
    rows += [(10, "\n\n \t\n", "en", "c"), (11, "é ß ñ 中文 😀", "de", "c"), (12, "12 34 !!", "de", "c")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("crowd", [0, 2, 64])
def test_simhash_links(spark, crowd):
    rng = random.Random(crowd)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:12]:  # chains and clusters around some of them
        for _ in range(12):
            v ^= 1 << rng.randrange(64)
            values.add(v)
            values.add(v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    values = sorted(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {(r.u, r.v) for r in simhash.links(fps, crowd).collect()}
    near = [(signed(a), signed(b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)
    nodes = [signed(v) for v in values]
    assert plain_components(nodes, found) == plain_components(nodes, near)
    roots = {r.node: r.root for r in components.components(simhash.links(fps, crowd)).collect()}
    assert {n: roots.get(n, n) for n in nodes} == plain_components(nodes, near)


def test_simhash_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = plain_components(prints, near)
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: (prints[i], expected[i]) for i in prints}
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == sorted(i for i in prints if expected[i] == i)


def test_simhash_edges(spark, odd, empty):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert by[1].fp == by[2].fp == by[10].fp == 0 and by[10].component_id == 1
    assert by[8].component_id == 7 and by[9].component_id == 7
    assert by[6].fp & (1 << 64) - 1 == plain_fingerprint(LONG)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    assert simhash.keep_first(odd).columns == odd.columns


def test_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    for bits in (8, 20, 56, 64):
        high = (1 << bits) - 1
        parts = [rng.integers(0, high, n, dtype=np.uint64, endpoint=True) % np.uint64(max(2, high // 3)) for n in (0, 1, 7, 300)]
        filters = [exact_dedup.CountingQuotientFilter.of(p, bits) for p in parts]
        filters = [exact_dedup.CountingQuotientFilter.from_bytes(f.to_bytes()) for f in filters]
        values, counts = exact_dedup.merge_all(filters).items()
        expected = Counter(np.concatenate(parts).tolist())
        assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == expected and (np.diff(values.astype(object)) > 0).all()


@pytest.mark.parametrize("blocks,broadcast", [(1, 10**6), (16, 0)])
def test_exact_duplicates(spark, odd, empty, docs, blocks, broadcast):
    for df in (odd, docs, empty):
        groups = defaultdict(list)
        rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in df.collect()]
        for i, t in rows:
            groups[t].append(i)
        first = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
        expected = Counter((i, first[t], len(groups[t]), first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        assert Counter(map(tuple, exact_dedup.exact_duplicates(df, blocks, broadcast).collect())) == expected


def test_pieces_are_the_tokenizers_ids(spark, odd, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    marked = frame(spark, [(50, "before <|endoftext|> after", "en", "a"), (51, "  spaces\n\n\nand 12345 'll don't", "en", "a")])
    for df in (odd, marked, docs.limit(40)):
        parts = defaultdict(list)
        for r in packing.cut_pieces(df, 128).collect():
            parts[r.doc_id, r.piece].append(r)
            assert len(r.ids) == r.length <= 128 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        for row in df.collect():
            ids = plain.encode(row.text or "", add_special_tokens=False).ids + [0]
            found = [i for (d, _), p in sorted(((k, p) for k, p in parts.items() if k[0] == row.doc_id), key=lambda x: x[0][1]) for i in p[0].ids]
            assert found == ids
            lengths = [parts[row.doc_id, k][0].length for k in range(-(-len(ids) // 128))]
            assert all(n == 128 for n in lengths[1:])


def test_packing(spark, odd, empty, docs):
    for df, capacity in ((docs, 512), (odd, 64), (empty, 64)):
        found = packing.pack(df, capacity, ids=False).collect()
        bins = defaultdict(list)
        for r in found:
            bins[r.sequence_id].append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert Counter((r.doc_id, r.piece) for r in found) == Counter((r.doc_id, r.piece) for r in packing.cut_pieces(df, capacity, ids=False).collect())
        if found:
            least = -(-sum(r.length for r in found) // capacity)
            assert len(bins) <= max(least + 1, 1.02 * least)


def test_plan_pairs_large_items():
    rng = random.Random(5)
    for _ in range(100):
        capacity = rng.choice([10, 37, 100])
        histogram = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 25))}
        bins = defaultdict(list)
        for n, rows in packing.plan(histogram, capacity).items():
            for rank in range(histogram[n]):
                row = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1]
                bins[row[1] + (rank - row[0]) // row[2]].append((row[3] + (rank - row[0]) % row[2] * n, n))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= capacity
            assert sum(3 * n > capacity for _, n in parts) <= 2
        # first fit in falling order is hardly ever better
        fit = []
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            i = next((i for i, room in enumerate(fit) if room >= n), None)
            if i is None:
                fit.append(capacity)
                i = -1
            fit[i] -= n
        assert len(bins) <= len(fit) + 2


def test_mixing_targets(spark):
    rng = random.Random(2)
    for _ in range(6):
        sizes = [(f"s{i}", rng.choice([0, 1, 50, 5000, 100_000])) for i in range(rng.randint(1, 9))] + [(None, 70)]
        found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        weights = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
        total = sum(n for _, n in sizes)
        goal, full = {}, set()
        while True:  # as the contract says: share, stop at the cap, share the excess again
            left = total - sum(3 * n for s, n in sizes if s in full)
            open_weight = sum(weights[s] for s, _ in sizes if s not in full) or 1
            goal = {s: 3.0 * n if s in full else left * weights[s] / open_weight for s, n in sizes}
            more = {s for s, n in sizes if s not in full and goal[s] > 3 * n}
            if not more:
                break
            full |= more
        assert found == pytest.approx(goal)


def test_mixing(spark, odd, empty, docs):
    for df in (odd, docs):
        found = mixing.mix(df).collect()
        assert Counter(map(str, found)) == Counter(map(str, mixing.mix(df.repartition(3), bins=4096).collect()))
        sizes = Counter((r.doc_id, len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w])) for r in df.collect())
        assert Counter((r.doc_id, r.size) for r in found) == sizes
        assert all(0 <= r.copies <= 3 for r in found)
    by = defaultdict(list)
    for r in mixing.mix(docs).collect():
        by[r.source].append(r)
    for rows in by.values():
        taken = sum(r.copies * r.size for r in rows)
        assert abs(taken - rows[0].target) <= max(r.size for r in rows)
        assert rows[0].source_size == sum(r.size for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    copies = Counter({(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect() if r.copies})
    assert Counter((r.doc_id, r.source) for r in mixing.apply_mix(docs).collect()) == copies
    assert mixing.apply_mix(odd).columns == odd.columns


def test_mixing_against_sql(spark, odd, docs, small):
    import duckdb

    for df in (odd, docs):
        documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841
        mine = mixing.mix(df).selectExpr("doc_id", "size", "source_size", "target", "copies * size as taken").collect()
        key = lambda rows: sorted(str((None if r[0] is None or r[0] != r[0] else int(r[0]), r[1], r[2], round(r[3], 6), r[4])) for r in rows)
        assert key(mine) == key(duckdb.sql(mixing.SQL).fetchall())


@pytest.mark.parametrize("bins", [1, 64])
def test_mixing_does_not_depend_on_bins(docs, bins):
    key = lambda df: {(r.doc_id, r.copies) for r in df.collect()}
    assert key(mixing.mix(docs, bins=bins)) == key(mixing.mix(docs))


def test_sharding(spark, odd, empty, docs):
    groups = frame(spark, [(i, f"text {i % 7 if i < 60 else i}", "en", "a") for i in range(400)] + [(1000 + i, "hot", "en", "a") for i in range(200)])
    for df, shards in ((docs, 8), (odd, 3), (odd, 40), (groups, 12)):
        found = sharding.shard(df, shards).collect()
        counts = Counter(r.shard for r in found)
        assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1 and set(counts) <= set(range(shards))
        for s in counts:
            assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
    together = defaultdict(set)
    for r in found:
        together[r.link].add(r.shard)
    sizes = Counter(r.link for r in found)
    assert sum(len(together[k]) > 1 for k, n in sizes.items() if 1 < n < 40) <= 1
    assert max(len(v) for v in together.values()) <= 7  # 200 rows in shards of 50
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("sizes, shards, least", [([3] * 400, 40, 0.9), ([2, 3, 4, 5] * 1000, 40, 0.95), ([700, *[2] * 400, *[1] * 500], 10, 0.9), ([1] * 50, 40, 1)])
def test_sharding_keeps_links(spark, sizes, shards, least):
    rows = spark.createDataFrame([(k, f"g{g}") for k, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))], "row_id long, link string")
    found = sharding.propagate(rows, shards).join(rows, "row_id").collect()
    total, counts = sum(sizes), Counter(r.shard for r in found)
    assert len(found) == len({r.row_id for r in found}) == total
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1 and set(counts) <= set(range(shards))
    here = Counter((r.link, r.shard) for r in found)
    small = {f"g{g}": n for g, n in enumerate(sizes) if 1 < n <= total // shards}
    kept = sum(n * (n - 1) for (g, _), n in here.items() if g in small)
    assert kept >= least * sum(n * (n - 1) for n in small.values())
    assert all(r.together == here[r.link, r.shard] for r in found if r.link in small)


def test_quotas_refuse_the_fewest():
    import random

    for seed in range(50):
        draw = random.Random(seed)
        asks = {(a, b): draw.randint(1, 9) for a in range(6) for b in range(6) if a != b and draw.random() < 0.6}
        room = [draw.randint(0, 3) for _ in range(6)]
        granted = sharding._quotas(asks, room)
        assert all(0 < n <= asks[m] for m, n in granted.items())
        for j in range(6):
            assert sum(n for (_, b), n in granted.items() if b == j) - sum(n for (a, _), n in granted.items() if a == j) <= room[j]
    assert sharding._quotas({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}


def test_line_frequency_against_sql(spark, odd, docs, small):
    import duckdb

    documents = docs.toPandas()  # noqa: F841
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"]
    assert Counter(map(tuple, line_frequency.judge(docs).select(names).collect())) == Counter(duckdb.sql(f"SELECT {', '.join(names)} FROM ({line_frequency.SQL})").fetchall())
    documents = odd.toPandas()  # noqa: F841
    assert Counter(map(tuple, line_frequency.judge(odd).select(names).collect())) == Counter(duckdb.sql(f"SELECT {', '.join(names)} FROM ({line_frequency.SQL})").fetchall())


def test_line_frequency_rejects_depleted(spark, empty):
    own = " ".join(f"own{i}" for i in range(60))
    notice = " ".join(f"notice{i}" for i in range(70))
    rows = [(i, f"{notice}\n" + own.replace("own", f"d{i}w"), "en", "a") for i in range(30)]
    rows += [(100 + i, f"{own.replace('own', f'c{i}w')}\nshort line", "en", "a") for i in range(10)] + [(200, f"{notice}\n{own}", "en", "other")]
    found = {r.doc_id: r for r in line_frequency.judge(frame(spark, rows)).collect()}
    assert not any(found[i].kept for i in range(30)) and all(found[i].n_removed_words == 70 for i in range(30))
    assert all(found[100 + i].kept for i in range(10)) and found[200].kept
    assert line_frequency.judge(empty).count() == 0


def test_repeated_windows(spark):
    def plain(text):
        words = text.split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)})

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    found = {r.doc_id: r.n_repeat_words for r in line_frequency.features(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).withColumn("out", language.held_out()).select("out", "lang", "lang_pred", "score", "rejected").collect()
    held = [r for r in found if r.out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in found) / len(found) < 0.01 and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in language.predict(odd, language.learn(docs)).collect()}
    assert {i for i, r in by.items() if r.lang_pred == "und"} == {1, 2, 10, 12} and by[12].rejected and by[12].score == 0
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}


def test_language_ignores_held_out_labels(spark, docs):
    one = language.learn(docs)
    other = language.learn(docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang"))))
    assert one == other


def plain_removals(rows):
    lines, gone = [], set()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            words = frozenset(line.encode().lower().split())
            if len(words) < 5:
                continue
            if any((j, m) != (i, k) and 5 * len(words & w) >= 4 * len(words | w) for j, m, w in lines):
                gone.add((i, k))
            lines.append((i, k, words))
    return gone


@pytest.mark.parametrize("leaders,up_to", [(2048, 8), (3, 1)])
def test_line_dedup(spark, docs, monkeypatch, leaders, up_to):
    monkeypatch.setattr(line_dedup, "LEADERS", leaders)
    monkeypatch.setattr(line_dedup, "ALL_UP_TO", up_to)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 30))] for _ in range(30)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 4)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
        rows.append((i, "\n".join(lines)))
    gone = plain_removals(rows)
    found = {(r.doc_id, r.line) for r in line_dedup.judged(frame(spark, [(i, t, "en", "a") for i, t in rows])).filter("gone").collect()}
    assert found == gone and gone
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert {(r.doc_id, r.line) for r in line_dedup.judged(docs).filter("gone").collect()} == plain_removals(texts)


@pytest.mark.parametrize("hot", [255, 0])
def test_postings_are_shuffled_in_blocks(spark, monkeypatch, hot):
    """Words of ten lines in all, in blocks and (hot) in turns; a row for each posting would be thousands."""
    monkeypatch.setattr(line_dedup, "HOT", hot, raising=False)
    monkeypatch.setattr(line_dedup, "TURNS", 5, raising=False)
    monkeypatch.setattr(line_dedup, "LEADERS", 4)
    monkeypatch.setattr(line_dedup, "ALL_UP_TO", 1)
    plans, write = [], line_dedup.cut

    def noted(df, name="cut"):
        if name == "candidates":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(line_dedup, "cut", noted)
    rng = random.Random(8)
    base = [[f"w{rng.randrange(60)}" for _ in range(25)] for _ in range(10)]
    rows = []
    for i in range(120):
        lines = [list(rng.choice(base)) for _ in range(3)]
        for words in lines:
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(25)] = f"w{rng.randrange(60)}"
        rows.append((i * 7, "\n".join(map(" ".join, lines))))
    texts = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)
    gone = plain_removals(rows)
    assert {(r.doc_id, r.line) for r in line_dedup.judged(texts).filter("gone").collect()} == gone and len(gone) > 100
    found = {r.doc_id: (r.n_removed, r.n_left) for r in line_dedup.dedup_lines(texts).collect()}
    assert found == {i: (n := sum(j == i for j, _ in gone), 3 - n) for i, _ in rows}
    assert plans and all("postings" in p and "Generate" not in p for p in plans)


def test_long_texts_are_read_in_parts(monkeypatch):
    text = ("Some words \tand\nlines " * 50 + "x" * 300 + "\n\n" + "a b\n" * 100 + "y" * 200).encode()
    whole = line_dedup.words_of(text, 64)
    for size in (1, 7, 64, 250):
        monkeypatch.setattr(line_dedup, "_AT_ONCE", size)
        assert b"".join(line_dedup._parts(text)) == text
        found = line_dedup.words_of(text, 64)
        assert (found[0] == whole[0]).all() and (found[1] == whole[1]).all() and found[2] == whole[2] == text.count(b"\n") + 1


def test_line_dedup_edges(spark, odd, empty):
    found = line_dedup.dedup_lines(odd)
    assert found.columns == [*odd.columns, "n_lines", "n_removed", "n_left"] and found.count() == odd.count()
    by = defaultdict(list)
    for r in found.collect():
        by[r.doc_id].append(r)
    assert by[1][0].text is None and by[2][0].text == "" and by[6][0].text == LONG
    assert [r.n_removed for r in by[7]] == [0, 0] and by[8][0].text == "and more" and by[8][0].n_left == 0
    assert by[None][0].n_removed == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_quality(spark, odd, empty, small):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels)
    flipped = labels.withColumn("quality", F.when(language.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.learn(docs.repartition(5), flipped)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True)) and model.pairs
    rows = quality.score(docs, model).withColumn("out", language.held_out()).join(labels, "doc_id").filter("out").select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(odd, model).count() == odd.count() and quality.score(empty, model).count() == 0
    none = quality.learn(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_quality_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y, pairs=1)
    assert model.pairs[0][:2] == (1, 0) and ((model.scores(x) > 0.5) == y).mean() > 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and this is a long notice about them that you must read.</p></div>
<div id="content"><article><header><h1>A  headline &amp;\n more</h1></header><p><b>First paragraph of text, with <a href=/x>a link</a> inside.<br>Next line.
<p>Second one &lt;tag&gt; &#233;.</p><div class="ad">Buy this now, it is very cheap and good.</div><ul><li>An item.<li>Another item.</ul>
<form><label>Your mail</label><input name=q></form></article>
<section class="comments"><p>I am a reader and I say this is a very long comment, indeed.</p></section></div>
<aside><p>Related: a long teaser text that looks like an article, but is not.</p></aside><footer>&copy; 2020 us. All rights reserved.</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE).split("\n\n") == ["A headline & more", "First paragraph of text, with a link inside. Next line.", "Second one <tag> é.", "An item.", "Another item."]
    assert html_text.main_text("") == "" and html_text.main_text("<p>") == "" and html_text.main_text("<nav><a href=x>y</a></nav>") == ""


def test_labelling_is_a_minimum_cut():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 9)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(labels, scores=scores, edges=edges):
            return sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.label(scores, edges)) == pytest.approx(best)


ARTICLE = "<article><p>A whole first sentence of the text.</p><p><a href=x>One link here</a></p><p>And the last sentence, closing it.</p></article>"
KEPT = ["A whole first sentence of the text.", "One link here", "And the last sentence, closing it."]


def test_html_keeps_whole_articles():
    for page in (ARTICLE, "<head><title>x</title><body>" + ARTICLE, "<head><title>x</title>" + ARTICLE, "<body><svg/>" + ARTICLE, "<svg><path d=x/><g><text>no</text></g></svg>" + ARTICLE, "<iframe src=x />" + ARTICLE):
        assert html_text.main_text(page).split("\n\n") == KEPT
    one = "<p>A whole first sentence of this text, kept.</p>"
    for page in (f'<div class="post tags-list">{one}</div>', f'<main><div class="side">{one}</div></main>', one):
        assert html_text.main_text(page) == one[3:-4]
    advert = f'<div class="ad">{"buy this now. " * 100}</div><div class="post-comments"><p>{"I like it. " * 200}</p></div>'
    assert html_text.main_text(ARTICLE.replace("</article>", advert + "</article>")).split("\n\n") == KEPT


def test_html_cut_decides_on_whole_pages():
    import itertools

    menu = "<ul>" + "".join(f"<li><a href={k}>Link {k}</a></li>" for k in range(4)) + "</ul>"
    changed = 0
    for page in (ARTICLE, ARTICLE.replace("</article>", menu + "</article>"), menu + ARTICLE, PAGE, f"<div>{menu}<p>Some words</p><p>A sentence with more of them.</p></div>"):
        blocks, has_article = html_text.parse(page)
        scores, edges = [html_text.evidence(b, has_article) for b in blocks], html_text.links(blocks, 1.5)

        def cost(labels, scores=scores, edges=edges):
            return sum(abs(s) for s, x in zip(scores, labels, strict=True) if x != (s > 0)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost(x) for x in itertools.product((False, True), repeat=len(blocks)))
        assert cost(html_text.label(scores, edges)) == pytest.approx(best)
        changed += html_text.main_text(page) != html_text.main_text(page, 0.0)
    assert changed >= 2 and "Link" not in html_text.main_text(menu + ARTICLE)


def test_html_deep_pages_are_linear():
    import time

    start = time.perf_counter()
    html_text.main_text("<div>x" * 20_000)
    assert time.perf_counter() - start < 5


def test_html_table(spark, small):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "y"), (None, "u", "", "z"), (4, "v", "<p>" * 20000 + "deep text, a whole sentence of it." + "<b>" * 3000, "w")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows) and sorted(r.n_chars for r in rows)[:2] == [0, 0]
    assert html_text.extract(pages.limit(0)).count() == 0
    assert html_text.extract(spark.read.parquet(f"{small}/pages.parquet")).filter("n_chars = 0").count() == 0


def test_line_dedup_query_compares_short_lines(spark, tmp_path):
    rows = [(1, "les.\na b c d\n\nall rights reserved."), (2, "Les.\na b c\n\nRESERVED. all rights"), (3, "a b c d e\nles. les.\nstays"), (4, "中文中文\na b c x"), (5, "中文中文\nnew")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.n_lines, r.n_removed, r.n_left, r.text) for r in line_dedup.op8_line_dedup(spark, str(tmp_path)).collect()}
    # four of five words are a similarity of 4/5, three of four are not
    assert found == {1: (4, 0, 3, rows[0][1]), 2: (4, 2, 1, "a b c\n"), 3: (3, 2, 1, "stays"), 4: (2, 0, 2, rows[3][1]), 5: (2, 1, 1, "new")}


def test_language_rejects_what_is_in_no_learned_language(spark, docs):
    rng = random.Random(1)
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(200)) for _ in range(100)]
    dictionaries = language.learn(docs)
    assert all(r.rejected for r in language.predict(frame(spark, [(i, t, "en", "a") for i, t in enumerate(letters)]), dictionaries).collect())
    assert language.predict(docs, dictionaries).filter("rejected").count() == 0


def test_whole_sets_are_shuffled_once(spark, monkeypatch):
    plans, write = [], line_dedup.cut

    def noted(df, name="cut"):
        if name == "whole":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(line_dedup, "cut", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(k, "one two three four five six\none two three four five seven") for k in range(4)] + [(9, "one two three four five six eight")], "doc_id long, text string")
        found = line_dedup.dedup_lines(docs, least=1).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r.n_removed for r in found] == [0, 2, 2, 2, 1]
    assert plans and not any("Exchange" in p.split("SortMergeJoin")[0] for p in plans)  # none above the join
