"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. Words are ordered by rarity over all
documents, so two lines with a Jaccard similarity of at least 4/5 share a word
among the rarest of each (the prefix). Lines that share one are compared by
length, by the places of the shared word and by a parity bitmap of the sets, all
of which only rule out what cannot match (whole texts also by a bitmap as wide as
their set, before anything is read again); what is left is verified on the whole
sets. A line goes when an earlier line matches it.

Candidates are found on hashes of words, of 44 bits, which leaves room to sort them together with their line;
their similarity is that of the words themselves. Every table of a step is deleted once its reader is written. The rarity order comes from a table of counts of fixed
size, in which rare words may share a slot: that changes the order and what is
compared, never the result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm._common import blocks, cut, discard, release, small_batches, tidy

#: Similarity, as a fraction of whole numbers.
NUM, DEN = 4, 5
#: Lines with fewer distinct words are left alone, unless the caller asks for them.
LEAST_WORDS = 5
#: Sets of fewer words match none but their equals: one word more is already a similarity under 4/5 (four of five words still reach it).
ALONE = NUM // (DEN - NUM)
#: Bits of a word's hash, and of its place in its line's order; places from the last on share it.
WORD_BITS, PLACE_BITS = 44, 20
LAST_PLACE = (1 << PLACE_BITS) - 1
#: Size up to which a set has a bitmap of 128 bits. Larger sets may differ in as many words as the bitmaps of any two do, 64.
WIDE = 287
#: Slots of the table of counts, bits of the filter of wanted lines, parts of either, tasks that unite them.
SLOTS, WANTED_BITS, PARTS, MERGERS = 1 << 23, 1 << 25, 64, 16
#: Wanted lines up to which their ids may be broadcast to the scan.
FEW = 50_000
#: Bytes of text handled at once, postings handled at once, postings that a task may hold.
_AT_ONCE, _POSTINGS, _HELD = 1 << 20, 1 << 18, 1 << 20
#: Coded count from which a word's postings come in turns (200,000 occurrences), and their number.
HOT, TURNS = 255, 32
#: What a posting is in a block (p, sid, n, b1, b2), and its bytes.
_KINDS = (np.int64, np.int64, np.int32, np.int64, np.int64)
_POSTING = sum(np.dtype(kind).itemsize for kind in _KINDS)
#: Postings of a word against which each later one is compared; candidates up to which all of a posting's are given.
LEADERS, ALL_UP_TO = 2048, 8

_BASE = 0x9E3779B97F4A7C15
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = bytes(k in (0x20, *range(0x09, 0x0E)) for k in range(256))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, x, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    h = h * np.uint64((2 * turn + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about _AT_ONCE bytes that end at white space, or after one word that is longer."""
    start = 0
    while len(text) - start > _AT_ONCE:
        end = start + _AT_ONCE
        space = max(text.rfind(b" ", start, end), text.rfind(b"\n", start, end))
        if space < start:
            found = _SPACES.search(text, end)
            space = found.start() if found else len(text) - 1
        yield text[start : space + 1]
        start = space + 1
    yield text[start:]


def words_of(text: bytes, bits: int = WORD_BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, line) of each word of a text in order, and the number of its \\n-split lines; A-Z are lower-cased.

    A long text is read part by part: what is held for each byte, some forty times its size, is held for one part.
    """
    hashes, lines, before = [], [], 0
    for part in _parts(text):
        h, line, n = _words_of(part, bits)
        hashes.append(h), lines.append(line + before)
        before += n - 1
    return (hashes[0], lines[0], before + 1) if len(hashes) == 1 else (np.concatenate(hashes), np.concatenate(lines), before + 1)


def _words_of(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    text = text.lower()
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data)
    space = np.ones(n + 2, dtype=bool)
    space[1:-1] = np.frombuffer(text.translate(_IS_SPACE), dtype=bool)
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(max(_AT_ONCE, 1 << max(1, n).bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.add(data, np.uint64(1), out=sums[1:], dtype=np.uint64)
    sums[1:] *= power[:n]
    np.cumsum(sums, out=sums)
    breaks = np.flatnonzero(data == 10)
    before = np.concatenate([[0], np.searchsorted(starts, breaks), [len(starts)]])
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(before))
    return _mixed((sums[ends] - sums[starts]) * inverse[starts], 0) >> np.uint64(64 - bits), line, len(breaks) + 1


def shingles_of(text: bytes, first_line: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of 64 bits, row) of the shingles of joined texts; a row of fewer words is one shingle, if of none an empty one."""
    hashes, lines, _ = words_of(text, 64)
    row = np.searchsorted(first_line, lines, side="right") - 1
    counts = np.bincount(row, minlength=len(first_line))
    whole = max(0, len(hashes) - shingle + 1)
    out = np.zeros(whole, dtype=np.uint64)
    for k in range(shingle):
        out = out * np.uint64(_BASE) + hashes[k : whole + k]
    inside = row[:whole] == row[len(row) - whole :]
    out, rows = out[inside], row[:whole][inside]
    short = np.flatnonzero(counts < shingle)
    start, h = (np.cumsum(counts) - counts)[short], counts[short].astype(np.uint64)
    for k in range(shingle - 1):
        more = k < counts[short]
        h[more] = h[more] * np.uint64(_BASE) + hashes[start[more] + k]
    out, rows = np.append(out, h), np.append(rows, short)
    order = np.argsort(rows, kind="stable")
    return _mixed(out[order], 7), rows[order]


def sets_of(hashes: np.ndarray, lines: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the lines that have ``least``: (hash, place of its line below), lines, their sizes."""
    if len(lines) and lines[-1] >= 1 << (64 - WORD_BITS):  # more lines than the sort key has room for
        half = len(lines) // 2
        half = int(np.searchsorted(lines, lines[half]))
        a, b = (sets_of(hashes[x], lines[x] - lines[x][0], least) for x in (slice(0, half), slice(half, None)))
        return tuple(np.concatenate([a[i], b[i] + (len(a[2]) if i == 1 else int(lines[half]) if i == 2 else 0)]) for i in range(4))
    key = np.sort((lines.astype(np.uint64) << np.uint64(WORD_BITS)) | hashes)
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    key = key[first]
    line = (key >> np.uint64(WORD_BITS)).astype(np.int64)
    sizes = np.bincount(line)
    good = sizes >= least
    inside = good[line]
    place = np.cumsum(good) - 1
    which = np.flatnonzero(good)
    return key[inside] & np.uint64((1 << WORD_BITS) - 1), place[line[inside]], which, sizes[which]


def _keys(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share."""
    return tuple(np.add.reduceat(_mixed(h, i), starts) for i in (1, 2))


def _keyed(text: bytes, first_line: np.ndarray, least: int, shingle: int) -> tuple[np.ndarray, ...]:
    """(hash, place of its set below), the sets' lines, rows, sizes and 128-bit keys. The sets are the lines, or with ``shingle`` the whole texts.

    A set too small to match any but its equal is taken by its key alone, which is made of whole hashes there.
    """
    if shingle:
        full, lines = shingles_of(text, first_line, shingle)
    else:
        full, lines, _ = words_of(text, 64)
    h, at, line, n = sets_of(full >> np.uint64(64 - WORD_BITS), lines, least)
    if not len(n):
        return h, at, line, line, n, h, h
    k1, k2 = _keys(h, np.cumsum(n) - n)
    small = n < ALONE
    if small.any():
        wanted = np.zeros(int(lines[-1]) + 1, dtype=bool)
        wanted[line[small]] = True
        inside = wanted[lines]
        f, own = full[inside], lines[inside]
        order = np.lexsort((f, own))
        f, own = f[order], own[order]
        first = np.ones(len(f), dtype=bool)
        first[1:] = (f[1:] != f[:-1]) | (own[1:] != own[:-1])
        f, own = f[first], own[first]
        k2[small] = np.add.reduceat(_mixed(f, 2), np.flatnonzero(np.append(True, own[1:] != own[:-1])))
    row = line if shingle else np.searchsorted(first_line, line, side="right") - 1
    return h, at, np.zeros_like(line) if shingle else line - first_line[row], row, n, k1, k2


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end, joined texts, first line of each row) in blocks of bounded bytes; null is empty."""
    texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
    for a, b in blocks([len(t) + 1 for t in texts], _AT_ONCE):
        counts = np.array([t.count(b"\n") + 1 for t in texts[a:b]])
        yield a, b, b"\n".join(texts[a:b]), np.cumsum(counts) - counts


def _coded(counts: np.ndarray) -> np.ndarray:
    """Counts as a byte: exact up to 127, then by steps of a twelfth of a power of 2."""
    big = 127 + np.log2(np.maximum(counts, 1) / 127) * 12
    return np.where(counts <= 127, counts, np.minimum(255, big)).astype(np.uint8)


def _gathered(parts: DataFrame, size: int, kind: type, unite, finish) -> np.ndarray:
    """One table of fixed size from sparse parts (part, places, values): each part is united in one task, batch by batch."""
    wide = size // PARTS

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, places, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = tables.setdefault(part, np.zeros(wide, dtype=kind))
                at = np.flatnonzero(np.unpackbits(np.frombuffer(places, dtype=np.uint8), count=wide))
                planes = np.frombuffer(values, dtype=np.uint8).reshape(-1, len(at))
                table[at] = unite(table[at], np.ascontiguousarray(planes.T).view(kind).ravel())
        for part, table in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([finish(table).tobytes()], pa.binary())], names=["part", "table"])

    out = np.zeros((PARTS, wide), dtype=finish(np.zeros(1, dtype=kind)).dtype)
    for row in parts.repartition(MERGERS, "part").mapInArrow(merge, "part int, table binary").collect():
        out[row[0]] = np.frombuffer(row[1], dtype=out.dtype)
    return out.ravel()


def _scattered(table: np.ndarray) -> pa.RecordBatch:
    """The places that are not 0 as bits and their values byte by byte, lowest bytes first: what a shuffle then compresses well."""
    wide = len(table) // PARTS
    part, places, values = [], [], []
    for i in range(PARTS):
        own = table[i * wide : (i + 1) * wide]
        at = np.flatnonzero(own)
        if len(at):
            part.append(i), places.append(np.packbits(own != 0).tobytes()), values.append(own[at].view(np.uint8).reshape(len(at), -1).T.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["part", "places", "values"])


_SPARSE = "part int, places binary, values binary"


def rarity(docs: DataFrame, shingle: int = 0) -> np.ndarray:
    """Coded counts of all words, or shingles, of all documents by slot, SLOTS bytes whatever the corpus."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, dtype=np.uint32)
        for batch in batches:
            for _, _, text, first_line in _texts(batch, 0):
                hashes = shingles_of(text, first_line, shingle)[0] >> np.uint64(64 - WORD_BITS) if shingle else words_of(text)[0]
                slots, n = np.unique(hashes & np.uint64(SLOTS - 1), return_counts=True)
                table[slots] += n.astype(np.uint32)
        yield _scattered(table)

    def unite(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a.astype(np.uint64) + b, 0xFFFFFFFF).astype(np.uint32)

    return _gathered(docs.select("text").mapInArrow(count, _SPARSE), SLOTS, np.uint32, unite, _coded)


def _bitmaps(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Parities of the words of each set, of ``n`` words, by place, in two numbers; 0 for large sets, which a shuffle compresses."""
    bit = _mixed(h, 3) >> np.uint64(57)
    value = np.where(np.repeat(n, n) <= WIDE, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
    return [np.bitwise_xor.reduceat(np.where((bit >> np.uint64(6)) == i, value, np.uint64(0)), np.cumsum(n) - n) for i in (0, 1)]


def _wide_bitmap(h: np.ndarray) -> bytes | None:
    """The parities of a set of over WIDE words, with a bit or more for each word."""
    if len(h) <= WIDE:
        return None
    bits = 1 << (len(h) - 1).bit_length()
    return np.packbits(np.bincount((_mixed(h, 3) & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def _wide_apart(a: bytes, b: bytes) -> int:
    k = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(c, dtype=np.uint8).reshape(-1, k), axis=0) for c in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def lines_of(docs: DataFrame, counts: np.ndarray, least: int = LEAST_WORDS, shingle: int = 0) -> DataFrame:
    """Return (doc_id, text_hash, line, of, n, k1, k2, b1, b2, prefix): the lines that are compared; a prefix entry is a word and its place.

    ``of`` is the number of compared lines in the text on the first of them, 0 on the others. With ``shingle`` also ``wide``, the bitmap of a large set.

    Words that occur once in all documents are left out of the prefix, as no
    other line has them.
    """
    kind = dict(docs.dtypes)["doc_id"]
    table = docs.sparkSession.sparkContext.broadcast(counts)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, text, first_line in _texts(batch, 1):
                h, at, line, row, n, k1, k2 = _keyed(text, first_line, least, shingle)
                starts = np.cumsum(n) - n
                if not len(n):
                    continue
                b1, b2 = _bitmaps(h, n)
                wide = [pa.array([_wide_bitmap(h[i : i + m]) for i, m in zip(starts.tolist(), n.tolist(), strict=True)], pa.binary())] if shingle else []
                count = table.value[h & np.uint64(SLOTS - 1)]
                order = np.argsort((at.astype(np.uint64) << np.uint64(44)) | (count.astype(np.uint64) << np.uint64(36)) | (h & np.uint64((1 << 36) - 1)), kind="stable")
                h, at, count = h[order], at[order], count[order]
                place = np.arange(len(h)) - starts[at]
                chosen = (place < n[at] - -(-NUM * n[at] // DEN) + 1) & (count > 1) & (n[at] >= ALONE)
                ends = np.append(0, np.cumsum(np.bincount(at[chosen], minlength=len(n)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).take(pa.array(row + a)) for i in (0, 2)),
                        pa.array(line.astype(np.int32)),
                        pa.array(np.where(np.append(True, row[1:] != row[:-1]), np.bincount(row)[row], 0).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        *(pa.array(x.view(np.int64)) for x in (k1, k2, b1, b2)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(((h[chosen] << np.uint64(PLACE_BITS)) | np.minimum(place[chosen], LAST_PLACE).astype(np.uint64)).view(np.int64))),
                        *wide,
                    ],
                    names=["doc_id", "text_hash", "line", "of", "n", "k1", "k2", "b1", "b2", "prefix", *(["wide"] if shingle else [])],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, line int, of int, n int, k1 long, k2 long, b1 long, b2 long, prefix array<long>" + ", wide binary" * bool(shingle))


def postings_of(sets: DataFrame) -> DataFrame:
    """Return (p, sid, n, b1, b2): the prefix words of distinct lines with their places, in one number, which is less to shuffle."""
    return sets.select(F.explode("prefix").alias("p"), "sid", "n", "b1", "b2")


def _word() -> Column:
    return F.shiftrightunsigned("p", PLACE_BITS)


def in_order(first: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``sid``, unique and rising with (doc_id, line), to the distinct lines.

    Whole-number ids that no two texts share make it by arithmetic, if the
    product fits a long; otherwise the rows are dealt out by ranges of their order.
    """
    if dict(first.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        row = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("line"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
        low, high, longest, nulls = row
        if low is not None and not nulls and (int(high) - int(low) + 1) * (longest + 1) < 1 << 62:
            shared = lines.select("doc_id", "text_hash").distinct().groupBy("doc_id").count().filter("count > 1")
            if shared.isEmpty():
                return first.withColumn("sid", (F.col("doc_id").cast("long") - F.lit(int(low))) * (longest + 1) + F.col("line"))
    return first.repartitionByRange("doc_id", "line").sortWithinPartitions("doc_id", "line").withColumn("sid", F.monotonically_increasing_id())


def _pairs(word, p, sid, n, b1, b2, known, leaders: int, up_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, more) of postings in the order of (word, sid); of those ``known`` from before no y is made."""
    place = p & LAST_PLACE
    m = len(word)
    new_run = np.ones(m, dtype=bool)
    new_run[1:] = word[1:] != word[:-1]
    start = np.maximum.accumulate(np.where(new_run, np.arange(m), 0))
    rank = np.arange(m) - start
    b1, b2 = b1.view(np.uint64), b2.view(np.uint64)
    unknown = place == LAST_PLACE
    some_unknown = bool(unknown.any())
    short = np.int32 if n.max(initial=0) < 1 << 27 else np.int64
    size, ahead = n.astype(short), place.astype(short)
    rest = size - ahead
    active = np.flatnonzero((rank > 0) & ~known)
    behind, first, n1, p1, rest1 = rank[active], start[active], size[active], ahead[active], rest[active]
    seen = np.zeros(m, dtype=np.int32)
    found_y, found_x = [], []
    for q in range(min(leaders, int(rank.max(initial=0)))):
        if q < 4 or q % 4 == 0:
            left = (behind > q) & (seen[active] <= up_to)
            active, behind, first, n1, p1, rest1 = (c[left] for c in (active, behind, first, n1, p1, rest1))
            if not len(active):
                break
        j = first + q
        # lines that share the words at two places have at most so many in common as come before and after both
        fits = (np.minimum(p1, ahead.take(j, mode="clip")) + np.minimum(rest1, rest.take(j, mode="clip"))) * (NUM + DEN) >= (n1 + size.take(j, mode="clip")) * NUM
        if some_unknown:
            fits |= unknown[active] | unknown.take(j, mode="clip")
        fits = np.flatnonzero(fits & (behind > q))
        y, j = active[fits], j[fits]
        total = n[y].astype(np.int64) + n[j]
        differ = total - 2 * -(-NUM * total // (NUM + DEN))
        far = np.bitwise_count(b1[j] ^ b1[y]).astype(np.int32) + np.bitwise_count(b2[j] ^ b2[y])
        good = (far <= differ) | (np.maximum(n[j], n[y]) > WIDE)
        y = y[good]
        seen[y] += 1
        found_y.append(y), found_x.append(j[good])
    y, x = (np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in (found_y, found_x))
    # the loop goes by rising x, so the number of a pair among its y's is its place in a stable sort
    order = np.argsort(y, kind="stable")
    y, x = y[order], x[order]
    turn = np.arange(len(y)) - np.searchsorted(y, y)
    many = seen[y] > up_to
    keep = ~many | (turn < 2)
    y, x, many = y[keep], x[keep], many[keep]
    late = np.flatnonzero((rank > leaders) & ~known & (seen <= up_to))
    return (
        np.concatenate([sid[y], sid[late]]),
        np.concatenate([sid[x], sid[start[late]]]),
        np.concatenate([many, np.ones(len(late), dtype=bool)]),
    )


def _dealt(postings: list[np.ndarray], part: np.ndarray, turn: np.ndarray) -> pa.RecordBatch:
    """The postings as a row for each (part, turn), column after column in its bytes: far fewer rows to shuffle."""
    wide = int(turn.max()) + 1
    key = part * wide + turn
    order = np.argsort(key.astype(np.uint16) if wide == 1 and key.max() < 1 << 16 else key, kind="stable")  # numbers that short are sorted by digits
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(starts[1:], len(key))
    columns = [c[order] for c in postings]
    rows = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    first = key[starts]
    return pa.RecordBatch.from_arrays([pa.array((first // wide).astype(np.int32)), pa.array((first % wide).astype(np.int32)), pa.array(rows, pa.binary())], names=["part", "turn", "postings"])


def candidates(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """Return (y, x, more) from the distinct lines and the coded counts of words: for a line y, earlier lines x that may match it.

    All of them where there are few; otherwise the first two, with ``more`` set
    on one: these lines are looked at again should none of their pairs match.
    Postings are shuffled in blocks by word and put in order where they arrive.
    Those of words that occur more often than a task should hold come in turns
    by rising ``sid``, of which only the first LEADERS are carried on.
    """
    spark = sets.sparkSession
    low, high, most = sets.agg(F.min("sid"), F.max("sid"), F.sum(F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1)).first()
    low, wide = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // TURNS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (most or 0) // _HELD)
    table = spark.sparkContext.broadcast(counts)

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            postings = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            word = postings[0].view(np.uint64) >> np.uint64(PLACE_BITS)
            hot = table.value[word & np.uint64(SLOTS - 1)] >= HOT
            turn = np.where(hot, (postings[1] - low) // wide + 1, 0)
            return _dealt(postings, (word % np.uint64(parts)).view(np.int64), turn)

        size = 0
        for batch in batches:
            prefix = batch.column(0)
            many = np.diff(prefix.offsets.to_numpy())
            p = prefix.flatten().to_numpy(zero_copy_only=False)
            held.append([p, *(np.repeat(c.to_numpy(zero_copy_only=False), many) for c in batch.columns[1:])])
            size += len(p)
            if size >= _POSTINGS:
                yield flush()
                size = 0
        if size:
            yield flush()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None

        def meet(held: list[bytes], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal carry
            sizes = [len(row) // _POSTING for row in held]
            new, done = [], 0
            for kind in _KINDS:
                new.append(np.concatenate([np.frombuffer(row, dtype=kind, count=m, offset=done * m) for row, m in zip(held, sizes, strict=True)]))
                done += new[-1].itemsize
            held.clear()
            known = np.zeros(len(new[0]), dtype=bool)
            if carry is not None:
                known = np.append(np.ones(len(carry[0]), dtype=bool), known)
                new = [np.concatenate(c) for c in zip(carry, new, strict=True)]
            word = (new[0].view(np.uint64) >> np.uint64(PLACE_BITS)).view(np.int64)
            order = np.lexsort((new[1], word))
            word, known, new = word[order], known[order], [c[order] for c in new]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            ends = np.append(starts[1:], len(word))
            # cut where words end
            cuts = np.unique(np.concatenate([[0], ends[np.searchsorted(ends, np.arange(_POSTINGS, len(word), _POSTINGS))], [len(word)]]))
            for at in map(slice, cuts[:-1].tolist(), cuts[1:].tolist()):
                y, x, more = _pairs(word[at], *(c[at] for c in new), known[at], LEADERS, ALL_UP_TO)
                found = pa.table({"y": pa.array(y), "x": pa.array(x), "more": pa.array(more)})
                yield from found.group_by(["y", "x"]).aggregate([("more", "max")]).rename_columns(["y", "x", "more"]).to_batches()
            if not last:
                leading = np.arange(len(word)) - np.repeat(starts, ends - starts) <= LEADERS
                carry = [c[leading] for c in new]

        held: list[bytes] = []
        now = 0
        for batch in batches:
            for turn, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if turn != now and held:
                    yield from meet(held, now == 0)  # words of turn 0 come in no other
                now = turn
                held.append(row)
        if held:
            yield from meet(held, True)

    dealt = sets.select("prefix", "sid", "n", "b1", "b2").mapInArrow(deal, "part int, turn int, postings binary")
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions("turn").select("turn", "postings")
    return ordered.mapInArrow(run, "y long, x long, more boolean")


def _wanted_key(did: np.ndarray, line: np.ndarray, k1: np.ndarray) -> np.ndarray:
    return _mixed(k1 ^ _mixed(did + line.astype(np.uint64), 4), 5) & np.uint64(WANTED_BITS - 1)


def _document_key(did: np.ndarray) -> np.ndarray:
    """The place of a document that has a wanted line, so that the others need not be split into words."""
    return _mixed(did, 6) & np.uint64(WANTED_BITS - 1)


def _marked(marks: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (marks[key >> np.uint64(3)] >> (7 - (key & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _runs(words: bytes, shingle: int) -> set[bytes]:
    """The runs of ``shingle`` words of a text; a shorter text is one run."""
    words = words.split()
    return {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}


def _whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int = 0) -> DataFrame:
    """Return (sid, words): the whole sets of ``wanted`` (sid, doc_id, line, k1, k2), read from the texts again as words, not as hashes.

    With ``shingle`` the words of the text in order, joined by spaces, of which the runs are made when they are compared.

    A filter of fixed size tells the scan which lines to give; those it lets
    through by chance fall out in the join.
    """
    did = F.xxhash64("doc_id").alias("did")

    @tidy
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(WANTED_BITS, dtype=bool)
        for batch in batches:
            d, line, k1 = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            bits[_wanted_key(d.view(np.uint64), line, k1.view(np.uint64))] = True
            bits[_document_key(d.view(np.uint64))] = True
        yield _scattered(np.packbits(bits))

    marks = _gathered(wanted.select(did, "line", "k1").mapInArrow(mark, _SPARSE), WANTED_BITS // 8, np.uint8, np.bitwise_or, lambda t: t)
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    if wanted.count() <= FEW:
        docs = docs.join(F.broadcast(wanted.select(F.col("doc_id").alias("__id")).distinct()), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            some = _marked(shared.value, _document_key(ids))
            batch, ids = batch.filter(pa.array(some)), ids[some]
            for a, _, text, first_line in _texts(batch, 1):
                h, at, line, row, n, k1, k2 = _keyed(text, first_line, ALONE, shingle)
                if not len(n):
                    continue
                hit = np.flatnonzero(_marked(shared.value, _wanted_key(ids[row + a], line, k1)))
                parts = text.lower().split(b"\n")
                last = np.append(first_line[1:], len(parts))
                if shingle:
                    words = pa.array([b" ".join(b"\n".join(parts[first_line[r] : last[r]]).split()) for r in row[hit].tolist()], pa.binary())
                else:
                    words = [list(dict.fromkeys(parts[first_line[r] + at_line].split())) for r, at_line in zip(row[hit].tolist(), line[hit].tolist(), strict=True)]
                    words = pa.array(words, pa.list_(pa.binary())).cast(pa.list_(pa.string()), safe=False)
                yield pa.RecordBatch.from_arrays([pa.array(k1[hit].view(np.int64)), pa.array(k2[hit].view(np.int64)), words], names=["k1", "k2", "words"])

    sets = docs.select(did, "text").mapInArrow(run, f"k1 long, k2 long, words {'binary' if shingle else 'array<string>'}")  # of strings, whose common ones Spark finds by hashing; of bytes it would compare all with all
    # a key is one set's, so copies of it go before the join, which then finds the words where they are
    with small_batches(docs.sparkSession):
        return cut(wanted.select("sid", "k1", "k2").join(sets.dropDuplicates(["k1", "k2"]), ["k1", "k2"]).select("sid", "words"), "whole")


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (y, x) of ``sets`` with wide bitmaps whose bitmaps do not rule them out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, a, n2, b = (c.to_pylist() for c in batch.columns[2:])
            good = [p is None or q is None or _wide_apart(p, q) <= n + m - 2 * -(-NUM * (n + m) // (NUM + DEN)) for n, p, m, q in zip(n1, a, n2, b, strict=True)]
            yield batch.select(["y", "x"]).filter(pa.array(good, pa.bool_()))

    large = sets.filter("wide IS NOT NULL").select("sid", "n", "wide")
    met = pairs.join(large.toDF("y", "n1", "a"), "y", "left").join(large.toDF("x", "n2", "b"), "x", "left")
    return met.select("y", "x", "n1", "a", "n2", "b").mapInArrow(run, "y long, x long")


def _alike(met: DataFrame, shingle: int) -> DataFrame:
    """The y of ``met`` (y, a, b) whose texts a and b reach the similarity on their runs of words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((_runs(a, shingle), _runs(b, shingle)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            good = [DEN * (shared := len(a & b)) >= NUM * (len(a) + len(b) - shared) for a, b in sets]
            yield batch.select(["y"]).filter(pa.array(good, pa.bool_()))

    return met.select("y", "a", "b").mapInArrow(run, "y long")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int = 0) -> DataFrame:
    """The lines y of ``pairs`` (y, x) whose whole sets reach the similarity, written as (sid, k1, k2)."""
    pairs, used = pairs.select("y", "x").distinct(), []
    if shingle:
        with small_batches(docs.sparkSession):
            pairs = cut(_plausible(pairs, sets), "plausible")
        used.append(pairs)
    ends = pairs.select(F.col("y").alias("sid")).union(pairs.select("x")).distinct()
    wanted = cut(sets.select("sid", "doc_id", "line", "k1", "k2").join(ends, "sid", "left_semi"), "wanted")
    whole = _whole_sets(docs, wanted, shingle)
    release(docs.sparkSession)
    met = pairs.join(whole.toDF("y", "a"), "y").join(whole.toDF("x", "b"), "x")
    if shingle:
        met = _alike(met, shingle)
    else:
        shared = F.size(F.array_intersect("a", "b"))
        met = met.filter(DEN * shared >= NUM * (F.size("a") + F.size("b") - shared))
    with small_batches(docs.sparkSession, 200):
        matched = cut(met.select(F.col("y").alias("sid")).distinct().join(wanted.select("sid", "k1", "k2"), "sid"), "matched")
    discard(whole, wanted, *used)
    release(docs.sparkSession)
    return matched


def judged(docs: DataFrame, least: int = LEAST_WORDS, shingle: int = 0) -> DataFrame:
    """Return (doc_id, text_hash, line, gone): the compared lines, from 0; gone if an earlier one (by doc_id, then place) has a similarity of 4/5 or more.

    An earlier line counts whether or not it is itself removed. Equal sets are
    joined first: their first line stands for all, the others go. Lines with
    fewer than ``least`` distinct words are not compared. With ``shingle``, the
    whole text counts as one line 0, and its runs of so many words as the words.
    """
    return _judged(docs, least, shingle)[0].drop("of")


def _judged(docs: DataFrame, least: int, shingle: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """``judged`` with ``of``, as ``lines_of`` has it, and the tables to discard once it is written."""
    with small_batches(docs.sparkSession):
        counts = rarity(docs, shingle)
        full = cut(lines_of(docs, counts, least, shingle), "lines")
    release(docs.sparkSession)
    of_set = [c for c in full.columns if c not in ("doc_id", "text_hash", "line", "of", "k1", "k2")]
    first = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line")).alias("at"), *(F.any_value(c).alias(c) for c in of_set))
    first = first.select("at.doc_id", "at.line", "k1", "k2", *of_set)
    sets = cut(in_order(first, full), "sets")
    # the sets have the prefixes now; of the lines, most of whose table they are, only the keys are read again
    lines = cut(full.select("doc_id", "text_hash", "line", "of", "k1", "k2"), "keys")
    discard(full)
    release(docs.sparkSession)
    found = cut(candidates(sets, counts), "candidates")
    release(docs.sparkSession)
    matched = _verified(docs, sets, found, shingle)
    again = cut(found.filter("more").select(F.col("y").alias("sid")).distinct().join(matched, "sid", "left_anti"), "again")
    discard(found)
    if not again.isEmpty():
        # few lines are left: their words go to where the others' are; more of them meet those in a shuffle
        left = postings_of(sets.join(again, "sid", "left_semi"))
        place = F.col("p").bitwiseAND(F.lit(LAST_PLACE)).cast("int")
        left = left.select(_word().alias("word"), F.col("sid").alias("y"), F.col("n").alias("n2"), place.alias("p2"), F.col("b1").alias("c1"), F.col("b2").alias("c2"))
        need = F.ceil((F.col("n") + F.col("n2")) * NUM / (NUM + DEN) - 1e-9)
        fits = (F.greatest("place", "p2") == LAST_PLACE) | (F.least("place", "p2") + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("p2")) >= need)
        near = F.bit_count(F.col("b1").bitwiseXOR(F.col("c1"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("c2"))) <= F.col("n") + F.col("n2") - 2 * need
        near |= F.greatest("n", "n2") > WIDE
        left = F.broadcast(left) if left.count() <= FEW else left
        spread = postings_of(sets).select(_word().alias("word"), "sid", "n", place.alias("place"), "b1", "b2")
        more = cut(spread.join(left, "word").filter((F.col("sid") < F.col("y")) & fits & near).select("y", F.col("sid").alias("x")).distinct(), "more")
        near = _verified(docs, sets, more, shingle)
        both = cut(matched.union(near).distinct(), "matched")
        discard(near, more, matched)
        matched = both
    discard(again)
    # written first: Spark splits a line that is very common only in a join of two tables
    verdict = cut(sets.select("k1", "k2", F.struct("doc_id", "line").alias("at")).join(matched.select("k1", "k2", F.lit(True).alias("gone")), ["k1", "k2"], "left"), "verdict")
    discard(sets, matched)
    found = lines.join(verdict, ["k1", "k2"])
    return found.select("doc_id", "text_hash", "line", (F.col("gone").isNotNull() | ~F.col("at").eqNullSafe(F.struct("doc_id", "line"))).alias("gone"), "of"), [lines, verdict]


def without_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` whose text has no earlier one (by doc_id) with a similarity of 4/5 or more on runs of ``shingle`` words.

    Null texts count as empty, empty texts as equal. A shorter text is one run.
    Rows that repeat an id and a text stay or go together.
    """
    found, used = _judged(docs, 1, shingle)
    # every row has a set; those that go are the fewer, so that the texts need not be shuffled where they can be broadcast
    gone = cut(found.filter("gone").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "gone")
    discard(*used)
    release(docs.sparkSession)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Return the rows of ``docs`` with their text less the removed lines, and n_lines, n_removed, n_left (int).

    ``n_left`` counts the lines with at least ``least`` distinct words that
    stay; lines with fewer are not compared nor removed. A null text stays
    null and has no lines. Rows that repeat an id and a text are one document,
    and keep or lose the same lines; other rows with one id are judged each on
    its own text, a line of theirs being the earliest only if both share it at
    one place. A null id comes before all others. Columns with the names of the
    result's counts are replaced.
    """
    out = ["n_lines", "n_removed", "n_left"]
    columns = [c for c in docs.columns if c not in out]
    found, used = _judged(docs, least)
    # of the lines that stay, the first of a text tells how many it has
    by = found.filter(F.col("gone") | (F.col("of") > 0)).groupBy("doc_id", "text_hash").agg(F.collect_set(F.when(F.col("gone"), F.col("line"))).alias("__gone"), F.max("of").alias("__of"))
    by = cut(by.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__gone", (F.col("__of") - F.size("__gone")).alias("__left")), "gone")
    discard(*used)
    release(docs.sparkSession)
    joined = docs.select(*(F.col(f"`{c}`") for c in columns)).join(by.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    # the lines that stay, by number; the array of lines is bound once
    kept = "array_join(transform(array(split(text, '\\n')), a -> transform(array_except(sequence(0, size(a) - 1), __gone), i -> a[i]))[0], '\\n')"
    removed = F.coalesce(F.size("__gone"), F.lit(0))
    counted = joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1),
            "n_removed": F.when(F.col("text").isNull(), 0).otherwise(removed),
            "n_left": F.coalesce("__left", F.lit(0)),
        }
    )
    return counted.select(*(F.when(F.col("n_removed") > 0, F.expr(kept)).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in columns), *out)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=1)
    return found.select("doc_id", "n_lines", "n_removed", "n_left", "text")
