"""Exact deduplication: counting quotient filters find repeated fingerprints, their texts are compared byte by byte.

Every partition builds counting quotient filters of the 64-bit fingerprints of
its texts, one for each block of the fingerprint space. Filters of one block
merge losslessly, as each lists its fingerprints in order. What is counted more
than once is routed to the verification, which groups the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm._common import SPACE, cut, tidy


class CountingQuotientFilter:
    """Unsigned fingerprints of ``bits`` bits with counts, as quotients (places) and remainders (sorted runs).

    ``occupied`` holds a bit for each quotient that has a run, ``ends`` a bit
    for each slot that ends its run; slots hold remainders in order and their
    counts. Nothing is lost: quotient and remainder make up the whole fingerprint.
    """

    def __init__(self, bits: int, quotient_bits: int, occupied: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.quotient_bits = bits, quotient_bits
        self.occupied, self.ends, self.remainders, self.counts = occupied, ends, remainders, counts

    @classmethod
    def of_sorted(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        quotient_bits = min(bits - 1, max(1, int(len(values)).bit_length()))
        shift = np.uint64(bits - quotient_bits)
        quotients = values >> shift
        occupied = np.zeros(1 << quotient_bits, dtype=bool)
        occupied[quotients] = True
        ends = np.append(quotients[1:] != quotients[:-1], True) if len(values) else np.zeros(0, dtype=bool)
        return cls(bits, quotient_bits, np.packbits(occupied), np.packbits(ends), values & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    @classmethod
    def of(cls, values: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        return cls.of_sorted(*np.unique(values.astype(np.uint64), return_counts=True), bits)

    def __len__(self) -> int:
        return len(self.remainders)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, and their counts."""
        n = len(self)
        if not n:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        runs = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.quotient_bits)).astype(np.uint64)
        ends = np.unpackbits(self.ends, count=n).astype(np.int64)
        run_of = np.cumsum(ends) - ends
        return (runs[run_of] << np.uint64(self.bits - self.quotient_bits)) | self.remainders, self.counts

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        (a, n), (b, m) = self.items(), other.items()
        values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        counts = np.zeros(len(values), dtype=np.int64)
        np.add.at(counts, place, np.concatenate([n, m]))
        return self.of_sorted(values, counts, self.bits)

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, self.quotient_bits, len(self)], dtype="<i8").tobytes()
        wide = -(-(self.bits - self.quotient_bits) // 8)  # whole bytes of a remainder
        slots = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
        once = self.counts == 1
        return head + self.occupied.tobytes() + self.ends.tobytes() + slots + np.packbits(once).tobytes() + self.counts[~once].astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, quotient_bits, n = (int(x) for x in np.frombuffer(data, "<i8", 3))
        at = 24

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied, ends = take(-(-(1 << quotient_bits) // 8)), take(-(-n // 8))
        wide = -(-(bits - quotient_bits) // 8)
        slots = np.zeros((n, 8), dtype=np.uint8)
        slots[:, :wide] = take(n * wide).reshape(n, wide)
        once = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
        counts = np.ones(n, dtype=np.int64)
        counts[~once] = np.frombuffer(data, "<i8", int((~once).sum()), at)
        return cls(bits, quotient_bits, occupied, ends, slots.view("<u8").ravel(), counts)


def merge_all(filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
    """Pairs merge first, so that each fingerprint is copied a logarithm of times."""
    heap = list(filters)
    while len(heap) > 1:
        heap = [a.merged(b) for a, b in zip(heap[::2], heap[1::2], strict=False)] + heap[len(heap) & ~1 :]
    return heap[0]


def repeated(fps: DataFrame, blocks: int = 256) -> DataFrame:
    """Return (fp long): the fingerprints (column ``fp``) that occur more than once.

    ``blocks``, a power of two, splits the fingerprint space; a block's filters
    from all partitions are merged in one task, so take more for more rows.
    """
    top = blocks.bit_length() - 1
    low = 64 - top

    @tidy
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        values = np.sort(np.concatenate(values)) if values else np.zeros(0, dtype=np.uint64)
        block = (values >> np.uint64(low)).astype(np.int64) if top else np.zeros(len(values), dtype=np.int64)
        starts = np.searchsorted(block, np.arange(blocks + 1))
        ids, data = [], []
        for i in np.flatnonzero(np.diff(starts)):
            ids.append(int(i))
            data.append(CountingQuotientFilter.of(values[starts[i] : starts[i + 1]] & np.uint64((1 << low) - 1), low).to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], names=["block", "filter"])

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, counts = merge_all(CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")).items()
        found = values[counts > 1] | (np.uint64(key[0].as_py()) << np.uint64(low) if top else np.uint64(0))
        return pa.table({"fp": pa.array(found.view(np.int64), pa.int64())})

    filters = fps.select("fp").mapInArrow(build, "block int, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long")


def exact_duplicates(docs: DataFrame, blocks: int = 256, broadcast_rows: int = 500_000) -> DataFrame:
    """Return (doc_id, keep_id, group_size long, kept boolean, text_sha256): one row per row of ``docs``.

    Texts are equal when identical after each run of white space (space, tab to
    carriage return) became one space; null counts as empty. Of equal texts, the
    smallest doc_id stays; rows that repeat that id and text stay together. A
    null id is larger than any other. Other columns are ignored.

    The repeated fingerprints are broadcast to the scan of the texts only when
    they are counted and at most ``broadcast_rows``; beyond, the join shuffles.
    """
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACE}]+", " ")
    own = cut(docs.select("doc_id", F.xxhash64(normal).alias("fp"), F.sha2(normal, 256).alias("text_sha256")), "hashed")
    again = cut(repeated(own, blocks), "repeated")
    side = F.broadcast(again) if again.count() <= broadcast_rows else again

    # by the bytes of the texts themselves; copies collapse before the shuffle
    texts = docs.select("doc_id", normal.alias("t")).withColumn("fp", F.xxhash64("t")).join(side, "fp", "left_semi")
    same = texts.groupBy("t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(same.select(F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")

    found = own.join(groups, "text_sha256", "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB, over the same tables.
SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
