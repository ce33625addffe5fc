"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is two 32-bit segments. Two fingerprints that differ in at
most 2 bits either differ in at most 1 bit of the upper segment, or are equal in
the lower one. So each fingerprint looks up the Hamming ball of radius 1 around
its upper segment, and its own lower segment, in the segment tables, and the
whole distance of what it finds is verified.

A segment value that more than ``crowd`` fingerprints share would return pairs
with the square of its size. Its rows take the exact way round: there, each
fingerprint also enumerates the ball of radius 1 in the other segment. Two
fingerprints within 2 bits always meet in such a ball's point, and all that meet
in one point are within 2 bits of each other, at most 65 of them, so that they
are linked to the least of them. No link of a component is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm._common import cut, tidy
from textlode.llm.components import components

#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text, unsigned; bytes.lower and bytes.split see ASCII only, as the contract asks."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        bits = np.unpackbits(hashes[i : i + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16 if len(bits) < 65536 else np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Return (doc_id, fp long): one row per document; a null text is an empty one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _ball(column: str, own: bool, both_ways: bool) -> F.Column:
    """The values within one bit of a 32-bit segment; without both_ways only those that set a bit, as the other end of a pair finds the rest."""
    free = f"filter(sequence(0, 31), i -> (shiftrightunsigned({column}, i) & 1L) = 0L)" if not both_ways else "sequence(0, 31)"
    flips = f"transform({free}, i -> {column} ^ shiftleft(1L, i))"
    return F.expr(f"concat(array({column}), {flips})" if own else flips)


def links(fps: DataFrame, crowd: int = 64) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) that join all that lie within 2 bits of each other."""
    at = cut(fps.select("fp", F.shiftrightunsigned("fp", 32).alias("hi"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo")), "segments")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2

    hot_hi = cut(at.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("hi"), "hot")
    hot_lo = cut(at.groupBy("lo").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("lo"), "hot")

    probes = at.select(F.col("fp").alias("u"), "lo", F.col("hi").alias("own"), F.explode(_ball("hi", own=True, both_ways=False)).alias("hi"))
    table = at.join(hot_hi, "hi", "left_anti").select("hi", F.col("fp").alias("v"))
    upper = probes.join(table, "hi").filter((F.col("own") != F.col("hi")) | (F.col("u") < F.col("v"))).filter(near).select("u", "v")

    quiet = at.join(hot_lo, "lo", "left_anti")
    lower = quiet.select("lo", F.col("fp").alias("u")).join(quiet.select("lo", F.col("fp").alias("v")), "lo").filter("u < v").filter(near).select("u", "v")

    crowded = at.join(hot_hi, "hi", "left_semi")
    points = crowded.select("fp", "hi", F.explode(_ball("lo", own=True, both_ways=True)).alias("lo"))
    points = points.union(probes.filter("own != hi").join(hot_hi, "hi", "left_semi").select(F.col("u").alias("fp"), "hi", "lo"))
    points = points.union(at.join(hot_lo, "lo", "left_semi").select("fp", F.explode(_ball("hi", own=True, both_ways=True)).alias("hi"), "lo"))
    centre = F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))
    stars = points.groupBy(centre.alias("at")).agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1).select(F.explode("all").alias("u"), F.array_min("all").alias("v")).filter("u != v").filter(near)
    return upper.union(lower).union(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3, crowd: int = 64) -> DataFrame:
    """Return (doc_id, fp long, component_id): the smallest doc_id that is reachable over links of 2 or fewer bits.

    Null texts count as empty, and empty texts (fingerprint 0) are linked like
    any other. Repeated rows and equal texts share a fingerprint and hence a
    component. A null doc_id keeps its row and never names a component that has
    another id. Other columns are ignored; an empty table gives no rows.
    """
    own = cut(fingerprints(docs, shingle), "fingerprints")
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps, crowd))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component: one document of each group stays (with rows that repeat its id)."""
    first = near_duplicates(docs, shingle).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
