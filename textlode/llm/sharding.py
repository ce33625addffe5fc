"""Sharding by balanced label propagation.

Documents that are linked (here: equal texts) want to sit in one shard. They
start dealt out over all shards, then move in rounds: by a join, each looks up
how many of its links every shard holds and has room for, and asks to move to
the one that can hold most of them. Quotas for each pair of shards keep every
shard within a tenth of an even share: moves that cannot be made up for are refused, the fewest
that will do. At last the shards that hold too many give whole groups, small
ones first, to those that hold too few, and documents without links fill up.

The rows of a group are linked alike, so a round moves counts of (group, shard)
and no rows; rows take their places once, by their rank within their group.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlode.llm._common import cut, discard, ranked, salts_for

#: Rows of a group that one task of the last join holds.
PIECE = 500_000


def _quotas(asks: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the asked moves (from, to) are granted so that no shard grows by more than its room.

    A shard that would grow too much refuses moves of others into it. These
    shards then keep more, and refuse in turn, until one has room: the shortest
    such chains are taken. Both tables hold at most shards x shards counts.
    """
    granted = dict(asks)
    shards = len(room)
    spare = list(room)
    for (a, b), n in asks.items():
        spare[b] -= n
        spare[a] += n
    into: list[set[int]] = [{a for (a, b) in asks if b == j} for j in range(shards)]
    for j in range(shards):
        while spare[j] < 0:
            before: dict[int, int] = {j: j}
            queue, end = deque([j]), None
            while queue and end is None:
                b = queue.popleft()
                for a in sorted(into[b]):
                    if a not in before:
                        before[a] = b
                        queue.append(a)
                        if spare[a] > 0:
                            end = a
                            break
            # there is an end: without any moves no shard grows
            chain = [end]
            while chain[-1] != j:
                chain.append(before[chain[-1]])
            moves = list(zip(chain, chain[1:]))
            n = min(-spare[j], spare[end], *(granted[m] for m in moves))
            for a, b in moves:
                granted[a, b] -= n
                if not granted[a, b]:
                    into[b].discard(a)
            spare[j] += n
            spare[end] -= n
    return {m: n for m, n in granted.items() if n}


def _before(cells: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Add ``before``: the rows in cells that come earlier within ``keys``, small groups first and a group's cells together."""
    order = F.struct(F.ceil(F.log2("size")).alias("class"), F.pmod(F.xxhash64("group"), F.lit(salts)).alias("part"))
    dealt = cells.withColumn("__part", order)
    sofar = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "__part").agg(F.sum("n").alias("__n")).select(*keys, "__part", F.coalesce(F.sum("__n").over(sofar), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__part").orderBy("group", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, [*keys, "__part"]).withColumn("before", F.col("before") + F.col("__start")).drop("__part", "__start")


def _spans(surplus: list[int], wanted: list[int]) -> list[tuple[int, int, int, int]]:
    """(from, to, low, high): ranges of a shard's surplus and the shard that takes them; at most two for each shard."""
    gives = [[j, 0, n] for j, n in enumerate(surplus) if n > 0]
    takes = [[j, n] for j, n in enumerate(wanted) if n > 0]
    out = []
    while gives and takes:
        give, take = gives[-1], takes[-1]
        n = min(give[2] - give[1], take[1])
        out.append((give[0], take[0], give[1], give[1] + n))
        give[1] += n
        take[1] -= n
        if give[1] == give[2]:
            gives.pop()
        if not take[1]:
            takes.pop()
    return out


def propagate(rows: DataFrame, shards: int = 40, rounds: int = 12) -> DataFrame:
    """Give rows (row_id long, unique; link, null for none) a ``shard`` whose counts differ by one at most.

    Return (row_id, shard, group, together): the linked rows' group, null
    without links, and how many rows of it, itself included, are in the shard.
    A link's rows form a clique, kept as counts by shard, never as pairs. A link
    with more rows than a shard holds is told off into parts that fit one each.
    Rounds end once no move is asked or granted, or after ``rounds``. Ties go by
    hashes, so reruns agree. Only tables of shards x shards counts go to the
    driver. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    total = rows.count()
    salts = salts_for(total)
    capacity = max(1, total // shards)
    target = [total // shards + (j < total % shards) for j in range(shards)]
    # rows of one link are dealt over salts, so that a hot one is no single task
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
    sizes = salted.filter(F.col("link").isNotNull()).groupBy("link", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("link", "salt", F.sum("n").over(Window.partitionBy("link")).alias("n")).filter("n > 1")
    parts = F.when(F.col("n") > capacity, F.pmod(F.xxhash64("row_id", F.lit(1)), F.ceil(F.col("n") / (0.9 * capacity)).cast("long"))).otherwise(F.lit(0).cast("long"))
    group = F.when(F.col("n").isNotNull(), F.xxhash64("link", parts))
    own = cut(salted.join(sizes, ["link", "salt"], "left").select("row_id", group.alias("group")), "own")
    linked = own.filter(F.col("group").isNotNull())
    groups = linked.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    # dealt over the shards from one that a hash gives: each holds size / shards of a group, or one more
    each = F.expr(f"explode(transform(sequence(0L, least(size, {shards}L) - 1), i -> struct(cast(pmod(xxhash64(group) + i, {shards}L) as int) as shard, (size - i + {shards - 1}L) div {shards}L as n)))")
    cells = cut(groups.select("group", "size", each.alias("c")).select("group", "size", "c.shard", "c.n"), "cells")

    def held(cells: DataFrame) -> list[int]:
        found = dict(cells.groupBy("shard").agg(F.sum("n")).collect())
        return [found.get(j, 0) for j in range(shards)]

    def moved(cells: DataFrame, going: DataFrame) -> DataFrame:
        """Cells after ``going`` (group, size, shard, want, out): counts that leave are taken off and added there."""
        both = cells.select("group", "size", "shard", "n").union(going.select("group", "size", "shard", (-F.col("out")).alias("n"))).union(going.select("group", "size", F.col("want").alias("shard"), F.col("out").alias("n")))
        return both.groupBy("group", "size", "shard").agg(F.sum("n").alias("n")).filter("n > 0")

    count = held(cells)
    linked_rows = sum(count)
    limit = [max(t, -(-11 * linked_rows // (10 * shards))) for t in target]
    for _ in range(rounds):
        room = [max(0, m - n) for m, n in zip(limit, count, strict=True)]
        rooms = F.broadcast(spark.createDataFrame(list(enumerate(room)), "shard int, room long"))
        seen = cells.filter("n < size").join(rooms, "shard")
        tie = F.pmod(F.xxhash64("group", "shard"), F.lit(1 << 30))
        best = seen.groupBy("group").agg(F.max(F.struct(F.least("size", F.col("n") + F.col("room")), "n", tie, "shard")).alias("best")).select("group", F.col("best.shard").alias("want"))
        asks = cut(cells.join(best, "group").filter("shard != want"), "asks")
        wanted = {(r[0], r[1]): r[2] for r in asks.groupBy("shard", "want").agg(F.sum("n")).collect()}
        granted = _quotas(wanted, room) if wanted else {}
        if not granted:
            discard(asks)
            break
        quota = F.broadcast(spark.createDataFrame([(a, b, n) for (a, b), n in granted.items()], "shard int, want int, quota long"))
        going = _before(asks, ["shard", "want"], salts).join(quota, ["shard", "want"]).withColumn("out", F.least("n", F.col("quota") - F.col("before"))).filter("out > 0")
        after = cut(moved(cells, going), "moved")
        discard(asks, cells)
        cells, count = after, held(after)
    surplus = [max(0, n - t) for n, t in zip(count, target, strict=True)]
    spans = _spans(surplus, [max(0, t - n) for n, t in zip(count, target, strict=True)])
    if spans:
        ranges = F.broadcast(spark.createDataFrame(spans, "shard int, want int, low long, high long"))
        out = F.least(F.col("before") + F.col("n"), "high") - F.greatest("before", "low")
        going = _before(cells, ["shard"], salts).join(ranges, "shard").withColumn("out", out).filter("out > 0")
        after = cut(moved(cells, going), "moved")
        discard(cells)
        cells, count = after, held(after)
    # a group's rows by their rank: its shards in order take as many as they have counted; a large group is joined in pieces
    low = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    piece = F.expr(f"explode(sequence(low div {PIECE}L, (low + n - 1) div {PIECE}L))")
    places = cells.withColumn("low", low).select("group", "shard", "low", F.col("n").alias("together"), piece.alias("piece"))
    at = ranked(linked, ["group"], ["row_id"], "rank", salts_for(capacity)).withColumn("piece", F.expr(f"rank div {PIECE}L"))
    placed = at.join(places, ["group", "piece"]).filter("rank >= low and rank < low + together").select("row_id", "shard", "group", "together")
    # rows without links fill the shards up to their targets
    upto, shard = 0, F.lit(shards - 1)
    ends = []
    for n, t in zip(count, target, strict=True):
        upto += t - n
        ends.append(upto)
    for j in range(shards - 2, -1, -1):
        shard = F.when(F.col("rank") < ends[j], j).otherwise(shard)
    loose = ranked(own.filter(F.col("group").isNull()).select("row_id", F.xxhash64("row_id").alias("key"), F.lit(0).alias("one")), ["one"], ["key", "row_id"], "rank", salts)
    return cut(placed.union(loose.select("row_id", shard.cast("int"), F.lit(None).cast("long"), F.lit(1).cast("long"))), "placed")


def shard(docs: DataFrame, shards: int = 40, rounds: int = 12) -> DataFrame:
    """Return (doc_id, size, text_crc32, shard, slot): one row per row of ``docs``; counts differ by one at most.

    Equal texts are linked; a null text counts as an empty one. Null and
    repeated ids are dealt like any other row, and an empty table gives no rows.
    A text's length does not matter here. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("link"))
    own = cut(own, "rows")
    own = cut(own.withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    placed = propagate(own.select("row_id", "link"), shards, rounds)
    out = own.join(placed, "row_id")
    return ranked(out, ["shard"], ["row_id"], "slot", salts_for(max(1, own.count() // shards))).select("doc_id", "size", "text_crc32", "shard", "slot", "link")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
