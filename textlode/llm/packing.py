"""Best-fit packing of token pieces into sequences by large-item matching.

Lengths are whole numbers up to the capacity, so that a corpus of any size is a
histogram of at most ``capacity`` lengths. The plan is made on that histogram:
pieces above a third of the capacity are matched greedily, the longest with the
longest that still fits, so at most two meet in a sequence; shorter pieces, in
falling order, go to the fullest sequence that has room. Equal sequences are
handled as ranges of numbers, so the plan's size depends on the capacity alone.
Each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm._common import cut, ranked, salts_for, tidy


@functools.cache
def _encoder(path: str):
    """The ids that the tokenizer file gives a text without added special tokens.

    The file's byte-level vocabulary, whose ids follow the order of the merges,
    is run by the faster library; a text that holds a special token's string, or
    a run of white space too long for it, goes to the file's own library.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    slow = Tokenizer.from_file(path)
    special = [x["content"] for x in model.get("added_tokens", [])]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    # what the file must say for the faster library's pattern and vocabulary to be its own
    if model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or model.get("normalizer"):
        raise ValueError(f"{path} does not split texts by the byte-level pattern without normalising them")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return fast.encode_to_numpy(text).astype("<u4")
            except ValueError:  # its pattern tries a run of white space from the end, to a depth that has a limit
                pass
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, ids: bool = True) -> DataFrame:
    """Return (doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut where longer than ``capacity``.

    Pieces are ``capacity`` long, but for the first, which takes the rest. A
    null text is an empty one. ``ids`` leaves out the ids where only their
    places and digests are wanted.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    path = path or vocabulary()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                all_ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(all_ids)
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(all_ids[a:b].tobytes()))
                    if ids:
                        parts.append(all_ids[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces in a sequence, first offset) in order of rank."""
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: ranges of sequences (first, count)
    out: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
    made = 0
    used = dict.fromkeys(histogram, 0)

    def place(length: int, first: int, bins: int, each: int, room: int) -> None:
        out[length].append((used[length], first, each, capacity - room))
        used[length] += bins * each

    left = {n: c for n, c in histogram.items() if 3 * n > capacity}
    lengths = sorted(left, reverse=True)
    for n in lengths:
        while left[n]:
            mate = next((m for m in lengths if m <= capacity - n and left[m] and (m != n or left[m] > 1)), None)
            bins = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            place(n, made, bins, 1, capacity)
            left[n] -= bins
            room = capacity - n
            if mate is not None:
                place(mate, made, bins, 1, room)
                left[mate] -= bins
                room -= mate
            rooms.setdefault(room, []).append((made, bins))
            made += bins
    for n in sorted((n for n in histogram if 3 * n <= capacity), reverse=True):
        todo = histogram[n]
        for room in sorted(r for r in rooms if r >= n):
            each = room // n
            ranges = rooms.pop(room)
            while ranges and todo:
                first, bins = ranges.pop()
                full = min(bins, todo // each)
                if full:
                    place(n, first, full, each, room)
                    rooms.setdefault(room - each * n, []).append((first, full))
                    todo -= full * each
                if full < bins:
                    rest, first = bins - full, first + full
                    if todo:
                        place(n, first, 1, todo, room)
                        rooms.setdefault(room - todo * n, []).append((first, 1))
                        todo, rest, first = 0, rest - 1, first + 1
                    if rest:
                        ranges.append((first, rest))
            if ranges:
                rooms.setdefault(room, []).extend(ranges)
            if not todo:
                break
        if todo:
            each = capacity // n
            full, over = divmod(todo, each)
            for bins, k in ((full, each), (1, over)):
                if bins and k:
                    place(n, made, bins, k, capacity)
                    rooms.setdefault(capacity - k * n, []).append((made, bins))
                    made += bins
    return {n: np.array(sorted(rows), dtype=np.int64).reshape(-1, 4) for n, rows in out.items()}


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add (sequence_id, offset) to pieces with a ``length`` from 1 to ``capacity``.

    The histogram that goes to the driver, and the plan that comes back, hold at
    most ``capacity`` lengths. Repeated rows are packed as often as they occur.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places = plan(counts, capacity)
    order = ["doc_id", "piece"]
    placed = ranked(pieces, ["length"], order, "rank", salts_for(max(counts.values(), default=1)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = length == n
                rows = places[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + inside // row[:, 2]
                offset[at] = row[:, 3] + inside % row[:, 2] * n
            kept = [(c, n) for c, n in zip(batch.columns, names, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), pa.array(sequence), pa.array(offset)], names=[*(n for _, n in kept), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return placed.select(*pieces.columns, "rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    Return (doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset).
    Null and empty texts are the single ``end_id``. Null ids are packed, too;
    repeated rows are packed as often as they occur. Other columns are ignored.
    """
    return assign(cut(cut_pieces(docs, capacity, end_id, path, ids), "pieces"), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
