"""Language identification by compression with a raw-content zstandard dictionary for each language.

A text costs fewest bytes with the dictionary of its own language. Where the
next language costs hardly more, the margin is narrow and the text is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlode.llm._common import held_out, tidy

#: The label of texts without a letter.
NONE = "und"
#: Share of the second cost by which the best must lie under it, in texts long enough to be measured in whole bytes; in shorter ones only ties are narrow.
MARGIN, TIE = 0.02, 1e-4


def learn(docs: DataFrame, rows: int = 400, size: int = 1 << 17) -> dict[str, bytes]:
    """Dictionaries by language from documents that are not held out and have a language.

    The sample is bounded: of each language, about ``rows`` documents whose
    draw is lowest, whole, and at most ``size`` bytes of them in the dictionary.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counted = {r[0]: r[1] for r in counts.collect()}
    if not counted:
        return {}
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 1.5 * rows / n))) for k, n in counted.items()))
    drawn = known.withColumn("draw", draw).filter(F.col("draw") < share)
    in_order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    before = F.sum(F.octet_length("text")).over(in_order) - F.octet_length("text")
    sample = drawn.withColumn("n", F.row_number().over(in_order)).withColumn("before", before).filter((F.col("n") <= rows) & (F.col("before") < size))
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for lang, n, text in sample.select("lang", "n", "text").collect():
        parts.setdefault(lang, []).append((n, prepared(text)))
    return {k: b"".join(t for _, t in sorted(v))[-size:] for k, v in sorted(parts.items())}


def _compressors(dictionaries: dict[str, bytes], level: int):
    import zstandard as z

    out = []
    for name, data in dictionaries.items():
        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((name, z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)))
    return out


#: Marks around a word, and what parts the letters of one.
_AROUND = ".,;:!?%$#&*()|\"'<>[]"
_BETWEEN = re.compile(r"[\W\d_]+")


def prepared(text: str) -> bytes:
    """What is compressed: the lower-cased letters of the whole text, without words that hold a digit."""
    words: list[str] = []
    for word in text.lower().split():
        word = word.strip(_AROUND)
        if word.isalpha():
            words.append(word)
        elif word and not any(map(str.isdigit, word)):
            words += _BETWEEN.split(word)
    return b"\n" + " ".join(words).encode() + b"\n"


def phrases(data: bytes, dictionary: bytes) -> int:
    """Number of phrases when ``data`` is parsed greedily into the longest strings that the dictionary holds."""
    at = count = 0
    while at < len(data):
        n = 1
        while at + n < len(data) and data[at : at + n + 1] in dictionary:
            n += 1
        at += n
        count += 1
    return count


def judge(text: str, compressors, thorough, dictionaries: dict[str, bytes], has_letter, margin: float, short: int = 256) -> tuple[str, float, bool]:
    """(language, score, rejected) of a text.

    The cost is the compressed size. Few bytes leave ties, as a block that does
    not shrink is stored raw, so texts under ``short`` bytes are compressed at a
    more ``thorough`` level, and add their phrases in the dictionary as a
    fraction of a byte; there the margin is that of a tie at most.
    """
    if not compressors or not has_letter(text):
        return NONE, 0.0, True
    data = prepared(text)
    costs = [(len(c.compress(data)), name) for name, c in (thorough if len(data) < short else compressors)]
    if len(data) < short:
        costs = [(n + phrases(data, dictionaries[name]) / (2 * short), name) for n, name in costs]
    costs.sort()
    best = costs[0][0]
    score = 1.0 / sum(math.exp((best - n) / 2.0) for n, _ in costs)
    least = min(margin, TIE) if len(data) < short else margin
    narrow = len(costs) > 1 and costs[1][0] - best < least * costs[1][0]
    return costs[0][1], score, narrow


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, level: int = 6) -> DataFrame:
    """Return the rows of ``docs`` with lang_pred, score (0 to 1) and rejected.

    ``und``, score 0 and rejected if the text is null or has no letter, or no
    language was learned. Equal costs go to the first name, and are rejected.
    Columns named lang_pred, score or rejected are replaced.
    """
    out = ["lang_pred", "score", "rejected"]
    columns = [c for c in docs.columns if c not in out]

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        has_letter = regex.compile(r"\p{L}").search
        compressors, thorough = (_compressors(dictionaries, n) for n in (level, max(level, 12)))
        for texts in batches:
            found = [(NONE, 0.0, True) if t is None else judge(t, compressors, thorough, dictionaries, has_letter, margin) for t in texts.to_pylist()]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=out)

    udf = F.arrow_udf(run, "lang_pred string, score double, rejected boolean")
    return docs.select(*columns).withColumn("__found", udf("text")).select(*columns, *(F.col(f"__found.{c}").alias(c) for c in out))


def identify(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Learn from the rows that are not held out and predict all rows of ``docs``."""
    return predict(docs, learn(docs), margin)


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
