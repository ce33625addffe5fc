"""Cross-document line frequency, with DataFrame functions alone.

Lines are normalised and hashed, the documents of a host (the source) that hold
a line are counted, lines held by too many are removed, and documents of which
too little is left are rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm._common import SPACE, cut

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def features(docs: DataFrame) -> DataFrame:
    """Per row: word and line counts, and for each line with a word its normalised hash and number of words.

    Repeated windows are found by sorting: the high bits of a window's hash over
    its place in the text, one long for each window, so that equal windows meet.
    The words of windows that meet are compared; should any differ, the windows
    themselves are sorted.
    """
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("t"))
    split = text.select(
        "doc_id",
        "host",
        "t",
        F.expr(rf"filter(split(t, r'[{SPACE}]+'), w -> w != '')").alias("words"),
        F.expr(rf"filter(split(t, '\n'), l -> l rlike r'[^{SPACE}]')").alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        "host",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.expr("cast(length(t) - length(translate(t, '%s', '')) as long)" % SYMBOLS).alias("n_symbols"),
        F.expr(r"cast(length(translate(t, ' \t\n\u000B\u000C\r', '')) as long)").alias("word_chars"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr(rf"transform(lines, l -> lower(trim(regexp_replace(l, r'[{SPACE}]+', ' '))))").alias("norm"),
        F.expr("if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> shiftrightunsigned(xxhash64(words[i], words[i + 1], words[i + 2]), 2)))").alias("windows"),
    )
    placed = hashed.withColumn("n", F.size("windows").cast("long")).withColumn("ordered", F.expr("sort_array(transform(windows, (h, i) -> h - h % n + i))"))
    again = placed.withColumn("at", F.expr("sort_array(transform(filter(ordered, (x, k) -> coalesce(get(ordered, k + 1) div n = x div n, false) or coalesce(get(ordered, k - 1) div n = x div n, false)), x -> x % n))"))
    met = "filter(transform(ordered, (x, k) -> if(coalesce(get(ordered, k + 1) div n = x div n, false), struct(cast(x % n as int) as a, cast(ordered[k + 1] % n as int) as b), null)), p -> p is not null)"
    differ = " or ".join(f"words[p.a + {o}] <> words[p.b + {o}]" for o in range(3))
    again = again.withColumn("clash", F.expr(f"size(at) > 0 and exists({met}, p -> {differ})"))
    sorted_windows = "sort_array(transform(sequence(0, cast(n as int) - 1), i -> struct(words[i] as a, words[i + 1] as b, words[i + 2] as c, cast(i as long) as i)))"
    same = lambda k: f"coalesce(struct(get(v, {k}).a, get(v, {k}).b, get(v, {k}).c) = struct(x.a, x.b, x.c), false)"
    exactly = f"sort_array(transform(transform(array({sorted_windows}), v -> filter(v, (x, k) -> {same('k + 1')} or {same('k - 1')}))[0], x -> x.i))"
    again = again.withColumn("at", F.expr(f"if(clash, {exactly}, at)"))
    return again.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.expr("aggregate(transform(at, (x, k) -> least(3L, coalesce(get(at, k + 1) - x, 3L))), 0L, (a, b) -> a + b)").alias("n_repeat_words"),
        F.expr("transform(norm, l -> struct(xxhash64(l) as h, length(l) - length(replace(l, ' ', '')) + 1 as w))").alias("lines"),
    )


def judge(docs: DataFrame, share: float = 0.05, least: int = 10, left: float = 0.5) -> DataFrame:
    """Return (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed, kept): a row per row of ``docs``.

    A line is over the limit when more than ``share`` of a host's documents, and
    more than ``least`` of them, hold it. A document is rejected when the words
    left without such lines are fewer than ``left`` of its words, or when the
    base rules fail: under 50 words, or over half of them in repeated windows.

    A null text has no words; a null source and an empty one are the same host. Null and
    repeated ids are rows like any other: rows, not ids, count as documents.
    Other columns are ignored; an empty table gives no rows.
    """
    found = cut(features(docs).withColumn("row", F.monotonically_increasing_id()), "features")
    hosts = found.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    held = found.select("host", F.explode(F.expr("array_distinct(transform(lines, l -> l.h))")).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    # a line must first be over the part of the limit that needs no join
    over = held.filter(F.col("n") > least).join(hosts, "host").filter(F.col("n") > share * F.col("docs")).select("host", "h")
    over = cut(over, "over")
    lines = found.select("row", "host", F.explode("lines").alias("l")).select("row", "host", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    removed = lines.join(over, ["host", "h"]).groupBy("row").agg(F.sum("w").cast("long").alias("n_removed_words"))
    out = found.join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = F.col("n_words") - F.col("n_removed_words") >= left * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", failed.alias("base_failed"), (~failed & enough).alias("kept"))


def op6_line_frequency(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB, over the same tables.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
), again AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) > 1
), rep AS (
  SELECT r, count(DISTINCT i + o) AS n FROM again, unnest([0, 1, 2]) AS u(o) GROUP BY r
), l AS (
  SELECT r, host, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS x FROM (SELECT r, host, unnest(ls) AS x FROM w)
), hosts AS (
  SELECT host, count(*) AS docs FROM d GROUP BY host
), over AS (
  SELECT l.host, x FROM l JOIN hosts USING (host) GROUP BY l.host, x HAVING count(DISTINCT r) > 10 AND count(DISTINCT r) > 0.05 * max(docs)
), removed AS (
  SELECT r, sum(len(string_split(l.x, ' '))) AS n FROM l JOIN over USING (host, x) GROUP BY r
), f AS (
  SELECT doc_id, len(ws) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN removed USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_removed_words::BIGINT AS n_removed_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM f
"""
