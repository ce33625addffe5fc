"""Spark and DuckDB spellings of the few constructs the signals are written in.

A signal is one expression; a plan is a list of stages of named expressions.
Spark runs a stage as a projection; DuckDB, which the tests compare against,
as a common table expression.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Python's str methods see it, as the inside of a regex class.
BLANK = r"\s\x1c-\x1f"

Stage = dict[str, str]


def escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_ " or ord(c) > 127 else "\\" + c for c in text)


def bounded(marker: str) -> str:
    """A marker with a word boundary at each end that is a word character."""
    start, end = (r"\b" if c.isalnum() or c == "_" else "" for c in (marker[0], marker[-1]))
    return start + escaped(marker) + end


def any_of(markers: Iterable[str], bound: bool = True, longest_first: bool = True) -> str:
    parts = [bounded(m) if bound else escaped(m) for m in markers]
    return "(?:" + "|".join(sorted(parts, key=len, reverse=True) if longest_first else parts) + ")"


def keys(markers: Iterable[str]) -> list[str]:
    """For each marker, a lower-case run of letters and digits without which it cannot occur."""
    import re

    return sorted({max(re.findall("[a-z0-9]+", m.lower()), key=len) for m in markers})


class Spark:
    name = "spark"

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def regex(self, pattern: str, fold: bool = False, lines: bool = False) -> str:
        flags = "(?" + "i" * fold + "m" * lines + "dU)"
        return self.text(flags + pattern.replace(r"[\s", "[" + BLANK))

    @staticmethod
    def narrow(pattern: str) -> str:
        r"""The pattern with \b at ASCII words only, which is all that DuckDB knows."""
        return pattern.replace(r"\b", "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")

    def count(self, x: str, pattern: str, fold: bool = False, lines: bool = False) -> str:
        return f"regexp_count({x}, {self.regex(pattern, fold, lines)})"

    def has(self, x: str, pattern: str, fold: bool = False, lines: bool = False) -> str:
        return f"({x} rlike {self.regex(pattern, fold, lines)})"

    def replace(self, x: str, pattern: str, by: str, fold: bool = False, lines: bool = False) -> str:
        return f"regexp_replace({x}, {self.regex(pattern, fold, lines)}, {self.text(by)})"

    def split(self, x: str, pattern: str, lines: bool = False) -> str:
        return f"split({x}, {self.regex(pattern, lines=lines)})"

    def find_all(self, x: str, pattern: str, group: int = 0, lines: bool = False) -> str:
        return f"regexp_extract_all({x}, {self.regex(pattern, lines=lines)}, {group})"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.regex(pattern)}, {group})"

    @staticmethod
    def each(array: str, body: str, i: bool = False) -> str:
        return f"transform({array}, {'(x, ix)' if i else 'x'} -> {body})"

    @staticmethod
    def keep(array: str, body: str, i: bool = False) -> str:
        return f"filter({array}, {'(x, ix)' if i else 'x'} -> {body})"

    @staticmethod
    def size(array: str) -> str:
        return f"size({array})"

    @staticmethod
    def slice(array: str, start: str, n: str) -> str:
        return f"slice({array}, {start} + 1, {n})"

    @staticmethod
    def steps(last: str, step: int = 1) -> str:
        """0, step, ... up to and with last; none below 0."""
        return f"if({last} < 0, cast(array() as array<int>), sequence(0, greatest({last}, 0), {step}))"

    @staticmethod
    def at(array: str, i: str) -> str:
        return f"get({array}, {i})"

    @staticmethod
    def distinct(array: str) -> str:
        return f"array_distinct({array})"

    @staticmethod
    def sorted(array: str) -> str:
        return f"sort_array({array})"

    @staticmethod
    def total(array: str) -> str:
        return f"aggregate({array}, 0D, (p, q) -> p + q)"

    @staticmethod
    def joined(array: str, by: str = " ") -> str:
        return f"array_join({array}, '{by}')"

    @staticmethod
    def both(a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    @staticmethod
    def either(a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def words(self, items: Iterable[str]) -> str:
        return "array(" + ", ".join(self.text(x) for x in items) + ")"

    def in_words(self, x: str, items: Iterable[str]) -> str:
        return f"({x} in (" + ", ".join(self.text(i) for i in items) + "))"

    @staticmethod
    def gram(array: str, i: str, n: int) -> str:
        """What n neighbours have in common only with equal ones: a 64-bit hash."""
        return "xxhash64(" + ", ".join(f"{array}[{i} + {k}]" for k in range(n)) + ")"

    @staticmethod
    def in_repeats(sorted_array: str) -> str:
        """How many elements of a sorted array have an equal neighbour."""
        return f"size(filter({sorted_array}, (x, i) -> coalesce(get({sorted_array}, i - 1) = x, false) or coalesce(get({sorted_array}, i + 1) = x, false)))"

    @staticmethod
    def repeated_values(sorted_array: str) -> str:
        return f"size(filter({sorted_array}, (x, i) -> coalesce(get({sorted_array}, i + 1) = x, false) and not coalesce(get({sorted_array}, i - 1) = x, false)))"

    @staticmethod
    def longest_run(sorted_array: str) -> str:
        run = "if(x = a.p, a.r + 1, 1)"
        return f"aggregate({sorted_array}, struct('' as p, 0 as r, 0 as b), (a, x) -> struct(x as p, {run} as r, greatest(a.b, {run}) as b), a -> a.b)"

    @staticmethod
    def gate(tokens: str, needed: Iterable[str]) -> str:
        return f"arrays_overlap({tokens}, array({', '.join(repr(k) for k in needed)}))"

    @staticmethod
    def occurrences(x: str, chars: str) -> str:
        return f"(length({x}) - length(translate({x}, {Spark.text(chars)}, '')))"

    @staticmethod
    def double(x: str) -> str:
        return f"cast({x} as double)"

    @staticmethod
    def fold_flags(pieces: str, joins: str) -> str:
        """Walk over pieces (f, s) with the end t of what was joined so far; a 1 or 0 for each piece."""
        body = f"struct(right(if({joins}, concat(a.t, ' ', x.s), x.s), 12) as t, concat(a.g, if({joins}, '1', '0')) as g)"
        return f"aggregate({pieces}, struct('' as t, '' as g), (a, x) -> {body}, a -> a.g)"

    @staticmethod
    def piece(first: str, s: str) -> str:
        return f"struct({first} as f, {s} as s)"

    @staticmethod
    def flat(array: str) -> str:
        return f"flatten({array})"

    @staticmethod
    def bind(value: str, body: str) -> str:
        """body over v, which is computed once."""
        return f"transform(array({value}), v -> {body})[0]"


class Duck(Spark):
    name = "duckdb"

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def regex(self, pattern: str, fold: bool = False, lines: bool = False) -> str:
        flags = "i" * fold + "m" * lines
        wide = r"\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
        return self.text((f"(?{flags})" if flags else "") + pattern.replace(r"[\s", "[" + wide).replace(r"[^\s", "[^" + wide))

    @staticmethod
    def narrow(pattern: str) -> str:
        return pattern

    def count(self, x: str, pattern: str, fold: bool = False, lines: bool = False) -> str:
        return f"len(regexp_extract_all({x}, {self.regex(pattern, fold, lines)}))"

    def has(self, x: str, pattern: str, fold: bool = False, lines: bool = False) -> str:
        return f"regexp_matches({x}, {self.regex(pattern, fold, lines)})"

    def replace(self, x: str, pattern: str, by: str, fold: bool = False, lines: bool = False) -> str:
        return f"regexp_replace({x}, {self.regex(pattern, fold, lines)}, {self.text(by.replace('$', chr(92)))}, 'g')"

    def split(self, x: str, pattern: str, lines: bool = False) -> str:
        return f"string_split_regex({x}, {self.regex(pattern, lines=lines)})"

    @staticmethod
    def each(array: str, body: str, i: bool = False) -> str:
        body = _shifted(body) if i else body
        return f"list_transform({array}, lambda {'x, i1' if i else 'x'}: {body})"

    @staticmethod
    def keep(array: str, body: str, i: bool = False) -> str:
        body = _shifted(body) if i else body
        return f"list_filter({array}, lambda {'x, i1' if i else 'x'}: {body})"

    @staticmethod
    def size(array: str) -> str:
        return f"len({array})"

    @staticmethod
    def slice(array: str, start: str, n: str) -> str:
        return f"({array})[({start}) + 1 : ({start}) + ({n})]"

    @staticmethod
    def steps(last: str, step: int = 1) -> str:
        return f"range(0, greatest({last} + 1, 0), {step})"

    @staticmethod
    def at(array: str, i: str) -> str:
        return f"list_extract({array}, CASE WHEN ({i}) < 0 THEN NULL ELSE ({i}) + 1 END)"

    @staticmethod
    def distinct(array: str) -> str:
        return f"list_distinct({array})"

    @staticmethod
    def sorted(array: str) -> str:
        return f"list_sort({array})"

    @staticmethod
    def total(array: str) -> str:
        return f"coalesce(list_sum({array}), 0)::DOUBLE"

    @staticmethod
    def joined(array: str, by: str = " ") -> str:
        return f"array_to_string({array}, '{by}')"

    @staticmethod
    def both(a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    @staticmethod
    def either(a: str, b: str) -> str:
        return f"list_distinct(list_concat({a}, {b}))"

    def words(self, items: Iterable[str]) -> str:
        return "[" + ", ".join(self.text(x) for x in items) + "]"

    @staticmethod
    def gram(array: str, i: str, n: int) -> str:
        return " || ' ' || ".join(f"{array}[{i} + {k + 1}]" for k in range(n))

    @staticmethod
    def in_repeats(array: str) -> str:
        return f"coalesce(list_sum(list_filter(map_values(list_histogram({array})), lambda x: x > 1)), 0)"

    @staticmethod
    def repeated_values(array: str) -> str:
        return f"len(list_filter(map_values(list_histogram({array})), lambda x: x > 1))"

    @staticmethod
    def longest_run(array: str) -> str:
        return f"coalesce(list_max(map_values(list_histogram({array}))), 0)"

    @staticmethod
    def gate(tokens: str, needed: Iterable[str]) -> str:
        return "true"

    @staticmethod
    def occurrences(x: str, chars: str) -> str:
        return f"(length({x}) - length(translate({x}, {Duck.text(chars)}, '')))"

    @staticmethod
    def bind(value: str, body: str) -> str:
        return f"list_transform([{value}], lambda v: {body})[1]"

    @staticmethod
    def piece(first: str, s: str) -> str:
        return f"{{'f': {first}, 's': {s}, 't': '', 'g': ''}}"

    @staticmethod
    def fold_flags(pieces: str, joins: str) -> str:
        start = "{'f': true, 's': '', 't': '', 'g': ''}"
        body = f"{{'f': true, 's': '', 't': right(CASE WHEN {joins} THEN a.t || ' ' || x.s ELSE x.s END, 12), 'g': a.g || CASE WHEN {joins} THEN '1' ELSE '0' END}}"
        return f"list_reduce(list_prepend({start}, {pieces}), lambda a, x: {body}).g"


def _shifted(body: str) -> str:
    """DuckDB counts from 1."""
    import re

    return re.sub(r"\bix\b", "(i1 - 1)", body)


def spark_frame(df: DataFrame, stages: Iterable[Stage]) -> DataFrame:
    for stage in stages:
        df = df.withColumns({k: F.expr(v) for k, v in stage.items()})
    return df


def duck_query(source: str, stages: Iterable[Stage], final: str) -> str:
    parts, last = [f"s0 AS ({source})"], "s0"
    for n, stage in enumerate(stages, 1):
        parts.append(f"s{n} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in stage.items())} FROM {last})")
        last = f"s{n}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT {final} FROM {last}"
