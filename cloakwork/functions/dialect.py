"""Expressions in SQL text for Spark and, for comparison, for DuckDB.

Long chains of patterns are written once, against this small set of functions, and parsed
by Spark in one call instead of being put together function by function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloakwork.functions import js
from cloakwork.sources import tables

#: Tables of short files whose rows meet long chains of patterns.
DEAR = ("part", "pages")


class Spark:
    def table(self, name: str) -> str:
        return f"cloakwork_{name}"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def pattern(self, p: str) -> str:
        return self.lit(js.java(p, True))

    def match(self, x: str, p: str) -> str:
        return f"({x} rlike {self.pattern(p)})"

    def sub(self, x: str, p: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.lit(by.replace('@1', '$1'))})"

    def sub_first(self, x: str, p: str, by: str = "") -> str:
        q = self.pattern(p)
        return f"case when regexp_instr({x}, {q}) = 0 then {x} else concat(substr({x}, 1, regexp_instr({x}, {q}) - 1), {self.lit(by)}, substr({x}, regexp_instr({x}, {q}) + length(regexp_extract({x}, {q}, 0)))) end"

    def extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {g})"

    def extract_all(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, {g})"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.pattern(p)})"

    def filter(self, xs: str, v: str, test: str) -> str:
        return f"filter({xs}, {v} -> {test})"

    def transform(self, xs: str, v: str, f: str) -> str:
        return f"transform({xs}, {v} -> {f})"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def has(self, xs: str, x: str) -> str:
        return f"array_contains({xs}, {x})"

    def word_in(self, w: str, t: str) -> str:
        """Is the word of a column in the text as a whole word. A pattern made at run time is compiled for each row, so
        texts without the word are spared it."""
        return f"(contains(lower({t}), lower({w})) and {t} rlike concat('(?i)', {self.lit(js.BOUNDARY)}, '\\\\Q', {w}, '\\\\E', {self.lit(js.BOUNDARY)}))"

    def encode(self, x: str) -> str:
        return f"replace(url_encode({x}), '+', '%20')"

    def each(self, xs: str, name: str) -> str:
        """Rows of (i from 0, name)."""
        return f"lateral view posexplode({xs}) v as i, {name}"

    def at(self, xs: str, i: int) -> str:
        return f"get({xs}, {i})"

    def sort_join(self, xs: str) -> str:
        return f"array_join(array_sort({xs}), '|')"

    def slice(self, xs: str, start: int) -> str:
        return f"slice({xs}, {start}, greatest(size({xs}) - {start - 1}, 0))"

    def join(self, xs: str, by: str) -> str:
        return f"array_join({xs}, {self.lit(by)})"

    def let(self, name: str, x: str, body: str) -> str:
        """The body, in which the name stands for x. However often it does, x is there once: a name of a nested select would
        be replaced by its whole text wherever the optimizer moves a filter below the select."""
        return f"get(transform(array({x}), {name} -> {body}), 0)"


class Duck(Spark):
    def table(self, name: str) -> str:
        return name

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def pattern(self, p: str) -> str:
        return self.lit("(?i)" + p)

    def match(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pattern(p)})"

    def sub(self, x: str, p: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.lit(by.replace('@1', chr(92) + '1'))}, 'g')"

    def sub_first(self, x: str, p: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.lit(by)})"

    def split(self, x: str, p: str) -> str:
        return f"string_split_regex({x}, {self.pattern(p)})"

    def filter(self, xs: str, v: str, test: str) -> str:
        return f"list_filter({xs}, lambda {v}: {test})"

    def transform(self, xs: str, v: str, f: str) -> str:
        return f"list_transform({xs}, lambda {v}: {f})"

    def size(self, xs: str) -> str:
        return f"cast(len({xs}) as int)"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def has(self, xs: str, x: str) -> str:
        return f"list_contains({xs}, {x})"

    def word_in(self, w: str, t: str) -> str:
        return f"regexp_matches({t}, '(?i)\\b' || regexp_escape({w}) || '\\b')"

    def encode(self, x: str) -> str:
        return f"url_encode({x})"

    def each(self, xs: str, name: str) -> str:
        return f", lateral (select unnest({xs}) as {name}, unnest(generate_series(0, len({xs}) - 1)) as i) v"

    def at(self, xs: str, i: int) -> str:
        return f"({xs})[{i + 1}]"

    def sort_join(self, xs: str) -> str:
        return f"array_to_string(list_sort({xs}), '|')"

    def slice(self, xs: str, start: int) -> str:
        return f"({xs})[{start}:]"

    def join(self, xs: str, by: str) -> str:
        return f"array_to_string({xs}, {self.lit(by)})"

    def let(self, name: str, x: str, body: str) -> str:
        return f"list_transform([{x}], lambda {name}: {body})[1]"


def words(d: Spark, ws) -> str:
    return "(" + ", ".join(map(d.lit, ws)) + ")"


def trim(d: Spark, x: str) -> str:
    return d.sub(x, r"^\s+|\s+$")


def chain(d: Spark, x: str, *steps: tuple[str, str] | str) -> str:
    """Replacements one after the other; a plain pattern is removed."""
    for step in steps:
        p, by = (step, "") if isinstance(step, str) else step
        x = d.sub(x, p, by)
    return x


def values(d: Spark, columns: str, rows) -> str:
    cell = lambda v: "cast(null as string)" if v is None else ("true" if v is True else "false" if v is False else d.lit(v) if isinstance(v, str) else str(v))
    return f"(select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as t({columns}))"


def query(make: Callable[[Spark], str], *names: str):
    """A query over the named tables from SQL text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in names:
            rows = tables.dealt(spark, sf_dir, t) if t in DEAR else spark.read.parquet(f"{sf_dir}/{t}.parquet")
            rows.createOrReplaceTempView(f"cloakwork_{t}")
        return spark.sql(make(Spark()))

    return run
