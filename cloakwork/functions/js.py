"""Regular expressions and strings with the semantics of ECMAScript, on Spark columns.

Java's ``\\b`` knows letters of all scripts and its ``\\s`` only ASCII; ECMAScript has it the
other way round. ``java`` rewrites a pattern so that both mean what ECMAScript says; ``re2``
leaves a pattern for DuckDB, whose ``\\b`` is ASCII too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's own word class, of ASCII alone: one look into a table, where a class of ranges is asked range by range.
_W = r"\w"
BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
SPACES = r"\s   -     　﻿"
#: The same characters one by one.
WHITE = "".join(c for c in map(chr, range(1 << 16)) if c in " \t\n\v\f\r" or (ord(c) > 127 and re.match(f"[{SPACES}]", c, re.A)))
#: A class without white space that a match must begin with, also within a group that is repeated.
_NEXT = re.compile(r"(?:\(\?:(?=\\d\{\d\}[^()|]*\)\{[1-9]))?(?:\[((?:[^\]\\]|\\[^s])+)\]|(\\d))(?![*?]|\{0)")


def java(pattern: str, ignore_case: bool = False) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            if two == "\\b" and not inside:
                # Next to a letter or a group of words the test of one side is enough.
                word = re.match(r"\\b(?:\(\?:)?[A-Za-z]", pattern[i:]) or re.match(r"\\b\((?:\?:)?[A-Za-z]", pattern[i:])
                # Before a class that must follow, the class is looked for first: it spares most places the test of both sides.
                ahead = _NEXT.match(pattern, i + 2)
                out.append(f"(?=[{ahead[1] or ahead[2]}])" if ahead else "")
                out.append(f"(?<!{_W})" if word and i == 0 else BOUNDARY)
            elif two == "\\s":
                out.append(SPACES if inside else f"[{SPACES}]")
            else:
                out.append(two)
            i += 2
            continue
        if two[0] == "[" and not inside:
            inside = True
        elif two[0] == "]":
            inside = False
        out.append(two[0])
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(java(pattern, ignore_case))


def replace(c: Column, pattern: str, by: str = "", ignore_case: bool = False) -> Column:
    return F.regexp_replace(c, F.lit(java(pattern, ignore_case)), F.lit(by))


def replace_first(c: Column, pattern: str, by: str = "", ignore_case: bool = False) -> Column:
    """ECMAScript's replace without the g flag, for replacements without groups."""
    p = java(pattern, ignore_case)
    at = F.regexp_instr(c, F.lit(p))
    found = F.regexp_extract(c, p, 0)
    return F.when(at == 0, c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.lit(by), F.substring(c, at + F.length(found), F.length(c))))


def extract_all(c: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern, ignore_case)), F.lit(group))


def extract(c: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """The group of the first match; empty if there is none."""
    return F.regexp_extract(c, java(pattern, ignore_case), group)


def trim(c: Column) -> Column:
    """Trims white space of all scripts, as ECMAScript's trim does. A pattern would be tried at each of the text's places."""
    return F.btrim(c, F.lit(WHITE))


def literal(c: Column) -> Column:
    """A pattern, made at run time, that matches the string itself."""
    return F.regexp_replace(c, F.lit(r"([.*+?^${}()|\[\]\\])"), F.lit(r"\\$1"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, F.lit("[^0-9]"), F.lit(""))


def half_up(c: Column) -> Column:
    """Math.round."""
    return F.floor(c + F.lit(0.5))


def some(c: Column) -> Column:
    """Null for an empty string, as || treats it."""
    return F.when(c != "", c)


def once(value: Column, f) -> Column:
    """f of a value that is computed once for a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
