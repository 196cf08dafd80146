"""Attribute selectors as data: parsed once, then tested on a node or compiled to a column.

A selector is a tag, tests of attributes, and at most one ancestor ("header input"). There are
no other combinators.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Test(NamedTuple):
    attribute: str
    op: str
    value: str
    any_case: bool
    negated: bool


class Selector(NamedTuple):
    tag: str | None
    tests: tuple[Test, ...]
    within: Selector | None = None


_PIECE = re.compile(r"""(?P<tag>^[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|(?P<not>:not\()?\[(?P<name>[\w-]+)\s*(?:(?P<op>[~*^$]?=)\s*(?P<quote>['"]?)(?P<value>.*?)(?P=quote)\s*(?P<case>\bi)?)?\](?(not)\))""")


def _compound(text: str) -> Selector:
    tag, tests, at = None, [], 0
    if text == "*":
        return Selector(None, ())
    for m in _PIECE.finditer(text):
        if m.start() != at:
            raise ValueError(f"not a selector: {text}")
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
        elif m["id"]:
            tests.append(Test("id", "=", m["id"], False, False))
        elif m["class"]:
            tests.append(Test("class", "~=", m["class"], False, False))
        else:
            tests.append(Test(m["name"].lower(), m["op"] or "", m["value"] or "", bool(m["case"]), bool(m["not"])))
    if at != len(text) or not text:
        raise ValueError(f"not a selector: {text}")
    return Selector(tag, tuple(tests))


def _cut(text: str, by: str) -> list[str]:
    """The parts of a text between separators that stand in no brackets and quotes."""
    bracket = r"""\[(?:[^\]"']|"[^"]*"|'[^']*')*\]"""
    if not re.fullmatch(rf"(?:{bracket}|[^\[\]])*", text):
        raise ValueError(f"not a selector: {text}")
    return [p.strip() for p in re.findall(rf"(?:{bracket}|[^\[{by}])+", text) if p.strip()]


def parse(text: str) -> tuple[Selector, ...]:
    """The selectors of a list, in order."""
    out = []
    for one in _cut(text, ","):
        *outer, last = map(_compound, _cut(one, " "))
        if len(outer) > 1:
            raise ValueError(f"more than one ancestor: {one}")
        out.append(last._replace(within=outer[0]) if outer else last)
    return tuple(out)


def holds(selector: Selector, tag: str, attributes: dict[str, str]) -> bool:
    """Does a node of the tag and attributes meet the selector, its ancestor aside."""
    if selector.tag not in (None, tag):
        return False
    for name, op, value, any_case, negated in selector.tests:
        got = attributes.get(name)
        if got is not None and any_case:
            got, value = got.lower(), value.lower()
        met = got is not None and (
            not op or (op == "=" and got == value) or (op == "*=" and value != "" and value in got) or (op == "^=" and value != "" and got.startswith(value)) or (op == "$=" and value != "" and got.endswith(value)) or (op == "~=" and value in got.split())
        )
        if met == negated:
            return False
    return True


class Matcher:
    """Which of several lists of selectors a node meets, as bits. A selector is only tried on nodes that have an
    attribute which it asks for, or its tag."""

    def __init__(self, lists: tuple[tuple[Selector, ...], ...]) -> None:
        self.plain: dict[str, int] = {}
        self.known: dict = {}
        self.shapes: dict = {}
        self.held = 0
        self.tried: dict[str, list[tuple[int, Selector]]] = {}
        for bit, ways in enumerate(lists):
            for one in ways:
                asked = next((t.attribute for t in one.tests if not t.negated), None)
                if asked is None and not one.tests and one.tag:
                    self.plain[one.tag] = self.plain.get(one.tag, 0) | 1 << bit
                else:
                    self.tried.setdefault(f"[{asked}" if asked else one.tag or "", []).append((1 << bit, one))

    def bits(self, tag: str, attributes: dict[str, str]) -> int:
        found = self.plain.get(tag, 0)
        for key in ("", tag, *(f"[{a}" for a in attributes)) if attributes else ("", tag):
            for bit, one in self.tried.get(key, ()):
                if not found & bit and holds(one, tag, attributes):
                    found |= bit
        return found


def column(selector: Selector, tag: Column, attributes: Column) -> Column:
    """The same of columns."""
    tests = [F.lit(True) if selector.tag is None else tag == selector.tag]
    for name, op, value, any_case, negated in selector.tests:
        got, value = attributes[name], F.lit(value.lower() if any_case else value)
        got = F.lower(got) if any_case else got
        if not op:
            met = got.isNotNull()
        elif op == "=":
            met = got == value
        elif op == "~=":
            met = F.array_contains(F.split(got, r"\s+"), value)
        else:
            met = {"*=": F.contains, "^=": F.startswith, "$=": F.endswith}[op](got, value) & (value != "")
        met = F.coalesce(met, F.lit(False))
        tests.append(~met if negated else met)
    return reduce(Column.__and__, tests)
