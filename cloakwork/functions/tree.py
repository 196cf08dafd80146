"""Pages as trees: one pass over a page's tags with a stack of what is open.

Every node gets its parent, depth, place among siblings of its tag and its interval: nodes are
numbered in the order of their opening tags, and a node's descendants are the numbers up to its
``last``. So "is within" is a comparison, and "closest" is the nearest of the intervals around a node. A text span points into
the page's text, which is made once, so nested nodes copy nothing.

The stack is the one thing here that no built-in function of Spark can keep in linear time, so the pass
is an Arrow function over whole batches; what builds on it are columns. Void and unclosed tags, ends that
are left out, attributes in any or no quotes and character references are read as browsers read them; the
reordering of misnested formatting is not imitated.
"""

from __future__ import annotations

import gc
import html as entities
import re
import sys
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions import selectors

# How HTML closes and shows its elements.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe"))
IN_HEAD = frozenset(("title", "meta", "link", "script", "style", "base", "noscript", "template"))
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
ENDS_P = frozenset(("address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))
CELL = ("table", "td", "th", "caption")
#: What an opening tag ends, and what such an end doesn't reach beyond.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", *CELL)),
    "dt": (("dt", "dd"), ("dl", *CELL)),
    "dd": (("dt", "dd"), ("dl", *CELL)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select", "datalist")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("thead", "tbody", "tfoot", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "a": (("a",), CELL),
    "button": (("button",), CELL),
    "body": (("head",), ()),
}
P_BARRIERS = (*CELL, "button", "object")
TABLE_PARTS = frozenset(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"))

#: The common names of tags as they are, so that few are made small.
NAMES = {name: name for name in VOID | RAW | BLOCKS | ENDS_P | TABLE_PARTS | frozenset(("a", "b", "i", "span", "strong", "button", "select", "label"))}

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*(?:"[^"]*"|'[^']*'|(?!\s*["'])))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*").fullmatch
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)", re.S)

NODE = pa.struct([
    ("node", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("nth", pa.int32()), ("same", pa.int32()), ("children", pa.int32()),
    ("start", pa.int32()), ("stop", pa.int32()), ("areas", pa.int64()), ("kind", pa.int32()), ("near", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string())), ("content", pa.string()), ("selector", pa.string()),
    ("image", pa.string()), ("drawing", pa.string()), ("pictured", pa.bool_()), ("options", pa.list_(pa.struct([("value", pa.string()), ("label", pa.string()), ("selected", pa.bool_())]))),
])
RUN = pa.struct([("node", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
PAGE = pa.struct([("title", pa.string()), ("text", pa.string()), ("runs", pa.list_(RUN)), ("nodes", pa.list_(NODE))])
_DDL = (
    "struct<title:string,text:string,runs:array<struct<node:int,start:int,stop:int>>,nodes:array<struct<node:int,parent:int,last:int,depth:int,tag:string,nth:int,same:int,children:int,start:int,stop:int,areas:bigint,kind:int,near:int,"
    "attributes:map<string,string>,content:string,selector:string,image:string,drawing:string,pictured:boolean,options:array<struct<value:string,label:string,selected:boolean>>>>>"
)


class Spec(NamedTuple):
    """What a pass marks. ``areas`` are named lists of selectors: bit i of a node's ``areas`` says that it or an ancestor meets
    list i. ``kinds`` are lists of selectors, and ``kind`` is the first list, from 1, that the node meets, else 0; nodes
    of a kind have a path, pictures and options. ``near`` is the closest node, itself included, of the selectors
    ``closest``, or -1. Text of ``silent`` areas is no text of the page. Unless ``every``, only nodes of a kind are given.
    ``runs``, where asked for, are the stretches of text with the nodes that they stand in. Nodes in the areas ``around`` are given, whatever
    their kind. Without ``paths`` no node has a selector."""

    areas: tuple[tuple[str, tuple[selectors.Selector, ...]], ...] = ()
    kinds: tuple[tuple[selectors.Selector, ...], ...] = ()
    closest: tuple[selectors.Selector, ...] = ()
    silent: tuple[str, ...] = ()
    every: bool = False
    runs: bool = False
    around: tuple[str, ...] = ()
    paths: bool = True

    def matcher(self) -> selectors.Matcher:
        return selectors.Matcher((*(ways for _, ways in self.areas), *self.kinds, self.closest))

    def within(self, node: Column, area: str) -> Column:
        """Is a node in the area."""
        return F.getbit(node["areas"], F.lit([name for name, _ in self.areas].index(area))) == 1


def spec(areas: dict[str, str] | None = None, kinds: tuple[str, ...] = (), closest: str = "", silent: tuple[str, ...] = (), every: bool = False, runs: bool = False, around: tuple[str, ...] = (), paths: bool = True) -> Spec:
    return Spec(tuple((k, selectors.parse(v)) for k, v in (areas or {}).items()), tuple(map(selectors.parse, kinds)), selectors.parse(closest), silent, every, runs, around, paths)


def attributes_of(text: str) -> dict[str, str]:
    """The attributes of a tag's text; of equal names the first."""
    attributes: dict[str, str] = {}
    for a in _ATTRIBUTE.finditer(text):
        value = next((g for g in a.groups()[1:] if g is not None), "")
        attributes.setdefault(a[1].lower(), entities.unescape(value) if "&" in value else value)
    return attributes


def tokens(page: str, read=lambda tag, text: attributes_of(text)):
    """(what, name, value): text, opening tags with what ``read`` makes of their attributes, and ends; ``raw`` for what stands in
    an element whose content is no markup. A tag that the page's end cuts off is none."""
    at, end, tag_at, names = 0, len(page), _TAG.match, NAMES
    while at < end:
        sign = page.find("<", at)
        if sign < 0:
            yield "text", None, page[at:]
            return
        if sign > at:
            yield "text", None, page[at:sign]
        m = tag_at(page, sign)
        if not m:
            other = _OTHER.match(page, sign)
            if not other and re.match(r"</?[A-Za-z]", page[sign : sign + 3]):
                return
            if not other:
                yield "text", None, "<"
            at = other.end() if other else sign + 1
            continue
        slash, name, text = m.groups()
        at, name = m.end(), names.get(name) or name.lower()
        if slash:
            yield "end", name, None
            continue
        yield ("whole" if text.endswith("/") or text.rstrip().endswith("/") else "open"), name, read(name, text)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            stop = close.start() if close else end
            yield "raw", name, page[at:stop]
            at = close.end() if close else end


def escaped(name: str) -> str:
    """An identifier as selectors write it."""
    if _PLAIN(name):
        return name
    out = re.sub(r"[^\w-]", lambda m: m[0] if ord(m[0]) > 127 else f"\\{m[0]}" if m[0] >= " " and m[0] != "\x7f" else f"\\{ord(m[0]):x} ", name)
    return re.sub(r"^(-?)([0-9])", lambda m: f"{m[1]}\\{ord(m[2]):x} ", out)


#: So many different tags a matcher remembers, so many nodes of known shapes, and so many pages are folded before they become Arrow's.
TAGS, SHAPES, PAGES = 1 << 14, 1 << 17, 128


class _Tag(NamedTuple):
    """What an opening tag's text says, whatever page it stands on: ``shape`` is all that the stack asks of it, ``own`` a selector by id,
    name, label or role, and ``step`` the tag with its first class."""

    attributes: dict[str, str]
    pairs: list[tuple[str, str]]
    shape: tuple[str, int, bool]
    own: str | None
    step: str


class _Shape(NamedTuple):
    """The tree of all pages with the same kinds of tags in the same order. Texts are pieces by number (-1: a line's end), and tags are
    their numbers among the page's opening ones (-1: one that the page leaves out)."""

    pieces: list[int]
    runs: list[tuple[int, int]]
    title: int | None
    #: A given node, the pieces at which it begins and ends, its tag, content, image, drawing, and options (tag, first piece, last piece).
    given: list[tuple[dict, int, int, int, int | None, int | None, int | None, list[tuple[int, int, int]]]]
    #: Of every node its parent, tag, tag's name, and what tells it from its siblings of that name.
    parents: list[int]
    sources: list[int]
    names: list[str]
    places: list[str]


class _Fold:
    """The stack, and the nodes so far, of pages of one shape."""

    def __init__(self, what: Spec, matcher: selectors.Matcher) -> None:
        self.matcher, self.kinds, self.known = matcher, (1 << len(what.kinds)) - 1, (1 << len(what.areas)) - 1
        self.what, self.nodes, self.counts, self.stack, self.pieces, self.title, self.texts, self.tags = what, [], [{}], [], [], None, 0, 0
        self.opened: dict[str, int] = {}
        self.runs: list[tuple[int, int]] = []
        self.quiet = sum(1 << i for i, (name, _) in enumerate(what.areas) if name in what.silent)

    def say(self, piece: int) -> bool:
        if self.stack and self.stack[-1]["areas"] & self.quiet:
            return False
        self.pieces.append(piece)
        return True

    def text(self) -> None:
        if self.say(self.texts) and self.what.runs:
            self.runs.append((self.stack[-1]["node"] if self.stack else -1, len(self.pieces) - 1))
        self.texts += 1

    def close(self, depth: int) -> None:
        """Closes what is open at the depth and above it."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.opened[node["tag"]] -= 1
            node["stop"], node["last"] = len(self.pieces), len(self.nodes) - 1
            if node["tag"] == "option":
                self.option(node)
            if node["tag"] in BLOCKS:
                self.say(-1)

    def option(self, node: dict) -> None:
        select = next((n for n in reversed(self.stack) if n["tag"] == "select"), None)
        if select is not None and select["kind"]:
            select["options"].append((node["source"], node["start"], len(self.pieces)))

    def found(self, names: tuple[str, ...], barriers: tuple[str, ...]) -> int | None:
        """The depth of the nearest open element of the names within the barriers."""
        opened = self.opened
        for name in names:
            if opened.get(name):
                break
        else:
            return None
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[depth]["tag"]
            if tag in names:
                return depth
            if tag in barriers:
                return None
        return None

    def open(self, tag: str, met: int, whole: bool, source: int = -1) -> None:
        if tag in ("html", "body", "head") and any(n["tag"] == tag for n in self.nodes[:8]):
            return
        if self.stack and self.stack[-1]["tag"] == "head" and tag not in IN_HEAD:
            self.close(len(self.stack) - 1)
        if self.opened.get("p") and tag in ENDS_P:
            depth = self.found(("p",), P_BARRIERS)
            if depth is not None:
                self.close(depth)
        if tag in ENDS:
            depth = self.found(*ENDS[tag])
            if depth is not None:
                self.close(depth)
        if tag == "tr" and self.stack and self.stack[-1]["tag"] == "table":
            self.open("tbody", self.matcher.bits("tbody", {}), False)
        if tag in ("td", "th") and self.stack and self.stack[-1]["tag"] in ("table", "thead", "tbody", "tfoot"):
            self.open("tr", self.matcher.bits("tr", {}), False)
        if tag in BLOCKS or tag == "br":
            self.say(-1)
        up = self.stack[-1] if self.stack else None
        siblings = self.counts[up["node"] + 1 if up else 0]
        siblings[tag] = siblings.get(tag, 0) + 1
        number = len(self.nodes)
        areas = (up["areas"] if up else 0) | met & self.known
        kinds = met >> len(self.what.areas) & self.kinds
        kind = (kinds & -kinds).bit_length()
        near = number if met >> len(self.what.areas) + len(self.what.kinds) else up["near"] if up else -1
        node = {
            "node": number, "parent": up["node"] if up else -1, "last": number, "depth": len(self.stack), "tag": tag, "nth": siblings[tag], "children": 0, "start": len(self.pieces), "stop": len(self.pieces), "areas": areas,
            "kind": kind, "near": near, "source": source, "content": None, "image": None, "drawing": None, "pictured": False, "options": [], "holder": (up["node"] if up["kind"] else up["holder"]) if up else -1,
        }
        if up:
            up["children"] += 1
        self.nodes.append(node)
        self.counts.append({})
        if tag in ("img", "svg"):
            self.picture(node)
        if tag not in VOID and not (whole and (tag in ("svg", "math") or any(n["tag"] in ("svg", "math") for n in self.stack[-8:]))):
            self.stack.append(node)
            self.opened[tag] = self.opened.get(tag, 0) + 1

    def picture(self, node: dict) -> None:
        """Tells the nodes of a kind around a picture of it, nearest first; one that knows one already has told the others."""
        at, field = node["holder"], "image" if node["tag"] == "img" else "drawing"
        while at >= 0:
            holder = self.nodes[at]
            if holder["pictured"] and holder[field] is not None:
                return
            holder["pictured"] = True
            holder[field] = node["source"] if holder[field] is None else holder[field]
            at = holder["holder"]

    def raw(self, tag: str) -> None:
        if tag == "title" and self.title is None:
            self.title = self.texts
        node = self.nodes[-1] if self.nodes and self.nodes[-1]["tag"] == tag else None
        if node is not None and tag == "textarea":
            node["content"] = self.texts
        if self.stack and self.stack[-1] is node:
            self.close(len(self.stack) - 1)
        self.texts += 1

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        depth = self.found((tag,), ("table",) if tag in TABLE_PARTS and tag != "table" else () if tag in TABLE_PARTS else CELL)
        if depth is not None:
            self.close(depth)

    def shape(self, parts: tuple) -> _Shape:
        """Folds the parts of a page: None for a text, a tag's shape, its name after a slash, or of raw content after a bar."""
        for part in parts:
            if part is None:
                self.text()
            elif type(part) is tuple:
                self.open(*part, self.tags)
                self.tags += 1
            elif part[0] == "/":
                self.end(part[1:])
            else:
                self.raw(part[1:])
        self.close(0)
        places, given, what = [], [], self.what
        around = sum(1 << i for i, (name, _) in enumerate(what.areas) if name in what.around)
        for n in self.nodes:
            n["same"] = self.counts[n["parent"] + 1][n["tag"]]
            places.append(f":nth-of-type({n['nth']})" if n["same"] > 1 else "")
            if what.every or n["kind"] or n["areas"] & around:
                plain = {k: n[k] for k in ("node", "parent", "last", "depth", "tag", "nth", "same", "children", "areas", "kind", "near", "pictured")}
                plain |= {"start": 0, "stop": 0, "attributes": [], "content": None, "selector": None, "image": None, "drawing": None, "options": None}
                given.append((plain, n["start"], n["stop"], n["source"], n["content"], n["image"], n["drawing"], n["options"]))
        return _Shape(self.pieces, self.runs, self.title, given, [n["parent"] for n in self.nodes], [n["source"] for n in self.nodes], [n["tag"] for n in self.nodes], places)


def _path(shape: _Shape, tags: list[_Tag], at: int) -> str:
    """A selector of a node: by id, name, label or role, else the path of its ancestors under the body."""
    source = shape.sources[at]
    if source >= 0 and tags[source].own:
        return tags[source].own
    steps = []
    while at >= 0 and shape.names[at] not in ("body", "html"):
        source = shape.sources[at]
        steps.append((tags[source].step if source >= 0 else shape.names[at]) + shape.places[at])
        at = shape.parents[at]
    return " > ".join(reversed(steps))


def _read(tag: str, text: str, matcher: selectors.Matcher) -> _Tag:
    """Pages repeat their tags, and each other's, so what was read is kept."""
    known, key = matcher.known, (tag, text)
    found = known.get(key)
    if found is None:
        if len(known) >= TAGS:
            known.clear()
        a = attributes_of(text)
        own = f"#{escaped(a['id'])}" if a.get("id") else next((f'{tag}[{n}="{escaped(a[n])}"]' for n in ("name", "aria-label", "role") if a.get(n)), None)
        classes = a["class"].split() if "class" in a else ()
        step = f"{tag}.{escaped(classes[0])}" if classes and ":" not in classes[0] and "/" not in classes[0] else tag
        found = known[key] = _Tag(a, list(a.items()), (tag, matcher.bits(tag, a), text.rstrip().endswith("/")), own, step)
    return found


def fold(page: str, what: Spec, matcher: selectors.Matcher | None = None) -> dict:
    """A page's title, text and nodes. Pages made from one template differ in texts and values, so the tree of what the stack asks of
    their tags is folded once, and filled for each page."""
    matcher = matcher or what.matcher()
    parts, texts, tags = [], [], []
    for kind, name, value in tokens(page, lambda tag, text: _read(tag, text, matcher)):
        if kind == "text":
            parts.append(None)
            texts.append(value)
        elif kind == "end":
            parts.append(f"/{name}")
        elif kind == "raw":
            parts.append(f"|{name}")
            texts.append(value)
        else:
            parts.append(value.shape)
            tags.append(value)
    parts = tuple(parts)
    shape = matcher.shapes.get(parts)
    if shape is None:
        shape = _Fold(what, matcher).shape(parts)
        matcher.held += len(parts)
        if matcher.held > SHAPES:
            matcher.shapes.clear()
            matcher.held = len(parts)
        matcher.shapes[parts] = shape
    texts = [entities.unescape(t) if "&" in t else t for t in texts]
    pieces = ["\n" if i < 0 else texts[i] for i in shape.pieces]
    sums = [0, *accumulate(map(len, pieces))]
    nodes = []
    for plain, start, stop, source, content, image, drawing, options in shape.given:
        n = plain.copy()
        n["start"], n["stop"] = sums[start], sums[stop]
        if source >= 0:
            n["attributes"] = tags[source].pairs
        if n["kind"] and what.paths:
            n["selector"] = _path(shape, tags, n["node"])
        if content is not None:
            n["content"] = texts[content].removeprefix("\n")
        if image is not None:
            n["image"] = tags[image].attributes.get("alt") or ""
        if drawing is not None:
            n["drawing"] = tags[drawing].attributes.get("aria-label") or ""
        if n["tag"] == "select":
            n["options"] = []
            for option, first, last in options:
                label, a = " ".join("".join(pieces[first:last]).split()), tags[option].attributes
                n["options"].append({"value": a.get("value", label), "label": label, "selected": "selected" in a})
        nodes.append(n)
    runs = [{"node": node, "start": sums[i], "stop": sums[i + 1]} for node, i in shape.runs if pieces[i] and not pieces[i].isspace()]
    return {"title": None if shape.title is None else texts[shape.title], "text": "".join(pieces), "runs": runs, "nodes": nodes}


def parsed(page: Column, what: Spec) -> Column:
    """struct<title, text, nodes> of a page; of a null page no text and no nodes."""

    def pages(column: pa.Array) -> pa.Array:
        matcher, parts = what.matcher(), []
        # Nodes are Python objects for a few pages at a time: a whole batch of them would take hundreds of MB. They hold no
        # cycles, so the collector, which would go through all of them again and again, rests meanwhile.
        collects = gc.isenabled()
        gc.disable()
        try:
            for at in range(0, len(column), PAGES):
                parts.append(pa.array([fold(v.as_py() or "", what, matcher) for v in column.slice(at, PAGES)], PAGE))
        finally:
            if collects:
                gc.enable()
        return pa.concat_arrays(parts) if parts else pa.array([], PAGE)

    pages.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(pages, _DDL)(page)


# Tasks get these small modules with the function, so no package has to be there.
for _name in (__name__, selectors.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_name])
