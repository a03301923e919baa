"""HTML pages as a text and an array of elements.

One small Arrow function flattens a page; everything after it (cards, fields, links) is column expressions. Elements
stand in document order and know the end of their subtree, so "inside" is a comparison; they also know their span in the
page's text, so the text of an element is a substring.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser
from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import squeeze

NODE = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("up", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())])
PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("nodes", T.ArrayType(NODE))])
_ARROW = pa.struct([("text", pa.string()), ("nodes", pa.list_(pa.struct([
    ("id", pa.int32()), ("stop", pa.int32()), ("up", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())),
    ("attrs", pa.map_(pa.string(), pa.string())), ("start", pa.int32()), ("size", pa.int32())])))])
BREAK = "\x1f"  # stands between text nodes; cleaning would drop it from page text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript"))


class _Flattener(HTMLParser):
    """Collects elements and text; unclosed elements end with their parent, stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.hidden = [], [], 0
        self.texts, self.length = [], 0

    def _add(self, tag, attrs, size=0):
        node = {"id": len(self.nodes), "stop": len(self.nodes), "up": self.open[-1]["id"] if self.open else -1, "tag": tag,
                "classes": attrs.get("class", "").split(), "attrs": list(attrs.items()), "start": self.length, "size": size}
        self.nodes.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN or self.hidden:
            if tag not in VOID:
                self.hidden += tag in HIDDEN
                self.open.append({"id": -1, "tag": tag})
        else:
            node = self._add(tag, {name: value or "" for name, value in reversed(attrs)})
            if tag not in VOID:
                self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(node["tag"] == tag for node in self.open):
            closed = None
            while closed != tag:
                closed = self._close(self.open.pop())

    def _close(self, node):
        if node["id"] < 0:
            self.hidden -= node["tag"] in HIDDEN
        else:
            node["stop"] = len(self.nodes) - 1
            node["size"] = max(0, self.length - 1 - node["start"])
        return node["tag"]

    def handle_data(self, data):
        if not self.hidden:
            text = unicodedata.normalize("NFKC", html.unescape(data.replace("\r\n", "\n"))).replace(BREAK, "").strip()
            if text:
                self._add("#text", {}, len(text))
                self.texts.append(text)
                self.length += len(text) + 1

    def finish(self):
        self.close()
        while self.open:
            self._close(self.open.pop())
        return {"text": BREAK.join(self.texts), "nodes": self.nodes}


# Text, then one tag or comment in its plain spelling: quoted values, nothing that HTMLParser would have to mend.
_ATTRIBUTES = r"""(?:[ \n\t]+[a-zA-Z][a-zA-Z0-9_:-]*(?:="[^"<>]*")?)*"""
_TOKEN = re.compile(
    rf"([^<]*)(?:<(?:(script|style){_ATTRIBUTES}>(?:[^<]|<(?!/(?:script|style)|!--))*</\2>"
    rf"|(/?)([a-zA-Z][a-zA-Z0-9-]*)({_ATTRIBUTES})[ \n\t]*(/?)>|!--[^-<>]+-->|!(?:DOCTYPE|doctype)[^<>]*>)|\Z)")
_ATTRIBUTE = re.compile(r"""[ \n\t]([a-zA-Z][a-zA-Z0-9_:-]*)(?:="([^"]*)")?""")
# what stands in these is not read as markup
RAW = HIDDEN | frozenset("title textarea iframe noembed noframes xmp plaintext".split())


class _Attributes(HTMLParser):
    """Attributes of one start tag."""

    def handle_starttag(self, tag, attrs):
        self.found = attrs

    @classmethod
    def of(cls, token: str):
        parser = cls()
        parser.feed(token)
        return parser.found


class _Nodes:
    """The nodes of many pages, column by column: lists of plain values, which the garbage collector need not walk."""

    def __init__(self):
        self.stops, self.ups, self.tags, self.starts, self.sizes = [], [], [], [], []
        self.classes, self.class_ends, self.keys, self.values, self.attr_ends = [], [0], [], [], [0]

    def add(self, up: int, tag: str, start: int, size: int, found: dict | None = None) -> None:
        """A node that ends where it begins."""
        self.stops.append(-1)
        self.ups.append(up)
        self.tags.append(tag)
        self.starts.append(start)
        self.sizes.append(size)
        if found:
            if "class" in found:
                self.classes.extend(found["class"].split())
            self.keys.extend(found.keys())
            self.values.extend(found.values())
        self.class_ends.append(len(self.classes))
        self.attr_ends.append(len(self.keys))

    def rows(self) -> list[list]:
        attrs = [dict(zip(self.keys[begin:end], self.values[begin:end])) for begin, end in zip(self.attr_ends, self.attr_ends[1:])]
        return [list(node) for node in zip(self.stops, self.ups, self.tags, attrs, self.starts, self.sizes)]

    def cut(self, size: int) -> None:
        """Take away all nodes but the first `size`."""
        del self.classes[self.class_ends[size]:], self.keys[self.attr_ends[size]:], self.values[self.attr_ends[size]:]
        del self.class_ends[size + 1:], self.attr_ends[size + 1:]
        for column in (self.stops, self.ups, self.tags, self.starts, self.sizes):
            del column[size:]


def _plain_page(page: str, out: _Nodes) -> str | None:
    """As `_Flattener`, for a page all of whose markup is in its plain spelling: its text, and its nodes in `out`; None, and no nodes, for any
    other page."""
    first = len(out.stops)
    text = _plain_text(page, out, first)
    if text is None:
        out.cut(first)
    return text


def _plain_text(page: str, out: _Nodes, first: int) -> str | None:
    texts, opened, up, length, at, raw, size = [], [], -1, 0, 0, None, 0
    normalize, unescape, stops, ups, tags, starts, sizes = unicodedata.normalize, html.unescape, out.stops, out.ups, out.tags, out.starts, out.sizes
    classes, keys, values, class_ends, attr_ends = out.classes, out.keys, out.values, out.class_ends, out.attr_ends
    for token in _TOKEN.finditer(page):
        if token.start() != at:
            return None
        at = token.end()
        data, _, ends, name, attrs, alone = token.groups()
        if data:
            if "&" in data:
                data = unescape(unescape(data).replace("\r\n", "\n"))
            elif "\r" in data:
                data = data.replace("\r\n", "\n")
            text = (data if data.isascii() else normalize("NFKC", data)).replace(BREAK, "").strip()
            if text:
                stops.append(size)
                ups.append(up)
                tags.append("#text")
                starts.append(length)
                sizes.append(len(text))
                class_ends.append(len(classes))
                attr_ends.append(len(keys))
                size += 1
                texts.append(text)
                length += len(text) + 1
        if name is None:
            if raw:
                return None
            continue
        tag = name.lower()
        if raw and not (ends and tag == raw):
            return None
        raw = None
        if ends:
            if attrs or alone:
                return None
            if opened and opened[-1][1] == tag:
                number = opened.pop()[0]
                stops[first + number] = size - 1
                if length > starts[first + number]:
                    sizes[first + number] = length - 1 - starts[first + number]
                up = opened[-1][0] if opened else -1
            elif any(other == tag for _, other in opened):
                closed = None
                while closed != tag:
                    number, closed = opened.pop()
                    stops[first + number], sizes[first + number] = size - 1, max(0, length - 1 - starts[first + number])
                up = opened[-1][0] if opened else -1
            continue
        if tag in RAW:
            if tag != "title" or alone:
                return None
            raw = tag
        if attrs:
            if "&" in attrs:
                pairs = [(key, value or "") for key, value in _Attributes.of(f"<{name}{attrs}>")]
            else:
                pairs = [(key.lower(), value) for key, value in _ATTRIBUTE.findall(attrs)]
            if len(pairs) > 1:
                pairs = dict(reversed(pairs)).items()
            for key, value in pairs:
                if key == "class":
                    classes.extend(value.split())
                keys.append(key)
                values.append(value)
        stops.append(size)
        ups.append(up)
        tags.append(tag)
        starts.append(length)
        sizes.append(0)
        class_ends.append(len(classes))
        attr_ends.append(len(keys))
        if tag not in VOID and not alone:
            opened.append((size, tag))
            up = size
        size += 1
    if at != len(page):
        return None
    for number, _ in opened:
        stops[first + number], sizes[first + number] = size - 1, max(0, length - 1 - starts[first + number])
    return BREAK.join(texts)


def _plain_nodes(page: str):
    """Text and nodes of one page by `_plain_page`, or None. A node is a list: stop, up, tag, attributes, start, size."""
    out = _Nodes()
    text = _plain_page(page, out)
    return None if text is None else (text, out.rows())


def _any_nodes(page: str):
    parser = _Flattener()
    parser.feed(page)
    done = parser.finish()
    return done["text"], [[n["stop"], n["up"], n["tag"], dict(n["attrs"]), n["start"], n["size"]] for n in done["nodes"]]


def _flatten(pages: list[str | None]) -> pa.Array:
    """The pages' structs, built column by column."""
    texts, ends, ids, out = [], [0], [], _Nodes()
    for page in pages:
        text = None if page is None else _plain_page(page, out)
        if text is None and page is not None:
            text, nodes = _any_nodes(page)
            for stop, up, tag, found, start, size in nodes:
                out.add(up, tag, start, size, found)
                out.stops[-1] = stop
        texts.append(text)
        ids.extend(range(len(out.stops) - ends[-1]))
        ends.append(len(out.stops))
    number = lambda items: pa.array(items, pa.int32())
    text_array = lambda items: pa.array(items, pa.string())
    node = pa.StructArray.from_arrays([
        number(ids), number(out.stops), number(out.ups), text_array(out.tags), pa.ListArray.from_arrays(number(out.class_ends), text_array(out.classes)),
        pa.MapArray.from_arrays(number(out.attr_ends), text_array(out.keys), text_array(out.values)), number(out.starts), number(out.sizes)],
        fields=list(_ARROW.field("nodes").type.value_type))
    missing = pa.array([page is None for page in pages], pa.bool_())
    return pa.StructArray.from_arrays([text_array(texts), pa.ListArray.from_arrays(number(ends), node)], fields=list(_ARROW), mask=missing)


@F.arrow_udf(PAGE)
def html_page(pages: pa.Array) -> pa.Array:
    """STRUCT<text, nodes> of each page."""
    return _flatten(pages.to_pylist())


def with_page(pages: DataFrame, *columns: str | Column) -> DataFrame:
    """The given columns, `nodes`, `text` and `base` (where the text starts) of each page."""
    flat = pages.select(*columns, html_page("html").alias("_page"))
    kept = [name for name in flat.columns if name != "_page"]
    return flat.select(*kept, F.col("_page.nodes").alias("nodes"), F.col("_page.text").alias("text"), F.lit(0).alias("base"))


# --- selectors: predicates over one node of an array -------------------------------------------------------------

Test = Callable[[Column], Column]


def tag(name: str, *classes: str, **attrs: str | None) -> Test:
    """Element by tag ('*' for any), classes, and attributes (None: the attribute only has to exist)."""
    def test(node: Column) -> Column:
        found = (node["tag"] == name) if name != "*" else (node["tag"] != "#text")
        for cls in classes:
            found = found & F.array_contains(node["classes"], cls)
        for key, value in attrs.items():
            actual = attribute(node, key.rstrip("_").replace("_", "-"))
            found = found & (actual.isNotNull() if value is None else (actual == value))
        return found
    return test


def any_of(*tests: Test) -> Test:
    def test(node: Column) -> Column:
        result = tests[0](node)
        for other in tests[1:]:
            result = result | other(node)
        return result
    return test


def attribute(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def inside(outer: Test, inner: Test, nodes: str = "nodes") -> Test:
    """Descendant: `inner` somewhere below a node accepted by `outer`."""
    return lambda node: inner(node) & F.exists(nodes, lambda a: outer(a) & below(a)(node))


def below(top: Column) -> Test:
    return lambda node: (top["id"] < node["id"]) & (node["id"] <= top["stop"])


def find_all(test: Test, nodes: str = "nodes") -> Column:
    return F.filter(nodes, lambda n: F.coalesce(test(n), F.lit(False)))


def find(test: Test, nodes: str = "nodes") -> Column:
    return F.get(find_all(test, nodes), 0)


def nearest_above(name: str, test: Test, nodes: str = "nodes") -> Column:
    """Closest ancestor of the located element in column `name`."""
    return F.try_element_at(find_all(lambda n: test(n) & below(n)(F.col(name)), nodes), F.lit(-1))


def parent_of(name: str, nodes: str = "nodes") -> Column:
    return find(lambda n: n["id"] == F.col(name)["up"], nodes)


def raw_text(node: Column) -> Column:
    """Text of a located element with BREAK between its text nodes; NULL without an element."""
    return F.substring("text", node["start"] - F.col("base") + 1, node["size"])


def tidy(text: Column) -> Column:
    """Clean text out of a page's text (entities and NFKC were resolved while flattening)."""
    return squeeze(F.regexp_replace(F.translate(text, BREAK, " "), r"[\p{C}&&[^\n\t]]", ""))


def text_of(node: Column) -> Column:
    """Clean text of a located element; '' without an element."""
    return F.coalesce(tidy(raw_text(node)), F.lit(""))


def texts_of(test: Test) -> Column:
    return F.transform(find_all(test), text_of)
