"""HTML as column expressions, and the one tree walk Spark SQL cannot express.

Anchors, meta tags, scripts and labelled text are found with JVM regular expressions. Only the
choice of the body container needs a tree; `page_parts` walks each page once in an Arrow batch.
"""
from __future__ import annotations

import re
import urllib.parse
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from docledger.functions import text as X

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def decoded(col: Column) -> Column:
    for name, value in ENTITIES.items():
        col = F.replace(col, F.lit(name), F.lit(value))
    return col


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, '' if missing."""
    raw = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(decoded(F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2")))


def tags(html: Column, name: str) -> Column:
    """Opening tags of one kind, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/>])[^>]*>"), F.lit(0))


def elements(html: Column, name: str) -> Column:
    """Whole elements of one kind (not nested in themselves), in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s>])[^>]*>.*?</{name}\s*>"), F.lit(0))


def inner_text(html: Column) -> Column:
    """Text of a fragment, tags as spaces, white space squeezed."""
    return X.squeeze(decoded(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def without(html: Column, *names: str) -> Column:
    for name in names:
        html = F.regexp_replace(html, rf"(?is)<{name}(?=[\s>])[^>]*>.*?</{name}\s*>", " ")
    return html


def visible_text(html: Column) -> Column:
    return inner_text(F.regexp_replace(without(html, "script", "style"), r"(?s)<!--.*?-->", " "))


def _join(urls: pd.Series, bases: pd.Series) -> pd.Series:
    def one(url, base):
        try:
            p = urllib.parse.urlsplit(urllib.parse.urljoin(base or "", (url or "").strip()))
        except ValueError:
            return ""
        return urllib.parse.urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path, p.query, ""))
    return pd.Series([one(u, b) for u, b in zip(urls, bases)], dtype=object)


# resolve against the base, lower scheme and host, drop the fragment, keep the query
normalize_url = F.pandas_udf(_join, T.StringType())



def _absolute(urls: pd.Series, bases: pd.Series) -> pd.Series:
    def one(url, base):
        try:
            return urllib.parse.urljoin(base or "", (url or "").strip())
        except ValueError:
            return ""
    return pd.Series([one(u, b) for u, b in zip(urls, bases)], dtype=object)


absolute_url = F.pandas_udf(_absolute, T.StringType())

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKING = ("p", "div", "table", "br", "a", "img")


class _Node:
    __slots__ = ("tag", "attrs", "children", "blocks", "classes")

    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.children, self.blocks = tag, dict(attrs), [], False
        self.classes = (self.attrs.get("class") or "").split()

    def walk(self):
        """All elements below this one in document order; an explicit stack, as pages nest as deep as they like."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, _Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def strings(self):
        """Stripped text pieces in order; a paragraph without block content is one piece."""
        stack = [(iter(self.children), _whole_paragraph(self), [])]
        while stack:
            children, joined, pieces = stack[-1]
            for c in children:
                if isinstance(c, _Node):
                    stack.append((iter(c.children), joined or _whole_paragraph(c), pieces if joined else []))
                    break
                if text := c.strip():
                    if joined:
                        pieces.append(text)
                    else:
                        yield text
            else:
                stack.pop()
                if joined and not (stack and stack[-1][1]) and pieces:
                    yield "".join(pieces)

    def text(self, sep="\n"):
        return sep.join(s for s in self.strings() if s)

    def matches(self, selector: tuple[str, str, str]) -> bool:
        tag, kind, name = selector
        if tag and tag != self.tag:
            return False
        if kind == "#":
            return self.attrs.get("id") == name
        return kind == "" or name in self.classes


def _selector(text: str) -> tuple[str, str, str]:
    """(tag, "." or "#" or "", name) of `tag`, `.class`, `#id`, `tag.class` or `tag#id`."""
    return re.fullmatch(r"([a-z0-9]*)([.#]?)(.*)", text, re.S).groups()


def _whole_paragraph(node: _Node) -> bool:
    return node.tag == "p" and not node.blocks


def _noted(root: _Node) -> list[_Node]:
    """All elements in document order; each notes whether it has block content."""
    nodes = list(root.walk())
    for n in reversed([root, *nodes]):
        n.blocks = any(isinstance(c, _Node) and (c.tag in BLOCKING or c.blocks) for c in n.children)
    return nodes


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open[-1].tag in ("p", "b", "i", "span", "strong", "em", "font"):
            for i in range(len(self.open) - 1, 0, -1):  # a paragraph ends the one before it
                if self.open[i].tag == "p":
                    del self.open[i:]
                    break
                if self.open[i].tag in ("div", "td", "li", "article"):
                    break
        node = _Node(tag, [(k, v or "") for k, v in attrs])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].children.append(data)


PARTS = T.StructType().add("body", "string").add("located", "boolean").add("custom", "boolean").add("number", "string")


def page_parts(selectors: tuple, number_pattern: str, dropped: tuple):
    """Pandas UDF (html, site selectors, site minimum) -> body text, was a container found, number standing alone."""
    number, alone_at = re.compile(number_pattern), _selector(".rules_tit1")
    selectors, dropped = [_selector(s) for s in selectors], [_selector(s) for s in dropped]

    def one(html, site, minimum):
        tree = _Tree()
        tree.feed(html or "")
        nodes = _noted(tree.root)
        alone = next((v for n in nodes if n.tag in ("p", "span", "td") or n.matches(alone_at)
                      for v in [re.sub(r"\s+", "", n.text(""))] if number.fullmatch(v)), "")
        for s in site if site is not None else ():
            s = _selector(s)
            node = next((n for n in nodes if n.matches(s)), None)
            if node is not None:
                body = re.sub(r"\n{3,}", "\n\n", node.text().replace("　", " ")).strip()
                if len(body) >= minimum:
                    return body, True, True, alone
                break
        for parent in [tree.root, *nodes]:
            parent.children = [c for c in parent.children if isinstance(c, str) or not any(c.matches(d) for d in dropped)]
        nodes = _noted(tree.root)
        for s in selectors:
            node = next((n for n in nodes if n.matches(s)), None)
            if node is not None and len(node.text("")) > 20:
                return re.sub(r"\n{3,}", "\n\n", node.text()).strip(), True, False, alone
        body = next((n for n in nodes if n.tag == "body"), tree.root)
        return re.sub(r"\n{3,}", "\n\n", body.text()).strip(), False, False, alone

    def parts(html: pd.Series, site: pd.Series, minimum: pd.Series) -> pd.DataFrame:
        rows = []
        for h, s, m in zip(html, site, minimum):
            try:
                rows.append(one(h, s, m))
            except (AssertionError, ValueError):  # what the HTML parser raises on malformed declarations: no container was found
                rows.append(("", False, False, ""))
        return pd.DataFrame(rows, columns=["body", "located", "custom", "number"])

    return F.pandas_udf(parts, PARTS)
