"""A small, tolerant document tree on the standard library's HTML tokenizer.

Elements that are never closed end where an element around them ends; a closing tag without an
open element is ignored. Void elements have no content.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element: name, attributes, children (elements and strings) and the element around it."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.name, self.attrs, self.parent, self.children = name, attrs or {}, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in page order."""
        rest = [c for c in reversed(self.children) if isinstance(c, Node)]
        while rest:
            node = rest.pop()
            yield node
            rest.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        rest: list = list(reversed(self.children))
        while rest:
            c = rest.pop()
            if isinstance(c, str):
                yield c
            else:
                rest.extend(reversed(c.children))

    def text(self, separator: str = "", strip: bool = False) -> str:
        """All text below, pieces joined by ``separator``; ``strip`` trims pieces and leaves out blank ones."""
        return separator.join(x for x in (s.strip() for s in self.strings()) if x) if strip else separator.join(self.strings())

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def has_class(self, pattern: re.Pattern) -> bool:
        """Whether a class, or the whole attribute, matches."""
        return any(pattern.search(c) for c in self.classes) or bool(self.classes) and bool(pattern.search(" ".join(self.classes)))

    def all(self, names: str | None = None, cls: str | None = None, where: Callable[[Node], bool] | None = None, flags: int = 0) -> Iterator[Node]:
        """Elements below of one of the ``names`` (None: any), with a class that matches ``cls``, for which ``where`` holds."""
        wanted, pattern = names.split() if names else None, re.compile(cls, flags) if cls else None
        for node in self.walk():
            if (wanted is None or node.name in wanted) and (pattern is None or node.has_class(pattern)) and (where is None or where(node)):
                yield node

    def first(self, names: str | None = None, cls: str | None = None, where: Callable[[Node], bool] | None = None, flags: int = 0) -> Node | None:
        return next(self.all(names, cls, where, flags), None)

    def select(self, selector: str) -> list[Node]:
        """Elements below by ``name`` or ``name.class``."""
        name, _, cls = selector.partition(".")
        return [n for n in self.walk() if n.name == name and (not cls or cls in n.classes)]

    def remove(self, test: Callable[[Node], bool]) -> None:
        """Takes out all elements below for which ``test`` holds, with what is in them."""
        self.children = [c for c in self.children if isinstance(c, str) or not test(c)]
        for node in list(self.walk()):
            node.children = [c for c in node.children if isinstance(c, str) or not test(c)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.name != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
