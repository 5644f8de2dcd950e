"""A forgiving element tree: local names, attributes in order, byte offsets; a file that ends early gives what it had."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

from tessera.functions.text import DECIMAL

_TAG = re.compile(rb"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_INT = re.compile(r"[+-]?[0-9]+\Z")
_FLOAT = re.compile(rf"(?:{DECIMAL})\Z")
#: Unicode's white space, which str.strip() alone takes too widely.
SPACES = "\t\n\v\f\r \x85\xa0                　"


def as_int(text: str | None, fallback: int) -> int:
    """A 32-bit integer, white space around it allowed, else the fallback."""
    t = (text or "").strip(SPACES)
    return int(t) if _INT.match(t) and -(2**31) <= int(t) < 2**31 else fallback


def as_float(text: str | None, fallback: float) -> float:
    t = (text or "").strip(SPACES)
    return float(t) if _FLOAT.match(t) else fallback


@dataclass
class Element:
    name: str
    attributes: list[tuple[str, str]]
    begin: int
    items: list = field(default_factory=list)  # texts and elements
    end: int = -1

    def get(self, name: str) -> str | None:
        """The first attribute of that local name."""
        return next((v for k, v in self.attributes if k == name), None)

    def has(self, name: str) -> bool:
        return self.get(name) is not None

    def int(self, name: str, fallback: int = 0) -> int:
        return as_int(self.get(name), fallback)

    def float(self, name: str, fallback: float = 0.0) -> float:
        return as_float(self.get(name), fallback)

    def mm(self, name: str, fallback: float = 0.0) -> float:
        """A length in thousandths of a millimetre, as millimetres."""
        return 0.001 * self.float(name, fallback / 0.001)

    def flag(self, name: str, fallback: bool = False) -> bool:
        v = self.get(name)
        return v == "true" if v else fallback

    @property
    def children(self) -> list[Element]:
        return [x for x in self.items if isinstance(x, Element)]

    def through_barriers(self) -> Iterator[Element]:
        """Children; elements named barrier stand for theirs."""
        for x in self.children:
            if x.name == "barrier":
                yield from x.through_barriers()
            else:
                yield x

    @property
    def text(self) -> str:
        """The element's own text, as it stands."""
        return "".join(x for x in self.items if isinstance(x, str))


def parse(data: bytes) -> Element | None:
    """The root element. ValueError for what isn't XML; None for nothing at all."""
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True
    roots: list[Element] = []
    stack: list[Element] = []
    local = lambda name: name.rpartition(":")[2]

    def start(name: str, attributes: list[str]) -> None:
        pairs = [(local(k), v) for k, v in zip(attributes[::2], attributes[1::2], strict=True)]
        e = Element(local(name), pairs, parser.CurrentByteIndex)
        (stack[-1].items if stack else roots).append(e)
        stack.append(e)

    def end(name: str) -> None:
        e, at = stack.pop(), parser.CurrentByteIndex
        head = _TAG.match(data, e.begin)
        e.end = head.end() if head and head[0].endswith(b"/>") else data.index(b">", at) + 1

    def text(value: str) -> None:
        if stack:
            stack[-1].items.append(value)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        unfinished = {expat.errors.codes[x] for x in (expat.errors.XML_ERROR_NO_ELEMENTS, expat.errors.XML_ERROR_UNCLOSED_TOKEN, expat.errors.XML_ERROR_PARTIAL_CHAR)}
        if e.code not in unfinished:
            raise ValueError(str(e)) from e
    return roots[0] if roots else None
