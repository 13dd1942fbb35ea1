"""RDF/XML, file by file: a stack of node and property elements over an event stream, so a large file needs no tree.

Node elements (typed or not) by about, ID, nodeID or none; property attributes and elements; resource, nodeID, datatype,
xml:lang, xml:base; parseType Resource, Collection and Literal; numbered list items. A file that isn't well-formed gives
the statements before the error and one bad record; an attribute or element out of place gives a bad record alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin
from xml.etree import ElementTree
from xml.sax.saxutils import escape

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "http://www.w3.org/XML/1998/namespace"
#: Attributes of the syntax itself.
SYNTAX = frozenset(RDF + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType", "bagID", "aboutEach"))
_LITERAL = RDF + "XMLLiteral"


def _iri(tag: str) -> str | None:
    """The IRI of an expanded name; names without a namespace have none."""
    return "".join(tag[1:].split("}", 1)) if tag.startswith("{") else None


@dataclass
class _Frame:
    kind: str  # document, node, property, literal
    base: str
    lang: str | None
    subject: tuple[str, str] | None = None  # of a node
    predicate: str | None = None  # of a property
    datatype: str | None = None
    text: list[str] = field(default_factory=list)
    filled: bool = False  # a property that has its object
    items: list[tuple[str, str]] | None = None  # of a collection
    li: int = 0


class RdfXmlReader:
    def __init__(self, text: str, file_id: str = "0", base: str = "") -> None:
        self.text, self.file_id, self.blanks, self.out = text, file_id, 0, []
        self.stack = [_Frame("document", base, None)]

    def blank(self, label: str | None = None) -> tuple[str, str]:
        if label is None:
            self.blanks += 1
            return f"_:x{self.file_id}n{self.blanks}", "blank"
        return f"_:x{self.file_id}l{label}", "blank"

    def say(self, s: tuple[str, str], p: str, o: tuple[str, str], datatype: str | None = None, lang: str | None = None) -> None:
        self.out.append((s[0], s[1], p, o[0], o[1], datatype, lang, None))

    def read(self) -> Iterator[tuple]:
        """Quads (with None) and bad pieces (with their text)."""
        parser = ElementTree.XMLPullParser(["start", "end"])
        try:
            for at in range(0, len(self.text), 1 << 16):
                parser.feed(self.text[at : at + (1 << 16)])
                yield from self.events(parser)
            parser.close()
            yield from self.events(parser)
        except (ElementTree.ParseError, ValueError) as e:
            yield None, str(e)

    def events(self, parser) -> Iterator[tuple]:
        for event, element in parser.read_events():
            try:
                (self.start if event == "start" else self.end)(element)
            except ValueError as e:
                yield None, str(e)
            if event == "end" and self.stack[-1].kind != "literal":
                element.clear()
            for quad in self.out:
                yield quad, None
            self.out = []

    def start(self, e) -> None:
        top = self.stack[-1]
        base = urljoin(top.base, e.get(f"{{{XML}}}base")) if e.get(f"{{{XML}}}base") else top.base
        lang = e.get(f"{{{XML}}}lang", top.lang) or None
        if top.kind == "literal":
            self.stack.append(_Frame("literal", base, lang))
        elif top.kind == "document" and _iri(e.tag) == RDF + "RDF":
            self.stack.append(_Frame("document", base, lang))
        elif top.kind in ("document", "property"):
            self.start_node(e, top, base, lang)
        else:
            self.start_property(e, top, base, lang)

    def start_node(self, e, top: _Frame, base: str, lang: str | None) -> None:
        get = lambda n: e.get(f"{{{RDF}}}{n}")
        if get("about") is not None:
            subject = (urljoin(base, get("about")), "uri")
        elif get("ID") is not None:
            subject = (urljoin(base, "#" + get("ID")), "uri")
        else:
            subject = self.blank(get("nodeID"))
        self.stack.append(_Frame("node", base, lang, subject))
        kind = _iri(e.tag)
        if kind is None:
            raise ValueError(f"an element without a namespace: {e.tag}")
        if kind != RDF + "Description":
            self.say(subject, RDF + "type", (kind, "uri"))
        self.attributes(e, subject, base, lang)
        if top.kind == "property":
            if top.items is not None:
                top.items.append(subject)
            elif top.filled:
                raise ValueError(f"two objects of one {top.predicate}")
            else:
                self.say(top.subject, top.predicate, subject)
                top.filled = True

    def attributes(self, e, subject: tuple[str, str], base: str, lang: str | None) -> bool:
        """Property attributes; whether there were any."""
        found = False
        for name, value in e.attrib.items():
            p = _iri(name)
            if p is None or p in SYNTAX or p.startswith(XML):
                continue
            found = True
            if p == RDF + "type":
                self.say(subject, p, (urljoin(base, value), "uri"))
            else:
                self.say(subject, p, (value, "literal"), None, lang)
        return found

    def start_property(self, e, top: _Frame, base: str, lang: str | None) -> None:
        get = lambda n: e.get(f"{{{RDF}}}{n}")
        p = _iri(e.tag)
        if p == RDF + "li":
            top.li += 1
            p = f"{RDF}_{top.li}"
        own = _Frame("property", base, lang, top.subject, p, get("datatype"))
        self.stack.append(own)
        if p is None:
            own.filled = True
            raise ValueError(f"an element without a namespace: {e.tag}")
        how = get("parseType")
        if how == "Resource":
            o = self.blank()
            self.say(top.subject, p, o)
            self.stack[-1] = _Frame("node", base, lang, o)
        elif how == "Collection":
            own.items = []
        elif how is not None:
            self.stack[-1] = _Frame("literal", base, None, top.subject, p, _LITERAL)
        elif get("resource") is not None or get("nodeID") is not None:
            o = (urljoin(base, get("resource")), "uri") if get("resource") is not None else self.blank(get("nodeID"))
            self.say(top.subject, p, o)
            self.attributes(e, o, base, lang)
            own.filled = True
        elif any((q := _iri(n)) and q not in SYNTAX and not q.startswith(XML) for n in e.attrib):
            o = self.blank()
            self.say(top.subject, p, o)
            self.attributes(e, o, base, lang)
            own.filled = True

    def end(self, e) -> None:
        own = self.stack.pop()
        if own.kind == "literal" and own.predicate is not None:
            inner = escape(e.text or "") + "".join(ElementTree.tostring(x, encoding="unicode") for x in e)
            self.say(own.subject, own.predicate, (inner, "literal"), _LITERAL)
        elif own.kind == "property" and own.items is not None:
            nodes = [self.blank() for _ in own.items]
            ends = [*nodes, (RDF + "nil", "uri")]
            self.say(own.subject, own.predicate, ends[0])
            for item, here, onward in zip(own.items, nodes, ends[1:], strict=True):
                self.say(here, RDF + "first", item)
                self.say(here, RDF + "rest", onward)
        elif own.kind == "property" and not own.filled:
            self.say(own.subject, own.predicate, (e.text or "", "literal"), own.datatype, None if own.datatype else own.lang)


def parse_rdfxml(text: str, file_id: str = "0", base: str = "") -> Iterator[tuple]:
    return RdfXmlReader(text, file_id, base).read()
