"""Turtle and TriG, file by file: a tokeniser and a recursive reader.

Directives (@base, @prefix, BASE, PREFIX), prefixed and relative names, ``a``, ``;`` and ``,``, all literal forms, blank
nodes with properties, collections and graph blocks. A statement that can't be read becomes a bad record and reading goes
on behind its final dot. Line-based statements are Turtle too, so a folder of mixed files may be read this way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from ..config import RDF_TYPE

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*)+)
    |(?P<iri><[^<>"{}|^`\s]*>)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<typed>\^\^)
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
    |(?P<blank>_:[^\s<>"'()\[\]{},;]+)
    |(?P<name>[^\s<>"'()\[\]{},;:@^]*:(?:[^\s<>"'()\[\]{},;\\]|\\.)*|[A-Za-z]+)
    |(?P<mark>[()\[\]{},;.=])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text) if "\\" in text else text


class _Reader:
    def __init__(self, text: str, file_id: str) -> None:
        self.text, self.at, self.kind, self.token = text, 0, "", ""
        self.base, self.prefixes, self.graph = "", {}, None
        self.file_id, self.blanks, self.out = file_id, 0, []
        self.next()

    def next(self) -> None:
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if m is None:
                self.kind, self.token = "bad", self.text[self.at]
                self.at += 1
                return
            self.at = m.end()
            if m.lastgroup != "space":
                self.kind, self.token = m.lastgroup, m[0]
                if self.kind in ("blank", "name") and self.token.endswith("."):  # the dot behind a name ends the statement
                    cut = len(self.token) - len(self.token.rstrip("."))
                    self.at -= cut
                    self.token = self.token[:-cut]
                return
        self.kind, self.token = "end", ""

    def fail(self) -> None:
        raise ValueError(f"unexpected {self.token!r}")

    def expect(self, mark: str) -> None:
        if self.token != mark:
            self.fail()
        self.next()

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:gen{self.file_id}x{self.blanks}"

    def iri(self) -> str:
        kind, token = self.kind, self.token
        prefix, _, local = token.partition(":")
        if kind != "iri" and (kind != "name" or ":" not in token or prefix not in self.prefixes):
            raise ValueError(f"unknown name {token!r}")
        self.next()
        if kind != "iri":
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        text = _unescape(token[1:-1])
        return urljoin(self.base, text) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text) else text

    def literal(self):
        token = self.token
        body = token[3:-3] if self.kind == "long" else token[1:-1]
        self.next()
        if self.kind == "at":
            lang = self.token[1:]
            self.next()
            return ("literal", _unescape(body), None, lang)
        if self.kind == "typed":
            self.next()
            return ("literal", _unescape(body), self.iri(), None)
        return ("literal", _unescape(body), None, None)

    def node(self):
        kind, token = self.kind, self.token
        if kind in ("string", "long"):
            return self.literal()
        if kind == "number":
            self.next()
            return ("literal", token, XSD + ("double" if "e" in token.lower() else "decimal" if "." in token else "integer"), None)
        if kind == "name" and token in ("true", "false"):
            self.next()
            return ("literal", token, XSD + "boolean", None)
        if kind == "blank":
            self.next()
            return ("blank", token, None, None)
        if token == "[":
            self.next()
            own = ("blank", self.fresh(), None, None)
            if self.token != "]":
                self.properties(own)
            self.expect("]")
            return own
        if token == "(":
            self.next()
            items = []
            while self.token != ")":
                if self.kind == "end":
                    self.fail()
                items.append(self.node())
            self.next()
            rest = ("uri", RDF + "nil", None, None)
            for item in reversed(items):
                cell = ("blank", self.fresh(), None, None)
                self.emit(cell, RDF + "first", item)
                self.emit(cell, RDF + "rest", rest)
                rest = cell
            return rest
        return ("uri", self.iri(), None, None)

    def emit(self, s, p, o) -> None:
        self.out.append((s[1], s[0], p, o[1], o[0], o[2], o[3], self.graph))

    def properties(self, subject) -> None:
        while True:
            while self.token == ";":
                self.next()
            if self.token in (".", "]", "}") or self.kind == "end":
                return
            if self.kind == "name" and self.token == "a":
                self.next()
                p = RDF_TYPE
            else:
                p = self.iri()
            while True:
                self.emit(subject, p, self.node())
                if self.token != ",":
                    break
                self.next()
            if self.token != ";":
                return

    def statement(self) -> None:
        word = self.token.lower()
        if word in ("@prefix", "prefix", "@base", "base") and self.kind in ("at", "name"):
            self.next()
            if word.endswith("prefix"):
                prefix = self.token.removesuffix(":")
                self.next()
                self.prefixes[prefix] = self.iri()
            else:
                self.base = urljoin(self.base, _unescape(self.token[1:-1]))
                self.next()
            if word[0] == "@":
                self.expect(".")
            return
        if word == "graph" and self.kind == "name":
            self.next()
        if self.token == "{":
            self.block(None)
            return
        alone = self.token == "["
        subject = self.node()
        if subject[0] == "literal":
            self.fail()
        if self.token == "{":
            self.block(subject[1])
            return
        if not (alone and self.token == "."):
            if self.token == ".":
                self.fail()
            self.properties(subject)
        if self.kind == "iri" or self.kind == "blank":  # a statement of four terms, as in N-Quads
            g = self.node()[1]
            self.out = [(*x[:7], g) if i >= self.mark else x for i, x in enumerate(self.out)]
        self.expect(".")

    def block(self, graph: str | None) -> None:
        self.next()
        self.graph = graph
        while self.token != "}":
            if self.kind == "end":
                self.fail()
            self.properties(self.node())
            if self.token == ".":
                self.next()
        self.graph = None
        self.next()

    def read(self) -> Iterator[tuple]:
        """Quads (with None) and bad pieces (with their text)."""
        while self.kind != "end":
            begin, self.mark = self.at - len(self.token), len(self.out)
            try:
                self.statement()
            except ValueError:
                del self.out[self.mark :]
                self.graph = None
                while self.kind != "end" and self.token != ".":
                    self.next()
                yield None, self.text[begin : self.at].strip()
                self.next()
            for quad in self.out:
                yield quad, None
            self.out = []


def parse_turtle(text: str, file_id: str = "0") -> Iterator[tuple]:
    return _Reader(text, file_id).read()
