"""A Turtle parser (N-Triples and the common part of N3 included).

``parse`` gives rows (s_kind, s, p, o_kind, o, o_dt, o_lang). Blank node labels are scoped to the
document by the ``scope`` that prefixes them.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from weftline.functions.terms import BNODE, IRI, LITERAL, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, XSD_BOOLEAN, XSD_DECIMAL, XSD_DOUBLE, XSD_INTEGER

BASE_IRI = "http://localhost/"

Row = tuple[str, str, str, str, str, str, str]
Node = tuple[str, str, str, str]  # kind, lex, dt, lang

_NAME = r"[^\W\d_](?:[\w\-.]*[\w\-])?"
_LOCAL = r"(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[\w\-.:·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])*(?:[\w\-:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]))?"
_TOKEN = re.compile(
    rf"""
    (?P<skip>(?:\s+|\#[^\n\r]*)+)
  | (?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
  | (?P<long>\"\"\"(?:\"{{0,2}}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{{0,2}}(?:[^'\\]|\\.))*''')
  | (?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<bnode>_:[\w](?:[\w\-.]*[\w\-])?)
  | (?P<keyword>@(?:prefix|base)\b)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<pname>(?:{_NAME})?:(?:{_LOCAL})?)
  | (?P<word>[A-Za-z]+)
  | (?P<mark>\^\^|[.;,\[\]()=])
    """,
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_NAMED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class RdfError(ValueError):
    """Text that is not well-formed, or a document without what it must have."""


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "uU" and len(x) > 1:
            return chr(int(x[1:], 16))
        if x not in _NAMED:
            raise RdfError(f"unknown escape \\{x}")
        return _NAMED[x]

    return _ESCAPE.sub(one, text) if "\\" in text else text


class _Parser:
    def __init__(self, text: str, base: str, scope: str):
        self.base, self.scope, self.prefixes = base, scope, {}
        self.rows: list[Row] = []
        self.fresh = 0
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise RdfError(f"unexpected {text[at : at + 30]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.i = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if text is not None and t[1] != text or t[0] == "end":
            raise RdfError(f"expected {text or 'more'}, found {t[1] or 'the end'!r}")
        self.i += 1
        return t

    def document(self) -> list[Row]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            word = text.lstrip("@").lower()
            if kind == "keyword" or kind == "word" and word in ("prefix", "base"):
                self.take()
                if word == "prefix":
                    name = self.take()[1]
                    self.prefixes[name[:-1]] = self.iri(self.take())
                else:
                    self.base = self.iri(self.take())
                if kind == "keyword":
                    self.take(".")
                continue
            bare = text == "["
            subject = self.node()
            if not (bare and self.peek()[1] == "."):
                self.predicates(subject)
            self.take(".")
        return self.rows

    def iri(self, token: tuple[str, str]) -> str:
        kind, text = token
        if kind == "iri":
            return urljoin(self.base, unescape(text[1:-1])) if not re.match(r"<[A-Za-z][\w+.\-]*:", text) else unescape(text[1:-1])
        if kind != "pname":
            raise RdfError(f"expected an IRI, found {text!r}")
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise RdfError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def blank(self) -> Node:
        self.fresh += 1
        return (BNODE, f"{self.scope}g{self.fresh}", "", "")

    def predicates(self, subject: Node, end: str = ".") -> None:
        if subject[0] == LITERAL:
            raise RdfError("a literal can't be a subject")
        while True:
            kind, text = self.peek()
            if kind == "word" and text == "a":
                self.take()
                p = RDF_TYPE
            else:
                p = self.iri(self.take())
            while True:
                o = self.node()
                self.rows.append((subject[0], subject[1], p, *o))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (end, "."):
                return

    def node(self) -> Node:
        kind, text = self.take()
        if kind in ("iri", "pname"):
            return (IRI, self.iri((kind, text)), "", "")
        if kind == "bnode":
            return (BNODE, f"{self.scope}{text[2:]}", "", "")
        if kind in ("string", "long"):
            lex = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "lang":
                return (LITERAL, lex, "", self.take()[1][1:].lower())
            if self.peek()[1] == "^^":
                self.take()
                return (LITERAL, lex, self.iri(self.take()), "")
            return (LITERAL, lex, "", "")
        if kind == "number":
            dt = XSD_DOUBLE if "e" in text.lower() else XSD_DECIMAL if "." in text else XSD_INTEGER
            return (LITERAL, text, dt, "")
        if kind == "word" and text in ("true", "false"):
            return (LITERAL, text, XSD_BOOLEAN, "")
        if text == "[":
            node = self.blank()
            if self.peek()[1] != "]":
                self.predicates(node, "]")
            self.take("]")
            return node
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            nodes = [self.blank() for _ in items]
            for i, item in enumerate(items):
                self.rows.append((BNODE, nodes[i][1], RDF_FIRST, *item))
                rest = nodes[i + 1] if i + 1 < len(items) else (IRI, RDF_NIL, "", "")
                self.rows.append((BNODE, nodes[i][1], RDF_REST, *rest))
            return nodes[0] if nodes else (IRI, RDF_NIL, "", "")
        raise RdfError(f"unexpected {text!r}")


def parse(text: str, base: str = BASE_IRI, scope: str = "") -> list[Row]:
    return _Parser(text, base, scope).document()
