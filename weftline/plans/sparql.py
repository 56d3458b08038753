"""SPARQL text to a syntax tree: queries (ASK, SELECT, CONSTRUCT) and updates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from weftline.functions.terms import RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, XSD_BOOLEAN, XSD_DECIMAL, XSD_DOUBLE, XSD_INTEGER
from weftline.sources.turtle import unescape


class SparqlError(ValueError):
    """A query that is not well-formed, or not supported."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    kind: str
    lex: str
    dt: str = ""
    lang: str = ""


@dataclass(frozen=True)
class Path:
    """op: link, inverse, sequence, alternative, optional, star, plus or negated; parts: paths, or IRIs for link and negated."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Call:
    """An expression: name is an operator or function; args expressions, terms, variables or, for exists, a Group."""

    name: str
    args: tuple
    distinct: bool = False
    separator: str = " "


Expr = Var | Term | Call
Node = Var | Term
Triple = tuple[Node, "Path | Var", Node]


@dataclass(eq=False)
class Group:
    parts: list = field(default_factory=list)


@dataclass
class Bgp:
    triples: list[Triple]


@dataclass
class Optional_:
    group: Group


@dataclass
class Minus:
    group: Group


@dataclass
class Union_:
    groups: list[Group]


@dataclass
class Named:
    """GRAPH: a group on a named graph; name: an IRI or variable."""

    name: Node
    group: Group


@dataclass
class Filter:
    expr: Expr


@dataclass
class Bind:
    expr: Expr
    var: str


@dataclass
class Values:
    names: list[str]
    rows: list[list[Term | None]]


@dataclass
class Select:
    items: list[tuple[Expr, str]] | None  # None: all
    where: Group
    distinct: bool = False
    group_by: list[tuple[Expr, str | None]] = field(default_factory=list)
    having: list[Expr] = field(default_factory=list)
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass
class Ask:
    where: Group


@dataclass
class Construct:
    template: list[Triple]
    where: Group


@dataclass
class Modify:
    delete: list[Triple]
    insert: list[Triple]
    where: Group | None  # None: the templates are data
    clear: bool = False


AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}

_TOKEN = re.compile(
    r"""
    (?P<skip>(?:\s+|\#[^\n\r]*)+)
  | (?P<iri><[^\x00-\x20<>"{}|^`\\]*>)
  | (?P<string>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<var>[?$]\w+)
  | (?P<bnode>_:\w(?:[\w\-.]*[\w\-])?)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)
  | (?P<pname>(?:[^\W\d_](?:[\w\-.]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[\w\-.:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])*(?:[\w\-:]|%[0-9A-Fa-f]{2}))?)?)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+\-*/|^?])
    """,
    re.X | re.S,
)


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise SparqlError(f"unexpected {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.i, self.prefixes, self.base, self.fresh = 0, {}, "", 0

    # --- tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else ("end", "")

    def at(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind in ("word", "mark") and (text.upper() if kind == "word" else text) in words

    def accept(self, *words: str) -> bool:
        if self.at(*words):
            self.i += 1
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.accept(word):
            raise SparqlError(f"expected {word}, found {self.peek()[1] or 'the end'!r}")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end":
            raise SparqlError("unexpected end")
        self.i += 1
        return t

    # --- prologue and forms
    def prologue(self) -> None:
        while self.at("PREFIX", "BASE"):
            if self.take()[1].upper() == "PREFIX":
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.take()[1][1:-1]
            else:
                self.base = self.take()[1][1:-1]

    def query(self):
        self.prologue()
        if self.accept("ASK"):
            self.from_()
            found = Ask(self.where())
            self.modifiers(Select(None, found.where))
        elif self.at("SELECT"):
            found = self.select()
        elif self.accept("CONSTRUCT"):
            if self.at("WHERE"):
                where = self.where()
                if any(not isinstance(p, Bgp) for p in where.parts):
                    raise SparqlError("CONSTRUCT WHERE takes triples only")
                found = Construct([t for p in where.parts for t in p.triples], where)
            else:
                template = self.template()
                self.from_()
                found = Construct(template, self.where())
        else:
            raise SparqlError(f"unsupported query form {self.peek()[1]!r}")
        self.end()
        return found

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")

    def from_(self) -> None:
        if self.at("FROM"):
            raise SparqlError("a query is answered from its own graph; FROM names another")

    def where(self) -> Group:
        self.accept("WHERE")
        return self.group()

    def updates(self) -> list[Modify]:
        out = []
        self.prologue()
        while self.peek()[0] != "end":
            out.append(self.update())
            if not self.accept(";"):
                break
            self.prologue()
        self.end()
        return out

    def update(self) -> Modify:
        nothing = Modify([], [], None)
        if self.accept("CLEAR", "DROP"):
            silent = self.accept("SILENT")
            if self.accept("DEFAULT", "ALL"):
                return Modify([], [], None, clear=True)
            if not self.accept("NAMED"):
                self.named(silent)
            return nothing
        if self.accept("CREATE"):
            self.named(self.accept("SILENT"))
            return nothing
        if self.accept("COPY", "MOVE", "ADD"):
            silent = self.accept("SILENT")
            for last in (False, True):
                if not self.accept("DEFAULT"):
                    self.named(silent)
                if not last:
                    self.expect("TO")
            return nothing  # of the default graph to itself
        if self.at("WITH"):
            raise SparqlError("an update changes its own graph; WITH names another")
        if self.at("INSERT") and self.peek(1)[1].upper() == "DATA":
            self.i += 2
            return Modify([], self.template(), None)
        if self.at("DELETE") and self.peek(1)[1].upper() == "DATA":
            self.i += 2
            return Modify(self.template(), [], None)
        if self.at("DELETE") and self.peek(1)[1].upper() == "WHERE":
            self.i += 2
            template = self.template()
            return Modify(template, [], Group([Bgp(template)]))
        delete, insert = [], []
        if self.accept("DELETE"):
            delete = self.template()
            if any(isinstance(n, Var) and n.name.startswith("_:") for t in delete for n in t):
                raise SparqlError("blank nodes can't be deleted by a template")
        if self.accept("INSERT"):
            insert = self.template()
        elif not delete:
            raise SparqlError(f"unsupported update {self.peek()[1]!r}")
        if self.at("USING"):
            raise SparqlError("an update reads its own graph; USING names another")
        return Modify(delete, insert, self.where())

    def named(self, silent: bool) -> None:
        """A named graph, which nothing holds: an error unless it may be silent."""
        self.accept("GRAPH")
        name = self.iri(self.take())
        if not silent:
            raise SparqlError(f"there are no named graphs, so there is no {name}")

    def select(self) -> Select:
        self.expect("SELECT")
        distinct = self.accept("DISTINCT", "REDUCED")
        items: list[tuple[Expr, str]] | None = []
        if self.accept("*"):
            items = None
        else:
            while self.peek()[0] == "var" or self.at("("):
                if self.accept("("):
                    e = self.expression()
                    self.expect("AS")
                    items.append((e, self.var()))
                    self.expect(")")
                else:
                    name = self.var()
                    items.append((Var(name), name))
        self.from_()
        return self.modifiers(Select(items, self.where(), distinct))

    def modifiers(self, found: Select) -> Select:
        if self.accept("GROUP"):
            self.expect("BY")
            while self.peek()[0] == "var" or self.at("(") or self.peek()[0] == "word" and self.peek(1)[1] == "(" and not self.at("HAVING"):
                if self.accept("("):
                    e, name = self.expression(), None
                    if self.accept("AS"):
                        name = self.var()
                    self.expect(")")
                    found.group_by.append((e, name))
                elif self.peek()[0] == "var":
                    name = self.var()
                    found.group_by.append((Var(name), name))
                else:
                    found.group_by.append((self.primary(), None))
        if self.accept("HAVING"):
            while self.at("("):
                found.having.append(self.primary())
        if self.accept("ORDER"):
            self.expect("BY")
            while self.at("ASC", "DESC", "(") or self.peek()[0] == "var":
                down = self.at("DESC")
                self.accept("ASC", "DESC")
                found.order.append((self.primary(), not down))
        while self.at("LIMIT", "OFFSET"):
            which = self.take()[1].upper()
            n = int(self.take()[1])
            if which == "LIMIT":
                found.limit = n
            else:
                found.offset = n
        if self.at("VALUES"):
            found.where.parts.append(self.values())
        return found

    # --- patterns
    def group(self) -> Group:
        self.expect("{")
        if self.at("SELECT"):
            found = Group([self.select()])
            self.expect("}")
            return found
        g = Group()
        while not self.accept("}"):
            if self.accept("."):
                continue
            if self.accept("OPTIONAL"):
                g.parts.append(Optional_(self.group()))
            elif self.accept("MINUS"):
                g.parts.append(Minus(self.group()))
            elif self.accept("FILTER"):
                g.parts.append(Filter(self.constraint()))
            elif self.accept("BIND"):
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                g.parts.append(Bind(e, self.var()))
                self.expect(")")
            elif self.at("VALUES"):
                g.parts.append(self.values())
            elif self.at("SERVICE", "LOAD"):
                raise SparqlError("remote data is not supported")
            elif self.accept("GRAPH"):
                name = self.node([], False)
                g.parts.append(Named(name, self.group()))
            elif self.at("{"):
                groups = [self.group()]
                while self.accept("UNION"):
                    groups.append(self.group())
                g.parts.append(Union_(groups) if len(groups) > 1 else groups[0])
            else:
                triples: list[Triple] = []
                self.subject_triples(triples, paths=True)
                last = g.parts[-1] if g.parts else None
                if isinstance(last, Bgp):
                    last.triples += triples
                else:
                    g.parts.append(Bgp(triples))
        return g

    def values(self) -> Values:
        self.expect("VALUES")
        if self.peek()[0] == "var":
            names, one = [self.var()], True
        else:
            self.expect("(")
            names, one = [], False
            while not self.accept(")"):
                names.append(self.var())
        rows = []
        self.expect("{")
        while not self.accept("}"):
            if one:
                rows.append([self.value()])
            else:
                self.expect("(")
                row = []
                while not self.accept(")"):
                    row.append(self.value())
                if len(row) != len(names):
                    raise SparqlError("VALUES row of another length")
                rows.append(row)
        return Values(names, rows)

    def value(self) -> Term | None:
        if self.accept("UNDEF"):
            return None
        found = self.node([], False)
        if not isinstance(found, Term):
            raise SparqlError("VALUES takes terms only")
        return found

    def template(self) -> list[Triple]:
        self.expect("{")
        triples: list[Triple] = []
        while not self.accept("}"):
            if not self.accept("."):
                self.subject_triples(triples, paths=False)
        return triples

    def blank(self) -> Var:
        self.fresh += 1
        return Var(f"_:b{self.fresh}")

    def subject_triples(self, out: list[Triple], paths: bool) -> None:
        bare = self.at("[", "(")
        s = self.node(out, paths)
        if bare and (self.at(".", "}") or self.peek()[0] == "end"):
            return
        self.predicate_objects(s, out, paths)

    def predicate_objects(self, s: Node, out: list[Triple], paths: bool) -> None:
        while True:
            p = Var(self.var()) if self.peek()[0] == "var" else self.path() if paths else self.link()
            while True:
                out.append((s, p, self.node(out, paths)))
                if not self.accept(","):
                    break
            if not self.at(";"):
                return
            while self.accept(";"):
                pass
            if self.at(".", "}", "]") or self.peek()[0] == "end":
                return

    def link(self) -> Path:
        if self.peek() == ("word", "a"):
            self.i += 1
            return Path("link", (RDF_TYPE,))
        return Path("link", (self.iri(self.take()),))

    def path(self) -> Path:
        parts = [self.path_sequence()]
        while self.accept("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alternative", tuple(parts))

    def path_sequence(self) -> Path:
        parts = [self.path_step()]
        while self.accept("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("sequence", tuple(parts))

    def path_step(self) -> Path:
        inverse = self.accept("^")
        if self.accept("!"):
            names = []
            many = self.accept("(")
            while not (many and self.accept(")")):
                if self.accept("^"):
                    raise SparqlError("inverse links in a negated set are not supported")
                names.append(self.link().parts[0])
                if not many:
                    break
                self.accept("|")
            found = Path("negated", tuple(names))
        elif self.accept("("):
            found = self.path()
            self.expect(")")
        else:
            found = self.link()
        for mark, op in (("?", "optional"), ("*", "star"), ("+", "plus")):
            if self.accept(mark):
                found = Path(op, (found,))
                break
        return Path("inverse", (found,)) if inverse else found

    # --- terms
    def var(self) -> str:
        kind, text = self.take()
        if kind != "var":
            raise SparqlError(f"expected a variable, found {text!r}")
        return text[1:]

    def iri(self, token: tuple[str, str]) -> str:
        kind, text = token
        if kind == "iri":
            from urllib.parse import urljoin

            return text[1:-1] if not self.base or re.match(r"<[A-Za-z][\w+.\-]*:", text) else urljoin(self.base, text[1:-1])
        if kind != "pname":
            raise SparqlError(f"expected an IRI, found {text!r}")
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise SparqlError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def node(self, out: list[Triple], paths: bool) -> Node:
        kind, text = self.take()
        if kind == "var":
            return Var(text[1:])
        if kind in ("iri", "pname"):
            return Term("iri", self.iri((kind, text)))
        if kind == "bnode":
            return Var(text)
        if kind == "string":
            return self.literal(text)
        if kind == "number" or text in "+-" and self.peek()[0] == "number":
            number = text if kind == "number" else text.replace("+", "") + self.take()[1]
            return Term("lit", number, XSD_DOUBLE if "e" in number.lower() else XSD_DECIMAL if "." in number else XSD_INTEGER)
        if kind == "word" and text.lower() in ("true", "false"):
            return Term("lit", text.lower(), XSD_BOOLEAN)
        if text == "[":
            found = self.blank()
            if not self.at("]"):
                self.predicate_objects(found, out, paths)
            self.expect("]")
            return found
        if text == "(":
            items = []
            while not self.accept(")"):
                items.append(self.node(out, paths))
            nodes = [self.blank() for _ in items]
            for i, item in enumerate(items):
                out.append((nodes[i], Path("link", (RDF_FIRST,)), item))
                out.append((nodes[i], Path("link", (RDF_REST,)), nodes[i + 1] if i + 1 < len(nodes) else Term("iri", RDF_NIL)))
            return nodes[0] if nodes else Term("iri", RDF_NIL)
        raise SparqlError(f"unexpected {text!r}")

    def literal(self, text: str) -> Term:
        lex = unescape(text[3:-3] if text[:3] in ('"""', "'''") and len(text) >= 6 else text[1:-1])
        if self.peek()[0] == "lang":
            return Term("lit", lex, "", self.take()[1][1:].lower())
        if self.accept("^^"):
            return Term("lit", lex, self.iri(self.take()))
        return Term("lit", lex)

    # --- expressions
    def constraint(self) -> Expr:
        return self.primary()

    def expression(self) -> Expr:
        found = self.conjunction()
        while self.accept("||"):
            found = Call("||", (found, self.conjunction()))
        return found

    def conjunction(self) -> Expr:
        found = self.comparison()
        while self.accept("&&"):
            found = Call("&&", (found, self.comparison()))
        return found

    def comparison(self) -> Expr:
        left = self.sum()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.accept(op):
                return Call(op, (left, self.sum()))
        negated = self.at("NOT")
        if negated and self.peek(1)[1].upper() == "IN" or self.at("IN"):
            self.i += 2 if negated else 1
            return Call("NOT IN" if negated else "IN", (left, *self.arguments()))
        return left

    def sum(self) -> Expr:
        found = self.product()
        while self.at("+", "-"):
            op = self.take()[1]
            found = Call(op, (found, self.product()))
        return found

    def product(self) -> Expr:
        found = self.unary()
        while self.at("*", "/"):
            op = self.take()[1]
            found = Call(op, (found, self.unary()))
        return found

    def unary(self) -> Expr:
        if self.accept("!"):
            return Call("!", (self.unary(),))
        if self.accept("-"):
            return Call("-", (Term("lit", "0", XSD_INTEGER), self.unary()))
        self.accept("+")
        return self.primary()

    def arguments(self) -> tuple:
        self.expect("(")
        out = []
        while not self.accept(")"):
            out.append(self.expression())
            if not self.at(")"):
                self.expect(",")
        return tuple(out)

    def primary(self) -> Expr:
        kind, text = self.peek()
        if self.accept("("):
            found = self.expression()
            self.expect(")")
            return found
        if kind == "var":
            return Var(self.var())
        if kind == "word":
            name = text.upper()
            if name in ("TRUE", "FALSE"):
                return self.node([], False)
            self.i += 1
            if name == "NOT":
                self.expect("EXISTS")
                return Call("NOT EXISTS", (self.group(),))
            if name == "EXISTS":
                return Call("EXISTS", (self.group(),))
            if name in AGGREGATES:
                return self.aggregate(name)
            return Call(name, self.arguments())
        if kind in ("iri", "pname"):
            found = Term("iri", self.iri(self.take()))
            return Call("CAST", (found, *self.arguments())) if self.at("(") else found
        return self.node([], False)

    def aggregate(self, name: str) -> Call:
        self.expect("(")
        distinct = self.accept("DISTINCT")
        args: tuple = () if self.accept("*") else (self.expression(),)
        separator = " "
        if self.accept(";"):
            self.expect("SEPARATOR")
            self.expect("=")
            separator = self.literal(self.take()[1]).lex
        self.expect(")")
        return Call(name, args, distinct, separator)


def parse_query(text: str):
    """An Ask, Select or Construct."""
    return _Parser(text).query()


def parse_update(text: str) -> list[Modify]:
    """The operations of an update, in order."""
    return _Parser(text).updates()
