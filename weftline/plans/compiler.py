"""SPARQL patterns as DataFrame plans, for any number of graphs at once.

A solution is a row of graph_id and one term struct for each variable, null where unbound. Every join
is an equi-join on graph_id and the shared variables, so Catalyst picks its order and strategy; a
variable that may be unbound on one side is compared null-tolerantly. Errors in expressions are nulls:
a filter drops them, BIND leaves the variable unbound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import terms as t
from weftline.functions.terms import BNODE, IRI, LITERAL, NUMERIC, XSD, XSD_BOOLEAN, XSD_DATETIME, XSD_DECIMAL, XSD_DOUBLE, XSD_INTEGER, XSD_STRING

from . import sparql as q

TERM_DDL = "struct<kind:string,lex:string,dt:string,lang:string>"
#: Rounds after which an unbounded property path must have closed.
PATH_ROUNDS = 64


@dataclass
class Value:
    """A compiled expression: ``kind`` is term, bool, int (a whole number), dec (decimal) or num (double)."""

    kind: str
    col: Column


@dataclass
class Solutions:
    """rows: graph_id and one column ``?name`` for each variable; loose: those that may be null."""

    rows: DataFrame
    names: list[str]
    loose: set[str]


def col(name: str) -> str:
    return "?" + name


def _ref(name: str) -> Column:
    return F.col(f"`?{name}`")


def constant(x: q.Term) -> Column:
    return t.term(x.kind, x.lex, "" if x.dt == XSD_STRING else x.dt, x.lang)


# ---------------------------------------------------------------- expressions


def as_term(v: Value) -> Column:
    if v.kind == "term":
        return v.col
    if v.kind == "bool":
        return t.literal(v.col.cast("string"), XSD_BOOLEAN)
    if v.kind == "int":
        return t.literal(v.col.cast("string"), XSD_INTEGER)
    if v.kind == "dec":
        return t.literal(_decimal_text(v.col), XSD_DECIMAL)
    return t.literal(v.col.cast("string"), XSD_DOUBLE)


def _decimal_text(c: Column) -> Column:
    """Without trailing zeros."""
    return F.when(c == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def as_bool(v: Value) -> Column:
    """The effective boolean value; null is an error."""
    if v.kind == "bool":
        return v.col
    if v.kind in ("num", "int", "dec"):
        return v.col != 0
    c = v.col
    return (
        F.when(c.kind != LITERAL, F.lit(None))
        .when(c.dt == XSD_BOOLEAN, c.lex.isin("true", "1"))
        .when(c.dt.isin(NUMERIC), F.coalesce(c.lex.try_cast("double") != 0, F.lit(False)))
        .when((c.dt == "") | (c.dt == XSD_STRING), F.length(c.lex) > 0)
        .cast("boolean")
    )


#: Whole numbers; decimals; and narrower decimals, whose products and quotients keep their digits.
WHOLE, EXACT, NARROW = "decimal(38,0)", "decimal(38,18)", "decimal(19,9)"
_INEXACT = (XSD_DOUBLE, XSD + "float")
_WHOLE_TYPES = [x for x in NUMERIC if x not in (XSD_DECIMAL, *_INEXACT)]


@dataclass
class Number:
    """A number by its datatype: whole for integers, exact for them and decimals, double for all; null where it isn't one."""

    whole: Column
    exact: Column
    double: Column


def as_numbers(v: Value) -> Number:
    none = lambda kind: F.lit(None).cast(kind)
    if v.kind == "bool":
        return Number(none(WHOLE), none(EXACT), none("double"))
    if v.kind == "num":
        return Number(none(WHOLE), none(EXACT), v.col.cast("double"))
    if v.kind == "dec":
        return Number(none(WHOLE), v.col.try_cast(EXACT), v.col.cast("double"))
    if v.kind == "int":
        return Number(v.col.try_cast(WHOLE), v.col.try_cast(EXACT), v.col.cast("double"))
    c = v.col
    of = lambda kinds, kind: F.when((c.kind == LITERAL) & c.dt.isin(list(kinds)), c.lex.try_cast(kind))
    return Number(of(_WHOLE_TYPES, WHOLE), of([*_WHOLE_TYPES, XSD_DECIMAL], EXACT), of(NUMERIC, "double"))


def as_number(v: Value) -> Column:
    return as_numbers(v).double


def _of_type(whole: Column | None, exact: Column, double: Column) -> Value:
    """The term of the narrowest type that has a value."""
    found = [] if whole is None else [F.when(whole.isNotNull(), t.term(LITERAL, whole.cast("string"), XSD_INTEGER))]
    found += [F.when(exact.isNotNull(), t.term(LITERAL, _decimal_text(exact), XSD_DECIMAL)), F.when(double.isNotNull(), t.term(LITERAL, double.cast("string"), XSD_DOUBLE))]
    return Value("term", F.coalesce(*found))


def as_text(v: Value) -> Column:
    """The lexical form of a literal that is a string; null otherwise."""
    c = as_term(v)
    return F.when((c.kind == LITERAL) & ((c.dt == "") | (c.dt == XSD_STRING)), c.lex)


def _compare(op: str, a: Value, b: Value) -> Column:
    if a.kind == b.kind == "bool":
        pairs = (a.col, b.col)
        return {"=": pairs[0] == pairs[1], "!=": pairs[0] != pairs[1], "<": pairs[0] < pairs[1], ">": pairs[0] > pairs[1], "<=": pairs[0] <= pairs[1], ">=": pairs[0] >= pairs[1]}[op]
    x, y = as_term(a), as_term(b)
    nx, ny = as_numbers(a), as_numbers(b)
    both = nx.double.isNotNull() & ny.double.isNotNull()
    exact = nx.exact.isNotNull() & ny.exact.isNotNull()
    sign = {"<": lambda m, n: m < n, ">": lambda m, n: m > n, "<=": lambda m, n: m <= n, ">=": lambda m, n: m >= n, "=": lambda m, n: m == n, "!=": lambda m, n: m != n}[op]
    unbound = x.isNull() | y.isNull()
    first = F.when(unbound, F.lit(None)).when(exact, sign(nx.exact, ny.exact)).when(both, sign(nx.double, ny.double))
    if op in ("=", "!="):
        return first.otherwise(sign(x, y)).cast("boolean")
    plain = (x.kind == LITERAL) & (y.kind == LITERAL) & (x.dt == y.dt) & ~x.dt.isin(NUMERIC)
    return first.when(plain, sign(x.lex, y.lex)).cast("boolean")


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    x, y = as_numbers(a), as_numbers(b)
    act = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    exact = act(x.exact, y.exact)
    if op in "*/":
        m, n = x.exact.try_cast(NARROW), y.exact.try_cast(NARROW)
        exact = F.coalesce(F.when((m == x.exact) & (n == y.exact), act(m, n)), exact)
    both = x.exact.isNotNull() & y.exact.isNotNull()
    double = act(x.double, y.double)
    if op == "/":  # a quotient of exact numbers by zero is an error
        return _of_type(None, exact, F.when(~both | (y.double != 0), double))
    return _of_type(act(x.whole, y.whole), exact, double)


def _rounded(v: Value, act: Callable[[Column], Column]) -> Value:
    """A function that keeps the number's type."""
    x = as_numbers(v)
    return _of_type(x.whole if act is not F.abs else F.abs(x.whole), act(x.exact), F.when(x.exact.isNull(), act(x.double).cast("double")))


def _like(source: Value, text: Column) -> Value:
    """A string that keeps the language of the source."""
    c = as_term(source)
    return Value("term", F.when(text.isNotNull(), t.term(LITERAL, text, "", F.coalesce(c.lang, F.lit("")))))


#: Year, month, day, hours, minutes, seconds and zone of a date or time of day.
_MOMENT = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$"


def _part(v: Value, i: int) -> Column:
    """A part of a moment as it is written, whatever the session's zone; null for what is no moment."""
    c = as_term(v)
    lex = F.when((c.kind == LITERAL) & c.lex.rlike(_MOMENT) & F.try_to_timestamp(F.substring(c.lex, 1, 10)).isNotNull(), c.lex)
    return F.regexp_extract(lex, _MOMENT, i)


def _zone(v: Value) -> Column:
    """A moment's zone as a duration; without one an error."""
    z = _part(v, 7)
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    said = F.concat(F.when(F.startswith(z, F.lit("-")), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(z == "Z", "PT0S").when(z != "", F.when((hours == 0) & (minutes == 0), "PT0S").otherwise(said))


def _calls() -> dict[str, Callable[..., Value]]:
    term, boolean, whole, number = (lambda k: lambda c: Value(k, c))("term"), lambda c: Value("bool", c), lambda c: Value("int", c), lambda c: Value("num", c)
    lit_ = lambda c, dt="", lang="": Value("term", t.literal(c, dt, lang))
    lex = lambda v: F.when(as_term(v).kind != BNODE, as_term(v).lex)

    def substr(s: Value, start: Value, size: Value | None = None) -> Value:
        text, at = as_text(s), as_number(start).cast("int")
        n = as_number(size).cast("int") if size is not None else F.length(text)
        return _like(s, F.substring(text, at, n))

    def replace(s: Value, pattern: Value, by: Value, flags: Value | None = None) -> Value:
        p = as_text(pattern) if flags is None else F.concat(F.lit("(?"), as_text(flags), F.lit(")"), as_text(pattern))
        return _like(s, F.regexp_replace(as_text(s), p, as_text(by)))

    def regex(s: Value, pattern: Value, flags: Value | None = None) -> Value:
        p = as_text(pattern) if flags is None else F.concat(F.lit("(?"), as_text(flags), F.lit(")"), as_text(pattern))
        return boolean(F.regexp_like(as_text(s), p))

    def lang_matches(tag: Value, wanted: Value) -> Value:
        a, b = F.lower(as_text(tag)), F.lower(as_text(wanted))
        return boolean(F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-")))))

    def concat(*parts: Value) -> Value:
        langs = [as_term(p).lang for p in parts]
        same = reduce(lambda a, b: a & b, [x == langs[0] for x in langs], F.lit(True))
        return lit_(F.concat(*[as_text(p) for p in parts]), "", F.when(same, langs[0]).otherwise("")) if parts else lit_(F.lit(""))

    def datatype(v: Value) -> Value:
        c = as_term(v)
        dt = F.when(c.lang != "", t.RDF + "langString").when(c.dt == "", XSD_STRING).otherwise(c.dt)
        return term(t.iri(F.when(c.kind == LITERAL, dt)))

    def strlang(v: Value, tag: Value) -> Value:
        simple = F.when(as_term(v).lang == "", as_text(v))
        return lit_(F.when(as_text(tag).isNotNull(), simple), "", F.lower(as_text(tag)))

    def if_(test: Value, yes: Value, no: Value) -> Value:
        b = as_bool(test)
        return term(F.when(b, as_term(yes)).when(~b, as_term(no)))

    def cast(to: Value, v: Value) -> Value:
        c, dt = as_term(v), to.col.lex
        usable = F.when(c.kind == LITERAL, c.lex)
        fits = F.when(dt == XSD_STRING, F.lit(True)).when(dt == XSD_BOOLEAN, usable.isin("true", "false", "0", "1")).when(dt.isin(NUMERIC), usable.try_cast("double").isNotNull()).otherwise(F.lit(True))
        text = F.when(dt == XSD_INTEGER, F.coalesce(usable.try_cast(WHOLE).cast("string"), F.floor(usable.try_cast("double")).cast("string"), usable)).otherwise(F.when(dt == XSD_STRING, lex(v)).otherwise(usable))
        return Value("term", F.when(fits & text.isNotNull(), t.term(LITERAL, text, F.when(dt == XSD_STRING, "").otherwise(dt))))

    return {
        "STR": lambda v: lit_(lex(v)),
        "LANG": lambda v: lit_(F.when(as_term(v).kind == LITERAL, as_term(v).lang)),
        "DATATYPE": datatype,
        "IRI": lambda v: term(t.iri(F.when((as_term(v).kind == IRI) | as_text(v).isNotNull(), as_term(v).lex))),
        "URI": lambda v: term(t.iri(F.when((as_term(v).kind == IRI) | as_text(v).isNotNull(), as_term(v).lex))),
        "STRLANG": strlang,
        "STRDT": lambda v, dt: lit_(F.when(as_term(v).lang == "", as_text(v)), as_term(dt).lex),
        "CONCAT": concat,
        "STRLEN": lambda v: whole(F.length(as_text(v)).cast("long")),
        "SUBSTR": substr,
        "UCASE": lambda v: _like(v, F.upper(as_text(v))),
        "LCASE": lambda v: _like(v, F.lower(as_text(v))),
        "STRSTARTS": lambda a, b: boolean(F.startswith(as_text(a), as_text(b))),
        "STRENDS": lambda a, b: boolean(F.endswith(as_text(a), as_text(b))),
        "CONTAINS": lambda a, b: boolean(F.contains(as_text(a), as_text(b))),
        "STRBEFORE": lambda a, b: _like(a, F.when(F.contains(as_text(a), as_text(b)), F.substring(as_text(a), F.lit(1), F.instr(as_text(a), as_text(b)) - 1)).when(as_text(a).isNotNull() & as_text(b).isNotNull(), "")),
        "STRAFTER": lambda a, b: _like(a, F.when(F.contains(as_text(a), as_text(b)), F.substring(as_text(a), F.instr(as_text(a), as_text(b)) + F.length(as_text(b)), F.length(as_text(a)))).when(as_text(a).isNotNull() & as_text(b).isNotNull(), "")),
        "REPLACE": replace,
        "REGEX": regex,
        "ENCODE_FOR_URI": lambda v: lit_(F.replace(F.replace(F.url_encode(as_text(v)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))),
        "LANGMATCHES": lang_matches,
        "ABS": lambda v: _rounded(v, F.abs),
        "ROUND": lambda v: _rounded(v, lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)"))),
        "CEIL": lambda v: _rounded(v, F.ceil),
        "FLOOR": lambda v: _rounded(v, F.floor),
        "RAND": lambda: number(F.rand()),
        "NOW": lambda: lit_(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), XSD_DATETIME),
        "YEAR": lambda v: whole(_part(v, 1).try_cast("long")),
        "MONTH": lambda v: whole(_part(v, 2).try_cast("long")),
        "DAY": lambda v: whole(_part(v, 3).try_cast("long")),
        "HOURS": lambda v: whole(_part(v, 4).try_cast("long")),
        "MINUTES": lambda v: whole(_part(v, 5).try_cast("long")),
        "SECONDS": lambda v: Value("dec", _part(v, 6).try_cast(EXACT)),
        "TZ": lambda v: lit_(_part(v, 7)),
        "TIMEZONE": lambda v: lit_(_zone(v), XSD + "dayTimeDuration"),
        "MD5": lambda v: lit_(F.md5(as_text(v))),
        "SHA1": lambda v: lit_(F.sha1(as_text(v))),
        "SHA256": lambda v: lit_(F.sha2(as_text(v), 256)),
        "SHA384": lambda v: lit_(F.sha2(as_text(v), 384)),
        "SHA512": lambda v: lit_(F.sha2(as_text(v), 512)),
        "ISIRI": lambda v: boolean(as_term(v).kind == IRI),
        "ISURI": lambda v: boolean(as_term(v).kind == IRI),
        "ISBLANK": lambda v: boolean(as_term(v).kind == BNODE),
        "ISLITERAL": lambda v: boolean(as_term(v).kind == LITERAL),
        "ISNUMERIC": lambda v: boolean(F.when(as_term(v).isNotNull(), as_number(v).isNotNull())),
        "SAMETERM": lambda a, b: boolean(as_term(a) == as_term(b)),
        "UUID": lambda: term(t.iri(F.concat(F.lit("urn:uuid:"), F.uuid()))),
        "STRUUID": lambda: lit_(F.uuid()),
        "IF": if_,
        "COALESCE": lambda *vs: term(F.coalesce(*map(as_term, vs))),
        "CAST": cast,
    }


CALLS = _calls()


class Compiler:
    """Compiles against one frame of triples that holds all graphs (graph_id; s_kind, s, p, o_kind, o, o_dt, o_lang)."""

    def __init__(self, triples: DataFrame, graphs: DataFrame | None = None):
        self.triples, self.made = triples, count()
        self.graphs = graphs if graphs is not None else triples.select("graph_id").distinct()

    # ------------------------------------------------------------ expressions
    def expr(self, e: q.Expr, names: set[str], aggregates: dict[q.Call, str] | None = None) -> Value:
        if isinstance(e, q.Var):
            return Value("term", _ref(e.name) if e.name in names else F.lit(None).cast(TERM_DDL))
        if isinstance(e, q.Term):
            return Value("term", constant(e))
        if aggregates is not None and e in aggregates:
            found = F.col(f"`{aggregates[e]}`")
            return Value("bool", found) if e.name in ("EXISTS", "NOT EXISTS") else Value("term", found)
        args = e.args
        if e.name == "BOUND":
            return Value("bool", _ref(args[0].name).isNotNull() if args[0].name in names else F.lit(False))
        if e.name in ("EXISTS", "NOT EXISTS"):
            raise q.SparqlError("EXISTS is supported in filters only")
        if e.name == "BNODE":
            # one for each solution, and for each text in it; told by what is bound, so a lost task makes the same again
            key = F.to_json(F.struct("graph_id", *[_ref(n) for n in sorted(names)]))
            text = as_text(self.expr(args[0], names, aggregates)) if args else F.lit(f"#{next(self.made)}")
            return Value("term", F.when(text.isNotNull(), t.term(BNODE, F.concat(F.lit("n"), F.md5(F.concat_ws("|", key, text))))))
        v = [self.expr(a, names, aggregates) for a in args]
        if e.name in ("||", "&&"):
            a, b = as_bool(v[0]), as_bool(v[1])
            return Value("bool", a | b if e.name == "||" else a & b)
        if e.name == "!":
            return Value("bool", ~as_bool(v[0]))
        if e.name in ("=", "!=", "<", ">", "<=", ">="):
            return Value("bool", _compare(e.name, *v))
        if e.name in ("IN", "NOT IN"):
            hit = reduce(lambda a, b: a | b, [_compare("=", v[0], x) for x in v[1:]], F.lit(False))
            return Value("bool", hit if e.name == "IN" else ~hit)
        if e.name in ("+", "-", "*", "/"):
            return _arithmetic(e.name, *v)
        if e.name not in CALLS:
            raise q.SparqlError(f"unsupported function {e.name}")
        return CALLS[e.name](*v)

    # ------------------------------------------------------------ patterns
    def unit(self) -> Solutions:
        return Solutions(self.graphs.select("graph_id"), [], set())

    def pattern(self, s: q.Node, p, o: q.Node) -> Solutions:
        rows = self.triples
        if isinstance(p, q.Path):
            if p.op in ("plus", "star") and (isinstance(s, q.Term) or isinstance(o, q.Term)):
                return self._ends(self.reached(p, s, o), s, o)
            if p.op != "link":
                return self._ends(self.path(p), s, o)
            rows = rows.where(F.col("p") == p.parts[0])
        if isinstance(s, q.Term):
            rows = rows.where((F.col("s_kind") == s.kind) & (F.col("s") == s.lex))
        if isinstance(o, q.Term):
            dt = "" if o.dt == XSD_STRING else o.dt
            rows = rows.where((F.col("o_kind") == o.kind) & (F.col("o") == o.lex) & (F.col("o_dt") == dt) & (F.col("o_lang") == o.lang))
        found: dict[str, Column] = {}
        for node, made in ((s, t.subject()), (p, t.predicate()), (o, t.object_())):
            if isinstance(node, q.Var):
                if node.name in found:
                    rows = rows.where(found[node.name] == made)
                else:
                    found[node.name] = made
        return Solutions(rows.select("graph_id", *[c.alias(col(n)) for n, c in found.items()]), list(found), set())

    def _ends(self, pairs: DataFrame, s: q.Node, o: q.Node) -> Solutions:
        """Solutions from (graph_id, x, y)."""
        if isinstance(s, q.Term):
            pairs = pairs.where(F.col("x") == constant(s))
        if isinstance(o, q.Term):
            pairs = pairs.where(F.col("y") == constant(o))
        if isinstance(s, q.Var) and s == o:
            return Solutions(pairs.where("x = y").select("graph_id", F.col("x").alias(col(s.name))), [s.name], set())
        named = [(n.name, c) for n, c in ((s, "x"), (o, "y")) if isinstance(n, q.Var)]
        return Solutions(pairs.select("graph_id", *[F.col(c).alias(col(n)) for n, c in named]), [n for n, _ in named], set())

    def reached(self, p: q.Path, s: q.Node, o: q.Node) -> DataFrame:
        """graph_id, x, y of an unbounded path from its bound end only, one step after the other with what the last one found."""
        from weftline.operators.storage import cut

        pairs = self.path(p.parts[0])
        back = not isinstance(s, q.Term)
        if back:
            pairs = pairs.select("graph_id", F.col("y").alias("x"), F.col("x").alias("y"))
        end = constant(o if back else s)
        steps = cut(pairs.distinct())
        start = self.graphs.select("graph_id").distinct().select("graph_id", end.alias("y"))
        now = cut(start.join(steps.withColumnRenamed("y", "z"), (F.col("y") == F.col("x")) & (start["graph_id"] == steps["graph_id"])).select(start["graph_id"], F.col("z").alias("y")).distinct())
        found = now
        while now.limit(1).count():
            step = steps.select(F.col("graph_id").alias("g"), "x", F.col("y").alias("z"))
            more = now.join(step, (F.col("graph_id") == F.col("g")) & (F.col("y") == F.col("x"))).select("graph_id", F.col("z").alias("y")).distinct()
            now = cut(more.join(found, ["graph_id", "y"], "left_anti"))
            found = found.unionByName(now)  # written tables, one a step
        if p.op == "star":
            found = found.unionByName(start).distinct()
        ends = found.select("graph_id", end.alias("x"), "y")
        return ends.select("graph_id", F.col("y").alias("x"), F.col("x").alias("y")) if back else ends

    def path(self, p: q.Path) -> DataFrame:
        """graph_id, x, y: the ends that the path connects."""
        if p.op in ("link", "negated"):
            hit = F.col("p").isin(*p.parts)
            rows = self.triples.where(hit if p.op == "link" else ~hit)
            return rows.select("graph_id", t.subject().alias("x"), t.object_().alias("y"))
        parts = [self.path(x) for x in p.parts]
        if p.op == "inverse":
            return parts[0].select("graph_id", F.col("y").alias("x"), F.col("x").alias("y"))
        if p.op == "alternative":
            return reduce(DataFrame.unionByName, parts)
        if p.op == "sequence":
            found = parts[0]
            for step in parts[1:]:
                step = step.select("graph_id", F.col("x").alias("m"), F.col("y").alias("z"))
                found = found.withColumnRenamed("y", "m").join(step, ["graph_id", "m"]).select("graph_id", "x", F.col("z").alias("y"))
            return found
        nodes = self.triples.select("graph_id", t.subject().alias("x")).unionByName(self.triples.select("graph_id", t.object_().alias("x"))).distinct()
        itself = nodes.select("graph_id", "x", F.col("x").alias("y"))
        if p.op == "optional":
            return parts[0].unionByName(itself).distinct()
        closed = closure(parts[0])
        return closed if p.op == "plus" else closed.unionByName(itself).distinct()

    def join(self, a: Solutions, b: Solutions, how: str = "inner") -> Solutions:
        """Joins compatible solutions. Where a shared variable may be unbound, rows with and without it are joined apart, so that all joins are equi-joins."""
        split = next((n for n in a.names if n in b.names and (n in a.loose or n in b.loose)), None)
        if split is None:
            return self._joined(a, b, how)
        parts = []
        for x in self._halves(a, split):
            for y in self._halves(b, split):
                parts.append(self.join(x, y))
        names = a.names + [n for n in b.names if n not in a.names]
        rows = reduce(DataFrame.unionByName, [p.rows.select("graph_id", *[(_ref(n) if n in p.names else F.lit(None).cast(TERM_DDL)).alias(col(n)) for n in names]) for p in parts])
        new = {n for n in b.names if n not in a.names}
        loose = {n for n in a.loose if n not in b.names or n in b.loose} | (b.loose & new)
        if how == "left":
            alone = self._alone(a, b)
            rows = rows.unionByName(alone.select("graph_id", *[(_ref(n) if n in a.names else F.lit(None).cast(TERM_DDL)).alias(col(n)) for n in names]))
            loose |= new | a.loose
        return Solutions(rows, names, loose)

    def _halves(self, a: Solutions, n: str) -> list[Solutions]:
        """a's rows where n is bound, and those where it isn't, which then have no such variable."""
        if n not in a.loose:
            return [a]
        bound = Solutions(a.rows.where(_ref(n).isNotNull()), a.names, a.loose - {n})
        rest = [x for x in a.names if x != n]
        return [bound, Solutions(a.rows.where(_ref(n).isNull()).select("graph_id", *[_ref(x) for x in rest]), rest, a.loose - {n})]

    def _alone(self, a: Solutions, b: Solutions) -> DataFrame:
        """a's rows that are compatible with no row of b."""
        split = next((n for n in a.names if n in b.names and (n in a.loose or n in b.loose)), None)
        if split is None:
            shared = [n for n in a.names if n in b.names]
            return self._semi(a, b, shared, "left_anti", need=False).rows
        out = []
        for x in self._halves(a, split):
            left = x
            for y in self._halves(b, split):
                left = Solutions(self._alone(left, y), x.names, x.loose)
            out.append(left.rows.select("graph_id", *[(_ref(n) if n in x.names else F.lit(None).cast(TERM_DDL)).alias(col(n)) for n in a.names]))
        return reduce(DataFrame.unionByName, out)

    def _joined(self, a: Solutions, b: Solutions, how: str) -> Solutions:
        shared = [n for n in a.names if n in b.names]
        renamed = b.rows.select(F.col("graph_id").alias("~g"), *[_ref(n).alias("~" + n) for n in b.names])
        condition = F.col("graph_id") == F.col("~g")
        for n in shared:
            condition &= _ref(n) == F.col(f"`~{n}`")
        new = [n for n in b.names if n not in a.names]
        joined = a.rows.join(renamed, condition, how).select("graph_id", *[_ref(n) for n in a.names], *[F.col(f"`~{n}`").alias(col(n)) for n in new])
        loose = a.loose | (b.loose & set(new))
        return Solutions(joined, a.names + new, loose | set(new) if how == "left" else loose)

    def optional(self, a: Solutions, group: q.Group) -> Solutions:
        """A left join; the group's own filters belong to its condition, and see the variables of both sides."""
        filters = [p for p in group.parts if isinstance(p, q.Filter)]
        rest = q.Group([p for p in group.parts if not isinstance(p, q.Filter)])
        b = self.group(rest)
        inside = all(self._names(f.expr) <= set(b.names) and not _has_exists(f.expr) for f in filters)
        if inside:
            for f in filters:
                b = self.filter(b, f.expr)
            return self.join(a, b, "left")
        if any(_has_exists(f.expr) for f in filters):
            raise q.SparqlError("EXISTS in an OPTIONAL's filter must use the OPTIONAL's own variables")
        fresh = self.join(a, b)
        kept = fresh
        for f in filters:
            kept = self.filter(kept, f.expr)
        # rows without a partner: those of a that no kept row extends
        key = Solutions(kept.rows, a.names, set())
        alone = self._anti(a, key)
        rows = kept.rows.unionByName(alone.rows, allowMissingColumns=True)
        return Solutions(rows, fresh.names, fresh.loose | {n for n in fresh.names if n not in a.names})

    def _anti(self, a: Solutions, b: Solutions, how: str = "left_anti") -> Solutions:
        """a's rows that equal (null-safe, on a's variables) no row of b."""
        renamed = b.rows.select(F.col("graph_id").alias("~g"), *[_ref(n).alias("~" + n) for n in a.names])
        condition = F.col("graph_id") == F.col("~g")
        for n in a.names:
            condition &= _ref(n).eqNullSafe(F.col(f"`~{n}`"))
        return Solutions(a.rows.join(renamed, condition, how), a.names, a.loose)

    def _names(self, e) -> set[str]:
        if isinstance(e, q.Var):
            return {e.name}
        if isinstance(e, q.Call):
            return set().union(*[self._names(a) for a in e.args]) if e.args else set()
        return set()

    def minus(self, a: Solutions, group: q.Group) -> Solutions:
        b = self.group(group)
        shared = [n for n in a.names if n in b.names]
        if not shared:
            return a
        return self._semi(a, b, shared, "left_anti", need=True)

    def _semi(self, a: Solutions, b: Solutions, shared: list[str], how: str, need: bool) -> Solutions:
        renamed = b.rows.select(F.col("graph_id").alias("~g"), *[_ref(n).alias("~" + n) for n in shared])
        condition = F.col("graph_id") == F.col("~g")
        common = F.lit(False)
        for n in shared:
            mine, theirs = _ref(n), F.col(f"`~{n}`")
            same = mine == theirs
            common = common | same
            if n in a.loose:
                same = same | mine.isNull()
            if n in b.loose:
                same = same | theirs.isNull()
            condition &= same
        if need and any(n in a.loose or n in b.loose for n in shared):
            condition &= F.coalesce(common, F.lit(False))
        return Solutions(a.rows.join(renamed, condition, how), a.names, a.loose)

    def filter(self, a: Solutions, e: q.Expr) -> Solutions:
        if isinstance(e, q.Call) and e.name == "&&":
            return self.filter(self.filter(a, e.args[0]), e.args[1])
        if isinstance(e, q.Call) and e.name == "!" and isinstance(e.args[0], q.Call) and e.args[0].name in ("EXISTS", "NOT EXISTS"):
            inner = e.args[0]
            e = q.Call("NOT EXISTS" if inner.name == "EXISTS" else "EXISTS", inner.args)
        if isinstance(e, q.Call) and e.name in ("EXISTS", "NOT EXISTS"):
            how = "left_semi" if e.name == "EXISTS" else "left_anti"
            b = self.group(e.args[0])
            return self._semi(a, b, [n for n in a.names if n in b.names], how, need=False)
        if _has_exists(e):
            return self._filter_with_exists(a, e)
        return Solutions(a.rows.where(as_bool(self.expr(e, set(a.names)))), a.names, a.loose)

    def _filter_with_exists(self, a: Solutions, e: q.Expr) -> Solutions:
        """A filter with EXISTS somewhere inside: each becomes a column first."""
        held: dict[q.Call, str] = {}
        rows = a.rows
        for i, call in enumerate(_exists_calls(e)):
            b = self.group(call.args[0])
            hit = self._semi(Solutions(a.rows.distinct(), a.names, a.loose), b, [n for n in a.names if n in b.names], "left_semi", need=False)
            marked = hit.rows.select(F.col("graph_id").alias("~g"), *[_ref(n).alias("~" + n) for n in a.names], F.lit(True).alias("~hit"))
            same = F.col("graph_id") == F.col("~g")
            for n in a.names:
                same &= _ref(n).eqNullSafe(F.col(f"`~{n}`"))
            there = F.col("~hit").isNotNull()
            rows = rows.join(marked, same, "left").withColumn(f"~exists{i}", there if call.name == "EXISTS" else ~there).drop("~g", "~hit", *["~" + n for n in a.names])
            held[call] = f"~exists{i}"
        kept = rows.where(as_bool(self.expr(e, set(a.names), held)))
        return Solutions(kept.select("graph_id", *[_ref(n) for n in a.names]), a.names, a.loose)

    def values(self, part: q.Values) -> Solutions:
        spark = self.triples.sparkSession
        rows = [tuple((None if x is None else (x.kind, x.lex, "" if x.dt == XSD_STRING else x.dt, x.lang)) for x in row) for row in part.rows]
        schema = ", ".join(f"`?{n}` {TERM_DDL}" for n in part.names)
        table = self.graphs.select("graph_id").crossJoin(spark.createDataFrame(rows, schema))  # a table of the query's text, for each graph
        loose = {n for i, n in enumerate(part.names) if any(r[i] is None for r in part.rows)}
        return Solutions(table, list(part.names), loose)

    def union(self, groups: list[q.Group]) -> Solutions:
        found = [self.group(g) for g in groups]
        names = list(dict.fromkeys(n for f in found for n in f.names))
        rows = [f.rows.select("graph_id", *[(_ref(n) if n in f.names else F.lit(None).cast(TERM_DDL)).alias(col(n)) for n in names]) for f in found]
        loose = {n for n in names if any(n not in f.names or n in f.loose for f in found)}
        return Solutions(reduce(DataFrame.unionByName, rows), names, loose)

    def group(self, g: q.Group) -> Solutions:
        now: Solutions | None = None
        add = lambda b: b if now is None else self.join(now, b)
        for part in g.parts:
            if isinstance(part, q.Bgp):
                for s, p, o in part.triples:
                    now = add(self.pattern(s, p, o))
            elif isinstance(part, q.Group):
                now = add(self.group(part))
            elif isinstance(part, q.Named):  # there are no named graphs, so nothing matches
                inside = self.group(part.group)
                named = [part.name.name] if isinstance(part.name, q.Var) and part.name.name not in inside.names else []
                rows = inside.rows.where(F.lit(False))
                for n in named:
                    rows = rows.withColumn(col(n), F.lit(None).cast(TERM_DDL))
                now = add(Solutions(rows, [*inside.names, *named], inside.loose))
            elif isinstance(part, q.Union_):
                now = add(self.union(part.groups))
            elif isinstance(part, q.Values):
                now = add(self.values(part))
            elif isinstance(part, q.Select):
                now = add(self.select(part))
            elif isinstance(part, q.Optional_):
                now = self.optional(now or self.unit(), part.group)
            elif isinstance(part, q.Minus):
                now = self.minus(now or self.unit(), part.group)
            elif isinstance(part, q.Bind):
                now = now or self.unit()
                if part.var in now.names:
                    raise q.SparqlError(f"?{part.var} is bound already")
                made = as_term(self.expr(part.expr, set(now.names)))
                now = Solutions(now.rows.withColumn(col(part.var), made), [*now.names, part.var], now.loose | {part.var})
        now = now or self.unit()
        for part in g.parts:  # filters hold for the whole group
            if isinstance(part, q.Filter):
                now = self.filter(now, part.expr)
        return now

    # ------------------------------------------------------------ query forms
    def ask(self, query: q.Ask) -> DataFrame:
        """graph_id of the graphs with a solution."""
        return self.group(query.where).rows.select("graph_id").distinct()

    def select(self, query: q.Select) -> Solutions:
        found = self.group(query.where)
        calls = [c for e, _ in query.items or [] for c in _aggregates(e)] + [c for e in query.having for c in _aggregates(e)] + [c for e, _ in query.order for c in _aggregates(e)]
        held: dict[q.Call, str] | None = None
        rows, names, loose = found.rows, list(found.names), set(found.loose)
        if query.group_by or calls:
            keys = []
            for i, (e, name) in enumerate(query.group_by):
                name = name or f"~key{i}"
                if not (isinstance(e, q.Var) and e.name == name and name in names):
                    rows = rows.withColumn(col(name), as_term(self.expr(e, set(names))))
                    names.append(name)
                keys.append(name)
            held = {c: f"~agg{i}" for i, c in enumerate(dict.fromkeys(calls))}
            for i, c in enumerate(held):  # what is added up or compared, as columns of their own
                if c.name in ("SUM", "AVG", "MIN", "MAX"):
                    v = self.expr(c.args[0], set(names))
                    x = as_numbers(v)
                    rows = rows.withColumns({f"~w{i}": x.whole, f"~e{i}": x.exact, f"~d{i}": x.double, f"~v{i}": as_term(v)})
            made = [self._aggregate(c, set(names), i).alias(n) for i, (c, n) in enumerate(held.items())] or [F.count(F.lit(1)).alias("~n")]
            grouped = rows.groupBy("graph_id", *[_ref(k) for k in keys]).agg(*made)
            if not keys:  # an empty group still has one result
                grouped = self.graphs.select("graph_id").join(grouped, "graph_id", "left")
                for c, n in held.items():
                    if c.name in ("COUNT", "SUM", "AVG"):
                        zero = t.term(LITERAL, "0", XSD_INTEGER)
                        grouped = grouped.withColumn(n, F.coalesce(F.col(f"`{n}`"), zero))
            rows, names = grouped, keys
            for e in query.having:
                rows = rows.where(as_bool(self.expr(e, set(names), held)))
        items = query.items if query.items is not None else [(q.Var(n), n) for n in names if not n.startswith("_:")]
        for e, name in items:
            if not isinstance(e, q.Var) or e.name != name:
                rows = rows.withColumn(col(name), as_term(self.expr(e, set(names), held)))
                names.append(name)
                loose.add(name)
            elif name not in names:
                rows = rows.withColumn(col(name), F.lit(None).cast(TERM_DDL))
                names.append(name)
                loose.add(name)
        order = []
        for i, (e, up) in enumerate(query.order):
            v = self.expr(e, set(names), held)
            x = as_numbers(v)
            rows = rows.withColumn(f"~n{i}", x.double).withColumn(f"~e{i}", x.exact).withColumn(f"~t{i}", as_term(v))
            order += [F.col(f"`~{k}{i}`").asc_nulls_first() if up else F.col(f"`~{k}{i}`").desc_nulls_last() for k in "net"]
        keep = list(dict.fromkeys(n for _, n in items))
        if query.limit is not None or query.offset:
            from pyspark.sql import Window

            if query.distinct:
                extra = [f"~{k}{i}" for i in range(len(query.order)) for k in "net"]
                rows = rows.dropDuplicates(["graph_id", *[col(n) for n in keep]]).select("graph_id", *[_ref(n) for n in keep], *[F.col(f"`{x}`") for x in extra])
            # limits hold for each graph; ties are settled by the terms, so that reruns agree
            w = Window.partitionBy("graph_id").orderBy(*order, *[_ref(n) for n in keep])
            # an upper bound alone lets Spark drop rows before the shuffle
            rows = rows.withColumn("~rn", F.row_number().over(w))
            if query.limit is not None:
                rows = rows.where(F.col("`~rn`") <= query.offset + query.limit)
            rows = rows.where(F.col("`~rn`") > query.offset)
            rows = rows.select("graph_id", *[_ref(n) for n in keep])
        else:
            if order:
                rows = rows.orderBy("graph_id", *order)
            rows = rows.select("graph_id", *[_ref(n) for n in keep])
            if query.distinct:
                rows = rows.distinct()
        return Solutions(rows, keep, loose & set(keep))

    def _aggregate(self, c: q.Call, names: set[str], i: int) -> Column:
        if c.name == "COUNT":
            if not c.args:
                n = F.countDistinct(F.struct(*[_ref(x) for x in sorted(names)])) if c.distinct else F.count(F.lit(1))
            else:
                v = as_term(self.expr(c.args[0], names))
                n = F.countDistinct(v) if c.distinct else F.count(v)
            return t.term(LITERAL, n.cast("string"), XSD_INTEGER)
        v = self.expr(c.args[0], names)
        if c.name == "SAMPLE":
            return F.min(as_term(v))
        if c.name == "GROUP_CONCAT":
            texts = F.collect_set(as_term(v).lex) if c.distinct else F.collect_list(as_term(v).lex)
            return t.term(LITERAL, F.array_join(F.sort_array(texts), c.separator))
        x = Number(*[F.col(f"`~{k}{i}`") for k in "wed"])
        if c.name in ("MIN", "MAX"):
            pick = F.min if c.name == "MIN" else F.max
            return pick(F.struct(x.double.alias("n"), x.exact.alias("e"), F.col(f"`~v{i}`").alias("t"))).getField("t")
        if c.name == "SUM":
            add = F.sum_distinct if c.distinct else F.try_sum
            whole, exact, double = add(x.whole), add(x.exact), (F.sum_distinct if c.distinct else F.sum)(x.double)
        else:
            n = F.count_distinct if c.distinct else F.count
            mean = lambda y, kind: F.try_divide(F.sum_distinct(y).try_cast(kind), n(y))
            whole, exact, double = None, mean(x.exact, "decimal(28,9)") if c.distinct else F.try_avg(x.exact), mean(x.double, "double") if c.distinct else F.avg(x.double)
        # one value that isn't whole makes the total decimal, one that isn't exact makes it double
        number = F.count(x.double)
        whole = None if whole is None else F.when(F.count(x.whole) == number, whole)
        return _of_type(whole, F.when(F.count(x.exact) == number, exact), double).col

    def construct(self, query: q.Construct) -> DataFrame:
        return self.instantiate(self.group(query.where), query.template, "c").distinct()

    def instantiate(self, found: Solutions, template: list[q.Triple], salt: str) -> DataFrame:
        """The template's triples for each solution; those with an unbound variable or at an illegal place are left out."""
        if not template:
            return self.triples.limit(0)
        names = [n for n in found.names]
        key = F.md5(F.to_json(F.struct(F.col("graph_id"), *[_ref(n) for n in sorted(names)])))

        def node(x: q.Node) -> Column:
            if isinstance(x, q.Term):
                return constant(x)
            if x.name.startswith("_:") and x.name not in names:  # a blank node of its own for each solution
                return t.term(BNODE, F.concat(F.lit(f"{salt}{x.name[2:]}-"), F.substring(key, 1, 16)))
            return _ref(x.name) if x.name in names else F.lit(None).cast(TERM_DDL)

        made = []
        for s, p, o in template:
            p_term = t.term(IRI, p.parts[0]) if isinstance(p, q.Path) else node(p)
            made.append(F.struct(node(s).alias("s"), p_term.alias("p"), node(o).alias("o")))
        rows = found.rows.select("graph_id", F.explode(F.array(*made)).alias("x"))
        rows = rows.where("x.s is not null and x.p is not null and x.o is not null").where((F.col("x.s.kind") != LITERAL) & (F.col("x.p.kind") == IRI))
        x = F.col("x")
        return rows.select("graph_id", x.s.kind.alias("s_kind"), x.s.lex.alias("s"), x.p.lex.alias("p"), x.o.kind.alias("o_kind"), x.o.lex.alias("o"), x.o.dt.alias("o_dt"), x.o.lang.alias("o_lang"))


def _aggregates(e) -> list[q.Call]:
    if isinstance(e, q.Call):
        return [e] if e.name in q.AGGREGATES else [c for a in e.args for c in _aggregates(a)]
    return []


def _exists_calls(e) -> list[q.Call]:
    if not isinstance(e, q.Call):
        return []
    return [e] if e.name in ("EXISTS", "NOT EXISTS") else [c for a in e.args for c in _exists_calls(a)]


def _has_exists(e) -> bool:
    return isinstance(e, q.Call) and (e.name in ("EXISTS", "NOT EXISTS") or any(_has_exists(a) for a in e.args))


def closure(pairs: DataFrame) -> DataFrame:
    """(graph_id, x, y) of one or more steps: distances double each round, written between rounds."""
    from weftline.operators.storage import cut

    now = cut(pairs.distinct())
    n = now.count()
    for _ in range(PATH_ROUNDS):
        step = now.select("graph_id", F.col("x").alias("m"), F.col("y").alias("z"))
        more = now.withColumnRenamed("y", "m").join(step, ["graph_id", "m"]).select("graph_id", "x", F.col("z").alias("y"))
        now = cut(now.unionByName(more).distinct())
        if (m := now.count()) == n:
            return now
        n = m
    raise q.SparqlError("a property path did not close")


def ask(triples: DataFrame, text: str, graphs: DataFrame | None = None) -> DataFrame:
    """graph_id of the graphs for which the ASK query holds."""
    query = q.parse_query(text)
    if not isinstance(query, q.Ask):
        raise q.SparqlError("not an ASK query")
    return Compiler(triples, graphs).ask(query)


def select(triples: DataFrame, text: str, graphs: DataFrame | None = None) -> DataFrame:
    """graph_id and a term struct for each selected variable, named as the variable."""
    found = Compiler(triples, graphs).select(q.parse_query(text))
    return found.rows.select("graph_id", *[_ref(n).alias(n) for n in found.names])


def construct(triples: DataFrame, text: str, graphs: DataFrame | None = None) -> DataFrame:
    return Compiler(triples, graphs).construct(q.parse_query(text))
