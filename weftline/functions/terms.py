"""RDF terms as DataFrame columns.

A triple is a row (graph_id, s_kind, s, p, o_kind, o, o_dt, o_lang); o_dt and o_lang are '' rather than
null, so that all joins are plain equi-joins. A term as one column is struct(kind, lex, dt, lang), null
where a variable is unbound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IRI, BNODE, LITERAL = "iri", "bnode", "lit"

TRIPLES = T.StructType([T.StructField(n, T.StringType()) for n in ("graph_id", "s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang")])
TRIPLE = [f.name for f in TRIPLES.fields[1:]]

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE, RDF_FIRST, RDF_REST, RDF_NIL = (RDF + x for x in ("type", "first", "rest", "nil"))
XSD_STRING, XSD_INTEGER, XSD_DECIMAL, XSD_DOUBLE, XSD_BOOLEAN, XSD_DATETIME = (XSD + x for x in ("string", "integer", "decimal", "double", "boolean", "dateTime"))
NUMERIC = [XSD + x for x in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def term(kind, lex, dt="", lang="") -> Column:
    return F.struct(_c(kind).alias("kind"), _c(lex).alias("lex"), _c(dt).alias("dt"), _c(lang).alias("lang"))


def iri(lex) -> Column:
    """An IRI term; null where ``lex`` is."""
    return F.when(_c(lex).isNotNull(), term(IRI, lex))


def literal(lex, dt="", lang="") -> Column:
    """A literal term; null where ``lex`` is."""
    return F.when(_c(lex).isNotNull(), term(LITERAL, lex, dt, lang))


def subject() -> Column:
    return term(F.col("s_kind"), F.col("s"))


def predicate() -> Column:
    return term(IRI, F.col("p"))


def object_() -> Column:
    return term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))


def escaped(lex: Column) -> Column:
    """The lexical form with N-Triples escapes."""
    out = F.replace(lex, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def ntriples(kind: Column, lex: Column, dt: Column, lang: Column) -> Column:
    """A term in N-Triples."""
    tail = F.when(lang != "", F.concat(F.lit("@"), lang)).when((dt != "") & (dt != XSD_STRING), F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise("")
    return (
        F.when(kind == IRI, F.concat(F.lit("<"), lex, F.lit(">")))
        .when(kind == BNODE, F.concat(F.lit("_:"), lex))
        .otherwise(F.concat(F.lit('"'), escaped(lex), F.lit('"'), tail))
    )


def line() -> Column:
    """A row's triple as an N-Triples line."""
    none = F.lit("")
    return F.concat_ws(
        " ",
        ntriples(F.col("s_kind"), F.col("s"), none, none),
        F.concat(F.lit("<"), F.col("p"), F.lit(">")),
        ntriples(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")),
        F.lit("."),
    )


def label_map(triples: DataFrame, predicate_iri: str) -> DataFrame:
    """graph_id, s, texts: each subject's texts by language, the last in byte order where a language has several; non-literals are ignored."""
    rows = triples.where((F.col("p") == predicate_iri) & (F.col("o_kind") == LITERAL))
    one = rows.groupBy("graph_id", "s", "o_lang").agg(F.max("o").alias("o"))
    return one.groupBy("graph_id", "s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_lang", "o")))).alias("texts"))


def pick_label(texts: Column, languages: tuple[str, ...] = ("cs", "en")) -> Column:
    """The text of the first language there is, else of the least language key, else ''."""
    named = [F.try_element_at(texts, F.lit(x)) for x in languages]
    least = F.try_element_at(texts, F.array_min(F.map_keys(texts)))
    return F.coalesce(*named, least, F.lit(""))
