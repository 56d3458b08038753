"""Relational tables as triples: subject urn:<table>:<key>, predicate urn:col:<column>, foreign keys as IRIs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.terms import IRI, LITERAL, RDF_TYPE, XSD_DECIMAL, XSD_INTEGER


@dataclass(frozen=True)
class View:
    """How a table becomes triples: its key, plain texts, whole numbers, amounts (two decimals), references (column to table) and texts with a language column."""

    table: str
    key: str
    texts: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()
    amounts: tuple[str, ...] = ()
    references: dict[str, str] = field(default_factory=dict)
    tagged: dict[str, str] = field(default_factory=dict)


VIEWS = {
    v.table: v
    for v in (
        View("region", "r_regionkey", texts=("r_name",)),
        View("nation", "n_nationkey", texts=("n_name",), references={"n_regionkey": "region"}),
        View("supplier", "s_suppkey", texts=("s_name",), amounts=("s_acctbal",), references={"s_nationkey": "nation"}),
        View("customer", "c_custkey", texts=("c_name", "c_mktsegment"), amounts=("c_acctbal",), references={"c_nationkey": "nation"}),
        View("part", "p_partkey", texts=("p_name", "p_brand", "p_type"), whole=("p_size",), amounts=("p_retailprice",)),
        View("documents", "doc_id", texts=("source",), whole=("n_chars",), tagged={"text": "lang"}),
    )
}


def subject_of(table: str, key: Column) -> Column:
    return F.concat(F.lit(f"urn:{table}:"), key.cast("string"))


def triples_of(rows: DataFrame, view: View, graph_id: Column | None = None) -> DataFrame:
    """The rows' triples; graph_id: the table's name unless given (over the table's columns). Null values give no triple."""
    lit = lambda name, value, dt="", lang="": F.struct(F.lit(f"urn:col:{name}").alias("p"), F.lit(LITERAL).alias("o_kind"), value.cast("string").alias("o"), F.lit(dt).alias("o_dt"), (lang if isinstance(lang, Column) else F.lit(lang)).alias("o_lang"))
    link = lambda p, value: F.struct(F.lit(p).alias("p"), F.lit(IRI).alias("o_kind"), value.alias("o"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    cells = [link(RDF_TYPE, F.lit(f"urn:table:{view.table}"))]
    cells += [lit(c, F.col(c)) for c in view.texts]
    cells += [lit(c, F.col(c), XSD_INTEGER) for c in view.whole]
    cells += [lit(c, F.col(c).cast("decimal(18,2)"), XSD_DECIMAL) for c in view.amounts]
    cells += [link(f"urn:col:{c}", subject_of(t, F.col(c))) for c, t in view.references.items()]
    cells += [lit(c, F.col(c), "", F.coalesce(F.col(tag), F.lit(""))) for c, tag in view.tagged.items()]
    graph = graph_id if graph_id is not None else F.lit(view.table)
    one = rows.select(graph.alias("graph_id"), subject_of(view.table, F.col(view.key)).alias("s"), F.explode(F.array(*cells)).alias("x"))
    one = one.where("s is not null and x.o is not null")
    return one.select("graph_id", F.lit(IRI).alias("s_kind"), "s", "x.p", "x.o_kind", "x.o", "x.o_dt", "x.o_lang")


def load_triples(spark: SparkSession, sf_dir: str, tables: list[str], graph_id: dict[str, Column] | None = None) -> DataFrame:
    """Triples of the tables in the folder."""
    out = []
    for name in tables:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        out.append(triples_of(rows, VIEWS[name], (graph_id or {}).get(name)))
    return reduce(DataFrame.unionByName, out)


def triples_sql(tables: list[str], graph_id: dict[str, str] | None = None) -> str:
    """The same as a DuckDB query."""
    parts = []
    for name in tables:
        v = VIEWS[name]
        g = (graph_id or {}).get(name, f"'{name}'")
        head = f"SELECT {g} AS graph_id, 'iri' AS s_kind, 'urn:{name}:' || CAST({v.key} AS VARCHAR) AS s, "
        cell = lambda p, kind, o, dt="", lang="''": f"'{p}' AS p, '{kind}' AS o_kind, {o} AS o, '{dt}' AS o_dt, {lang} AS o_lang FROM {name}"
        cells = [cell(RDF_TYPE, "iri", f"'urn:table:{name}'")]
        cells += [cell(f"urn:col:{c}", "lit", f"CAST({c} AS VARCHAR)") for c in v.texts]
        cells += [cell(f"urn:col:{c}", "lit", f"CAST({c} AS VARCHAR)", XSD_INTEGER) for c in v.whole]
        cells += [cell(f"urn:col:{c}", "lit", f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)", XSD_DECIMAL) for c in v.amounts]
        cells += [cell(f"urn:col:{c}", "iri", f"'urn:{t}:' || CAST({c} AS VARCHAR)") for c, t in v.references.items()]
        cells += [cell(f"urn:col:{c}", "lit", c, "", f"coalesce({tag}, '')") for c, tag in v.tagged.items()]
        parts += [f"SELECT * FROM ({head}{c}) WHERE o IS NOT NULL AND s IS NOT NULL" for c in cells]
    return " UNION ALL ".join(parts)
