"""Registered queries of the engine's own operators, and the SQL that gives the same rows.

The tables are seen as triples (``sources.relational``). Explorations run on small subjects, as the
number of states multiplies the triples: one run for each region, its sample being the region's nations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import terms as t
from weftline.model import Group, Settings, application, transformer
from weftline.operators import explore as E
from weftline.operators import graphs as G
from weftline.operators import lookups as L
from weftline.operators import pipelines as P
from weftline.operators import rollups as R
from weftline.operators.storage import cut, dictionary_encode
from weftline.plans import compiler as C
from weftline.sources import rdf
from weftline.sources.relational import load_triples, subject_of, triples_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PREFIXES = "PREFIX c: <urn:col:> PREFIX p: <urn:p:> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _flat(df: DataFrame) -> DataFrame:
    """Term structs as their lexical forms."""
    return df.select(*[F.col(f"`{c}`.lex").alias(c) if k.startswith("struct<kind") else F.col(f"`{c}`") for c, k in df.dtypes])


def _selected(name: str, tables: list[str], text: str, sql: str) -> None:
    """A query that runs SPARQL on the triples of some tables, as one graph."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        triples = load_triples(spark, sf_dir, tables, {x: F.lit("g") for x in tables})
        return _flat(C.select(triples, PREFIXES + text)).drop("graph_id")


# ------------------------------------------------------------------ scans and look-ups

_THREE = ["region", "nation", "supplier"]


@query("triples_scan", triples_sql(_THREE))
def triples_scan(spark, sf_dir):
    return load_triples(spark, sf_dir, _THREE)


@query("find_by_class", "SELECT DISTINCT 'urn:nation:' || CAST(n_nationkey AS VARCHAR) AS s FROM nation")
def find_by_class(spark, sf_dir):
    return L.by_class(load_triples(spark, sf_dir, _THREE), "urn:table:nation").select("s")


@query("find_one_by_class", "SELECT 'urn:supplier:' || CAST(s_suppkey AS VARCHAR) AS graph_id, 'urn:supplier:' || CAST(s_suppkey AS VARCHAR) AS s FROM supplier")
def find_one_by_class(spark, sf_dir):
    rows = load_triples(spark, sf_dir, ["supplier"], {"supplier": subject_of("supplier", F.col("s_suppkey"))})
    return L.one_by_class(rows, "urn:table:supplier")


@query("ntriples_roundtrip", triples_sql(_THREE))
def ntriples_roundtrip(spark, sf_dir):
    written = rdf.lines(load_triples(spark, sf_dir, _THREE)).withColumnRenamed("line", "value")
    return rdf.ntriples_rows(written)


# ------------------------------------------------------------------ ASK

_RICH = application("urn:app:rich", PREFIXES + 'ASK { ?s c:s_acctbal ?b FILTER(?b > 5000) }')
_NATION7 = application("urn:app:nation7", PREFIXES + "ASK { ?s c:s_nationkey <urn:nation:7> }")
_BOTH = application("urn:app:both", PREFIXES + "ASK { ?s c:s_acctbal ?b FILTER(?b > 0) }", PREFIXES + 'ASK { ?s c:s_name ?n FILTER(CONTAINS(?n, "1")) }')
_ANY = application("urn:app:any")


def _suppliers(spark, sf_dir):
    return load_triples(spark, sf_dir, ["supplier"], {"supplier": subject_of("supplier", F.col("s_suppkey"))})


_S = "'urn:supplier:' || CAST(s_suppkey AS VARCHAR)"
_BAL = "CAST(s_acctbal AS DECIMAL(18,2))"


@query("ask_matrix", f"SELECT {_S} AS graph_id, 'urn:app:rich' AS iri FROM supplier WHERE {_BAL} > 5000 UNION ALL SELECT {_S}, 'urn:app:nation7' FROM supplier WHERE s_nationkey = 7")
def ask_matrix(spark, sf_dir):
    return E.matches(_suppliers(spark, sf_dir), [_RICH, _NATION7]).select("graph_id", "iri")


@query("ask_all_descriptors", f"SELECT {_S} AS graph_id, 'urn:app:both' AS iri FROM supplier WHERE {_BAL} > 0 AND s_name LIKE '%1%' UNION ALL SELECT {_S}, 'urn:app:any' FROM supplier")
def ask_all_descriptors(spark, sf_dir):
    return E.matches(_suppliers(spark, sf_dir), [_BOTH, _ANY]).select("graph_id", "iri")


# ------------------------------------------------------------------ patterns

_selected("bgp_star", ["customer"], "SELECT ?c ?name ?segment ?nation { ?c c:c_name ?name ; c:c_mktsegment ?segment ; c:c_nationkey ?nation }", "SELECT 'urn:customer:' || CAST(c_custkey AS VARCHAR) AS c, c_name AS name, c_mktsegment AS segment, 'urn:nation:' || CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
_selected("bgp_path", _THREE, "SELECT ?supplier ?nation ?region { ?s c:s_name ?supplier ; c:s_nationkey ?n . ?n c:n_name ?nation ; c:n_regionkey ?r . ?r c:r_name ?region }", "SELECT s_name AS supplier, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_D = "'urn:documents:' || CAST(doc_id AS VARCHAR)"
_selected("optional_filter_lang", ["documents"], 'SELECT ?d ?source ?text { ?d c:source ?source OPTIONAL { ?d c:text ?text FILTER(LANG(?text) = "en") } }', f"SELECT {_D} AS d, source, CASE WHEN lang = 'en' THEN text END AS text FROM documents WHERE source IS NOT NULL")
_selected("bind_iri_concat", ["nation"], 'SELECT ?n ?geo { ?n c:n_name ?name BIND(IRI(CONCAT(STR(?n), "/geo/", LCASE(?name))) AS ?geo) }', "SELECT 'urn:nation:' || CAST(n_nationkey AS VARCHAR) AS n, 'urn:nation:' || CAST(n_nationkey AS VARCHAR) || '/geo/' || lower(n_name) AS geo FROM nation")


@query("strlang", "SELECT n_name || ' of' AS label, 'en' AS lang, 'lit' AS kind FROM nation")
def strlang(spark, sf_dir):
    triples = load_triples(spark, sf_dir, ["nation"])
    found = C.select(triples, PREFIXES + 'SELECT ?l { ?n c:n_name ?name BIND(STRLANG(CONCAT(?name, " of"), "en") AS ?l) }')
    return found.select(F.col("l.lex").alias("label"), F.col("l.lang"), F.col("l.kind"))


_selected("union", ["nation", "region"], "SELECT ?x ?name { { ?x c:n_name ?name } UNION { ?x c:r_name ?name } }", "SELECT 'urn:nation:' || CAST(n_nationkey AS VARCHAR) AS x, n_name AS name FROM nation UNION ALL SELECT 'urn:region:' || CAST(r_regionkey AS VARCHAR), r_name FROM region")
_NATION = "'urn:nation:' || CAST(n_nationkey AS VARCHAR)"
_selected("minus", ["nation", "supplier"], "SELECT ?n { ?n c:n_name ?name MINUS { ?s c:s_nationkey ?n } }", f"SELECT {_NATION} AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
_selected("filter_exists", ["nation", "supplier"], "SELECT ?n { ?n c:n_name ?name FILTER EXISTS { ?s c:s_nationkey ?n } }", f"SELECT {_NATION} AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
_selected("filter_not_exists", ["nation", "supplier"], "SELECT ?n { ?n c:n_name ?name FILTER NOT EXISTS { ?s c:s_nationkey ?n ; c:s_acctbal ?b FILTER(?b > 5000) } }", f"SELECT {_NATION} AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE {_BAL} > 5000)")
_selected("values_join", ["nation"], "SELECT ?n ?name ?tag { VALUES (?r ?tag) { (<urn:region:0> \"first\") (<urn:region:2> \"third\") } ?n c:n_regionkey ?r ; c:n_name ?name }", f"SELECT {_NATION} AS n, n_name AS name, CASE n_regionkey WHEN 0 THEN 'first' ELSE 'third' END AS tag FROM nation WHERE n_regionkey IN (0, 2)")
_selected("group_having", ["supplier"], "SELECT ?n (COUNT(*) AS ?k) (COUNT(DISTINCT ?name) AS ?names) (MIN(?name) AS ?least) (GROUP_CONCAT(?name; SEPARATOR=\"|\") AS ?all) { ?s c:s_nationkey ?n ; c:s_name ?name } GROUP BY ?n HAVING (COUNT(*) > 1)", "SELECT 'urn:nation:' || CAST(s_nationkey AS VARCHAR) AS n, CAST(count(*) AS VARCHAR) AS k, CAST(count(DISTINCT s_name) AS VARCHAR) AS names, min(s_name) AS least, string_agg(s_name, '|' ORDER BY s_name) AS \"all\" FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
_selected("order_limit_offset", ["part"], "SELECT ?p ?size { ?p c:p_size ?size } ORDER BY DESC(?size) ?p LIMIT 20 OFFSET 5", "SELECT 'urn:part:' || CAST(p_partkey AS VARCHAR) AS p, CAST(p_size AS VARCHAR) AS size FROM part ORDER BY p_size DESC, 1 LIMIT 20 OFFSET 5")
_selected("select_distinct", ["part"], "SELECT DISTINCT ?brand { ?p c:p_brand ?brand }", "SELECT DISTINCT p_brand AS brand FROM part")
_selected("sub_select", _THREE, "SELECT ?name ?k { ?n c:n_name ?name { SELECT ?n (COUNT(?s) AS ?k) { ?s c:s_nationkey ?n } GROUP BY ?n } }", "SELECT n_name AS name, CAST(count(*) AS VARCHAR) AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
_selected("path_sequence", _THREE, "SELECT ?s ?region { ?s c:s_nationkey/c:n_regionkey/c:r_name ?region }", f"SELECT {_S} AS s, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_selected("path_inverse_alternative", ["region", "nation"], "SELECT ?r ?x { ?r ^c:n_regionkey|c:r_name ?x }", "SELECT 'urn:region:' || CAST(n_regionkey AS VARCHAR) AS r, 'urn:nation:' || CAST(n_nationkey AS VARCHAR) AS x FROM nation UNION ALL SELECT 'urn:region:' || CAST(r_regionkey AS VARCHAR), r_name FROM region")
_selected("path_closure", _THREE, "SELECT ?s ?x { ?s (c:s_nationkey|c:n_regionkey)+ ?x . ?s c:s_name ?name }", f"SELECT {_S} AS s, 'urn:nation:' || CAST(s_nationkey AS VARCHAR) AS x FROM supplier UNION ALL SELECT {_S}, 'urn:region:' || CAST(n_regionkey AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_selected("string_functions", ["nation"], 'SELECT ?name ?len ?sub ?up ?before ?md ?enc { ?n c:n_name ?name BIND(STRLEN(?name) AS ?len) BIND(SUBSTR(?name, 2, 3) AS ?sub) BIND(UCASE(?name) AS ?up) BIND(STRBEFORE(?name, "A") AS ?before) BIND(MD5(?name) AS ?md) BIND(REPLACE(?name, "[AEIOU]", "-") AS ?enc) FILTER(STRSTARTS(?name, "N") || REGEX(?name, "a", "i")) }', "SELECT n_name AS name, CAST(length(n_name) AS VARCHAR) AS len, substring(n_name, 2, 3) AS sub, upper(n_name) AS up, CASE WHEN contains(n_name, 'A') THEN split_part(n_name, 'A', 1) ELSE '' END AS before, md5(n_name) AS md, regexp_replace(n_name, '[AEIOU]', '-', 'g') AS enc FROM nation WHERE starts_with(n_name, 'N') OR regexp_matches(n_name, 'a', 'i')")
_selected("numeric_functions", ["part"], "SELECT ?p ?twice ?odd ?up { ?p c:p_size ?z BIND(?z * 2 + 1 AS ?twice) BIND(IF(?z > 25, \"big\", \"small\") AS ?odd) BIND(CEIL(?z / 10) AS ?up) FILTER(?z IN (1, 7, 30) || isNumeric(?z) && ?z >= 45) }", "SELECT 'urn:part:' || CAST(p_partkey AS VARCHAR) AS p, CAST(p_size * 2 + 1 AS VARCHAR) AS twice, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS odd, CAST(CAST(ceil(p_size / 10.0) AS BIGINT) AS VARCHAR) AS up FROM part WHERE p_size IN (1, 7, 30) OR p_size >= 45")

# numbers by their type, moments as they are written, forms that need more than a join
_STRIP = lambda x: f"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_BIG = "9007199254740993"
_selected("sum_avg_max", ["supplier"], "SELECT ?n (SUM(?b) AS ?total) (FLOOR(AVG(?b) * 100) AS ?mean) (MAX(?b) AS ?most) (MIN(?b) AS ?least) { ?s c:s_nationkey ?n ; c:s_acctbal ?b } GROUP BY ?n", f"SELECT 'urn:nation:' || CAST(s_nationkey AS VARCHAR) AS n, {_STRIP(f'sum({_BAL})')} AS total, CAST(CAST(floor(CAST(sum(CAST({_BAL} * 100 AS BIGINT)) AS DOUBLE) / count(*)) AS BIGINT) AS VARCHAR) AS mean, CAST(max({_BAL}) AS VARCHAR) AS most, CAST(min({_BAL}) AS VARCHAR) AS least FROM supplier GROUP BY s_nationkey")
_selected("big_whole_numbers", ["part"], f"SELECT ?brand (SUM(?big) AS ?total) (MAX(?big) AS ?most) {{ ?p c:p_brand ?brand ; c:p_size ?z BIND(?z * {_BIG} + 1 AS ?big) FILTER(?big > {_BIG}) }} GROUP BY ?brand", f"SELECT p_brand AS brand, CAST(sum(CAST(p_size AS HUGEINT) * {_BIG} + 1) AS VARCHAR) AS total, CAST(max(CAST(p_size AS HUGEINT) * {_BIG} + 1) AS VARCHAR) AS most FROM part WHERE p_size >= 1 GROUP BY p_brand")
_selected("decimals", ["supplier"], "SELECT ?s ?more ?size ?near ?part { ?s c:s_acctbal ?b BIND(?b + 0.1 AS ?more) BIND(ABS(?b) AS ?size) BIND(ROUND(?b) AS ?near) BIND(?b * 0.125 AS ?part) }", f"SELECT {_S} AS s, {_STRIP(f'{_BAL} + 0.1')} AS more, {_STRIP(f'abs({_BAL})')} AS size, CAST(CAST(floor({_BAL} + 0.5) AS BIGINT) AS VARCHAR) AS near, {_STRIP(f'{_BAL} * 0.125')} AS part FROM supplier")
_selected("moments", ["region"], 'SELECT ?r ?year ?hours ?minutes ?seconds ?tz ?zone { ?r c:r_name ?name BIND(SUBSTR(STR(STRLEN(?name)), 1, 1) AS ?k) BIND(STRDT(CONCAT("2011-01-10T14:45:13.500-0", ?k, ":30"), xsd:dateTime) AS ?t) BIND(YEAR(?t) AS ?year) BIND(HOURS(?t) AS ?hours) BIND(MINUTES(?t) AS ?minutes) BIND(SECONDS(?t) AS ?seconds) BIND(TZ(?t) AS ?tz) BIND(TIMEZONE(?t) AS ?zone) }', "SELECT 'urn:region:' || CAST(r_regionkey AS VARCHAR) AS r, '2011' AS year, '14' AS hours, '45' AS minutes, '13.5' AS seconds, '-0' || k || ':30' AS tz, '-PT' || k || 'H30M' AS zone FROM (SELECT *, left(CAST(length(r_name) AS VARCHAR), 1) AS k FROM region)")
_selected("exists_in_disjunction", ["nation", "supplier"], 'SELECT ?n { ?n c:n_name ?name FILTER(EXISTS { ?s c:s_nationkey ?n ; c:s_acctbal ?b FILTER(?b > 9000) } || STRSTARTS(?name, "A")) }', f"SELECT {_NATION} AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE {_BAL} > 9000) OR starts_with(n_name, 'A')")
_selected("minus_some", ["nation", "supplier"], "SELECT ?n { ?n c:n_name ?name MINUS { ?s c:s_nationkey ?n ; c:s_acctbal ?b FILTER(?b > 8000) } }", f"SELECT {_NATION} AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE {_BAL} > 8000)")
_selected("named_graph", ["nation"], "SELECT ?n ?r { ?n c:n_name ?name OPTIONAL { GRAPH <urn:g> { ?n c:n_regionkey ?r } } }", f"SELECT {_NATION} AS n, CAST(NULL AS VARCHAR) AS r FROM nation")
_selected("loose_join", ["nation", "supplier"], "SELECT ?n ?s ?b { ?n c:n_name ?name OPTIONAL { ?s c:s_nationkey ?n ; c:s_acctbal ?x FILTER(?x > 8000) } OPTIONAL { ?s c:s_acctbal ?b } FILTER(BOUND(?s)) FILTER(?b > 9000) }", f"SELECT {_NATION} AS n, {_S} AS s, CAST({_BAL} AS VARCHAR) AS b FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE {_BAL} > 9000 UNION ALL SELECT {_NATION}, {_S}, CAST({_BAL} AS VARCHAR) FROM nation CROSS JOIN supplier WHERE {_BAL} > 9000 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE {_BAL} > 8000)")
_selected("path_optional", ["nation", "supplier"], "SELECT ?s ?x { ?s c:s_name ?name . ?s c:s_nationkey? ?x }", f"SELECT {_S} AS s, 'urn:nation:' || CAST(s_nationkey AS VARCHAR) AS x FROM supplier UNION ALL SELECT {_S}, {_S} FROM supplier")
_selected("path_star", ["region", "nation"], "SELECT ?n ?x { ?n c:n_name ?name . ?n c:n_regionkey* ?x }", f"SELECT {_NATION} AS n, 'urn:region:' || CAST(n_regionkey AS VARCHAR) AS x FROM nation UNION ALL SELECT {_NATION}, {_NATION} FROM nation")
_selected("path_to_bound_end", _THREE, "SELECT ?x { ?x (c:s_nationkey|c:n_regionkey)+ <urn:region:1> }", f"SELECT {_NATION} AS x FROM nation WHERE n_regionkey = 1 UNION ALL SELECT {_S} FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
_selected("path_negated", ["nation"], "SELECT ?n ?x { ?n !(rdf:type|c:n_name) ?x }", f"SELECT {_NATION} AS n, 'urn:region:' || CAST(n_regionkey AS VARCHAR) AS x FROM nation")
_selected("blank_nodes", ["nation"], "SELECT (COUNT(DISTINCT ?a) AS ?as) (COUNT(DISTINCT ?b) AS ?bs) (MIN(?c) AS ?blank) { ?n c:n_regionkey ?r BIND(BNODE() AS ?a) BIND(BNODE(STR(?r)) AS ?b) BIND(STR(ISBLANK(?a) && ?a != ?b) AS ?c) }", "SELECT CAST(count(*) AS VARCHAR) AS \"as\", CAST(count(*) AS VARCHAR) AS bs, 'true' AS blank FROM nation")
_selected("term_functions", ["part"], "SELECT ?p ?dt ?same ?cast { ?p c:p_size ?z ; c:p_brand ?brand BIND(DATATYPE(?z) AS ?dt) BIND(STR(SAMETERM(?z, STRDT(STR(?z), xsd:integer))) AS ?same) BIND(xsd:integer(CONCAT(STR(?z), \"0\")) AS ?cast) }", f"SELECT 'urn:part:' || CAST(p_partkey AS VARCHAR) AS p, '{t.XSD_INTEGER}' AS dt, 'true' AS same, CAST(p_size * 10 AS VARCHAR) AS \"cast\" FROM part")


@query("construct", "SELECT DISTINCT 'urn:region:' || CAST(n_regionkey AS VARCHAR) AS s, 'urn:p:has' AS p, n_name AS o FROM nation")
def construct(spark, sf_dir):
    triples = load_triples(spark, sf_dir, ["nation"])
    return C.construct(triples, PREFIXES + "CONSTRUCT { ?r p:has ?name } WHERE { ?n c:n_regionkey ?r ; c:n_name ?name }").select("s", "p", "o")


# ------------------------------------------------------------------ updates

RENAME = PREFIXES + "DELETE { ?s c:n_name ?n } INSERT { ?s p:label ?n } WHERE { ?s c:n_name ?n }"
RESTRUCTURE = PREFIXES + 'DELETE { ?s c:n_regionkey ?r } INSERT { ?s p:place ?g . ?g p:region ?r ; p:title ?title } WHERE { ?s c:n_regionkey ?r BIND(IRI(CONCAT(STR(?s), "/place")) AS ?g) OPTIONAL { ?s p:label ?l FILTER(LANG(?l) = "") BIND(CONCAT("Place of ", ?l) AS ?title) } }'
_NAT = triples_sql(["nation"])
_SHORT = "graph_id, s, p, o"


def _updated(spark, sf_dir, text):
    return G.update(load_triples(spark, sf_dir, ["nation"]), text).select("graph_id", "s", "p", "o")


@query("update_rename", f"SELECT graph_id, s, CASE WHEN p = 'urn:col:n_name' THEN 'urn:p:label' ELSE p END AS p, o FROM ({_NAT})")
def update_rename(spark, sf_dir):
    return _updated(spark, sf_dir, RENAME)


_MOVED = "SELECT graph_id, s, 'urn:p:place' AS p, s || '/place' AS o FROM src WHERE p = 'urn:col:n_regionkey' UNION ALL SELECT graph_id, s || '/place', 'urn:p:region', o FROM src WHERE p = 'urn:col:n_regionkey'"


@query("update_restructure", f"WITH src AS ({_NAT}) SELECT graph_id, s, CASE WHEN p = 'urn:col:n_name' THEN 'urn:p:label' ELSE p END AS p, o FROM src WHERE p <> 'urn:col:n_regionkey' UNION ALL {_MOVED} UNION ALL SELECT graph_id, s || '/place', 'urn:p:title', 'Place of ' || o FROM src WHERE p = 'urn:col:n_name'")
def update_restructure(spark, sf_dir):
    return _updated(spark, sf_dir, RENAME + " ; " + RESTRUCTURE)


@query("update_unbound_skip", f"WITH src AS ({_NAT}) SELECT graph_id, s, p, o FROM src WHERE p <> 'urn:col:n_regionkey' UNION ALL {_MOVED}")
def update_unbound_skip(spark, sf_dir):
    return _updated(spark, sf_dir, RESTRUCTURE)


@query("update_data", f"SELECT * FROM (SELECT graph_id, s, p, o FROM ({_NAT}) WHERE p <> 'urn:col:n_name' UNION ALL SELECT 'nation', 'urn:x', 'urn:p:y', 'z') WHERE NOT (s = 'urn:nation:0' AND p LIKE '%type')")
def update_data(spark, sf_dir):
    return _updated(spark, sf_dir, PREFIXES + 'DELETE WHERE { ?s c:n_name ?n } ; INSERT DATA { <urn:x> p:y "z" } ; DELETE DATA { <urn:nation:0> a <urn:table:nation> }')


# ------------------------------------------------------------------ differences and fingerprints

_SUP = triples_sql(["supplier"])
#: The root: all suppliers. Sample r, for each region: those of region r renamed, without those of the next region.
_SAMPLES_SQL = f"WITH src AS ({_SUP}), root AS (SELECT s, p, o FROM src), samples AS (SELECT CAST(r_regionkey AS VARCHAR) AS graph_id, s, CASE WHEN p = 'urn:col:s_name' AND n_regionkey = r_regionkey THEN 'urn:p:label' ELSE p END AS p, o FROM src JOIN supplier ON s = {_S} JOIN nation ON s_nationkey = n_nationkey CROSS JOIN region WHERE n_regionkey <> (r_regionkey + 1) % 5) "


def _samples(spark, sf_dir):
    root = load_triples(spark, sf_dir, ["supplier"], {"supplier": F.lit("root")})
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_regionkey").alias("region"))
    placed = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(subject_of("supplier", F.col("s_suppkey")).alias("s"), "region")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey")
    rows = root.join(placed, "s").crossJoin(F.broadcast(regions)).where("region != (r_regionkey + 1) % 5")  # a sample for each region: five
    renamed = F.when((F.col("p") == "urn:col:s_name") & (F.col("region") == F.col("r_regionkey")), "urn:p:label").otherwise(F.col("p"))
    return root, rows.withColumn("graph_id", F.col("r_regionkey").cast("string")).withColumn("p", renamed).select("graph_id", *t.TRIPLE)


@query("diff_added", _SAMPLES_SQL + "SELECT graph_id, s, p, o FROM samples WHERE (s, p, o) NOT IN (SELECT (s, p, o) FROM root)")
def diff_added(spark, sf_dir):
    root, samples = _samples(spark, sf_dir)
    return G.added(samples, root).select("graph_id", "s", "p", "o")


_REMOVED_SQL = "SELECT g.graph_id, r.s, r.p, r.o FROM (SELECT DISTINCT graph_id FROM samples) g CROSS JOIN root r LEFT JOIN samples x ON x.graph_id = g.graph_id AND x.s = r.s AND x.p = r.p AND x.o = r.o WHERE x.s IS NULL"


@query("diff_removed", _SAMPLES_SQL + _REMOVED_SQL)
def diff_removed(spark, sf_dir):
    root, samples = _samples(spark, sf_dir)
    return G.removed(samples, root).select("graph_id", "s", "p", "o")


@query("diff_size", _SAMPLES_SQL + f", a AS (SELECT graph_id, count(*) AS added FROM samples WHERE (s, p, o) NOT IN (SELECT (s, p, o) FROM root) GROUP BY 1), r AS (SELECT graph_id, count(*) AS removed FROM ({_REMOVED_SQL}) GROUP BY 1) SELECT g.graph_id, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(added, 0) + coalesce(removed, 0) AS diff_size FROM (SELECT DISTINCT graph_id FROM samples) g LEFT JOIN a USING (graph_id) LEFT JOIN r USING (graph_id)")
def diff_size(spark, sf_dir):
    root, samples = _samples(spark, sf_dir)
    return G.diff_sizes(samples, root)


def _term_sql(kind: str, lex: str, dt: str, lang: str) -> str:
    return f"CASE WHEN {kind} = 'iri' THEN '<' || {lex} || '>' ELSE '\"' || {lex} || '\"' || CASE WHEN {lang} <> '' THEN '@' || {lang} WHEN {dt} <> '' THEN '^^<' || {dt} || '>' ELSE '' END END"


_SUPPLIER_GRAPHS = triples_sql(["supplier"], {"supplier": _S})
_FP_SQL = f"SELECT graph_id, md5(CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) || '|' || CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) || '|' || CAST(count(*) AS VARCHAR)) AS fp, count(*) AS n FROM (SELECT DISTINCT graph_id, md5('<' || s || '> <' || p || '> ' || {_term_sql('o_kind', 'o', 'o_dt', 'o_lang')}) AS h FROM ({_SUPPLIER_GRAPHS})) GROUP BY graph_id"


@query("graph_fingerprint", _FP_SQL)
def graph_fingerprint(spark, sf_dir):
    return G.fingerprints(_suppliers(spark, sf_dir), blank=False)


@query("dedupe_first_wins", "SELECT 'urn:part:' || CAST(p_partkey AS VARCHAR) AS graph_id, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) > 1 AS redundant FROM part")
def dedupe_first_wins(spark, sf_dir):
    rows = load_triples(spark, sf_dir, ["part"], {"part": subject_of("part", F.col("p_partkey"))})
    same = rows.where(F.col("p").isin("urn:col:p_brand", "urn:col:p_size")).withColumn("s", F.lit("urn:x"))
    return L.first_wins(G.fingerprints(same, blank=False), F.substring_index("graph_id", ":", -1).cast("long"))


@query("dictionary_encode", "SELECT row_number() OVER (ORDER BY kind, lex, dt, lang) AS id, kind, lex, dt, lang FROM (SELECT s_kind AS kind, s AS lex, '' AS dt, '' AS lang FROM src UNION SELECT 'iri', p, '', '' FROM src UNION SELECT o_kind, o, o_dt, o_lang FROM src)".replace("FROM src", f"FROM ({triples_sql(_THREE)})"))
def dictionary_values(spark, sf_dir):
    return dictionary_encode(load_triples(spark, sf_dir, _THREE))[0]


@query("bnode_isomorphic", "SELECT CAST(r_regionkey AS VARCHAR) || '-' || v AS graph_id, '0-' || CASE WHEN v = 'c' THEN 'c' ELSE 'a' END AS cls FROM region CROSS JOIN (VALUES ('a'), ('b'), ('c')) AS x(v)")
def bnode_isomorphic(spark, sf_dir):
    """For each region a ring of six blank nodes, the same under other names, and two rings of three: alike in colours, not isomorphic."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("string").alias("r"))
    rings = {"a": [(i, (i + 1) % 6) for i in range(6)], "b": [((i * 5 + 2) % 6, ((i + 1) * 5 + 2) % 6) for i in range(6)], "c": [(i, i // 3 * 3 + (i + 1) % 3) for i in range(6)]}
    links = spark.createDataFrame([(v, f"n{x}", f"n{y}") for v, pairs in rings.items() for x, y in pairs], "v string, x string, y string")
    rows = regions.crossJoin(F.broadcast(links))  # eighteen links for each region
    triples = rows.select(F.concat_ws("-", "r", "v").alias("graph_id"), F.lit(t.BNODE).alias("s_kind"), F.concat("v", "x").alias("s"), F.lit("urn:p:next").alias("p"), F.lit(t.BNODE).alias("o_kind"), F.concat("v", "y").alias("o"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    return G.isomorphism_classes(triples)


# ------------------------------------------------------------------ exploration

T1 = transformer("urn:t:label", PREFIXES + "ASK { ?s c:n_name ?n }", RENAME, "Label")
T2 = transformer("urn:t:place", PREFIXES + "ASK { ?s c:n_regionkey ?r }", PREFIXES + "DELETE { ?s c:n_regionkey ?r } INSERT { ?s p:in ?r } WHERE { ?s c:n_regionkey ?r }", "Place")
A1 = application("urn:a:labels", PREFIXES + "ASK { ?s p:label ?l }", title="Labels")
A2 = application("urn:a:map", PREFIXES + "ASK { ?s p:label ?l ; p:in ?r }", title="Map")


def _roots(spark, sf_dir):
    """run_id: the region's place among regions in order of IRI; the sample: the region's nations."""
    nations = load_triples(spark, sf_dir, ["nation"], {"nation": F.format_string("%03d", F.col("n_regionkey"))})
    return nations.withColumnRenamed("graph_id", "run_id")


def _explored(spark, sf_dir, **how) -> E.Result:
    return E.explore(_roots(spark, sf_dir), [A1, A2], [T1, T2], blank=False, **how)


#: Level by level: what a node's graph has is told by which rules were applied; the second meeting of both is redundant.
_NODES_SQL = """WITH runs AS (SELECT DISTINCT printf('%03d', n_regionkey) AS run_id FROM nation),
rules AS (SELECT * FROM (VALUES (0, 'urn:t:label'), (1, 'urn:t:place')) AS x(idx, iri)),
l0 AS (SELECT run_id, 'root' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS level, CAST(NULL AS VARCHAR) AS transformer, 0 AS num, 0 AS mask FROM runs),
l1 AS (SELECT run_id, '0_' || num AS node_id, 'root' AS parent_id, 1 AS level, transformer, num, mask FROM (SELECT run_id, iri AS transformer, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS num, 1 << idx AS mask FROM l0 CROSS JOIN rules)),
l2 AS (SELECT run_id, '1_' || num AS node_id, parent_id, 2 AS level, transformer, num, mask FROM (SELECT run_id, node_id AS parent_id, iri AS transformer, row_number() OVER (PARTITION BY run_id ORDER BY num, idx) AS num, mask | (1 << idx) AS mask FROM l1 JOIN rules ON (mask >> idx) & 1 = 0)),
nodes AS (SELECT *, false AS redundant FROM l0 UNION ALL SELECT *, row_number() OVER (PARTITION BY run_id, mask ORDER BY num) > 1 FROM l1 UNION ALL SELECT *, row_number() OVER (PARTITION BY run_id, mask ORDER BY num) > 1 FROM l2),
apps AS (SELECT run_id, node_id, level, transformer, num, parent_id, 'urn:a:labels' AS application FROM nodes WHERE NOT redundant AND mask & 1 = 1 UNION ALL SELECT run_id, node_id, level, transformer, num, parent_id, 'urn:a:map' FROM nodes WHERE NOT redundant AND mask = 3) """


@query("explore_nodes", _NODES_SQL + "SELECT n.run_id, n.node_id, n.parent_id, n.level, n.transformer, coalesce(string_agg(a.application, ' ' ORDER BY a.application), '') AS applications, n.redundant, true AS expanded FROM nodes n LEFT JOIN apps a ON n.run_id = a.run_id AND n.node_id = a.node_id GROUP BY ALL")
def explore_nodes(spark, sf_dir):
    n = _explored(spark, sf_dir).nodes
    return n.select("run_id", "node_id", "parent_id", "level", "transformer", F.array_join("applications", " ").alias("applications"), "redundant", "expanded")


#: A run for each nation, its sample being the nation's customers.
_C1 = transformer("urn:t:label", PREFIXES + "ASK { ?s c:c_name ?n }", PREFIXES + "DELETE { ?s c:c_name ?n } INSERT { ?s p:label ?n } WHERE { ?s c:c_name ?n }", "Label")
_C2 = transformer("urn:t:place", PREFIXES + "ASK { ?s c:c_nationkey ?r }", PREFIXES + "DELETE { ?s c:c_nationkey ?r } INSERT { ?s p:in ?r } WHERE { ?s c:c_nationkey ?r }", "Place")


@query("explore_customers", _NODES_SQL.replace("DISTINCT printf('%03d', n_regionkey) AS run_id FROM nation", "DISTINCT printf('%03d', c_nationkey) AS run_id FROM customer") + "SELECT n.run_id, n.node_id, n.parent_id, n.level, n.transformer, coalesce(string_agg(a.application, ' ' ORDER BY a.application), '') AS applications, n.redundant FROM nodes n LEFT JOIN apps a ON n.run_id = a.run_id AND n.node_id = a.node_id GROUP BY ALL")
def explore_customers(spark, sf_dir):
    roots = load_triples(spark, sf_dir, ["customer"], {"customer": F.format_string("%03d", F.col("c_nationkey"))}).withColumnRenamed("graph_id", "run_id")
    n = E.explore(roots, [A1, A2], [_C1, _C2], blank=False).nodes
    return n.select("run_id", "node_id", "parent_id", "level", "transformer", F.array_join("applications", " ").alias("applications"), "redundant")


_OPEN = "ASK { ?s a <urn:table:region> FILTER NOT EXISTS { ?x p:next ?y } }"
_RING = lambda links: PREFIXES + "INSERT { " + " . ".join(f"_:n{a} p:next _:n{b}" for a, b in links) + " } WHERE { ?s a <urn:table:region> }"
_R1 = transformer("urn:t:six", PREFIXES + _OPEN, _RING([(i, (i + 1) % 6) for i in range(6)]), "Ring of six")
_R2 = transformer("urn:t:threes", PREFIXES + _OPEN, _RING([(i, i // 3 * 3 + (i + 1) % 3) for i in range(6)]), "Two rings of three")
_R3 = transformer("urn:t:again", PREFIXES + _OPEN, _RING([((i * 5 + 2) % 6, (i * 5 + 7) % 6) for i in range(6)]), "Ring of six, otherwise written")


@query("explore_rings", "SELECT printf('%03d', r_regionkey) AS run_id, node_id, level, redundant FROM region CROSS JOIN (VALUES ('root', 0, false), ('0_1', 1, false), ('0_2', 1, false), ('0_3', 1, true)) AS x(node_id, level, redundant)")
def explore_rings(spark, sf_dir):
    """States that share all colours: a ring of six blank nodes and two rings of three are different, the ring written twice is not."""
    regions = load_triples(spark, sf_dir, ["region"], {"region": F.format_string("%03d", F.col("r_regionkey"))}).withColumnRenamed("graph_id", "run_id")
    return E.explore(regions, [], [_R1, _R2, _R3], filter="isomorphic").nodes.select("run_id", "node_id", "level", "redundant")


@query("explore_isomorphic", _NODES_SQL + "SELECT run_id, node_id, level, redundant FROM nodes")
def explore_isomorphic(spark, sf_dir):
    return _explored(spark, sf_dir, filter="isomorphic").nodes.select("run_id", "node_id", "level", "redundant")


@query("explore_no_filter", _NODES_SQL + "SELECT run_id, node_id, level, false AS redundant FROM nodes")
def explore_no_filter(spark, sf_dir):
    return _explored(spark, sf_dir, filter="none", level_limit=2).nodes.select("run_id", "node_id", "level", "redundant")


@query("explore_graph_sizes", _NODES_SQL + "SELECT run_id || '|' || node_id AS graph_id, 3 * k AS n FROM nodes JOIN (SELECT printf('%03d', n_regionkey) AS run_id, count(*) AS k FROM nation GROUP BY 1) USING (run_id) WHERE NOT redundant")
def explore_graph_sizes(spark, sf_dir):
    return _explored(spark, sf_dir).graphs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))


_LEVEL_SQL = "SELECT n.run_id, n.level, count(*) AS start_nodes, count(*) AS expanded, count(*) FILTER (redundant) AS filtered, count(*) FILTER (NOT redundant AND n.level > 0) AS new_nodes, coalesce(max(k.next_level), 0) AS next_level, coalesce(max(f.fresh), 0) AS new_applications, coalesce(max(u.used), 0) AS applications FROM nodes n LEFT JOIN (SELECT run_id, level - 1 AS level, count(*) AS next_level FROM nodes WHERE level > 0 GROUP BY 1, 2) k ON n.run_id = k.run_id AND n.level = k.level LEFT JOIN (SELECT run_id, level, count(*) AS fresh FROM (SELECT run_id, application, min(level) AS level FROM apps GROUP BY 1, 2) GROUP BY 1, 2) f ON n.run_id = f.run_id AND n.level = f.level LEFT JOIN (SELECT run_id, level, count(DISTINCT application) AS used FROM apps GROUP BY 1, 2) u ON n.run_id = u.run_id AND n.level = u.level GROUP BY n.run_id, n.level"


@query("level_stats", _NODES_SQL + _LEVEL_SQL)
def level_stats(spark, sf_dir):
    s = P.level_statistics(_explored(spark, sf_dir).nodes)
    return s.select("run_id", "level", "start_nodes", "expanded", "filtered", "new_nodes", "next_level", "new_applications", F.size("applications").cast("long").alias("applications"))


@query("stats_total", _NODES_SQL + "SELECT n.run_id, -1 AS level, 0 AS start_nodes, count(*) AS expanded, count(*) FILTER (redundant) AS filtered, count(*) FILTER (NOT redundant AND level > 0) AS new_nodes, 0 AS next_level, (SELECT count(DISTINCT application) FROM apps a WHERE a.run_id = n.run_id) AS applications, count(DISTINCT transformer) AS transformers FROM nodes n GROUP BY n.run_id")
def stats_total(spark, sf_dir):
    s = P.total_statistics(P.level_statistics(_explored(spark, sf_dir).nodes))
    return s.select("run_id", "level", "start_nodes", "expanded", "filtered", "new_nodes", "next_level", F.size("applications").cast("long").alias("applications"), F.size("transformers").cast("long").alias("transformers"))


@query("new_apps_per_level", _NODES_SQL + "SELECT run_id, level, count(*) AS new_applications FROM (SELECT run_id, application, min(level) AS level FROM apps GROUP BY 1, 2) GROUP BY 1, 2")
def new_apps_per_level(spark, sf_dir):
    return P.new_applications(_explored(spark, sf_dir).nodes)


@query("strong_group_prune", _NODES_SQL + "SELECT run_id, node_id, level, num = 2 AND level = 1 AS pruned, num = 2 AND level = 1 AS redundant FROM nodes WHERE NOT (level = 2 AND parent_id = '0_2')")
def strong_group_prune(spark, sf_dir):
    groups = [Group.of("urn:g", ["urn:t:place", "urn:t:label"])]
    return _explored(spark, sf_dir, groups=groups).nodes.select("run_id", "node_id", "level", "pruned", "redundant")


@query("shake", _NODES_SQL + "SELECT run_id, node_id FROM nodes WHERE NOT redundant")
def shake(spark, sf_dir):
    from weftline.operators.prune import shake_non_expanded, shake_redundant

    return shake_redundant(shake_non_expanded(_explored(spark, sf_dir).nodes)).select("run_id", "node_id")


@query("edges", _NODES_SQL + "SELECT run_id, parent_id AS source, node_id AS target, transformer FROM nodes WHERE parent_id IS NOT NULL")
def edges(spark, sf_dir):
    return P.edges(_explored(spark, sf_dir).nodes).drop("seq")


@query("vertices_pivot", _NODES_SQL + "SELECT run_id, node_id AS id, level, redundant, CASE WHEN transformer = 'urn:t:place' THEN 'urn:g' ELSE '' END AS \"group\", CAST(NOT redundant AND mask & 1 = 1 AS INTEGER) AS \"Labels\", CAST(NOT redundant AND mask = 3 AS INTEGER) AS \"Map\" FROM nodes")
def vertices_pivot(spark, sf_dir):
    groups = [Group.of("urn:g", ["urn:t:place"])]
    return P.vertices(_explored(spark, sf_dir).nodes, [A1, A2], groups).drop("seq")


@query("pipelines", _NODES_SQL + "SELECT a.run_id, a.node_id, a.application, CASE WHEN a.level = 1 THEN a.transformer ELSE p.transformer || ' ' || a.transformer END AS transformers, CAST(a.level AS INTEGER) AS steps FROM apps a LEFT JOIN nodes p ON a.run_id = p.run_id AND a.parent_id = p.node_id")
def pipelines(spark, sf_dir):
    return P.pipelines(_explored(spark, sf_dir).nodes).select("run_id", "node_id", "application", F.array_join("transformers", " ").alias("transformers"), "steps")


@query("preorder", _NODES_SQL + "SELECT run_id, node_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN level = 0 THEN 0 WHEN level = 1 THEN num * 10 ELSE CAST(substring(parent_id, 3) AS INTEGER) * 10 + num END) - 1 AS visit FROM nodes")
def preorder(spark, sf_dir):
    return P.preorder(_explored(spark, sf_dir).nodes).select("run_id", "node_id", F.col("visit").cast("long").alias("visit"))


@query("resume_roundtrip", _NODES_SQL + "SELECT run_id, node_id, parent_id, level, redundant FROM nodes")
def resume_roundtrip(spark, sf_dir):
    from weftline.operators.checkpoint import load_run, save_run
    from weftline.operators.storage import run_folder
    import uuid

    half = _explored(spark, sf_dir, level_limit=1)
    path = f"{run_folder(spark)}/run-{uuid.uuid4().hex}"
    save_run(half, path)
    return _explored(spark, sf_dir, resume=load_run(spark, path)).nodes.select("run_id", "node_id", "parent_id", "level", "redundant")


# ------------------------------------------------------------------ roll-ups

_ROLL = _NODES_SQL + ", ds AS (SELECT DISTINCT printf('%03d', r_regionkey) AS run_id, 'urn:region:' || CAST(r_regionkey AS VARCHAR) AS dataset, r_name AS dataset_label FROM region JOIN nation ON n_regionkey = r_regionkey), ap AS (SELECT * FROM (VALUES ('urn:a:labels', 'Labels'), ('urn:a:map', 'Map'), ('urn:a:never', 'Never')) AS x(application, application_label)) "


def _rollup_inputs(spark, sf_dir):
    nodes = cut(_explored(spark, sf_dir).nodes.withColumn("definition", F.lit("urn:all")))
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    runs = regions.select(F.lit("urn:all").alias("definition"), F.format_string("%03d", F.col("r_regionkey")).alias("run_id"), F.format_string("run_%03d", F.col("r_regionkey")).alias("path"), subject_of("region", F.col("r_regionkey")).alias("dataset"), F.lit("").alias("endpoint"), F.col("r_name").alias("dataset_label"), (F.col("r_regionkey") * 1500).cast("long").alias("duration_ms"))
    runs = runs.join(nodes.select("run_id").distinct(), "run_id", "left_semi")
    pipes = P.pipelines(nodes).withColumn("definition", F.lit("urn:all"))
    apps = spark.createDataFrame([("urn:all", "urn:a:labels", "Labels"), ("urn:all", "urn:a:map", "Map"), ("urn:all", "urn:a:never", "Never")], "definition string, application string, application_label string")
    trans = spark.createDataFrame([("urn:all", "urn:t:label"), ("urn:all", "urn:t:place"), ("urn:all", "urn:t:never")], "definition string, transformer string")
    return nodes, runs, pipes, apps, trans


@query("rollup_application", _ROLL + "SELECT 'urn:all' AS definition, ap.application, ap.application_label, count(DISTINCT ds.dataset) AS datasets, count(a.run_id) AS pipelines FROM ap LEFT JOIN apps a ON ap.application = a.application LEFT JOIN ds ON a.run_id = ds.run_id GROUP BY ap.application, ap.application_label")
def rollup_application(spark, sf_dir):
    _, runs, pipes, apps, _ = _rollup_inputs(spark, sf_dir)
    return R.by_application(runs, pipes, apps)


@query("rollup_dataset_application", _ROLL + "SELECT 'run_' || ds.run_id AS path, ds.dataset, '' AS endpoint, a.application, 'urn:all' AS definition, ds.dataset_label, ap.application_label, count(*) AS pipelines FROM apps a JOIN ds ON a.run_id = ds.run_id JOIN ap ON ap.application = a.application GROUP BY ds.run_id, ds.dataset, a.application, ds.dataset_label, ap.application_label")
def rollup_dataset_application(spark, sf_dir):
    _, runs, pipes, apps, _ = _rollup_inputs(spark, sf_dir)
    return R.by_dataset_application(runs, pipes, apps)


@query("rollup_dataset", _ROLL + "SELECT 'run_' || ds.run_id AS path, ds.dataset, '' AS endpoint, 'urn:all' AS definition, ds.dataset_label, count(a.application) AS pipelines, count(DISTINCT a.application) AS applications FROM ds LEFT JOIN apps a ON a.run_id = ds.run_id GROUP BY ds.run_id, ds.dataset, ds.dataset_label")
def rollup_dataset(spark, sf_dir):
    _, runs, pipes, _, _ = _rollup_inputs(spark, sf_dir)
    return R.by_dataset(runs, pipes)


@query("rollup_run", _ROLL + "SELECT 'urn:all' AS definition, (SELECT count(*) FROM apps) AS pipelines, 3 AS applications, (SELECT count(DISTINCT application) FROM apps) AS applications_used, (SELECT count(DISTINCT application) FROM apps) AS applications_in_pipelines, (SELECT count(*) FROM ds) AS datasets, (SELECT count(DISTINCT run_id) FROM nodes WHERE transformer IS NOT NULL) AS datasets_used, (SELECT count(DISTINCT run_id) FROM apps) AS datasets_in_pipelines, 3 AS transformers, (SELECT count(DISTINCT transformer) FROM nodes) AS transformers_used, 2 AS transformers_in_pipelines, (SELECT CAST(sum(CAST(floor(CAST(run_id AS INTEGER) * 1.5) AS BIGINT)) AS BIGINT) FROM ds) AS exploration_seconds, CAST(NULL AS BIGINT) AS total_seconds")
def rollup_run(spark, sf_dir):
    nodes, runs, pipes, apps, trans = _rollup_inputs(spark, sf_dir)
    return R.by_definition(runs, pipes, apps, trans, nodes)


# ------------------------------------------------------------------ models and settings


@query("label_pick", "WITH x AS (SELECT source, lang, max(text) AS h FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2) SELECT source, coalesce(max(h) FILTER (lang = 'cs'), max(h) FILTER (lang = 'de'), arg_min(h, lang)) AS label FROM x GROUP BY source")
def label_pick(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null and lang is not null and text is not null")
    triples = docs.select(F.lit("g").alias("graph_id"), F.lit(t.IRI).alias("s_kind"), F.col("source").alias("s"), F.lit("urn:p:title").alias("p"), F.lit(t.LITERAL).alias("o_kind"), F.col("text").alias("o"), F.lit("").alias("o_dt"), F.col("lang").alias("o_lang"))
    return t.label_map(triples, "urn:p:title").select(F.col("s").alias("source"), t.pick_label(F.col("texts"), ("cs", "de")).alias("label"))


@query("rdf_list_walk", "SELECT 'urn:region:' || CAST(n_regionkey AS VARCHAR) AS list, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place, n_name AS item FROM nation")
def rdf_list_walk(spark, sf_dir):
    """Each region's nations as an RDF list, walked back into (list, place, item) by a recursive query."""
    from pyspark.sql import Window

    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    cells = nations.withColumn("i", F.row_number().over(w)).withColumn("last", F.lead("n_nationkey").over(w).isNull())
    node = lambda i: F.concat(F.lit("l"), F.col("n_regionkey").cast("string"), F.lit("_"), i.cast("string"))
    region = F.concat(F.lit("urn:region:"), F.col("n_regionkey").cast("string"))
    links = cells.select(node(F.col("i")).alias("s"), F.when(F.col("last"), t.RDF_NIL).otherwise(node(F.col("i") + 1)).alias("rest"), F.col("n_name").alias("first"))
    heads = cells.where("i = 1").select(region.alias("list"), node(F.col("i")).alias("head"))
    return L.walk_lists(heads, links)


@query("group_sort", "SELECT 'urn:region:' || CAST(n_regionkey AS VARCHAR) AS \"group\", string_agg(n_name, '|' ORDER BY lower(n_name), n_name) AS transformers FROM nation GROUP BY n_regionkey")
def group_sort(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(subject_of("region", F.col("n_regionkey")).alias("region"), "n_name")
    return L.sorted_groups(nations, "region", "n_name").select("group", F.array_join("transformers", "|").alias("transformers"))


@query("config_merge", "SELECT * FROM (VALUES ('filter', 'isomorphic'), ('level_limit', '3'), ('output', '/cli'), ('store', 'files')) AS x(name, value)")
def config_merge(spark, sf_dir):
    """Said on the command line first, then in the definition, then the defaults."""
    from dataclasses import asdict

    from weftline.model import DEFAULTS

    merged = asdict(Settings(output="/cli", level_limit=3).merged(Settings(output="/definition", filter="isomorphic")).merged(DEFAULTS))
    return spark.createDataFrame([(k, str(merged[k])) for k in ("filter", "level_limit", "output", "store")], "name string, value string")
