"""Reading and writing triples.

N-Triples files are read line by line with column functions, so any number and size of files is
distributed. Turtle has no such unit; each file is parsed whole by one task, files in parallel. A
file's graph_id is its path unless given.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from pathlib import Path, PurePosixPath
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.terms import BNODE, IRI, LITERAL, TRIPLES, XSD_STRING, line

from . import turtle
from .turtle import BASE_IRI, RdfError

TURTLE_SUFFIXES = {".ttl", ".turtle", ".n3"}
NTRIPLES_SUFFIXES = {".nt"}

_IRI = r"<([^\x00-\x20<>]*)>"
_SUBJECT = rf"^\s*(?:{_IRI}|_:([\w\-.]+))"
_PREDICATE = rf"^\s*(?:<[^>]*>|_:\S+)\s*{_IRI}"
_LEXICAL = r'"((?:[^"\\]|\\.)*)"'
_TAIL = rf"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^{_IRI})?"
_OBJECT = rf"^\s*(?:<[^>]*>|_:\S+)\s*<[^>]*>\s*(?:{_IRI}|_:([\w\-]+(?:\.+[\w\-]+)*)|{_LEXICAL}{_TAIL})\s*\.\s*(?:#.*)?$"


def unescaped(lex: Column) -> Column:
    """N-Triples escapes undone; \\u escapes are rare, and only texts with one are split at them."""
    named = F.replace(lex, F.lit("\\\\"), F.lit("\x00"))
    for name, raw in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
        named = F.replace(named, F.lit(name), F.lit(raw))

    def decoded(part: Column) -> Column:
        wide = part.startswith("U")
        size = F.when(wide, F.lit(8)).otherwise(F.lit(4))
        code = F.conv(F.substring(part, F.lit(2), size), 16, 10).cast("int")
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        utf16 = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 4, "0"))
        units = F.when(code < 0x10000, utf16(code)).otherwise(F.concat(utf16(high), utf16(low)))
        return F.concat(F.decode(units, "UTF-16BE"), F.substring(part, size + 2, F.length(part)))

    parts = F.split(named, r"\\(?=u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})", -1)
    coded = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded), ""))
    out = F.when(named.contains("\\u") | named.contains("\\U"), coded).otherwise(named)
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def ntriples_rows(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Triples of (graph_id, value: a line); comments and empty lines are dropped, other lines that aren't triples raise (or, not strict, are dropped)."""
    v = F.col("value")
    rows = lines.where(~v.rlike(r"^\s*(#.*)?$"))
    o = [F.regexp_extract(v, _OBJECT, i) for i in range(1, 6)]
    well = v.rlike(_OBJECT) & v.rlike(_PREDICATE) & v.rlike(_SUBJECT)
    if strict:
        shown = F.substring(v, 1, 120)
        rows = rows.withColumn("value", F.when(well, v).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples line: "), shown))))
    else:
        rows = rows.where(well)
    is_bnode, literal_ = v.rlike(r"^\s*_:"), v.rlike(r'^\s*(?:<[^>]*>|_:\S+)\s*<[^>]*>\s*"')
    object_bnode = v.rlike(r"^\s*(?:<[^>]*>|_:\S+)\s*<[^>]*>\s*_:")
    return rows.select(
        "graph_id",
        F.when(is_bnode, BNODE).otherwise(IRI).alias("s_kind"),
        F.when(is_bnode, F.regexp_extract(v, _SUBJECT, 2)).otherwise(unescaped(F.regexp_extract(v, _SUBJECT, 1))).alias("s"),
        unescaped(F.regexp_extract(v, _PREDICATE, 1)).alias("p"),
        F.when(literal_, LITERAL).when(object_bnode, BNODE).otherwise(IRI).alias("o_kind"),
        F.when(literal_, unescaped(o[2])).when(object_bnode, o[1]).otherwise(unescaped(o[0])).alias("o"),
        F.when(literal_ & (o[4] != XSD_STRING), unescaped(o[4])).otherwise("").alias("o_dt"),
        F.when(literal_, F.lower(o[3])).otherwise("").alias("o_lang"),
    )


def read_ntriples(spark: SparkSession, path: str, graph_id: str | None = None, strict: bool = True) -> DataFrame:
    name = F.lit(graph_id) if graph_id is not None else F.col("_metadata.file_path")
    return ntriples_rows(spark.read.text(path).select(name.alias("graph_id"), "value"), strict)


def read_turtle(spark: SparkSession, path: str, graph_id: str | None = None, base: str = BASE_IRI) -> DataFrame:
    """Each file is one unit of work; blank node labels carry a hash of the path."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"), F.substring(F.md5("path"), 1, 8).alias("mark"))

    def rows(parts):
        for pdf in parts:
            for name, text, mark in zip(pdf["path"], pdf["text"], pdf["mark"], strict=True):
                found = turtle.parse(text.lstrip("﻿"), base, mark + "-")
                yield pd.DataFrame([(graph_id if graph_id is not None else name, *r) for r in found], columns=TRIPLES.fieldNames())

    return files.mapInPandas(rows, TRIPLES)


def read_rdf(spark: SparkSession, path: str, graph_id: str | None = None, format: str | None = None) -> DataFrame:
    """Triples of a file, by its extension unless the format (turtle, ntriples) is given."""
    suffix = PurePosixPath(urlparse(path).path or path).suffix.lower()
    format = format or ("turtle" if suffix in TURTLE_SUFFIXES else "ntriples" if suffix in NTRIPLES_SUFFIXES else None)
    if format is None:
        raise RdfError(f"no known RDF format for {path}")
    return (read_turtle if format == "turtle" else read_ntriples)(spark, path, graph_id)


def from_rows(spark: SparkSession, rows: list[turtle.Row], graph_id: str) -> DataFrame:
    """A small document, parsed on the driver, as triples."""
    return spark.createDataFrame([(graph_id, *r) for r in rows], TRIPLES)


class UrlCache:
    """Opens URLs; with a folder, each is fetched once and kept under ``data/`` with ``cache.json`` as the index."""

    def __init__(self, folder: str | Path | None = None, opener: Callable[[str], bytes] | None = None):
        self.folder = Path(folder) if folder else None
        self.opener = opener or (lambda url: urllib.request.urlopen(url, timeout=60).read())  # noqa: S310
        index = self.folder / "cache.json" if self.folder else None
        self.index: dict[str, str] = json.loads(index.read_text()) if index and index.exists() else {}

    def open(self, url: str) -> bytes:
        if self.folder is None:
            return self.opener(url)
        if url not in self.index:
            data = self.opener(url)
            name = f"data/{len(self.index):05d}"
            (self.folder / "data").mkdir(parents=True, exist_ok=True)
            (self.folder / name).write_bytes(data)
            self.index[url] = name
            (self.folder / "cache.json").write_text(json.dumps(self.index, indent=1))
        return (self.folder / self.index[url]).read_bytes()


def load_rows(location: str, cache: UrlCache | None = None) -> list[turtle.Row]:
    """The statements of a definition document (a path, or a file:, http: or https: URL), parsed on the driver; what comes by http is always Turtle."""
    parsed = urlparse(location)
    if parsed.scheme in ("http", "https"):
        return turtle.parse((cache or UrlCache()).open(location).decode("utf-8"), location)
    if parsed.scheme not in ("", "file"):
        raise RdfError(f"unsupported protocol {parsed.scheme!r}")
    path = Path(urllib.request.url2pathname(parsed.path) if parsed.scheme else location)
    if path.suffix.lower() not in TURTLE_SUFFIXES | NTRIPLES_SUFFIXES:
        raise RdfError(f"no known RDF format for {location}")
    return turtle.parse(path.read_text(encoding="utf-8"), BASE_IRI)


def lines(triples: DataFrame) -> DataFrame:
    """graph_id, line: the triples in N-Triples."""
    return triples.select("graph_id", line().alias("line"))


def write_ntriples(triples: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """Writes N-Triples text, in a folder for each value of ``by`` if given."""
    rows = triples.select(*([by] if by else []), line().alias("value"))
    (rows.write.mode(mode).partitionBy(by) if by else rows.write.mode(mode)).text(path)
