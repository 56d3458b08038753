"""Definitions: documents that name datasets, applications, transformers, groups and settings.

They are small by nature (texts of queries and references), so they are read on the driver; samples
become DataFrames when a run starts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from weftline.functions.terms import BNODE, IRI, LITERAL, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE
from weftline.model import Application, Configuration, Dataset, Descriptor, Feature, Group, Port, Settings, Transformer, Vocabulary

from .rdf import UrlCache, load_rows
from .turtle import RdfError, Row


class Document:
    """The statements of one document, by subject, in their order."""

    def __init__(self, rows: list[Row]):
        self.rows = rows
        self.of: dict[tuple[str, str], list[Row]] = defaultdict(list)
        for r in rows:
            self.of[r[0], r[1]].append(r)

    def about(self, node: tuple[str, str] | str) -> list[Row]:
        return self.of.get((IRI, node) if isinstance(node, str) else node, [])

    def by_class(self, cls: str) -> list[tuple[str, str]]:
        """Subjects of that type, each once, in the document's order; the class is compared as text."""
        return list(dict.fromkeys((r[0], r[1]) for r in self.rows if r[2] == RDF_TYPE and r[4] == cls))

    def one_by_class(self, cls: str) -> tuple[str, str]:
        found = self.by_class(cls)
        if len(found) != 1:
            raise RdfError(f"expected one {cls}, found {len(found)}")
        return found[0]

    def texts(self, node: tuple[str, str], predicate: str) -> dict[str, str]:
        """By language; the last wins; what is no literal is passed over."""
        return {r[6]: r[4] for r in self.about(node) if r[2] == predicate and r[3] == LITERAL}

    def objects(self, node: tuple[str, str] | str, predicate: str) -> list[tuple[str, str]]:
        return [(r[3], r[4]) for r in self.about(node) if r[2] == predicate]

    def value(self, node: tuple[str, str], predicate: str) -> str | None:
        found = self.objects(node, predicate)
        return found[-1][1] if found else None

    def items(self, node: tuple[str, str]) -> list[tuple[str, str]]:
        """The members of an RDF list."""
        out, seen = [], set()
        while node != (IRI, RDF_NIL):
            if node in seen or node[0] == LITERAL:
                raise RdfError("not a well-formed list")
            seen.add(node)
            first, rest = self.objects(node, RDF_FIRST), self.objects(node, RDF_REST)
            if len(first) != 1 or len(rest) != 1:
                raise RdfError("not a well-formed list")
            out.append(first[0])
            node = rest[0]
        return out

    def is_list(self, node: tuple[str, str]) -> bool:
        return node == (IRI, RDF_NIL) or bool(self.objects(node, RDF_FIRST))


class Reader:
    """Records of one document; ports of the same IRI are the same object."""

    def __init__(self, document: Document, vocabulary: Vocabulary):
        self.d, self.v = document, vocabulary
        self.ports: dict[str, Port] = {}

    def port(self, node: tuple[str, str]) -> Port:
        if node[1] not in self.ports:
            self.ports[node[1]] = Port(node[1], self.d.texts(node, self.v.title))
        return self.ports[node[1]]

    def configuration(self, node: tuple[str, str] | None) -> Configuration | None:
        if node is None:
            return None
        service = self.d.objects(node, self.v.service)
        endpoint = self.d.value(service[-1], self.v.endpoint) if service else None
        return Configuration(self.d.texts(node, self.v.title), self.d.value(node, self.v.query), self.d.value(node, self.v.configuration_query), endpoint)

    def _common(self, node: tuple[str, str]) -> dict:
        v, d = self.v, self.d
        features = []
        for f in d.objects(node, v.feature):
            descriptors = []
            for x in d.objects(f, v.descriptor):
                query = d.value(x, v.query)
                if query is None:
                    raise RdfError(f"descriptor {x[1]} has no query")
                target = d.objects(x, v.applies_to)
                descriptors.append(Descriptor(query, self.port(target[0]) if target else None, d.texts(x, v.title)))
            features.append(Feature(tuple(descriptors), d.texts(f, v.title)))
        made = d.objects(node, v.configuration)
        return {
            "title": d.texts(node, v.title),
            "description": d.texts(node, v.description),
            "configuration": self.configuration(made[-1] if made else None),
            "inputs": tuple(self.port(x) for x in d.objects(node, v.input_port) if x[0] != LITERAL),
            "features": tuple(features),
        }

    def application(self, node: tuple[str, str]) -> Application:
        return Application(node[1], **self._common(node), executor=self.d.value(node, self.v.executor))

    def transformer(self, node: tuple[str, str]) -> Transformer:
        outputs = tuple(self.port(x) for x in self.d.objects(node, self.v.output_port) if x[0] != LITERAL)
        return Transformer(node[1], **self._common(node), outputs=outputs)

    def dataset(self, node: tuple[str, str], rows: list[Row]) -> Dataset:
        made = self.d.objects(node, self.v.configuration)
        return Dataset(node[1], self.d.texts(node, self.v.title), self.configuration(made[-1] if made else None), tuple(rows))

    def group(self, node: tuple[str, str]) -> Group:
        return Group.of(node[1], [x[1] for x in self.d.objects(node, self.v.has_transformer)])


def dataset_from_directory(iri: str, label: str, folder: str | Path) -> Dataset:
    """A dataset whose sample is the folder's sample.ttl."""
    return Dataset(iri, {"": label}, None, tuple(load_rows(str(Path(folder) / "sample.ttl"))))


@dataclass
class Definition:
    iri: str
    datasets: list[Dataset] = field(default_factory=list)
    applications: list[Application] = field(default_factory=list)
    transformers: list[Transformer] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)
    settings: Settings = field(default_factory=Settings)
    issues: list[str] = field(default_factory=list)


def _setting(name: str, text: str):
    kind = Settings.__annotations__[name]
    return text in ("true", "1") if "bool" in kind else int(text) if "int" in kind else text


def settings_of(document: Document, node: tuple[str, str], vocabulary: Vocabulary) -> Settings:
    """The settings that the node gives, the last of each."""
    return Settings(**{vocabulary.settings[r[2]]: _setting(vocabulary.settings[r[2]], r[4]) for r in document.about(node) if r[2] in vocabulary.settings})


def load_definition(location: str, vocabulary: Vocabulary, cache: UrlCache | None = None, load: Callable[[str], list[Row]] | None = None) -> Definition:
    """Reads the document with exactly one input, what it imports (each document once), and every template.

    A template that can't be read becomes an issue. A run needs a dataset, so none is an error.
    """
    load = load or (lambda x: load_rows(x, cache))
    found, seen, templates = Definition(location), set(), []

    def follow(at: str) -> None:
        if at in seen:
            return
        seen.add(at)
        d = Document(load(at))
        node = d.one_by_class(vocabulary.input)
        for kind, target in d.objects(node, vocabulary.imports):
            if kind == IRI:
                follow(target)
        templates.extend(x for kind, x in d.objects(node, vocabulary.has_template) if kind == IRI)
        reader = Reader(d, vocabulary)
        found.groups += [reader.group(x) for x in d.objects(node, vocabulary.has_group) if x[0] != LITERAL]
        for x in d.objects(node, vocabulary.definition):
            if x[0] in (IRI, BNODE):
                found.settings = found.settings.merged(settings_of(d, x, vocabulary))

    follow(location)
    for url in dict.fromkeys(templates):
        try:
            d = Document(load(url))
            reader = Reader(d, vocabulary)
            kinds = {r[4] for r in d.about(url) if r[2] == RDF_TYPE}
            node = (IRI, url)
            if vocabulary.application in kinds:
                found.applications.append(reader.application(node))
            elif vocabulary.transformer in kinds:
                found.transformers.append(reader.transformer(node))
            elif vocabulary.dataset in kinds:
                # the sample may be named by the dataset or by one of its ports
                named = [r[4] for r in d.rows if r[2] == vocabulary.sample]
                if not named:
                    raise RdfError(f"dataset {url} has no sample")
                found.datasets.append(reader.dataset(node, load(named[0])))
            else:
                found.issues.append(f"{url}: no known type")
        except (RdfError, OSError, ValueError) as e:
            found.issues.append(f"{url}: {e}")
    if not found.datasets:
        raise RdfError(f"{location}: no dataset" + "".join(f"\n{x}" for x in found.issues))
    found.datasets.sort(key=lambda x: x.iri)
    return found


@dataclass
class Experiment:
    definitions: list[str]
    settings: Settings


def load_experiment(location: str, vocabulary: Vocabulary, cache: UrlCache | None = None) -> Experiment:
    """The definitions of an experiment, one or an RDF list, and its output."""
    d = Document(load_rows(location, cache))
    urls: list[str] = []
    settings = Settings()
    for r in d.rows:
        if r[2] == vocabulary.has_definition:
            node = (r[3], r[4])
            urls += [x[1] for x in d.items(node)] if d.is_list(node) else [node[1]]
        if r[2] == vocabulary.definition:
            settings = settings.merged(Settings(output=settings_of(d, (r[3], r[4]), vocabulary).output))
    return Experiment(urls, settings)


def report_issues(issues: list[str], output: str | Path) -> None:
    """Adds the issues to builder-report.txt in the output folder."""
    if issues:
        Path(output).mkdir(parents=True, exist_ok=True)
        with (Path(output) / "builder-report.txt").open("a", encoding="utf-8") as f:
            f.writelines(x + "\n" for x in issues)
