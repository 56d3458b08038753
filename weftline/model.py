"""Components of an exploration: datasets, applications, transformers, groups and settings."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, replace

LABEL_LANGUAGES = ("cs", "en")


#: What a vocabulary names: kinds of records, their properties and the properties of a run.
ROLES = (
    "dataset", "application", "transformer", "input", "has_template", "imports", "has_group", "has_transformer", "has_definition", "sample", "configuration", "input_port",
    "output_port", "feature", "executor", "configuration_query", "descriptor", "query", "applies_to", "service", "definition", "title", "description", "endpoint",
)


class Vocabulary:
    """The IRIs that definitions are written with: one for each of ROLES, and one for each setting that a definition may give."""

    def __init__(self, terms: dict[str, str], settings: dict[str, str] | None = None, base: str = ""):
        """terms: role to IRI; settings: field of Settings to IRI; what has no scheme is put behind ``base``."""
        known = {f.name for f in fields(Settings)}
        if missing := [x for x in ROLES if x not in terms]:
            raise ValueError("the vocabulary lacks " + ", ".join(missing))
        if strange := sorted({*terms} - {*ROLES} | {*(settings or {})} - known):
            raise ValueError("the vocabulary has unknown entries: " + ", ".join(strange))
        whole = lambda x: x if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x) else base + x
        self.terms = {k: whole(v) for k, v in terms.items()}
        self.settings = {whole(v): k for k, v in (settings or {}).items()}

    @staticmethod
    def read(path: str) -> Vocabulary:
        """From a JSON file: {"base": IRI, "terms": {role: IRI or ending}, "settings": {field: IRI or ending}}."""
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return Vocabulary(found["terms"], found.get("settings"), found.get("base", ""))

    def __getattr__(self, name: str) -> str:
        try:
            return self.__dict__["terms"][name]
        except KeyError:
            raise AttributeError(name) from None


def label(texts: dict[str, str], languages: tuple[str, ...] = LABEL_LANGUAGES) -> str:
    """The text of the first language there is, else of the least language key, else ''."""
    for x in languages:
        if x in texts:
            return texts[x]
    return texts[min(texts)] if texts else ""


@dataclass(frozen=True)
class Port:
    iri: str
    title: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Descriptor:
    query: str
    applies_to: Port | None = None
    title: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Feature:
    descriptors: tuple[Descriptor, ...] = ()
    title: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Configuration:
    title: dict[str, str] = field(default_factory=dict, hash=False)
    query: str | None = None
    configuration_query: str | None = None
    endpoint: str | None = None


@dataclass(frozen=True)
class Component:
    iri: str
    title: dict[str, str] = field(default_factory=dict, hash=False)
    description: dict[str, str] = field(default_factory=dict, hash=False)
    configuration: Configuration | None = None
    inputs: tuple[Port, ...] = ()
    features: tuple[Feature, ...] = ()

    @property
    def label(self) -> str:
        return label(self.title)

    @property
    def guards(self) -> list[str]:
        """The ASK texts that must all hold; none: the component always fits."""
        return [d.query for f in self.features for d in f.descriptors]


@dataclass(frozen=True)
class Application(Component):
    executor: str | None = None


@dataclass(frozen=True)
class Transformer(Component):
    outputs: tuple[Port, ...] = ()

    @property
    def rule(self) -> str:
        return (self.configuration.query if self.configuration else None) or ""


@dataclass(frozen=True)
class Group:
    iri: str
    transformers: tuple[str, ...] = ()

    @staticmethod
    def of(iri: str, transformers: list[str]) -> Group:
        return Group(iri, tuple(sorted(transformers, key=lambda x: (x.lower(), x))))


@dataclass(frozen=True)
class Dataset:
    iri: str
    title: dict[str, str] = field(default_factory=dict, hash=False)
    configuration: Configuration | None = None
    rows: tuple = field(default=(), hash=False, repr=False)

    @property
    def label(self) -> str:
        return label(self.title)

    def endpoint(self, default: str = "") -> str:
        found = self.configuration.endpoint if self.configuration else None
        return default if found is None else found


def application(iri: str, *guards: str, title: str = "") -> Application:
    """An application with one descriptor for each guard."""
    return Application(iri, {"en": title or iri}, features=(Feature(tuple(Descriptor(g) for g in guards)),))


def transformer(iri: str, guard: str, rule: str, title: str = "") -> Transformer:
    return Transformer(iri, {"en": title or iri}, configuration=Configuration(query=rule), features=(Feature((Descriptor(guard),)),))


@dataclass(frozen=True)
class Settings:
    """Of one run; None: not said, so that what is said elsewhere, or the default, holds."""

    level_limit: int | None = None
    output: str | None = None
    filter: str | None = None
    use_mapping: bool | None = None
    store: str | None = None
    resume: bool | None = None
    time_limit_minutes: int | None = None
    use_strong_groups: bool | None = None
    url_cache: str | None = None
    node_time_limit_seconds: int | None = None

    def merged(self, other: Settings) -> Settings:
        """This one's values, the other's where this one has none."""
        return replace(self, **{f.name: getattr(other, f.name) for f in fields(self) if getattr(self, f.name) is None})


DEFAULTS = Settings(level_limit=-1, output="./output", filter="diff", use_mapping=False, store="files", resume=False, time_limit_minutes=-1, use_strong_groups=False, url_cache=None, node_time_limit_seconds=-1)
