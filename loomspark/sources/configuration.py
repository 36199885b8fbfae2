"""Configuration files as tables: a data source for sources, questions, teams, their members, services and dependencies.

``spark.read.format("loom_config").option("kind", "questions").load("questions.yaml")`` gives a row an entry. What an entry must
and may hold is a table below, from which the schema, the reading and the messages follow. Configuration lies where the driver
runs and is small: the driver reads the files as it plans, each file is a partition, and entries are parsed and checked in
its task. YAML is read where a YAML reader is installed, JSON always.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: The kinds of knowledge that sources hold.
BUCKETS = ("norms", "knowledge", "expertise")


@dataclass(frozen=True)
class Kind:
    """Entries of a file's list ``at``. ``text``, ``lists``, ``numbers``, ``flags``: fields by type; ``named``: what the file calls a field.

    ``required``: fields that an entry must have, else it is an error, or with ``lenient`` passed over. ``unique``: a field
    that no two entries share. ``any_of``: at least one of these must not be empty. ``each``: a list field of which every
    item gives a row of its own.
    """

    at: str
    text: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    unique: str | None = None
    any_of: tuple[str, ...] = ()
    named: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    choices: dict[str, Sequence[str]] = field(default_factory=dict)
    each: str | None = None
    lenient: bool = False

    def schema(self) -> str:
        lists = [f"{n} {'string' if n == self.each else 'array<string>'}" for n in self.lists]
        return ", ".join(["pos int", *(f"{n} string" for n in self.text), *lists, *(f"{n} int" for n in self.numbers), *(f"{n} boolean" for n in self.flags)])


KINDS = {
    "sources": Kind("sources", ("id", "type", "bucket"), ("paths", "exclude"), ("stale_after_days", "max_file_kb"), ("manual",), ("id", "type", "bucket", "paths"), "id", choices={"bucket": BUCKETS}),
    "questions": Kind("questions", ("id", "q"), ("expect_paths", "expect_any_paths", "expect_entities", "buckets", "sources", "paths", "tags"), ("budget_tokens",), required=("q",), unique="id", any_of=("expect_paths", "expect_any_paths", "expect_entities"), defaults={"id": "q{}"}),
    "teams": Kind("teams", ("name", "oncall"), required=("name",), lenient=True),
    "members": Kind("teams", ("name",), ("members",), required=("name",), each="members", lenient=True),
    "services": Kind("services", ("name", "team", "runbook"), ("paths",), required=("name",), lenient=True),
    "dependencies": Kind("edges", ("source", "target", "via"), required=("source", "target"), named={"source": "from", "target": "to", "via": "kind"}, defaults={"via": "unknown"}, lenient=True),
}


class ConfigurationError(ValueError):
    """What a configuration lacks, and where."""


def parse(text: str, name: str) -> Any:
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        return yaml.safe_load(text) if yaml else json.loads(text or "null")
    except Exception as e:
        raise ConfigurationError(f"{name} can't be read: {e}") from None


def _strings(value: Any, where: str) -> list[str]:
    if value is None:
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return value
    raise ConfigurationError(f"{where} must be a string or a list of strings")


def entries(data: Any, kind: Kind) -> Iterator[tuple]:
    """The rows of a parsed file."""
    listed = data.get(kind.at) if isinstance(data, dict) else None
    if not listed and kind.lenient:
        return
    if not isinstance(listed, list) or not listed:
        raise ConfigurationError(f"a mapping with a non-empty list '{kind.at}' is needed")
    seen: set[str] = set()
    for pos, entry in enumerate(listed):
        where = f"{kind.at}[{pos}]"
        get = lambda name, e=entry: e.get(kind.named.get(name, name))
        lacking = [kind.named.get(n, n) for n in kind.required if not isinstance(entry, dict) or not get(n)]
        if lacking and kind.lenient:
            continue
        if lacking:
            raise ConfigurationError(f"{where} needs {', '.join(lacking)}")
        row: dict[str, Any] = {n: str(get(n)) if get(n) is not None else kind.defaults.get(n, "").format(pos + 1) or None for n in kind.text}
        row |= {n: _strings(get(n), f"{where}.{n}") for n in kind.lists}
        row |= {n: None if get(n) is None else int(get(n)) for n in kind.numbers} | {n: bool(get(n)) for n in kind.flags}
        for n, allowed in kind.choices.items():
            if row[n] not in allowed:
                raise ConfigurationError(f"{where}.{n} must be one of {', '.join(allowed)}")
        if kind.any_of and not any(row[n] for n in kind.any_of):
            raise ConfigurationError(f"{where} needs one of {', '.join(kind.any_of)}")
        if kind.unique:
            if row[kind.unique] in seen:
                raise ConfigurationError(f"duplicate {kind.unique} {row[kind.unique]!r} in '{kind.at}'")
            seen.add(row[kind.unique])
        for item in row[kind.each] if kind.each else [None]:
            yield (pos, *(item if n == kind.each else v for n, v in row.items()))


@dataclass
class _File(InputPartition):
    name: str
    text: str


class _Reader(DataSourceReader):
    def __init__(self, kind: Kind, path: str):
        self.kind, self.path = kind, path

    def partitions(self) -> Sequence[InputPartition]:
        names = sorted(glob.glob(os.path.join(self.path, "*") if os.path.isdir(self.path) else self.path))
        if not names:
            raise ConfigurationError(f"no configuration at {self.path}")
        out = []
        for name in names:
            with open(name, encoding="utf-8") as f:
                out.append(_File(os.path.basename(name), f.read()))
        return out

    def read(self, partition: _File) -> Iterator[tuple]:
        yield from entries(parse(partition.text, partition.name), self.kind)


class ConfigurationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_config"

    def _kind(self) -> Kind:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ConfigurationError(f"option 'kind' must be one of {', '.join(KINDS)}")
        return KINDS[kind]

    def schema(self) -> str:
        return self._kind().schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._kind(), self.options.get("path", ""))


def read_configuration(spark: SparkSession, kind: str, path: str):
    """The entries of one kind in a file, in all files of a folder, or in those that a pattern fits."""
    spark.dataSource.register(ConfigurationSource)
    return spark.read.format("loom_config").option("kind", kind).load(path)
