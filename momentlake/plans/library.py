"""Registries that users extend: questions for frames and definitions of answers about whole recordings."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from momentlake.errors import Refused, UnknownOption
from momentlake.schemas import check_fields, json_schema

KINDS = ("fold", "spans", "items", "link")


def version_of(definition: dict) -> str:
    """Twelve hex digits that identify a definition by its content."""
    return hashlib.sha256(json.dumps(definition, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class Entry:
    name: str
    kind: str
    instruction: str
    fields: dict = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    builtin: bool = False

    @property
    def version(self) -> str:
        return version_of({k: v for k, v in asdict(self).items() if k != "builtin"})

    def json_schema(self) -> dict:
        return json_schema(self.fields)


class Library:
    """Entries by name.  Built-in ones can be neither replaced nor removed."""

    def __init__(self, *builtin: Entry):
        self._entries = {e.name: Entry(**{**asdict(e), "needs": tuple(e.needs), "builtin": True}) for e in builtin}

    def names(self) -> list[str]:
        return sorted(self._entries)

    def get(self, name: str) -> Entry:
        if name not in self._entries:
            raise UnknownOption("entry", name, self.names())
        return self._entries[name]

    def add(self, entry: Entry, replace: bool = False) -> str:
        """The version of the added entry."""
        if entry.kind not in (*KINDS, "question"):
            raise UnknownOption("kind", entry.kind, (*KINDS, "question"))
        if problems := check_fields(entry.fields):
            raise Refused("; ".join(problems))
        if not entry.instruction.strip():
            raise Refused(f"{entry.name} needs an instruction")
        old = self._entries.get(entry.name)
        if old and (old.builtin or not replace):
            raise Refused(f"{entry.name!r} is {'built in' if old.builtin else 'taken'}")
        self._entries[entry.name] = Entry(**{**asdict(entry), "needs": tuple(entry.needs), "builtin": False})
        return entry.version

    def remove(self, name: str) -> None:
        if self.get(name).builtin:
            raise Refused(f"{name!r} is built in")
        del self._entries[name]

    def rows(self, spark: SparkSession) -> DataFrame:
        """name, version, kind and definition (JSON), for the append-only tables of a store."""
        rows = [(e.name, e.version, e.kind, json.dumps(asdict(e), sort_keys=True)) for e in self._entries.values()]
        return spark.createDataFrame(rows, "name string, version string, kind string, definition string")


def instruction(template: str, **values: object) -> str:
    """A template with {n}, {span}, {vocabulary} and the like filled in; other braces stay."""
    for key, value in values.items():
        template = template.replace(f"{{{key}}}", ", ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value))
    return template


def frame_label(number: int, media_ts: float, view: str | None = None) -> str:
    """What stands beside an image in a question: its number, its second, and what part of the frame it shows."""
    return f"Frame {number} at {media_ts:.1f}s" + (f": {view}" if view else "")
