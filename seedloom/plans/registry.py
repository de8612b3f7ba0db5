"""Rules by which columns get generators, plugins that add rules, and their precedence."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from ..functions.generators import Gen
from . import constraints
from .dialects import default_generator
from .model import ColumnConstraint, ColumnModel

Factory = Callable[[ColumnModel], Gen]
#: Entry points of this group are functions that get a Registry.
GROUP = "seedloom.generators"


@dataclass
class Registry:
    """Patterns on names (first match wins), vendor type names and types (last one wins)."""

    patterns: list[tuple[re.Pattern, Factory]] = field(default_factory=list)
    type_names: dict[str, Factory] = field(default_factory=dict)
    types: dict[str, Factory] = field(default_factory=dict)

    def by_name(self, pattern: str, factory: Factory) -> Registry:
        self.patterns.append((re.compile(pattern, re.I), factory))
        return self

    def by_type_name(self, name: str, factory: Factory) -> Registry:
        self.type_names[name.lower()] = factory
        return self

    def by_type(self, name: str, factory: Factory) -> Registry:
        self.types[name] = factory
        return self

    def add(self, plugin: Callable[[Registry], None]) -> Registry:
        plugin(self)
        return self

    @classmethod
    def discover(cls) -> Registry:
        """A registry with the rules of all installed plugins."""
        found = cls()
        for e in entry_points(group=GROUP):
            found.add(e.load())
        return found

    def find(self, column: ColumnModel) -> tuple[str, Factory] | None:
        for pattern, factory in self.patterns:
            if pattern.fullmatch(column.name):
                return "name rule", factory
        if (f := self.type_names.get((column.vendor_type or "").lower())) is not None:
            return "type name rule", f
        if (f := self.types.get(column.type_name)) is not None:
            return "type rule", f
        return None


@dataclass(frozen=True)
class Resolved:
    gen: Gen
    source: str


def resolve(column: ColumnModel, overrides: Mapping[str, Gen] = {}, registry: Registry | None = None, constraint: ColumnConstraint | None = None, dialect: str = "default") -> Resolved:
    """Column configuration, then registry by name, type name and type, then constraint, then the dialect's default."""
    by_name = {k.lower(): v for k, v in overrides.items()}
    if column.name.lower() in by_name:
        return Resolved(by_name[column.name.lower()], "column")
    if registry is not None and (found := registry.find(column)) is not None:
        return Resolved(found[1](column), found[0])
    if constraint is not None:
        if (made := constraints.generator(column, constraint)) is not None:
            return Resolved(made, "constraint")
        warnings.warn(f"the constraint of {column.name} can't be met by construction; the type's default is used", stacklevel=2)
    return Resolved(default_generator(column, dialect), "default")
