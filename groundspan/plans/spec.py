"""Specifications: typed classes compiled, before any data is read, to fields with cardinality, kind and strategies."""

from __future__ import annotations

import json
import types
import typing
from dataclasses import dataclass, field
from decimal import Decimal
from datetime import date
from graphlib import CycleError, TopologicalSorter
from hashlib import sha256
from typing import Annotated, Any, Literal, Union, get_args, get_origin

from ..operators.candidates import RegexParams
from ..operators.filters import Expr


class SpecError(ValueError):
    pass


KINDS: dict[type, str] = {Decimal: "MONEY", date: "DATE", int: "CARDINAL", bool: "BOOL", str: "ORG"}
VALUE_TYPES = {Decimal: "amount", date: "date", int: "int", bool: "bool", str: "str"}
_kinds = {"MONEY", "PERCENT", "DATE", "ORG", "PERSON", "GPE", "CARDINAL", "ORDINAL", "BOOL", "CATEGORY"}


def register_kind(name: str) -> str:
    """Adds a value kind; one that is there already stays."""
    if not name or name != name.upper():
        raise SpecError("a kind is upper case")
    _kinds.add(name)
    return name


@dataclass(frozen=True)
class Regex:
    pattern: str
    group: int | str = 0
    entity_type: str | None = None
    native: bool = False

    def params(self) -> RegexParams:
        return RegexParams(pattern=self.pattern, group=self.group, entity_type=self.entity_type)


@dataclass(frozen=True)
class Rule:
    """A category rule: the literal that a pattern speaks for or against."""

    literal: str
    pattern: str
    polarity: str = "positive"


@dataclass(frozen=True)
class Field:
    """What a class says about a field, as Annotated[type, Field(...)]."""

    description: str
    strategies: tuple[Regex, ...] = ()
    rules: tuple[Rule, ...] = ()
    kind: str | None = None
    keep: Expr | None = None
    depends_on: tuple[str, ...] = ()
    priority: int = 0
    boundary_defining: bool = False


@dataclass(frozen=True)
class FieldSpec:
    field_id: str
    ordinal: int
    cardinality: str
    kind: str
    value_type: str
    literals: tuple[str, ...]
    meta: Field


@dataclass(frozen=True)
class Spec:
    name: str
    fields: tuple[FieldSpec, ...]
    rules: dict[str, tuple[str, list[str], str]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> FieldSpec:
        return next(f for f in self.fields if f.field_id == name)

    def summary(self) -> dict[str, Any]:
        shown = lambda f: {"cardinality": f.cardinality, "kind": f.kind, "value_type": f.value_type, "literals": list(f.literals), "description": f.meta.description, "depends_on": list(f.meta.depends_on), "priority": f.meta.priority, "strategies": [vars(s) for s in f.meta.strategies], "rules": [vars(r) for r in f.meta.rules], "keep": f.meta.keep and f.meta.keep.to_json()}
        return {"name": self.name, "fields": {f.field_id: shown(f) for f in self.fields}}

    @property
    def version(self) -> str:
        return sha256(json.dumps(self.summary(), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


_registry: dict[str, type] = {}


def analyze(annotation: Any) -> tuple[str, Any, tuple[str, ...], Field | None]:
    """(cardinality, element type, literals, metadata) of a type annotation."""
    meta = None
    if get_origin(annotation) is Annotated:
        annotation, *more = get_args(annotation)
        meta = next((m for m in more if isinstance(m, Field)), None)
    cardinality = "ONE"
    if get_origin(annotation) in (Union, types.UnionType):
        args = [a for a in get_args(annotation) if a is not type(None)]
        if len(args) != 1 or len(args) == len(get_args(annotation)):
            raise SpecError("of unions only those with None are supported")
        annotation, cardinality = args[0], "OPTIONAL"
    elif get_origin(annotation) is list:
        annotation, cardinality = get_args(annotation)[0], "MANY"
    if get_origin(annotation) is Literal:
        arms = get_args(annotation)
        if not all(isinstance(a, str) for a in arms):
            raise SpecError("literals must be strings")
        return cardinality, str, arms, meta
    if annotation not in VALUE_TYPES:
        raise SpecError(f"unsupported type: {annotation}")
    return cardinality, annotation, (), meta


def dependency_order(depends: dict[str, tuple[str, ...]]) -> list[str]:
    """Names after those they depend on, ties by name; unknown names and cycles fail."""
    for name, others in depends.items():
        if unknown := set(others) - set(depends):
            raise SpecError(f"{name} depends on unknown {sorted(unknown)}")
    sorter = TopologicalSorter(depends)
    try:
        sorter.prepare()
    except CycleError as e:
        raise SpecError(f"cycle: {e.args[1]}") from e
    ready, out = sorted(sorter.get_ready()), []
    while ready:
        out.append(ready.pop(0))
        sorter.done(out[-1])
        ready = sorted([*ready, *sorter.get_ready()])
    return out


def compile_spec(cls: type, rules: dict[str, tuple[str, list[str], str]] | None = None) -> Spec:
    """The specification of a class with annotated fields. rules: cross-field rules, see operators.validation.cross_field."""
    out = []
    for ordinal, (name, annotation) in enumerate(typing.get_type_hints(cls, include_extras=True).items()):
        cardinality, element, literals, meta = analyze(annotation)
        if meta is None:
            raise SpecError(f"{name} has no Field")
        if not meta.description:
            raise SpecError(f"{name} has no description")
        kind = meta.kind or ("CATEGORY" if literals else KINDS[element])
        if kind not in _kinds:
            raise SpecError(f"unknown kind: {kind}")
        if len(literals) > 1 and not meta.rules:
            raise SpecError(f"{name} has several literals and no rules to choose")
        if unknown := {r.literal for r in meta.rules} - set(literals):
            raise SpecError(f"{name} has rules for unknown literals {sorted(unknown)}")
        if not literals and not meta.strategies:
            raise SpecError(f"{name} has no strategy")
        for strategy in meta.strategies:
            strategy.params()
        out.append(FieldSpec(name, ordinal, cardinality, kind, VALUE_TYPES[element], literals, meta))
    if not out:
        raise SpecError("a specification needs a field")
    dependency_order({f.field_id: f.meta.depends_on for f in out})
    spec = Spec(cls.__name__, tuple(out), rules or {})
    _registry[spec.version] = cls
    return spec


def lookup(version: str) -> type:
    if version not in _registry:
        raise SpecError("unknown specification")
    return _registry[version]


def producer_version(code: str, model: str | None = None, prompt: str | None = None) -> str:
    """code:<hash>, or model, prompt and code joined by bars."""
    own = "code:" + sha256(code.encode()).hexdigest()[:16]
    return own if model is None else "|".join((model, prompt or "", own))
