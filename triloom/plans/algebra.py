"""Algebra nodes and expressions; plain dataclasses, compared by value."""

from __future__ import annotations

from dataclasses import dataclass, field


class UnsupportedQuery(ValueError):
    """A construct that this engine doesn't answer."""


class UnsupportedFunction(UnsupportedQuery):
    """A function that this engine doesn't know."""


# expressions


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    """A term in its encoding; numeric constants carry their value."""

    term: str
    value: int | float | bool | None = None


@dataclass(frozen=True)
class Op:
    """An operator or function: name in lower case and arguments."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    name: str
    arg: object | None
    distinct: bool = False
    separator: str = " "


# nodes


@dataclass(frozen=True)
class Pattern:
    s: Var | Const
    p: Var | Const
    o: Var | Const

    def variables(self) -> list[str]:
        return list(dict.fromkeys(x.name for x in (self.s, self.p, self.o) if isinstance(x, Var)))


@dataclass(frozen=True)
class BGP:
    patterns: tuple


@dataclass(frozen=True)
class Values:
    """Rows of constants; None is unbound."""

    names: tuple
    rows: tuple


@dataclass(frozen=True)
class NJoin:
    """Joined inputs, in the order the planner chose; each joins on all variables it shares with those before."""

    parts: tuple


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    condition: object | None = None


@dataclass(frozen=True)
class Exists:
    """Semi join, or anti join if negated."""

    left: object
    right: object
    negated: bool


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Filter:
    child: object
    condition: object


@dataclass(frozen=True)
class Extend:
    child: object
    name: str
    expression: object


@dataclass(frozen=True)
class Group:
    """keys are (name, expression or None); aggregates are (name, Agg)."""

    child: object
    keys: tuple
    aggregates: tuple


@dataclass(frozen=True)
class Project:
    child: object
    names: tuple


@dataclass(frozen=True)
class Distinct:
    child: object


@dataclass(frozen=True)
class Order:
    child: object
    keys: tuple = field(default=())


@dataclass(frozen=True)
class Slice:
    child: object
    offset: int
    limit: int | None


@dataclass(frozen=True)
class Construct:
    child: object
    templates: tuple


@dataclass(frozen=True)
class Ask:
    child: object


def pattern_variables(node) -> set[str]:
    """Variables that a node binds; a projection shows its names only, and conditions bind none."""
    if isinstance(node, Pattern):
        return set(node.variables())
    if isinstance(node, BGP):
        return set().union(*(pattern_variables(p) for p in node.patterns)) if node.patterns else set()
    if isinstance(node, (NJoin, Union)):
        return set().union(*(pattern_variables(p) for p in node.parts))
    if isinstance(node, LeftJoin):
        return pattern_variables(node.left) | pattern_variables(node.right)
    if isinstance(node, (Exists, Minus)):
        return pattern_variables(node.left)
    if isinstance(node, Extend):
        return pattern_variables(node.child) | {node.name}
    if isinstance(node, Group):
        return {n for n, _ in node.keys} | {n for n, _ in node.aggregates}
    if isinstance(node, (Project, Values)):
        return set(node.names)
    return pattern_variables(node.child)
