"""Intermediate results by plan: what two queries share is computed once.

Keys are plans with their variables renamed in order of appearance, so ?a p ?b and ?x p ?y share one entry.
"""

from __future__ import annotations

import dataclasses

from pyspark import StorageLevel

from .algebra import BGP, Var


def canonical(node, names: dict[str, str]):
    """The node with its variables renamed; names collects old to new."""
    if isinstance(node, Var):
        return Var(names.setdefault(node.name, f"v{len(names)}"))
    if isinstance(node, tuple):
        return tuple(canonical(x, names) for x in node)
    if dataclasses.is_dataclass(node):
        return type(node)(*(canonical(getattr(node, f.name), names) for f in dataclasses.fields(node)))
    return node


class PlanCache:
    """Persists basic graph patterns of two patterns or more."""

    def __init__(self):
        self.entries: dict = {}
        self.hits = 0

    def get(self, node):
        if not isinstance(node, BGP) or len(node.patterns) < 2:
            return None
        names: dict[str, str] = {}
        found = self.entries.get(canonical(node, names))
        if found is None:
            return None
        self.hits += 1
        back = {new: old for old, new in names.items()}
        frame = found.frame.select(*[found.frame[c].alias(back[c]) for c in found.frame.columns])
        return dataclasses.replace(found, frame=frame, kinds={back[c]: k for c, k in found.kinds.items()})

    def offer(self, node, got):
        if not isinstance(node, BGP) or len(node.patterns) < 2:
            return got
        names: dict[str, str] = {}
        key = canonical(node, names)
        if key not in self.entries:
            frame = got.frame.select(*[got.frame[c].alias(names[c]) for c in got.frame.columns]).persist(StorageLevel.MEMORY_AND_DISK)
            self.entries[key] = dataclasses.replace(got, frame=frame, kinds={names[c]: k for c, k in got.kinds.items()})
            back = {new: old for old, new in names.items()}
            return dataclasses.replace(got, frame=frame.select(*[frame[c].alias(back[c]) for c in frame.columns]))
        return got

    def clear(self) -> None:
        for s in self.entries.values():
            s.frame.unpersist()
        self.entries.clear()
