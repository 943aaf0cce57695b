"""Workflows: a graph of operators that is composed into lazy DataFrames, so that Catalyst sees one plan for each output.

An operator is any callable from PatchSets (or DataFrames) to one of them. Nothing runs while a workflow is executed, unless
eager nodes are asked for; a result that several nodes use can be cached.
"""

from __future__ import annotations

import traceback
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from geoloom.patchset import PatchSet


class CyclicDependencyError(ValueError):
    """A graph has a cycle."""


class Graph:
    """A directed graph with possibly several edges between two vertices."""

    def __init__(self, edges: Iterable[tuple[Any, Any]] = (), vertices: Iterable[Any] = ()):
        self.after: dict[Any, list[Any]] = {v: [] for v in vertices}
        for a, b in edges:
            self.add_edge(a, b)

    def add_vertex(self, v: Any) -> None:
        self.after.setdefault(v, [])

    def add_edge(self, a: Any, b: Any) -> None:
        self.add_vertex(b)
        self.after.setdefault(a, []).append(b)

    def del_edge(self, a: Any, b: Any) -> None:
        if b not in self.after.get(a, []):
            raise ValueError(f"no edge {(a, b)}")
        self.after[a].remove(b)

    def del_vertex(self, v: Any) -> None:
        if v not in self.after:
            raise ValueError(f"no vertex {v}")
        del self.after[v]
        self.after = {a: [b for b in bs if b != v] for a, bs in self.after.items()}

    def indegrees(self) -> Counter:
        out = Counter({v: 0 for v in self.after})
        out.update(b for bs in self.after.values() for b in bs)
        return out

    def outdegree(self, v: Any) -> int:
        return len(self.after[v])

    def ordered(self) -> list[Any]:
        """Every vertex after all that lead to it."""
        left = self.indegrees()
        ready, out = [v for v in self.after if not left[v]], []
        while ready:
            v = ready.pop()
            out.append(v)
            for b in self.after[v]:
                left[b] -= 1
                if not left[b]:
                    ready.append(b)
        if len(out) < len(self.after):
            raise CyclicDependencyError("the graph has a cycle")
        return out


@dataclass(eq=False)
class Node:
    """An operator in a workflow, with the nodes whose results it takes."""

    operator: Callable
    inputs: Sequence[Node] = ()
    name: str | None = None

    def __post_init__(self):
        if not callable(self.operator) or not all(isinstance(n, Node) for n in self.inputs):
            raise ValueError("a node takes an operator and nodes")
        self.name = self.name or getattr(self.operator, "__name__", type(self.operator).__name__)

    def ancestors(self) -> list[Node]:
        seen: dict[int, Node] = {}
        todo = [self]
        while todo:
            n = todo.pop()
            if id(n) not in seen:
                seen[id(n)] = n
                todo += n.inputs
        return list(seen.values())


def chain(*operators: Callable | tuple[Callable, str]) -> list[Node]:
    """Nodes that feed each other in turn."""
    nodes: list[Node] = []
    for op in operators:
        op, name = op if isinstance(op, tuple) else (op, None)
        nodes.append(Node(op, nodes[-1:], name))
    return nodes


class Input:
    """An operator without inputs: its value is given when the workflow runs, or by default."""

    def __init__(self, default: Any = None):
        self.default = default

    def __call__(self, value: Any = None) -> Any:
        return self.default if value is None else value


class Output:
    """An operator that names its input as an output of the workflow."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, value: Any) -> Any:
        return value


@dataclass
class Stats:
    name: str
    start: datetime
    end: datetime
    error: str | None = None
    origin: str | None = None


@dataclass
class Results:
    outputs: dict[str, Any] = field(default_factory=dict)
    stats: dict[str, Stats] = field(default_factory=dict)
    start: datetime | None = None
    end: datetime | None = None
    failed_node: str | None = None

    @property
    def failed(self) -> bool:
        return self.failed_node is not None

    def without_outputs(self) -> Results:
        return Results({}, self.stats, self.start, self.end, self.failed_node)


class Workflow:
    def __init__(self, nodes: Sequence[Node]):
        if len({id(n) for n in nodes}) < len(nodes):
            raise ValueError("a node appears twice")
        have = {id(n) for n in nodes}
        if any(id(i) not in have for n in nodes for i in n.inputs):
            raise ValueError("a node's input isn't in the workflow")
        names = [n.operator.name for n in nodes if isinstance(n.operator, Output)]
        if len(set(names)) < len(names):
            raise ValueError("two outputs have one name")
        counts: Counter = Counter()
        self.names: dict[Node, str] = {}
        for n in nodes:
            counts[n.name] += 1
            self.names[n] = n.name if counts[n.name] == 1 else f"{n.name}_{counts[n.name]}"
        self.graph = Graph([(i, n) for n in nodes for i in n.inputs], nodes)
        self.nodes: list[Node] = self.graph.ordered()

    @classmethod
    def from_ends(cls, *ends: Node) -> Workflow:
        found: dict[int, Node] = {}
        for e in ends:
            found |= {id(n): n for n in e.ancestors()}
        return cls(list(found.values()))

    def execute(self, arguments: dict[Node, dict | tuple] | None = None, raise_errors: bool = True, eager: bool = False, cache_shared: bool = False) -> Results:
        """Outputs by name. arguments: for a node, keyword or further positional arguments of its operator.

        A failed node stops the run. eager: each node's frames are counted, so that times and errors belong to nodes.
        """
        arguments = dict(arguments or {})
        if unknown := [a for a in arguments if a not in self.names]:
            raise ValueError(f"not nodes of this workflow: {unknown}")
        out, done = Results(start=datetime.now()), {}
        left = {n: self.graph.outdegree(n) for n in self.nodes}
        for n in self.nodes:
            more = arguments.get(n, {})
            positional, named = (more, {}) if isinstance(more, tuple) else ((), more)
            start, error = datetime.now(), None
            try:
                value = n.operator(*(done[i] for i in n.inputs), *positional, **named)
                if cache_shared and left[n] > 1:
                    for df in tables_of(value):
                        df.persist()
                if eager:
                    for df in tables_of(value):
                        df.count()
            except Exception as e:
                error = e
            trace = "".join(traceback.format_exception(error)) if error else None
            origin = f"{type(error).__name__}" if error else None
            out.stats[self.names[n]] = Stats(self.names[n], start, datetime.now(), trace, origin)
            if error:
                out.failed_node = self.names[n]
                if raise_errors:
                    raise error
                break
            done[n] = value
            if isinstance(n.operator, Output):
                out.outputs[n.operator.name] = value
            for i in n.inputs:
                left[i] -= 1
                if not left[i]:
                    done.pop(i, None)
        out.end = datetime.now()
        return out

    def dot(self) -> str:
        """The graph in the DOT language."""
        lines = [f'  "{self.names[n]}"' + (' [shape=box, style=filled]' if isinstance(n.operator, (Input, Output)) else "") + ";" for n in self.nodes]
        lines += [f'  "{self.names[i]}" -> "{self.names[n]}";' for n in self.nodes for i in n.inputs]
        return "digraph workflow {\n" + "\n".join(lines) + "\n}\n"


def tables_of(value: Any) -> list[DataFrame]:
    if isinstance(value, DataFrame):
        return [value]
    return list(value.features.values()) if isinstance(value, PatchSet) else []


