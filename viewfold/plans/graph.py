"""Pipelines as graphs of lazy nodes, built in code or from YAML.

A node is a function from DataFrames to a DataFrame. ``a >> b`` feeds a's output to b's next free
input, ``a >> b[1]`` to its second. Nothing runs until an action or a stream is started; names in
YAML are looked up, never evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame


class Node:
    """``f`` gets the inputs in order. ``needs`` are columns that the first input must have;
    ``tags`` are what the node adds, ``requires`` tags that a node before it must add."""

    def __init__(self, f: Callable[..., DataFrame], name: str | None = None, needs: Iterable[str] = (), tags: Iterable[str] = (), requires: Iterable[str] = ()):
        self.f, self.name = f, name or getattr(f, "__name__", "node")
        self.needs, self.tags, self.requires = tuple(needs), frozenset(tags), frozenset(requires)
        self.inputs: dict[int, Node] = {}

    def __getitem__(self, k: int) -> _Port:
        return _Port(self, k)

    def connect_to(self, source: Node, k: int | None = None) -> Node:
        k = len(self.inputs) if k is None else k
        if k in self.inputs:
            raise ValueError(f"input {k} of {self.name} is taken")
        self.inputs[k] = source
        return self

    def __rshift__(self, other):
        if other is None:
            return self
        port = other if isinstance(other, _Port) else _Port(other, None)
        port.node.connect_to(self, port.k)
        return port.node

    def ancestors(self) -> list[Node]:
        """All nodes before this one, sources first."""
        seen: list[Node] = []

        def walk(n: Node, path: tuple[Node, ...]) -> None:
            if n in path:
                raise ValueError(f"{n.name} feeds itself")
            for k in sorted(n.inputs):
                walk(n.inputs[k], (*path, n))
            if n not in seen:
                seen.append(n)

        walk(self, ())
        return seen[:-1]


class _Port:
    def __init__(self, node: Node, k: int | None):
        self.node, self.k = node, k


def analyzer(f: Callable[[DataFrame], DataFrame], **how) -> Node:
    return Node(f, **how)


def chain(df: DataFrame, *analyzers) -> DataFrame:
    """Analyzers (functions, or objects with ``apply``) one after another; None is skipped."""
    return reduce(lambda d, a: d.transform(a.apply if hasattr(a, "apply") else a), (a for a in analyzers if a is not None), df)


def predict_stream(source: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, analyzers: Iterable = ()) -> DataFrame:
    """Frames through a model, if any, and analyzers; streaming if the source is."""
    return chain(source, model, *analyzers)


@dataclass(frozen=True)
class EvaluatorConfig:
    """Settings of an evaluation, from code or YAML."""

    kind: str = "bbox"
    max_images: int = 0
    classes: dict[str, int] | None = None
    top_k: tuple[int, ...] = (1, 5)
    sigmas: tuple[float, ...] | None = None
    pred_path: str | None = None

    def __post_init__(self):
        if self.kind not in ("bbox", "keypoints", "segm", "classification", "regression"):
            raise ValueError(f"no evaluation of {self.kind}")
        if self.max_images < 0 or any(k < 1 for k in self.top_k):
            raise ValueError("limits must not be negative")

    @classmethod
    def load(cls, text: str | dict, **overrides) -> EvaluatorConfig:
        if isinstance(text, str):
            import yaml

            text = yaml.safe_load(text)
        values = {**(text or {}), **overrides}
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


class Pipeline:
    """The nodes connected to those given. Building checks that inputs are complete, and that
    every required tag and column comes from some node before."""

    def __init__(self, *nodes: Node):
        self.sinks = [n.node if isinstance(n, _Port) else n for n in nodes]
        self.queries: list = []

    def build(self) -> dict[str, DataFrame]:
        made: dict[Node, DataFrame] = {}
        for sink in self.sinks:
            for n in (*sink.ancestors(), sink):
                if n in made:
                    continue
                if sorted(n.inputs) != list(range(len(n.inputs))):
                    raise ValueError(f"{n.name} has gaps between its inputs")
                got = frozenset().union(*(a.tags for a in n.ancestors()))
                if n.requires - got:
                    raise ValueError(f"{n.name} needs {sorted(n.requires - got)} from a node before it")
                args = [made[n.inputs[k]] for k in sorted(n.inputs)]
                if n.needs and set(n.needs) - set(args[0].columns):
                    raise ValueError(f"{n.name} needs columns {sorted(set(n.needs) - set(args[0].columns))}")
                made[n] = n.f(*args)
        return {s.name: made[s] for s in self.sinks}

    def run(self) -> DataFrame:
        """The output of the only sink."""
        (df,) = self.build().values()
        return df

    def start(self, checkpoint: str, mode: str = "append", **trigger):
        """A streaming query per streaming sink, written to memory under the sink's name."""
        for name, df in self.build().items():
            writer = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}")
            self.queries.append((writer.trigger(**trigger) if trigger else writer).start())
        return self

    def wait(self) -> None:
        """Waits for all; errors of several queries are raised together."""
        errors = []
        for q in self.queries:
            try:
                q.awaitTermination()
            except Exception as e:  # gathered, and raised below
                errors.append(f"{q.name}: {e}")
        if errors:
            self.stop()
            raise RuntimeError("; ".join(errors))

    def stop(self) -> None:
        for q in self.queries:
            if q.isActive:
                q.stop()

    def progress(self) -> dict[str, dict | None]:
        """Rows and rates of each query's last batch."""
        return {q.name: q.lastProgress for q in self.queries}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stop()


def load_pipeline(text: str | dict, factories: dict[str, Callable[..., Node]], variables: dict | None = None) -> Pipeline:
    """A pipeline from YAML: ``vars``, ``nodes`` {name: {kind: {arguments}}} and ``connections``,
    lists of names along a path, with [k] for an input. ``$(name)`` stands for a variable."""
    if isinstance(text, str):
        import yaml

        text = yaml.safe_load(text)
    if not isinstance(text, dict) or not text.get("nodes") or set(text) - {"vars", "nodes", "connections"}:
        raise ValueError("vars, nodes and connections are the parts of a pipeline")
    known = {**(text.get("vars") or {}), **(variables or {})}

    def resolve(v):
        if isinstance(v, dict):
            return {k: resolve(x) for k, x in v.items()}
        if isinstance(v, list):
            return [resolve(x) for x in v]
        if isinstance(v, str) and (m := re.fullmatch(r"\$\((\w+)\)", v)):
            if m[1] not in known:
                raise ValueError(f"no variable {m[1]}")
            return known[m[1]]
        return v

    nodes: dict[str, Node] = {}
    for name, spec in text["nodes"].items():
        (kind, args), *rest = spec.items() if isinstance(spec, dict) else [(spec, None)]
        if rest or kind not in factories:
            raise ValueError(f"{name}: no kind of node {kind}")
        nodes[name] = factories[kind](**(resolve(args) or {}))
        nodes[name].name = name
    used = set()
    for path in text.get("connections") or []:
        for a, b in zip(path, path[1:]):
            m = re.fullmatch(r"(\w+)(?:\[(\d+)\])?", b)
            if a.split("[")[0] not in nodes or not m or m[1] not in nodes:
                raise ValueError(f"unknown connection {a} to {b}")
            source = a.split("[")[0]
            nodes[m[1]].connect_to(nodes[source], int(m[2]) if m[2] else None)
            used.add(source)
    return Pipeline(*(n for name, n in nodes.items() if name not in used))
