"""Hierarchical timing of loops on the driver, with a table, CSV and JSON."""

from __future__ import annotations

import csv
import json
import time
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Node:
    name: str
    kind: str = "region"
    n: int = 0
    total: float = 0.0
    least: float = float("inf")
    most: float = 0.0
    squares: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)

    def add(self, seconds: float) -> None:
        self.n += 1
        self.total += seconds
        self.squares += seconds * seconds
        self.least, self.most = min(self.least, seconds), max(self.most, seconds)

    def merge(self, other: Node) -> None:
        """Add another tree of the same name, as of another driver."""
        self.n, self.total, self.squares = self.n + other.n, self.total + other.total, self.squares + other.squares
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        for k, v in other.children.items():
            self.children.setdefault(k, Node(v.name, v.kind)).merge(v)

    def as_dict(self) -> dict:
        clock = {"n": self.n, "total": self.total, "min": self.least if self.n else 0.0, "max": self.most}
        return {"name": self.name, "type": self.kind, "clock": clock, "children": [c.as_dict() for c in self.children.values()]}

    def walk(self, depth: int = 0):
        yield depth, self
        for c in self.children.values():
            yield from c.walk(depth + 1)


class Profiler:
    """Levels: 0 off, 1 kernels, 2 regions too, 3 all."""

    def __init__(self, level: int = 1):
        self.level, self.root = level, Node("root")
        self._open = [self.root]

    @contextmanager
    def _enter(self, name: str, kind: str):
        node = self._open[-1].children.setdefault(name, Node(name, kind))
        self._open.append(node)
        began = time.perf_counter()
        try:
            yield node
        finally:
            node.add(time.perf_counter() - began)
            self._open.pop()

    @contextmanager
    def region(self, name: str):
        if self.level < 2:
            yield None
        else:
            with self._enter(name, "region") as node:
                yield node

    @contextmanager
    def kernel(self, name: str):
        if self.level < 1:
            yield None
        else:
            with self._enter(name, "kernel") as node:
                yield node

    def records(self) -> list[tuple[str, int, float, float, float]]:
        """(kernel, count, total, mean, standard deviation), the longest first."""
        own: dict[str, Node] = {}
        for _, node in self.root.walk():
            if node.kind == "kernel":
                copy = own.setdefault(node.name, Node(node.name, "kernel"))
                copy.merge(Node(node.name, "kernel", node.n, node.total, node.least, node.most, node.squares))
        rows = []
        for x in own.values():
            mean = x.total / x.n if x.n else 0.0
            rows.append((x.name, x.n, x.total, mean, max(0.0, x.squares / max(1, x.n) - mean * mean) ** 0.5))
        return sorted(rows, key=lambda r: -r[2])

    def frame(self, spark):
        return spark.createDataFrame(self.records() or [], "kernel string, n bigint, total_s double, mean_s double, std_s double")

    def table(self, most: int = 20) -> str:
        return "\n".join(["count  total s  mean s  kernel", *(f"{n:5d}  {t:7.3f}  {m:6.3f}  {k}" for k, n, t, m, _ in self.records()[:most])])

    def write_csv(self, path: str) -> None:
        with open(path, "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["rank", "thread", "nranks", "nthreads", "count", "total time", "plan time", "mpi time", "GB used", "GB total", "kernel name"])
            out.writerows([0, 0, 1, 1, n, t, 0.0, 0.0, 0.0, 0.0, k] for k, n, t, _, _ in self.records())

    def write_json(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.root.as_dict(), f, indent=1)
