"""Closed-form meshes as arithmetic over ``spark.range``."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.model import Mesh


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def line(spark: SparkSession, n: int = 144) -> Mesh:
    """n nodes in a row and the edges between them, with float dats on both."""
    mesh = Mesh(spark)
    nodes, edges = mesh.decl_set(n, "nodes"), mesh.decl_set(max(0, n - 1), "edges")
    mesh.decl_map(edges, nodes, 2, lambda i: [i, i + 1], "edge_nodes")
    mesh.decl_dat(edges, 1, "float", lambda i: i * 7.0, "e1")
    mesh.decl_dat(edges, 4, "float", lambda i: [i * 3.0 + 1000.5 * d for d in range(4)], "e4")
    mesh.decl_dat(nodes, 1, "float", lambda i: i * 13, "n1")
    mesh.decl_dat(nodes, 3, "float", lambda i: [i * 13 - 0.125 * d for d in range(3)], "n3")
    return mesh


def jacobi(spark: SparkSession, nn: int = 6, real: str = "double", wide: bool = False) -> Mesh:
    """The five-point grid of (nn-1)^2 unknowns; a self-edge for each node and an edge to each neighbour.

    ``wide`` gives the dats more components, of which kernels use the first.
    """
    mesh, k = Mesh(spark), nn - 1
    nodes = mesh.decl_set(k * k, "nodes")
    steps = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    grid = spark.range(k * k).select(F.col("id").alias("n"), (F.col("id") % k).alias("i"), _div(F.col("id"), k).alias("j"))
    made = None
    for s, (di, dj) in enumerate(steps):  # self-edges first, then one direction after another, each in order of its nodes
        here = grid.where((F.col("i") + di >= 0) & (F.col("i") + di < k) & (F.col("j") + dj >= 0) & (F.col("j") + dj < k))
        rank = {0: F.col("n"), 1: F.col("n") - F.col("j") - 1, 2: F.col("n") - F.col("j"), 3: F.col("n") - k, 4: F.col("n")}[s]
        base = [0, k * k, k * k + k * (k - 1), k * k + 2 * k * (k - 1), k * k + 3 * k * (k - 1)][s]
        one = here.select((rank + base).alias("id"), F.col("n").alias("a"), (F.col("n") + di + dj * k).alias("b"), F.lit(-1.0 if s == 0 else 0.25).alias("w"))
        made = one if made is None else made.unionByName(one)
    edges = mesh.adopt_set(made, "edges")
    mesh.adopt_map(edges, nodes, ["a", "b"], "edge_nodes")
    dims = (3, 2, 2, 3) if wide else (1, 1, 1, 1)
    kinds = ("double", "float", "float", "float") if wide else (real,) * 4
    mesh.frames["edges"] = edges.frame.withColumns({f"A__{d}": (F.col("w") if d == 0 else F.lit(0.0)).cast(kinds[0]) for d in range(dims[0])}).drop("w")
    mesh.adopt_dat(edges, [f"A__{d}" for d in range(dims[0])], kinds[0], "A")
    out = lambda i: sum(((i % k) == e).cast("double") * 0.25 for e in (0, k - 1)) + sum((_div(i, k) == e).cast("double") * 0.25 for e in (0, k - 1))
    mesh.decl_dat(nodes, dims[1], kinds[1], lambda i: [out(i)] + [F.lit(0.0)] * (dims[1] - 1), "r")
    mesh.decl_dat(nodes, dims[2], kinds[2], None, "u")
    mesh.decl_dat(nodes, dims[3], kinds[3], None, "du")
    mesh.decl_const("alpha", 1.0)
    return mesh


def channel(spark: SparkSession, ni: int = 20, nj: int = 10, height: float = 0.1) -> Mesh:
    """A channel of ni x nj quadrilaterals with a bump on its lower wall, as a finite-volume mesh.

    Edges run so that (dy, -dx) of node 0 to node 1 points from their second
    cell to the first. Flags: 1 is a wall, 2 the far field.
    """
    mesh, n1 = Mesh(spark), ni + 1
    nodes = mesh.decl_set(n1 * (nj + 1), "nodes")

    def place(i):
        x = (i % n1) / F.lit(float(ni)) * 3.0 - 1.0
        low = F.when((x > 0) & (x < 1), height * F.sin(x * 3.141592653589793) * F.sin(x * 3.141592653589793)).otherwise(0.0)
        eta = _div(i, n1) / F.lit(float(nj))
        return [x, low + (1.0 - low) * eta]

    mesh.decl_dat(nodes, 2, "double", place, "x")
    return _volumes(mesh, ni, nj, 0, 1)


def _volumes(mesh: Mesh, ni: int, nj: int, cut: int, top: int) -> Mesh:
    """Cells, faces and flags over a grid of nodes.

    The first ``cut`` faces of the lowest row lie on the last ones in turned
    order, so that they join cells; ``top`` is the flag of the highest row.
    """
    nodes, n1 = mesh.sets["nodes"], ni + 1
    cells = mesh.decl_set(ni * nj, "cells")
    corner = lambda c: (c % ni) + _div(c, ni) * n1
    mesh.decl_map(cells, nodes, 4, lambda c: [corner(c), corner(c) + 1, corner(c) + 1 + n1, corner(c) + n1], "cell_nodes")
    up, along = (ni - 1) * nj, ni * (nj - 1)
    edges = mesh.decl_set(up + along + cut, "edges")

    def edge(e):
        i, j = e % max(1, ni - 1) + 1, _div(e, max(1, ni - 1))
        f = e - up
        joined = f >= along
        k, m = F.when(joined, f - along).otherwise(f % ni), F.when(joined, 0).otherwise(_div(f, ni) + 1)
        v = e < up
        a = F.when(v, i + j * n1).otherwise(k + 1 + m * n1)
        b = F.when(v, i + (j + 1) * n1).otherwise(k + m * n1)
        c = F.when(v, i - 1 + j * ni).when(joined, ni - 1 - k).otherwise(k + (m - 1) * ni)
        d = F.when(v, i + j * ni).otherwise(k + m * ni)
        return a, b, c, d

    mesh.decl_map(edges, nodes, 2, lambda e: [edge(e)[1], edge(e)[0]], "edge_nodes")
    mesh.decl_map(edges, cells, 2, lambda e: [edge(e)[2], edge(e)[3]], "edge_cells")
    walls = ni - 2 * cut
    bedges = mesh.decl_set(walls + ni + 2 * nj, "bedges")

    def bedge(e):
        low, high, left = e < walls, (e >= walls) & (e < walls + ni), (e >= walls + ni) & (e < walls + ni + nj)
        i = F.when(low, e + cut).otherwise(e - walls)
        j = F.when(left, e - walls - ni).otherwise(e - walls - ni - nj)
        a = F.when(low, i).when(high, i + 1 + nj * n1).when(left, (j + 1) * n1).otherwise(ni + j * n1)
        b = F.when(low, i + 1).when(high, i + nj * n1).when(left, j * n1).otherwise(ni + (j + 1) * n1)
        c = F.when(low, i).when(high, i + (nj - 1) * ni).when(left, j * ni).otherwise(ni - 1 + j * ni)
        return b, a, c, F.when(low, 1).when(high, top).otherwise(2)

    mesh.decl_map(bedges, nodes, 2, lambda e: list(bedge(e)[:2]), "bedge_nodes")
    mesh.decl_map(bedges, cells, 1, lambda e: bedge(e)[2], "bedge_cell")
    mesh.decl_dat(bedges, 1, "int", lambda e: bedge(e)[3], "bound")
    return mesh


def _spline(x, y, at):
    """The cubic spline through (x, y) whose third derivative doesn't jump at the second and the last but one point."""
    import numpy as np

    h, n = np.diff(x), len(x)
    slope = np.diff(y) / h
    a, b = np.zeros((n, n)), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        b[k] = 6 * (slope[k] - slope[k - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)  # second derivatives
    k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    t, u = at - x[k], x[k + 1] - at
    return (m[k] * u**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t


def _wing(chord: int):
    """The lower end of each column of nodes in the plane of square roots: the wing's outline in the middle third, else the cut."""
    import numpy as np

    #: The outline's scale, its coefficients by sqrt(x), x, x^2, x^3 and x^4, and the point the root is taken about.
    scale, terms, about = 0.594689181, (0.298222773, -0.127125232, -0.357907906, 0.291984971, -0.105174696), 0.0077
    x = np.sin(np.linspace(0, np.pi / 2, 100)) ** 2
    y = scale * sum(c * x**e for c, e in zip(terms, (0.5, 1, 2, 3, 4), strict=True))
    y[-1] = 0.0
    root = np.sqrt(x + 1j * y - about)
    outline = np.concatenate([-root[::-1].conj(), root[1:]])
    columns = np.linspace(-3, 3, 3 * chord + 1)
    low = np.zeros_like(columns)
    low[chord + 1 : 2 * chord] = _spline(outline.real, outline.imag, columns[chord + 1 : 2 * chord])
    return columns, low


def _wing_nodes(spark: SparkSession, chord: int, out: int, skip: int):
    """(id, x, y) of a grid round a wing, without the first ``skip`` nodes; the outline is a table of one row for each of 3 chord + 1 columns."""
    import numpy as np

    n1 = 3 * chord + 1
    columns, low = _wing(chord)
    ends = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(columns, np.asarray(low), strict=True))], "k bigint, a double, b double")
    grid = spark.range(skip, n1 * (out + 1)).select((F.col("id") - skip).alias("id"), (F.col("id") % n1).alias("k"), _div(F.col("id"), n1).alias("j")).join(ends, "k")
    up = F.col("b") + (3.0 - F.col("b")) * (F.col("j") / F.lit(float(out)))
    return grid.select("id", (F.col("a") * F.col("a") - up * up).alias("x"), (2.0 * F.col("a") * up).alias("y"))


def wing(spark: SparkSession, chord: int = 20, out: int = 30) -> Mesh:
    """A grid round a NACA0012 wing as a finite-volume mesh: 3 chord x out cells, ``chord`` walls, and as many faces along the cut behind the wing."""
    mesh = Mesh(spark)
    nodes = mesh.decl_set((3 * chord + 1) * (out + 1), "nodes")
    mesh.decl_dat(nodes, 2, "double", _wing_nodes(spark, chord, out, 0), "x")
    return _volumes(mesh, 3 * chord, out, chord, 2)


def wing_elements(spark: SparkSession, chord: int = 20, out: int = 30) -> Mesh:
    """The same grid as bilinear elements: nodes of the cut are there once, and ``held`` are the nodes of the far field."""
    mesh, ni = Mesh(spark), 3 * chord
    n1, skip = ni + 1, chord + 1
    nodes = mesh.decl_set(n1 * (out + 1) - skip, "nodes")
    mesh.decl_dat(nodes, 2, "double", _wing_nodes(spark, chord, out, skip), "x")
    cells = mesh.decl_set(ni * out, "cells")

    def node(i, j):
        return F.when((j == 0) & (i <= chord), ni - i).otherwise(i + j * n1) - skip

    mesh.decl_map(cells, nodes, 4, lambda c: [node(c % ni + i, _div(c, ni) + j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))], "cell_nodes")
    held = mesh.decl_set(ni + 2 * out, "held")
    # Both ends of each row over the lowest one's first, then the highest row between its ends, then the lowest row's last.
    side, j = lambda h: h % 2, lambda h: _div(h, 2) + 1
    mesh.decl_map(held, nodes, 1, lambda h: F.when(h < 2 * out, node(side(h) * ni, j(h))).when(h < 2 * out + ni - 1, node(h - 2 * out + 1, F.lit(out))).otherwise(node(F.lit(ni), F.lit(0))), "held_nodes")
    return mesh


def text_lines(mesh: Mesh) -> list[str]:
    """The text form of a small finite-volume mesh, for round trips."""
    def rows(name, columns):
        return [" ".join(repr(v) if isinstance(v, float) else str(v) for v in r) for r in mesh.frames[name].orderBy("id").select(*columns).collect()]

    head = " ".join(str(mesh.sets[s].size) for s in ("nodes", "cells", "edges", "bedges"))
    m = mesh.maps
    return [head, *rows("nodes", ["x__0", "x__1"]), *rows("cells", m["cell_nodes"].columns), *rows("edges", m["edge_nodes"].columns + m["edge_cells"].columns), *rows("bedges", m["bedge_nodes"].columns + m["bedge_cell"].columns + ["bound__0"])]
