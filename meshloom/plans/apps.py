"""Small workloads over meshes: Jacobi, finite volumes, finite elements, reductions, minima.

Loops stay lazy within a time step; the lineage is cut by a checkpoint in the
shared folder at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.kernels import Gas, Potential, element_product, stiffness
from meshloom.operators.args import INC, MAX, MIN, READ, RW, WRITE, arg_dat, arg_gbl, arg_idx, arg_info
from meshloom.operators.model import Mesh
from meshloom.sources import generate


def jacobi(mesh: Mesh, iterations: int = 2, every: int = 1) -> list[tuple[float, float]]:
    """Iterate a generated grid; returns (sum of squares, largest u) of each round."""
    edges, nodes = mesh.sets["edges"], mesh.sets["nodes"]
    m = mesh.maps["edge_nodes"]
    a, r, u, du = mesh.dats["edges", "A"], *(mesh.dats["nodes", n] for n in ("r", "u", "du"))
    first = lambda v: v[0] if isinstance(v, list) else v
    wide = lambda v, old: [v, *old[1:]] if isinstance(old, list) else v
    pad = lambda v, d: v if d == 1 else [v, *[F.lit(0.0)] * (d - 1)]
    alpha, out = mesh.consts["alpha"], []
    for k in range(iterations):
        mesh.par_loop(lambda aa, uu, beta: {2: pad(beta * first(aa) * first(uu), du.dim)}, "res", edges, arg_dat(a), arg_dat(u, 1, m), arg_dat(du, 0, m, INC), arg_gbl(1.0))
        done = mesh.par_loop(
            lambda rr, dd, uu: {1: wide(F.lit(0.0), dd), 2: wide(first(uu) + first(dd) + alpha.col * first(rr), uu), 3: (first(dd) + alpha.col * first(rr)) ** 2, 4: first(uu) + first(dd) + alpha.col * first(rr)},
            "update", nodes, arg_dat(r), arg_dat(du, access=RW), arg_dat(u, access=RW), arg_gbl(0.0, INC), arg_gbl(0.0, MAX),
            checkpoint=(k + 1) % every == 0,
        )
        if (k + 1) % every == 0:
            mesh.checkpoint(nodes)
        v = done.values()
        out.append((v[3][0], v[4][0]))
    return out


WORK_DATS = (("qold", 4), ("res", 4), ("adt", 1))


def start_flow(mesh: Mesh, gas: Gas, temporary: bool = False) -> None:
    """The free stream everywhere; with ``temporary``, each time step declares what it works with and frees it."""
    cells = mesh.sets["cells"]
    mesh.decl_dat(cells, 4, "double", lambda i: [F.lit(v) for v in gas.far], "q")
    for name, dim in () if temporary else WORK_DATS:
        mesh.decl_dat(cells, dim, "double", None, name)


def flow(mesh: Mesh, gas: Gas, iterations: int = 1, temporary: bool = False) -> list[float]:
    """The rms of every time step of ``flow_history``."""
    return [rms for rms, _, _ in flow_history(mesh, gas, iterations, temporary)]


def flow_history(mesh: Mesh, gas: Gas, iterations: int = 1, temporary: bool = False) -> list[tuple[float, float, int]]:
    """Time steps of two stages each over a finite-volume mesh; of every step the rms, the largest squared change and its cell.

    Ties of the largest change go to the smallest cell; where nothing changes, to cell 0.
    """
    cells, edges, bedges = (mesh.sets[s] for s in ("cells", "edges", "bedges"))
    cn, en, ec, bn, bc = (mesh.maps[m] for m in ("cell_nodes", "edge_nodes", "edge_cells", "bedge_nodes", "bedge_cell"))
    x, bound, q = mesh.dats["nodes", "x"], mesh.dats["bedges", "bound"], mesh.dats["cells", "q"]
    n, out = cells.size, []

    def faces(a, b, q1, q2, t1, t2):
        left, right = gas.face(a, b, q1, q2, t1, t2)
        return {6: left, 7: right}

    def update(old, now, rr, tt, index):
        step = [r / tt for r in rr]
        squares = [s * s for s in step]
        return {1: [o - s for o, s in zip(old, step, strict=True)], 2: [F.lit(0.0)] * 4, 4: sum(squares[1:], squares[0]), 5: F.greatest(*squares), 7: index}

    for _ in range(iterations):
        if temporary:
            for name, dim in WORK_DATS:
                mesh.decl_dat_temp(cells, dim, "double", None, name)
        qold, res, adt = (mesh.dats["cells", name] for name, _ in WORK_DATS)
        mesh.par_loop(gas.save, "save", cells, arg_dat(q), arg_dat(qold, access=WRITE))
        for _ in range(2):
            mesh.par_loop(lambda corners, state: {2: gas.time_step(corners, state)}, "time_step", cells, arg_dat(x, -4, cn), arg_dat(q), arg_dat(adt, access=WRITE))
            mesh.checkpoint(cells)
            mesh.par_loop(faces, "faces", edges, arg_dat(x, 0, en), arg_dat(x, 1, en), arg_dat(q, 0, ec), arg_dat(q, 1, ec), arg_dat(adt, 0, ec), arg_dat(adt, 1, ec), arg_dat(res, 0, ec, INC), arg_dat(res, 1, ec, INC))
            mesh.par_loop(lambda a, b, s, t, f: {5: gas.boundary(a, b, s, t, f)}, "boundary", bedges, arg_dat(x, 0, bn), arg_dat(x, 1, bn), arg_dat(q, 0, bc), arg_dat(adt, 0, bc), arg_dat(bound), arg_dat(res, 0, bc, INC))
            done = mesh.par_loop(
                update, "update", cells, arg_dat(qold), arg_dat(q, access=RW), arg_dat(res, access=RW), arg_dat(adt), arg_gbl(0.0, INC), arg_gbl(0.0, MAX), arg_idx(), arg_info(0, 5), checkpoint=True
            )
        v = done.values()
        out.append(((v[4][0] / n) ** 0.5, v[5][0], v[7][0]))
        if temporary:
            for name, _ in WORK_DATS:
                mesh.free_dat_temp(mesh.dats["cells", name])
    return out


def poisson(spark: SparkSession, ni: int = 8, nj: int = 6, most: int = 200, least: float = 1e-8) -> tuple[Mesh, int]:
    """Conjugate gradients for Laplace's equation with u = x on the boundary of a channel; returns the mesh and the rounds."""
    mesh = generate.channel(spark, ni, nj)
    nodes, cells, bedges = mesh.sets["nodes"], mesh.sets["cells"], mesh.sets["bedges"]
    cn, bn, x = mesh.maps["cell_nodes"], mesh.maps["bedge_nodes"], mesh.dats["nodes", "x"]
    k = mesh.decl_dat(cells, 16, "double", None, "K")
    u, v, p, r, fixed = (mesh.decl_dat(nodes, 1, "double", None, n) for n in ("u", "v", "p", "r", "fixed"))
    mesh.par_loop(lambda c: {1: stiffness(c)}, "assemble", cells, arg_dat(x, -4, cn), arg_dat(k, access=WRITE))
    mesh.par_loop(lambda: {0: [F.lit(1.0), F.lit(1.0)]}, "dirichlet", bedges, arg_dat(fixed, -2, bn, WRITE))
    mesh.par_loop(lambda xx, f: {2: F.when(f > 0, xx[0]).otherwise(0.0)}, "boundary_values", nodes, arg_dat(x), arg_dat(fixed), arg_dat(u, access=WRITE))
    mesh.checkpoint(cells, nodes)

    def product(of) -> None:
        mesh.par_loop(lambda: {0: F.lit(0.0)}, "clear", nodes, arg_dat(v, access=WRITE))
        mesh.par_loop(lambda kk, pp: {2: element_product(kk, pp)}, "product", cells, arg_dat(k), arg_dat(of, -4, cn), arg_dat(v, -4, cn, INC))
        mesh.checkpoint(nodes)

    product(u)
    done = mesh.par_loop(lambda vv, f: {2: F.when(f > 0, 0.0).otherwise(-vv), 3: F.when(f > 0, 0.0).otherwise(-vv), 4: F.when(f > 0, 0.0).otherwise(vv * vv)}, "start", nodes, arg_dat(v), arg_dat(fixed), arg_dat(r, access=WRITE), arg_dat(p, access=WRITE), arg_gbl(0.0, INC))
    start = now = done.values()[4][0]
    rounds = 0
    while rounds < most and now > least * least * max(start, 1e-300):
        product(p)
        pv = mesh.par_loop(lambda a, b: {2: a * b}, "dot", nodes, arg_dat(p), arg_dat(v), arg_gbl(0.0, INC)).values()[2][0]
        alpha = now / pv
        done = mesh.par_loop(
            lambda pp, vv, f, uu, rr, a: {3: uu + a * pp, 4: F.when(f > 0, 0.0).otherwise(rr - a * vv), 6: F.when(f > 0, 0.0).otherwise((rr - a * vv) * (rr - a * vv))},
            "update_ur", nodes, arg_dat(p), arg_dat(v), arg_dat(fixed), arg_dat(u, access=RW), arg_dat(r, access=RW), arg_gbl(alpha), arg_gbl(0.0, INC),
        )
        new = done.values()[6][0]
        mesh.par_loop(lambda rr, pp, b: {1: rr + b * pp}, "update_p", nodes, arg_dat(r), arg_dat(p, access=RW), arg_gbl(new / now))
        mesh.checkpoint(nodes)
        now, rounds = new, rounds + 1
    return mesh, rounds


def potential_flow(mesh: Mesh, gas: Potential, rounds: int = 20, most: int = 200, share: float = 0.1) -> list[tuple[int, float]]:
    """Newton's rounds for potential flow on bilinear elements; of each the steps of conjugate gradients within it and the rms of its correction.

    ``mesh`` has nodes with x, cells, and ``held`` with a map to nodes whose
    value stays. The inner steps end at ``share`` of the residual they began
    with, or after ``most``, as a rule of the method. Geometry is made once.
    """
    nodes, cells, held = (mesh.sets[s] for s in ("nodes", "cells", "held"))
    cn, hn, x = mesh.maps["cell_nodes"], mesh.maps["held_nodes"], mesh.dats["nodes", "x"]
    phi = mesh.decl_dat(nodes, 1, "double", lambda i: F.col(x.columns[0]) * gas.mach, "phi")
    res, u, v, p = (mesh.decl_dat(nodes, 1, "double", None, name) for name in ("res", "u", "v", "p"))
    by, weight, speed, rho, drop, k = (mesh.decl_dat(cells, dim, "double", None, name) for name, dim in (("by", 32), ("weight", 4), ("speed", 8), ("rho", 4), ("drop", 4), ("K", 16)))

    def geometry(corners):
        d, w = gas.geometry(corners)
        return {1: d, 2: w}

    def density(s):
        r, d = gas.density(s)
        return {1: r, 2: d}

    def element(b, w, s, r, d):
        matrix, flux = gas.element(b, w, s, r, d)
        return {5: matrix, 6: flux}

    def hold(dat) -> None:
        mesh.par_loop(lambda: {0: F.lit(0.0)}, "hold", held, arg_dat(dat, 0, hn, WRITE))

    mesh.par_loop(geometry, "geometry", cells, arg_dat(x, -4, cn), arg_dat(by, access=WRITE), arg_dat(weight, access=WRITE))
    mesh.checkpoint(cells, nodes)
    n, out = nodes.size, []
    for _ in range(rounds):
        mesh.par_loop(lambda b, f: {2: gas.velocity(b, f)}, "velocity", cells, arg_dat(by), arg_dat(phi, -4, cn), arg_dat(speed, access=WRITE))
        mesh.par_loop(density, "density", cells, arg_dat(speed), arg_dat(rho, access=WRITE), arg_dat(drop, access=WRITE))
        mesh.checkpoint(cells)
        mesh.par_loop(element, "assemble", cells, arg_dat(by), arg_dat(weight), arg_dat(speed), arg_dat(rho), arg_dat(drop), arg_dat(k, access=WRITE), arg_dat(res, -4, cn, INC))
        hold(res)
        mesh.checkpoint(cells, nodes)
        begun = mesh.par_loop(lambda r: {1: F.lit(0.0), 2: F.lit(0.0), 3: r, 4: r * r}, "start", nodes, arg_dat(res), arg_dat(u, access=WRITE), arg_dat(v, access=WRITE), arg_dat(p, access=WRITE), arg_gbl(0.0, INC))
        first = now = begun.values()[4][0]
        steps = 0
        while steps < most and now > share * share * first:
            mesh.par_loop(lambda kk, pp: {2: element_product(kk, pp)}, "product", cells, arg_dat(k), arg_dat(p, -4, cn), arg_dat(v, -4, cn, INC))
            hold(v)
            mesh.checkpoint(nodes)
            pv = mesh.par_loop(lambda a, b: {2: a * b}, "dot", nodes, arg_dat(p), arg_dat(v), arg_gbl(0.0, INC)).values()[2][0]
            done = mesh.par_loop(
                lambda pp, vv, rr, a: {1: F.lit(0.0), 2: a * pp, 3: rr - a * vv, 5: (rr - a * vv) * (rr - a * vv)},
                "update_ur", nodes, arg_dat(p), arg_dat(v, access=RW), arg_dat(u, access=INC), arg_dat(res, access=RW), arg_gbl(now / pv), arg_gbl(0.0, INC),
            )
            new = done.values()[5][0]
            mesh.par_loop(lambda rr, pp, b: {1: rr + b * pp}, "update_p", nodes, arg_dat(res), arg_dat(p, access=RW), arg_gbl(new / now))
            now, steps = new, steps + 1
        moved = mesh.par_loop(lambda f, uu: {0: f - uu, 1: F.lit(0.0), 3: uu * uu}, "correct", nodes, arg_dat(phi, access=RW), arg_dat(res, access=WRITE), arg_dat(u), arg_gbl(0.0, INC))
        out.append((steps, (moved.values()[3][0] / n) ** 0.5))
        mesh.checkpoint(nodes)
    return out


def counts(mesh: Mesh) -> dict[str, list]:
    """Edges counted in an indirect loop, cells in a direct one."""
    a = mesh.par_loop(lambda x: {1: F.lit(1)}, "count_edges", mesh.sets["edges"], arg_dat(mesh.dats["nodes", "x"], 0, mesh.maps["edge_nodes"]), arg_gbl(0, INC, "int")).values()
    b = mesh.par_loop(lambda: {0: F.lit(1)}, "count_cells", mesh.sets["cells"], arg_gbl(0, INC, "int")).values()
    return {"edges": a[1], "cells": b[0]}


def minima(spark: SparkSession) -> tuple[int, int]:
    """The least of (i - 10)^2 + 5, over all elements and over the even ones through a map."""
    mesh = Mesh(spark)
    s1, s2 = mesh.decl_set(20, "s1"), mesh.decl_set(10, "s2")
    d = mesh.decl_dat(s1, 1, "int", lambda i: (i - 10) * (i - 10) + 5, "d")
    m = mesh.decl_map(s2, s1, 1, lambda i: 2 * i, "m")
    direct = mesh.par_loop(lambda v: {1: v}, "min", s1, arg_dat(d), arg_gbl(1000, MIN, "int")).values()[1][0]
    through = mesh.par_loop(lambda v: {1: v}, "min", s2, arg_dat(d, 0, m, READ), arg_gbl(1000, MIN, "int")).values()[1][0]
    return direct, through


def flow_state(spark: SparkSession, ni: int = 20, nj: int = 10, iterations: int = 1) -> DataFrame:
    """The states after some time steps over a generated channel."""
    mesh, gas = generate.channel(spark, ni, nj), Gas()
    start_flow(mesh, gas)
    flow(mesh, gas, iterations)
    return mesh.fetch(mesh.dats["cells", "q"])
