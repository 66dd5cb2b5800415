"""Loops over small closed-form meshes against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions.kernels import Gas, Potential
from meshloom.operators import graph
from meshloom.operators.args import INC, MAX, MIN, RW, WORK, WRITE, arg_dat, arg_gbl, arg_idx, arg_info, opt_arg_dat
from meshloom.operators.model import Mesh, MeshError, spark_type
from meshloom.operators.planner import conflicts
from meshloom.plans import apps
from meshloom.sources import generate, mesh_io


def values(mesh, dat):
    return [tuple(r[1:]) for r in mesh.fetch(dat).collect()]


def test_constants(spark):
    mesh = Mesh(spark)
    s = mesh.decl_set(32, "s")
    one, four = mesh.decl_const("one", 20.1), mesh.decl_const("four", 30.1, 40.2, 50.3, 60.4)
    d1, d4 = mesh.decl_dat(s, 1, "double", None, "d1"), mesh.decl_dat(s, 4, "double", None, "d4")
    mesh.par_loop(lambda: {0: one.col, 1: [four[k] for k in range(4)]}, "consts", s, arg_dat(d1, access=WRITE), arg_dat(d4, access=WRITE))
    assert values(mesh, d1) == [(20.1,)] * 32
    assert values(mesh, d4) == [(30.1, 40.2, 50.3, 60.4)] * 32
    with pytest.raises(MeshError):
        mesh.decl_const("one", 1.0)


def test_globals(spark):
    mesh = Mesh(spark)
    s = mesh.decl_set(161, "s")
    d1, d5 = mesh.decl_dat(s, 1, "double", lambda i: i, "d1"), mesh.decl_dat(s, 5, "double", lambda i: [i * 5 + d for d in range(5)], "d5")
    out = mesh.par_loop(
        lambda a, b: {2: a, 3: b, 4: b, 5: b}, "all", s, arg_dat(d1), arg_dat(d5),
        arg_gbl(0.0, INC), arg_gbl([0.0, 1.0, 2.0, 3.0, 4.0], INC), arg_gbl([1e9, 1e9, 0.4, 1e9, 1e9], MIN), arg_gbl([0.0, 0.0, 1000000000.4, 0.0, 0.0], MAX),
    ).values()
    assert out[2] == [12880.0]
    assert out[3] == [5 * 12880.0 + d * 161 + d for d in range(5)]
    assert out[4] == [0.0, 1.0, 0.4, 3.0, 4.0]
    assert out[5] == [800.0, 801.0, 1000000000.4, 803.0, 804.0]


def test_indirect_and_direct_increments(spark):
    mesh = generate.line(spark, 144)
    edges, nodes, m = mesh.sets["edges"], mesh.sets["nodes"], mesh.maps["edge_nodes"]
    n1, n3, e1, e4 = mesh.dats["nodes", "n1"], mesh.dats["nodes", "n3"], mesh.dats["edges", "e1"], mesh.dats["edges", "e4"]
    mesh.par_loop(lambda e: {1: e, 2: e * 2, 3: [e, e + 1, e + 2]}, "inc", edges, arg_dat(e1), arg_dat(n1, 0, m, INC), arg_dat(n1, 1, m, INC), arg_dat(n3, 1, m, INC))
    want1 = [13.0 * i + (7.0 * i if i < 143 else 0) + (14.0 * (i - 1) if i else 0) for i in range(144)]
    np.testing.assert_allclose([v for (v,) in values(mesh, n1)], want1, rtol=1e-6)
    np.testing.assert_allclose(values(mesh, n3), [[13 * i - 0.125 * d + ((7.0 * (i - 1) + d) if i else 0) for d in range(3)] for i in range(144)], rtol=1e-6)
    mesh.par_loop(lambda x: {1: [v + 1.325 * d for d, v in enumerate(x)]}, "direct", edges, arg_dat(mesh.decl_dat(edges, 4, "float", lambda i: [F.col(c) for c in e4.columns], "copy")), arg_dat(e4, access=INC))
    np.testing.assert_allclose(values(mesh, e4), [[2 * (3.0 * i + 1000.5 * d) + 1.325 * d for d in range(4)] for i in range(143)], rtol=1e-6)
    assert mesh.is_onto(m) and mesh.check_map(m).first()["n_bad"] == 0 and nodes.size == 144


def test_indices_vector_arguments_and_strides(spark):
    mesh = Mesh(spark)
    edges, nodes = mesh.decl_set(48, "edges"), mesh.decl_set(64, "nodes")
    p = mesh.decl_map(edges, nodes, 3, lambda e: [(7 * e + 11 * d) % 64 for d in range(3)], "p")
    x = mesh.decl_dat(nodes, 2, "double", lambda i: [i, i * 10], "x")
    out, total = mesh.decl_dat(edges, 4, "double", None, "out"), mesh.decl_dat(nodes, 1, "ll", None, "total")
    mesh.par_loop(lambda i, a, v: {3: [i, a, v[0][1] + v[2][0], v[1][0]], 4: [i, i * 2, i * 3]}, "mixed", edges, arg_idx(), arg_idx(1, p), arg_dat(x, -3, p), arg_dat(out, access=WRITE), arg_dat(total, -3, p, INC))
    to = lambda e, d: (7 * e + 11 * d) % 64
    assert values(mesh, out) == [(e, to(e, 1), 10 * to(e, 0) + to(e, 2), to(e, 1)) for e in range(48)]
    want = [0] * 64
    for e in range(48):
        for d in range(3):
            want[to(e, d)] += e * (d + 1)
    assert [v for (v,) in values(mesh, total)] == want


def test_indirect_write_optional_work_and_info(spark):
    mesh = Mesh(spark)
    a, b = mesh.decl_set(20, "a"), mesh.decl_set(6, "b")
    m = mesh.decl_map(a, b, 2, lambda i: [i % 5, (i * 3) % 5], "m")
    d, e = mesh.decl_dat(a, 1, "double", lambda i: (i - 7) * (i - 7) * -1.0, "d"), mesh.decl_dat(b, 1, "double", None, "e")
    mesh.par_loop(lambda v, w, off: {3: [v + w, v]}, "write", a, arg_dat(d), arg_gbl(1.0, WORK), opt_arg_dat(False, d), arg_dat(e, -2, m, WRITE))
    want = [0.0] * 6
    for i in range(20):
        want[i % 5], want[(i * 3) % 5] = -((i - 7) ** 2) + 1.0, -((i - 7) ** 2) + 0.0
    assert [v for (v,) in values(mesh, e)] == want
    assert conflicts(a, arg_dat(e, 0, m, WRITE)).count() == 5
    got = mesh.par_loop(lambda v, i: {2: v, 3: i, 4: v * 2}, "info", a, arg_dat(d), arg_idx(), arg_gbl(-1e9, MAX), arg_info(-5, 2), arg_info(0.5, 2)).values()
    assert got == {2: [0.0], 3: [7], 4: [0.0]}
    none = mesh.par_loop(lambda v, i: {2: v, 3: i}, "info", a, arg_dat(d), arg_idx(), arg_gbl(5.0, MAX), arg_info(-5, 2)).values()
    assert none == {2: [5.0], 3: [-5]}


def test_nan_is_ignored_in_extrema(spark):
    mesh = Mesh(spark)
    s = mesh.decl_set(4, "s")
    d = mesh.decl_dat(s, 1, "double", lambda i: F.when(i == 2, float("nan")).otherwise(i), "d")
    assert mesh.par_loop(lambda v: {1: v, 2: v}, "x", s, arg_dat(d), arg_gbl(-1.0, MAX), arg_gbl(9.0, MIN)).values() == {1: [3.0], 2: [0.0]}


def test_rules(spark):
    mesh = Mesh(spark)
    a, b = mesh.decl_set(3, "a"), mesh.decl_set(2, "b")
    m = mesh.decl_map(a, b, 2, [[0, 1], [1, 0], [1, 1]], "m")
    based = mesh.decl_map(a, b, 1, [1, 2, 2], "based", base=1)
    assert [r[0] for r in a.frame.orderBy("id").select(*based.columns).collect()] == [0, 1, 1]
    x, y = mesh.decl_dat(a, 1, "double", [1, 2, 3], "x"), mesh.decl_dat(b, 1, "double", None, "y")
    flag = mesh.decl_dat(a, 1, "bool", None, "flag")
    bad = [
        lambda: mesh.decl_set(-1, "c"),
        lambda: mesh.decl_map(a, b, 0, [], "z"),
        lambda: mesh.decl_dat(a, 1, "double", None, "x"),
        lambda: mesh.par_loop(lambda: {}, "k", a, arg_dat(y)),
        lambda: mesh.par_loop(lambda: {}, "k", a, arg_dat(x, 0, m)),
        lambda: mesh.par_loop(lambda: {}, "k", a, arg_dat(y, 2, m)),
        lambda: mesh.par_loop(lambda: {}, "k", a, arg_dat(y, 1)),
        lambda: mesh.par_loop(lambda: {}, "k", b, arg_dat(y, 0, m)),
        lambda: mesh.par_loop(lambda v: {0: v, 1: v}, "k", a, arg_dat(x)),
        lambda: mesh.par_loop(lambda v: {1: [v, v]}, "k", a, arg_dat(x), arg_dat(y, 0, m, INC)),
        lambda: mesh.par_loop(lambda v: {}, "k", a, arg_dat(x, dim=2)),
        lambda: mesh.par_loop(lambda v: {}, "k", a, arg_dat(x, type="int")),
        lambda: mesh.par_loop(lambda v: {}, "k", a, arg_gbl(1.0, RW)),
        lambda: mesh.par_loop(lambda v: {}, "k", a, arg_gbl(True, INC, "bool")),
        lambda: mesh.par_loop(lambda v: {0: 1}, "k", a, arg_info(0, 0)),
        lambda: mesh.fetch(x, 0, 3),
        lambda: mesh.decl_dat_overlay(a, y),
        lambda: spark_type("string"),
    ]
    for f in bad:
        with pytest.raises(MeshError):
            f()
    assert mesh.search_dat(a, 1, "r8", "x") is x and mesh.search_dat(a, 2, "r8", "x") is None and flag.dim == 1
    assert mesh.free_dat_temp(x) == -1
    assert mesh.describe().count() == 2 + 2 + 3
    assert mesh.par_loop(lambda: {0: F.lit(1)}, "empty", mesh.decl_set(0, "none"), arg_gbl(3, INC, "int")).values() == {0: [3]}
    mesh.close()
    assert not mesh.sets


def test_overlay_and_index(spark):
    mesh = Mesh(spark)
    a, b = mesh.decl_set(6, "a"), mesh.decl_set(4, "b")
    d = mesh.decl_dat(a, 1, "double", lambda i: i, "d")
    over = mesh.decl_dat_overlay(b, d)
    mesh.par_loop(lambda: {0: F.lit(10.0)}, "add", b, arg_dat(over, access=INC))
    mesh.write_back(over)
    assert [v for (v,) in values(mesh, d)] == [10, 11, 12, 13, 4, 5]
    mesh.write_index(d)
    assert [v for (v,) in values(mesh, d)] == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("real", ["double", "float"])
def test_jacobi_reaches_the_known_values(spark, real):
    mesh = generate.jacobi(spark, 6, real)
    assert mesh.sets["edges"].size == 105
    apps.jacobi(mesh, 2)
    u = np.array([v for (v,) in values(mesh, mesh.dats["nodes", "u"])]).reshape(5, 5)
    assert u[0, 0] == 0.625 and u[0, 1] == 0.4375 and u[1, 1] == 0.125 and u[0, 2] == 0.375 and u[1, 2] == 0.0625 and u[2, 2] == 0.0


def test_jacobi_with_wide_dats(spark):
    mesh = generate.jacobi(spark, 6, wide=True)
    apps.jacobi(mesh, 2)
    u = values(mesh, mesh.dats["nodes", "u"])
    assert u[0] == (0.625, 0.0)


def plain_flow(mesh, gas, steps):
    """The same scheme as plain loops."""
    rows = lambda s, c: [tuple(r) for r in mesh.frames[s].orderBy("id").select(*c).collect()]
    m = mesh.maps
    x, cn = rows("nodes", ["x__0", "x__1"]), rows("cells", m["cell_nodes"].columns)
    en, ec = rows("edges", m["edge_nodes"].columns), rows("edges", m["edge_cells"].columns)
    bn, bc = rows("bedges", m["bedge_nodes"].columns), rows("bedges", m["bedge_cell"].columns + ["bound__0"])
    q = [list(gas.far) for _ in cn]
    out = []
    for _ in range(steps):
        old = [list(v) for v in q]
        for _ in range(2):
            adt = []
            for nodes, s in zip(cn, q, strict=True):
                u, v = s[1] / s[0], s[2] / s[0]
                c = (gas.gam * gas.gm1 * (s[3] / s[0] - 0.5 * (u * u + v * v))) ** 0.5
                t = 0.0
                for a, b in zip(nodes, nodes[1:] + nodes[:1], strict=True):
                    dx, dy = x[b][0] - x[a][0], x[b][1] - x[a][1]
                    t += abs(u * dy - v * dx) + c * (dx * dx + dy * dy) ** 0.5
                adt.append(t / gas.cfl)
            res = [[0.0] * 4 for _ in cn]
            for (a, b), (l, r) in zip(en, ec, strict=True):
                n = (x[a][1] - x[b][1], x[b][0] - x[a][0])
                mu = 0.5 * (adt[l] + adt[r]) * gas.eps
                for k, (f, g) in enumerate(zip(gas.flux(q[l], n), gas.flux(q[r], n), strict=True)):
                    flux = 0.5 * (f + g) + mu * (q[l][k] - q[r][k])
                    res[l][k] += flux
                    res[r][k] -= flux
            for (a, b), (c, flag) in zip(bn, bc, strict=True):
                n = (x[a][1] - x[b][1], x[b][0] - x[a][0])
                p = gas.pressure(q[c])
                wall = [0.0, p * n[0], p * n[1], 0.0]
                for k, (f, g) in enumerate(zip(gas.flux(q[c], n), gas.flux(gas.far, n), strict=True)):
                    res[c][k] += wall[k] if flag == 1 else 0.5 * (f + g) + adt[c] * gas.eps * (q[c][k] - gas.far[k])
            rms = 0.0
            for c in range(len(cn)):
                for k in range(4):
                    d = res[c][k] / adt[c]
                    q[c][k] = old[c][k] - d
                    rms += d * d
        out.append((rms / len(cn)) ** 0.5)
    return q, out


def test_finite_volumes_equal_plain_loops(spark):
    mesh, gas = generate.channel(spark, 6, 4), Gas()
    want_q, want = plain_flow(mesh, gas, 1)
    apps.start_flow(mesh, gas)
    got = apps.flow(mesh, gas, 1)
    np.testing.assert_allclose(got, want, rtol=1e-10)
    np.testing.assert_allclose(values(mesh, mesh.dats["cells", "q"]), want_q, rtol=1e-12)


def test_faces_point_from_their_second_cell_to_the_first(spark):
    """A uniform flow between walls far away leaves inner cells in balance."""
    mesh, gas = generate.channel(spark, 5, 4, height=0.0), Gas()
    assert apps.counts(mesh) == {"edges": [mesh.sets["edges"].size], "cells": [20]}
    apps.start_flow(mesh, gas)
    assert apps.flow(mesh, gas, 1)[0] < 1e-12


def test_conjugate_gradients(spark):
    mesh, rounds = apps.poisson(spark, 4, 3)
    x, u = values(mesh, mesh.dats["nodes", "x"]), values(mesh, mesh.dats["nodes", "u"])
    np.testing.assert_allclose([v for (v,) in u], [a for a, _ in x], atol=1e-6)  # u = x is harmonic
    assert 0 < rounds <= 20


def test_minima(spark):
    assert apps.minima(spark) == (5, 5)


def test_mesh_directory_round_trip(spark, tmp_path):
    mesh = generate.channel(spark, 4, 3)
    mesh.decl_const("far", 1.0, 2.0)
    mesh_io.write_mesh(mesh, f"file://{tmp_path}/m")
    again = mesh_io.read_mesh(spark, f"file://{tmp_path}/m")
    assert again.consts["far"].values == (1.0, 2.0) and again.sets["edges"].size == mesh.sets["edges"].size
    assert mesh_io.compare(mesh.fetch(mesh.dats["nodes", "x"]), again.fetch(again.dats["nodes", "x"])).isEmpty()
    moved = again.fetch(again.dats["nodes", "x"]).withColumn("x__1", F.col("x__1") + F.when(F.col("id") == 3, 1e-3).otherwise(0))
    assert [(r["id"], r["component"]) for r in mesh_io.compare(mesh.fetch(mesh.dats["nodes", "x"]), moved).collect()] == [(3, 1)]
    assert mesh_io.read_map(again, again.sets["cells"], again.sets["nodes"], 4, "gone", f"file://{tmp_path}/none") is None
    with pytest.raises(MeshError):
        mesh_io.read_map(again, again.sets["cells"], again.sets["nodes"], 3, "bad", f"file://{tmp_path}/m/maps/cell_nodes")
    assert mesh_io.read_dat(again, again.sets["bedges"], 1, "double", "as_double", f"file://{tmp_path}/m/dats/bedges/bound").type == "double"
    assert mesh_io.dataset_properties(spark, f"file://{tmp_path}/m/maps/cell_nodes") == {"size": 12, "dim": 4, "types": ["bigint"] * 4}


def test_text_mesh_and_dumps(spark, tmp_path):
    mesh = generate.channel(spark, 3, 2)
    (tmp_path / "grid.txt").write_text("\n".join(generate.text_lines(mesh)) + "\n")
    again = mesh_io.read_text_mesh(spark, f"file://{tmp_path}/grid.txt")
    for s, columns in (("edges", again.maps["edge_cells"].columns + again.maps["edge_nodes"].columns), ("bedges", ["bound__0"]), ("nodes", ["x__0", "x__1"])):
        assert [tuple(r) for r in again.frames[s].orderBy("id").select(*columns).collect()] == [tuple(r) for r in mesh.frames[s].orderBy("id").select(*columns).collect()]
    mesh_io.dump_text(mesh.dats["nodes", "x"], f"file://{tmp_path}/x")
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/x").collect()]
    assert lines[0] == "12 2" and len(lines) == 13 and float(lines[1].split()[0]) == -1.0
    mesh_io.dump_binary(mesh.dats["bedges", "bound"], str(tmp_path / "b.bin"))
    size, dim, rows = mesh_io.read_binary(str(tmp_path / "b.bin"), "int")
    assert (size, dim) == (10, 1) and rows == [tuple(r[1:]) for r in mesh.fetch(mesh.dats["bedges", "bound"]).collect()]


def test_text_dump_in_parts(spark, tmp_path, monkeypatch):
    """No part has all lines; in order of their names the parts are the whole dump, and a text mesh in parts is read in order."""
    monkeypatch.setattr(mesh_io, "PART_LINES", 100, raising=False)
    mesh = Mesh(spark)
    x = mesh.decl_dat(mesh.decl_set(1000, "nodes"), 2, "double", lambda i: [i, -i], "x")
    mesh_io.dump_text(x, f"file://{tmp_path}/x")
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "x").glob("part-*"))]
    assert len(parts) > 5 and max(map(len, parts)) < 400
    lines = sum(parts, [])
    assert lines[0] == "1000 2" and [tuple(map(float, n.split())) for n in lines[1:]] == [(i, -i) for i in range(1000)]
    counts = (300, 200, 400, 50)
    rows = [" ".join(map(str, counts)), *(f"{i} {-i}" for i in range(300)), *(f"{i} {i + 1} {i + 2} {i + 3}" for i in range(200)), *(f"{i % 300} {(i + 1) % 300} {i % 200} {(i + 1) % 200}" for i in range(400)), *(f"{i} {i + 1} {i} 1" for i in range(50))]
    text = spark.createDataFrame(list(enumerate(rows)), "i long, value string")
    mesh_io.write_lines(text, ["i"], F.col("value"), f"file://{tmp_path}/m", len(rows))
    assert len(list((tmp_path / "m").glob("part-*"))) > 5
    again = mesh_io.read_text_mesh(spark, f"file://{tmp_path}/m")
    assert [tuple(r) for r in again.frames["nodes"].orderBy("id").select("id", "x__0").collect()] == [(i, float(i)) for i in range(300)]
    assert [tuple(r) for r in again.frames["edges"].orderBy("id").select("id", "edge_cells__0").collect()] == [(i, i % 200) for i in range(400)]


def test_dual_graph_is_dealt_by_pairs(spark, monkeypatch):
    """As many tasks join the ties as their pairs call for, and the pairs are all there."""
    import re

    monkeypatch.setattr(graph, "PAIRS", 500, raising=False)
    mesh = Mesh(spark)
    links, ends, ties = mesh.decl_set(3000, "links"), mesh.decl_set(97, "ends"), mesh.decl_set(400, "ties")
    a = mesh.decl_map(links, ends, 1, lambda i: [i * i % 97], "a")
    t = mesh.decl_map(links, ties, 1, lambda i: [i % 400], "t")
    found = graph.dual_graph(a, t)
    by_tie: dict[int, set] = {}
    for i in range(3000):
        by_tie.setdefault(i % 400, set()).add(i * i % 97)
    want = {(x, y) for own in by_tie.values() for x in own for y in own if x != y}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    made = sum(len(own) * (len(own) - 1) for own in by_tie.values())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert made > 5000 and {int(n) for n in re.findall(r"RepartitionByExpression \[t#\d+L?\], (\d+)", plan)} == {-(-made // 500)}


def test_partitions(spark):
    mesh = generate.channel(spark, 12, 8)
    cells, x = mesh.sets["cells"], mesh.dats["nodes", "x"]
    parts = {r["part"]: r["n"] for r in graph.part_block(cells, 5).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sorted(parts) == list(range(5)) and max(parts.values()) - min(parts.values()) <= 1
    assert graph.part_random(cells, 4).agg(F.max("part")).first()[0] == 3
    geometric = graph.part_geometric(x, 4).groupBy("part").agg(F.count("*").alias("n")).collect()
    assert len(geometric) == 4 and max(r["n"] for r in geometric) <= 2 * min(r["n"] for r in geometric)
    place = mesh.decl_dat(mesh.sets["nodes"], 3, "double", lambda i: [F.col("x__0"), F.col("x__1"), F.lit(0.0)], "place")
    inertial = graph.part_inertial(place, 4).groupBy("part").agg(F.count("*").alias("n")).collect()
    assert len(inertial) == 4 and max(r["n"] for r in inertial) <= 1.6 * min(r["n"] for r in inertial)
    vectors = graph.propagate_all(mesh, {"cells": graph.part_block(cells, 3)})
    assert set(vectors) == {"cells", "nodes", "edges", "bedges"}
    for name, v in vectors.items():
        assert v.count() == mesh.sets[name].size
    cut = graph.edge_cut(mesh.maps["edge_cells"], vectors["cells"]).first()
    refined = graph.part_graph(mesh.maps["edge_cells"], 3, rounds=1)
    assert refined.count() == cells.size
    rnd = graph.edge_cut(mesh.maps["edge_cells"], graph.part_random(cells, 3)).first()
    assert 0 < cut["n_cut"] < rnd["n_cut"]
    together = graph.forced_together(mesh.maps["edge_cells"], vectors["cells"])
    assert together.select("part").distinct().count() == 1
    before = values(mesh, mesh.decl_dat(cells, 1, "ll", lambda i: i, "number"))
    graph.distribute(cells, vectors["cells"], 3)
    assert values(mesh, mesh.dats["cells", "number"]) == before
    regions = graph.halo_regions(mesh.maps["edge_cells"], vectors["edges"], vectors["cells"]).collect()
    assert sum(r["n"] for r in regions if r["kind"] != "imported") == mesh.sets["edges"].size


def test_long_chains_are_forced_together(spark):
    mesh = Mesh(spark)
    links, ends = mesh.decl_set(53, "links"), mesh.decl_set(56, "ends")
    m = mesh.decl_map(links, ends, 2, lambda i: [i, i + 1], "link_ends")
    vector = spark.range(56).select("id", F.col("id").cast("int").alias("part"))
    got = {r["id"]: r["part"] for r in graph.forced_together(m, vector).collect()}
    assert got == {i: 0 if i <= 53 else i for i in range(56)}


def test_renumbering(spark):
    mesh = generate.channel(spark, 5, 3)
    m, x = mesh.maps["cell_nodes"], mesh.dats["nodes", "x"]
    for order in (graph.order_geometric(x), graph.order_levels(mesh.maps["edge_nodes"], most=20)):
        got = graph.check_order(order).first()
        assert got["n"] == got["n_new"] == 24 and (got["low"], got["high"]) == (0, 23)
    order = graph.order_geometric(x)
    cells = graph.renumber_sources(m, order)
    assert graph.check_order(cells).first()["n_new"] == 15
    corners = lambda: {tuple(sorted((r["a"], r["b"]) for r in rows)) for rows in [mesh.sets["nodes"].frame.select(F.col("x__0").alias("a"), F.col("x__1").alias("b")).collect()]}
    before = corners()
    total = mesh.par_loop(lambda v: {1: v[0][0] * v[2][1]}, "sum", mesh.sets["cells"], arg_dat(x, -4, m), arg_gbl(0.0, INC)).values()[1][0]
    graph.apply_order(mesh, mesh.sets["nodes"], order)
    assert corners() == before
    assert abs(mesh.par_loop(lambda v: {1: v[0][0] * v[2][1]}, "sum", mesh.sets["cells"], arg_dat(x, -4, m), arg_gbl(0.0, INC)).values()[1][0] - total) < 1e-12
    touch = graph.renumber_targets(m, cells)
    assert graph.check_order(touch).first()["n_new"] == 24


def test_profile(spark, tmp_path):
    mesh = generate.line(spark, 5)
    mesh.profiler.level = 2
    with mesh.profiler.region("step"):
        mesh.par_loop(lambda v: {}, "read", mesh.sets["edges"], arg_dat(mesh.dats["edges", "e1"]))
    assert [r[:2] for r in mesh.profiler.records()] == [("read", 1)]
    mesh.profiler.write_json(tmp_path / "p.json")
    tree = json.loads((tmp_path / "p.json").read_text())
    assert tree["children"][0]["name"] == "step" and tree["children"][0]["children"][0]["clock"]["n"] == 1
    mesh.profiler.write_csv(tmp_path / "p.csv")
    assert (tmp_path / "p.csv").read_text().splitlines()[0].endswith("kernel name")
    assert "read" in mesh.profiler.table() and mesh.profiler.frame(spark).count() == 1


def test_a_bad_map_entry_stops_the_loop(spark):
    mesh = Mesh(spark)
    a, b = mesh.decl_set(5, "a"), mesh.decl_set(3, "b")
    m = mesh.decl_map(a, b, 1, [0, 1, 2, 7, 0], "to")
    x, y = mesh.decl_dat(b, 1, "double", [1.0, 2.0, 3.0], "x"), mesh.decl_dat(a, 1, "double", None, "y")
    mesh.par_loop(lambda v: {1: v}, "read", a, arg_dat(x, 0, m), arg_dat(y, access=WRITE))
    with pytest.raises(Exception, match="map to, slot 0"):
        mesh.fetch(y).collect()
    assert a.frame.select("id").count() == 5


def test_show_prints_the_first_elements(spark, capsys):
    mesh = Mesh(spark)
    a = mesh.decl_set(4, "a")
    mesh.show(mesh.decl_dat(a, 2, "int", [0, 1, 2, 3, 4, 5, 6, 7], "x"), most=2)
    assert capsys.readouterr().out.split("\n") == ["x on a: 4 elements of 2", "0 0 1", "1 2 3", ""]


def test_flow_round_a_wing_with_temporary_dats(spark):
    mesh, gas = generate.wing(spark, 4, 3), Gas()
    assert {n: s.size for n, s in mesh.sets.items()} == {"nodes": 52, "cells": 36, "edges": 11 * 3 + 12 * 2 + 4, "bedges": 4 + 12 + 6}
    assert not mesh.is_onto(mesh.maps["bedge_nodes"]) and mesh.is_onto(mesh.maps["cell_nodes"])
    want_q, want = plain_flow(mesh, gas, 2)
    apps.start_flow(mesh, gas, temporary=True)
    got = apps.flow_history(mesh, gas, 2, temporary=True)
    np.testing.assert_allclose([g[0] for g in got], want, rtol=1e-9)
    np.testing.assert_allclose(values(mesh, mesh.dats["cells", "q"]), want_q, rtol=1e-11)
    assert set(n for s, n in mesh.dats if s == "cells") == {"q"}


def test_the_faces_of_every_cell_of_the_wing_close(spark):
    """Outward normals of a cell's faces sum to zero, over the cut too."""
    mesh = generate.wing(spark, 5, 4)
    rows = lambda s, c: [tuple(r) for r in mesh.frames[s].orderBy("id").select(*c).collect()]
    m, x = mesh.maps, rows("nodes", ["x__0", "x__1"])
    total = np.zeros((60, 2))
    for (a, b), (c, d) in zip(rows("edges", m["edge_nodes"].columns), rows("edges", m["edge_cells"].columns), strict=True):
        n = np.array([x[a][1] - x[b][1], x[b][0] - x[a][0]])
        total[c] += n
        total[d] -= n
    for (a, b), (c,) in zip(rows("bedges", m["bedge_nodes"].columns), rows("bedges", m["bedge_cell"].columns), strict=True):
        total[c] += np.array([x[a][1] - x[b][1], x[b][0] - x[a][0]])
    np.testing.assert_allclose(total, 0, atol=1e-12)


def test_largest_change_and_its_cell(spark):
    mesh, gas = generate.channel(spark, 6, 4), Gas()
    apps.start_flow(mesh, gas)
    before = np.array(values(mesh, mesh.dats["cells", "q"]))
    apps.flow(mesh, gas, 1)
    middle = np.array(values(mesh, mesh.dats["cells", "q"]))
    _, worst, cell = apps.flow_history(mesh, gas, 1)[0]
    change = ((np.array(values(mesh, mesh.dats["cells", "q"])) - middle) ** 2).max(axis=1)
    assert before.shape == middle.shape
    assert cell == int(change.argmax())
    np.testing.assert_allclose(worst, change.max(), rtol=1e-9)


def plain_potential(x, cells, held, mach, rounds):
    """Newton's rounds with whole matrices, Gauss points and shape functions written out."""
    g = [0.5 - 0.5 / 3**0.5, 0.5 + 0.5 / 3**0.5]
    phi, out = mach * x[:, 0], []
    for _ in range(rounds):
        big, res = np.zeros((len(x), len(x))), np.zeros(len(x))
        for nodes in cells:
            at = x[list(nodes)]
            for s in g:
                for t in g:
                    local = np.array([[-(1 - t), 1 - t, t, -t], [-(1 - s), -s, s, 1 - s]])
                    jac = local @ at
                    grad = np.linalg.solve(jac, local)
                    w = 0.25 * abs(np.linalg.det(jac))
                    v = grad @ phi[list(nodes)]
                    base = 1 + 0.2 * (mach**2 - v @ v)
                    rho, along = base**2.5, v @ grad
                    res[list(nodes)] += w * rho * along
                    big[np.ix_(nodes, nodes)] += w * rho * (grad.T @ grad - np.outer(along, along) / base)
        res[held] = 0
        u, p, now, steps = np.zeros(len(x)), res.copy(), res @ res, 0
        first = now
        while steps < 200 and now > 0.01 * first:
            v = big @ p
            v[held] = 0
            a = now / (p @ v)
            u, res = u + a * p, res - a * v
            p, now, steps = res + (res @ res) / now * p, res @ res, steps + 1
        phi = phi - u
        out.append((steps, (u @ u / len(x)) ** 0.5))
    return phi, out


def test_potential_flow_equals_whole_matrices(spark):
    mesh = generate.wing_elements(spark, 4, 2)
    assert {n: s.size for n, s in mesh.sets.items()} == {"nodes": 34, "cells": 24, "held": 16}
    rows = lambda s, c: [tuple(r) for r in mesh.frames[s].orderBy("id").select(*c).collect()]
    x = np.array(rows("nodes", ["x__0", "x__1"]))
    cells, held = rows("cells", mesh.maps["cell_nodes"].columns), [h for (h,) in rows("held", mesh.maps["held_nodes"].columns)]
    assert len(set(held)) == 16
    want_phi, want = plain_potential(x, cells, held, 0.3, 2)
    got = apps.potential_flow(mesh, Potential(mach=0.3), rounds=2)
    assert [s for s, _ in got] == [s for s, _ in want]
    assert want[0][1] > 1e-4
    np.testing.assert_allclose([r for _, r in got], [r for _, r in want], rtol=1e-8)
    np.testing.assert_allclose([v for (v,) in values(mesh, mesh.dats["nodes", "phi"])], want_phi, rtol=1e-10)
