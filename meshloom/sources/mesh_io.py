"""Meshes in and out: Parquet directories, text meshes, text and binary dumps, comparison.

A Parquet mesh directory holds ``mesh.json`` (sets with sizes, maps, dats,
consts) and one table for each map and dat. Names may contain ``/``.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.model import Dat, Mesh, MeshError, MeshMap, MeshSet, spark_type


#: Lines of a text part, about; a task sorts those of one part.
PART_LINES = 1 << 18


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def write_mesh(mesh: Mesh, path: str) -> None:
    """Everything that is declared."""
    for m in mesh.maps.values():
        m.source.frame.select("id", *m.columns).write.mode("overwrite").parquet(f"{path}/maps/{m.name}")
    for d in mesh.dats.values():
        write_dat(d, f"{path}/dats/{d.set.name}/{d.name}")
    head = {
        "sets": {s.name: s.size for s in mesh.sets.values()},
        "maps": [{"name": m.name, "from": m.source.name, "to": m.target.name, "dim": m.dim} for m in mesh.maps.values()],
        "dats": [{"name": d.name, "set": d.set.name, "dim": d.dim, "type": d.type} for d in mesh.dats.values()],
        "consts": {c.name: list(c.values) for c in mesh.consts.values()},
    }
    mesh.spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/mesh.json")


def read_mesh(spark: SparkSession, path: str) -> Mesh:
    head = json.loads(_text(spark, f"{path}/mesh.json"))
    mesh = Mesh(spark)
    for name, size in head["sets"].items():
        mesh.decl_set(size, name)
    for m in head["maps"]:
        read_map(mesh, mesh.sets[m["from"]], mesh.sets[m["to"]], m["dim"], m["name"], f"{path}/maps/{m['name']}")
    for d in head["dats"]:
        read_dat(mesh, mesh.sets[d["set"]], d["dim"], d["type"], d["name"], f"{path}/dats/{d['set']}/{d['name']}")
    for name, values in head["consts"].items():
        mesh.decl_const(name, *values)
    return mesh


def read_set(mesh: Mesh, name: str, table: str, size: int | None = None) -> MeshSet:
    """A set whose size is given, or that of another table."""
    return mesh.decl_set(mesh.spark.read.parquet(table).count() if size is None else size, name)


def read_map(mesh: Mesh, source: MeshSet, target: MeshSet, dim: int, name: str, table: str) -> MeshMap | None:
    """None where there is no such table; its rows and slots must fit."""
    from pyspark.errors import AnalysisException

    try:
        data = mesh.spark.read.parquet(table)
    except AnalysisException:
        return None
    if len(data.columns) != dim + 1:
        raise MeshError(f"{table} has {len(data.columns) - 1} slots, not {dim}")
    if (n := data.count()) != source.size:
        raise MeshError(f"{table} has {n} rows; {source.name} has {source.size}")
    return mesh.decl_map(source, target, dim, data, name)


def read_dat(mesh: Mesh, on: MeshSet, dim: int, type_: str, name: str, table: str) -> Dat:
    """Values of another type are converted, with a message."""
    data = mesh.spark.read.parquet(table)
    own = [f for f in data.schema.fields if f.name != "id"]
    if len(own) != dim:
        raise MeshError(f"{table} has {len(own)} components, not {dim}")
    for f in own:
        if f.dataType.simpleString() != spark_type(type_):
            print(f"{name}: {f.dataType.simpleString()} becomes {spark_type(type_)}")
    return mesh.decl_dat(on, dim, type_, data, name)


def write_dat(dat: Dat, path: str, check: bool = False) -> None:
    """Write a dat; with ``check`` a table that is there must have its rows and components."""
    if check:
        there = dataset_properties(dat.set.mesh.spark, path)
        if (there["size"], there["dim"]) != (dat.set.size, dat.dim):
            raise MeshError(f"{path} has {there['size']} rows of {there['dim']}; {dat.name} has {dat.set.size} of {dat.dim}")
    dat.set.frame.select("id", *dat.columns).write.mode("overwrite").parquet(path)


def dataset_properties(spark: SparkSession, table: str) -> dict:
    """Rows, components and types of a table."""
    data = spark.read.parquet(table)
    own = [f for f in data.schema.fields if f.name != "id"]
    return {"size": data.count(), "dim": len(own), "types": [f.dataType.simpleString() for f in own]}


def read_text_mesh(spark: SparkSession, path: str, single: bool = False) -> Mesh:
    """A finite-volume mesh in four text sections after a line of counts ``nodes cells edges boundary-edges``.

    Sections: ``x y`` of nodes, four nodes of cells, two nodes and two cells of
    edges, two nodes, a cell and a flag of boundary edges; numbers from 0.
    Lines are numbered by the order of the files' names and within a file, in two levels.
    """
    # A block of a file is read by one task, in which ids increase.
    block = F.format_string("%s:%020d", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    lines = spark.read.text(path).select("value", block.alias("t"), F.monotonically_increasing_id().alias("at")).where(F.length(F.trim("value")) > 0)
    blocks = {r["t"]: r["n"] for r in lines.groupBy("t").agg(F.count("*").alias("n")).collect()}
    from pyspark.sql import Window

    before, run = [], 0
    for t in sorted(blocks):
        before += [F.lit(t), F.lit(run)]
        run += blocks[t]
    row = F.row_number().over(Window.partitionBy("t").orderBy("at")) - 1
    numbered = lines.select((F.create_map(*before)[F.col("t")] + row).alias("n"), F.split(F.trim("value"), r"\s+").alias("w"))
    head = numbered.where("n = 0").first()["w"]
    nnode, ncell, nedge, nbedge = (int(x) for x in head)
    mesh, start = Mesh(spark), 1
    real = "float" if single else "double"

    def section(size: int, names: list[str], kinds: list[str]) -> DataFrame:
        nonlocal start
        own = numbered.where((F.col("n") >= start) & (F.col("n") < start + size)).select((F.col("n") - start).cast("bigint").alias("id"), *[F.col("w")[k].cast(t).alias(c) for k, (c, t) in enumerate(zip(names, kinds, strict=True))])
        start += size
        return own

    nodes = mesh.adopt_set(section(nnode, ["x__0", "x__1"], [real] * 2), "nodes")
    cells = mesh.adopt_set(section(ncell, [f"cell_nodes__{k}" for k in range(4)], ["bigint"] * 4), "cells")
    edges = mesh.adopt_set(section(nedge, ["edge_nodes__0", "edge_nodes__1", "edge_cells__0", "edge_cells__1"], ["bigint"] * 4), "edges")
    bedges = mesh.adopt_set(section(nbedge, ["bedge_nodes__0", "bedge_nodes__1", "bedge_cell__0", "bound__0"], ["bigint"] * 3 + ["int"]), "bedges")
    mesh.adopt_map(cells, nodes, [f"cell_nodes__{k}" for k in range(4)], "cell_nodes")
    mesh.adopt_map(edges, nodes, ["edge_nodes__0", "edge_nodes__1"], "edge_nodes")
    mesh.adopt_map(edges, cells, ["edge_cells__0", "edge_cells__1"], "edge_cells")
    mesh.adopt_map(bedges, nodes, ["bedge_nodes__0", "bedge_nodes__1"], "bedge_nodes")
    mesh.adopt_map(bedges, cells, ["bedge_cell__0"], "bedge_cell")
    mesh.adopt_dat(nodes, ["x__0", "x__1"], real, "x")
    mesh.adopt_dat(bedges, ["bound__0"], "int", "bound")
    return mesh


def write_lines(rows: DataFrame, keys: list[str], line: Column, path: str, size: int) -> None:
    """A line for each of ``size`` rows in order of the keys: in text parts by ranges of keys, which in order of their names are the whole text."""
    parts = max(1, -(-size // PART_LINES))
    rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(line.alias("value")).write.mode("overwrite").text(path)


def dump_text(dat: Dat, path: str) -> None:
    """``size dim``, then a line for each element in order, each number as sign, 15 decimals and exponent; in parts, as ``write_lines`` makes them."""
    f = dat.set.frame
    number = [F.format_string("%+.15E", F.when(F.col(c).cast("double") == 0, F.lit(0.0)).otherwise(F.col(c).cast("double"))) if spark_type(dat.type) in ("double", "float") else F.col(c).cast("string") for c in dat.columns]
    head = f.sparkSession.createDataFrame([(0, f"{dat.set.size} {dat.dim}")], "__meshloom_kind int, __meshloom_head string")
    rows = head.unionByName(f.select("id", *dat.columns, F.lit(1).alias("__meshloom_kind")), allowMissingColumns=True)
    line = F.coalesce("__meshloom_head", F.concat(F.lit(" "), F.concat_ws("  ", *number)))
    write_lines(rows, ["__meshloom_kind", "id"], line, path, dat.set.size + 1)


def dump_binary(dat: Dat, path: str) -> None:
    """Size and dim as 32-bit integers, then the raw values in order, streamed through the driver."""
    code = {"double": "d", "float": "f", "int": "i", "bigint": "q", "boolean": "?"}[spark_type(dat.type)]
    with open(path, "wb") as out:
        out.write(struct.pack("<ii", dat.set.size, dat.dim))
        for row in dat.set.mesh.fetch(dat).toLocalIterator(prefetchPartitions=True):
            out.write(struct.pack(f"<{dat.dim}{code}", *row[1:]))


def read_binary(path: str, type_: str) -> tuple[int, int, list[tuple]]:
    code = {"double": "d", "float": "f", "int": "i", "bigint": "q", "boolean": "?"}[spark_type(type_)]
    with open(path, "rb") as f:
        size, dim = struct.unpack("<ii", f.read(8))
        return size, dim, list(struct.iter_unpack(f"<{dim}{code}", f.read()))


def compare(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(id, component, a, b) wherever two fetched dats differ by more than the tolerance, or only one has the element."""
    ca, cb = [c for c in a.columns if c != "id"], [c for c in b.columns if c != "id"]
    if len(ca) != len(cb):
        raise MeshError(f"{len(ca)} and {len(cb)} components")
    both = a.select("id", *[F.col(c).cast("double").alias(f"a{k}") for k, c in enumerate(ca)]).join(b.select("id", *[F.col(c).cast("double").alias(f"b{k}") for k, c in enumerate(cb)]), "id", "full")
    cells = F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for k in range(len(ca))])
    return both.select("id", F.explode(cells).alias("c")).select("id", "c.*").where("a is null or b is null or abs(a - b) > " + repr(tolerance))
