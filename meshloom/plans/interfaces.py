"""Queries for declarations, sources, sinks, partition dispatch, loop classes and timing, registered in the catalogue.

What is written goes to the shared folder and is read back whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from meshloom.operators import graph
from meshloom.operators.args import INC, MAX, MIN, READ, RW, WRITE, arg_dat, arg_gbl, arg_idx
from meshloom.operators.model import Mesh, shared_dir
from meshloom.operators.planner import classify
from meshloom.plans.catalogue import _dat, _query, money
from meshloom.sources import mesh_io
from meshloom.sources.tables import table_mesh

_SPEND = "SELECT c_custkey AS id, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS spend FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"
#: Contiguous ranges, as ``part_block`` deals them.
_BLOCK = "CAST(({id} * {parts}) // (SELECT count(*) FROM {table}) AS INTEGER)"


def _place(spark) -> str:
    return f"{shared_dir(spark)}/meshloom-mesh/{uuid.uuid4().hex}"


def _small(spark, sf_dir) -> Mesh:
    """orders and customer with a price and a constant, as what is written below."""
    mesh = table_mesh(spark, sf_dir, "customer", "orders")
    _dat(mesh, "orders", "o_totalprice")
    mesh.decl_const("rate", 2.0, 0.5)
    return mesh


def _spend(mesh):
    price, spend = mesh.dats["orders", "o_totalprice"], mesh.decl_dat(mesh.sets["customer"], 1, "double", None, "spend")
    mesh.par_loop(lambda p: {1: money(p)}, "spend", mesh.sets["orders"], arg_dat(price), arg_dat(spend, 0, mesh.maps["orders_customer"], INC))
    return mesh.sets["customer"].frame.select("id", F.col("spend__0").alias("spend"))


# Declarations -----------------------------------------------------------------------


@_query("SELECT i AS id, CAST(7 * i + 3 AS DOUBLE) AS a, CAST(7 * i + 4 AS DOUBLE) AS b FROM range(144) t(i)")
def q100_declared_set(spark, sf_dir):
    mesh = Mesh(spark)
    nodes = mesh.decl_set(144, "nodes")
    return mesh.fetch(mesh.decl_dat(nodes, 2, "double", lambda i: [7 * i + 3, 7 * i + 4], "x")).toDF("id", "a", "b")


@_query("SELECT r_regionkey AS id, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def q101_source_arrays(spark, sf_dir):
    """A set, a map and a dat from row-major numbers; nation has 25 rows at any scale."""
    tables = table_mesh(spark, sf_dir, "region", "nation")
    rows = tables.sets["nation"].frame.select("id", "nation_region").orderBy("id").collect()
    mesh = Mesh(spark)
    nation, region = mesh.decl_set(len(rows), "nation"), mesh.decl_set(tables.sets["region"].size, "region")
    m = mesh.decl_map(nation, region, 1, [r["nation_region"] + 1 for r in rows], "region", base=1)
    one, n = mesh.decl_dat(nation, 1, "ll", [1] * len(rows), "one"), mesh.decl_dat(region, 1, "ll", None, "n")
    mesh.par_loop(lambda x: {1: x}, "count", nation, arg_dat(one), arg_dat(n, 0, m, INC))
    return region.frame.select("id", F.col("n__0").alias("n"))


@_query("SELECT * FROM (VALUES ('found', true), ('missing', false), ('other dim', false), ('set', true), ('map', true), ('same', true), ('differ', false)) t(what, there)")
def q102_registry(spark, sf_dir):
    mesh = _small(spark, sf_dir)
    orders, customer = mesh.get_set("orders"), mesh.get_set("customer")
    rows = [
        ("found", mesh.search_dat(orders, 1, "double", "o_totalprice") is not None),
        ("missing", mesh.search_dat(orders, 1, "double", "none") is not None),
        ("other dim", mesh.search_dat(orders, 2, "double", "o_totalprice") is not None),
        ("set", orders is mesh.sets["orders"]),
        ("map", mesh.get_map("orders_customer") is mesh.maps["orders_customer"]),
        ("same", mesh.same_set(orders, mesh.maps["orders_customer"].source)),
        ("differ", mesh.same_set(orders, customer)),
    ]
    return spark.createDataFrame(rows, "what string, there boolean")


@_query("SELECT * FROM (VALUES ('set', 'customer', '', 0, ''), ('set', 'orders', '', 0, ''), ('map', 'orders_customer', 'orders->customer', 1, 'bigint'), ('dat', 'o_totalprice', 'orders', 1, 'double')) t(kind, name, on_set, dim, type)")
def q103_describe(spark, sf_dir):
    return _small(spark, sf_dir).describe()


# Sources and sinks ------------------------------------------------------------------


@_query(_SPEND)
def q104_mesh_round_trip(spark, sf_dir):
    """Everything declared is written and read again; the loop runs over what was read."""
    path = _place(spark)
    mesh_io.write_mesh(_small(spark, sf_dir), path)
    return _spend(mesh_io.read_mesh(spark, path))


@_query("SELECT 'given' AS how, count(*) AS size FROM orders UNION ALL SELECT 'inferred', count(*) FROM orders")
def q105_source_set(spark, sf_dir):
    path, mesh = _place(spark), _small(spark, sf_dir)
    mesh_io.write_dat(mesh.dats["orders", "o_totalprice"], path)
    new = Mesh(spark)
    mesh_io.read_set(new, "given", path, mesh.sets["orders"].size)
    mesh_io.read_set(new, "inferred", path)
    return spark.createDataFrame([(s.name, s.size) for s in new.sets.values()], "how string, size long")


@_query("SELECT o_orderkey AS id, CAST(o_custkey AS BIGINT) AS target FROM orders")
def q106_source_map(spark, sf_dir):
    path, mesh = _place(spark), _small(spark, sf_dir)
    m = mesh.maps["orders_customer"]
    m.source.frame.select("id", *m.columns).write.parquet(path)
    new = Mesh(spark)
    got = mesh_io.read_map(new, new.decl_set(m.source.size, "orders"), new.decl_set(m.target.size, "customer"), 1, "to", path)
    return got.source.frame.select("id", F.col(got.columns[0]).alias("target"))


@_query("SELECT o_orderkey AS id, CAST(o_totalprice AS FLOAT) AS v FROM orders")
def q107_source_dat(spark, sf_dir):
    """A dat read as another type than it was written in."""
    path, mesh = _place(spark), _small(spark, sf_dir)
    mesh_io.write_dat(mesh.dats["orders", "o_totalprice"], path)
    new = Mesh(spark)
    d = mesh_io.read_dat(new, new.decl_set(mesh.sets["orders"].size, "orders"), 1, "float", "price", path)
    return new.fetch(d).toDF("id", "v")


@_query("SELECT o_orderkey AS id, o_totalprice * 2.0 + 0.5 AS v FROM orders")
def q108_source_const(spark, sf_dir):
    path = _place(spark)
    mesh_io.write_mesh(_small(spark, sf_dir), path)
    mesh = mesh_io.read_mesh(spark, path)
    rate, out = mesh.consts["rate"], mesh.decl_dat(mesh.sets["orders"], 1, "double", None, "v")
    mesh.par_loop(lambda p: {1: p * rate[0] + rate[1]}, "rated", mesh.sets["orders"], arg_dat(mesh.dats["orders", "o_totalprice"]), arg_dat(out, access=WRITE))
    return mesh.sets["orders"].frame.select("id", F.col("v__0").alias("v"))


_TEXT = "WITH n AS (SELECT count(*) AS n FROM supplier)"


@_query(
    f"{_TEXT} SELECT 'nodes' AS part, s_suppkey AS id, CAST(s_suppkey AS DOUBLE) AS a, s_acctbal AS b FROM supplier"
    " UNION ALL SELECT 'cells', n_nationkey, CAST(n_nationkey % n AS DOUBLE), CAST((n_nationkey + 3) % n AS DOUBLE) FROM nation, n"
    " UNION ALL SELECT 'edges', c_custkey, CAST(c_custkey % n AS DOUBLE), CAST(c_custkey % 25 AS DOUBLE) FROM customer, n"
    " UNION ALL SELECT 'bedges', r_regionkey, CAST(r_regionkey AS DOUBLE), CAST(1 + r_regionkey % 2 AS DOUBLE) FROM region"
)
def q109_text_mesh(spark, sf_dir):
    """The four sections of a text mesh, written from the tables and read by lines."""
    path = _place(spark)
    t = table_mesh(spark, sf_dir, "supplier", "nation", "customer", "region")
    n, size = {k: s.size for k, s in t.sets.items()}, t.sets["supplier"].size
    i = F.col("id")
    say = lambda name, k, *c: t.sets[name].frame.select(F.lit(k).alias("k"), i.alias("i"), F.concat_ws(" ", *[x.cast("string") for x in c]).alias("value"))
    body = (
        say("supplier", 1, i, F.col("s_acctbal"))
        .unionByName(say("nation", 2, *[(i + k) % size for k in range(4)]))
        .unionByName(say("customer", 3, i % size, (i + 1) % size, i % 25, (i + 1) % 25))
        .unionByName(say("region", 4, i, i + 1, i, 1 + i % 2))
    )
    head = spark.createDataFrame([(0, 0, f"{size} {n['nation']} {n['customer']} {n['region']}")], "k int, i long, value string")
    mesh_io.write_lines(head.unionByName(body), ["k", "i"], F.col("value"), path, 1 + size + sum(n[k] for k in ("nation", "customer", "region")))
    mesh = mesh_io.read_text_mesh(spark, path)
    show = lambda name, a, b: mesh.sets[name].frame.select(F.lit(name).alias("part"), "id", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    out = show("nodes", "x__0", "x__1").unionByName(show("cells", "cell_nodes__0", "cell_nodes__3"))
    return out.unionByName(show("edges", "edge_nodes__0", "edge_cells__0")).unionByName(show("bedges", "bedge_cell__0", "bound__0"))


@_query("SELECT count(*) AS size, 1 AS dim, 'double' AS types FROM orders")
def q110_properties(spark, sf_dir):
    path, mesh = _place(spark), _small(spark, sf_dir)
    mesh_io.write_dat(mesh.dats["orders", "o_totalprice"], path)
    found = mesh_io.dataset_properties(spark, path)
    return spark.createDataFrame([(found["size"], found["dim"], ",".join(found["types"]))], "size long, dim int, types string")


@_query("SELECT round(o_totalprice, 2) AS v FROM orders UNION ALL SELECT -count(*) FROM orders")
def q111_dump_text(spark, sf_dir):
    """The numbers of a text dump; the head's size with its sign turned."""
    path, mesh = _place(spark), _small(spark, sf_dir)
    mesh_io.dump_text(mesh.dats["orders", "o_totalprice"], path)
    lines = spark.read.text(path)
    head = F.col("value").startswith(" ")
    return lines.select(F.when(head, F.round(F.trim("value").try_cast("double"), 2)).otherwise(-F.split("value", " ")[0].try_cast("double")).alias("v"))


@_query("SELECT o_orderkey AS id, 0 AS component, o_totalprice AS a, o_totalprice + 1 AS b FROM orders WHERE o_orderkey % 7 = 3")
def q112_compare(spark, sf_dir):
    mesh = _small(spark, sf_dir)
    a = mesh.fetch(mesh.dats["orders", "o_totalprice"])
    return mesh_io.compare(a, a.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("id") % 7 == 3, 1.0).otherwise(0.0)))


@_query("SELECT o_orderkey AS id, o_totalprice * 3 AS v FROM orders")
def q113_write_one_dat(spark, sf_dir):
    """A dat written over a table of its size, under a name with groups."""
    path, mesh = _place(spark) + "/group/of/price", _small(spark, sf_dir)
    price = mesh.dats["orders", "o_totalprice"]
    mesh_io.write_dat(price, path)
    other = mesh.decl_dat(mesh.sets["orders"], 1, "double", lambda i: F.col("o_totalprice") * 3, "three")
    mesh_io.write_dat(other, path, check=True)
    return spark.read.parquet(path).toDF("id", "v")


# Partitions -------------------------------------------------------------------------


@_query(
    f"SELECT 'customer' AS set_name, c_custkey AS id, {_BLOCK.format(id='c_custkey', parts=4, table='customer')} AS part FROM customer"
    f" UNION ALL SELECT 'orders', o_orderkey, {_BLOCK.format(id='o_custkey', parts=4, table='customer')} FROM orders"
    f" UNION ALL SELECT 'region', r_regionkey, {_BLOCK.format(id='r_regionkey', parts=4, table='region')} FROM region"
)
def q114_partition_dispatch(spark, sf_dir):
    """A method that lacks its coordinates falls back to blocks; orders follow their customers; region, to which nothing leads, has blocks."""
    import warnings

    mesh = table_mesh(spark, sf_dir, "customer", "orders", "region")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        vectors = graph.partition(mesh, "geometric", mesh.sets["customer"], 4)
    out = None
    for name, v in vectors.items():
        one = v.select(F.lit(name).alias("set_name"), "id", "part")
        out = one if out is None else out.unionByName(one)
    return out


@_query(_SPEND)
def q115_migrate_and_revert(spark, sf_dir):
    """A loop over dealt frames, then over frames in ranges again."""
    mesh = _small(spark, sf_dir)
    graph.partition(mesh, "random", mesh.sets["customer"], 4, seed=3)
    _spend(mesh)
    graph.revert(mesh)
    return mesh.sets["customer"].frame.select("id", F.col("spend__0").alias("spend"))


@_query(f"WITH v AS (SELECT p_partkey AS id, {_BLOCK.format(id='p_partkey', parts=8, table='part')} AS part, p_partkey % ((SELECT count(*) FROM part) // 2) AS pair FROM part) SELECT id, min(part) OVER (PARTITION BY pair) AS part FROM v")
def q116_forced_together(spark, sf_dir):
    """A forced map of two slots keeps element i and i + n/2 in one part."""
    mesh = table_mesh(spark, sf_dir, "part")
    half = mesh.sets["part"].size // 2
    pairs = mesh.decl_set(half, "pairs")
    mesh.force_part(mesh.decl_map(pairs, mesh.sets["part"], 2, lambda i: [i, i + half], "pair"))
    return graph.partition(mesh, "block", mesh.sets["part"], 8)["part"]


@_query(f"SELECT n_nationkey AS id, {_BLOCK.format(id='n_regionkey', parts=2, table='region')} AS part FROM nation")
def q117_propagate_all(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "region", "nation", "supplier")
    return graph.propagate_all(mesh, {"region": graph.part_block(mesh.sets["region"], 2)})["nation"]


@_query("WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS new FROM customer) SELECT new AS id, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS spend FROM o LEFT JOIN orders ON o_custkey = c_custkey GROUP BY new")
def q118_apply_order(spark, sf_dir):
    """The loop after the customers have new numbers in their frame and in the map."""
    mesh = _small(spark, sf_dir)
    graph.apply_order(mesh, mesh.sets["customer"], graph.ranked(mesh.sets["customer"].frame, ["c_acctbal", "id"]))
    return _spend(mesh)


# Loops and timing -------------------------------------------------------------------


@_query("SELECT * FROM (VALUES ('write', 'direct'), ('gather', 'indirect'), ('increment', 'scatter'), ('index', 'direct')) t(loop, class)")
def q119_loop_classes(spark, sf_dir):
    mesh = _small(spark, sf_dir)
    price, balance, m = mesh.dats["orders", "o_totalprice"], _dat(mesh, "customer", "c_acctbal"), mesh.maps["orders_customer"]
    rows = [
        ("write", classify(arg_dat(price, access=RW), arg_gbl(0.0, INC))),
        ("gather", classify(arg_dat(balance, 0, m, READ), arg_dat(price, access=WRITE))),
        ("increment", classify(arg_dat(price), arg_dat(balance, 0, m, INC))),
        ("index", classify(arg_idx(), arg_idx(0, m))),
    ]
    return spark.createDataFrame(rows, "loop string, class string")


@_query("SELECT bool_or(o_totalprice > 400000) AS any_high, bool_and(o_totalprice > 0) AS all_positive, bool_and(o_totalprice > 1000) AS all_above FROM orders")
def q120_bool_reductions(spark, sf_dir):
    mesh = _small(spark, sf_dir)
    got = mesh.par_loop(lambda p: {1: p > 400000, 2: p > 0, 3: p > 1000}, "flags", mesh.sets["orders"], arg_dat(mesh.dats["orders", "o_totalprice"]), arg_gbl(False, MAX, "bool"), arg_gbl(True, MIN, "bool"), arg_gbl(True, MIN, "bool"))
    return got.frame().toDF("any_high", "all_positive", "all_above")


def _timed(spark, sf_dir) -> Mesh:
    """Two loops in a region, one of them three times; only their counts are fixed."""
    mesh = _small(spark, sf_dir)
    mesh.profiler.level = 3
    orders, price = mesh.sets["orders"], mesh.dats["orders", "o_totalprice"]
    with mesh.profiler.region("steps"):
        for _ in range(3):
            mesh.par_loop(lambda p: {0: p + 1}, "add", orders, arg_dat(price, access=RW))
        mesh.par_loop(lambda p: {1: p}, "total", orders, arg_dat(price), arg_gbl(0.0, INC))
    return mesh


@_query("SELECT * FROM (VALUES ('add', CAST(3 AS BIGINT), true), ('total', CAST(1 AS BIGINT), true)) t(kernel, n, timed)")
def q121_timings(spark, sf_dir):
    return _timed(spark, sf_dir).profiler.frame(spark).select("kernel", "n", (F.col("total_s") > 0).alias("timed"))


@_query("SELECT * FROM (VALUES ('root', 'region', 0), ('steps', 'region', 1), ('add', 'kernel', 2), ('total', 'kernel', 2)) t(name, type, depth)")
def q122_timing_tree(spark, sf_dir):
    """The tree as its JSON says it."""
    tree = json.loads(json.dumps(_timed(spark, sf_dir).profiler.root.as_dict()))

    def rows(node, depth):
        yield node["name"], node["type"], depth
        for child in node["children"]:
            yield from rows(child, depth + 1)

    return spark.createDataFrame(list(rows(tree, 0)), "name string, type string, depth int")
