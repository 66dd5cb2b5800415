"""One query for each operator over the driver's tables read as a mesh, with DuckDB SQL beside it.

Money is summed as decimals; ids are bigint. Each query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.kernels import dot, element_product
from meshloom.operators import graph
from meshloom.operators.args import INC, MAX, MIN, RW, WORK, WRITE, arg_dat, arg_gbl, arg_idx, arg_info, opt_arg_dat, opt_arg_gbl
from meshloom.sources.tables import table_mesh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def money(c):
    return c.cast("decimal(18,2)")


def _dat(mesh, on, columns, name=None, kind="double"):
    columns = [columns] if isinstance(columns, str) else columns
    return mesh.adopt_dat(mesh.sets[on], columns, kind, name or columns[0])


def _orders(spark, sf_dir, *more):
    """orders and customer, with a three-slot arithmetic map among them."""
    mesh = table_mesh(spark, sf_dir, "customer", "orders", *more)
    n = mesh.sets["customer"].size
    mesh.decl_map(mesh.sets["orders"], mesh.sets["customer"], 3, lambda i: [(7 * i + 11 * d) % n for d in range(3)], "ring")
    return mesh


#: The arithmetic map in SQL: slot d of order o.
RING = "((7 * o_orderkey + 11 * {d}) % (SELECT count(*) FROM customer))"


def _money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


@_query(f"SELECT c_custkey AS id, CAST(coalesce(sum({_money('o_totalprice')}), 0) AS DOUBLE) AS spend FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q01_inc_dim1(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "customer", "orders")
    price, spend = _dat(mesh, "orders", "o_totalprice"), mesh.decl_dat(mesh.sets["customer"], 1, "double", None, "spend")
    mesh.par_loop(lambda p: {1: money(p)}, "spend", mesh.sets["orders"], arg_dat(price), arg_dat(spend, 0, mesh.maps["orders_customer"], INC))
    return mesh.sets["customer"].frame.select("id", F.col("spend__0").alias("spend"))


@_query("SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def q02_inc_nononto(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders", "lineitem")
    n = mesh.decl_dat(mesh.sets["orders"], 1, "ll", None, "n")
    mesh.par_loop(lambda: {0: F.lit(1)}, "count", mesh.sets["lineitem"], arg_dat(n, 0, mesh.maps["lineitem_orders"], INC))
    return mesh.sets["orders"].frame.select("id", F.col("n__0").alias("n"))


_FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@_query("SELECT p_partkey AS id, " + ", ".join(f"CAST(coalesce(sum({_money(c)}), 0) AS DOUBLE) AS t{k}" for k, c in enumerate(_FOUR)) + " FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def q03_inc_dim4(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "part", "lineitem")
    four, total = _dat(mesh, "lineitem", _FOUR, "four"), mesh.decl_dat(mesh.sets["part"], 4, "double", None, "t")
    mesh.par_loop(lambda v: {1: [money(x) for x in v]}, "totals", mesh.sets["lineitem"], arg_dat(four), arg_dat(total, 0, mesh.maps["lineitem_part"], INC))
    return mesh.sets["part"].frame.select("id", *[F.col(f"t__{k}").alias(f"t{k}") for k in range(4)])


@_query(
    f"""SELECT 'part' AS target, p_partkey AS id, CAST(coalesce(sum({_money('l_extendedprice')}), 0) AS DOUBLE) AS total FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey
    UNION ALL SELECT 'supplier', s_suppkey, CAST(coalesce(sum({_money('l_quantity')}), 0) AS DOUBLE) FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey"""
)
def q04_inc_two_targets(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "part", "supplier", "lineitem")
    price, quantity = _dat(mesh, "lineitem", "l_extendedprice"), _dat(mesh, "lineitem", "l_quantity")
    a, b = (mesh.decl_dat(mesh.sets[s], 1, "double", None, "total") for s in ("part", "supplier"))
    mesh.par_loop(lambda p, q: {2: money(p), 3: money(q)}, "both", mesh.sets["lineitem"], arg_dat(price), arg_dat(quantity), arg_dat(a, 0, mesh.maps["lineitem_part"], INC), arg_dat(b, 0, mesh.maps["lineitem_supplier"], INC))
    own = lambda s: mesh.sets[s].frame.select(F.lit(s).alias("target"), "id", F.col("total__0").alias("total"))
    return own("part").unionByName(own("supplier"))


def _slots_sql(terms: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT {RING.format(d=d)} AS c, {t} AS v FROM orders" for d, t in enumerate(terms))
    return f"SELECT c_custkey AS id, CAST(coalesce(sum(v), 0) AS DOUBLE) AS total FROM customer LEFT JOIN ({union}) ON c = c_custkey GROUP BY c_custkey"


@_query(_slots_sql([_money("o_totalprice"), _money("o_totalprice")]))
def q05_inc_multislot(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    price, total, m = _dat(mesh, "orders", "o_totalprice"), mesh.decl_dat(mesh.sets["customer"], 1, "double", None, "total"), mesh.maps["ring"]
    mesh.par_loop(lambda p: {1: money(p), 2: money(p)}, "slots", mesh.sets["orders"], arg_dat(price), arg_dat(total, 0, m, INC), arg_dat(total, 1, m, INC))
    return mesh.sets["customer"].frame.select("id", F.col("total__0").alias("total"))


@_query(_slots_sql([_money("o_totalprice"), f"-{_money('o_totalprice')}"]))
def q06_inc_sign(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    price, total, m = _dat(mesh, "orders", "o_totalprice"), mesh.decl_dat(mesh.sets["customer"], 1, "double", None, "total"), mesh.maps["ring"]
    mesh.par_loop(lambda p: {1: [money(p), -money(p)]}, "flux", mesh.sets["orders"], arg_dat(price), arg_dat(total, -2, m, INC))
    return mesh.sets["customer"].frame.select("id", F.col("total__0").alias("total"))


@_query("SELECT o_orderkey AS id, o_totalprice + c_acctbal AS v FROM orders JOIN customer ON o_custkey = c_custkey")
def q07_gather1(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "customer", "orders")
    out = mesh.decl_dat(mesh.sets["orders"], 1, "double", None, "v")
    mesh.par_loop(lambda p, b: {2: p + b}, "gather", mesh.sets["orders"], arg_dat(_dat(mesh, "orders", "o_totalprice")), arg_dat(_dat(mesh, "customer", "c_acctbal"), 0, mesh.maps["orders_customer"]), arg_dat(out, access=WRITE))
    return mesh.sets["orders"].frame.select("id", F.col("v__0").alias("v"))


@_query(
    f"""SELECT o_orderkey AS id, CAST(coalesce(sum(v), 0) AS DOUBLE) AS v FROM orders LEFT JOIN (
    SELECT l_orderkey, {_money('p_retailprice')} + {_money('s_acctbal')} AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def q08_gather_multi_map(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "part", "supplier", "orders", "lineitem")
    out, m = mesh.decl_dat(mesh.sets["orders"], 1, "double", None, "v"), mesh.maps
    mesh.par_loop(lambda p, s: {2: money(p) + money(s)}, "two_maps", mesh.sets["lineitem"], arg_dat(_dat(mesh, "part", "p_retailprice"), 0, m["lineitem_part"]), arg_dat(_dat(mesh, "supplier", "s_acctbal"), 0, m["lineitem_supplier"]), arg_dat(out, 0, m["lineitem_orders"], INC))
    return mesh.sets["orders"].frame.select("id", F.col("v__0").alias("v"))


def _ring_join(n: int) -> str:
    return " ".join(f"JOIN customer c{d} ON c{d}.c_custkey = {RING.format(d=d)}" for d in range(n))


@_query(f"SELECT o_orderkey AS id, CAST({' + '.join(_money(f'c{d}.c_acctbal') for d in range(3))} AS DOUBLE) AS v FROM orders {_ring_join(3)}")
def q09_gather_vec(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    out = mesh.decl_dat(mesh.sets["orders"], 1, "double", None, "v")
    mesh.par_loop(lambda b: {1: money(b[0]) + money(b[1]) + money(b[2])}, "vector", mesh.sets["orders"], arg_dat(_dat(mesh, "customer", "c_acctbal"), -3, mesh.maps["ring"]), arg_dat(out, access=WRITE))
    return mesh.sets["orders"].frame.select("id", F.col("v__0").alias("v"))


@_query("SELECT c_custkey AS id, CAST(r_regionkey AS BIGINT) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def q10_gather_chain(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "region", "nation", "customer")
    a, b = (mesh.decl_dat(mesh.sets[s], 1, "ll", None, "r") for s in ("nation", "customer"))
    mesh.par_loop(lambda i: {1: i}, "up", mesh.sets["nation"], arg_idx(0, mesh.maps["nation_region"]), arg_dat(a, access=WRITE))
    mesh.par_loop(lambda r: {1: r}, "down", mesh.sets["customer"], arg_dat(a, 0, mesh.maps["customer_nation"]), arg_dat(b, access=WRITE))
    return mesh.sets["customer"].frame.select("id", F.col("r__0").alias("region"))


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE c_acctbal END AS v FROM orders JOIN customer ON o_custkey = c_custkey")
def q11_boundary(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "customer", "orders")
    flag = mesh.decl_dat(mesh.sets["orders"], 1, "int", lambda i: F.when(F.col("o_orderstatus") == "F", 1).otherwise(2), "flag")
    out = mesh.decl_dat(mesh.sets["orders"], 1, "double", None, "v")
    mesh.par_loop(lambda f, p, b: {3: F.when(f == 1, p).otherwise(b)}, "boundary", mesh.sets["orders"], arg_dat(flag), arg_dat(_dat(mesh, "orders", "o_totalprice")), arg_dat(_dat(mesh, "customer", "c_acctbal"), 0, mesh.maps["orders_customer"]), arg_dat(out, access=WRITE))
    return mesh.sets["orders"].frame.select("id", F.col("v__0").alias("v"))


def _part(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "part")
    return mesh, mesh.sets["part"], _dat(mesh, "part", "p_retailprice")


@_query("SELECT p_partkey AS id, p_retailprice * 2 AS v0, p_retailprice + 1 AS v1 FROM part")
def q12_direct_write(spark, sf_dir):
    mesh, part, price = _part(spark, sf_dir)
    out = mesh.decl_dat(part, 2, "double", None, "v")
    mesh.par_loop(lambda p: {1: [p * 2, p + 1]}, "write", part, arg_dat(price), arg_dat(out, access=WRITE))
    return part.frame.select("id", F.col("v__0").alias("v0"), F.col("v__1").alias("v1"))


@_query("SELECT p_partkey AS id, sqrt(p_retailprice) + p_size AS v FROM part")
def q13_direct_rw(spark, sf_dir):
    mesh, part, price = _part(spark, sf_dir)
    mesh.par_loop(lambda p, s: {0: F.sqrt(p) + s}, "rw", part, arg_dat(price, access=RW), arg_dat(_dat(mesh, "part", "p_size", kind="int")))
    return part.frame.select("id", F.col("p_retailprice").alias("v"))


@_query("SELECT p_partkey AS id, p_retailprice + (p_retailprice + 3.25) AS v FROM part")
def q14_direct_inc(spark, sf_dir):
    mesh, part, price = _part(spark, sf_dir)
    old = mesh.decl_dat(part, 1, "double", lambda i: F.col("p_retailprice"), "old")
    mesh.par_loop(lambda p: {1: p + 3.25}, "inc", part, arg_dat(old), arg_dat(price, access=INC))
    return part.frame.select("id", F.col("p_retailprice").alias("v"))


@_query("SELECT p_partkey AS id, p_retailprice * 1.5 + 0.25 AS v FROM part")
def q15_gbl_read(spark, sf_dir):
    mesh, part, price = _part(spark, sf_dir)
    mesh.par_loop(lambda p, g: {0: p * g[0] + g[1]}, "scale", part, arg_dat(price, access=RW), arg_gbl([1.5, 0.25]))
    return part.frame.select("id", F.col("p_retailprice").alias("v"))


@_query("SELECT CAST(count(*) AS BIGINT) + 100 AS n FROM orders")
def q16_gbl_inc1(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders")
    return mesh.par_loop(lambda: {0: F.lit(1)}, "count", mesh.sets["orders"], arg_gbl(100, INC, "ll")).frame().select(F.col("r0__0").alias("n"))


@_query("SELECT " + ", ".join(f"CAST(sum(CAST(l_linenumber AS BIGINT) * {d + 1}) AS BIGINT) + {d} AS s{d}" for d in range(5)) + " FROM lineitem")
def q17_gbl_inc5(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "lineitem")
    done = mesh.par_loop(lambda n: {1: [n * (d + 1) for d in range(5)]}, "sums", mesh.sets["lineitem"], arg_dat(_dat(mesh, "lineitem", "l_linenumber", kind="int")), arg_gbl(list(range(5)), INC, "ll"))
    return done.frame().select(*[F.col(f"r1__{d}").alias(f"s{d}") for d in range(5)])


def _five(kind, values, access):
    def run(spark, sf_dir):
        mesh = table_mesh(spark, sf_dir, "orders")
        done = mesh.par_loop(lambda p: {1: [p + d for d in range(5)]}, kind, mesh.sets["orders"], arg_dat(_dat(mesh, "orders", "o_totalprice")), arg_gbl(values, access))
        return done.frame().select(*[F.col(f"r1__{d}").alias(f"m{d}") for d in range(5)])

    return run


_LOW, _HIGH = [1e12, 1e12, 0.4, 1e12, 1e12], [0.0, 0.0, 1000000000.4, 0.0, 0.0]
q18_gbl_min5 = _five("least", _LOW, MIN)
q18_gbl_min5.__name__ = "q18_gbl_min5"
_query("SELECT " + ", ".join(f"least(CAST({_LOW[d]!r} AS DOUBLE), min(o_totalprice + {d})) AS m{d}" for d in range(5)) + " FROM orders")(q18_gbl_min5)
q19_gbl_max5 = _five("most", _HIGH, MAX)
q19_gbl_max5.__name__ = "q19_gbl_max5"
_query("SELECT " + ", ".join(f"greatest(CAST({_HIGH[d]!r} AS DOUBLE), max(o_totalprice + {d})) AS m{d}" for d in range(5)) + " FROM orders")(q19_gbl_max5)


def _extremum(access, start):
    def run(spark, sf_dir):
        mesh = table_mesh(spark, sf_dir, "customer", "orders")
        done = mesh.par_loop(lambda p, i, c: {3: p, 4: i, 5: c}, "extremum", mesh.sets["orders"], arg_dat(_dat(mesh, "orders", "o_totalprice")), arg_idx(), arg_idx(0, mesh.maps["orders_customer"]), arg_gbl(start, access), arg_info(-1, 3), arg_info(-1, 3))
        return done.frame().select(F.col("r3__0").alias("v"), F.col("r4__0").cast("bigint").alias("id"), F.col("r5__0").cast("bigint").alias("customer"))

    return run


q20_argmax_info = _extremum(MAX, 0.0)
q20_argmax_info.__name__ = "q20_argmax_info"
_query("SELECT o_totalprice AS v, o_orderkey AS id, o_custkey AS customer FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")(q20_argmax_info)
q21_argmin_info = _extremum(MIN, 1e12)
q21_argmin_info.__name__ = "q21_argmin_info"
_query("SELECT o_totalprice AS v, o_orderkey AS id, o_custkey AS customer FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")(q21_argmin_info)


@_query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice >= 0 OR o_totalprice < 0")
def q22_reduction_in_indirect(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders", "lineitem")
    done = mesh.par_loop(lambda p: {1: F.when(p.isNotNull(), 1).otherwise(0)}, "count", mesh.sets["lineitem"], arg_dat(_dat(mesh, "orders", "o_totalprice"), 0, mesh.maps["lineitem_orders"]), arg_gbl(0, INC, "ll"))
    return done.frame().select(F.col("r1__0").alias("n"))


@_query("SELECT o_orderkey AS id, o_orderkey AS i FROM orders")
def q23_idx_direct(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders")
    out = mesh.decl_dat(mesh.sets["orders"], 1, "ll", None, "i")
    mesh.par_loop(lambda i: {1: i}, "index", mesh.sets["orders"], arg_idx(), arg_dat(out, access=WRITE))
    return mesh.sets["orders"].frame.select("id", F.col("i__0").alias("i"))


@_query("SELECT o_orderkey AS id, " + ", ".join(f"{RING.format(d=d)} AS i{d}" for d in range(3)) + " FROM orders")
def q24_idx_indirect(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    out, m = mesh.decl_dat(mesh.sets["orders"], 3, "ll", None, "i"), mesh.maps["ring"]
    mesh.par_loop(lambda a, b, c: {3: [a, b, c]}, "indices", mesh.sets["orders"], arg_idx(0, m), arg_idx(1, m), arg_idx(2, m), arg_dat(out, access=WRITE))
    return mesh.sets["orders"].frame.select("id", *[F.col(f"i__{d}").alias(f"i{d}") for d in range(3)])


@_query(f"SELECT o_orderkey AS id, o_orderkey * 1000 + {RING.format(d=0)} AS v, CAST(o_custkey AS DOUBLE) AS c FROM orders")
def q25_idx_mixed(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    orders = mesh.sets["orders"]
    v, c = mesh.decl_dat(orders, 1, "ll", None, "v"), mesh.decl_dat(orders, 1, "double", None, "c")
    mesh.par_loop(lambda i, j, k: {3: i * 1000 + j, 4: k.cast("double")}, "mixed", orders, arg_idx(), arg_idx(0, mesh.maps["ring"]), arg_idx(0, mesh.maps["orders_customer"]), arg_dat(v, access=WRITE), arg_dat(c, access=WRITE))
    return orders.frame.select("id", F.col("v__0").alias("v"), F.col("c__0").alias("c"))


_FOUR_CONSTS = (30.1, 40.2, 50.3, 60.4)


@_query("SELECT p_partkey AS id, CAST(20.1 AS DOUBLE) AS c1, " + ", ".join(f"CAST({v} AS DOUBLE) * p_size AS c4_{d}" for d, v in enumerate(_FOUR_CONSTS)) + " FROM part")
def q26_const(spark, sf_dir):
    mesh, part, _ = _part(spark, sf_dir)
    one, four, size = mesh.decl_const("one", 20.1), mesh.decl_const("four", *_FOUR_CONSTS), _dat(mesh, "part", "p_size", kind="int")
    a, b = mesh.decl_dat(part, 1, "double", None, "a"), mesh.decl_dat(part, 4, "double", None, "b")
    mesh.par_loop(lambda s: {1: one.col, 2: [four[d] * s for d in range(4)]}, "consts", part, arg_dat(size), arg_dat(a, access=WRITE), arg_dat(b, access=WRITE))
    return part.frame.select("id", F.col("a__0").alias("c1"), *[F.col(f"b__{d}").alias(f"c4_{d}") for d in range(4)])


def _optional(on: bool):
    def run(spark, sf_dir):
        mesh, part, price = _part(spark, sf_dir)
        size, out = _dat(mesh, "part", "p_size", kind="int"), mesh.decl_dat(part, 1, "double", None, "v")
        mesh.par_loop(lambda p, s, g: {3: p + (0 if s is None else s) + (0 if g is None else g)}, "optional", part, arg_dat(price), opt_arg_dat(on, size), opt_arg_gbl(on, 10.0 if on else None), arg_dat(out, access=WRITE))
        return part.frame.select("id", F.col("v__0").alias("v"))

    return run


q27_opt_on, q28_opt_off = _optional(True), _optional(False)
q27_opt_on.__name__, q28_opt_off.__name__ = "q27_opt_on", "q28_opt_off"
_query("SELECT p_partkey AS id, p_retailprice + p_size + 10.0 AS v FROM part")(q27_opt_on)
_query("SELECT p_partkey AS id, p_retailprice AS v FROM part")(q28_opt_off)


@_query("SELECT o_orderkey AS id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 7 ELSE 0 END AS mark FROM orders")
def q29_indirect_write(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders", "lineitem")
    mesh.frames["lineitem"] = mesh.frames["lineitem"].withColumn("id", F.lit(0).cast("bigint"))  # all writers write the same
    mark = mesh.decl_dat(mesh.sets["orders"], 1, "int", None, "mark")
    mesh.par_loop(lambda: {0: F.lit(7)}, "mark", mesh.sets["lineitem"], arg_dat(mark, 0, mesh.maps["lineitem_orders"], WRITE))
    return mesh.sets["orders"].frame.select("id", F.col("mark__0").alias("mark"))


@_query("SELECT c_custkey AS id, coalesce((SELECT arg_max(o_totalprice, o_orderkey) FROM orders WHERE o_custkey = c_custkey), c_acctbal) AS v FROM customer")
def q29b_indirect_write_last(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "customer", "orders")
    balance = _dat(mesh, "customer", "c_acctbal")
    mesh.par_loop(lambda p: {1: p}, "last", mesh.sets["orders"], arg_dat(_dat(mesh, "orders", "o_totalprice")), arg_dat(balance, 0, mesh.maps["orders_customer"], WRITE))
    return mesh.sets["customer"].frame.select("id", F.col("c_acctbal").alias("v"))


@_query("SELECT s.s_suppkey AS id, s.s_acctbal * 2 + o.s_suppkey AS v FROM supplier s JOIN supplier o ON s.s_suppkey = (o.s_suppkey + 1) % (SELECT count(*) FROM supplier)")
def q30_indirect_rw(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "supplier")
    s = mesh.sets["supplier"]
    n = s.size
    m, balance = mesh.decl_map(s, s, 1, lambda i: (i + 1) % n, "next"), _dat(mesh, "supplier", "s_acctbal")
    mesh.par_loop(lambda i, b: {1: b * 2 + i}, "rw", s, arg_idx(), arg_dat(balance, 0, m, RW))
    return s.frame.select("id", F.col("s_acctbal").alias("v"))


@_query(
    """WITH r0 AS (SELECT c_custkey AS id, (c_custkey + 1) % n AS after, (c_custkey + n - 1) % n AS before, CAST(0 AS DOUBLE) AS u, c_acctbal AS r FROM customer, (SELECT count(*) AS n FROM customer)),
    r1 AS (SELECT a.id, a.after, a.before, a.u + 0.25 * b.u + 0.25 * c.u + a.r - a.u AS u, a.r FROM r0 a JOIN r0 b ON b.id = a.after JOIN r0 c ON c.id = a.before),
    r2 AS (SELECT a.id, a.u + 0.25 * b.u + 0.25 * c.u + a.r - a.u AS u FROM r1 a JOIN r1 b ON b.id = a.after JOIN r1 c ON c.id = a.before)
    SELECT id, round(u, 6) AS u FROM r2"""
)
def q31_jacobi2(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "customer")
    s = mesh.sets["customer"]
    n = s.size
    m, r = mesh.decl_map(s, s, 2, lambda i: [(i + 1) % n, (i + n - 1) % n], "ring"), _dat(mesh, "customer", "c_acctbal")
    u, du = mesh.decl_dat(s, 1, "double", None, "u"), mesh.decl_dat(s, 1, "double", None, "du")
    for _ in range(2):
        mesh.par_loop(lambda near, now: {2: 0.25 * near[0] + 0.25 * near[1] - now}, "res", s, arg_dat(u, -2, m), arg_dat(u), arg_dat(du, access=WRITE))
        mesh.par_loop(lambda d, rr: {2: d + rr}, "update", s, arg_dat(du), arg_dat(r), arg_dat(u, access=INC))
    return s.frame.select("id", F.round("u__0", 6).alias("u"))


def _spmv_sql() -> str:
    at = lambda d: f"((7 * o_orderkey + 11 * {d}) % (SELECT count(*) FROM part))"
    terms = [f"SELECT {at(a)} AS p, {min(a, b) * 4 + max(a, b) + 1} * {_money('x.p_retailprice')} AS v FROM orders JOIN part x ON x.p_partkey = {at(b)}" for a in range(4) for b in range(4)]
    return f"SELECT p_partkey AS id, CAST(coalesce(sum(v), 0) AS DOUBLE) AS v FROM part LEFT JOIN ({' UNION ALL '.join(terms)}) ON p = p_partkey GROUP BY p_partkey"


@_query(_spmv_sql())
def q32_spmv(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "part", "orders")
    n = mesh.sets["part"].size
    m = mesh.decl_map(mesh.sets["orders"], mesh.sets["part"], 4, lambda i: [(7 * i + 11 * d) % n for d in range(4)], "corners")
    v = mesh.decl_dat(mesh.sets["part"], 1, "double", None, "v")
    k = [F.lit(j + 1) for j in range(16)]
    mesh.par_loop(lambda p: {1: element_product(k, [money(x) for x in p])}, "spmv", mesh.sets["orders"], arg_dat(_dat(mesh, "part", "p_retailprice"), -4, m), arg_dat(v, -4, m, INC))
    return mesh.sets["part"].frame.select("id", F.col("v__0").alias("v"))


@_query(f"SELECT CAST(sum({_money('l_quantity')} * {_money('l_extendedprice')}) AS DOUBLE) AS pv FROM lineitem")
def q33_cg_dot(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "lineitem")
    done = mesh.par_loop(lambda p, v: {2: money(p) * money(v)}, "dot", mesh.sets["lineitem"], arg_dat(_dat(mesh, "lineitem", "l_quantity")), arg_dat(_dat(mesh, "lineitem", "l_extendedprice")), arg_gbl(0.0, INC))
    return done.frame().select(F.col("r2__0").alias("pv"))


@_query("SELECT CAST(count(*) AS BIGINT) AS n_entries, CAST(sum(CASE WHEN l_orderkey < 0 OR l_orderkey >= (SELECT count(*) FROM orders) THEN 1 ELSE 0 END) AS BIGINT) AS n_bad FROM lineitem")
def q34_map_check(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders", "lineitem")
    return mesh.check_map(mesh.maps["lineitem_orders"])


@_query("SELECT CAST(count(*) AS BIGINT) AS n_unreferenced, count(*) = 0 AS onto FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q35_is_onto(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders", "lineitem")
    return mesh.unreferenced(mesh.maps["lineitem_orders"]).agg(F.count("*").alias("n_unreferenced")).select("n_unreferenced", (F.col("n_unreferenced") == 0).alias("onto"))


_ADJ = "WITH e AS (" + " UNION ALL ".join(f"SELECT {RING.format(d=a)} AS a, {RING.format(d=b)} AS b FROM orders" for a in range(3) for b in range(3) if a != b) + "), adj AS (SELECT DISTINCT a, b FROM e WHERE a <> b) "


@_query(_ADJ + "SELECT a, b FROM adj")
def q36_adjacency(spark, sf_dir):
    return graph.adjacency(_orders(spark, sf_dir).maps["ring"])


@_query(_ADJ + "SELECT c_custkey AS id, count(a) AS degree FROM customer LEFT JOIN adj ON a = c_custkey GROUP BY c_custkey")
def q37_degree(spark, sf_dir):
    return graph.degree(_orders(spark, sf_dir).maps["ring"])


_R3 = ", ".join(RING.format(d=d) for d in range(3))


@_query(f"SELECT max(greatest({_R3}) - least({_R3})) AS max_bandwidth, avg(greatest({_R3}) - least({_R3})) AS avg_bandwidth FROM orders")
def q38_bandwidth(spark, sf_dir):
    return graph.bandwidth(_orders(spark, sf_dir).maps["ring"])


_CB, _OB = "CAST(c_custkey * 4 // (SELECT count(*) FROM customer) AS INTEGER)", "CAST(o_orderkey * 4 // (SELECT count(*) FROM orders) AS INTEGER)"


@_query(f"SELECT o_orderkey AS id, {_OB} AS part FROM orders")
def q39_part_block(spark, sf_dir):
    return graph.part_block(table_mesh(spark, sf_dir, "orders").sets["orders"], 4)


@_query("SELECT p_partkey AS id, p_size AS part FROM part")
def q40_part_external(spark, sf_dir):
    mesh, _, _ = _part(spark, sf_dir)
    return graph.part_external(_dat(mesh, "part", "p_size", kind="int"))


_CVEC = f"SELECT c_custkey AS cid, {_CB} AS part FROM customer"
_RSLOTS = " UNION ALL ".join(f"SELECT o_orderkey AS o, {d} AS slot, {RING.format(d=d)} AS c FROM orders" for d in range(3))


@_query(f"WITH s AS ({_RSLOTS}), v AS ({_CVEC}), k AS (SELECT o, part, count(*) AS n, min(slot) AS slot FROM s JOIN v ON c = cid GROUP BY o, part) SELECT o AS id, part FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n DESC, slot) AS place FROM k) WHERE place = 1")
def q41_part_propagate_from(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    return graph.propagate_from(mesh.maps["ring"], graph.part_block(mesh.sets["customer"], 4))


@_query(f"WITH s AS ({_RSLOTS}), v AS (SELECT o_orderkey AS oid, {_OB} AS part FROM orders), k AS (SELECT c, part, count(*) AS n FROM s JOIN v ON o = oid GROUP BY c, part) SELECT c AS id, part FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, part) AS place FROM k) WHERE place = 1")
def q42_part_propagate_to(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    return graph.propagate_to(mesh.maps["ring"], graph.part_block(mesh.sets["orders"], 4))


@_query(f"WITH s AS ({_RSLOTS}), v AS ({_CVEC}), k AS (SELECT o, count(DISTINCT part) AS k FROM s JOIN v ON c = cid GROUP BY o) SELECT CAST(count(*) AS BIGINT) AS n_elements, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_cut FROM k")
def q43_edge_cut(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    return graph.edge_cut(mesh.maps["ring"], graph.part_block(mesh.sets["customer"], 4))


_HALO = f"h AS (SELECT DISTINCT a.part AS part, v.part AS owner, c AS id FROM ({_RSLOTS}) s JOIN (SELECT o_orderkey AS oid, {_OB} AS part FROM orders) a ON o = oid JOIN ({_CVEC}) v ON c = cid WHERE a.part <> v.part)"


@_query(f"WITH {_HALO} SELECT part, owner, count(*) AS n FROM h GROUP BY part, owner")
def q44_halo_sizes(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    return graph.halo_sizes(mesh.maps["ring"], graph.part_block(mesh.sets["orders"], 4), graph.part_block(mesh.sets["customer"], 4))


@_query(
    f"""WITH {_HALO}, d AS (SELECT DISTINCT a.part AS part, o_custkey AS id FROM (SELECT o_custkey, {_OB} AS part FROM orders) a JOIN ({_CVEC}) v ON o_custkey = cid WHERE a.part <> v.part),
    e AS (SELECT 'ring' AS map_name, part, id FROM h UNION ALL SELECT 'orders_customer', part, id FROM d), w AS (SELECT count(*) AS halo FROM (SELECT DISTINCT part, id FROM e))
    SELECT map_name, count(*) AS crossing, max(halo) AS halo, count(*) < max(halo) * CAST(0.3 AS DOUBLE) AS partial FROM e, w GROUP BY map_name"""
)
def q45_partial_halo_rule(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    return graph.partial_halo(mesh, mesh.sets["customer"], {s: graph.part_block(mesh.sets[s], 4) for s in ("orders", "customer")})


@_query("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 199")
def q46_fetch_range(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders")
    return mesh.fetch(_dat(mesh, "orders", "o_totalprice"), 100, 199)


_SIZES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@_query(" UNION ALL ".join(f"SELECT '{t}' AS set_name, count(*) AS size, CAST(0 AS BIGINT) AS \"offset\" FROM {t}" for t in _SIZES))
def q47_set_sizes(spark, sf_dir):
    return table_mesh(spark, sf_dir, *_SIZES).sizes()


@_query("SELECT c_custkey AS id, o_totalprice * 2 AS v FROM customer JOIN orders ON o_orderkey = c_custkey")
def q48_temp_overlay(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "customer", "orders")
    over = mesh.decl_dat_overlay(mesh.sets["customer"], _dat(mesh, "orders", "o_totalprice"))
    temp = mesh.decl_dat_temp(mesh.sets["customer"], 1, "double", None, "twice")
    mesh.par_loop(lambda p: {1: p * 2}, "twice", mesh.sets["customer"], arg_dat(over), arg_dat(temp, access=WRITE))
    out = mesh.sets["customer"].frame.select("id", F.col("twice__0").alias("v"))
    assert mesh.free_dat_temp(temp) == 0
    return out


@_query("SELECT label AS id, " + ", ".join(f"CAST(sum(CAST(round(CAST(embedding[{d + 1}] AS DOUBLE) * 10000) AS BIGINT)) AS BIGINT) AS s{d}" for d in range(64)) + " FROM embeddings GROUP BY label")
def q49_embed_inc64(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "embeddings")
    vectors = mesh.sets["embeddings"]
    labels = mesh.adopt_set(vectors.frame.select(F.col("label").cast("bigint").alias("id")).distinct(), "labels")
    m = mesh.decl_map(vectors, labels, 1, lambda i: F.col("label").cast("bigint"), "of")
    values = mesh.decl_dat(vectors, 64, "double", lambda i: [F.col("embedding")[d] for d in range(64)], "e")
    total = mesh.decl_dat(labels, 64, "ll", None, "s")
    mesh.par_loop(lambda v: {1: [F.round(x * 10000).cast("bigint") for x in v]}, "sums", vectors, arg_dat(values), arg_dat(total, 0, m, INC))
    return labels.frame.select(F.col("id").cast("int").alias("id"), *[F.col(f"s__{d}").alias(f"s{d}") for d in range(64)])


@_query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm2 FROM embeddings")
def q50_vec_norm(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "embeddings")
    vectors = mesh.sets["embeddings"]
    values = mesh.decl_dat(vectors, 64, "double", lambda i: [F.col("embedding")[d] for d in range(64)], "e")
    out = mesh.decl_dat(vectors, 1, "double", None, "n")
    mesh.par_loop(lambda v: {1: dot(v, v)}, "norm", vectors, arg_dat(values), arg_dat(out, access=WRITE))
    return vectors.frame.select("id", F.round("n__0", 6).alias("norm2"))


@_query("SELECT p_partkey AS id, CAST(p_partkey + 1 AS BIGINT) AS i FROM part")
def q51_write_index(spark, sf_dir):
    mesh, part, _ = _part(spark, sf_dir)
    d = mesh.decl_dat(part, 1, "ll", None, "i")
    mesh.write_index(d)
    return part.frame.select("id", F.col("i__0").alias("i"))


@_query("SELECT round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice * o_totalprice), 0) AS mean_square FROM orders")
def q52_moments(spark, sf_dir):
    return table_mesh(spark, sf_dir, "orders").frames["orders"].agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.avg(F.col("o_totalprice") * F.col("o_totalprice")), 0).alias("mean_square"))


@_query("SELECT count(*) AS n, count(*) AS n_new, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high FROM part")
def q53_renumber_check(spark, sf_dir):
    mesh, _, _ = _part(spark, sf_dir)
    return graph.check_order(graph.order_geometric(_dat(mesh, "part", ["p_size", "p_retailprice"], "place")))


@_query(f"WITH s AS ({_RSLOTS}), o AS (SELECT c_custkey AS cid, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS new FROM customer), l AS (SELECT o.o, min(new) AS low FROM s o JOIN o n ON c = cid GROUP BY o.o) SELECT o AS id, row_number() OVER (ORDER BY low, o) - 1 AS new FROM l")
def q54_renumber_propagate(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    order = graph.ranked(mesh.frames["customer"], ["c_acctbal", "id"])
    return graph.renumber_sources(mesh.maps["ring"], order)


@_query(f"WITH s AS ({_RSLOTS}), a AS (SELECT o_orderkey AS oid, {_OB} AS part FROM orders), v AS ({_CVEC}), t AS (SELECT o, a.part AS part, v.part AS owner FROM s JOIN a ON o = oid JOIN v ON c = cid), k AS (SELECT o, part, max(CASE WHEN part <> owner THEN 1 ELSE 0 END) AS x FROM t GROUP BY o, part) SELECT part, CASE WHEN x = 0 THEN 'core' ELSE 'boundary' END AS kind, count(*) AS n FROM k GROUP BY part, kind UNION ALL SELECT owner, 'imported', count(DISTINCT o) FROM t WHERE part <> owner GROUP BY owner")
def q55_halo_regions(spark, sf_dir):
    mesh = _orders(spark, sf_dir)
    return graph.halo_regions(mesh.maps["ring"], graph.part_block(mesh.sets["orders"], 4), graph.part_block(mesh.sets["customer"], 4))


@_query("SELECT p_brand, p_size, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS place FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size)) WHERE place = 1")
def q56_mode(spark, sf_dir):
    return graph.mode(table_mesh(spark, sf_dir, "part").frames["part"], "p_brand", "p_size")


@_query("SELECT p_size, n, CAST(coalesce(sum(n) OVER (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size)")
def q57_prefix_offsets(spark, sf_dir):
    counts = table_mesh(spark, sf_dir, "part").frames["part"].groupBy("p_size").agg(F.count("*").alias("n"))
    return graph.prefix_offsets(counts, "p_size", "n")


@_query("SELECT o_orderkey AS id, o_totalprice + 1.0 AS v FROM orders")
def q58_gbl_work(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders")
    out = mesh.decl_dat(mesh.sets["orders"], 1, "double", None, "v")
    mesh.par_loop(lambda p, w: {2: p + w}, "work", mesh.sets["orders"], arg_dat(_dat(mesh, "orders", "o_totalprice")), arg_gbl(1.0, WORK), arg_dat(out, access=WRITE))
    return mesh.sets["orders"].frame.select("id", F.col("v__0").alias("v"))


@_query("SELECT o_totalprice AS v FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def q59_gbl_write(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders")
    return mesh.par_loop(lambda p: {1: p}, "last", mesh.sets["orders"], arg_dat(_dat(mesh, "orders", "o_totalprice")), arg_gbl(0.0, WRITE)).frame().select(F.col("r1__0").alias("v"))


@_query("SELECT o_custkey AS id, count(*) AS n_writers FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def q60_write_conflicts(spark, sf_dir):
    from meshloom.operators.planner import conflicts

    mesh = table_mesh(spark, sf_dir, "customer", "orders")
    return conflicts(mesh.sets["orders"], arg_dat(_dat(mesh, "customer", "c_acctbal"), 0, mesh.maps["orders_customer"], WRITE))


@_query("SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_suppkey <> y.l_suppkey")
def q61_dual_graph(spark, sf_dir):
    mesh = table_mesh(spark, sf_dir, "orders", "supplier", "lineitem")
    return graph.dual_graph(mesh.maps["lineitem_supplier"], mesh.maps["lineitem_orders"])


@_query(
    "WITH n AS (SELECT i AS id, i % 11 AS x, i // 11 AS y FROM range(121) t(i)),"
    " r AS (SELECT *, 0.25::DOUBLE * ((x = 0)::INT + (x = 10)::INT + (y = 0)::INT + (y = 10)::INT) AS r FROM n),"
    " near AS (SELECT a.id, sum(b.r) AS s FROM r a JOIN r b ON (b.y = a.y AND b.x IN (a.x - 1, a.x + 1)) OR (b.x = a.x AND b.y IN (a.y - 1, a.y + 1)) GROUP BY a.id)"
    " SELECT r.id, r.r + 0.25::DOUBLE * near.s AS u__0 FROM r JOIN near ON near.id = r.id"
)
def q70_jacobi_grid(spark, sf_dir):
    from meshloom.plans import apps
    from meshloom.sources import generate

    mesh = generate.jacobi(spark, 12)
    apps.jacobi(mesh, 2)
    return mesh.fetch(mesh.dats["nodes", "u"])


@_query()
def q71_finite_volume(spark, sf_dir):
    from meshloom.plans import apps

    return apps.flow_state(spark)


@_query()
def q74_wing_flow(spark, sf_dir):
    """A time step round a wing, what it works with declared and freed within the step."""
    from meshloom.functions.kernels import Gas
    from meshloom.plans import apps
    from meshloom.sources import generate

    mesh, gas = generate.wing(spark, 8, 6), Gas()
    apps.start_flow(mesh, gas, temporary=True)
    apps.flow(mesh, gas, 1, temporary=True)
    return mesh.fetch(mesh.dats["cells", "q"])


@_query()
def q75_potential_flow(spark, sf_dir):
    """Two of Newton's rounds for potential flow round a wing."""
    from meshloom.functions.kernels import Potential
    from meshloom.plans import apps
    from meshloom.sources import generate

    mesh = generate.wing_elements(spark, 4, 3)
    apps.potential_flow(mesh, Potential(), rounds=2)
    return mesh.fetch(mesh.dats["nodes", "phi"])


@_query()
def q72_part_geometric(spark, sf_dir):
    mesh, _, _ = _part(spark, sf_dir)
    return graph.part_geometric(_dat(mesh, "part", ["p_size", "p_retailprice"], "place"), 4)


@_query()
def q73_part_inertial(spark, sf_dir):
    mesh, part, _ = _part(spark, sf_dir)
    place = mesh.decl_dat(part, 3, "double", lambda i: [F.col("p_size"), F.col("p_retailprice"), i % 7], "place")
    return graph.part_inertial(place, 4)


from meshloom.plans import interfaces  # noqa: E402, F401  registers its queries here
