"""The driver's tables read as a mesh: each keyed table is a set, each foreign key a map."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshloom.operators.model import Mesh

#: Table, its key, and its foreign keys.
SETS = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"region": "n_regionkey"}),
    "customer": ("c_custkey", {"nation": "c_nationkey"}),
    "supplier": ("s_suppkey", {"nation": "s_nationkey"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"customer": "o_custkey"}),
    "events": ("event_id", {"customer": "user_id"}),
    "embeddings": ("vec_id", {}),
    "lineitem": (None, {"orders": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"}),
}


def table_mesh(spark: SparkSession, sf_dir: str, *names: str) -> Mesh:
    """A mesh of the named tables, their foreign keys among them being maps ``table_target``."""
    mesh = Mesh(spark)
    for name in names:
        mesh.adopt_set(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name, SETS[name][0])
    for name in names:
        for target, column in SETS[name][1].items():
            if target in mesh.sets:
                mesh.frames[name] = mesh.frames[name].withColumn(f"{name}_{target}", F.col(column).cast("bigint"))
                mesh.adopt_map(mesh.sets[name], mesh.sets[target], [f"{name}_{target}"], f"{name}_{target}")
    return mesh
