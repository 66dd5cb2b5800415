"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meshloom.llm.common import remove, scratch

#: A hub's edges meet its smallest neighbour in this many tasks.
SALTS = 8


def _smallest(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and its neighbours v; the hub's rows are dealt by salt, and nothing is broadcast."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least.hint("merge"), ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than u is tied to the least of u's neighbourhood."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    return _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them; edges have u > v."""
    tied = _smallest(edges)
    return tied.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v) but the roots, root being the component's least node.

    Each round is one written table in the shared folder; the loop ends when a
    round changes nothing. Its rounds grow with the logarithm of the nodes.
    """
    spark, mark, old = edges.sparkSession, None, None
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        seen, path = Observation(), scratch(spark, "stars")
        _small_star(_large_star(now)).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).write.parquet(path)
        if old is not None:  # this round has read it
            remove(spark, old)
        old = path
        now, at = spark.read.schema("u long, v long").parquet(path), (seen.get["n"], seen.get["s"])
        if at == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = at
