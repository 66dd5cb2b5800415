"""Shared plumbing of the training-data operators: inputs, shared folders, ordered cells."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that count as white space between words.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where neither the setting nor a checkpoint folder exists, and the master
    is this process (as in tests), a folder of this machine is set; on a cluster
    that is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + os.path.join(tempfile.gettempdir(), "meshloom-checkpoints")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/meshloom/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.meshloom_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of ours in the shared folder."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.meshloom_path)


def filesystem(uri: str):
    """Arrow's file system and the path in it for a URI such as ``file:///x`` or ``hdfs://n/x``."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write byte strings to a file by a name of this attempt and move it into place.

    A repeated task writes the same bytes to the same final name.
    """
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own, n = f"{path}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(own) as out:
        for x in parts:
            out.write(x)
            n += len(x)
    fs.move(own, path)
    return n


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(id, text) with a null text as empty; columns that clash or are extra go."""
    return docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *more)


def slices(batches, rows: int = 1000):
    """The batches in slices of so few rows that their Python objects are small."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def give_back() -> None:
    """Return to the system what this process has freed: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run):
    """A task's function that gives freed memory back before and after it: Python workers outlive their stage."""

    def lean_run(batches):
        give_back()
        yield from run(batches)
        give_back()

    return lean_run


def row_key(i: Column, digest: Column) -> Column:
    """One text for an id, null or not, and a digest of the row's text."""
    return F.concat(F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), digest)


def keep_rows(docs: DataFrame, key: Column, kept: DataFrame, first: Column | None = None) -> DataFrame:
    """All columns of the ``docs`` whose key is among ``kept``'s only column; of rows that share a key, the first by ``first``."""
    own, other = "__meshloom_key", kept.toDF("__meshloom_kept")
    found = docs.withColumn(own, key).join(other, F.col(own) == F.col("__meshloom_kept"), "left_semi")
    place = F.row_number().over(Window.partitionBy(own).orderBy(F.lit(0) if first is None else first))
    return found.withColumn("__meshloom_place", place).where("__meshloom_place = 1").select(*[found[c] for c in docs.columns])


#: Bytes of texts that a cell has on the average, on a small table the least, and the most cells there are; beyond, cells grow and are streamed.
CELL_BYTES, LEAST_BYTES, MOST_CELLS = 16 << 20, 1 << 20, 8192


class Cells:
    """Contiguous ranges of ids, in order, so that work on ordered rows needs no global sort.

    The number of cells follows the bytes of the texts, their bounds are
    quantiles of the ids, so that neither far-off ids nor the partitions make a
    cell large. Any 64-bit ids will do. A null id counts as smaller than all
    others. A bound is the least id of its cell; the driver holds the bounds
    alone, ``MOST_CELLS`` at most. A table is read once more, ids and lengths.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CELL_BYTES):
        i = docs[id_col].cast("long")
        total, nulls, lo = docs.agg(F.sum(F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long") + 64), F.max(i.isNull()), F.min(i)).first()
        # Smaller cells on a small table, two for each partition, so that no task has many.
        few = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = min(MOST_CELLS, max(1, -(-(total or 0) // size), min(few, (total or 0) // LEAST_BYTES)))
        found = docs.agg(F.percentile_approx(i, [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else None
        self.bounds = sorted({x for x in (lo, *(found or ())) if x is not None})
        self.nulls = bool(nulls)

    def __len__(self) -> int:
        return max(1, len(self.bounds))

    def of(self, i: Column) -> Column:
        """2 * cell of an id, and 1 more where the id is the least of its cell; of a null id as of what is less than all ids."""
        bounds = np.array(self.bounds, dtype=np.int64)

        @F.arrow_udf("long")
        def place(ids: pa.Array) -> pa.Array:
            cells = np.zeros(len(ids), np.int64)
            if len(bounds):
                own = ids.drop_null().to_numpy(zero_copy_only=False)
                at = np.searchsorted(bounds, own, side="right") - 1
                cells[ids.is_valid().to_numpy(zero_copy_only=False)] = 2 * at + (bounds[at] == own)
            return pa.array(cells)

        return place(i)
