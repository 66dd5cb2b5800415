"""Sets, maps, dats and constants over DataFrames: one frame for each set.

A frame has the key column ``id`` (0 .. size-1), one column for each component
of each dat, and one ``bigint`` column for each slot of each map from the set.
Frames are immutable; a loop that writes makes a new version of a frame.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type names that declarations accept, and Spark's.
TYPES = {
    "double": "double", "r8": "double", "real*8": "double", "real(8)": "double",
    "float": "float", "r4": "float", "real*4": "float", "real(4)": "float",
    "int": "int", "i4": "int", "integer*4": "int", "integer(4)": "int",
    "bool": "boolean", "uint": "bigint", "ll": "bigint", "long": "bigint", "long long": "bigint", "ull": "decimal(20,0)",
}
NUMERIC = ("double", "float", "int", "bigint")


class MeshError(ValueError):
    """A declaration or an argument that breaks the model's rules."""


def spark_type(name: str) -> str:
    """Spark's type for a declared one; the layout suffix ``:soa`` means nothing here."""
    name = name.removesuffix(":soa")
    if name not in TYPES:
        raise MeshError(f"no such type: {name}")
    return TYPES[name]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names; one of this machine only where the master is this process."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise MeshError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="meshloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return there.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written as a table to the shared folder and read again, without its lineage.

    A checkpoint would keep the optimizer's estimate of the size, which is a
    product over joins: from one time step to the next its digits multiply,
    until planning does nothing else. A table has its true size, and later
    loops read only the columns they need.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/meshloom-cut/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def pinned(frame: DataFrame) -> DataFrame:
    """The frame by a checkpoint, for jobs that need the same rows in the same partitions again."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


@dataclass(eq=False)
class MeshSet:
    mesh: Mesh
    name: str
    index: int
    _size: int | None = None

    @property
    def frame(self) -> DataFrame:
        return self.mesh.frames[self.name]

    @property
    def size(self) -> int:
        if self._size is None:
            self._size = self.frame.count()
        return self._size


@dataclass(eq=False)
class MeshMap:
    source: MeshSet
    target: MeshSet
    columns: list[str]
    name: str
    forced: bool = False

    @property
    def dim(self) -> int:
        return len(self.columns)


@dataclass(eq=False)
class Dat:
    set: MeshSet
    columns: list[str]
    type: str
    name: str
    temporary: bool = False
    version: int = 0
    overlays: Dat | None = None

    @property
    def dim(self) -> int:
        return len(self.columns)


@dataclass(frozen=True)
class Const:
    name: str
    values: tuple

    def __getitem__(self, k: int) -> Column:
        return F.lit(self.values[k])

    @property
    def col(self) -> Column:
        return F.lit(self.values[0])


@dataclass(eq=False)
class Mesh:
    """The registry of one problem."""

    spark: SparkSession
    diags: int = 1
    frames: dict[str, DataFrame] = field(default_factory=dict)
    sets: dict[str, MeshSet] = field(default_factory=dict)
    maps: dict[str, MeshMap] = field(default_factory=dict)
    dats: dict[tuple[str, str], Dat] = field(default_factory=dict)
    consts: dict[str, Const] = field(default_factory=dict)
    partitions: dict[str, DataFrame] = field(default_factory=dict)
    profiler: Any = None

    def __post_init__(self):
        if self.profiler is None:
            from meshloom.operators.profile import Profiler

            self.profiler = Profiler()

    def close(self) -> None:
        for f in self.frames.values():
            f.unpersist()
        for d in (self.frames, self.sets, self.maps, self.dats, self.consts):
            d.clear()

    # Declarations ---------------------------------------------------------------

    def decl_set(self, size: int, name: str) -> MeshSet:
        if size < 0:
            raise MeshError(f"set {name}: negative size {size}")
        return self._add_set(name, self.spark.range(size), size)

    def adopt_set(self, frame: DataFrame, name: str, id_col: str | None = "id") -> MeshSet:
        """A frame that exists; without an id column its element index can't be observed."""
        if id_col is not None and id_col != "id":
            frame = frame.withColumn("id", F.col(id_col).cast("bigint"))
        return self._add_set(name, frame, None)

    def _add_set(self, name, frame, size) -> MeshSet:
        if name in self.sets:
            raise MeshError(f"set {name} is declared twice")
        self.sets[name] = MeshSet(self, name, len(self.sets), size)
        self.frames[name] = frame
        return self.sets[name]

    def decl_map(self, source: MeshSet, target: MeshSet, dim: int, data, name: str, base: int = 0) -> MeshMap:
        """``data``: a DataFrame (id and ``dim`` columns), row-major numbers, or a function of the id column that gives ``dim`` columns."""
        self._check_sets(source, target)
        if dim <= 0:
            raise MeshError(f"map {name}: dim {dim}")
        columns = [f"{name}__{k}" for k in range(dim)]
        self._attach(source, columns, ["bigint"] * dim, data)
        if base:
            self.frames[source.name] = source.frame.withColumns({c: F.col(c) - base for c in columns})
        return self.adopt_map(source, target, columns, name)

    def adopt_map(self, source: MeshSet, target: MeshSet, columns: Sequence[str], name: str) -> MeshMap:
        self._check_sets(source, target)
        if not columns:
            raise MeshError(f"map {name}: dim 0")
        self.maps[name] = MeshMap(source, target, list(columns), name)
        return self.maps[name]

    def decl_dat(self, on: MeshSet, dim: int, type_: str, data, name: str, temporary: bool = False) -> Dat:
        """``data``: None for zeros, a DataFrame (id and ``dim`` columns), row-major numbers, or a function of the id column."""
        self._check_sets(on)
        if dim <= 0:
            raise MeshError(f"dat {name}: dim {dim}")
        kind, columns = spark_type(type_), [f"{name}__{k}" for k in range(dim)]
        if (on.name, name) in self.dats:
            raise MeshError(f"dat {name} on {on.name} is declared twice")
        if data is None:
            zero = F.lit(False) if kind == "boolean" else F.lit(0).cast(kind)
            self.frames[on.name] = on.frame.withColumns({c: zero for c in columns})
        else:
            self._attach(on, columns, [kind] * dim, data)
        return self.adopt_dat(on, columns, type_, name, temporary)

    def adopt_dat(self, on: MeshSet, columns: Sequence[str], type_: str, name: str, temporary: bool = False) -> Dat:
        self._check_sets(on)
        spark_type(type_)
        self.dats[on.name, name] = Dat(on, list(columns), type_, name, temporary)
        return self.dats[on.name, name]

    def decl_dat_temp(self, on: MeshSet, dim: int, type_: str, data, name: str) -> Dat:
        return self.decl_dat(on, dim, type_, data, name, temporary=True)

    def free_dat_temp(self, dat: Dat) -> int:
        """0, or -1 where there is no such temporary dat."""
        if self.dats.get((dat.set.name, dat.name)) is not dat or not dat.temporary:
            return -1
        del self.dats[dat.set.name, dat.name]
        self.frames[dat.set.name] = dat.set.frame.drop(*dat.columns)
        return 0

    def decl_dat_overlay(self, on: MeshSet, dat: Dat) -> Dat:
        """The dat's values seen on a set that isn't larger, the prefix of its ids; ``write_back`` carries changes over."""
        if on.size > dat.set.size:
            raise MeshError(f"overlay of {dat.name}: {on.name} is larger than {dat.set.name}")
        columns = [f"{dat.name}__on__{on.name}__{k}" for k in range(dat.dim)]
        own = dat.set.frame.where(F.col("id") < on.size).select("id", *[F.col(c).alias(n) for c, n in zip(dat.columns, columns, strict=True)])
        self.frames[on.name] = on.frame.join(own, "id")
        new = self.adopt_dat(on, columns, dat.type, f"{dat.name}__on__{on.name}")
        new.overlays = dat
        return new

    def write_back(self, overlay: Dat) -> None:
        dat = overlay.overlays
        if dat is None:
            raise MeshError(f"{overlay.name} is no overlay")
        own = overlay.set.frame.select("id", *[F.col(c).alias(f"__new__{k}") for k, c in enumerate(overlay.columns)], F.lit(True).alias("__has"))
        f = dat.set.frame.join(own, "id", "left")
        f = f.withColumns({c: F.when(F.col("__has"), F.col(f"__new__{k}")).otherwise(F.col(c)) for k, c in enumerate(dat.columns)})
        self.frames[dat.set.name] = f.drop("__has", *[f"__new__{k}" for k in range(dat.dim)])
        dat.version += 1

    def decl_const(self, name: str, *values) -> Const:
        if not values or name in self.consts:
            raise MeshError(f"const {name}: " + ("declared twice" if values else "dim 0"))
        self.consts[name] = Const(name, tuple(values))
        return self.consts[name]

    def _attach(self, on: MeshSet, columns, kinds, data) -> None:
        if callable(data):
            made = data(F.col("id"))
            made = list(made) if isinstance(made, (list, tuple)) else [made]
            if len(made) != len(columns):
                raise MeshError(f"{len(made)} columns for dim {len(columns)}")
            self.frames[on.name] = on.frame.withColumns({c: m.cast(k) for c, k, m in zip(columns, kinds, made, strict=True)})
            return
        if not isinstance(data, DataFrame):
            import numpy as np
            import pandas as pd

            values = np.asarray(data).reshape(-1, len(columns))
            if len(values) != on.size:
                raise MeshError(f"{len(values)} elements for {on.name}, which has {on.size}")
            data = self.spark.createDataFrame(pd.DataFrame({"id": np.arange(len(values)), **{c: values[:, k] for k, c in enumerate(columns)}}))
        own = [c for c in data.columns if c != "id"]
        if len(own) != len(columns):
            raise MeshError(f"{len(own)} columns for dim {len(columns)}")
        renamed = data.select(F.col("id").cast("bigint").alias("id"), *[F.col(c).cast(k).alias(n) for c, k, n in zip(own, kinds, columns, strict=True)])
        self.frames[on.name] = on.frame.join(renamed, "id")

    def _check_sets(self, *sets) -> None:
        for s in sets:
            if s is None or self.sets.get(s.name) is not s:
                raise MeshError(f"{s.name if s else None} isn't a set of this mesh")

    # Registry -------------------------------------------------------------------

    def search_dat(self, on: MeshSet, dim: int, type_: str, name: str) -> Dat | None:
        d = self.dats.get((on.name, name))
        return d if d is not None and d.dim == dim and spark_type(d.type) == spark_type(type_) else None

    def get_set(self, name: str) -> MeshSet | None:
        return self.sets.get(name)

    def get_map(self, name: str) -> MeshMap | None:
        return self.maps.get(name)

    def force_part(self, m: MeshMap) -> None:
        m.forced = True

    @staticmethod
    def same_set(a: MeshSet, b: MeshSet) -> bool:
        return a is b

    def sizes(self) -> DataFrame:
        """(name, size, first global index) of every set, counted in one job for each."""
        out = None
        for s in self.sets.values():
            one = s.frame.agg(F.count("*").alias("size")).select(F.lit(s.name).alias("set_name"), "size", F.lit(0).cast("bigint").alias("offset"))
            out = one if out is None else out.unionByName(one)
        return out

    def describe(self) -> DataFrame:
        """What is declared: kind, name, set(s), dim, type."""
        rows = [("set", s.name, "", 0, "") for s in self.sets.values()]
        rows += [("map", m.name, f"{m.source.name}->{m.target.name}", m.dim, "bigint") for m in self.maps.values()]
        rows += [("dat", d.name, d.set.name, d.dim, d.type) for d in self.dats.values()]
        return self.spark.createDataFrame(rows, "kind string, name string, on_set string, dim int, type string")

    # Checks ---------------------------------------------------------------------

    def check_map(self, m: MeshMap) -> DataFrame:
        """One row: entries in all, and those outside [0, size of the target)."""
        n = m.target.size
        bad = sum((F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) >= n)).cast("bigint") for c in m.columns)
        return m.source.frame.agg((F.count("*") * m.dim).alias("n_entries"), F.coalesce(F.sum(bad), F.lit(0)).alias("n_bad"))

    def unreferenced(self, m: MeshMap) -> DataFrame:
        """The ids of target elements that no slot names."""
        named = m.source.frame.select(F.explode(F.array(*m.columns)).alias("id")).distinct()
        return m.target.frame.select("id").join(named, "id", "left_anti")

    def is_onto(self, m: MeshMap) -> bool:
        return self.unreferenced(m).isEmpty()

    # Fetching -------------------------------------------------------------------

    def fetch(self, dat: Dat, low: int | None = None, high: int | None = None) -> DataFrame:
        """id and components in the order of the elements; low and high are inclusive."""
        f = dat.set.frame.select("id", *dat.columns)
        if low is not None or high is not None:
            lo, hi = low or 0, dat.set.size - 1 if high is None else high
            if lo < 0 or hi >= dat.set.size or lo > hi:
                raise MeshError(f"range {lo}..{hi} of {dat.set.size} elements")
            f = f.where(F.col("id").between(lo, hi))
        return f.orderBy("id")

    def show(self, dat: Dat, most: int = 100) -> None:
        """Print the first elements of a dat, in order."""
        print(f"{dat.name} on {dat.set.name}: {dat.set.size} elements of {dat.dim}")
        for row in self.fetch(dat).limit(most).collect():
            print(row[0], *row[1:])

    def write_index(self, dat: Dat) -> None:
        """Each element's index, counted from 1."""
        self.frames[dat.set.name] = dat.set.frame.withColumns({c: (F.col("id") + 1).cast(spark_type(dat.type)) for c in dat.columns})
        dat.version += 1

    def checkpoint(self, *sets: MeshSet) -> None:
        """Cut the lineage of the sets' frames in the shared checkpoint folder."""
        for s in sets or tuple(self.sets.values()):
            self.frames[s.name] = cut(s.frame)

    def par_loop(self, kernel, name: str, on: MeshSet, *args, **options):
        from meshloom.operators.planner import par_loop

        return par_loop(self, kernel, name, on, *args, **options)
