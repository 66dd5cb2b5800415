"""One parallel loop as one DataFrame plan.

Gathers are one equi-join for each map slot that any argument reads, carrying
all that is read through it. The kernel is called once, with Columns, and
returns its outputs by argument position. Direct outputs make a new version of
the iteration set's frame; indirect ones are spread to rows of (target,
values), aggregated before they are shuffled, and joined to their target set;
reductions are one aggregate of the kernel's output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.operators.args import INC, MAX, MIN, READ, RW, WORK, WRITE, DatArg, GlobalArg, IndexArg, InfoArg
from meshloom.operators.model import NUMERIC, Mesh, MeshError, MeshSet, cut, spark_type


@dataclass
class LoopResult:
    """The kernel's output with what reductions need; nothing runs before it is asked for."""

    applied: DataFrame
    reductions: list[tuple[int, GlobalArg | InfoArg, list[Column]]]

    def frame(self) -> DataFrame:
        """One row: r{position}__{component} of every reduction, merged with its initial value."""
        columns = [c for _, _, own in self.reductions for c in own]
        if not columns:
            raise MeshError("the loop has no reduction")
        return self.applied.agg(*columns)

    def values(self) -> dict[int, list]:
        """The merged values by argument position; runs one job for all of them."""
        row = self.frame().first()
        return {k: [row[f"r{k}__{j}"] for j in range(len(own))] for k, _, own in self.reductions}


def _check(mesh: Mesh, on: MeshSet, args) -> None:
    for k, a in enumerate(args):
        if isinstance(a, (DatArg, IndexArg)) and getattr(a, "on", True):
            m = a.map
            if isinstance(a, DatArg):
                if mesh.dats.get((a.dat.set.name, a.dat.name)) is not a.dat:
                    raise MeshError(f"argument {k}: {a.dat.name} isn't declared")
                if a.access in (MIN, MAX, WORK):
                    raise MeshError(f"argument {k}: {a.access.name} of a dat")
                if a.dim is not None and a.dim != a.dat.dim:
                    raise MeshError(f"argument {k}: dim {a.dim}, but {a.dat.name} has {a.dat.dim}")
                if a.type is not None and spark_type(a.type) != spark_type(a.dat.type):
                    raise MeshError(f"argument {k}: type {a.type}, but {a.dat.name} has {a.dat.type}")
            if m is None:
                if a.idx != -1:
                    raise MeshError(f"argument {k}: index {a.idx} without a map")
                if isinstance(a, DatArg) and a.dat.set is not on:
                    raise MeshError(f"argument {k}: {a.dat.name} lives on {a.dat.set.name}, the loop runs over {on.name}")
                continue
            if mesh.maps.get(m.name) is not m:
                raise MeshError(f"argument {k}: map {m.name} isn't declared")
            if m.source is not on:
                raise MeshError(f"argument {k}: map {m.name} is from {m.source.name}, the loop runs over {on.name}; two steps aren't possible")
            if not -m.dim <= a.idx < m.dim:
                raise MeshError(f"argument {k}: slot {a.idx} of {m.dim}")
            if isinstance(a, DatArg) and m.target is not a.dat.set:
                raise MeshError(f"argument {k}: map {m.name} leads to {m.target.name}, {a.dat.name} lives on {a.dat.set.name}")
            if isinstance(a, IndexArg) and a.idx < 0:
                raise MeshError(f"argument {k}: an index argument takes one slot")
        elif isinstance(a, GlobalArg) and a.on:
            if a.access is RW:
                raise MeshError(f"argument {k}: a global read and written depends on the order of elements")
            if a.access in (INC, MIN, MAX) and spark_type(a.type) not in (NUMERIC if a.access is INC else (*NUMERIC, "boolean")):
                raise MeshError(f"argument {k}: {a.type} can't be reduced")
        elif isinstance(a, InfoArg):
            if not 0 <= a.ref < len(args) or not isinstance(args[a.ref], GlobalArg) or args[a.ref].access not in (MIN, MAX):
                raise MeshError(f"argument {k}: position {a.ref} is no MIN or MAX argument")
        elif not isinstance(a, (GlobalArg, DatArg)):
            raise MeshError(f"argument {k} is no argument")


def _one(columns: list[Column]):
    return columns[0] if len(columns) == 1 else columns


def _listed(value) -> list[Column]:
    return [v if isinstance(v, Column) else F.lit(v) for v in (value if isinstance(value, (list, tuple)) else [value])]


def _gathered(mesh: Mesh, base: DataFrame, args) -> tuple[DataFrame, dict]:
    """The frame joined once for each slot that is read; where each (map, slot, dat) is found.

    An entry that leads to no element stops the loop with the map's name when
    its value is asked for; no row goes for it.
    """
    wanted: dict[tuple[str, int], dict[str, list[str]]] = {}
    for a in args:
        if isinstance(a, DatArg) and a.on and a.map is not None and a.access in (READ, RW):
            for s in a.slots:
                wanted.setdefault((a.map.name, s), {})[a.dat.name] = a.dat.columns
    found = {}
    for k, ((name, slot), dats) in enumerate(wanted.items()):
        m = mesh.maps[name]
        columns = sorted({c for own in dats.values() for c in own})
        side = m.target.frame.select(F.col("id").alias(f"__g{k}"), *[F.col(c).alias(f"__g{k}__{c}") for c in columns])
        entry = F.col(m.columns[slot])
        base = base.join(side, entry == F.col(f"__g{k}"), "left")
        bad = F.raise_error(F.concat(F.lit(f"map {name}, slot {slot}, leads to no element of {m.target.name}: "), F.coalesce(entry.cast("string"), F.lit("null"))))
        found |= {(name, slot, d): [F.when(F.col(f"__g{k}").isNull(), bad).otherwise(F.col(f"__g{k}__{c}")) for c in own] for d, own in dats.items()}
    return base, found


def _inputs(args, found) -> list:
    out: list = []
    for a in args:
        if isinstance(a, DatArg):
            if not a.on:
                out.append(None)
            elif a.access in (WRITE, INC):
                continue
            elif a.map is None:
                out.append(_one([F.col(c) for c in a.dat.columns]))
            elif a.idx >= 0:
                out.append(_one(found[a.map.name, a.idx, a.dat.name]))
            else:
                out.append([_one(found[a.map.name, s, a.dat.name]) for s in a.slots])
        elif isinstance(a, GlobalArg):
            if not a.on:
                out.append(None)
            elif a.access in (READ, WORK):
                out.append(_one([F.lit(v) for v in a.values]))
        elif isinstance(a, IndexArg):
            out.append(F.col("id") if a.map is None else F.col(a.map.columns[a.idx]))
    return out


def _reduction(k: int, a: GlobalArg, values: list[str], has_id: bool) -> list[Column]:
    kind = spark_type(a.type)
    out = []
    for j, (c, start) in enumerate(zip(values, a.values, strict=True)):
        v, first = F.col(c), F.lit(start)
        number = F.when(~F.isnan(v), v) if a.access in (MIN, MAX) and kind in ("double", "float") else v
        if kind == "boolean" and a.access in (MIN, MAX):  # whether all are, or any is
            new = first & F.coalesce(F.bool_and(v), F.lit(True)) if a.access is MIN else first | F.coalesce(F.bool_or(v), F.lit(False))
        elif a.access is INC:
            new = F.coalesce(F.sum(v).cast(kind), F.lit(0).cast(kind)) + first.cast(kind)
        elif a.access is MIN:
            new = F.least(first.cast(kind), F.min(number).cast(kind))
        elif a.access is MAX:
            new = F.greatest(first.cast(kind), F.max(number).cast(kind))
        else:  # WRITE: the value of the greatest id
            new = F.coalesce(F.max_by(v, F.col("id")) if has_id else F.max(v), first).cast(kind)
        out.append(new.cast(kind).alias(f"r{k}__{j}"))
    return out


def _payload(k: int, a: InfoArg, ref: GlobalArg, values: list[str], decides: str) -> list[Column]:
    """The payload of the element that improves most on the initial value, the smallest id of ties."""
    v, start = F.col(decides), F.lit(ref.values[0])
    better = v > start if ref.access is MAX else v < start
    if spark_type(ref.type) in ("double", "float"):
        better = better & ~F.isnan(v)
    place = F.struct(v.alias("v"), (-F.col("id") if ref.access is MAX else F.col("id")).alias("i"), *[F.col(c).alias(f"p{j}") for j, c in enumerate(values)])
    best = (F.max if ref.access is MAX else F.min)(F.when(better, place))
    return [F.coalesce(best.getField(f"p{j}"), F.lit(start)).alias(f"r{k}__{j}") for j, start in enumerate(a.values)]


def par_loop(mesh: Mesh, kernel: Callable, name: str, on: MeshSet, *args, checkpoint: bool = False) -> LoopResult:
    """Run ``kernel`` over every element of ``on``; it gets the inputs in order and returns outputs by position.

    Inputs are what is read: dats (READ, RW), globals (READ, WORK), indices; an
    argument that is off is None. Outputs are dats (WRITE, RW: the new value,
    INC: the increment), globals (INC, MIN, MAX, WRITE: the element's share)
    and payloads (info).
    """
    _check(mesh, on, args)
    with mesh.profiler.kernel(name):
        base, found = _gathered(mesh, on.frame, args)
        got = kernel(*_inputs(args, found)) or {}
        due = [k for k, a in enumerate(args) if (isinstance(a, DatArg) and a.on and a.access is not READ) or (isinstance(a, GlobalArg) and a.on and a.access not in (READ, WORK)) or isinstance(a, InfoArg)]
        if sorted(got) != due:
            raise MeshError(f"{name} returned {sorted(got)}; its outputs are {due}")
        outputs: dict[int, list[list[str]]] = {}
        columns: dict[str, Column] = {}
        for k in due:
            a = args[k]
            wide = isinstance(a, DatArg) and a.map is not None and a.idx < 0
            groups = [_listed(x) for x in got[k]] if wide else [_listed(got[k])]
            dim = len(a.values) if isinstance(a, (GlobalArg, InfoArg)) else a.dat.dim
            if any(len(g) != dim for g in groups) or (wide and len(groups) != len(a.slots)):
                raise MeshError(f"{name}: output {k} has the wrong dim")
            outputs[k] = [[f"__o{k}__{s}__{j}" for j in range(dim)] for s in range(len(groups))]
            columns |= {c: v for own, g in zip(outputs[k], groups, strict=True) for c, v in zip(own, g, strict=True)}
        applied = base.withColumns(columns) if columns else base
        if checkpoint:
            applied = cut(applied)
        _scatter(mesh, on, args, outputs, applied)
        reductions: list = []
        for k in due:
            a = args[k]
            if isinstance(a, GlobalArg):
                reductions.append((k, a, _reduction(k, a, outputs[k][0], "id" in applied.columns)))
            elif isinstance(a, InfoArg):
                reductions.append((k, a, _payload(k, a, args[a.ref], outputs[k][0], outputs[a.ref][0][0])))
        for k in due:
            if isinstance(args[k], DatArg):
                args[k].dat.version += 1
        return LoopResult(applied, reductions)


def _scatter(mesh: Mesh, on: MeshSet, args, outputs, applied: DataFrame) -> None:
    direct: dict[str, Column] = {}
    aimed: dict[str, list] = {}
    for k, own in outputs.items():
        a = args[k]
        if not isinstance(a, DatArg):
            continue
        kind = spark_type(a.dat.type)
        if a.map is None:
            for c, o in zip(a.dat.columns, own[0], strict=True):
                now = direct.get(c, F.col(c))
                direct[c] = (now + F.col(o)).cast(kind) if a.access is INC else F.col(o).cast(kind)
        else:
            aimed.setdefault(a.map.target.name, []).extend((k, a, s, o) for s, o in zip(a.slots, own, strict=True))
    if direct:
        keep = [F.col(c) if c not in direct else direct[c].alias(c) for c in on.frame.columns]
        mesh.frames[on.name] = applied.select(*keep)
    for target, shares in aimed.items():
        _apply(mesh, target, shares, applied)


def _apply(mesh: Mesh, target: str, shares, applied: DataFrame) -> None:
    """Aggregate all that a loop sends to one set and join it to the set, once."""
    adds = [x for x in shares if x[1].access is INC]
    sets = [x for x in shares if x[1].access is not INC]
    sums = list(dict.fromkeys(c for _, a, _, _ in adds for c in a.dat.columns))
    written = list(dict.fromkeys(a.dat.name for _, a, _, _ in sets))
    dats = {a.dat.name: a.dat for _, a, _, _ in sets}
    kind = {c: applied.schema[o].dataType for _, a, _, own in adds for c, o in zip(a.dat.columns, own, strict=True)}
    rows: dict[tuple[str, int], dict[str, Column]] = {}
    for k, a, s, own in shares:
        to = a.map.columns[s]
        row = rows.setdefault((to, k if a.access is not INC else -1), {})
        if a.access is INC:
            for c, o in zip(a.dat.columns, own, strict=True):
                row[f"s__{c}"] = row[f"s__{c}"] + F.col(o) if f"s__{c}" in row else F.col(o)
        else:
            row[f"w__{a.dat.name}"] = F.struct(*[F.col(o).alias(c) for c, o in zip(a.dat.columns, own, strict=True)])
            row[f"n__{a.dat.name}"] = F.struct(F.col("id").alias("i"), F.lit(k * 64 + s).alias("k"))
    names = sorted({n for row in rows.values() for n in row})
    if len(rows) == 1:
        ((to, _), row), = rows.items()
        spread = applied.select(F.col(to).alias("__to"), *[row[n].alias(n) for n in names])
    else:  # one row for each slot, from one pass over the kernel's output
        def cell(row, n):
            if n in row:
                return row[n].cast(kind[n[3:]]) if n.startswith("s__") else row[n]
            return F.lit(None).cast(kind[n[3:]]) if n.startswith("s__") else F.lit(None)

        parts = [F.struct(F.col(to).alias("__to"), *[cell(row, n).alias(n) for n in names]) for (to, _), row in rows.items()]
        spread = applied.select(F.explode(F.array(*parts)).alias("__row")).select("__row.*")
    totals = [F.sum(f"s__{c}").alias(f"s__{c}") for c in sums] + [F.max_by(f"w__{d}", f"n__{d}").alias(f"w__{d}") for d in written]
    merged = mesh.frames[target].join(spread.groupBy("__to").agg(*totals), F.col("id") == F.col("__to"), "left")
    declared = {c: spark_type(a.dat.type) for _, a, _, _ in shares for c in a.dat.columns}
    new = {c: (F.col(c) + F.coalesce(F.col(f"s__{c}").cast(declared[c]), F.lit(0).cast(declared[c]))).cast(declared[c]) for c in sums}
    new |= {c: F.when(F.col(f"w__{d}").isNotNull(), F.col(f"w__{d}")[c].cast(declared[c])).otherwise(F.col(c)) for d in written for c in dats[d].columns}
    mesh.frames[target] = merged.withColumns(new).drop("__to", *[f"s__{c}" for c in sums], *[f"w__{d}" for d in written])


def classify(*args) -> str:
    """``direct`` where no argument goes through a map, ``indirect`` where one reads, ``scatter`` where one is written or incremented."""
    through = [a for a in args if isinstance(a, DatArg) and a.on and a.map is not None]
    return "scatter" if any(a.access is not READ for a in through) else "indirect" if through else "direct"


def conflicts(on: MeshSet, arg: DatArg) -> DataFrame:
    """Targets that several elements of ``on`` would write through the argument's slots."""
    to = on.frame.select(F.explode(F.array(*[arg.map.columns[s] for s in arg.slots])).alias("id"))
    return to.groupBy("id").agg(F.count("*").alias("n_writers")).where("n_writers > 1")
