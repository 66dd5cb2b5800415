"""Adjacency, bandwidth, partition vectors and their propagation, halo sizes, renumbering.

All are frames over (id, ...) keyed by the set's ids; ids never change. A
partition vector is a frame (id, part).
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators.model import Dat, Mesh, MeshError, MeshMap, MeshSet, cut, pinned


#: Pairs that a task of a dual graph makes, on the average.
PAIRS = 1 << 19


def _slots(m: MeshMap) -> DataFrame:
    """(from, slot, to) of every entry, from one pass."""
    entries = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(c).alias("to")) for s, c in enumerate(m.columns)])
    return m.source.frame.select(F.col("id").alias("from"), F.explode(entries).alias("e")).select("from", "e.slot", "e.to")


def adjacency(m: MeshMap) -> DataFrame:
    """(a, b), a <> b: target elements that a source element names together."""
    if m.dim < 2:
        raise MeshError(f"map {m.name} has one slot; dual_graph ties elements through another map")
    pairs = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in m.columns for y in m.columns if x != y]
    return m.source.frame.select(F.explode(F.array(*pairs)).alias("p")).select("p.a", "p.b").where("a <> b").distinct()


def dual_graph(ends: MeshMap, through: MeshMap) -> DataFrame:
    """(a, b), a <> b: targets of ``ends`` that some element of ``through``'s target set ties, by maps from one set.

    Each end counts once for each tie before the ties are joined, so the work
    follows the distinct ends of a tie; the pairs are the result. Ties are dealt
    to as many tasks as their pairs call for: a task keeps the pairs it has made,
    so that they are fewer before they are shuffled.
    """
    if ends.source is not through.source:
        raise MeshError(f"{ends.name} and {through.name} come from different sets")
    frame = ends.source.frame
    tied = cut(frame.select(F.explode(F.array(*through.columns)).alias("t"), F.array(*ends.columns).alias("e")).select("t", F.explode("e").alias("a")).distinct())
    made = tied.groupBy("t").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1))).first()[0] or 0
    dealt = tied.repartition(max(1, -(-made // PAIRS)), "t")
    return dealt.join(dealt.withColumnRenamed("a", "b"), "t").where("a <> b").select("a", "b").distinct()


def degree(m: MeshMap) -> DataFrame:
    """(id, degree) of every target element in the adjacency."""
    found = adjacency(m).groupBy("a").agg(F.count("*").alias("degree"))
    return m.target.frame.select("id").join(found, F.col("id") == F.col("a"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def bandwidth(m: MeshMap) -> DataFrame:
    """One row: the largest and mean distance of ids within a map row."""
    if m.dim < 2:
        raise MeshError(f"map {m.name} has one slot")
    gap = F.greatest(*m.columns) - F.least(*m.columns)
    return m.source.frame.agg(F.max(gap).alias("max_bandwidth"), F.avg(gap).alias("avg_bandwidth"))


# Partition vectors ------------------------------------------------------------


def part_block(on: MeshSet, parts: int) -> DataFrame:
    """Contiguous ranges, sizes apart by one at most."""
    n = on.size
    return on.frame.select("id", F.call_function("div", F.col("id") * parts, F.lit(max(n, 1))).cast("int").alias("part"))


def part_random(on: MeshSet, parts: int, seed: int = 0) -> DataFrame:
    return on.frame.select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int").alias("part"))


def part_external(dat: Dat) -> DataFrame:
    """The vector that an int dat of one component holds."""
    if dat.dim != 1:
        raise MeshError(f"dat {dat.name} has {dat.dim} components")
    return dat.set.frame.select("id", F.col(dat.columns[0]).cast("int").alias("part"))


def morton(columns: list[Column], bits: int = 16) -> Column:
    """The bits of whole numbers, interleaved."""
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.shiftright(c.cast("bigint"), b).bitwiseAND(F.lit(1).cast("bigint")), b * len(columns) + k) for k, c in enumerate(columns) for b in range(bits)])


def _cells(coordinates: Dat, bits: int = 16) -> Column:
    """A curve key of each element's place in the box of all."""
    limits = coordinates.set.frame.agg(*[f(c).cast("double").alias(f"{n}{k}") for k, c in enumerate(coordinates.columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    own = []
    for k, c in enumerate(coordinates.columns):
        lo, hi = limits[f"lo{k}"] or 0.0, limits[f"hi{k}"] or 0.0
        own.append(F.floor((F.col(c) - lo) / (hi - lo or 1.0) * ((1 << bits) - 1)))
    return morton(own, bits)


def part_geometric(coordinates: Dat, parts: int) -> DataFrame:
    """Ranges of a space-filling curve with equal counts: cells of the curve are counted, and their running sum is cut."""
    bits = max(1, min(16, 48 // coordinates.dim))
    keyed = coordinates.set.frame.select("id", _cells(coordinates, bits).alias("key"))
    coarse = F.shiftright("key", max(0, bits * coordinates.dim - 12))  # 4096 counters at most
    counts = {r["cell"]: r["n"] for r in keyed.groupBy(coarse.alias("cell")).agg(F.count("*").alias("n")).collect()}
    total, run, part_of = sum(counts.values()), 0, []
    for cell in sorted(counts):
        part_of += [F.lit(cell), F.lit(min(parts - 1, run * parts // max(1, total)))]
        run += counts[cell]
    return keyed.select("id", F.create_map(*part_of)[coarse].cast("int").alias("part")) if part_of else keyed.select("id", F.lit(0).alias("part"))


def part_inertial(coordinates: Dat, parts: int) -> DataFrame:
    """Recursive bisection along the axis of greatest inertia of coordinates, by three moments and one quantile for each box."""
    import numpy as np

    if coordinates.dim != 3:
        raise MeshError("three coordinates are needed")
    x = coordinates.columns
    now = coordinates.set.frame.select("id", *x, F.lit(0).alias("part"))
    sizes = {0: parts}
    while any(n > 1 for n in sizes.values()):
        moments = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)]]
        rows = {r["part"]: r for r in now.groupBy("part").agg(*moments).collect()}  # a row for each box
        axis, share = {}, {}
        for p, n in sizes.items():
            if n > 1 and p in rows:
                r = rows[p]
                c = np.array([[r[f"c{min(i, j)}{max(i, j)}"] or 0.0 for j in range(3)] for i in range(3)])
                axis[p], share[p] = np.linalg.eigh(c)[1][:, -1], (n // 2) / n
        if not axis:
            break
        along = F.lit(None).cast("double")
        for p, a in axis.items():
            along = F.when(F.col("part") == p, sum(F.col(c) * float(v) for c, v in zip(x, a, strict=True))).otherwise(along)
        placed = now.withColumn("__along", along)
        cuts = {r["part"]: r["q"] for r in placed.where("__along is not null").groupBy("part").agg(F.percentile_approx("__along", F.array(*[F.lit(s) for s in sorted(set(share.values()))]), 10_000).alias("q")).collect()}
        order, new, where = sorted(set(share.values())), {}, F.col("part")
        for p, n in sizes.items():
            new[p] = n // 2 if p in cuts else n
            if p in cuts:
                new[p + n // 2] = n - n // 2
                where = F.when((F.col("part") == p) & (F.col("__along") > cuts[p][order.index(share[p])]), F.lit(p + n // 2)).otherwise(where)
        now, sizes = placed.withColumn("__part", where.cast("int")).select("id", *x, F.col("__part").alias("part")), new
    return now.select("id", "part")


def part_graph(m: MeshMap, parts: int, rounds: int = 4, start: DataFrame | None = None) -> DataFrame:
    """Blocks of the target set, or a vector given, refined by moving elements to their neighbours' commonest part, while parts stay within a tenth of their share."""
    vector, edges = part_block(m.target, parts) if start is None else start, adjacency(m)
    for k in range(rounds):
        near = edges.join(vector.select(F.col("id").alias("b"), "part"), "b").groupBy(F.col("a").alias("id"), "part").agg(F.count("*").alias("n"))
        top = near.groupBy("id").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("t")).select("id", (-F.col("t.p")).alias("to"), F.col("t.n").alias("most"))
        own = near.withColumnRenamed("part", "own").withColumnRenamed("n", "inside")
        gain = vector.join(top, "id", "left").join(own, (own["id"] == vector["id"]) & (own["own"] == vector["part"]), "left").select(vector["id"], vector["part"], F.when(F.col("most") > F.coalesce("inside", F.lit(0)), F.col("to")).alias("to"))
        sizes = {r["part"]: r["n"] for r in vector.groupBy("part").agg(F.count("*").alias("n")).collect()}
        room = {p: max(0, int(1.1 * m.target.size / parts) - sizes.get(p, 0)) for p in range(parts)}
        wish = {r["to"]: r["n"] for r in gain.where("to is not null").groupBy("to").agg(F.count("*").alias("n")).collect()}
        if not wish:
            break
        # A share of those that want to go, by hash, so that no part overflows its room but by chance.
        chance = F.create_map(*[F.lit(x) for p in wish for x in (p, min(0.5, room[p] / wish[p]))])
        moved = F.col("to").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000 < chance[F.col("to")])
        vector = cut(gain.select("id", F.when(moved, F.col("to")).otherwise(F.col("part")).cast("int").alias("part")))
    return vector


def propagate_from(m: MeshMap, targets: DataFrame) -> DataFrame:
    """(id, part) of source elements: the commonest part among their targets, the first slot of ties."""
    seen = _slots(m).join(targets.select(F.col("id").alias("to"), "part"), "to").groupBy("from", "part").agg(F.count("*").alias("n"), F.min("slot").alias("slot"))
    best = seen.groupBy("from").agg(F.max(F.struct("n", (-F.col("slot")).alias("s"), "part")).alias("b"))
    return best.select(F.col("from").alias("id"), F.col("b.part").alias("part"))


def propagate_to(m: MeshMap, sources: DataFrame) -> DataFrame:
    """(id, part) of target elements: the commonest part among the sources that name them, the smallest of ties; those that none names are left out."""
    seen = _slots(m).join(sources.select(F.col("id").alias("from"), "part"), "from").groupBy("to", "part").agg(F.count("*").alias("n"))
    best = seen.groupBy("to").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("b"))
    return best.select(F.col("to").alias("id"), (-F.col("b.p")).alias("part"))


def propagate_all(mesh: Mesh, vectors: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Vectors of all sets that maps lead to from those given, by the cheapest map first.

    From sources to targets only a map that names every target will do.
    """
    out, onto = dict(vectors), {}
    while True:
        options = []
        for m in mesh.maps.values():
            s, t = m.source.name, m.target.name
            if t in out and s not in out:
                options.append((0 if m.dim == 1 else 1, m.name, True))
            elif s in out and t not in out:
                if m.name not in onto:
                    onto[m.name] = mesh.is_onto(m)
                if onto[m.name]:
                    options.append((2, m.name, False))
        if not options:
            return out
        _, name, down = min(options)
        m = mesh.maps[name]
        out[m.source.name if down else m.target.name] = propagate_from(m, out[m.target.name]) if down else propagate_to(m, out[m.source.name])


def forced_together(m: MeshMap, vector: DataFrame) -> DataFrame:
    """The targets of each row of ``m`` in one part: the smallest of the row, until nothing changes."""
    before = None
    while True:
        rows = _slots(m).join(vector.select(F.col("id").alias("to"), "part"), "to")
        low = rows.groupBy("from").agg(F.min("part").alias("low"))
        new = rows.join(low, "from").groupBy(F.col("to").alias("id")).agg(F.min("low").alias("low"))
        vector = vector.join(new, "id", "left").select("id", F.least("part", F.coalesce("low", "part")).alias("part"))
        vector = cut(vector)  # the plan grows threefold a round
        now = vector.agg(F.sum("part")).first()[0]
        if now == before:
            return vector
        before = now


def partition(mesh: Mesh, method: str, on: MeshSet, parts: int, m: MeshMap | None = None, coordinates: Dat | None = None, dat: Dat | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """Vectors of all sets, from that of ``on`` by the method named, and the frames dealt by them.

    A method without what it needs, or unknown, falls back to blocks with a
    warning; so does a set that no map leads to. Maps that are marked as forced
    keep the targets of each of their rows together.
    """
    methods = {
        "block": (True, lambda: part_block(on, parts)),
        "random": (True, lambda: part_random(on, parts, seed)),
        "external": (dat is not None, lambda: part_external(dat)),
        "geometric": (coordinates is not None, lambda: part_geometric(coordinates, parts)),
        "inertial": (coordinates is not None and coordinates.dim == 3, lambda: part_inertial(coordinates, parts)),
        "graph": (m is not None, lambda: part_graph(m, parts)),
        "geometric-graph": (m is not None and coordinates is not None, lambda: part_graph(m, parts, start=part_geometric(coordinates, parts))),
    }
    able, make = methods.get(method, (False, None))
    if not able:
        warnings.warn(f"partition by {method} isn't possible here; blocks stand for it", stacklevel=2)
    vector = make() if able else part_block(on, parts)
    for forced in mesh.maps.values():
        if forced.forced and forced.target is on:
            vector = forced_together(forced, vector)
    vectors = propagate_all(mesh, {on.name: vector})
    for name, s in mesh.sets.items():
        vectors.setdefault(name, part_block(s, parts))
        distribute(s, vectors[name], parts)
    mesh.partitions = vectors
    return vectors


def revert(mesh: Mesh) -> None:
    """Undo ``partition``: every frame in ranges of ids again."""
    for name in mesh.partitions:
        mesh.frames[name] = mesh.frames[name].repartitionByRange("id")
    mesh.partitions = {}


def distribute(on: MeshSet, vector: DataFrame, parts: int) -> None:
    """Deal the set's frame by its partition; a hint for later loops that changes no result."""
    on.mesh.frames[on.name] = on.frame.join(vector.withColumnRenamed("part", "__part"), "id").repartition(parts, "__part").drop("__part")


def edge_cut(m: MeshMap, vector: DataFrame) -> DataFrame:
    """One row: source elements, and those whose targets lie in several parts."""
    kinds = _slots(m).join(vector.select(F.col("id").alias("to"), "part"), "to").groupBy("from").agg(F.countDistinct("part").alias("k"))
    return kinds.agg(F.count("*").alias("n_elements"), F.coalesce(F.sum((F.col("k") > 1).cast("bigint")), F.lit(0)).alias("n_cut"))


def halo(m: MeshMap, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(part, owner, id): target elements that a part's source elements name and another part owns."""
    near = _slots(m).join(sources.select(F.col("id").alias("from"), "part"), "from")
    owned = near.join(targets.select(F.col("id").alias("to"), F.col("part").alias("owner")), "to")
    return owned.where("part <> owner").select("part", "owner", F.col("to").alias("id")).distinct()


def halo_sizes(m: MeshMap, sources: DataFrame, targets: DataFrame) -> DataFrame:
    return halo(m, sources, targets).groupBy("part", "owner").agg(F.count("*").alias("n"))


def halo_regions(m: MeshMap, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(part, kind, n) of source elements: core (all targets are the part's own) and boundary; and imported: those other parts have that name its targets."""
    tied = _slots(m).join(sources.select(F.col("id").alias("from"), "part"), "from").join(targets.select(F.col("id").alias("to"), F.col("part").alias("owner")), "to")
    kinds = tied.groupBy("from", "part").agg(F.max((F.col("part") != F.col("owner")).cast("int")).alias("out"))
    own = kinds.groupBy("part", F.when(F.col("out") == 0, "core").otherwise("boundary").alias("kind")).agg(F.count("*").alias("n"))
    imported = tied.where("part <> owner").select("from", F.col("owner").alias("part")).distinct().groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit("imported").alias("kind"), "n")
    return own.unionByName(imported)


def halo_owner(vector: DataFrame, ids: DataFrame) -> DataFrame:
    """The part that owns each id."""
    return ids.join(vector, "id")


def partial_halo(mesh: Mesh, target: MeshSet, vectors: dict[str, DataFrame], least: float = 0.3) -> DataFrame:
    """(map_name, crossing, halo, partial): whether a map's own halo is under ``least`` of all that the set's maps need."""
    parts = []
    for m in mesh.maps.values():
        if m.target is target and m.source.name in vectors:
            parts.append(halo(m, vectors[m.source.name], vectors[target.name]).select(F.lit(m.name).alias("map_name"), "part", "id"))
    each = reduce(DataFrame.unionByName, parts)
    whole = each.select("part", "id").distinct().count()
    own = each.groupBy("map_name").agg(F.count("*").alias("crossing"))
    return own.select("map_name", "crossing", F.lit(whole).cast("bigint").alias("halo"), (F.col("crossing") < whole * least).alias("partial"))


# Renumbering --------------------------------------------------------------------


def order_geometric(coordinates: Dat) -> DataFrame:
    """(id, new) in order of a space-filling curve."""
    keyed = coordinates.set.frame.select("id", _cells(coordinates, max(1, min(16, 48 // coordinates.dim))).alias("key"))
    return ranked(keyed, ["key", "id"])


def order_levels(m: MeshMap, most: int = 10_000) -> DataFrame:
    """(id, new) by breadth-first levels of the adjacency from the smallest id of each part, then by the least neighbour's level, degree and id."""
    edges = cut(adjacency(m))
    level = m.target.frame.select("id", F.when(F.col("id") == 0, F.lit(0)).alias("level"))
    for k in range(most):
        near = edges.join(level.where(F.col("level") == k).select(F.col("id").alias("b")), "b").select(F.col("a").alias("id")).distinct().withColumn("__near", F.lit(True))
        level = level.join(near, "id", "left").select("id", F.coalesce("level", F.when(F.col("__near"), F.lit(k + 1))).alias("level"))
        level = cut(level)
        count = level.agg(F.sum((F.col("level") == k + 1).cast("int")).alias("new"), F.min(F.when(F.col("level").isNull(), F.col("id"))).alias("left")).first()
        if not count["new"]:
            if count["left"] is None:
                break
            level = level.withColumn("level", F.when(F.col("id") == count["left"], F.lit(k + 1)).otherwise(F.col("level")))
    else:
        raise MeshError(f"{most} levels don't reach every element")
    return ranked(level.join(degree(m), "id"), ["level", "degree", "id"])


def ranked(frame: DataFrame, keys: list[str]) -> DataFrame:
    """(id, new): places 0 .. n-1 in order of the keys, by ranges sorted each for itself and their running counts."""
    dealt = frame.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id())
    dealt = dealt.select("id", F.shiftright("__place", 33).alias("__task"), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"))
    dealt = pinned(dealt)
    before, run = [], 0
    for r in dealt.groupBy("__task").agg(F.count("*").alias("n")).orderBy("__task").collect():  # a row for each task
        before += [F.lit(r["__task"]), F.lit(run)]
        run += r["n"]
    return dealt.select("id", (F.create_map(*before)[F.col("__task")] + F.col("__row")).cast("bigint").alias("new")) if before else dealt.select("id", F.lit(0).cast("bigint").alias("new"))


def renumber_sources(m: MeshMap, order: DataFrame) -> DataFrame:
    """(id, new) of the source set: by the least new number among its targets, then id."""
    low = _slots(m).join(order.select(F.col("id").alias("to"), "new"), "to").groupBy(F.col("from").alias("id")).agg(F.min("new").alias("low"))
    return ranked(low, ["low", "id"])


def renumber_targets(m: MeshMap, order: DataFrame) -> DataFrame:
    """(id, new) of the target set of an onto map: by first touch in the sources' new order."""
    touch = _slots(m).join(order.select(F.col("id").alias("from"), "new"), "from").groupBy(F.col("to").alias("id")).agg(F.min(F.struct("new", "slot")).alias("t")).select("id", F.col("t.new").alias("n"), F.col("t.slot").alias("s"))
    return ranked(touch, ["n", "s", "id"])


def apply_order(mesh: Mesh, on: MeshSet, order: DataFrame) -> None:
    """Give the set's elements their new numbers, in its frame and in every map that leads to it."""
    mesh.frames[on.name] = on.frame.join(order, "id").withColumn("id", F.col("new")).drop("new")
    for m in mesh.maps.values():
        if m.target is on:
            f = m.source.frame
            for c in m.columns:
                f = f.join(order.select(F.col("id").alias("__old"), F.col("new").alias("__new")), F.col(c) == F.col("__old")).withColumn(c, F.col("__new")).drop("__old", "__new")
            mesh.frames[m.source.name] = f


def check_order(order: DataFrame) -> DataFrame:
    """One row: elements, distinct new numbers, and the range; a permutation has all equal to 0 .. n-1."""
    return order.agg(F.count("*").alias("n"), F.countDistinct("new").alias("n_new"), F.min("new").alias("low"), F.max("new").alias("high"))


# Small tools ----------------------------------------------------------------------


def mode(frame: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): each key's commonest value, the smallest of ties."""
    counts = frame.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def prefix_offsets(frame: DataFrame, key: str, count: str) -> DataFrame:
    """(key, count, offset): the running sum before each key; one row for each key, so few."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return frame.select(key, count, F.coalesce(F.sum(count).over(w), F.lit(0)).alias("offset"))
