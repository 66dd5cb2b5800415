"""Near-duplicate documents: MinHash banding, verification, connected components.

Rows with equal shingle sets are one class, named by its smallest id; only
classes go on. Each has the minima of many universal hashes of its set; a band
of them is a bucket key. What must be linked shares a bucket (the threshold
gives the number and length of bands, so that a link at it is missed with a
chance below 3e-7: 32 bands of 6 at 0.85, 38 of 5 at 0.80). Of buckets with the
same members one counts. Inside a bucket of bounded size the signatures are
verified before anything is closed over: only pairs whose signatures agree tie
their documents together, so a chance meeting in a band ties nothing; a larger
bucket's members are tied to its least id. These ties give candidate components,
by large-star and small-star. Links are confirmed on full sets:

* a component of bounded size is read by one task, which compares its pairs,
  the signatures first, and skips pairs already connected;
* a larger one is compared with one pivot after another, dealt by salt; what
  no pivot of the largest cluster has taken is a query set, dealt in blocks,
  that is held against blocks of the whole component inside tasks of bounded
  size: signatures first, then exact counts from the block's inverted index.

Pairs that are already connected aren't expanded, no candidate is capped.

Defined results: a null or empty text, or one without words, has no shingles
and is linked with nothing. A null id can't be named: such a row is its own
component, component_id is null and it stays. Rows that share an id but not the text are
each placed by their own text. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import drop, id_and_text, slices, spool
from meshloom.llm.components import components
from meshloom.llm.shingles import lower, mix, shingle_sets, texts_of

#: Bands are as many as keep the chance that a link at the threshold shares none below MISS, and BANDS at least; shorter where BANDS * ROWS hashes don't suffice.
BANDS, ROWS, MISS = 32, 6, 3e-7
#: Signatures that agree by less than the threshold less this rule a pair out: five standard errors and more.
SLACK = 0.15
#: A candidate component up to these sizes is compared in one task.
SMALL_NODES, SMALL_SHINGLES = 64, 2_000_000
PIVOTS = 3
SALTS = 16
#: Queries, members and members' shingles of a block in a larger component, on the average.
BLOCK_QUERIES, BLOCK_NODES, BLOCK_SHINGLES = 256, 2048, 1_000_000
#: Shingles that are hashed at a time, for the CPU's cache.
BLOCK = 1 << 14
_DRAW = np.random.default_rng(7)
_A = _DRAW.integers(0, 2**32, 4096, dtype=np.uint32) | np.uint32(1)
_B = _DRAW.integers(0, 2**32, 4096, dtype=np.uint32)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(sets, n): of each set's values x the least a*x + b mod 2^32, for n universal hashes; no set is empty."""
    out = np.full((len(sets), n), 0xFFFFFFFF, dtype=np.uint32)
    k = 0
    while k < len(sets):
        j, size = k, 0
        while j < len(sets) and (j == k or size + len(sets[j]) <= BLOCK):
            size += len(sets[j])
            j += 1
        x = np.concatenate(sets[k:j])
        for at in range(0, len(x), BLOCK):
            own = (x[at : at + BLOCK] >> np.uint64(32)).astype(np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[k : j - 1]])]).astype(np.int64) if j > k + 1 else np.array([0])
            value = np.empty_like(own)
            for h in range(n):
                np.multiply(own, _A[h], out=value)
                np.add(value, _B[h], out=value)
                out[k:j, h] = np.minimum(out[k:j, h], np.minimum.reduceat(value, starts))
        k = j
    return out


def banding(threshold: tuple[int, int], bands: int | None = None, rows: int = ROWS) -> tuple[int, int]:
    """The number of bands, where none is given, and of rows in each for a threshold."""
    if bands is not None:
        return bands, rows
    for most, r in [(BANDS * ROWS, r) for r in range(rows, 0, -1)] + [(len(_A), 1)]:
        differ = 1 - (threshold[0] / threshold[1]) ** r
        n = max(BANDS, math.ceil(math.log(MISS) / math.log(differ))) if differ > 0 else BANDS
        if n * r <= most:
            return n, r
    raise ValueError(f"no bands for a threshold of {threshold[0]}/{threshold[1]}")


def band_keys(minima_: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(minima_), bands), dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima_[:, r::rows][:, :bands].astype(np.uint64) + np.uint64(1))
    return mix(key + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def signature(minima_: np.ndarray) -> np.ndarray:
    """A byte of each minimum."""
    return ((minima_ * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def _set_key(own: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


def _sketch(words: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                data, offsets = texts_of(part.column(1))
                sets = shingle_sets(lower(data), offsets, words)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                if full:
                    least = minima([sets[k] for k in full], bands * rows)
                    for k, row, sig in zip(full, band_keys(least, bands, rows), signature(least), strict=True):
                        keys[k], bits[k], sigs[k] = _set_key(sets[k]), row.tobytes(), sig.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary()), pa.array(sigs, pa.binary()), part.column(2)], names=["id", "n", "set_key", "bands", "sig", "sha"])

    return run


def _unpack(batches):
    """(id, bands) to a row for each band's key."""
    for batch in batches:
        ids, bands = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        keys = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in bands]) if bands else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids, [len(b) // 8 for b in bands]) if bands else keys)], names=["bucket", "id"])


def _ties(num: int, den: int):
    """Ties inside each bucket, of rows (bucket, id, signature) in order of the bucket: a tree of each cluster of like signatures."""
    least = num / den - SLACK

    def settle(ids, sigs):
        sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), -1)
        cluster = np.arange(len(ids))
        for k in range(1, len(ids)):
            for j in np.flatnonzero((sig[:k] == sig[k]).mean(axis=1) >= least).tolist():
                if cluster[j] != cluster[k]:
                    cluster[cluster == cluster[j]] = cluster[k]
                    yield ids[j], ids[k]

    def run(batches):
        bucket, ids, sigs, out = None, [], [], []
        for batch in slices(batches):
            for b, i, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    out += settle(ids, sigs) if len(ids) > 1 else []
                    bucket, ids, sigs = b, [], []
                ids.append(i)
                sigs.append(sig)
            yield _edges(out)
            out = []
        yield _edges(list(settle(ids, sigs)) if len(ids) > 1 else [])

    return run


def _candidates(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): ties between classes that share a bucket, a tree of each bucket's like members."""
    exploded = spool(classes.select(F.col("rep").alias("id"), "bands").mapInArrow(_unpack, "bucket long, id long"), "buckets")
    low, high = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32)
    met = exploded.withColumn("h", F.xxhash64("id")).groupBy("bucket").agg(F.count("*").alias("k"), F.min("id").alias("top"), F.sum(low).alias("s1"), F.sum(high).alias("s2")).where("k > 1")
    # Buckets with the same number, least id and sums of hashes have the same members.
    met = met.groupBy("k", "top", "s1", "s2").agg(F.min("bucket").alias("bucket"))
    met = met.select("bucket", "top", (F.col("k") <= SMALL_NODES).alias("few"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("salt"))
    shared = spool(exploded.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int")).join(met, ["bucket", "salt"]).select("bucket", "id", "top", "few"), "shared-buckets")
    drop(exploded)
    signed = shared.where("few").select("bucket", "id").join(classes.select(F.col("rep").alias("id"), "sig"), "id").select("bucket", "id", "sig")
    tied = signed.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_ties(num, den), "u long, v long")
    ties = spool(tied.unionByName(shared.where("not few").select(F.col("id").alias("u"), F.col("top").alias("v"))).distinct(), "ties")
    drop(shared)
    return ties


def _sets(words: int, n: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                data, offsets = texts_of(part.column(1))
                sets = shingle_sets(lower(data), offsets, words)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = signature(minima([sets[k] for k in full], n)) if full else []
                part = part.take(pa.array(full, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([sets[k].tobytes() for k in full], pa.binary())], names=["id", "root", "small", "sig", "shingles"])

    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |a & b| >= num * |a | b| for sorted distinct values."""
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return den * both >= num * (len(a) + len(b) - both)


def _small(num: int, den: int):
    """Links inside each component; rows come in order of the component."""
    least = num / den - SLACK

    def settle(rows):
        parent = list(range(len(rows)))

        def find(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        sig = np.stack([r[1] for r in rows])
        for k in range(1, len(rows)):
            near = np.flatnonzero((sig[:k] == sig[k]).mean(axis=1) >= least)
            for j in near.tolist():
                a, b = find(j), find(k)
                if a != b and linked(rows[j][2], rows[k][2], num, den):
                    parent[a] = b
                    yield rows[j][0], rows[k][0]

    def run(batches):
        root, rows, out = None, [], []
        for batch in slices(batches):
            for i, r, sig, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != root:
                    out += settle(rows) if rows else []
                    root, rows = r, []
                rows.append((i, np.frombuffer(sig, np.uint8), np.frombuffer(own, np.uint64)))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out + list(settle(rows) if rows else []))

    return run


def _edges(out):
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _pairs(num: int, den: int):
    """Links among rows (u, signature, set, v, signature, set)."""
    least = num / den - SLACK

    def run(batches):
        for batch in batches:
            out = []
            for u, s, a, v, t, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (np.frombuffer(s, np.uint8) == np.frombuffer(t, np.uint8)).mean() >= least and linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), num, den):
                    out.append((u, v))
            yield _edges(out)

    return run


def _blocks(num: int, den: int):
    """Links of the queries of a block to its members, one to each other cluster; rows come in order of the block."""
    least = num / den - SLACK

    def settle(queries, members):
        if not queries or not members:
            return
        ids, clusters, sizes = (np.array([m[k] for m in members], dtype=np.int64) for k in (0, 1, 2))
        sigs = np.stack([m[3] for m in members])
        tokens, owner = np.concatenate([m[4] for m in members]), np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for i, c, n, sig, own in queries:
            may = ((sigs == sig).mean(axis=1) >= least) & (clusters != c)
            if not may.any():
                continue
            lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            count = hi - lo
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            both = np.bincount(owner[at], minlength=len(members))
            found = np.flatnonzero(may & (den * both >= num * (n + sizes - both)))
            _, first = np.unique(clusters[found], return_index=True)
            for k in found[first].tolist():
                yield i, int(ids[k])

    def run(batches):
        block, queries, members, out = None, [], [], []
        for batch in slices(batches):
            for root, q, m, query, i, c, sig, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (root, q, m) != block:
                    out += settle(queries, members)
                    block, queries, members = (root, q, m), [], []
                own = np.frombuffer(own, np.uint64)
                (queries if query else members).append((i, c, len(own), np.frombuffer(sig, np.uint8), own))
            yield _edges(out)
            out = []
        yield _edges(list(settle(queries, members)))

    return run


def _with_root(rows: DataFrame, of_root: DataFrame, node: str) -> DataFrame:
    """``rows`` with what ``of_root`` says of their root; a large root's rows are dealt by salt."""
    spread = of_root.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("deal", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int")).join(spread.hint("merge"), ["root", "deal"]).drop("deal")


def _large(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links that connect what is connected in the components too large for a task."""
    big = sets.where("not small").select("id", "root", "sig", "shingles")
    links, open_ = None, big
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    for _ in range(PIVOTS):
        pivots = open_.groupBy("root").agg(F.min("id").alias("p"))
        held = pivots.join(big.select(F.col("id").alias("p"), F.col("sig").alias("psig"), F.col("shingles").alias("pset")), "p").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = open_.withColumn("salt", salt).join(held, ["root", "salt"]).where("id <> p")
        found = spool(dealt.select("p", "psig", "pset", "id", "sig", "shingles").mapInArrow(_pairs(num, den), "u long, v long"), "pivot-links")
        links = found if links is None else links.unionByName(found)
        done = found.select(F.col("v").alias("id")).unionByName(pivots.select(F.col("p").alias("id")))
        open_ = open_.join(done, "id", "left_anti")
    # Clusters so far; a node that no pivot has taken is its own. All but those of the largest cluster are queries.
    clusters = big.join(links.select(F.col("v").alias("id"), F.col("u").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    sizes = clusters.groupBy("root", "c").agg(F.count("*").alias("n"), F.sum(F.length("shingles") / 8).alias("s"))
    plan = sizes.groupBy("root").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > top.n")
    blocks = lambda x, most: F.greatest(F.lit(1), F.ceil(x / most)).cast("int")
    plan = plan.select("root", F.col("top.c").alias("main"), blocks(F.col("n") - F.col("top.n"), BLOCK_QUERIES).alias("qs"), F.greatest(blocks(F.col("n"), BLOCK_NODES), blocks(F.col("s"), BLOCK_SHINGLES)).alias("ms"))
    rows = _with_root(clusters, plan, "id")
    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["root", "q", "m", "query", "id", "c", "sig", "shingles"]
    queries = rows.where("c <> main").withColumn("q", place("qs", 1)).withColumn("m", each("ms")).withColumn("query", F.lit(True))
    members = rows.withColumn("m", place("ms", 2)).withColumn("q", each("qs")).withColumn("query", F.lit(False))
    dealt = queries.select(*columns).unionByName(members.select(*columns)).repartition("root", "q", "m").sortWithinPartitions("root", "q", "m")
    return links.unionByName(spool(dealt.mapInArrow(_blocks(num, den), "u long, v long"), "block-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: tuple[int, int] = (80, 100), bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """One row for each of ``docs``: its id, n_shingles, component_id, kept and its text's digest.

    Texts are linked when threshold[1] * |intersection| >= threshold[0] *
    |union| of their shingle sets; a component's smallest id names it.
    """
    num, den = threshold
    bands, rows = banding(threshold, bands, rows)
    texts = id_and_text(docs, id_col, text_col)
    digest = F.sha2(F.col("text").cast("binary"), 256)
    made = spool(texts.withColumn("sha", digest).mapInArrow(_sketch(words, bands, rows), "id long, n long, set_key binary, bands binary, sig binary, sha string"), "sketches")
    full = made.where("id is not null and n > 0")
    classes = spool(full.groupBy("set_key").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.min("bands").alias("bands"), F.min("sig").alias("sig")), "classes")
    ties = _candidates(classes, num, den)
    nodes = components(ties)
    drop(ties)
    nodes = nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
    weight = nodes.join(classes.select(F.col("rep").alias("node"), "n"), "node").groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    weight = weight.select("root", ((F.col("k") <= SMALL_NODES) & (F.col("s") <= SMALL_SHINGLES)).alias("small"))
    chosen = _with_root(nodes, weight, "node").select(F.col("node").alias("id"), "root", "small")
    # An id that several rows have goes with each of its texts.
    sets = spool(texts.join(chosen, "id").select("id", "text", "root", "small").mapInArrow(_sets(words, bands * rows), "id long, root long, small boolean, sig binary, shingles binary"), "sets")
    links = sets.where("small").select("root", "id", "sig", "shingles").repartition("root").sortWithinPartitions("root", "id").select("id", "root", "sig", "shingles").mapInArrow(_small(num, den), "u long, v long")
    if not sets.where("not small").isEmpty():
        links = links.unionByName(_large(sets, num, den))
    found = components(links)
    drop(sets)
    named = classes.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("root"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = made.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(named, ["set_key", "salt"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
