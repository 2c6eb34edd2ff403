"""Embedding near-duplicates by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from bidlens.llm.common import connected, small_batches, stored, table
from bidlens.llm.vectors import matrix, usable

# Production parameters: trees, rows of a leaf at which it is not split further, share of rows about a split that go to both sides.
TREES = 8
LEAF = 512
SPILL = 0.1
# Vectors of one node on which its splits are fitted, at most; every vector is indexed by them.
SAMPLE = 4096
# Directions tried for a split, and places in the middle half of the rows at which each may cut.
TRIES, CUTS = 6, (0.5, 0.4, 0.6, 0.3, 0.7, 0.25, 0.75)
# A node stays whole where of the pairs that the best split would part more than DENSE are linked.
DENSE = 0.01
# Linked pairs of a node's sample that a split is judged by, about.
LINKS = 20_000
# Levels of splits fitted in one round.
LEVELS = 6
# Vectors routed by one task at a time, about.
ROUTE = 4096
# Rows of a leaf compared at a time; a leaf that cannot be split further is compared block by block.
BLOCK = 2048


def _parted(at: np.ndarray, low: float, high: float, i: np.ndarray, j: np.ndarray) -> int:
    """How many pairs (i, j) of rows projected to ``at`` the split parts: one row goes left only, the other right only."""
    left, right = at < low, at > high
    return int(((left[i] & right[j]) | (right[i] & left[j])).sum())


def fit_splits(sample: np.ndarray, levels: int, least: int, spill: float, rng, linked: float = 0.9) -> dict:
    """Recursive random splits as {path: (direction, low, high)}; path is a string of 0 and 1.

    Vectors projected to ``low`` or above go right, to ``high`` or below go left, in between to both. Of
    several random directions and cuts the one that parts the fewest linked pairs of the sample is taken; a
    node of whose parted pairs more than ``DENSE`` are linked stays whole, as comparing them costs no more
    than in proportion to the links that it finds.
    """
    splits, open_nodes = {}, [("", sample)]
    while open_nodes:
        path, rows = open_nodes.pop()
        if len(path) >= levels or len(rows) < least:
            continue
        i, j = np.nonzero(np.triu(rows @ rows.T >= linked, 1))
        step = max(1, len(i) // LINKS)
        i, j = i[::step], j[::step]
        best = None
        for _ in range(TRIES):
            direction = rng.standard_normal(rows.shape[1])
            at = rows @ direction
            for cut in CUTS:
                low, middle, high = np.quantile(at, [cut - spill / 2, cut, cut + spill / 2])
                if not at.min() < middle <= at.max() or (at <= high).all() or (at >= low).all():
                    continue
                lost = _parted(at, low, high, i, j)
                if best is None or lost < best[0]:
                    best = lost, direction, at, low, high
                if not lost:
                    break
            if best and not best[0]:
                break
        if best is None:
            continue
        lost, direction, at, low, high = best
        if lost * step > DENSE * (at < low).sum() * (at > high).sum():
            continue
        splits[path] = (direction, low, high)
        open_nodes += [(path + "0", rows[at <= high]), (path + "1", rows[at >= low])]
    return splits


def route(rows: np.ndarray, splits: dict) -> list[tuple[np.ndarray, str]]:
    """Members (row numbers) of each leaf that the splits make."""
    out, open_nodes = [], [("", np.arange(len(rows)))]
    while open_nodes:
        path, members = open_nodes.pop()
        if path not in splits:
            if len(members):
                out.append((members, path))
            continue
        direction, low, high = splits[path]
        at = rows[members] @ direction
        open_nodes += [(path + "0", members[at <= high]), (path + "1", members[at >= low])]
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _splits_of(nodes: DataFrame, levels: int, leaf: int, spill: float, seed: int, linked: float) -> DataFrame:
    """Splits of each node, fitted on its bounded sample: (tree, node, splits)."""
    schema = StructType([StructField("tree", IntegerType()), StructField("node", StringType()), StructField("splits", BinaryType())])

    def fit(key, group):
        tree, node = key[0].as_py(), key[1].as_py()
        rows = matrix(group["vector"])[np.argsort(group["key"].to_numpy())]
        rng = np.random.default_rng([seed, tree, *node.encode()])
        splits = fit_splits(unit(rows), levels, max(2, int(leaf * group["share"][0].as_py())), spill, rng, linked)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": [node], "splits": pa.array([pickle.dumps(splits)], pa.binary())})

    return nodes.groupBy("tree", "node").applyInArrow(fit, schema)


def _routed(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Leaves (key, tree, node) of rows (key, vector, tree, node, n), dealt in parts of about ``ROUTE`` rows."""
    schema = StructType([StructField("key", LongType()), StructField("tree", IntegerType()), StructField("node", StringType())])
    parts = F.ceil(F.col("n") / ROUTE).cast("int")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int")).drop("n")
    sized = splits.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")

    def send(key, group, found):
        keys, outs, nodes = group["key"].to_numpy(), [], []
        if len(keys):
            for inside, tail in route(unit(matrix(group["vector"])), pickle.loads(found["splits"][0].as_py())):
                outs.append(keys[inside])
                nodes += [f"{key[1].as_py()}{tail}"] * len(inside)
        every = np.concatenate(outs) if outs else np.zeros(0, np.int64)
        return pa.table({"key": every, "tree": pa.array([key[0].as_py()] * len(every), pa.int32()), "node": pa.array(nodes, pa.string())})

    on = ("tree", "node", "part")
    return dealt.groupBy(*on).cogroup(sized.groupBy(*on)).applyInArrow(send, schema)


def forest(vectors: DataFrame, trees: int, leaf: int, spill: float, seed: int = 0, linked: float = 0.9) -> DataFrame:
    """The leaves (key, tree, node) of every vector of ``vectors`` (key, vector) in every tree.

    Vectors of one length share a root. Round by round, nodes larger than ``leaf`` are split by splits
    fitted on a sample of about ``SAMPLE`` of their vectors; the rounds end when no node splits, after one
    round per ``LEVELS`` levels of depth. A node whose vectors no split parts, or only by parting many
    pairs of cosine ``linked`` or more, stays as it is.
    """
    root = F.concat(F.size("vector").cast("string"), F.lit(":"))
    now = vectors.select("key", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"), root.alias("node"))
    sizes = stored(now.groupBy("tree", "node").agg(F.count("*").alias("n")), "forest-sizes")
    done = []
    while not (big := sizes.where(F.col("n") > leaf)).isEmpty():
        marked = now.join(big, ["tree", "node"], "left")
        done.append(marked.where("n is null").drop("n"))
        active = marked.where("n is not null").join(vectors, "key")
        share = F.least(F.lit(1.0), F.lit(SAMPLE) / F.col("n"))
        draw = F.pmod(F.xxhash64("key", "tree", "node"), F.lit(1_000_000)) / 1e6
        chosen = active.where(draw < share).withColumn("share", share).drop("n")
        splits = stored(_splits_of(chosen, LEVELS, leaf, spill, seed, linked), "forest-splits")
        routed = stored(_routed(active, splits.join(big, ["tree", "node"])), "forest-leaves")
        # Nodes that kept their name were not split.
        stuck = routed.join(big, ["tree", "node"], "left_semi")
        done.append(stuck)
        now = routed.join(big, ["tree", "node"], "left_anti")
        sizes = stored(now.groupBy("tree", "node").agg(F.count("*").alias("n")), "forest-sizes")
    for part in done:
        now = now.union(part)
    return stored(now, "forest")


def _counted_before(i, j, homes: pa.Array, tree: int, home: int) -> np.ndarray:
    """Which pairs (rows i, j) share a leaf in an earlier tree, or one of a smaller number in this tree."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    lists = homes.take(pa.array(used)).to_pylist()
    a, b = at[: len(i)], at[len(i) :]
    before = np.zeros(len(i), dtype=bool)
    for t in range(tree + 1):
        # In this tree only leaves of a smaller number count.
        kept = [[x for x in h[t] if t < tree or x < home] for h in lists]
        width = max(map(len, kept), default=0)
        padded = [np.array([h[s] if s < len(h) else -1 for h in kept], dtype=np.int64) for s in range(width)]
        for x in padded:
            left = np.nonzero((x[a] >= 0) & ~before)[0]
            for y in padded:
                before[left] |= x[a[left]] == y[b[left]]
    return before


def _settled(homes: pa.Array, tree: int) -> np.ndarray:
    """Rows that share one leaf of an earlier tree, the one with the most of them: their pairs are compared there."""
    lists, best = homes.to_pylist(), np.zeros(len(homes), dtype=bool)
    for t in range(tree):
        common = Counter(x for h in lists for x in h[t]).most_common(1)[0][0]
        inside = np.array([common in h[t] for h in lists])
        best = inside if inside.sum() > best.sum() else best
    return best


def near_links(vectors: DataFrame, leaves: DataFrame, least: float) -> DataFrame:
    """Links within leaves: rows (key, other, n). With other = key, ``n`` copies of other vectors are linked
    to ``key``; else key and other are linked and n is 0.

    A pair counts in the first leaf that it shares, by tree and number, so that sums over leaves count each
    linked pair once. Links are not listed: out of a leaf come counts and a spanning forest. A leaf beyond
    ``BLOCK`` rows is dealt as pairs of blocks; vectors that share a leaf of an earlier tree are not compared again there.
    """
    numbered = leaves.withColumn("home", F.expr("xxhash64(node) & 9223372036854775807"))
    homes = numbered.groupBy("key", "tree").agg(F.sort_array(F.collect_set("home")).alias("homes"))
    homes = homes.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("tree", "homes"))).alias("h")).select("key", F.col("h.homes").alias("homes"))
    digests = [F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("xor")]
    sized = numbered.groupBy("tree", "node", "home").agg(F.count("*").alias("n"), *digests).where("n > 1")
    # Of leaves with the same vectors only the first is compared.
    sized = sized.groupBy("n", "sum", "xor").agg(F.min(F.struct("tree", "home", "node")).alias("leaf"))
    sized = sized.select("leaf.tree", "leaf.node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = numbered.join(sized, ["tree", "node"]).join(vectors.join(homes, "key"), "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    pairs = dealt.withColumn("pair", F.explode(every)).select(
        "key", "copies", "vector", "homes", "home", "tree", "node", "block", F.col("pair.low").alias("low"), F.col("pair.high").alias("high")
    )
    schema = StructType([StructField(c, LongType()) for c in ("key", "other", "n")])

    def compare(key, group):
        tree, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
        ids, copies, block = (group[c].to_numpy() for c in ("key", "copies", "block"))
        vectors, homes, home = unit(matrix(group["vector"])), group["homes"].combine_chunks(), group["home"][0].as_py()
        left, right = np.nonzero(block == low)[0], np.nonzero(block == high)[0]
        count, edges, root = np.zeros(len(ids), dtype=np.int64), [], np.arange(len(ids))
        done = _settled(homes, tree) if len(ids) > LEAF else np.zeros(len(ids), dtype=bool)
        for start in range(0, len(left), BLOCK // 4):
            part = left[start : start + BLOCK // 4]
            for rows, others in ((part[~done[part]], right), (part[done[part]], right[~done[right]])):
                i, j = np.nonzero(vectors[rows] @ vectors[others].T >= least)
                i, j = rows[i], others[j]
                keep = ids[i] < ids[j] if low == high else ids[i] != ids[j]
                i, j = i[keep], j[keep]
                fresh = ~_counted_before(i, j, homes, tree, home)
                i, j = i[fresh], j[fresh]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                edges += _spanning(i, j, root)
        rows = [(int(ids[a]), int(ids[b]), 0) for a, b in edges] + [(int(ids[a]), int(ids[a]), int(count[a])) for a in np.nonzero(count)[0]]
        return pa.table([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["key", "other", "n"])

    return pairs.groupBy("tree", "node", "low", "high").applyInArrow(compare, schema)


def _spanning(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (i, j) that join components, as (i, j); ``root`` has every row's component and is changed."""
    out = []
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return out
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        # Each component takes one link to a component of smaller root, so no circle is closed.
        high, first = np.unique(np.maximum(a, b), return_index=True)
        out += zip(i[first].tolist(), j[first].tolist())
        root[high] = np.minimum(a, b)[first]
        while (root[root] != root).any():
            root[:] = root[root]


def embedding_near_dups(rows: DataFrame, least: float = 0.9, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """One row per row of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    rows without vec_id (their component_id is null and they are kept). Vectors of different lengths have
    no cosine and do not link. Equal vectors are compared once: ``n_links`` counts all other rows linked,
    repeated rows too. Rows of one vec_id are one node; each gets its own count and the node's component.
    """
    small_batches(rows.sparkSession)
    good = F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    # Adding 0 makes -0.0 equal to 0.0; single precision stays as it is.
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    zero = F.lit(0).cast(kind if kind == "float" else "double")
    clean = rows.where(good).select("vec_id", F.transform("embedding", lambda x: x + zero).alias("vector"))
    grouped = clean.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = stored(grouped.withColumn("key", F.monotonically_increasing_id()), "vectors")
    members = stored(clean.join(classes, "vector").select("vec_id", "key"), "vector-members")
    leaves = forest(classes.select("key", "vector"), trees, leaf, spill, linked=least)
    links = stored(near_links(classes.select("key", "vector", "copies"), leaves, least), "links")
    counts = links.where("key = other").groupBy("key").agg(F.sum("n").alias("n"))
    # Vectors under one id are one node.
    ids = members.groupBy("vec_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    shared = members.join(ids, "vec_id").select(F.col("key").alias("a"), F.col("low").alias("b"))
    edges = links.where("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b")).union(shared)
    rooted = classes.join(connected(edges, "vector-links").withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_id = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = rooted.join(least_id, "root").join(counts, "key", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = members.join(per_class, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    # An id with one usable row and one unusable: the latter is the same node.
    known = members.join(per_class, "key").groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    rest = alone.join(known, "vec_id", "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP4_SQL = """
with recursive v as (
    select vec_id, list_transform(embedding, x -> cast(x as double)) as e
    from embeddings
    where embedding is not null and len(list_filter(embedding, x -> x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, x -> x <> 0)) > 0
), l as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
    where list_inner_product(a.e, b.e) >= 0.9 * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))
), r as (
    select vec_id as a, vec_id as b from embeddings
    union
    select r.a, l.b from r join l on l.a = r.b
), c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join c on c.a = vec_id left join n on n.a = vec_id
"""
