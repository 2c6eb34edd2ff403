"""MinHash near-duplicates with tensored banding, verified on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from bidlens.llm.common import UPPER, add_columns, connected, settled, stored, table, text_of, trimmed
from bidlens.session import broadcast_if_small

# Words of a shingle, and the least similarity of a link in percent.
WORDS = 5
PERCENT = 85
# Two collections of SIDE groups of HASHES minhashes give SIDE ** 2 table keys of 2 * HASHES minhashes each.
# A pair at 0.85 is missed with a chance of 2 * (1 - 0.85 ** 3) ** 9 = 0.0004, one at 0.3 is met with 0.05.
SIDE = 9
HASHES = 3
# The pipeline's stage links from 0.8 on, where 9 groups would miss a pair with 0.003; with 12 the chance is 0.0004.
STAGE_PERCENT, STAGE_SIDE = 80, 12
# Nodes and shingles of a block, about, where a group is compared block by block.
BLOCK, BLOCK_SHINGLES = 256, 250_000
SEED = 20240501
_LOWER = bytes(c + 32 if chr(c) in UPPER else c for c in range(256))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; words end at space, tab or a line's end characters."""
    parts = text_of(text).translate(_LOWER).split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh3_64_intdigest
    if len(parts) <= words:
        return np.array([digest(line)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: -words]]).tolist()
    found = [digest(line[a:b]) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    return np.unique(np.array(found, dtype=np.uint64))


def _mixers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**63, size=(n, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(shingles: np.ndarray, mixers: np.ndarray) -> np.ndarray:
    out = np.empty(len(mixers), dtype=np.uint64)
    for i, (a, b) in enumerate(mixers):
        x = (shingles ^ b) * a
        x ^= x >> np.uint64(31)
        out[i] = x.min()
    return out


def signatures(docs: DataFrame, side: int = SIDE, hashes: int = HASHES, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, digest, left, right): the digest of the set, and two collections of group hashes."""
    mixers = _mixers(2 * side * hashes)

    def make(texts):
        sizes, digests, groups = [], [], []
        for t in texts:
            shingles = shingle_set(t.as_py(), words)
            sizes.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            found = minhashes(shingles, mixers).reshape(2 * side, hashes) if len(shingles) else []
            groups.append([xxhash.xxh3_64_intdigest(g.tobytes(), seed=i) - 2**63 for i, g in enumerate(found)])
        longs = pa.list_(pa.int64())
        return [
            pa.array(sizes, pa.int64()),
            pa.array(digests, pa.binary()),
            pa.array([g[:side] for g in groups], longs),
            pa.array([g[side:] for g in groups], longs),
        ]

    longs = ArrayType(LongType())
    outputs = [StructField("n_shingles", LongType()), StructField("digest", BinaryType()), StructField("left", longs), StructField("right", longs)]
    return add_columns(docs.select("doc_id", "text"), ["text"], outputs, make).drop("text")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """Table keys that several of ``nodes`` (node, size, left, right) have, as rows (key, node, size).

    A key pairs a hash of each collection, so nodes can only share it if they share both of its hashes.
    Hashes of one node alone go first, and only the rest of the two collections is combined.
    """
    halves = [F.posexplode(F.concat("left", "right")).alias("at", "hash"), (F.size("left")).alias("side")]
    each = nodes.select("node", "size", *halves).select("node", "size", F.xxhash64("at", "hash").alias("half"), (F.col("at") >= F.col("side")).cast("int").alias("side"))
    each = stored(each, "near-halves")
    often = each.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    own = [F.collect_list(F.when(F.col("side") == s, F.col("half"))).alias(c) for s, c in enumerate(("left", "right"))]
    left = stored(each.join(often, "half").groupBy("node").agg(F.first("size").alias("size"), *own), "near-left")
    pairs = left.select("node", "size", F.explode("left").alias("l"), "right").select("node", "size", "l", F.explode("right").alias("r"))
    keys = stored(pairs.select("node", "size", F.xxhash64("l", "r").alias("key")), "near-keys")
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key")


def _full_sets(need: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Full sets of the nodes ``need`` (node, digest, doc_id) as rows (node, shingles)."""
    texts = docs.select("doc_id", "text").join(broadcast_if_small(need), "doc_id")

    def sets(text):
        found = [shingle_set(t.as_py(), words) for t in text]
        return [pa.array([s.tobytes() for s in found], pa.binary()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary())]

    outputs = [StructField("shingles", BinaryType()), StructField("own", BinaryType())]
    full = add_columns(texts, ["text"], outputs, sets).where("own = digest").select("node", "shingles")
    # Repeated rows under one id have equal sets: one is enough.
    return stored(full.groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")


def _own_shingles(full: DataFrame) -> DataFrame:
    """How many shingles of each node are in no other node of ``full`` (node, shingles): (node, own)."""

    def listed(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("shingles")]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else nodes), pa.array(nodes)], names=["shingle", "node"])

    schema = StructType([StructField("shingle", LongType()), StructField("node", LongType())])
    once = full.mapInArrow(trimmed(listed), schema).groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
    return once.groupBy("node").agg(F.count("*").alias("own"))


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b) with the sizes of intersection and union of their full sets: (a, b, common, total)."""
    joined = pairs.join(full.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    joined = joined.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")

    def compare(batches):
        for batch in batches:
            common, total = [], []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                common.append(int((t[at] == s).sum()))
                total.append(len(s) + len(t) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])

    schema = StructType([StructField(c, LongType()) for c in ("a", "b", "common", "total")])
    return stored(joined.mapInArrow(trimmed(compare), schema), "near-verified")


def _linked_in_blocks(rows: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within each group ``a`` of ``rows`` (a, b, size, root, shared), on full sets.

    A group is dealt as pairs of blocks of about ``BLOCK`` nodes and ``BLOCK_SHINGLES`` shingles; a task compares one pair of
    blocks row by row and returns only the links that join components, at most one per component.
    """
    several = rows.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("shingles")).where("lo < hi")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = rows.join(several.select("a", blocks.alias("blocks")), "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    pairs = dealt.withColumn("pair", F.explode(every)).select("a", "b", "size", "root", "shared", "block", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"))
    held = pairs.join(full.withColumnRenamed("node", "b"), "b")

    def compare(key, group):
        node, size, root, shared, block = (group[c].to_numpy() for c in ("b", "size", "root", "shared", "block"))
        root, found = root.copy(), []
        left, right = np.nonzero(block == key[1].as_py())[0], np.nonzero(block == key[2].as_py())[0]
        if not (len(left) and len(right)):
            # Few nodes with many shingles give about as many blocks as nodes, so some blocks have none.
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["shingles"]]
        # Shingles as numbers from 0, and those of the right block in one line.
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        line = np.concatenate([at[ends[r] - size[r] : ends[r]] for r in right])
        starts = np.concatenate([[0], np.cumsum(size[right])[:-1]])
        marks = np.zeros(len(names), dtype=np.int32)
        for i in left:
            most = np.minimum(shared[i], shared[right])
            if not ((root[right] != root[i]) & (100 * most >= percent * (size[i] + size[right] - most))).any():
                continue
            mine = at[ends[i] - size[i] : ends[i]]
            marks[mine] = 1
            common = np.add.reduceat(marks[line], starts, dtype=np.int64)
            marks[mine] = 0
            for j in right[100 * common >= percent * (size[i] + size[right] - common)]:
                if root[j] != root[i]:
                    found.append((node[i], node[j]))
                    root[root == root[j]] = root[i]
        return pa.table([pa.array([f[c] for f in found], pa.int64()) for c in range(2)], names=["a", "b"])

    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    return held.groupBy("a", "low", "high").applyInArrow(lambda key, group: settled(compare, key, group), schema)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, side: int = SIDE, hashes: int = HASHES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents link if the Jaccard similarity of their shingle sets is at least ``percent`` / 100. A text
    of fewer words than a shingle is one shingle; one without words, or null, has none and links with
    nothing. A null doc_id links with nothing, has a null component and is kept. Rows under one doc_id are
    one document: their links are united, and they are kept or not together. An empty table gives no rows.

    Equal sets are one node, so copies cost nothing further. In a bucket every node is verified against
    the bucket's smallest one, its leader: that joins groups of near copies without listing their pairs.
    Where components stay apart, the nodes of a leader's buckets are compared block by block inside tasks,
    which list no pairs but the links that join components. Left out before are nodes too many of whose
    shingles are in no other open node: no intersection with another one can be large enough.
    """
    signed = stored(signatures(docs, side, hashes, words), "near-signatures")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    grouped = usable.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("size"), F.first("left").alias("left"), F.first("right").alias("right"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    rows = stored(shared_keys(nodes), "near-buckets")
    leaders = rows.groupBy("key").agg(F.min("node").alias("a"))
    led = rows.join(leaders, "key").select("key", "a", F.col("node").alias("b"), "size")
    met = rows.select("node").distinct()
    full = _full_sets(stored(nodes.join(met, "node", "left_semi").select("node", "digest", F.col("first_id").alias("doc_id")), "near-need"), docs, words)
    first = _verified(led.where("a <> b").select("a", "b").distinct(), full)
    linked = F.col("common") * 100 >= F.col("total") * percent
    links = first.where(linked).select("a", "b")

    # Rows of one doc_id with different texts.
    ids = usable.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x < y").select("doc_id")
    same = usable.join(ids, "doc_id").join(nodes.select("digest", "node"), "digest").select("doc_id", "node")
    links = links.union(same.join(same.groupBy("doc_id").agg(F.min("node").alias("m")), "doc_id").select("node", "m"))
    links = stored(links.toDF("a", "b"), "near-links")
    roots = connected(links, "near-components")

    # Buckets that still hold several components, and of their rows those that can link with another one.
    named = led.join(roots.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    mixed = stored(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("size").alias("least")).where("lo < hi").select("key", "least"), "near-mixed")
    open_ = stored(named.join(mixed, "key").select("key", "a", "b", "size", "root", "least"), "near-open")
    own = stored(_own_shingles(full.join(open_.select(F.col("b").alias("node")).distinct(), "node", "left_semi")), "near-own")
    counted = open_.join(own.withColumnRenamed("node", "b"), "b", "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0)))
    fits = 100 * F.col("shared") >= percent * (F.col("size") + F.greatest(F.col("least") - F.col("shared"), F.lit(0)))
    able = stored(counted.where(fits).groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("size", "root", "shared")]), "near-able")
    more = stored(_linked_in_blocks(able, full, percent), "near-more")
    roots = connected(links.union(more), "near-components")

    rooted = stored(nodes.select("digest", "node", "first_id").join(roots, "node", "left").select("digest", "first_id", F.coalesce("root", "node").alias("root")), "near-roots")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = rooted.join(least, "root").select("digest", "component_id")
    out = usable.select("doc_id", "n_shingles", "digest").join(component, "digest").select("doc_id", "n_shingles", "component_id")
    # A document with rows that have no shingles keeps the component of its others.
    rest = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles")
    empty = rest.select("doc_id").where("doc_id is not null").distinct()
    known = usable.join(empty, "doc_id", "left_semi").join(component, "digest").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    rest = rest.join(known, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
edges as (select x, y from links union all select y, x from links),
reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, e.y from reach r join edges e on e.x = r.b),
least as (select a, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from documents join least on a = doc_id left join sizes using (doc_id)
"""


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose group, linked from ``STAGE_PERCENT`` on, has a document of smaller doc_id.

    Documents with a null or empty text, or a null doc_id, stay; rows under one doc_id stay or go together; an empty table
    stays empty; all columns stay as they are.
    """
    gone = stored(near_duplicates(docs, STAGE_PERCENT, side=STAGE_SIDE).where("not kept").select("doc_id").distinct(), "near-gone")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
